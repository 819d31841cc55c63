"""Whitening and vector codes against numpy and brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.errors import OperatorError
from framelake.llm import vector_codes, vectors, whitening

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, x STRING, n INT"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], lab, "extra", 7) for i, v, lab in rows], SCHEMA)


def hard_rows(width=8, n=300, seed=1):
    """Random rows, a vector that a third of all rows share, repeated ids, null labels and rows that must be dropped."""
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.3, width).astype(np.float32).tolist(), int(i % 5) if i % 7 else None) for i in range(n)]
    common = rng.normal(0, 0.3, width).astype(np.float32).tolist()
    rows += [(n + i, common, 3) for i in range(n // 2)]
    rows += [(3, rows[3][1], 2), (None, rows[5][1], None), (None, rows[6][1], 1)]
    bad = [(9001, None, 1), (9002, [None] * width, 1), (9003, [float("nan")] * width, 1), (9004, [float("inf")] * width, None), (9005, [], 1)]
    return rows, bad


def expected_whitening(rows, weights):
    x = np.floor(64 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(int) + 1_000_000
    fit = x if weights == "counts" else np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = fit - sums / n
    e, u = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)
    return x, n, sums, e[order], u[:, order]


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening_equals_numpy(spark, weights):
    rows, bad = hard_rows()
    got = whitening.whiten(table(spark, rows + bad), components=5, weights=weights).toPandas()
    x, n, sums, e, u = expected_whitening(rows, weights)
    assert len(got) == 5 * len(rows)
    assert set(got["n"]) == {n}
    deviation = {(r[0], int(((n * v - sums) ** 2).sum())) for r, v in zip(rows, x, strict=True)}
    assert {(None if i != i else int(i), int(d)) for i, d in zip(got["vec_id"], got["deviation"], strict=True)} == deviation
    want = ((x - sums / n) @ u / np.sqrt(e))[:, :5]
    for k in range(5):
        mine = got[got["component"] == k + 1]
        assert np.allclose(mine["explained"], e[k] / e.sum(), rtol=1e-9)
        a, b = np.sort(mine["whitened"].to_numpy()), np.sort(want[:, k])
        assert np.allclose(a, b, atol=1e-8) or np.allclose(a, np.sort(-want[:, k]), atol=1e-8)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_of_flat_and_few_vectors(spark):
    flat = whitening.whiten(table(spark, [(1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1)])).toPandas()
    assert len(flat) == 4 and flat["whitened"].isna().all() and set(flat["deviation"]) == {0} and set(flat["explained"]) == {0.0}
    two = whitening.whiten(table(spark, [(1, [0.5, 0.25], 1), (2, [-0.5, 0.25], 1)])).toPandas()
    assert sorted(two[two["component"] == 1]["whitened"].round(9)) == [-1.0, 1.0]
    assert two[two["component"] == 2]["whitened"].isna().all()
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, hard_rows()[1])).count() == 0


def test_whitening_lists_what_it_leaves_out(spark):
    rows = [(k, [0.1 * k, 0.2], 1) for k in range(4)] + [(50, [1.0, 2.0, 3.0], 1), (51, [2.0**31, 0.0], 1), (52, None, 1)]
    done = whitening.whiten(table(spark, rows))
    assert {r[0] for r in done.select("vec_id").distinct().collect()} == {0, 1, 2, 3}
    assert {(r[0], r[1]) for r in whitening.unwhitened(table(spark, rows)).collect()} == {(50, "LAYOUT"), (51, "INVALID_PARAMETER")}


def test_exact_deviation_beyond_64_bits():
    x = np.array([[1 << 35, 0], [1_000_001, 1_000_000]])
    sums = [0, 0]
    assert whitening.deviations(x, 1, sums) == [None, 1_000_001**2 + 1_000_000**2]
    assert whitening.deviations(x[1:], 3, sums) == [9 * (1_000_001**2 + 1_000_000**2)]


def test_hot_keys_join_without_a_shuffle(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 50).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("c"), F.sum("id").alias("s"))
    got = {(r["id"], r["s"]) for r in vectors.join_spread(rows, facts, "k", "c", 1000, 10).collect()}
    sums = {r["k"]: r["s"] for r in facts.collect()}
    assert got == {(r["id"], sums[r["k"]]) for r in rows.collect()}


def brute_codes(rows, parts=4, entries=256, rounds=4):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = np.floor(1024 * np.array([r[1] for r in order], np.float32).astype(float)).astype(int)
    cut = np.split(whole, parts, axis=1)
    books = [c[:entries].copy() for c in cut]

    def assign():
        gaps = [((c[:, None] - b[None]) ** 2).sum(axis=2) for c, b in zip(cut, books, strict=True)]
        return [g.argmin(axis=1) for g in gaps], sum(g.min(axis=1) for g in gaps)

    for _ in range(rounds):
        for p, at in enumerate(assign()[0]):
            for k in set(at):
                mine = cut[p][at == k]
                books[p][k] = mine.sum(axis=0) // len(mine)
    at, error = assign()
    codes = ["".join(f"{a[i]:02x}" for a in at) for i in range(len(order))]
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    by_label = {}
    for r, e in zip(order, error, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    return sorted((str(r[0]), c, int(e), by_label[r[2]], sha) for r, c, e in zip(order, codes, error, strict=True)), books


@pytest.mark.parametrize("entries", [256, 20, 1])
def test_codes_equal_brute_force(spark, entries):
    rows, bad = hard_rows()
    got = vector_codes.encode(table(spark, rows + bad), entries=entries).collect()
    want, _ = brute_codes(rows, entries=entries)
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == want


def test_codes_of_few_rows_and_errors(spark):
    few = [(5, [0.1, 0.2, 0.3, 0.4], None), (7, [0.5, 0.2, 0.1, 0.0], None)]
    got = vector_codes.encode(table(spark, few)).collect()
    assert sorted(r["code"] for r in got) == sorted(c for _, c, *_ in brute_codes(few)[0])
    assert {r["label_error"] for r in got} == {0}
    assert vector_codes.encode(table(spark, [])).count() == 0
    with pytest.raises(OperatorError):
        vector_codes.encode(table(spark, [(1, [0.1, 0.2, 0.3], 1)]))
    large = few + [(8, [20000.0, 0.0, 0.0, 0.0], 1), (9, [0.1], 1)]
    assert {(r[0], r[1]) for r in vector_codes.uncoded(table(spark, large)).collect()} == {(8, "INVALID_PARAMETER"), (9, "LAYOUT")}
    assert vector_codes.encode(table(spark, large)).count() == 2


def test_decoded_codes_have_the_stated_error(spark):
    rows, _ = hard_rows(n=60)
    codes = vector_codes.encode(table(spark, rows), entries=16, rounds=1)
    _, books = brute_codes(rows, entries=16, rounds=1)
    back = vector_codes.decode(codes.where("vec_id IS NOT NULL"), books).collect()
    whole = {r[0]: np.floor(1024 * np.array(r[1], np.float32).astype(float)) for r in rows}
    assert all(int(((whole[r["vec_id"]] - np.array(r["vector"])) ** 2).sum()) == r["error"] for r in back)


@pytest.mark.parametrize("spread", [3, 2000, 1 << 23])
def test_orchard_walks_find_the_nearest_and_skip_entries(spread):
    rng = np.random.default_rng(spread)
    centers = rng.integers(-spread, spread, (40, 3))
    entries = np.concatenate([centers, centers[:7], rng.integers(-spread, spread, (90, 3))])  # some entries twice
    points = entries[rng.integers(0, len(entries), 500)] + rng.integers(-max(1, spread // 50), max(2, spread // 50), (500, 3))
    finder = vector_codes.Orchard(entries)
    at, error = finder.nearest(points)
    gaps = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (at == gaps.argmin(axis=1)).all() and (error == gaps.min(axis=1)).all()
    if spread > 3:
        assert finder.met < 0.8 * gaps.size  # walks end before the lists do
