"""Near copies, repeated text, search, shards, chats and the pipeline against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from framelake.llm import chat_views, near_copies, pack_shards, repeated_text, run_length_index, shingle_sets, threshold_search

DOCS = "doc_id BIGINT, text STRING, component_id INT, kept STRING, ranges INT, node STRING"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in rows], DOCS)


def words_of(text):
    return (text or "").encode().lower().split()


def near_brute(rows):
    """``{row: (set size, smallest id reachable)}`` by all pairs."""
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            same = rows[a][0] is not None and rows[b][0] is not None
            if same and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)].append(i)
    return [(i, len(sets[k]), min(least[root(k)]) if i is not None else None) for k, (i, _) in enumerate(rows)]


def mutated(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def near_rows():
    rng = random.Random(5)
    rows, n = [], 0
    for size in (3, 5, 6, 30, 120, 300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        family = [base]
        for _ in range(25):
            family.append(mutated(rng, rng.choice(family), rng.randrange(max(1, size // 30) + 1)))
        for words in family:
            rows.append((n, " ".join(words)))
            n += 1
    rng.shuffle(rows)
    return [(k, t) for k, (_, t) in enumerate(rows)] + [(900, None), (901, ""), (902, " \t\n"), (903, "One Two"), (904, "one\x0btwo"), (903, "One Two"), (None, rows[0][1]), (905, "z " * 20_000)]


def test_near_copies_equal_all_pairs(spark):
    rows = near_rows()
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_copies.near_duplicates(docs_of(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(near_brute(rows), key=str)
    kept = near_copies.drop_duplicates(docs_of(spark, rows))
    want = [i for i, _, c in near_brute(rows) if i is None or i == c]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str) and kept.columns == docs_of(spark, []).columns
    assert near_copies.near_duplicates(docs_of(spark, [])).count() == 0


def test_near_copies_finish_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    monkeypatch.setattr(near_copies, "ROWS_PER_GROUP", 8)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(mutated(rng, base, rng.randrange(5)))) for k in range(70)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_copies.near_duplicates(docs_of(spark, rows)).collect()]
    assert sorted(got) == sorted(near_brute(rows))


def test_near_copies_give_a_repeated_id_one_component(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(3, b), (5, a), (5, b), (5, b + " end"), (8, a), (9, c), (9, c), (9, ""), (12, c), (12, None)]
    got = sorted({(r.doc_id, r.component_id) for r in near_copies.near_duplicates(docs_of(spark, rows)).collect()})
    assert got == [(3, 3), (5, 3), (8, 3), (9, 9), (12, 9), (12, 12)]
    own = [(r.n_shingles, r.component_id) for r in near_copies.near_duplicates(docs_of(spark, rows)).where("doc_id = 12").collect()]
    assert sorted(own) == [(0, 12), (36, 9)]


def test_near_copies_in_hot_buckets_of_unlinked_members(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SALT_ROWS", 100)
    rng = random.Random(21)
    common = [f"c{k}" for k in range(60)]
    rows = [(k, " ".join(common + [f"w{rng.randrange(10**9)}" for _ in range(20)])) for k in range(1500)]  # similarity 0.58
    rows += [(2000 + k, " ".join(rows[k][1].split()[:-1] + ["other"])) for k in (3, 700, 1499)]
    got = {r.doc_id: r.component_id for r in near_copies.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {i: i - 2000 if i >= 2000 else i for i, _ in rows}


def test_near_copies_of_long_texts_are_dealt_by_their_size(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK_CELLS", 500)
    monkeypatch.setattr(near_copies, "CELLS_PER_GROUP", 1000)
    rng = random.Random(22)
    base = [f"w{k}" for k in range(900)]
    rows = [(k, " ".join(mutated(rng, base, rng.randrange(60)))) for k in range(40)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_copies.near_duplicates(docs_of(spark, rows)).collect()]
    assert sorted(got) == sorted(near_brute(rows))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100, 160)] + [(5, 9), (9, 5), (7, 7)], "a BIGINT, b BIGINT")
    got = {(r.node, r.component) for r in near_copies.components(edges).collect()}
    assert got == {(k, 100) for k in range(100, 161)} | {(5, 5), (9, 5)}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    s = shingle_sets.signatures([a, b, a], 512)
    assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - 0.6) < 0.08
    assert not (shingle_sets.bands(s, 4)[0] == shingle_sets.bands(s, 4)[0][0])[1:].any()


def repeat_brute(rows):
    seen, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - 49):
            if i is not None:
                seen[b[j : j + 50]] = min(i, seen.get(b[j : j + 50], i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if i is not None and seen[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        left = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def repeat_rows():
    rng = random.Random(9)
    parts = ["".join(rng.choice(al) for _ in range(rng.choice([30, 49, 50, 51, 90, 400]))) for al in ["ab", "abcdefgh ", "é\x00z"] for _ in range(9)]
    rows = [(k, "".join(rng.choice([rng.choice(parts), rng.choice(parts)[: rng.randrange(60)]]) for _ in range(rng.randrange(6)))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, "a" * 700), (203, "a" * 60), (204, "ab" * 300), (205, rows[3][1]), (205, rows[3][1]), (None, rows[3][1]), (206, parts[1] * 40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece", [64, 1 << 19])
def test_repeated_text_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(repeated_text, "PIECE_BYTES", piece)
    rows = repeat_rows()
    got = repeated_text.remove_repeats(docs_of(spark, rows), with_kept=True).collect()
    plain = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str)
    assert plain == sorted(repeat_brute(rows), key=str)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got if r.n_removed)
    assert repeated_text.remove_repeats(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [0, 2, 30])
def test_repeated_text_deals_hot_anchors_by_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(repeated_text, "HOT_STRETCHES", hot)
    monkeypatch.setattr(repeated_text, "STEP_BYTES", 3000)
    rows = repeat_rows()
    got = repeated_text.remove_repeats(docs_of(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == sorted(repeat_brute(rows), key=str)


def test_no_anchor_gathers_in_one_part(spark):
    """300 texts with a common 40-byte string between bytes of their own: one part held a stretch of every text."""
    rng = random.Random(4)
    own = lambda n: "".join(chr(rng.randrange(33, 127)) for _ in range(n))
    common_part = own(40)
    rows = [(k, own(80) + common_part + own(80)) for k in range(300)]
    texts = docs_of(spark, rows).coalesce(1).selectExpr("doc_id", "text", "xxhash64(text) AS text_hash")
    counted = repeated_text.repeated_anchors(texts, 12, 100).collect()
    hot = np.concatenate([np.frombuffer(r.anchors, np.uint64).reshape(-1, 2) for r in counted if r.text_hash is None])
    assert len(hot) and 100 < hot[:, 1].max() <= 300
    lists = collections.defaultdict(list)
    for r in counted:
        lists[r.text_hash].append(bytes(r.anchors))
    held = spark.createDataFrame([(k, t, lists[h]) for k, t, h in texts.collect()], "doc_id BIGINT, text STRING, anchors ARRAY<BINARY>").coalesce(1)
    sizes = collections.Counter()
    for r in repeated_text._send_stretches(held, 12, np.sort(hot[:, 0])).collect():
        if r.windows is not None:
            sizes[r.part] += len(r.windows) // repeated_text.WINDOW.itemsize
    assert len(sizes) == 12 and max(sizes.values()) < 0.2 * sum(sizes.values())


def test_matching_statistics_equal_brute_force():
    rng = random.Random(5)
    for round_no in range(150):
        letters = [b"ab", b"abc", bytes([0, 1, 255]), b"a"][round_no % 4]
        strings = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 8))]
        strings += strings[: round_no % 3]
        patterns = [bytes(rng.choice(letters + b"z") for _ in range(rng.randint(0, 25))) for _ in range(4)] + strings[:2]
        floor = rng.choice([1, 3, 5, 8, 20])
        index = run_length_index.RunLengthIndex(strings, floor)
        length, position, first = index.stream(patterns)
        at = 0
        for p in patterns:
            for j in range(len(p)):
                best = max(k for k in range(len(p) - j + 1) if any(p[j : j + k] in s for s in strings))
                where = next((n for n, s in enumerate(strings) if p[j : j + floor] in s), -1) if len(p) - j >= floor else -1
                assert (length[at], first[at]) == (best, where)
                assert bytes((index.text[position[at] :][:best] - 1).astype(np.uint8)) == p[j : j + best]
                at += 1


def test_covered_ranges_equal_brute_force():
    """Stretches as lists, with twice named documents and a stretch that stands twice in one text."""
    rng, floor = random.Random(4), repeated_text.FLOOR
    for _ in range(20):
        base = bytes(rng.choices(b"abcd", k=400))
        rows = []  # document, start, stretch
        for doc in [rng.randrange(12) for _ in range(30)]:
            a, n = rng.randrange(300), rng.randrange(floor, floor + 35)
            rows.append((doc, rng.randrange(1000), base[a : a + n]))
        rows += [(3, 2000, rows[0][2]), (3, 3000, rows[0][2]), (5, 4000, bytes(60)), (6, 4000, bytes(rng.choices(b"xyz", k=70)))]
        doc, start, found = (list(x) for x in zip(*rows, strict=True))
        got = repeated_text.covered_ranges(np.array(doc), np.array(start, np.int32), pa.array(found, pa.binary()))
        bytes_of = lambda ranges: {(d, i) for d, a, b in ranges for i in range(a, b)}
        want = []
        for d, at, s in rows:
            for w in range(len(s) - floor + 1):
                if any(s[w : w + floor] in t and e < d for e, _, t in rows):
                    want.append((d, at + w, at + w + floor))
        assert bytes_of(zip(*(x.tolist() for x in got), strict=True)) == bytes_of(want)
        texts = sorted(set(found))
        owner = np.array([min(d for d, _, t in rows if t == s) for s in texts])
        meets = [n for n, s in enumerate(texts) if any(s[w : w + floor] in t for w in range(len(s) - floor + 1) for t, o in zip(texts, owner, strict=True) if o != owner[n])]
        assert repeated_text._may_match(pa.array(texts, pa.binary()), owner).tolist() == meets and len(meets) <= len(texts) - 2


def test_stretches_go_to_parts_as_lists(spark, monkeypatch):
    """A step sends one row per part, whose lists name each distinct stretch once with its first document."""
    from pyspark.sql import functions as F

    passage = " ".join(f"word{k}" for k in range(60))
    df = docs_of(spark, [(k, f"{k} begins {passage} and ends {k}") for k in range(6)]).coalesce(1)
    texts = df.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    anchors = repeated_text.repeated_anchors(texts.select("text_hash", "text"), 4, 1000).groupBy("text_hash").agg(F.collect_list("anchors").alias("anchors"))
    held = texts.join(anchors, "text_hash").select("doc_id", "text", "anchors").coalesce(1)
    sent = repeated_text._send_stretches(held, 4, np.zeros(0, np.uint64)).where("docs IS NOT NULL").collect()
    assert len({r["part"] for r in sent}) == len(sent) > 1
    for r in sent:
        assert len(r["docs"]) == len(r["starts"]) == len(r["stretches"]) == len(set(map(bytes, r["stretches"])))
        assert all(d == 0 for d, s in zip(r["docs"], r["stretches"], strict=True) if bytes(s) in passage.encode())


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(threshold_search, "CANDIDATES_PER_BLOCK", 64)
    monkeypatch.setattr(threshold_search, "QUERIES_PER_BLOCK", 8)
    monkeypatch.setattr(threshold_search, "FIRST_DEPTH", 2)
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 6) / 64 + 0.001]) for k in range(300)]
    rows += [(400, [0.0] * 6), (420, [0.0] * 6), (440, None), (460, [1.0, None] + [0.0] * 4), (480, [float("nan")] * 6), (500, [float("inf")] + [0.0] * 5)]
    rows += [(None, [0.5] * 6), (520, [0.1, 0.2]), (540, [1.0, 2.0]), (560, [1e7] * 6), (20, rows[20][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id BIGINT, embedding ARRAY<DOUBLE>, score INT, dims INT")
    ints = {i: tuple(int(np.floor(64 * x)) for x in v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in ints if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), c) for c in ints if c != q and len(ints[c]) == len(ints[q]))
        want += [(q, n, c, -s) for n, (s, c) in enumerate(scored[:20], 1)]
    from pyspark.sql import functions as F

    got = [tuple(r) for r in threshold_search.search(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == sorted(want)
    assert threshold_search.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_threshold_saturates_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = float(2**62)
    df = spark.createDataFrame([(0, [big, 1.0]), (1, [big, 0.0]), (2, [-big, 0.0]), (3, [0.0, 1.0]), (4, [1e300, 0.0]), (5, [-1e300, 0.0])], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = [tuple(r) for r in threshold_search.search(df, F.col("vec_id") == 0, scale=1.0).orderBy("rank").collect()]
    most = 2**63 - 1
    assert got == [(0, 1, 1, most), (0, 2, 4, most), (0, 3, 3, 1), (0, 4, 2, -(2**63)), (0, 5, 5, -(2**63))]


def test_queries_side_by_side_take_their_best_along(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.integers(-9, 10, (900, 5)).astype(np.float32)
    vectors[600:] //= 4  # a block that cannot reach the scores of the others
    own = np.arange(0, 600, 20)
    blocks = [threshold_search.Block(part, vectors[part]) for part in (np.arange(0, 600, 2)[::-1], np.arange(1, 600, 2), np.arange(600, 900))]
    walked = []
    for block in blocks:
        block.lists = type("Watched", (), {"__getitem__": lambda _, key, lists=block.lists, block=block: walked.append(block) or lists[key]})()
    best = threshold_search.Best(len(own), 3, vectors.dtype)
    for block in blocks:
        block.offer(own, vectors[own], best)
    want = [(n, *x) for n, q in enumerate(own) for x in sorted((-float(vectors[q] @ v), k) for k, v in enumerate(vectors) if k != q)[:3]]
    assert [(n, -s, i) for n, i, s in zip(best.number.tolist(), best.ids.tolist(), best.scores.tolist(), strict=True)] == want
    assert blocks[0] in walked and blocks[2] not in walked
    assert threshold_search._heaps(7, 6, 6) == (7, 6) and threshold_search._heaps(76, 61, 6) == (10, 8)
    monkeypatch.setattr(threshold_search, "CANDIDATES_PER_BLOCK", 100)
    monkeypatch.setattr(threshold_search, "QUERIES_PER_BLOCK", 10)
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    found = []
    for heaps in ((9, 5), (2, 3), (1, 1)):
        monkeypatch.setattr(threshold_search, "_heaps", lambda wide, many, cores, heaps=heaps: heaps)
        found.append(sorted(tuple(r) for r in threshold_search.search(df, F.col("vec_id") % 20 == 0, k=3, scale=1.0).collect()))
    assert found[0] == found[1] == found[2]
    assert [(q, n, i, -s) for q, n, i, s in found[0] if q < 600] == [(own[n], r % 3 + 1, i, s) for r, (n, s, i) in enumerate(want)]


def test_threshold_stops_early():
    rng = np.random.default_rng(0)
    vectors = np.abs(rng.standard_cauchy((4000, 3)) * 50).astype(np.int64).astype(np.float64)
    block = threshold_search.Block(np.arange(4000), vectors)
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                seen.append(len(key))
            return super().__getitem__(key)

    block.vectors = block.vectors.view(Watched)
    ids, scores = block.top(7, vectors[7] + 1, 5)
    all_scores = sorted(((-float(v @ (vectors[7] + 1)), k) for k, v in enumerate(vectors) if k != 7))[:5]
    assert [(k, s) for s, k in all_scores] == [(int(i), -float(s)) for i, s in zip(ids, scores, strict=True)]
    assert sum(seen) < 2000


def test_shards(spark):
    rng = random.Random(2)
    rows = [(k, "x y" * rng.randrange(400)) for k in range(3000)]
    rows += [(k, "hot text") for k in range(5000, 6500)] + [(7000, None), (7001, ""), (7002, "big " * 3000), (7003, "ab"), (7003, "ab"), (None, "no id")]
    got = pack_shards.pack(docs_of(spark, rows)).toPandas()
    assert len(got) == len(rows) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted(zip(got["doc_id"].fillna(-1).astype(int), got["size"], got["text_crc32"], strict=True)) == want
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    size, count = got.groupby("shard")["size"].sum(), got.groupby("shard").size()
    assert len(size) == 40 and size.max() < 1.03 * size.mean() and size.min() > 0.97 * size.mean()
    groups = got.groupby(["text_crc32", "size"]).agg(rows=("shard", "size"), total=("size", "sum"), shards=("shard", "nunique"))
    cold = groups[(groups["rows"] < len(got) / 160) & (groups["total"] < 0.8 * got["size"].sum() / 160)]  # tokens nearly follow bytes
    assert len(cold) > 300 and (cold["shards"] == 1).all()
    assert count.max() <= 1.15 * count.mean()
    again = pack_shards.pack(docs_of(spark, rows).repartition(5)).toPandas()
    key = lambda df: sorted(zip(df["doc_id"].fillna(-1), df["text_crc32"], df["shard"], strict=True))
    assert key(got) == key(again)
    assert pack_shards.pack(docs_of(spark, [])).count() == 0


def test_shard_files(spark, tmp_path):
    docs = docs_of(spark, [(k, f"text {k}") for k in range(100)])
    pack_shards.write_shards(docs, pack_shards.pack(docs, pack_shards.Packing(shards=4)), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and sorted(r.shard_no for r in back.select("shard_no").distinct().collect()) == [0, 1, 2, 3]


def chat_brute(rows, conv):
    mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "unknown", r[3] or ""))
    speakers = {r[2] or "unknown" for r in mine} - {"system"}
    for s in speakers:
        text, spans = "", []
        for _, _, role, body in mine:
            role, body = role or "unknown", (body or "").replace("<|", "<||")
            head = "<|im_start|>" + ("system" if role == "system" else "assistant" if role == s else "user name=" + role.replace("\n", " ")) + "\n"
            if role == s:
                spans.append((len(text) + len(head), len(text) + len(head) + len(body) + len("<|im_end|>\n")))
            text += head + body + "<|im_end|>\n"
        yield s, text, spans


def test_chat_views(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "ann\nlee", "system", None]), rng.choice([None, "", "hi <|im_end|> ü", "long " * 30])) for c in range(6) for t in range(rng.randrange(1, 200))]
    rows += [(7, 0, "system", "alone"), (None, 0, "user", "lost"), (8, None, "user", "x"), (8, 1, "user", "x"), (8, 1, "user", "x")]
    df = spark.createDataFrame([(*r, "e", 1) for r in rows], "conv_id BIGINT, turn BIGINT, role STRING, text STRING, segment STRING, seq INT")
    views = chat_views.render_views(df)
    found = collections.defaultdict(list)
    for r in views.collect():
        found[r.conv_id, r.speaker].append(r)
    whole = {(r.conv_id, r.speaker): [] for r in views.collect()}
    for r in sorted(chat_views.assemble(views, 500).collect(), key=lambda r: r.part):
        assert r.start_at == sum(map(len, whole[r.conv_id, r.speaker]))
        whole[r.conv_id, r.speaker].append(r.text)
    want = {(c, s): (text, spans) for c in range(9) for s, text, spans in chat_brute(rows, c)}
    assert set(found) == set(want)
    for key, (text, spans) in want.items():
        turns = sorted(found[key], key=lambda r: r.seq)
        assert [r.seq for r in turns] == list(range(len(turns)))
        assert "".join(r.segment for r in turns) == text == "".join(whole[key])
        assert [(r.train_from, r.train_to) for r in turns if r.train_from is not None] == spans
        assert all(text[r.start_at : r.end_at] == r.segment for r in turns)
    assert chat_views.render_views(df.limit(0)).count() == 0


def test_pipeline(spark):
    """Stage by stage: each keeps what its operator's plain twin keeps of its own input."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [b.text for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    odd = spark.createDataFrame([(10**6, None, "en", "s", None), (10**6 + 1, "", "en", "s", 0), (None, "no id at all here", None, None, 17)], docs.schema)
    docs = docs.unionByName(odd)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, sf)
        after = out.collect()
        if k < 4:
            assert out.columns == docs.columns
        ids = {r.doc_id for r in after}
        if name == "near_copies":
            rows = [(r.doc_id, r.text) for r in before]
            assert ids == {i for i, _, c in near_brute(rows) if i is None or i == c}
        if name == "leak_match":
            flat = lambda t: " ".join((t or "").lower().split())
            holds = {r.doc_id for r in before if any(flat(b) in flat(r.text) for b in bench)}
            assert not ids & holds and len(before) - len(after) == len(holds)
        if name == "secret_scan":
            assert len(after) == len(before) and all(r.n_chars is None or r.text is None or r.n_chars == len(r.text) for r in after)
        docs = spark.createDataFrame(after, out.schema)
    assert docs.where("NOT round_trip").count() == 0
    assert corpus_pipeline.run(spark, sf).count() > 0
