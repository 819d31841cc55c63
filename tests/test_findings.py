"""One small test per finding of a review."""

import math
import pathlib
import shutil
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from framelake import tables  # noqa: E402
from framelake.errors import OperatorError  # noqa: E402
from framelake.operators import audio, graphs, layout, provenance, udfs  # noqa: E402
from framelake.plans import decisions  # noqa: E402
from framelake.session import clear_steps, shared_folder  # noqa: E402
from tools.check import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_exploded_grids_are_not_broadcast(spark):
    plan = entry.queries()["layout.densify"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan, plan


LINKED = [
    "prov.audit_gate", "prov.chain_append", "prov.chain_verify", "prov.open_case", "prov.record_decision", "prov.record_run", "prov.strict_audit",
    "prov.record_super_resolve", "prov.tamper_propagation", "src.audit_jsonl", "stream.chain_tail",
]


@pytest.mark.parametrize("name", LINKED)
def test_logs_on_a_cluster_use_the_key_of_the_tables(spark, monkeypatch, name):
    shared_folder(spark)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://head:7077")
    with pytest.raises(OperatorError):
        provenance.audit_key(spark.range(1))
    assert compare(entry.queries()[name](spark, SF).toPandas(), connect(SF).execute(entry.oracle_sql()[name]).df()).startswith("ok")


@pytest.fixture(scope="module", params=[256, 206, 201])
def ragged(request, tmp_path_factory):
    """The smallest tables with so few vectors that the last frame is short: beside a whole frame of its asset, alone, and of one line."""
    folder = tmp_path_factory.mktemp("ragged")
    for file in pathlib.Path(SF).glob("*.parquet"):
        shutil.copyfile(file, folder / file.name)
    whole = pq.read_table(f"{SF}/embeddings.parquet")
    pq.write_table(whole.filter(pc.less(whole["vec_id"], request.param)), folder / "embeddings.parquet")
    return str(folder)


def write_vectors(folder, count):
    """The smallest tables with the first ``count`` vectors."""
    for file in pathlib.Path(SF).glob("*.parquet"):
        shutil.copyfile(file, folder / file.name)
    whole = pq.read_table(f"{SF}/embeddings.parquet")
    pq.write_table(whole.filter(pc.less(whole["vec_id"], count)), folder / "embeddings.parquet")


def against_sql(spark, folder, name):
    verdict = compare(entry.queries()[name](spark, folder).toPandas(), connect(folder).execute(entry.oracle_sql()[name]).df())
    assert verdict.startswith("ok"), verdict


def test_models_take_short_frames(spark, ragged):
    against_sql(spark, ragged, "ml.batch_predict")
    tensors = layout.frame_to_chw(tables.px_emb_u8(spark, ragged), 255.0)
    short = udfs.predict_errors(tensors, (3, 40, 22)).count()
    assert short == tensors.where("height > 40").count() > 0
    assert udfs.batch_predict(tensors, udfs.invert_model, (3, 40, 22)).count() == tensors.count() - short


BY_SIZE = [
    "agg.all_metrics", "agg.fuse_median", "agg.mse", "agg.mse_uneven", "agg.psnr", "agg.ssim", "agg.stack", "agg.stack_max", "agg.stack_median",
    "agg.stack_min", "join.pair_errors_lone", "fx.phase_correlate", "fx.stabilize", "fx.super_resolve",
]


@pytest.mark.parametrize("name", BY_SIZE)
def test_sql_states_the_rule_for_sizes(spark, ragged, name):
    against_sql(spark, ragged, name)


EDGES = "project_id STRING, src STRING, dst STRING"


@pytest.mark.parametrize("shape", ["tree", "chain", "cycle", "self", "diamond", "two"])
def test_ancestors_of_shallow_and_deep_graphs(spark, shape):
    n = {"chain": 150}.get(shape, 40)
    up = {
        "tree": lambda k: [k // 2] if k else [], "chain": lambda k: [k - 1] if k else [], "cycle": lambda k: [(k - 1) % 5] if k < 5 else [k - 1],
        "self": lambda k: [k] if k == 0 else [k - 1], "diamond": lambda k: {k // 2, k // 3} if k else [], "two": lambda k: [k - 2] if k > 1 else [],
    }[shape]
    edges = [("p", str(s), str(k)) for k in range(n) for s in up(k)]
    above = {k: set() for k in range(n)}
    for k in range(n):
        todo = list(up(k))
        while todo:
            s = todo.pop()
            if s not in above[k]:
                above[k].add(s)
                todo += up(s)
    want = sorted((str(k), str(a)) for k in range(n) for a in above[k] | {k})
    nodes = spark.createDataFrame([("p", str(k)) for k in range(n)], "project_id STRING, node_id STRING")
    got = graphs.ancestors(nodes, spark.createDataFrame(edges, EDGES)).collect()
    assert sorted((r.node_id, r.ancestor) for r in got) == want


def test_ancestors_of_a_tree_join_rows_not_pairs(spark):
    clear_steps(spark)
    nodes, edges = tables.dag_orders(spark, SF)
    pairs = graphs.ancestors(nodes, edges).count()
    folder = f"{shared_folder(spark)}/framelake/{spark.sparkContext.applicationId}"
    assert max(spark.read.parquet(str(f)).count() for f in pathlib.Path(folder).iterdir()) <= nodes.count() < pairs


def test_chunks_are_filtered_a_few_at_a_time(spark):
    wave = [("a", 0, n, math.sin(n * 0.3)) for n in range(5000)]
    samples = spark.createDataFrame(wave, "asset_id STRING, channel INT, n BIGINT, v DOUBLE").coalesce(1)
    seen = [b.num_rows for b in audio._few_rows(iter([pa.RecordBatch.from_pydict({"x": range(600)})]))]
    assert max(seen) <= audio.CHUNKS_AT_ONCE and sum(seen) == 600
    few, many = [audio.k_weight(samples, chunk=size).orderBy("n").toPandas() for size in (8, 1024)]  # 625 chunks in some tasks, and 5
    np.testing.assert_allclose(few["v"], many["v"], atol=1e-9)


def longest_ways(n, pairs):
    """Levels by the definition: the longest way from a node without inputs, -1 where some input never comes."""
    level, open_ = {}, True
    while open_:
        open_ = [k for k in range(n) if k not in level and all(a in level for a, b in pairs if b == k)]
        level |= {k: max((level[a] + 1 for a, b in pairs if b == k), default=0) for k in open_}
    return {str(k): level.get(k, -1) for k in range(n)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nodes_that_lead_nowhere_take_levels_after_peeling(spark, monkeypatch, seed):
    """Widening graphs with stretches, twice named and missing inputs and a cycle; shells come off, and peeling reads what is left."""
    draw, n = np.random.default_rng(seed), 120
    pairs = {(k // 2, k) for k in range(1, n)} | {(k // 3, k) for k in range(1, n) if k % 4} | {(int(draw.integers(0, k)), k) for k in range(90, n)}
    pairs |= {(999, 100), (118, 70), (70, 118)} if seed > 1 else set()
    nodes = spark.createDataFrame([("p", str(k)) for k in range(n)], "project_id STRING, node_id STRING")
    edges = spark.createDataFrame([("p", str(a), str(b), 0) for a, b in [*pairs, (0, 2)]], "project_id STRING, src STRING, dst STRING, pos INT")
    monkeypatch.setattr(graphs, "AMPLE", 8)
    real, split = graphs._shells, []
    monkeypatch.setattr(graphs, "_shells", lambda e: split.append((e.count(), *real(e))) or split[0][1:])
    got = {r["node_id"]: r["level"] for r in graphs.topo_levels(nodes, edges).collect()}
    assert got == longest_ways(n, pairs)
    (whole, core, shells), = split
    assert len(shells) >= 2 and core.count() < whole / 2


def test_chains_keep_the_sign_of_a_rounded_zero(spark):
    rows = [("a", 0, 0.2751, 0.5, 0.7251, 0.3, 0.1), ("a", 1, 0.2749, 0.5, 0.7249, 0.3, 0.1)]  # brightness -0.0002 and 0.0002
    stats = spark.createDataFrame(rows, "asset_id STRING, frame_no INT, p01 DOUBLE, p50 DOUBLE, p99 DOUBLE, chroma_mean DOUBLE, edge_mean DOUBLE")
    got = {r["frame_no"]: r["params"] for r in decisions.auto_chain(stats).where("step_no = 0").collect()}
    assert got == {0: '{"brightness":-0.0,"contrast":2.0}', 1: '{"brightness":0.0,"contrast":2.0}'}


@pytest.mark.parametrize("vectors", [236, 211])
def test_crop_takes_frames_in_their_stated_size(spark, tmp_path, vectors):
    """The last frame has 36 or 11 of its 50 lines; the rectangle ends at the 40th."""
    write_vectors(tmp_path, vectors)
    against_sql(spark, tmp_path, "px.crop")


def test_wiener_gives_frames_in_their_stated_size(spark, ragged):
    against_sql(spark, ragged, "fx.wiener")
