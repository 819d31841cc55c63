import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from framelake.errors import OperatorError
from framelake.operators import diffmerge, graphs, provenance
from framelake.plans import chain, decisions, params
from framelake.plans.catalogue import Effect, Param, Registry
from framelake.sources import images, luts, recipes, tables


@pytest.fixture(scope="module")
def log(spark):
    rows = [(c, i, f"2024-01-01T00:00:{i:02d}.000000", "op1", "note", f"n{i}") for c in ("a", "b") for i in range(9)]
    plain = spark.createDataFrame(rows, "case_id STRING, seq BIGINT, at STRING, operator_key STRING, action STRING, note STRING")
    blank = {c: F.lit(None).cast("string") for c in ("input_hash", "input_sha256", "output_hash", "output_sha256", "recipe_hash", "recipe_sha256")}
    return provenance.chain_append(plain.withColumns(blank))


def test_link_is_a_plain_hmac(log):
    rows = log.where("case_id = 'a'").orderBy("seq").collect()
    assert rows[0]["prev_link"] == provenance.GENESIS
    text = f'{{"action":"note","at":"{rows[1]["at"]}","case_id":"a","note":"n1","operator_key":"op1","prev_link":"{rows[0]["link"]}","seq":1}}'
    assert rows[1]["link"] == hmac.new(provenance.DEFAULT_KEY, text.encode(), hashlib.sha256).hexdigest()


@pytest.mark.parametrize("bits", [16, 1, 2])
def test_verify_finds_tampering(log, monkeypatch, bits):
    monkeypatch.setattr(provenance, "TAIL_BITS", bits)
    assert {r["ok"] for r in provenance.chain_verify(log).collect()} == {True}
    changed = log.withColumn("note", F.when((F.col("case_id") == "a") & (F.col("seq") == 4), "x").otherwise(F.col("note")))
    got = {r["case_id"]: r for r in provenance.chain_verify(changed).collect()}
    assert got["a"]["first_bad_seq"] == 4 and got["a"]["reason"] == "link does not verify" and got["b"]["ok"]
    gone = provenance.chain_verify(log.where("not (case_id = 'a' and seq = 3)")).where("case_id = 'a'").first()
    assert (gone["first_bad_seq"], gone["reason"]) == (4, "seq mismatch")
    twice = provenance.chain_verify(log.unionByName(log.where("case_id = 'b' and seq = 8"))).where("case_id = 'b'").first()
    assert not twice["ok"]
    trusted = provenance.tamper_propagation(changed).where("case_id = 'a' and trusted").count()
    assert trusted == 4


def test_appending_continues_and_skips_broken(spark, log):
    drafts = spark.createDataFrame([("a", 0, "t", "op2"), ("b", 0, "t", "op2"), ("b", 1, "u", "op2")], "case_id STRING, draft_no BIGINT, at STRING, operator_key STRING")
    broken = log.withColumn("note", F.when(F.col("case_id") == "a", "x").otherwise(F.col("note")))
    fresh = provenance.record_run(broken, drafts)
    assert {(r["case_id"], r["seq"]) for r in fresh.collect()} == {("b", 9), ("b", 10)}
    cols = log.columns
    assert provenance.chain_verify(log.where("case_id = 'b'").unionByName(fresh.select(*cols))).first()["ok"]


def test_fips_false_without_artifacts(log):
    assert not provenance.fips_summary(log).first()["fips_ok"]


NODES = "project_id STRING, node_id STRING, effect_id STRING, label STRING, inputs ARRAY<STRING>, params MAP<STRING, STRING>"


def test_graph_diff_round_trip(spark):
    a = spark.createDataFrame([("p", "1", "e", "l", [], {"k": "1"}), ("p", "2", "e", "l", ["1"], {"k": "1"}), ("p", "3", "e", "l", ["2"], {})], NODES)
    b = spark.createDataFrame([("p", "1", "e", "l", [], {"k": "2"}), ("p", "2", "f", "l", ["1"], {"k": "1"}), ("p", "4", "e", "l", ["2", "1"], {})], NODES)
    diff = diffmerge.diff_graphs(a, b)
    assert ("node_removed", "2") in {(r["change"], r["item"]) for r in diff.collect()}
    shape = lambda df: {r["node_id"]: (r["effect_id"], sorted(r["inputs"]), r["params"]) for r in df.collect()}
    assert shape(diffmerge.apply_graph(a, b, diff)) == shape(b)


def test_sinks_follow_merge_and_removal(spark):
    node = lambda p, i, e: (p, i, e, "l", [], {})
    a = spark.createDataFrame([node("p", "1", "e"), node("p", "2", "e"), node("p", "3", "e"), node("q", "1", "e")], NODES)
    b = spark.createDataFrame([node("p", "1", "e"), node("p", "2", "f"), node("q", "1", "e")], NODES)
    sinks = spark.createDataFrame([("p", "1"), ("p", "2"), ("p", "3"), ("q", "1")], "project_id STRING, node_id STRING")
    pairs = lambda df: sorted((r["project_id"], r["node_id"]) for r in df.collect())
    assert pairs(diffmerge.apply_sinks(sinks, a, diffmerge.diff_graphs(a, b))) == [("p", "1"), ("q", "1")]
    bad = spark.createDataFrame([("p", "node_removed", "1"), ("p", "node_removed", "9"), ("q", "node_removed", "1")], "project_id STRING, change STRING, item STRING")
    assert pairs(diffmerge.apply_sinks(sinks, a, bad)) == [("p", "1"), ("p", "2"), ("p", "3")]
    more = spark.createDataFrame([("p", "1"), ("r", "7")], sinks.schema)
    assert pairs(diffmerge.merge_sinks(sinks, more)) == [*pairs(sinks), ("r", "7")]


def test_diff_with_missing_node_is_refused(spark):
    a = spark.createDataFrame([("p", "1", "e", "l", [], {})], NODES)
    diff = spark.createDataFrame([("p", "node_removed", "9")], "project_id STRING, change STRING, item STRING")
    assert diffmerge.graph_diff_errors(a, diff).first()["reason"] == "missing node 9"
    assert diffmerge.apply_graph(a, a, diff).count() == 1


def graph(spark, n, pairs):
    nodes = spark.createDataFrame([("p", str(i)) for i in range(n)], "project_id STRING, node_id STRING")
    edges = spark.createDataFrame([("p", str(a), str(b), 0) for a, b in pairs], "project_id STRING, src STRING, dst STRING, pos INT")
    return nodes, edges


def test_levels_on_chain_diamond_and_cycle(spark):
    level = lambda g: {r["node_id"]: r["level"] for r in graphs.topo_levels(*g).collect()}
    chain_pairs = [(i, i + 1) for i in range(299)]
    assert level(graph(spark, 300, chain_pairs)) == {str(i): i for i in range(300)}
    assert level(graph(spark, 6, [(0, 1), (0, 2), (1, 3), (2, 4), (4, 3), (3, 5)])) == {"0": 0, "1": 1, "2": 1, "4": 2, "3": 3, "5": 4}
    assert level(graph(spark, 5, [(0, 1), (1, 2), (2, 1), (2, 3)])) == {"0": 0, "1": -1, "2": -1, "3": -1, "4": 0}
    assert level(graph(spark, 3, [(0, 1), (1, 2), (2, 0)])) == {"0": -1, "1": -1, "2": -1}


def test_ancestors_survive_cycles(spark):
    got = {(r["node_id"], r["ancestor"]) for r in graphs.ancestors(*graph(spark, 4, [(0, 1), (1, 2), (2, 1), (2, 3)])).collect()}
    assert {a for n, a in got if n == "3"} == {"0", "1", "2", "3"}
    ring = {(r["node_id"], r["ancestor"]) for r in graphs.ancestors(*graph(spark, 4, [(0, 1), (1, 2), (2, 0), (2, 3)])).collect()}
    assert ring == {(n, a) for n in "0123" for a in "012"} | {("3", "3")}
    assert graphs.validate(*graph(spark, 2, [(0, 1), (7, 1)])).first()["reason"] == "input references missing node 7"


def test_parameters(spark):
    reg = Registry([Effect("e", lambda p: p, (Param("f", "float", 1.5, 0, 2), Param("n", "int", 3, 0, 5), Param("s", "choice", "x", options=("x", "y")), Param("b", "bool", True)))])
    raw = spark.createDataFrame([("ok", "f=9"), ("ok", "s=zzz"), ("bad1", "n=6"), ("bad2", "n=1.5"), ("bad3", "q=1"), ("bad4", "f=2.5")], "owner_id STRING, kv STRING")
    given, rows = params.parse_kv(raw), reg.spec_rows(spark)
    errors = {(r["owner_id"], r["reason"]) for r in params.param_errors(given, rows).collect()}
    assert errors == {("bad1", "above max"), ("bad2", "type mismatch"), ("bad3", "unknown parameter"), ("bad4", "above max")}
    strict = {r["owner_id"] for r in params.param_errors(given, rows, strict=True).collect()}
    assert "ok" in strict
    filled = {r["key"]: r for r in params.fill_params(given, reg.get("e").params, raw.select("owner_id").distinct(), rows).collect()}
    assert filled["f"]["d"] == 9.0 and filled["n"]["i"] == 3 and filled["s"]["s"] == "zzz" and filled["b"]["b"] is True


def test_templates():
    assert decisions.clarify_chain("nonsense") == decisions.clarify_chain("standard")
    assert decisions.clarify_chain("police", True)[-1] == ("upscale.lanczos", "clarify upscale", {"scale": 4.0, "lobes": 3})
    assert [s[2]["amount"] for s in decisions.clarify_chain("plate") if s[0] == "sharpen.unsharp_mask"] == [0.55, 0.385, 0.22]
    reg = Registry()
    for steps in decisions.templates().values():
        for effect, _, given in steps:
            if effect != "denoise.gaussian":
                reg.bind(effect, given)
    for bad in (decisions.style_chain, decisions.palette_chain):
        with pytest.raises(OperatorError):
            bad("nope")


def test_recipe_values(spark):
    text = '{"input":"i","output":"o","chain":[{"effect":"e","params":{"a":1,"b":1.5,"c":true,"d":"x","e":99999999999999999999,"f":[1]}}]}'
    df = spark.createDataFrame([("r", text)], "recipe_id STRING, json STRING")
    kinds = {r["key"]: r["kind"] for r in recipes.recipe_params(df).collect()}
    assert kinds == {"a": "int", "b": "float", "c": "bool", "d": "string", "e": "float", "f": "unsupported"}
    assert recipes.recipe_errors(df).count() == 1
    with pytest.raises(OperatorError):
        chain.parse_recipe(text)


def cube(spark, text):
    lines = [("l", i, v) for i, v in enumerate(text.split("\n"))]
    return luts.parse_cube(spark.createDataFrame(lines, "lut_id STRING, line_no INT, value STRING"))


def test_cube_files(spark, tmp_path, frame, noise, block):
    body = "\n".join(f"{r} {g} {b}" for b in (0, 1) for g in (0, 1) for r in (0, 1))
    assert luts.cube_errors(*cube(spark, f"# c\nLUT_3D_SIZE 2\n{body}")).isEmpty()
    for text, reason in [("LUT_1D_SIZE 4\n0 0 0", "expected 3D lattice, got 1D"), (body, None), (f"LUT_3D_SIZE 3\n{body}", "sample count mismatch"),
                         (f"LUT_3D_SIZE 2\nDOMAIN_MAX 0 1 1\n{body}", "DOMAIN_MAX must exceed DOMAIN_MIN")]:
        found = luts.cube_errors(*cube(spark, text)).first()
        assert reason is None or found["reason"] == reason
    path = tmp_path / "id.cube"
    path.write_text(f"LUT_3D_SIZE 2\n{body}\n")
    img = noise[:5, :5]
    done = chain.apply_chain(frame(img), [("color.lut3d", None, {"path": str(path)})])
    import numpy as np

    np.testing.assert_allclose(block(done), img, atol=1e-12)


def test_json_sources_fail_fast(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"case_id":"a","seq":0}\n\n   \n{"case_id":"a","seq":1}\n')
    assert tables.read_audit(spark, str(path)).count() == 2
    path.write_text('{"case_id":"a","seq":0}\nnot json\n')
    with pytest.raises(Exception):
        tables.read_audit(spark, str(path)).collect()
    bad = spark.createDataFrame([('{"schema":"other/v9","id":"p"}',)], "json STRING")
    with pytest.raises(Exception):
        tables.parse_projects(bad).collect()


def test_frame_extract_names(spark):
    df = spark.createDataFrame([("a", i) for i in range(30)], "asset_id STRING, frame_no INT")
    assert [r["output_name"] for r in tables.frame_extract(df, 5, 20, 7).orderBy("frame_no").collect()] == ["frame_000005.png", "frame_000012.png", "frame_000019.png"]
    with pytest.raises(OperatorError):
        tables.frame_extract(df, 5, 5)


def png(path, img):
    import struct
    import zlib

    h, w, _ = img.shape
    raw = b"".join(b"\0" + row.tobytes() for row in img)
    part = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_image_files(spark, tmp_path, block):
    import numpy as np

    from framelake.operators import layout

    img = np.random.default_rng(0).integers(0, 256, (5, 7, 4), dtype=np.uint8)
    png(tmp_path / "a.png", img)
    (tmp_path / "notes.txt").write_text("x")
    packed = images.read_images(spark, str(tmp_path / "a.png"))
    np.testing.assert_array_equal(block(layout.to_pixels(packed)), img)
    listed = {r["uri"].rsplit("/", 1)[1]: r for r in images.binary_inventory(spark, str(tmp_path)).collect()}
    assert listed["a.png"]["kind"] == "still_image" and listed["notes.txt"]["kind"] == "other"
    assert listed["notes.txt"]["hash"] == "sha256:" + hashlib.sha256(b"x").hexdigest()


def test_shift_report_reaches_the_log_but_not_a_broken_one(spark):
    first = [(c, 0, "2024-01-01T00:00:00.000000", "op", "case-init", "") for c in ("good", "bad")]
    draft = spark.createDataFrame(first, "case_id STRING, seq BIGINT, at STRING, operator_key STRING, action STRING, note STRING")
    log = provenance.chain_append(provenance._draft(draft).select(*provenance.BEFORE_LINK, *provenance.AFTER_LINK))
    log = log.withColumn("note", F.when(F.col("case_id") == "bad", "changed").otherwise(F.col("note")))
    runs = spark.createDataFrame(
        [(c, 0, "2024-01-02T00:00:00.000000", "op", a, 2, "median", r) for c, a, r in (("good", "a", "seen"), ("bad", "a", ""), ("good", "none", ""))],
        "case_id STRING, draft_no INT, at STRING, operator_key STRING, asset_id STRING, scale INT, fuse STRING, remark STRING")
    shifts = spark.createDataFrame([("a", 1, 0.5, -1.0, 0.9), ("a", 0, 0.0, 0.0, 1.0)], "asset_id STRING, frame_no INT, dx DOUBLE, dy DOUBLE, peak DOUBLE")
    rows = provenance.record_super_resolve(log, runs, shifts).collect()
    assert [(r["case_id"], r["seq"], r["action"]) for r in rows] == [("good", 1, "super-resolve")]
    assert rows[0]["note"].startswith("seen | super-resolve of 2 frames at scale 2 by median") and '"frame_no":1,"dx":0.5,"dy":-1.0' in rows[0]["note"]
    assert [r["case_id"] for r in provenance.super_resolve_errors(runs, shifts).collect()] == ["good"]
