"""Queries over audit logs, projects, graphs, parameters and recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake import tables as t
from framelake.operators import diffmerge, graphs, layout, provenance
from framelake.plans import chain as chains
from framelake.plans import params
from framelake.plans.catalogue import Effect, Param, Registry
from framelake.session import cut_lineage, staging_path
from framelake.sources import images, luts, recipes
from framelake.sources import tables as src
from framelake.workload.registry import query
from framelake.workload.sql import (
    ARTIFACTS,
    AUDIT,
    AUDIT_BAD,
    CASES,
    ENTRIES,
    ITEMS,
    KEY,
    MODELS,
    NODES,
    PX_U8,
    RECIPE_PARTS,
    checked,
    linked,
    values,
)

# Parameters and sources

_REGISTRY = Registry([Effect("test", lambda px: px, (Param("k", "float", 1.0, 0.0, 90.0), Param("gain", "float", 1.0)))])


_KV = """kv AS (SELECT CAST(event_id AS VARCHAR) AS owner_id, 'k=' || json_extract_string(props, '$.k') AS kv FROM events
  UNION ALL SELECT CAST(event_id AS VARCHAR), 'bogus=true' FROM events WHERE event_id % 50 = 0)"""


@query("src.kv_params", f"""WITH {_KV} SELECT owner_id, split_part(kv,'=',1) AS key, CASE WHEN v IN ('true','false') THEN 'bool' WHEN try_cast(v AS BIGINT) IS NOT NULL THEN 'int' WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'string' END AS kind, v AS value
  FROM (SELECT *, substr(kv, instr(kv,'=')+1) AS v FROM kv)""")
def kv_params(spark, sf):
    p = params.parse_kv(t.par_ev(spark, sf))
    return p.select("owner_id", "key", "kind", F.coalesce("s", F.col("b").cast("string"), F.col("i").cast("string"), F.col("d").cast("string")).alias("value"))


@query("param.validate_errors", """SELECT CAST(event_id AS VARCHAR) AS owner_id, 'bogus' AS key, 'INVALID_PARAMETER' AS code, 'unknown parameter' AS reason FROM events WHERE event_id % 50 = 0
  UNION ALL SELECT CAST(event_id AS VARCHAR), 'k', 'INVALID_PARAMETER', 'above max' FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 90""")
def param_errors(spark, sf):
    return params.param_errors(params.parse_kv(t.par_ev(spark, sf)), _REGISTRY.spec_rows(spark), strict=True)


@query("param.validate_fill", """WITH e AS (SELECT CAST(event_id AS VARCHAR) AS owner_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE event_id % 50 <> 0)
  SELECT owner_id, 'k' AS key, k AS value FROM e UNION ALL SELECT owner_id, 'gain', 1.0 FROM e""")
def validate_fill(spark, sf):
    given = params.parse_kv(t.par_ev(spark, sf))
    return params.fill_params(given, _REGISTRY.get("test").params, given.select("owner_id").distinct(), _REGISTRY.spec_rows(spark)).select("owner_id", "key", F.col("d").alias("value"))


@query("entitlement.filter", """SELECT CAST(c_custkey AS VARCHAR) AS owner_id, c_mktsegment AS edition FROM customer
  WHERE c_custkey % 4 IN (0,1) AND (c_custkey % 9 = 0 OR TIMESTAMP '2024-01-10' < TIMESTAMP '2024-01-15' + CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END * (c_custkey % 60) AS INTEGER) * INTERVAL 1 DAY)""")
def entitlement(spark, sf):
    return params.entitled(t.entitlements(spark, sf), "restore", "2024-01-10 00:00:00").select("owner_id", "edition")


@query("src.recipe_json", f"""WITH {RECIPE_PARTS}, s AS (SELECT recipe_id, CAST(i AS INTEGER) AS step_no, json_extract(json, '$.chain[' || i || ']') AS st FROM recs, LATERAL (SELECT unnest(range(CAST(json_array_length(json, '$.chain') AS BIGINT))) AS i)),
  k AS (SELECT recipe_id, step_no, json_extract_string(st, '$.effect') AS effect, unnest(json_keys(st, '$.params')) AS key, st FROM s), v AS (SELECT *, json_extract(st, '$.params.' || key) AS j FROM k)
  SELECT recipe_id, step_no, effect, key, CASE WHEN json_type(j)='BOOLEAN' THEN 'bool' WHEN json_type(j) IN ('UBIGINT','BIGINT') THEN 'int' WHEN json_type(j)='DOUBLE' THEN 'float' ELSE 'string' END AS kind, trim(CAST(j AS VARCHAR), '"') AS text FROM v""")
def recipe_json(spark, sf):
    return recipes.recipe_params(t.rec_part(spark, sf)).select("recipe_id", "step_no", "effect", "key", "kind", "text")


@query("graph.chain_from_recipe", f"""WITH {RECIPE_PARTS}, s AS (SELECT recipe_id, i, coalesce(json_extract_string(json, '$.chain[' || i || '].label'), 'step' || lpad(CAST(i AS VARCHAR), 2, '0')) AS node, json_array_length(json, '$.chain') AS n FROM recs, LATERAL (SELECT unnest(range(CAST(json_array_length(json, '$.chain') AS BIGINT))) AS i))
  SELECT recipe_id, CASE WHEN i = 0 THEN 'source' ELSE lag(node) OVER (PARTITION BY recipe_id ORDER BY i) END AS src, node AS dst, CAST(i AS INTEGER) AS pos FROM s
  UNION ALL SELECT recipe_id, node, 'sink', CAST(n AS INTEGER) FROM s WHERE i = n - 1""")
def chain_from_recipe(spark, sf):
    return graphs.chain_from_recipe(recipes.recipe_steps(t.rec_part(spark, sf)))


@query("src.audit_jsonl", f"WITH RECURSIVE {AUDIT} SELECT case_id, seq, action, note, operator_key, prev_link, link FROM audit")
def audit_jsonl(spark, sf):
    log = t.case_ev(spark, sf)
    lines = log.select(F.to_json(F.struct(*[c for c in log.columns if c != "event_id"])).alias("value"))
    blank = log.where("seq = 0").select(F.lit("   ").alias("value"))
    return src.parse_audit(lines.unionByName(blank)).select("case_id", "seq", "action", "note", "operator_key", "prev_link", "link")


def _projects(spark, sf):
    """Customers as project documents: their orders are nodes, the latest order the sink."""
    o = t.project_nodes(spark, sf, "base")
    docs = o.groupBy("project_id").agg(
        F.collect_list(F.struct(F.col("node_id").alias("id"), F.col("effect_id").alias("effect"), "label", "inputs", "params")).alias("nodes"),
        F.array(F.max(F.col("node_id").cast("bigint")).cast("string")).alias("sinks"))
    empty = lambda s: F.from_json(F.lit("[]"), f"ARRAY<STRUCT<{s}>>")
    return docs.select(F.to_json(F.struct(
        F.lit(src.PROJECT_TAG).alias("schema"), F.col("project_id").alias("id"), "nodes", "sinks",
        empty("id: STRING, name: STRING").alias("presets"), F.create_map(F.lit("m"), F.lit("v1")).alias("models"))).alias("json"))


@query("src.project_json", f"WITH {NODES} SELECT project_id, node_id, effect_id AS effect, label, src AS inputs, status || '/' || totalprice AS params FROM base")
def project_json(spark, sf):
    n = src.project_tables(src.parse_projects(_projects(spark, sf)))["nodes"]
    return n.select("project_id", F.col("id").alias("node_id"), "effect", "label", F.array_join("inputs", ",").alias("inputs"), F.concat(F.try_element_at("params", F.lit("status")), F.lit("/"), F.try_element_at("params", F.lit("totalprice"))).alias("params"))


@query("agg.project_summary", f"""WITH {NODES} SELECT project_id, CAST(0 AS BIGINT) AS assets_count, count(*) AS nodes_count, CAST(0 AS BIGINT) AS presets_count, CAST(0 AS BIGINT) AS history_count, CAST(1 AS BIGINT) AS sinks_count, CAST(1 AS BIGINT) AS models_count FROM base GROUP BY project_id""")
def project_summary(spark, sf):
    return src.project_summary(src.project_tables(src.parse_projects(_projects(spark, sf))))


@query("src.cube_lut", """SELECT CAST(n_nationkey AS VARCHAR) AS lut_id, CAST(i % 3 AS INTEGER) AS ri, CAST((i // 3) % 3 AS INTEGER) AS gi, CAST(i // 9 AS INTEGER) AS bi, round((i % 3)/2.0, 6) AS r, round(((i // 3) % 3)/2.0*(1 - n_regionkey/10.0), 6) AS g, round((i // 9)/2.0, 6) AS b
  FROM nation, (SELECT unnest(range(27)) AS i)""")
def cube_lut(spark, sf):
    axis = F.explode(F.sequence(F.lit(0), F.lit(26))).alias("i")
    n = t.read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("lut_id"), "n_regionkey")
    row = F.format_string("%.6f %.6f %.6f # point", (F.col("i") % 3) / 2.0, (F.floor(F.col("i") / 3) % 3) / 2.0 * (1 - F.col("n_regionkey") / 10.0), F.floor(F.col("i") / 9) / 2.0)
    body = n.select("lut_id", "n_regionkey", axis).select("lut_id", (F.col("i") + 3).alias("line_no"), row.alias("value"))
    head = n.select("lut_id", F.posexplode(F.array(F.lit('TITLE "t"'), F.lit("# comment"), F.lit("LUT_3D_SIZE 3"))).alias("line_no", "value"))
    lattice, headers = luts.parse_cube(head.unionByName(body))
    good = lattice.join(luts.cube_errors(lattice, headers), "lut_id", "left_anti")
    return good.select("lut_id", F.col("ri").cast("int").alias("ri"), "gi", "bi", "r", "g", "b")


@query("src.kind_of", """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'still_image' WHEN page_id % 4 = 1 THEN 'video' WHEN page_id % 4 = 2 THEN 'still_image' ELSE 'other' END AS kind FROM pages""")
def kind_of(spark, sf):
    ext = F.element_at(F.array(*[F.lit(e) for e in (".PNG", ".mkv", ".cr3", ".html")]), (F.col("page_id") % 4).cast("int") + 1)
    return t.read(spark, sf, "pages").select("page_id", images.kind_of(F.concat("url", ext)).alias("kind"))


@query("src.table_inventory")
def table_inventory(spark, sf):
    found = images.binary_inventory(spark, sf)
    return found.select(F.regexp_extract("uri", "[^/]+$", 0).alias("name"), "size", "hash", "kind")


_PAGE_FILES = """pf AS (SELECT 'host' || page_id % 10 || '/page' || page_id || '.' || (['PNG', 'mkv', 'cr3', 'html'])[page_id % 4 + 1] AS name, coalesce(html, '') AS html,
  (['still_image', 'video', 'still_image', 'other'])[page_id % 4 + 1] AS kind FROM pages)"""


def _name(column="uri"):
    """A file's path below its folder of files."""
    return F.regexp_extract(column, "[^/]+/[^/]+$", 0).alias("name")


def _page_folder(spark, sf):
    path = staging_path(spark, "pages")
    images.write_blobs(t.page_files(spark, sf), path)
    return path


@query("src.binary_inventory", f"WITH {_PAGE_FILES} SELECT name, strlen(html) AS size, 'sha256:' || sha256(html) AS hash, kind FROM pf")
def binary_inventory(spark, sf):
    return images.binary_inventory(spark, _page_folder(spark, sf)).select(_name(), "size", "hash", "kind")


@query("src.file_blocks", f"""WITH {_PAGE_FILES} SELECT name, b AS block, 1000 * b AS start, 'sha256:' || sha256(encode(html)[1000 * b + 1 : 1000 * b + 1000]) AS hash
  FROM pf, LATERAL (SELECT unnest(range(greatest(1, (strlen(html) + 999) // 1000))) AS b)""")
def file_blocks(spark, sf):
    return images.file_blocks(spark, _page_folder(spark, sf), block_bytes=1000).select(_name(), "block", "start", "hash")


def _image_folder(spark, sf):
    path = staging_path(spark, "images")
    images.write_blobs(t.image_files(spark, sf), path)
    return path


@query("src.image", f"WITH {PX_U8} SELECT asset_id || '/' || frame_no || '.png' AS name, {KEY.split('frame_no, ')[1]}, r, g, b, a FROM px_u8 WHERE frame_no % 7 <> 6")
def image(spark, sf):
    px = layout.to_pixels(images.read_images(spark, _image_folder(spark, sf)))
    return px.select(_name("asset_id"), "y", "x", "r", "g", "b", "a")


@query("src.image_errors", f"WITH {PX_U8} SELECT DISTINCT asset_id || '/' || frame_no || '.png' AS name, 'LAYOUT' AS code FROM px_u8 WHERE frame_no % 7 = 6")
def image_errors(spark, sf):
    return images.image_errors(spark, _image_folder(spark, sf)).select(_name(), "code")


# Joins and batch bookkeeping

_BLOBS = "blobs AS (SELECT CAST(doc_id AS VARCHAR) AS blob_id, 'sha256:' || sha256(text) AS hash, n_chars AS size, source FROM documents)"


def _assets(spark, sf):
    """Documents as assets of their source's project; every third one is remote."""
    scheme = F.when(F.col("blob_id").cast("bigint") % 3 == 0, "https://").otherwise("file://")
    return t.blobs(spark, sf).select(F.col("source").alias("project_id"), F.concat(F.lit("a"), "blob_id").alias("asset_id"), F.concat(scheme, F.col("blob_id")).alias("uri"), "hash", "blob_id")


@query("join.asset_blob", f"WITH {_BLOBS}, u AS (SELECT DISTINCT hash FROM blobs) SELECT u.hash, 'a' || blob_id AS asset_id FROM u LEFT JOIN blobs ON u.hash = blobs.hash")
def asset_blob(spark, sf):
    entries = t.blobs(spark, sf).select(F.concat(F.lit("assets/"), F.regexp_replace("hash", "^sha256:", "")).alias("archive_path")).distinct()
    done = src.bundle_import(entries, _assets(spark, sf))
    return done.select(F.concat(F.lit("sha256:"), "digest").alias("hash"), "asset_id")


@query("src.bundle_import", f"""WITH {_BLOBS}, e AS (SELECT DISTINCT 'assets/' || substr(hash, 8) AS archive_path FROM blobs UNION ALL SELECT 'assets/' || sha256(url) FROM pages UNION ALL SELECT '../' || page_id FROM pages)
  SELECT archive_path, coalesce('a' || blob_id, '00000000-0000-0000-0000-000000000000') AS asset_id FROM e LEFT JOIN blobs ON substr(hash, 8) = substr(archive_path, 8) WHERE archive_path NOT LIKE '%..%'""")
def bundle_import(spark, sf):
    pages = t.read(spark, sf, "pages")
    entries = t.blobs(spark, sf).select(F.concat(F.lit("assets/"), F.regexp_replace("hash", "^sha256:", "")).alias("archive_path")).distinct()
    entries = entries.unionByName(pages.select(F.concat(F.lit("assets/"), F.sha2("url", 256)).alias("archive_path"))).unionByName(pages.select(F.concat(F.lit("../"), F.col("page_id").cast("string")).alias("archive_path")))
    return src.bundle_import(entries, _assets(spark, sf)).select("archive_path", "asset_id")


@query("src.bundle_errors", "SELECT '../' || page_id AS archive_path, 'INVALID_PARAMETER' AS code, 'rejected suspicious bundle entry' AS reason FROM pages")
def bundle_errors(spark, sf):
    return src.bundle_errors(t.read(spark, sf, "pages").select(F.concat(F.lit("../"), F.col("page_id").cast("string")).alias("archive_path")))


@query("sink.bundle_export", f"WITH {_BLOBS} SELECT source AS project_id, hash AS content_hash, count(*) AS assets FROM blobs WHERE CAST(blob_id AS BIGINT) % 3 <> 0 GROUP BY 1, 2")
def bundle_export(spark, sf):
    return src.bundle_export(_assets(spark, sf), t.blobs(spark, sf))[0].select("project_id", "content_hash", "assets")


_EMBED = "em AS (SELECT source AS project_id, hash AS content_hash, count(*) AS assets, max(size) AS size FROM blobs WHERE CAST(blob_id AS BIGINT) % 3 <> 0 GROUP BY 1, 2)"


@query("sink.bundle_manifest", f"""WITH {_BLOBS}, {_EMBED} SELECT project_id, count(*) AS embedded, CAST(sum(assets) AS BIGINT) AS assets, CAST(sum(size) AS BIGINT) AS bytes,
  count(*) || ':' || sum(CAST(CAST('0x' || substr(content_hash, 8, 15) AS UBIGINT) AS HUGEINT)) AS hash_set FROM em GROUP BY 1""")
def bundle_manifest(spark, sf):
    return src.bundle_export(_assets(spark, sf), t.blobs(spark, sf))[1]


@query("sink.bundle_contents", f"WITH {_BLOBS}, {_EMBED} SELECT project_id, content_hash, 'assets/' || substr(content_hash, 8) AS archive_path, sha256 AS found FROM em JOIN (SELECT DISTINCT hash, substr(hash, 8) AS sha256 FROM blobs) ON hash = content_hash")
def bundle_contents(spark, sf):
    path = staging_path(spark, "bundle")
    src.write_bundle(_assets(spark, sf), t.blobs(spark, sf), path)
    entries, contents, _ = src.read_bundle(spark, path)
    return entries.join(contents, "content_hash").select("project_id", "content_hash", "archive_path", F.sha2("content", 256).alias("found"))


@query("join.skip_existing", "SELECT CAST(p_partkey AS VARCHAR) AS source, p_partkey || '.png' AS output_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def skip_existing(spark, sf):
    named = lambda c: F.concat(F.col(c).cast("string"), F.lit(".png")).alias("output_name")
    sources = t.read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("source"), named("p_partkey"))
    return chains.skip_existing(sources, t.read(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(named("l_partkey")))


@query("agg.batch_stats", "SELECT count(*) FILTER (o_orderstatus='F') AS processed, count(*) FILTER (o_orderstatus='O') AS skipped, count(*) FILTER (o_orderstatus NOT IN ('F','O')) AS failed FROM orders")
def batch_stats(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "O", "skipped").otherwise("failed")
    return src.batch_stats(t.read(spark, sf, "orders").select(status.alias("status")))


@query("rec.render_plan", f"""WITH {_BLOBS}, w AS (SELECT DISTINCT hash AS input_hash, 'r' || CAST(blob_id AS BIGINT) % 3 AS recipe_hash FROM blobs)
  SELECT * FROM w WHERE (input_hash, recipe_hash) NOT IN (SELECT hash, 'r' || CAST(blob_id AS BIGINT) % 3 FROM blobs JOIN labels ON labels.doc_id = CAST(blob_id AS BIGINT))""")
def render_plan(spark, sf):
    rid = (F.col("blob_id").cast("bigint") % 3).alias("recipe_id")
    inputs = t.blobs(spark, sf).select("blob_id", F.col("hash").alias("input_hash"), rid)
    known = inputs.select("recipe_id").distinct().select("recipe_id", F.concat(F.lit("r"), F.col("recipe_id").cast("string")).alias("recipe_hash"))
    done = inputs.join(t.read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("blob_id")), "blob_id", "left_semi")
    return chains.render_plan(inputs, known, done.join(known, "recipe_id").select("input_hash", "recipe_hash"))


# Provenance


@query("prov.content_hash", "SELECT doc_id, 'sha256:' || sha256(text) AS hash FROM documents")
def content_hash(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", provenance.content_hash(F.col("text")).alias("hash"))


@query("prov.canonical_json", "SELECT o_orderkey, '{\"custkey\":' || o_custkey || ',\"key\":' || o_orderkey || ',\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}' AS canonical FROM orders")
def canonical(spark, sf):
    o = t.read(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("custkey"))
    return o.select("o_orderkey", provenance.canonical_json("status", "priority", "key", "custkey").alias("canonical"))


@query("prov.chain_append", f"WITH RECURSIVE {AUDIT} SELECT case_id, seq, prev_link, link FROM audit")
def chain_append(spark, sf):
    return t.case_ev(spark, sf).select("case_id", "seq", "prev_link", "link")


_VERIFY = "count(*) AS entries, count(fault) = 0 AS ok, coalesce(min(seq) FILTER (fault IS NOT NULL), -1) AS first_bad_seq, coalesce(arg_min(fault, seq), '') AS reason"


@query("prov.chain_verify", f"WITH RECURSIVE {AUDIT_BAD}, {checked('bad')} SELECT case_id, {_VERIFY} FROM checked GROUP BY case_id")
def chain_verify(spark, sf):
    return provenance.chain_verify(t.case_ev_bad(spark, sf), key=t.AUDIT_KEY)


@query("prov.tamper_propagation", f"WITH RECURSIVE {AUDIT_BAD}, {checked('bad')} SELECT case_id, seq, coalesce(fault, '') AS fault, max(CASE WHEN fault IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY seq) = 0 AS trusted FROM checked")
def tamper(spark, sf):
    return provenance.tamper_propagation(t.case_ev_bad(spark, sf), key=t.AUDIT_KEY).select("case_id", "seq", F.coalesce("fault", F.lit("")).alias("fault"), "trusted")


@query("join.artifact_hash", f"WITH {ENTRIES}, {ARTIFACTS} SELECT e.case_id, seq, input_hash AS hash, coalesce(path, '') AS path, path IS NOT NULL AS ok FROM entries e LEFT JOIN artifacts a ON a.case_id = e.case_id AND a.hash = e.input_hash WHERE input_hash IS NOT NULL AND input_hash NOT LIKE '%0000000000000000%'")
def artifact_hash(spark, sf):
    done = provenance.artifact_hash(t.case_entries(spark, sf), t.artifacts(spark, sf))
    return done.select("case_id", "seq", "hash", F.coalesce("path", F.lit("")).alias("path"), "ok")


_FILES = "files AS (SELECT e.case_id, count(*) AS artifact_count, count(*) FILTER (path IS NULL) AS missing FROM entries e LEFT JOIN artifacts a ON a.case_id = e.case_id AND a.hash = e.input_hash WHERE input_hash IS NOT NULL GROUP BY e.case_id)"


@query("prov.strict_audit", f"""WITH RECURSIVE {AUDIT}, {checked('audit')}, {ARTIFACTS}, {_FILES}, v AS (SELECT case_id, {_VERIFY} FROM checked GROUP BY case_id)
  SELECT v.*, coalesce(artifact_count,0) AS artifact_count, coalesce(missing,0) AS missing, coalesce(missing,0) = 0 AS all_match FROM v LEFT JOIN files USING (case_id)""")
def strict_audit(spark, sf):
    return provenance.strict_audit(t.case_ev(spark, sf), t.artifacts(spark, sf), key=t.AUDIT_KEY)


@query("join.independent_reviewer", f"WITH {ENTRIES}, {CASES} SELECT e.case_id, seq, operator_key, creator_key FROM entries e JOIN cases USING (case_id) WHERE action = 'sign-off' AND operator_key <> creator_key")
def independent(spark, sf):
    return provenance.independent_reviewer(t.case_entries(spark, sf), t.cases(spark, sf)).select("case_id", "seq", "operator_key", "creator_key")


_SIGN = """sg AS (SELECT case_id, count(*) FILTER (action='sign-off') AS signoffs, count(*) FILTER (action='sign-off' AND lower(note) LIKE '%decision: approve%') AS approvals, count(*) FILTER (action='sign-off' AND lower(note) LIKE '%decision: reject%') AS rejections,
  array_to_string(list_sort(list_distinct(list(operator_key) FILTER (action='sign-off' AND lower(note) LIKE '%decision: approve%' AND operator_key <> creator_key))), ',') AS rv FROM entries JOIN cases USING (case_id) GROUP BY case_id),
  sign AS (SELECT * EXCLUDE (rv), coalesce(rv, '') AS reviewers, coalesce(rv, '') <> '' AS independent FROM sg)"""


@query("agg.signoff_status", f"WITH {ENTRIES}, {CASES}, {_SIGN} SELECT * FROM sign")
def signoff(spark, sf):
    return provenance.signoff_status(t.case_entries(spark, sf), t.cases(spark, sf)).withColumn("reviewers", F.array_join("reviewers", ","))


_FIPS = """fips AS (SELECT case_id, count(*) FILTER (input_hash IS NOT NULL) AS artifact_entries, count(*) FILTER (input_hash IS NOT NULL AND input_sha256 IS NOT NULL) AS covered_entries, count(*) FILTER (input_hash IS NOT NULL) > 0 AND count(*) FILTER (input_hash IS NOT NULL AND input_sha256 IS NULL) = 0 AS fips_ok FROM entries GROUP BY case_id)"""


@query("agg.fips_summary", f"WITH {ENTRIES}, {_FIPS} SELECT * FROM fips")
def fips(spark, sf):
    return provenance.fips_summary(t.case_entries(spark, sf))


@query("prov.audit_gate", f"""WITH RECURSIVE {AUDIT_BAD}, {checked('bad')}, {ARTIFACTS}, {_FILES}, {CASES}, {_SIGN.replace("FROM entries", "FROM bad")}, {_FIPS.replace("FROM entries", "FROM bad")}, v AS (SELECT case_id, {_VERIFY} FROM checked GROUP BY case_id),
  g AS (SELECT case_id, CASE WHEN NOT ok THEN 'audit log broken' WHEN coalesce(missing,0) > 0 THEN 'artifact missing' WHEN NOT fips_ok THEN 'sha-256 missing' WHEN NOT independent THEN 'no independent approval' ELSE 'ok' END AS reason FROM v LEFT JOIN files USING (case_id) JOIN sign USING (case_id) JOIN fips USING (case_id))
  SELECT case_id, reason, reason = 'ok' AS passed FROM g""")
def audit_gate(spark, sf):
    log = cut_lineage(t.case_ev_bad(spark, sf))
    return provenance.audit_gate(log, t.cases(spark, sf), t.artifacts(spark, sf), require_fips=True, require_signoff=True, key=t.AUDIT_KEY)


@query("agg.case_rollup", f"""WITH {ENTRIES} SELECT coalesce(case_id,'*') AS case_id, coalesce(action,'*') AS action, CAST(grouping(case_id, action) AS INTEGER) AS level, count(*) AS entries, min("at") AS first_at, max("at") AS last_at FROM entries GROUP BY GROUPING SETS ((case_id, action), (case_id), ())""")
def rollup(spark, sf):
    return provenance.case_rollup(t.case_entries(spark, sf)).select(F.coalesce("case_id", F.lit("*")).alias("case_id"), F.coalesce("action", F.lit("*")).alias("action"), "level", "entries", "first_at", "last_at")


_CASE_FILES = """cf AS (SELECT CAST(user_id AS VARCHAR) AS case_id, CASE event_type WHEN 'view' THEN 'inputs/' WHEN 'click' THEN 'outputs/' WHEN 'purchase' THEN 'stages/run' || event_id % 3 || '/' WHEN 'signup' THEN 'recipes/' ELSE 'notes/' END || event_id AS path FROM events)"""


@query("agg.case_artifacts", f"""WITH {_CASE_FILES}, k AS (SELECT case_id, CASE split_part(path, '/', 1) WHEN 'inputs' THEN 'input' WHEN 'outputs' THEN 'output' WHEN 'stages' THEN 'stage' WHEN 'recipes' THEN 'recipe' ELSE 'other' END AS kind,
    CASE WHEN path LIKE 'stages/%' THEN split_part(path, '/', 2) END AS stage FROM cf)
  SELECT coalesce(case_id, '*') AS case_id, coalesce(kind, '*') AS kind, CAST(grouping(case_id, kind) AS INTEGER) AS level, count(*) AS artifacts, count(DISTINCT stage) AS stage_runs FROM k GROUP BY GROUPING SETS ((case_id, kind), (case_id), ())""")
def case_artifacts(spark, sf):
    folder = F.coalesce(
        *[F.when(F.col("event_type") == k, v) for k, v in (("view", F.lit("inputs/")), ("click", F.lit("outputs/")), ("signup", F.lit("recipes/")))],
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("stages/run"), F.col("event_id") % 3, F.lit("/"))), F.lit("notes/"))
    files = t.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("case_id"), F.concat(folder, "event_id").alias("path"))
    stars = [F.coalesce(c, F.lit("*")).alias(c) for c in ("case_id", "kind")]
    return provenance.artifact_rollup(files).select(*stars, "level", "artifacts", "stage_runs")


@query("prov.manifest_times", """SELECT o_orderkey, 'd' || o_orderkey % 190 AS output_path, 'sha256:' || sha256(text) AS output_hash, strftime(CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400), '%Y-%m-%dT%H:%M:%S.%fZ') AS render_time
  FROM orders LEFT JOIN documents ON doc_id = o_orderkey % 190""")
def manifest_times(spark, sf):
    at = F.concat(F.lit("d"), (F.col("o_orderkey") % 190).cast("string"))
    renders = t.read(spark, sf, "orders").select(
        "o_orderkey", *[at.alias(f"{k}_path") for k in ("input", "output", "recipe")],
        F.expr("cast(o_orderdate as timestamp) + make_interval(0, 0, 0, 0, 0, 0, o_orderkey % 86400)").alias("rendered_at"))
    hashes = t.read(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), provenance.content_hash(F.col("text")).alias("hash"))
    return provenance.manifest(renders, hashes).select("o_orderkey", "output_path", "output_hash", "render_time")


@query("prov.manifest", """WITH h AS (SELECT 'd' || doc_id AS path, 'sha256:' || sha256(text) AS hash FROM documents) SELECT p_partkey, i.hash AS input_hash, o.hash AS output_hash, coalesce(r.hash, '') AS recipe_hash
  FROM part LEFT JOIN h i ON i.path = 'd' || (p_partkey % 200) LEFT JOIN h o ON o.path = 'd' || (p_partkey % 190) LEFT JOIN h r ON r.path = 'd' || (p_size + 1000000)""")
def manifest(spark, sf):
    at = lambda e, k: F.concat(F.lit("d"), e.cast("string")).alias(f"{k}_path")
    renders = t.read(spark, sf, "part").select("p_partkey", at(F.col("p_partkey") % 200, "input"), at(F.col("p_partkey") % 190, "output"), at(F.col("p_size") + 1000000, "recipe"))
    hashes = t.read(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), provenance.content_hash(F.col("text")).alias("hash"))
    return provenance.manifest(renders, hashes).select("p_partkey", "input_hash", "output_hash", F.coalesce("recipe_hash", F.lit("")).alias("recipe_hash"))


def _digest(side: str) -> str:
    return f"""{side}_d AS (SELECT project_id, sha256('{{"effect_id":"' || effect_id || '","inputs":["' || src || '"],"label":"' || label || '","node_id":"' || node_id || '","params":{{"status":"' || status || '","totalprice":"' || totalprice || '"}}}}') AS d FROM {side}),
  {side}_6 AS (SELECT project_id, substr(d,1,6) AS p, sha256(string_agg(d, '' ORDER BY d)) AS h FROM {side}_d GROUP BY ALL), {side}_3 AS (SELECT project_id, substr(p,1,3) AS q, sha256(string_agg(h, '' ORDER BY p)) AS h FROM {side}_6 GROUP BY project_id, substr(p,1,3)),
  {side}_p AS (SELECT project_id, 'sha256:' || sha256(string_agg(h, '' ORDER BY q)) AS project_hash FROM {side}_3 GROUP BY project_id)"""


@query("prov.share_token", f"WITH {NODES}, {_digest('base')}, {_digest('theirs')} SELECT b.project_id, b.project_hash, t.project_hash IS NOT DISTINCT FROM b.project_hash AS valid FROM base_p b LEFT JOIN theirs_p t USING (project_id)")
def share_token(spark, sf):
    links = provenance.project_digest(t.project_nodes(spark, sf, "base"))
    return provenance.share_token(links, t.project_nodes(spark, sf, "theirs")).select("project_id", "project_hash", "valid")


@query("prov.dedup_content", f"WITH {_BLOBS} SELECT hash, min(blob_id) AS blob_id, max(size) AS size, count(*) AS copies FROM blobs GROUP BY hash")
def dedup(spark, sf):
    return provenance.dedup_content(t.blobs(spark, sf))


def _new_entries(action: str, note: str, extra: str, keep: str) -> str:
    return f"""tl AS (SELECT case_id, arg_max(link, seq) AS lk, max(seq) + 1 AS next_seq FROM bad GROUP BY case_id), intact AS (SELECT case_id FROM checked GROUP BY case_id HAVING count(fault) = 0),
  drafts AS (SELECT CAST(user_id AS VARCHAR) AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "at", 'op' || (event_id % 5) AS operator_key,
    '{action}' AS action, {note} AS note, {extra} FROM events WHERE {keep} AND CAST(user_id AS VARCHAR) IN (SELECT case_id FROM intact)),
  nx AS (SELECT d.* REPLACE (d.seq + next_seq AS seq), d.seq AS k, lk FROM drafts d JOIN tl USING (case_id))"""


_NULLS = "CAST(NULL AS VARCHAR) AS output_hash, CAST(NULL AS VARCHAR) AS recipe_hash, CAST(NULL AS VARCHAR) AS input_sha256, CAST(NULL AS VARCHAR) AS output_sha256, CAST(NULL AS VARCHAR) AS recipe_sha256"


def _appended(sql: str) -> str:
    """Recursive linking of ``nx`` after each case's last link."""
    step = linked("nx", "fresh", "lk").replace("WHERE seq = 0", "WHERE k = 0")
    return f"WITH RECURSIVE {AUDIT_BAD}, {checked('bad')}, {sql}, {step} SELECT case_id, seq, action, note, prev_link, link FROM fresh"


def _drafts(spark, sf, keep):
    from framelake.functions.ordering import positions

    ev = t.read(spark, sf, "events").where(keep)
    placed = positions(ev, ["user_id"], ["ts", "event_id"], F.date_trunc("hour", "ts"), "draft_no")
    return placed.select(
        F.col("user_id").cast("string").alias("case_id"), "draft_no", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"),
        F.concat(F.lit("op"), (F.col("event_id") % 5).cast("string")).alias("operator_key"), "event_id", "value")


@query("prov.record_run", _appended(_new_entries("render", "''", f"'sha256:' || sha256('i' || event_id) AS input_hash, {_NULLS}", "event_type = 'view'")))
def record_run(spark, sf):
    runs = _drafts(spark, sf, "event_type = 'view'").withColumn("input_hash", provenance.content_hash(F.concat(F.lit("i"), F.col("event_id").cast("string"))))
    return provenance.record_run(cut_lineage(t.case_ev_bad(spark, sf)), runs.drop("event_id", "value"), key=t.AUDIT_KEY).select("case_id", "seq", "action", "note", "prev_link", "link")


_SHIFT_NOTE = """CASE WHEN event_id % 2 = 0 THEN 'night | ' ELSE '' END || 'super-resolve of 3 frames at scale ' || (event_id % 3 + 2) || ' by median; shifts: [{"frame_no":0,"dx":0.0,"dy":0.0,"peak":1.0},{"frame_no":1,"dx":0.5,"dy":' || (event_id % 7 + 0.25) || ',"peak":0.5},{"frame_no":2,"dx":1.0,"dy":' || (event_id % 7 + 1.25) || ',"peak":0.5}]'"""


def _shift_runs(spark, sf):
    """Every event as a run over three frames with measured shifts."""
    runs = _drafts(spark, sf, "true").select(
        "*", F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("asset_id"), (F.col("event_id") % 3 + 2).alias("scale"), F.lit("median").alias("fuse"),
        F.when(F.col("event_id") % 2 == 0, "night").otherwise("").alias("remark"), provenance.content_hash(F.concat(F.lit("i"), F.col("event_id").cast("string"))).alias("input_hash"))
    k = F.col("frame_no")
    shifts = t.read(spark, sf, "events").select("event_id", F.explode(F.array(*[F.lit(n) for n in range(3)])).alias("frame_no")).select(
        F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("asset_id"), "frame_no", (k / 2.0).alias("dx"),
        F.when(k == 0, 0.0).otherwise(F.col("event_id") % 7 + k - 0.75).alias("dy"), F.when(k == 0, 1.0).otherwise(0.5).alias("peak"))
    return runs.drop("event_id", "value"), shifts


@query("prov.record_super_resolve", _appended(_new_entries("super-resolve", _SHIFT_NOTE, f"'sha256:' || sha256('i' || event_id) AS input_hash, {_NULLS}", "true")))
def record_super_resolve(spark, sf):
    runs, shifts = _shift_runs(spark, sf)
    return provenance.record_super_resolve(cut_lineage(t.case_ev_bad(spark, sf)), runs, shifts, key=t.AUDIT_KEY).select("case_id", "seq", "action", "note", "prev_link", "link")


@query("prov.super_resolve_errors", "SELECT CAST(user_id AS VARCHAR) AS case_id, 'INVALID_PARAMETER' AS code, 'no measured shifts for a' || event_id AS reason FROM events WHERE event_id % 5 = 0")
def super_resolve_errors(spark, sf):
    runs, shifts = _shift_runs(spark, sf)
    return provenance.super_resolve_errors(runs, shifts.where(F.substring("asset_id", 2, 20).cast("bigint") % 5 != 0))


@query("prov.record_decision", _appended(_new_entries("sign-off", "'decision: ' || CASE WHEN value > 50 THEN 'approve' ELSE 'reject' END || CASE WHEN event_id % 2 = 0 THEN ' — checked' ELSE '' END", f"CAST(NULL AS VARCHAR) AS input_hash, {_NULLS}", "event_type = 'purchase'")))
def record_decision(spark, sf):
    d = _drafts(spark, sf, "event_type = 'purchase'").withColumns({"decision": F.when(F.col("value") > 50, "Approve").otherwise("REJECT"), "remark": F.when(F.col("event_id") % 2 == 0, "checked").otherwise("")})
    drafts = provenance.decision_drafts(d, t.cases(spark, sf)).drop("event_id", "value", "decision", "remark", "creator_key", "self_signoff")
    return provenance.append_to(cut_lineage(t.case_ev_bad(spark, sf)), drafts, key=t.AUDIT_KEY).select("case_id", "seq", "action", "note", "prev_link", "link")


@query("prov.decision_errors", """SELECT CAST(user_id AS VARCHAR) AS case_id, 'INVALID_PARAMETER' AS code, 'decision must be ''approve'' or ''reject'', got ''' || event_type || '''' AS reason FROM events""")
def decision_errors(spark, sf):
    return provenance.decision_errors(t.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("case_id"), F.col("event_type").alias("decision")))


@query("prov.self_signoff", f"WITH {CASES} SELECT event_id, 'op' || (event_id % 5) = creator_key AS self_signoff FROM events JOIN cases ON case_id = CAST(user_id AS VARCHAR) WHERE event_type = 'purchase'")
def self_signoff(spark, sf):
    d = _drafts(spark, sf, "event_type = 'purchase'").withColumns({"decision": F.lit("approve"), "remark": F.lit("")})
    return provenance.decision_drafts(d, t.cases(spark, sf)).select("event_id", "self_signoff")


@query("prov.open_case", f"""WITH RECURSIVE {CASES}, entries AS (SELECT CAST(c_custkey AS VARCHAR) AS case_id, CAST(0 AS BIGINT) AS seq, '2024-02-01T00:00:00.000000' AS "at", 'op' || (c_custkey % 7) AS operator_key, 'case-init' AS action, '' AS note, CAST(NULL AS VARCHAR) AS input_hash, {_NULLS}
  FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT case_id FROM cases)), {linked()} SELECT case_id, operator_key, prev_link, link FROM audit""")
def open_case(spark, sf):
    new = t.read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("case_id"), F.lit("2024-02-01T00:00:00.000000").alias("at"), F.concat(F.lit("op"), (F.col("c_custkey") % 7).cast("string")).alias("creator_key"))
    return provenance.open_case(t.cases(spark, sf), new, key=t.AUDIT_KEY).select("case_id", "operator_key", "prev_link", "link")


@query("prov.open_case_errors", f"WITH {CASES} SELECT CAST(c_custkey AS VARCHAR) AS case_id, 'INVALID_PARAMETER' AS code, 'case already open' AS reason FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (SELECT case_id FROM cases)")
def open_case_errors(spark, sf):
    return provenance.open_case_errors(t.cases(spark, sf), t.read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("case_id")))


# Diff and merge


def _sides(spark, sf, what):
    return [what(spark, sf, side) for side in ("base", "theirs")]


_LONG = NODES + ", " + ", ".join(f"{s}_l AS (SELECT project_id, node_id, 'status' AS key, status AS value FROM {s} UNION ALL SELECT project_id, node_id, 'totalprice', totalprice FROM {s})" for s in ("base", "theirs"))
_FULL = """fd AS (SELECT coalesce(a.project_id,b.project_id) AS project_id, coalesce(a.node_id,b.node_id) AS node_id, coalesce(a.key,b.key) AS key, a.value AS before, b.value AS after,
  CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' WHEN a.value = b.value THEN 'same' ELSE 'changed' END AS change FROM base_l a FULL OUTER JOIN theirs_l b ON a.project_id=b.project_id AND a.node_id=b.node_id AND a.key=b.key)"""
_BLANK = "project_id, node_id, key, coalesce(before,'') AS before, coalesce(after,'') AS after, change"


def _filled(df):
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in ("before", "after")})


@query("join.full_diff", f"WITH {_LONG}, {_FULL} SELECT {_BLANK} FROM fd")
def full_diff(spark, sf):
    a, b = (diffmerge.params_long(n) for n in _sides(spark, sf, t.project_nodes))
    return _filled(diffmerge.full_diff(a, b, [*diffmerge.NODE, "key"], "value"))


@query("diff.params", f"WITH {_LONG}, {_FULL} SELECT {_BLANK} FROM fd WHERE change <> 'same'")
def diff_params(spark, sf):
    a, b = (diffmerge.params_long(n) for n in _sides(spark, sf, t.project_nodes))
    return _filled(diffmerge.diff_params(a, b))


@query("diff.apply_params", f"WITH {_LONG} SELECT * FROM theirs_l")
def apply_params(spark, sf):
    a, b = (diffmerge.params_long(n) for n in _sides(spark, sf, t.project_nodes))
    return diffmerge.apply_params(a, diffmerge.diff_params(a, b))


_GRAPH_DIFF = """gd AS (SELECT project_id, 'node_removed' AS change, node_id AS item FROM base WHERE node_id NOT IN (SELECT node_id FROM theirs)
  UNION ALL SELECT project_id, 'node_added', node_id FROM theirs WHERE node_id NOT IN (SELECT node_id FROM base)
  UNION ALL SELECT b.project_id, 'node_changed', b.node_id FROM base b JOIN theirs t USING (node_id) WHERE b.totalprice <> t.totalprice OR b.status <> t.status
  UNION ALL (SELECT project_id, 'edge_removed', src || '->' || node_id FROM base EXCEPT SELECT project_id, 'edge_removed', src || '->' || node_id FROM theirs)
  UNION ALL (SELECT project_id, 'edge_added', src || '->' || node_id FROM theirs EXCEPT SELECT project_id, 'edge_added', src || '->' || node_id FROM base))"""


@query("diff.graphs", f"WITH {NODES}, {_GRAPH_DIFF} SELECT * FROM gd")
def diff_graphs(spark, sf):
    return diffmerge.diff_graphs(*_sides(spark, sf, t.project_nodes))


def _closed(spark, sf):
    """Both versions with inputs that stay inside the project, so that their diff applies."""
    return [n.withColumn("inputs", F.array(F.when(F.col("node_id").cast("bigint") % 2 == 0, F.col("node_id")).otherwise(F.col("node_id")))) for n in _sides(spark, sf, t.project_nodes)]


@query("diff.apply_graph", f"WITH {NODES} SELECT project_id, node_id, effect_id, label, node_id AS inputs, status || '/' || totalprice AS params FROM theirs")
def apply_graph(spark, sf):
    a, b = _closed(spark, sf)
    done = diffmerge.apply_graph(a, b, diffmerge.diff_graphs(a, b))
    return done.select("project_id", "node_id", "effect_id", "label", F.array_join("inputs", ",").alias("inputs"), F.concat(F.try_element_at("params", F.lit("status")), F.lit("/"), F.try_element_at("params", F.lit("totalprice"))).alias("params"))


def _sinks(nodes):
    """The latest order of every customer."""
    return nodes.groupBy("project_id").agg(F.max(F.col("node_id").cast("bigint")).cast("string").alias("node_id"))


@query("diff.apply_sinks", f"""WITH {NODES}, s AS (SELECT project_id, CAST(max(CAST(node_id AS BIGINT)) AS VARCHAR) AS node_id FROM base GROUP BY project_id)
  SELECT project_id, node_id FROM s WHERE EXISTS (SELECT 1 FROM base b JOIN theirs t ON b.project_id = t.project_id AND b.node_id = t.node_id AND b.effect_id = t.effect_id AND b.label = t.label WHERE b.project_id = s.project_id AND b.node_id = s.node_id)""")
def apply_sinks(spark, sf):
    a, b = _closed(spark, sf)
    return diffmerge.apply_sinks(_sinks(a), a, diffmerge.diff_graphs(a, b)).select("project_id", "node_id")


@query("diff.graph_errors", f"""WITH {NODES}, {_GRAPH_DIFF}, e AS (SELECT project_id, unnest(string_split(item, '->')) AS item FROM gd WHERE change LIKE 'edge_%')
  SELECT DISTINCT project_id, 'GRAPH' AS code, 'edge references missing node ' || item AS reason FROM e WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.project_id = e.project_id AND b.node_id = e.item) AND NOT EXISTS (SELECT 1 FROM theirs t WHERE t.project_id = e.project_id AND t.node_id = e.item AND t.node_id NOT IN (SELECT node_id FROM base))""")
def graph_errors(spark, sf):
    a, b = _sides(spark, sf, t.project_nodes)
    return diffmerge.graph_diff_errors(a, diffmerge.diff_graphs(a, b))


_ITEM_DIFF = "(SELECT project_id, kind || '_removed' AS change, item_id AS item FROM items_base EXCEPT SELECT project_id, kind || '_removed', item_id FROM items_theirs) UNION ALL (SELECT project_id, kind || '_added', item_id FROM items_theirs EXCEPT SELECT project_id, kind || '_added', item_id FROM items_base)"
_MODEL_DIFF = "SELECT coalesce(a.project_id,b.project_id) AS project_id, CASE WHEN a.model IS NULL THEN 'model_added' WHEN b.model IS NULL THEN 'model_removed' ELSE 'model_changed' END AS change, coalesce(a.model,b.model) AS item FROM models_base a FULL OUTER JOIN models_theirs b ON a.project_id=b.project_id AND a.model=b.model WHERE a.hash IS DISTINCT FROM b.hash"


@query("diff.projects", f"WITH {NODES}, {_GRAPH_DIFF}, {ITEMS}, {MODELS} SELECT * FROM gd UNION ALL {_ITEM_DIFF} UNION ALL {_MODEL_DIFF}")
def diff_projects(spark, sf):
    nodes, items, models = (_sides(spark, sf, w) for w in (t.project_nodes, t.project_items, t.project_models))
    return diffmerge.diff_projects(*nodes, *items, *models)


@query("merge.projects", f"""WITH {NODES} SELECT project_id, node_id, effect_id, label, src AS inputs, status || '/' || totalprice AS params FROM theirs
  UNION ALL SELECT project_id, node_id, effect_id, label, src, status || '/' || totalprice FROM base WHERE node_id NOT IN (SELECT node_id FROM theirs)""")
def merge_projects(spark, sf):
    m = diffmerge.merge_nodes(*_sides(spark, sf, t.project_nodes))
    return m.select("project_id", "node_id", "effect_id", "label", F.array_join("inputs", ",").alias("inputs"), F.concat(F.try_element_at("params", F.lit("status")), F.lit("/"), F.try_element_at("params", F.lit("totalprice"))).alias("params"))


@query("merge.conflicts", f"""WITH {_LONG}, {MODELS} SELECT a.project_id, a.node_id, a.key AS param_key FROM base_l a JOIN theirs_l b USING (project_id, node_id, key) WHERE a.value <> b.value
  UNION ALL SELECT a.project_id, '00000000-0000-0000-0000-000000000000', a.model FROM models_base a JOIN models_theirs b USING (project_id, model) WHERE a.hash <> b.hash""")
def merge_conflicts(spark, sf):
    return diffmerge.merge_conflicts(*_sides(spark, sf, t.project_nodes), *_sides(spark, sf, t.project_models))


@query("merge.sinks", f"""WITH {NODES} SELECT project_id, CAST(max(CAST(node_id AS BIGINT)) AS VARCHAR) AS node_id FROM base GROUP BY project_id
  UNION SELECT project_id, CAST(max(CAST(node_id AS BIGINT)) AS VARCHAR) FROM theirs GROUP BY project_id""")
def merge_sinks(spark, sf):
    return diffmerge.merge_sinks(*(_sinks(n) for n in _sides(spark, sf, t.project_nodes)))


@query("merge.items", f"WITH {ITEMS} SELECT * FROM items_base UNION ALL SELECT * FROM items_theirs WHERE item_id NOT IN (SELECT item_id FROM items_base)")
def merge_items(spark, sf):
    return diffmerge.merge_items(*_sides(spark, sf, t.project_items))


@query("merge.models", f"WITH {MODELS} SELECT * FROM models_theirs UNION ALL SELECT * FROM models_base WHERE model NOT IN (SELECT model FROM models_theirs)")
def merge_models(spark, sf):
    return diffmerge.merge_models(*_sides(spark, sf, t.project_models))


@query("set.union_distinct_edges", f"WITH {NODES} SELECT project_id, src, node_id AS dst FROM base UNION SELECT project_id, src, node_id FROM theirs")
def union_edges(spark, sf):
    return diffmerge.union_distinct(*(diffmerge.edges_of(n) for n in _sides(spark, sf, t.project_nodes)))


@query("set.intersect_nodes", f"WITH {NODES} SELECT project_id, node_id FROM base INTERSECT SELECT project_id, node_id FROM theirs")
def intersect_nodes(spark, sf):
    return diffmerge.intersect_nodes(*_sides(spark, sf, t.project_nodes))


@query("set.except_assets", f"WITH {ITEMS} SELECT project_id, kind, item_id FROM items_base EXCEPT ALL SELECT project_id, kind, item_id FROM items_theirs")
def except_assets(spark, sf):
    return diffmerge.except_items(*_sides(spark, sf, t.project_items))


@query("preset.store", f"WITH {ITEMS}, u AS (SELECT project_id, kind, item_id, name || '!' AS name FROM items_theirs) SELECT * FROM (SELECT * FROM u UNION ALL SELECT * FROM items_base WHERE item_id NOT IN (SELECT item_id FROM u)) WHERE CAST(item_id AS BIGINT) % 10 <> 7")
def preset_store(spark, sf):
    base, theirs = _sides(spark, sf, t.project_items)
    stored = diffmerge.upsert(base, theirs.withColumn("name", F.concat("name", F.lit("!"))), ["item_id"])
    gone = base.unionByName(theirs).where(F.col("item_id").cast("bigint") % 10 == 7).select("item_id").distinct()
    return diffmerge.remove(stored, gone, ["item_id"])


@query("history.append", "SELECT CAST(c_custkey AS VARCHAR) AS project_id, strftime(greatest(TIMESTAMP '1996-01-01', coalesce(max(o_orderdate), TIMESTAMP '1996-01-01')), '%Y-%m-%d') AS modified FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def history(spark, sf):
    projects = t.read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("project_id"), F.lit("1996-01-01").alias("modified"))
    entries = t.read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("project_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), F.col("o_orderstatus").alias("summary"))
    return diffmerge.history_append(projects, entries.limit(0), entries)[1]


# Graphs

_CONV = "nd AS (SELECT CAST(conv_id AS VARCHAR) AS project_id, conv_id || ':' || turn AS node_id FROM conversations{where}), ed AS (SELECT CAST(conv_id AS VARCHAR) AS project_id, conv_id || ':' || (turn-1) AS src, conv_id || ':' || turn AS dst FROM conversations WHERE turn >= 1)"


@query("join.graph_edges", f"WITH {_CONV.format(where=' WHERE NOT (conv_id % 3 = 0 AND turn = 2)')} SELECT project_id, src AS item, dst AS used_by, 'input' AS role FROM ed WHERE src NOT IN (SELECT node_id FROM nd)")
def graph_edges(spark, sf):
    return graphs.missing_endpoints(*t.dag_conv(spark, sf, "dangling"))


@query("graph.validate", f"""WITH {_CONV.format(where=' WHERE NOT (conv_id % 3 = 0 AND turn = 2)')} SELECT project_id, 'GRAPH' AS code, 'input references missing node ' || src AS reason FROM ed WHERE src NOT IN (SELECT node_id FROM nd)""")
def validate_graph(spark, sf):
    return graphs.validate(*t.dag_conv(spark, sf, "dangling"))


@query("graph.validate_cycle", "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS project_id, 'GRAPH' AS code, 'cycle detected' AS reason FROM conversations WHERE conv_id % 5 = 0")
def validate_cycle(spark, sf):
    return graphs.validate(*t.dag_conv(spark, sf, "cycle"))


@query("graph.topo_levels", """WITH RECURSIVE lv AS (SELECT o_orderkey AS k, CAST(0 AS BIGINT) AS level FROM orders WHERE o_orderkey = 0 UNION ALL SELECT o_orderkey, level + 1 FROM lv JOIN orders ON o_orderkey >= 1 AND o_orderkey // 2 = k)
  SELECT 'orders' AS project_id, CAST(k AS VARCHAR) AS node_id, level FROM lv""")
def topo(spark, sf):
    return graphs.topo_levels(*t.dag_orders(spark, sf))


@query("graph.topo_levels_diamond", """WITH RECURSIVE e AS (SELECT o_orderkey // 2 AS src, o_orderkey AS dst FROM orders WHERE o_orderkey >= 1 UNION SELECT o_orderkey // 3, o_orderkey FROM orders WHERE o_orderkey >= 1),
  lv AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS level UNION SELECT dst, level + 1 FROM lv JOIN e ON src = k) SELECT 'orders' AS project_id, CAST(k AS VARCHAR) AS node_id, max(level) AS level FROM lv GROUP BY k""")
def topo_diamond(spark, sf):
    nodes, edges = t.dag_orders(spark, sf)
    third = edges.withColumn("src", F.expr("cast(cast(dst as bigint) div 3 as string)"))
    return graphs.topo_levels(nodes, edges.unionByName(third))


@query("graph.ancestors", """WITH RECURSIVE an AS (SELECT o_orderkey AS n, o_orderkey AS a FROM orders UNION ALL SELECT n, a // 2 FROM an WHERE a >= 1)
  SELECT 'orders' AS project_id, CAST(n AS VARCHAR) AS node_id, CAST(a AS VARCHAR) AS ancestor FROM an""")
def ancestors(spark, sf):
    return graphs.ancestors(*t.dag_orders(spark, sf))


@query("graph.upstream_of", """WITH RECURSIVE an AS (SELECT o_orderkey AS n, o_orderkey AS a FROM orders WHERE o_orderkey % 100 = 7 UNION ALL SELECT n, a // 2 FROM an WHERE a >= 1)
  SELECT 'orders' AS project_id, CAST(n AS VARCHAR) AS sink, CAST(a AS VARCHAR) AS ancestor FROM an""")
def upstream_of(spark, sf):
    nodes, edges = t.dag_orders(spark, sf)
    sinks = nodes.where(F.col("node_id").cast("bigint") % 100 == 7)
    return graphs.upstream_of(sinks, edges)


def _catalogue_rows():
    rows = []
    reg = Registry()
    for i in reg.ids():
        for p in reg.get(i).params:
            rows.append((i, p.key, p.kind))
    return rows


@query("udf.effect_catalog", f"""WITH c AS (SELECT * FROM {values(_catalogue_rows(), 'c(effect, key, kind)')}), e AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'color.saturation' WHEN 1 THEN 'text.clahe' ELSE 'nope' END AS effect FROM part)
  SELECT p_partkey, e.effect, coalesce(key, '') AS key, coalesce(kind, 'unknown effect') AS kind FROM e LEFT JOIN c USING (effect)""")
def catalogue(spark, sf):
    pick = F.col("p_partkey") % 3
    used = t.read(spark, sf, "part").select("p_partkey", F.when(pick == 0, "color.saturation").when(pick == 1, "text.clahe").otherwise("nope").alias("effect"))
    specs = F.broadcast(Registry().spec_rows(spark))  # the catalogue: under 200 rows
    return used.join(specs, "effect", "left").select("p_partkey", "effect", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("kind", F.lit("unknown effect")).alias("kind"))


