"""The registered queries of this folder: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import common

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its DuckDB SQL where there is one."""

    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.token_counts import count_tokens

    return count_tokens(common.table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.secret_scan import scan_secrets

    return scan_secrets(common.table(spark, sf_dir, "documents"))


@query("op5_sentence_pieces")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.sentence_pieces import encode_documents

    return encode_documents(common.table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op10_quality_network")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.quality_network import score, train

    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))


@query("op6_leak_match")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.leak_match import find_leaks

    return find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


@query("op9_chat_views", """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS spoken_by, coalesce(text, '') AS body FROM conversations WHERE conv_id IS NOT NULL
), speakers AS (
  SELECT DISTINCT conv_id, spoken_by AS speaker FROM turns WHERE spoken_by <> 'system'
), heads AS (
  SELECT t.conv_id, s.speaker, t.turn, t.spoken_by, t.body,
    CASE WHEN t.spoken_by = 'system' THEN 'system' WHEN t.spoken_by = s.speaker THEN 'assistant' ELSE 'user' END AS role,
    CASE WHEN t.spoken_by <> 'system' AND t.spoken_by <> s.speaker THEN t.spoken_by END AS name
  FROM turns t JOIN speakers s ON t.conv_id = s.conv_id
), written AS (
  SELECT *, '<|im_start|>' || role
    || CASE WHEN name IS NULL THEN '' ELSE ' name=' || replace(replace(name, chr(10), ' '), '<|', '<||') END || chr(10) AS head
  FROM heads
), segments AS (
  SELECT *, head || replace(body, '<|', '<||') || '<|im_end|>' || chr(10) AS segment FROM written
), placed AS (
  SELECT *, row_number() OVER w - 1 AS seq, sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
  FROM segments WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, spoken_by, body)
)
SELECT conv_id, speaker, seq, turn, role, name, segment, CAST(stop - length(segment) AS BIGINT) AS start_at, CAST(stop AS BIGINT) AS end_at,
  CASE WHEN role = 'assistant' THEN CAST(stop - length(segment) + length(head) AS BIGINT) END AS train_from,
  CASE WHEN role = 'assistant' THEN CAST(stop AS BIGINT) END AS train_to
FROM placed
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.chat_views import render_views

    return render_views(common.table(spark, sf_dir, "conversations"))


@query("op8_pack_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.pack_shards import pack

    return pack(common.table(spark, sf_dir, "documents"))


@query("op4_threshold_search", """
WITH rows_in AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.ints, c.ints), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM rows_in q JOIN rows_in c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from framelake.llm.threshold_search import search

    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op2_near_copies")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.near_copies import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "documents"))


@query("op3_repeated_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.repeated_text import remove_repeats

    return remove_repeats(common.table(spark, sf_dir, "documents"))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.whitening import whiten

    return whiten(common.table(spark, sf_dir, "embeddings"))


def vector_codes_sql(rounds: int = 4) -> str:
    """Four rounds of assignment and flooring means, then the codes, as plain joins of parts and entries."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
, near{k} AS (
  SELECT p.rid, p.part, min(list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 256 + b.entry) AS best
  FROM parts p JOIN book{k} b ON p.part = b.part GROUP BY p.rid, p.part
)""")
        if k < rounds:
            steps.append(f"""
, flat{k} AS (
  SELECT p.part, n.best % 256 AS entry, unnest(range(len(p.v))) AS pos, unnest(p.v) AS x FROM parts p JOIN near{k} n ON p.rid = n.rid AND p.part = n.part
), sums{k} AS (
  SELECT part, entry, pos, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM flat{k} GROUP BY part, entry, pos
), means{k} AS (
  SELECT part, entry, list(x ORDER BY pos) AS v FROM sums{k} GROUP BY part, entry
), book{k + 1} AS (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m ON b.part = m.part AND b.entry = m.entry
)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label,
    list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), parts AS (
  SELECT rid, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS v FROM (SELECT rid, v, unnest(range(4)) AS part FROM kept)
), book0 AS (
  SELECT part, rid - 1 AS entry, v FROM parts WHERE rid <= 256
){''.join(steps)}
, coded AS (
  SELECT rid, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM near{rounds} GROUP BY rid
), books AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS sha
  FROM (SELECT part, entry, unnest(range(len(v))) AS pos, unnest(v) AS x FROM book{rounds})
)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, books.sha AS codebooks_sha256, k.label
FROM kept k JOIN coded c ON k.rid = c.rid, books
"""


@query("op12_vector_codes", vector_codes_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.vector_codes import encode

    return encode(common.table(spark, sf_dir, "embeddings"))


@query("op13_toxic_spans")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.toxic_spans import score, train

    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
