"""Shared SQL for the independent checks: the derived tables and small helpers, as DuckDB text."""

from __future__ import annotations

from framelake.operators.provenance import DEFAULT_KEY, GENESIS
from framelake.tables import RECIPES

LUMA = "0.2126*r + 0.7152*g + 0.0722*b"


def clamp01(e: str) -> str:
    return f"least(greatest({e}, 0.0), 1.0)"


def rgb(fn, cols: str = "rgb") -> str:
    return ", ".join(f"{fn(c)} AS {c}" for c in cols)


PX_EMB = """px_emb AS (
  SELECT 'emb' || (vec_id // 200) AS asset_id, CAST(vec_id // 50 AS INTEGER) AS frame_no, CAST(vec_id % 50 AS INTEGER) AS y, CAST(x AS INTEGER) AS x,
    least(greatest(coalesce(CAST(embedding[3*x+1] AS DOUBLE), 0.0) + 0.5, 0.0), 1.0) AS r,
    least(greatest(coalesce(CAST(embedding[3*x+2] AS DOUBLE), 0.0) + 0.5, 0.0), 1.0) AS g,
    least(greatest(coalesce(CAST(embedding[3*x+3] AS DOUBLE), 0.0) + 0.5, 0.0), 1.0) AS b,
    CAST(1.0 AS DOUBLE) AS a
  FROM embeddings, (SELECT unnest(range(22)) AS x))"""

DIMS = """dims AS (SELECT asset_id, frame_no, max(x)+1 AS w, max(y)+1 AS h FROM px_emb GROUP BY ALL)"""

PX_U8 = PX_EMB + """, px_u8 AS (
  SELECT asset_id, frame_no, y, x, CAST(floor(r*255+0.5) AS INTEGER) AS r, CAST(floor(g*255+0.5) AS INTEGER) AS g,
    CAST(floor(b*255+0.5) AS INTEGER) AS b, CAST(floor(a*255+0.5) AS INTEGER) AS a FROM px_emb)"""

PX_LI = """cells AS (
  SELECT l_suppkey, CAST(l_quantity-1 AS INTEGER) AS y, CAST(round(l_discount*100) AS INTEGER) AS x,
    least(1.0, count(*)/8.0) AS r, avg(l_tax)/0.08 AS g, least(1.0, avg(l_extendedprice)/100000.0) AS b
  FROM lineitem GROUP BY 1,2,3),
px_li AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS asset_id, 0 AS frame_no, CAST(gy.y AS INTEGER) AS y, CAST(gx.x AS INTEGER) AS x,
    coalesce(CAST(r AS DOUBLE),0.0) AS r, coalesce(g,0.0) AS g, coalesce(b,0.0) AS b, CAST(1.0 AS DOUBLE) AS a
  FROM supplier CROSS JOIN (SELECT unnest(range(50)) AS y) gy CROSS JOIN (SELECT unnest(range(11)) AS x) gx
  LEFT JOIN cells ON cells.l_suppkey = s_suppkey AND cells.y = gy.y AND cells.x = gx.x)"""

PX_PAIR = PX_EMB + """, pair AS (
  SELECT p.asset_id, p.frame_no, p.y, p.x, p.r, p.g, p.b, q.r AS r2, q.g AS g2, q.b AS b2
  FROM px_emb p JOIN px_emb q ON q.asset_id=p.asset_id AND q.frame_no=p.frame_no+1 AND q.y=p.y AND q.x=p.x)"""

# Only pairs of frames that both sides hold in one size.
PX_SAME = PX_PAIR + f""", {DIMS}, same AS (
  SELECT pair.* FROM pair JOIN dims d USING (asset_id, frame_no)
  JOIN dims e ON e.asset_id = pair.asset_id AND e.frame_no = pair.frame_no + 1 AND e.w = d.w AND e.h = d.h)"""

# Assets with frames of several sizes (needs ``dims``).
MIXED = """mixed AS (SELECT asset_id FROM dims GROUP BY asset_id HAVING min(w) <> max(w) OR min(h) <> max(h))"""

MOTION = """motion AS (
  SELECT DISTINCT asset_id, frame_no, (frame_no % 5) - 2 + CASE WHEN frame_no % 2 = 1 THEN 0.5 ELSE 0.0 END AS dx,
    (frame_no % 3) - 1 + CASE WHEN frame_no % 2 = 1 THEN 0.5 ELSE 0.0 END AS dy FROM px_emb)"""

SND = """snd AS (
  SELECT event_type AS asset_id, 0 AS channel, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n,
    greatest(-1.0, least(1.0, value/500.0*2 - 1)) AS v FROM events)"""

STEREO = SND + """, stereo AS (SELECT asset_id, channel, n, v FROM snd UNION ALL SELECT asset_id, 1, n, v*0.5 FROM snd)"""

ENTRIES = """entries AS (
  SELECT CAST(user_id AS VARCHAR) AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "at", 'op' || (event_id % 7) AS operator_key,
    CASE event_type WHEN 'signup' THEN 'case-init' WHEN 'view' THEN 'render' WHEN 'click' THEN 'note' WHEN 'purchase' THEN 'sign-off' ELSE 'note' END AS action,
    CASE WHEN event_type = 'purchase' THEN 'decision: ' || CASE WHEN value > 50 THEN 'approve' ELSE 'reject' END ELSE '' END AS note,
    CASE WHEN event_type = 'view' THEN 'sha256:' || sha256(CAST(event_id AS VARCHAR)) END AS input_hash,
    CAST(NULL AS VARCHAR) AS output_hash, CAST(NULL AS VARCHAR) AS recipe_hash,
    CASE WHEN event_type = 'view' AND event_id % 11 <> 0 THEN sha256(CAST(event_id AS VARCHAR)) END AS input_sha256,
    CAST(NULL AS VARCHAR) AS output_sha256, CAST(NULL AS VARCHAR) AS recipe_sha256, event_id
  FROM events)"""

CASES = """cases AS (SELECT CAST(user_id AS VARCHAR) AS case_id, 'op' || (user_id % 7) AS creator_key, min(ts) AS opened_at FROM events GROUP BY user_id)"""

ARTIFACTS = """artifacts AS (
  SELECT CAST(user_id AS VARCHAR) AS case_id, 'in/' || event_id || '.png' AS path, 'sha256:' || sha256(CAST(event_id AS VARCHAR)) AS hash
  FROM events WHERE event_type = 'view' AND event_id % 13 <> 0)"""


def hmac_sql(message: str) -> str:
    block = DEFAULT_KEY.ljust(64, b"\0")
    inner, outer = (bytes(b ^ k for b in block).hex() for k in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def head_sql(t: str = "") -> str:
    # Text inside JSON escapes its quotes.
    opt = lambda c: f"CASE WHEN {t}{c} IS NULL THEN '' ELSE ',\"{c}\":\"' || replace({t}{c}, '\"', chr(92) || '\"') || '\"' END"
    fields = ["case_id", "input_hash", "input_sha256", "note", "operator_key", "output_hash", "output_sha256"]
    return f"""'{{"action":"' || {t}action || '","at":"' || {t}"at" || '"' || {" || ".join(opt(c) for c in fields)} || ',"prev_link":"'"""


def tail_sql(t: str = "") -> str:
    opt = lambda c: f"CASE WHEN {t}{c} IS NULL THEN '' ELSE '\"{c}\":\"' || {t}{c} || '\",' END"
    return f"""'",' || {opt("recipe_hash")} || {opt("recipe_sha256")} || '"seq":' || {t}seq || '}}'"""


def linked(source: str = "entries", name: str = "audit", start: str = f"'{GENESIS}'") -> str:
    """Recursive linking of ``source`` into ``name`` (needs WITH RECURSIVE)."""
    return f"""{name}_steps AS (SELECT *, {head_sql()} AS _head, {tail_sql()} AS _tail FROM {source}),
{name}_links AS (
  SELECT case_id, seq, {start} AS prev_link, {hmac_sql(f"_head || {start} || _tail")} AS link FROM {name}_steps WHERE seq = 0
  UNION ALL
  SELECT e.case_id, e.seq, l.link, {hmac_sql("e._head || l.link || e._tail")} FROM {name}_links l JOIN {name}_steps e ON e.case_id = l.case_id AND e.seq = l.seq + 1),
{name} AS (SELECT e.*, l.prev_link, l.link FROM {source} e JOIN {name}_links l USING (case_id, seq))"""


AUDIT = ENTRIES + ", " + linked()
AUDIT_BAD = AUDIT + """, bad AS (SELECT * REPLACE (CASE WHEN event_id % 97 = 0 THEN 'x' ELSE note END AS note) FROM audit)"""


def checked(source: str, name: str = "checked") -> str:
    """Entries with their fault, by comparing with the previous row of the case."""
    return f"""{name}_prev AS (SELECT *, lag(seq) OVER w AS pseq, lag(link) OVER w AS plink FROM {source} WINDOW w AS (PARTITION BY case_id ORDER BY seq, link)),
{name} AS (SELECT *, CASE
    WHEN NOT (CASE WHEN seq = 0 THEN pseq IS NULL ELSE coalesce(pseq = seq - 1, false) END) THEN 'seq mismatch'
    WHEN prev_link <> CASE WHEN seq = 0 THEN '{GENESIS}' ELSE coalesce(plink, '') END THEN 'broken link'
    WHEN link <> {hmac_sql(f"{head_sql()} || prev_link || {tail_sql()}")} THEN 'link does not verify' END AS fault FROM {name}_prev)"""


def nodes(side: str) -> str:
    price, dropped = ("o_totalprice", 0) if side == "base" else ("CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END", 1)
    return f"""{side} AS (SELECT CAST(o_custkey AS VARCHAR) AS project_id, CAST(o_orderkey AS VARCHAR) AS node_id, o_orderpriority AS effect_id,
  'n' || o_orderkey AS label, CAST(o_orderkey // 2 AS VARCHAR) AS src, o_orderstatus AS status, printf('%.2f', {price}) AS totalprice
  FROM orders WHERE o_orderkey % 10 <> {dropped})"""


NODES = nodes("base") + ", " + nodes("theirs")


def models(side: str) -> str:
    dropped, moved = (3, 0) if side == "base" else (4, 1)
    return f"""models_{side} AS (SELECT CAST(c_nationkey AS VARCHAR) AS project_id, c_name AS model,
  'v' || CAST(CAST(floor(c_acctbal/1000) AS BIGINT) + CASE WHEN c_custkey % 5 = 0 THEN {moved} ELSE 0 END AS VARCHAR) AS hash FROM customer WHERE c_custkey % 10 <> {dropped})"""


MODELS = models("base") + ", " + models("theirs")


def items(side: str) -> str:
    dropped = 2 if side == "base" else 5
    return f"""items_{side} AS (SELECT p_brand AS project_id, CASE WHEN p_size % 2 = 0 THEN 'asset' ELSE 'preset' END AS kind,
  CAST(p_partkey AS VARCHAR) AS item_id, p_name AS name FROM part WHERE p_partkey % 10 <> {dropped})"""


ITEMS = items("base") + ", " + items("theirs")

RECIPE_PARTS = f"""recs AS (SELECT CAST(p_partkey AS VARCHAR) AS recipe_id,
  CASE p_partkey % 3 WHEN 0 THEN '{RECIPES[0]}' WHEN 1 THEN '{RECIPES[1]}' ELSE '{RECIPES[2]}' END AS json FROM part)"""


def values(rows: list[tuple], names: str) -> str:
    """Literal rows as an inline table."""
    lit = lambda v: "NULL" if v is None else ("'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v))
    return f"(VALUES {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) AS {names}"


def taps(name: str, sigma: float, half: int) -> str:
    """Normalized Gaussian taps ``(k, w)``."""
    raw = f"(SELECT k, exp(-k*k/(2.0*{sigma}*{sigma})) AS v FROM (SELECT unnest(range(-{half}, {half}+1)) AS k))"
    return f"{name} AS (SELECT k, v/sum(v) OVER () AS w FROM {raw})"


def conv(src: str, out: str, kernel: str, axis: str, cols: str = "rgba", dims: str = "dims") -> str:
    """One clamped pass along ``axis`` by joining every pixel with its taps."""
    limit = "w" if axis == "x" else "h"
    other = "y" if axis == "x" else "x"
    sums = ", ".join(f"sum(q.{c} * k.w) AS {c}" for c in cols)
    return f"""{out} AS (SELECT p.asset_id, p.frame_no, p.y, p.x, {sums} FROM {src} p JOIN {dims} d USING (asset_id, frame_no) CROSS JOIN {kernel} k
  JOIN {src} q ON q.asset_id = p.asset_id AND q.frame_no = p.frame_no AND q.{other} = p.{other} AND q.{axis} = least(greatest(p.{axis} + k.k, 0), d.{limit} - 1)
  GROUP BY ALL)"""


KEY = "asset_id, frame_no, y, x"


def rounded(cols: str = "rgba", digits: int = 9, t: str = "") -> str:
    return ", ".join(f"round({t}{c}, {digits}) AS {c}" for c in cols)
