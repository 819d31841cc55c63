"""Table schemas. Every operator takes and returns DataFrames of these shapes."""

FRAME = ["asset_id", "frame_no"]
PIXEL = ["asset_id", "frame_no", "y", "x"]
RGB = ["r", "g", "b"]
RGBA = ["r", "g", "b", "a"]

FRAMES = (
    "asset_id STRING, frame_no INT, width INT, height INT, color_space STRING, "
    "pts_value BIGINT, tb_num BIGINT, tb_den BIGINT"
)
PIXELS = "asset_id STRING, frame_no INT, y INT, x INT, r DOUBLE, g DOUBLE, b DOUBLE, a DOUBLE"
SCANLINES = (
    "asset_id STRING, frame_no INT, axis STRING, idx INT, r ARRAY<DOUBLE>, g ARRAY<DOUBLE>, "
    "b ARRAY<DOUBLE>, a ARRAY<DOUBLE>"
)
SAMPLES = "asset_id STRING, channel INT, n BIGINT, v DOUBLE"
ASSETS = (
    "asset_id STRING, uri STRING, kind STRING, hash STRING, width INT, height INT, "
    "frame_count BIGINT, fps_num BIGINT, fps_den BIGINT, duration_secs DOUBLE"
)
PARAMS = "owner_id STRING, key STRING, kind STRING, b BOOLEAN, i BIGINT, d DOUBLE, s STRING"
PARAM_SPECS = (
    "effect STRING, key STRING, kind STRING, def_b BOOLEAN, def_i BIGINT, def_d DOUBLE, "
    "def_s STRING, lo DOUBLE, hi DOUBLE, options ARRAY<STRING>"
)
RECIPE = (
    "input STRING, output STRING, "
    "chain ARRAY<STRUCT<effect: STRING, label: STRING, params: MAP<STRING, STRING>>>"
)
AUDIT = (
    "case_id STRING, seq BIGINT, at TIMESTAMP_NTZ, operator_key STRING, action STRING, note STRING, "
    "input_hash STRING, output_hash STRING, recipe_hash STRING, input_sha256 STRING, "
    "output_sha256 STRING, recipe_sha256 STRING, prev_link STRING, link STRING"
)
PROJECT = (
    "schema STRING, id STRING, created STRING, modified STRING, "
    "assets ARRAY<STRUCT<id: STRING, uri: STRING, kind: STRING, hash: STRING>>, "
    "nodes ARRAY<STRUCT<id: STRING, effect: STRING, label: STRING, inputs: ARRAY<STRING>, "
    "params: MAP<STRING, STRING>>>, "
    "sinks ARRAY<STRING>, presets ARRAY<STRUCT<id: STRING, name: STRING>>, "
    "history ARRAY<STRUCT<at: STRING, summary: STRING>>, models MAP<STRING, STRING>"
)
