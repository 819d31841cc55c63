"""3-D lattice text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.errors import INVALID_PARAMETER, OperatorError


def parse_cube(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(lut_id, line_no, value)`` text rows to lattice rows and one header row per lattice.

    Comments and titles are skipped; red varies fastest. Many files parse together, each its own
    lattice of at most a few hundred thousand rows.
    """
    text = F.trim(F.substring_index("value", "#", 1))
    kept = lines.select("lut_id", "line_no", F.split(text, r"\s+").alias("w")).where(F.length(F.get("w", 0)) > 0)
    head = F.get("w", 0)
    words = ["TITLE", "LUT_1D_SIZE", "LUT_3D_SIZE", "DOMAIN_MIN", "DOMAIN_MAX"]  # fixed values
    number = lambda i: F.get("w", i).try_cast("double")
    triple = F.array(number(1), number(2), number(3))
    headers = kept.where(head.isin(words)).groupBy("lut_id").agg(
        F.max(F.when(head == "LUT_3D_SIZE", F.get("w", 1).try_cast("int"))).alias("n"),
        F.count_if(head == "LUT_1D_SIZE").alias("one_d"),
        F.coalesce(F.max(F.when(head == "DOMAIN_MIN", triple)), F.array(*[F.lit(0.0)] * 3)).alias("lo"),
        F.coalesce(F.max(F.when(head == "DOMAIN_MAX", triple)), F.array(*[F.lit(1.0)] * 3)).alias("hi"),
    )
    rows = kept.where(~head.isin(words)).join(headers.select("lut_id", "n"), "lut_id").withColumn(
        "i", F.row_number().over(Window.partitionBy("lut_id").orderBy("line_no")) - 1
    )
    n = F.col("n")
    lattice = rows.select(
        "lut_id", "n", (F.col("i") % n).alias("ri"), (F.floor(F.col("i") / n) % n).cast("int").alias("gi"),
        F.floor(F.col("i") / (n * n)).cast("int").alias("bi"), *[number(k).alias(c) for k, c in enumerate("rgb")],
    )
    return lattice, headers


def cube_errors(lattice: DataFrame, headers: DataFrame) -> DataFrame:
    """What makes a lattice file unusable."""
    seen = lattice.groupBy("lut_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("r").isNull() | F.col("g").isNull() | F.col("b").isNull()).alias("bad"))
    j = headers.join(seen, "lut_id", "left")
    narrow = F.exists(F.arrays_zip("lo", "hi"), lambda d: d["hi"] <= d["lo"])
    reason = (
        F.when(F.col("one_d") > 0, "expected 3D lattice, got 1D").when(F.col("n").isNull(), "missing LUT_3D_SIZE")
        .when(F.col("n") < 2, "LUT_3D_SIZE must be >= 2").when(F.col("bad") > 0, "bad sample row")
        .when(F.coalesce("rows", F.lit(0)) != F.col("n") * F.col("n") * F.col("n"), "sample count mismatch")
        .when(narrow, "DOMAIN_MAX must exceed DOMAIN_MIN")
    )
    return j.select("lut_id", reason.alias("reason")).where("reason is not null")


def read_cube(spark: SparkSession, path: str):
    """One lattice file as rows, with its size and domain."""
    whole = spark.read.text(path, wholetext=True).select(F.lit(path).alias("lut_id"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    lattice, headers = parse_cube(whole)
    problem = cube_errors(lattice, headers).first()
    header = headers.first()
    if problem or header is None:
        raise OperatorError(INVALID_PARAMETER, problem["reason"] if problem else "missing LUT_3D_SIZE")
    return lattice.drop("lut_id", "n"), header["n"], tuple(header["lo"]), tuple(header["hi"])
