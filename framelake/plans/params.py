"""Binding raw parameters to specs in bulk; problems come back as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.errors import INVALID_PARAMETER
from framelake.plans.catalogue import Param


def parse_kv(raw: DataFrame) -> DataFrame:
    """``key=value`` strings to typed parameters: bool, then int, then float, then string."""
    key = F.substring_index("kv", "=", 1)
    text = F.substr(F.col("kv"), F.length(key) + 2)
    is_bool = text.isin("true", "false")
    whole = F.when(text.rlike(r"^[+-]?[0-9]+$"), F.expr("try_cast(substr(kv, length(substring_index(kv, '=', 1)) + 2) as bigint)"))
    number = F.when(
        text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") & whole.isNull(),
        F.expr("try_cast(substr(kv, length(substring_index(kv, '=', 1)) + 2) as double)"),
    )
    kind = F.when(is_bool, "bool").when(whole.isNotNull(), "int").when(number.isNotNull(), "float").otherwise("string")
    return raw.select(
        "owner_id", key.alias("key"), kind.alias("kind"),
        F.when(is_bool, text == "true").alias("b"), whole.alias("i"), number.alias("d"),
        F.when(kind == "string", text).alias("s"),
    )


def param_errors(given: DataFrame, specs: DataFrame, strict: bool = False) -> DataFrame:
    """Unknown keys, type mismatches and range violations.

    An integer given for a float parameter is promoted without a range check, and a choice is not
    checked against its options, unless ``strict``.
    """
    spec = F.broadcast(specs)  # the catalogue: under 200 rows
    named = given.join(spec.select("key", F.col("kind").alias("want"), "lo", "hi", "options"), "key", "left")
    value = F.coalesce("d", F.col("i").cast("double"))
    same = (F.col("kind") == F.col("want")) | ((F.col("want") == "choice") & (F.col("kind") == "string"))
    promoted = (F.col("want") == "float") & (F.col("kind") == "int")
    ranged = F.col("want").isin("int", "float") & (F.lit(strict) | ~promoted)
    shown = F.when(F.col("want") == "int", F.col("i").cast("string")).otherwise(value.cast("string"))
    reason = (
        F.when(F.col("want").isNull(), "unknown parameter").when(~same & ~promoted, "type mismatch")
        .when(ranged & (value < F.col("lo")), "below min").when(ranged & (value > F.col("hi")), "above max")
    )
    if strict:
        reason = reason.when((F.col("want") == "choice") & ~F.array_contains("options", F.col("s")), "not an option")
    return named.select("owner_id", "key", shown.alias("_v"), reason.alias("reason")).where("reason is not null").select(
        "owner_id", "key", F.lit(INVALID_PARAMETER).alias("code"), "reason"
    )


def fill_params(given: DataFrame, specs: Sequence[Param], owners: DataFrame, spec_rows: DataFrame, strict: bool = False) -> DataFrame:
    """Typed value of every spec for every owner without errors; missing keys take defaults."""
    wanted = F.array(*[_literal(p) for p in specs])
    good = owners.select("owner_id").join(param_errors(given, spec_rows, strict).select("owner_id").distinct(), "owner_id", "left_anti")
    own = given.select("owner_id", "key", F.lit(True).alias("_set"), "b", "i", "d", "s")
    joined = good.select("owner_id", F.inline(wanted)).join(own, ["owner_id", "key"], "left")
    is_set = F.col("_set").isNotNull()
    return joined.select(
        "owner_id", "key", "kind",
        F.when(is_set, F.col("b")).otherwise(F.col("def_b")).alias("b"),
        F.when(F.col("kind") == "int", F.when(is_set, F.col("i")).otherwise(F.col("def_i"))).alias("i"),
        F.when(F.col("kind") == "float", F.when(is_set, F.coalesce("d", F.col("i").cast("double"))).otherwise(F.col("def_d"))).alias("d"),
        F.when(is_set, F.col("s")).otherwise(F.col("def_s")).alias("s"),
    )


def _literal(p: Param) -> Column:
    pick = lambda kinds, sql_type: F.lit(p.default if p.kind in kinds else None).cast(sql_type)
    return F.struct(
        F.lit(p.key).alias("key"), F.lit(p.kind).alias("kind"), pick(("bool",), "boolean").alias("def_b"), pick(("int",), "bigint").alias("def_i"),
        pick(("float",), "double").alias("def_d"), pick(("string", "choice"), "string").alias("def_s"),
    )


def entitled(owners: DataFrame, feature: str, as_of) -> DataFrame:
    """Owners whose entitlement holds ``feature`` and has not expired at ``as_of``."""
    alive = F.col("expires").isNull() | (F.lit(as_of).cast("timestamp_ntz") < F.col("expires"))
    return owners.where(alive & F.array_contains("features", feature))
