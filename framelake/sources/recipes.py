"""Recipe JSON to typed step parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.errors import INVALID_PARAMETER
from framelake.schemas import RECIPE


def recipe_steps(recipes: DataFrame) -> DataFrame:
    """``(recipe_id, json)`` rows to one row per step; parameters keep their JSON spelling."""
    parsed = recipes.select("recipe_id", F.from_json("json", RECIPE, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("recipe_id", F.posexplode("r.chain").alias("step_no", "s")).select("recipe_id", "step_no", "s.*")


def value_kind(text: Column) -> Column:
    """JSON scalar kind from its spelling; numbers that fit 64 bits are integers."""
    return (
        F.when(text.isin("true", "false"), "bool")
        .when(text.rlike(r"^-?[0-9]+$"), "int")
        .when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "float")
        .when(text.rlike(r"^[\[{]"), "unsupported").otherwise("string")
    )


def recipe_params(recipes: DataFrame) -> DataFrame:
    """One row per step parameter with its kind and typed value."""
    entries = recipe_steps(recipes).select("recipe_id", "step_no", "effect", F.explode("params").alias("key", "text"))
    typed = entries.withColumn("kind", value_kind(F.col("text")))
    whole = F.when(F.col("kind") == "int", F.col("text").try_cast("bigint"))
    kind = F.when((F.col("kind") == "int") & whole.isNull(), "float").otherwise(F.col("kind"))
    return typed.select("recipe_id", "step_no", "effect", "key", kind.alias("kind"), "text").withColumns(
        {
            "i": F.when(F.col("kind") == "int", F.col("text").try_cast("bigint")),
            "d": F.when(F.col("kind") == "float", F.col("text").try_cast("double")),
        }
    )


def recipe_errors(recipes: DataFrame) -> DataFrame:
    """Parameters given as arrays or objects."""
    return recipe_params(recipes).where("kind = 'unsupported'").select(
        "recipe_id", "step_no", "key", F.lit(INVALID_PARAMETER).alias("code"), F.lit("unsupported JSON type").alias("reason")
    )
