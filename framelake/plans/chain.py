"""Running recipes over whole corpora, golden checks, and what is left to render."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.errors import INVALID_PARAMETER, OperatorError
from framelake.operators import metrics
from framelake.plans.catalogue import Registry
from framelake.schemas import FRAME, PIXEL, RGBA
from framelake.session import cut_lineage, staging_path
from framelake.sources import renders

Step = tuple[str, str | None, dict]
#: Recipes in one plan.
PLAN_RECIPES = 64


def parse_recipe(text: str) -> list[Step]:
    """Recipe JSON to steps; parameters must be plain values."""
    steps = []
    for step in json.loads(text)["chain"]:
        params = step.get("params") or {}
        for key, value in params.items():
            if not isinstance(value, bool | int | float | str):
                raise OperatorError(INVALID_PARAMETER, f"{step['effect']}: {key} has an unsupported JSON type")
        steps.append((step["effect"], step.get("label"), params))
    return steps


def apply_chain(px: DataFrame, steps: Sequence[Step], registry: Registry | None = None) -> DataFrame:
    """Steps one after the other; a step whose bound parameters change nothing adds nothing.

    A step that reads its input more than once starts from written rows unless its input is still the chain's own, so
    no step is computed twice and the planned scans of a chain grow by a constant per step.
    """
    registry = registry or Registry()
    planned = 0  # steps since the last written rows
    for effect_id, _, params in steps:
        effect, bound = registry.get(effect_id), registry.bind(effect_id, params)
        if effect.neutral(bound):
            continue
        if planned and effect.reads_again:
            px, planned = cut_lineage(px), 0
        px = effect.run(px, **bound)
        planned += 1
    return px


def apply_recipes(px: DataFrame, assigned: DataFrame, recipes: dict[str, str], registry: Registry | None = None) -> DataFrame:
    """Each asset through its assigned recipe.

    Pixels are first written by recipe, so every branch reads its own partition and the input is scanned once. A plan
    holds at most ``PLAN_RECIPES`` branches; with more recipes, each batch is written before the next is planned.
    """
    joined = px.join(assigned.select("asset_id", "recipe_id"), "asset_id")
    if len(recipes) > 1:
        path = staging_path(px.sparkSession, "by-recipe")
        joined.write.partitionBy("recipe_id").parquet(path)
        joined = px.sparkSession.read.schema(joined.schema).parquet(path)
    names = list(recipes)
    batches = []
    for start in range(0, len(names), PLAN_RECIPES):
        parts = [
            apply_chain(joined.where(F.col("recipe_id") == rid).drop("recipe_id"), parse_recipe(recipes[rid]), registry).select(*PIXEL, *RGBA)
            for rid in names[start : start + PLAN_RECIPES]
        ]
        done = reduce(DataFrame.unionByName, parts)
        batches.append(cut_lineage(done) if len(names) > PLAN_RECIPES else done)
    return reduce(DataFrame.unionByName, batches) if batches else px.limit(0).select(*PIXEL, *RGBA)


def stage_snapshots(px: DataFrame, steps: Sequence[Step], registry: Registry | None = None) -> DataFrame:
    """The frame after every step: stage 0 is the input, stage ``k`` follows step ``k``.

    Each stage is an output, so it is written once and the next step starts from the written rows.
    """
    registry = registry or Registry()
    tag = lambda df, no, name: df.select(*PIXEL, *RGBA, F.lit(no).alias("stage_no"), F.lit(name).alias("stage_label"))
    done = tag(px, 0, "00-input")
    for i, step in enumerate(steps, 1):
        after = apply_chain(px, [step], registry)
        px = after if after is px else cut_lineage(after)
        done = done.unionByName(tag(px, i, f"{i:02d}-{step[0].split('.')[-1]}"))
    return done


def render_plan(inputs: DataFrame, recipes: DataFrame, results: DataFrame) -> DataFrame:
    """Pairs of input and recipe content without a result yet."""
    wanted = inputs.join(recipes, "recipe_id").select("input_hash", "recipe_hash").distinct()
    return wanted.join(results.select("input_hash", "recipe_hash"), ["input_hash", "recipe_hash"], "left_anti")


def skip_existing(sources: DataFrame, outputs: DataFrame, force: bool = False) -> DataFrame:
    """Sources whose output name does not exist yet; all of them when forced."""
    return sources if force else sources.join(outputs.select("output_name"), "output_name", "left_anti")


def golden_run(px: DataFrame, golden: DataFrame, cases: DataFrame, steps: Sequence[Step], registry: Registry | None = None) -> DataFrame:
    """Render, compare with the golden frames, judge. Cases without comparable frames fail with NaN metrics.

    ``cases`` holds ``name, asset_id, frame_no, ssim_min, psnr_min``; null limits mean the defaults.
    """
    rendered = cut_lineage(apply_chain(px, steps, registry))  # read by the size check and by the metrics
    scores = metrics.all_metrics(rendered, golden)
    return metrics.judge(cases.join(scores, FRAME, "left"))


def golden_refresh(px: DataFrame, steps: Sequence[Step], path: str, registry: Registry | None = None) -> None:
    """Store the current rendering as golden, in place of the frames' old versions; other golden frames stay."""
    renders.replace_frames(apply_chain(px, steps, registry), path)
