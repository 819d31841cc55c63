"""Differences between two versions of projects, applying them, and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.errors import GRAPH
from framelake.session import cut_lineage

NODE = ["project_id", "node_id"]
NIL_NODE = "00000000-0000-0000-0000-000000000000"  # fixed value: node id that carries model conflicts


def full_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Key-by-key comparison; ``change`` is added, removed, changed or same."""
    left = a.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_a"))
    right = b.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_b"))
    change = (
        F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed")
        .when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    )
    return left.join(right, keys, "full_outer").withColumn("change", change).drop("_a", "_b")


def params_long(nodes: DataFrame) -> DataFrame:
    """Node parameters, one row per key."""
    return nodes.select(*NODE, F.explode("params").alias("key", "value"))


def diff_params(a: DataFrame, b: DataFrame) -> DataFrame:
    return full_diff(a, b, [*NODE, "key"], "value").where("change <> 'same'")


def apply_params(a: DataFrame, diff: DataFrame) -> DataFrame:
    """Remove, then add, then change: what the diff touches is replaced by its after-values."""
    keys = [*NODE, "key"]
    rest = a.join(diff.select(*keys), keys, "left_anti")
    fresh = diff.where("change <> 'removed'").select(*keys, F.col("after").alias("value"))
    return rest.select(*keys, "value").unionByName(fresh)


def edges_of(nodes: DataFrame) -> DataFrame:
    return nodes.select("project_id", F.explode("inputs").alias("src"), F.col("node_id").alias("dst"))


def canonical_params(c: Column | str = "params") -> Column:
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    )


def diff_graphs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Node and edge changes; a changed effect, label or input list is a removal plus an addition."""
    shape = F.concat_ws("|", "effect_id", "label", F.array_join("inputs", ","))
    side = lambda df, tag: df.select(*NODE, shape.alias(f"shape_{tag}"), canonical_params().alias(f"params_{tag}"))
    both = side(a, "a").join(side(b, "b"), NODE, "full_outer")
    rebuilt = F.col("shape_a") != F.col("shape_b")
    kinds = F.array_compact(F.array(
        F.when(F.col("shape_b").isNull() | rebuilt, F.lit("node_removed")),
        F.when(F.col("shape_a").isNull() | rebuilt, F.lit("node_added")),
        F.when((F.col("shape_a") == F.col("shape_b")) & (F.col("params_a") != F.col("params_b")), F.lit("node_changed")),
    ))
    nodes = both.select("project_id", F.explode(kinds).alias("change"), F.col("node_id").alias("item"))
    ea, eb = edges_of(a), edges_of(b)
    name = F.concat_ws("->", "src", "dst")
    gone = ea.exceptAll(eb).select("project_id", F.lit("edge_removed").alias("change"), name.alias("item"))
    new = eb.exceptAll(ea).select("project_id", F.lit("edge_added").alias("change"), name.alias("item"))
    return nodes.unionByName(gone).unionByName(new)


def graph_diff_errors(target: DataFrame, diff: DataFrame) -> DataFrame:
    """What makes a diff inapplicable: missing nodes to remove or change, edges to unknown nodes."""
    have = target.select("project_id", F.col("node_id").alias("item"))
    known = have.unionByName(diff.where("change = 'node_added'").select("project_id", "item")).distinct()
    touched = diff.where("change in ('node_removed', 'node_changed')").select("project_id", "item")
    lost = touched.join(have, ["project_id", "item"], "left_anti").select(
        "project_id", F.concat(F.lit("missing node "), F.col("item")).alias("reason")
    )
    ends = diff.where("change like 'edge_%'").select("project_id", F.explode(F.split("item", "->")).alias("item"))
    loose = ends.join(known, ["project_id", "item"], "left_anti").select(
        "project_id", F.concat(F.lit("edge references missing node "), F.col("item")).alias("reason")
    )
    return lost.unionByName(loose).distinct().select("project_id", F.lit(GRAPH).alias("code"), "reason")


def apply_graph(target: DataFrame, source: DataFrame, diff: DataFrame) -> DataFrame:
    """``target`` with ``diff`` applied; added nodes and changed parameters come from ``source``.

    Projects with any violation are left as they are. Removing a node also drops it from inputs.
    """
    diff = cut_lineage(diff)  # read by every branch below
    broken = graph_diff_errors(target, diff).select("project_id").distinct()
    usable = cut_lineage(diff.join(broken, "project_id", "left_anti"))
    pick = lambda change: usable.where(F.col("change") == change).select("project_id", F.col("item").alias("node_id"))
    removed, added, changed = pick("node_removed"), pick("node_added"), pick("node_changed")
    kept = target.join(removed, NODE, "left_anti").join(added, NODE, "left_anti")
    fresh = source.select(*NODE, F.col("params").alias("_new")).join(changed, NODE, "left_semi")
    updated = kept.join(fresh, NODE, "left").withColumn("params", F.coalesce("_new", "params")).drop("_new")
    nodes = cut_lineage(updated.unionByName(source.select(*target.columns).join(added, NODE, "left_semi")))
    # Inputs follow the edge changes: drop removed nodes and edges, append added edges once.
    split = F.split("item", "->")
    by_kind = lambda change: usable.where(F.col("change") == change).select(
        "project_id", F.get(split, 0).alias("src"), F.get(split, 1).alias("node_id")
    )
    wires = nodes.select(*NODE, F.posexplode("inputs").alias("pos", "src"))
    gone_nodes = removed.join(added, NODE, "left_anti").select("project_id", F.col("node_id").alias("src"))
    wires = wires.join(gone_nodes, ["project_id", "src"], "left_anti").join(by_kind("edge_removed"), [*NODE, "src"], "left_anti")
    extra = by_kind("edge_added").withColumn("pos", F.lit(1 << 30))
    wired = wires.select(*NODE, "pos", "src").unionByName(extra.select(*NODE, "pos", "src")).groupBy(*NODE, "src").agg(F.min("pos").alias("pos"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "src"))), lambda s: s["src"])
    inputs = wired.groupBy(*NODE).agg(ordered.alias("_in"))
    none = F.array().cast("array<string>")
    return nodes.join(inputs, NODE, "left").withColumn("inputs", F.coalesce("_in", none)).drop("_in")


def apply_sinks(sinks: DataFrame, target: DataFrame, diff: DataFrame) -> DataFrame:
    """Sinks of ``target`` (``project_id, node_id``) after ``diff``: removed nodes, rebuilt ones too, are sinks no longer.

    Projects with any violation keep theirs.
    """
    diff = cut_lineage(diff)  # read by both branches
    broken = graph_diff_errors(target, diff).select("project_id").distinct()
    removed = diff.where("change = 'node_removed'").join(broken, "project_id", "left_anti").select("project_id", F.col("item").alias("node_id"))
    return sinks.join(removed, NODE, "left_anti")


def diff_items(a: DataFrame, b: DataFrame) -> DataFrame:
    """Assets and presets by id: what was added and removed."""
    cols = ["project_id", "kind", "item_id"]
    gone = a.select(*cols).subtract(b.select(*cols)).withColumn("_c", F.lit("_removed"))
    new = b.select(*cols).subtract(a.select(*cols)).withColumn("_c", F.lit("_added"))
    return gone.unionByName(new).select("project_id", F.concat("kind", "_c").alias("change"), F.col("item_id").alias("item"))


def diff_models(a: DataFrame, b: DataFrame) -> DataFrame:
    moved = full_diff(a, b, ["project_id", "model"], "hash").where("change <> 'same'")
    return moved.select("project_id", F.concat(F.lit("model_"), F.col("change")).alias("change"), F.col("model").alias("item"))


def diff_projects(nodes_a, nodes_b, items_a, items_b, models_a, models_b) -> DataFrame:
    """Every change between two sets of projects as ``(project_id, change, item)``."""
    return diff_graphs(nodes_a, nodes_b).unionByName(diff_items(items_a, items_b)).unionByName(diff_models(models_a, models_b))


def merge_nodes(base: DataFrame, theirs: DataFrame) -> DataFrame:
    """All nodes of both sides; theirs win."""
    cols = [c for c in base.columns if c not in NODE]
    a = base.select(*NODE, F.struct(*cols).alias("_a"))
    b = theirs.select(*NODE, F.struct(*cols).alias("_b"))
    return a.join(b, NODE, "full_outer").select(*NODE, F.coalesce("_b", "_a").alias("v")).select(*NODE, "v.*")


def merge_conflicts(base: DataFrame, theirs: DataFrame, models_base: DataFrame, models_theirs: DataFrame) -> DataFrame:
    """Parameters that differ on nodes of both sides, and models pinned differently, one row per key.

    Keys are compared inside each node's own pair of maps and never gathered per project.
    """
    both = base.select(*NODE, F.col("params").alias("pa")).join(theirs.select(*NODE, F.col("params").alias("pb")), NODE)
    names = F.array_union(F.map_keys("pa"), F.map_keys("pb"))
    differ = F.filter(names, lambda k: ~F.try_element_at("pa", k).eqNullSafe(F.try_element_at("pb", k)))
    nodes = both.select(*NODE, F.explode(differ).alias("param_key"))
    pins = full_diff(models_base, models_theirs, ["project_id", "model"], "hash").where("change = 'changed'")
    return nodes.unionByName(pins.select("project_id", F.lit(NIL_NODE).alias("node_id"), F.col("model").alias("param_key")))


def merge_items(base: DataFrame, theirs: DataFrame) -> DataFrame:
    """Append-only by id: base rows stay, theirs fill in."""
    keys = ["project_id", "kind", "item_id"]
    return base.unionByName(theirs.join(base.select(*keys), keys, "left_anti"))


def merge_models(base: DataFrame, theirs: DataFrame) -> DataFrame:
    keys = ["project_id", "model"]
    return theirs.unionByName(base.join(theirs.select(*keys), keys, "left_anti"))


def merge_sinks(base: DataFrame, theirs: DataFrame) -> DataFrame:
    """Sinks of either side, each once."""
    return union_distinct(base.select(*NODE), theirs.select(*NODE))


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*NODE).intersect(b.select(*NODE))


def except_items(a: DataFrame, b: DataFrame) -> DataFrame:
    cols = ["project_id", "kind", "item_id"]
    return a.select(*cols).exceptAll(b.select(*cols))


def upsert(store: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Keyed replace-or-insert; with an empty ``changes`` value set it is a plain scan."""
    return store.join(changes.select(*key), key, "left_anti").unionByName(changes)


def remove(store: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    return store.join(ids.select(*key), key, "left_anti")


def history_append(projects: DataFrame, history: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History with new entries, and projects with ``modified`` moved to their latest one."""
    latest = entries.groupBy("project_id").agg(F.max("at").alias("_at"))
    bumped = projects.join(latest, "project_id", "left").withColumn("modified", F.coalesce(F.greatest("modified", "_at"), "modified"))
    return history.unionByName(entries), bumped.drop("_at")
