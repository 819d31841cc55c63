"""Pipeline graphs, many projects at once: validation, levels, ancestry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.errors import GRAPH
from framelake.session import cut_lineage, staging_path

NODE = ["project_id", "node_id"]
#: Ancestors of a node kept in one row before they are listed.
LINE = 64
#: Edges from which on nodes that lead nowhere are set aside, and the share of the edges that must go with them.
AMPLE, SHELL = 1 << 20, 0.25


def missing_endpoints(nodes: DataFrame, edges: DataFrame, sinks: DataFrame | None = None) -> DataFrame:
    """Inputs and sinks that name no node."""
    have = nodes.select("project_id", F.col("node_id").alias("item"))
    inputs = edges.select("project_id", F.col("src").alias("item"), F.col("dst").alias("used_by"), F.lit("input").alias("role"))
    uses = inputs
    if sinks is not None:
        uses = uses.unionByName(sinks.select("project_id", F.col("node_id").alias("item"), F.lit("").alias("used_by"), F.lit("sink").alias("role")))
    return uses.join(have, ["project_id", "item"], "left_anti")


def topo_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest distance from a source per node; ``-1`` marks nodes on or behind a cycle or a missing input.

    Stretches of nodes with a single input need no peeling: pointer jumping finds each one's nearest
    ancestor with none or several inputs in ``log2`` rounds. Peeling then runs over those anchors alone, so a
    long chain costs a few joins instead of one round per node. Where many nodes lead nowhere, as in graphs that
    widen, they are set aside before peeling and take their levels after it, so that rounds do not read their edges.
    """
    count = F.count(F.lit(1)).over(Window.partitionBy("project_id", "node_id"))
    inputs = edges.select("project_id", F.col("dst").alias("node_id"), "src").repartition(*NODE).distinct().withColumn("fan", count)
    # One row per input of a node, or without ``src`` for a node with none; a missing source is an input that never comes.
    steps = cut_lineage(nodes.select(*NODE).distinct().join(inputs, NODE, "left").withColumn("fan", F.coalesce("fan", F.lit(0).cast("bigint"))))
    anchors = steps.where("fan <> 1").select("project_id", F.col("node_id").alias("up"), F.lit(True).alias("settled")).distinct()
    one = F.lit(1).cast("bigint")
    # A pointer is settled when it stands on an anchor. Pointers double each round; on a cycle they
    # never settle, and after the longest possible chain has been covered they are left over.
    single = cut_lineage(steps.where("fan = 1").select(*NODE, F.col("src").alias("up"), one.alias("far")))
    state = cut_lineage(single.join(anchors, ["project_id", "up"], "left").select(*NODE, "up", "far", F.coalesce("settled", F.lit(False)).alias("settled")))
    reach, longest = 1, single.groupBy("project_id").count().agg(F.max("count")).first()[0] or 0
    while reach <= longest and not state.where("not settled").isEmpty():
        ahead = state.select("project_id", F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("far").alias("_far"), F.col("settled").alias("_done"))
        moving = state.where("not settled").join(ahead, ["project_id", "up"], "left")
        moved = moving.select(*NODE, F.coalesce("_up", "up").alias("up"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), F.coalesce("_done", F.lit(False)).alias("settled"))
        state, reach = cut_lineage(state.where("settled").unionByName(moved)), reach * 2

    # Contracted graph: an edge from each input's anchor to a several-input node, as long as the stretch. Inputs without an anchor
    # have none to come from.
    via = state.select("project_id", F.col("node_id").alias("src"), F.when(F.col("settled"), F.col("up")).alias("up"), "far", F.lit(True).alias("on"))
    anchor = F.when(F.col("on"), F.col("up")).otherwise(F.col("src"))
    long_edges = cut_lineage(
        steps.where("fan > 1").join(via, ["project_id", "src"], "left").select(
            "project_id", anchor.alias("anchor"), F.col("node_id").alias("dst"), F.col("fan").alias("need"), (F.coalesce("far", F.lit(0)) + one).alias("length")
        )
    )
    core, shells = _shells(long_edges)
    zero = steps.where("fan = 0").select("project_id", F.col("node_id").alias("anchor"), F.lit(0).cast("bigint").alias("level"))
    # Each round hands on only the levels found last, so every edge is joined once in all.
    fresh, levels, waiting = zero, _Parts(nodes.sparkSession, "levels"), None
    while levels.add(_arrived(core, fresh, waiting), "got = need"):
        fresh, waiting = _leveled(levels.last()), levels.last().where("got < need")
    for shell in reversed(shells):
        levels.add(_arrived(shell, zero.unionByName(_leveled(levels.all()))))
    known = zero.unionByName(_leveled(levels.all()))
    after = state.where("settled").join(known.withColumnRenamed("anchor", "up"), ["project_id", "up"])
    done = known.withColumnRenamed("anchor", "node_id").unionByName(after.select(*NODE, (F.col("level") + F.col("far")).alias("level")))
    return nodes.select(*NODE).join(done, NODE, "left").withColumn("level", F.coalesce("level", F.lit(-1).cast("bigint")))


def _shells(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The edges to peel, and shells of edges into nodes that lead nowhere once the shells before are gone.

    Each shell takes a share of the edges left, so all of them together are split in the time of a few passes.
    """
    spark, shells, left = edges.sparkSession, [], edges.count()
    while left >= AMPLE:
        ahead = edges.select("project_id", F.col("anchor").alias("dst"), F.lit(True).alias("ahead")).distinct()
        marked = edges.join(ahead, ["project_id", "dst"], "left").withColumn("ahead", F.coalesce("ahead", F.lit(False)))
        path = staging_path(spark, "shell")
        marked.write.partitionBy("ahead").parquet(path)
        parts = spark.read.schema(marked.schema).parquet(path)
        onward = parts.where("ahead").select(*edges.columns)
        rest = onward.count()
        if left - rest < left * SHELL:
            break
        shells.append(parts.where("not ahead").select(*edges.columns))
        edges, left = onward, rest
    return edges, shells


def _arrived(edges: DataFrame, levels: DataFrame, waiting: DataFrame | None = None) -> DataFrame:
    """``project_id, dst, need, got, level``: targets of edges from leveled nodes, with how many inputs came of those needed."""
    came = edges.join(levels, ["project_id", "anchor"]).select(
        "project_id", "dst", "need", F.lit(1).cast("bigint").alias("got"), (F.col("level") + F.col("length")).alias("level")
    )
    if waiting is not None:
        came = came.unionByName(waiting)
    return came.groupBy("project_id", "dst").agg(F.max("need").alias("need"), F.sum("got").alias("got"), F.max("level").alias("level"))


def _leveled(arrived: DataFrame) -> DataFrame:
    return arrived.where("got = need").select("project_id", F.col("dst").alias("anchor"), "level")


def validate(nodes: DataFrame, edges: DataFrame, sinks: DataFrame | None = None) -> DataFrame:
    """Error rows per project: missing inputs, missing sinks, cycles."""
    lost = missing_endpoints(nodes, edges, sinks).select("project_id", F.concat("role", F.lit(" references missing node "), "item").alias("reason"))
    known = nodes.select("project_id", F.col("node_id").alias("src"))
    present = edges.join(known, ["project_id", "src"], "left_semi")
    stuck = topo_levels(nodes, present).where("level < 0").select("project_id", F.lit("cycle detected").alias("reason")).distinct()
    return lost.unionByName(stuck).distinct().select("project_id", F.lit(GRAPH).alias("code"), "reason")


def ancestors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with all nodes upstream of it, itself included.

    Path doubling: round ``k`` extends the pairs known so far by jumps of exactly ``2**k`` edges, so a path of
    length ``d`` takes ``log2(d)`` rounds. Where every node has at most one input, each pair has one path and
    rounds need no deduplication; a pair of a node with itself reveals a cycle and turns it on. If such a graph is also
    less than ``LINE`` deep, rounds move one row per node with its ancestors in order, and pairs arise at the very end.
    """
    pair = ["project_id", "node_id", "ancestor"]
    known = cut_lineage(edges.select("project_id", F.col("dst").alias("node_id"), F.col("src").alias("ancestor")).distinct())
    jump = known
    self_too = nodes.select(*NODE, F.col("node_id").alias("ancestor"))
    single_path = known.groupBy("project_id", "node_id").count().where("count > 1").isEmpty()
    lines = _lines(known) if single_path else None
    if lines is not None:
        return lines.select(*NODE, F.explode("line").alias("ancestor")).where("node_id <> ancestor").unionByName(self_too)
    while True:
        fresh = _compose(jump, known)
        if not single_path:
            fresh = fresh.distinct().join(known, pair, "left_anti")
        fresh = cut_lineage(fresh)
        found = fresh.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("node_id") == F.col("ancestor")).alias("loops")).first()
        if not found["rows"]:
            break
        known = known.unionByName(fresh)
        if single_path and found["loops"]:
            single_path, known = False, cut_lineage(known.distinct())
        jump = _compose(jump, jump)
        jump = cut_lineage(jump if single_path else jump.distinct())
    return known.where("node_id <> ancestor").unionByName(self_too)


def _lines(ups: DataFrame) -> DataFrame | None:
    """``project_id, node_id, line`` of all ancestors, the nearest first, of nodes with one input each; None if some node has
    ``LINE`` of them or more, as on a cycle."""
    state = ups.select(*NODE, F.array("ancestor").alias("line"))
    reach = 1
    while True:
        # Only a line as long as the rounds so far can go on; its last node's line follows.
        whole = F.size("line") == reach
        onward = state.select("project_id", F.col("node_id").alias("_top"), F.col("line").alias("_more"))
        tops = state.withColumn("_top", F.when(whole, F.element_at("line", -1)))
        longer = F.when(F.col("_more").isNull(), F.col("line")).otherwise(F.concat("line", "_more"))
        state = cut_lineage(tops.join(onward, ["project_id", "_top"], "left").select(*NODE, longer.alias("line")))
        reach *= 2
        most = state.agg(F.max(F.size("line"))).first()[0] or 0
        if most >= LINE:
            return None
        if most < reach:
            return state


def upstream_of(sinks: DataFrame, edges: DataFrame) -> DataFrame:
    """``project_id, sink, ancestor``: every node a given sink depends on, itself included.

    A node with one input has one way up, so tables of its 1st, 2nd, 4th, ... ancestors hold at most a row per node, and lead to
    the stretch's end: the nearest node with none or several inputs. Only ends with several inputs are walked round by
    round, each once per sink; then all stretches that the walk entered are listed by doubling. A chain of
    ``n`` nodes takes ``log2(n)`` rounds, and rows in between never exceed nodes per table plus the answer. Cycles end
    where nothing new is reached.
    """
    spark = sinks.sparkSession
    node = ["project_id", "node_id"]
    steps = cut_lineage(edges.select("project_id", F.col("dst").alias("node_id"), F.col("src").alias("up")).distinct())
    fans = steps.groupBy(*node).agg(F.count(F.lit(1)).alias("fan"), F.min("up").alias("only"))
    jumps, cyclic = _stretch_jumps(fans.where("fan = 1").select(*node, F.col("only").alias("up")))
    ends = _stretch_ends(jumps)
    inputs = cut_lineage(steps.join(fans.where("fan > 1").select(*node), node))

    entered, seen = _Parts(spark, "entered"), _Parts(spark, "ends")
    fresh = sinks.select("project_id", F.col("node_id").alias("sink"), "node_id").distinct()
    while entered.add(fresh):
        last = entered.last()
        at = last.join(ends, node, "left").select(
            "project_id", "sink", F.coalesce("end", "node_id").alias("node_id")
        ).distinct().join(inputs.select(*node).distinct(), node, "left_semi")
        if len(seen):
            at = at.join(seen.all(), ["project_id", "sink", "node_id"], "left_anti")
        if not seen.add(at):
            break
        fresh = seen.last().join(inputs, node).select("project_id", "sink", F.col("up").alias("node_id")).distinct()

    triple = ["project_id", "sink", "node_id"]
    listed = _Parts(spark, "upstream")
    listed.add(entered.all().distinct())
    for jump in jumps:
        known = listed.all()
        further = known.join(jump, node).select("project_id", "sink", F.col("up").alias("node_id"))
        listed.add(further.distinct().join(known, triple, "left_anti") if cyclic else further)
    return listed.all().distinct().select("project_id", "sink", F.col("node_id").alias("ancestor"))


def _stretch_jumps(first: DataFrame) -> tuple[list[DataFrame], bool]:
    """Tables ``project_id, node_id, up`` of the 1st, 2nd, 4th, ... ancestor along single inputs, and whether some stretch is a cycle.

    A table holds the nodes with that many ancestors on their stretch; on a cycle there is always one more, so the largest
    project's size ends the doubling.
    """
    tables = [cut_lineage(first)]
    longest = tables[0].groupBy("project_id").count().agg(F.max("count")).first()[0] or 0
    while 2 ** len(tables) <= 2 * longest:
        last = tables[-1]
        onward = last.select("project_id", F.col("node_id").alias("up"), F.col("up").alias("_far"))
        further = cut_lineage(last.join(onward, ["project_id", "up"]).select("project_id", "node_id", F.col("_far").alias("up")))
        if further.isEmpty():
            return tables, False
        tables.append(further)
    return tables, 2 ** (len(tables) - 1) > longest > 0


def _stretch_ends(jumps: list[DataFrame]) -> DataFrame:
    """``project_id, node_id, end``: the top of each node's stretch, by the largest jumps first."""
    state = jumps[0].select("project_id", "node_id", F.col("node_id").alias("end"))
    for jump in reversed(jumps):
        state = state.join(jump.select("project_id", F.col("node_id").alias("end"), F.col("up").alias("_far")), ["project_id", "end"], "left")
        state = state.select("project_id", "node_id", F.coalesce("_far", "end").alias("end"))
    return cut_lineage(state)


class _Parts:
    """Rows written round by round below one folder; every round reads what is there."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.schemas = spark, staging_path(spark, name), []

    def __len__(self) -> int:
        return len(self.schemas)

    def add(self, rows: DataFrame, of_use: str = "true") -> bool:
        """Write one round; False if it holds nothing of use."""
        rows.write.parquet(f"{self.path}/part{len(self)}")
        self.schemas.append(rows.schema)
        return not self.last().where(of_use).isEmpty()

    def last(self) -> DataFrame:
        return self.spark.read.schema(self.schemas[-1]).parquet(f"{self.path}/part{len(self) - 1}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schemas[0]).parquet(*[f"{self.path}/part{k}" for k in range(len(self))])


def _compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs reached by a pair of ``first`` followed by a pair of ``second``."""
    onward = second.select("project_id", F.col("node_id").alias("ancestor"), F.col("ancestor").alias("_far"))
    return first.join(onward, ["project_id", "ancestor"]).select("project_id", "node_id", F.col("_far").alias("ancestor"))


def chain_from_recipe(steps: DataFrame) -> DataFrame:
    """Recipe steps as edges source -> step00 -> ... -> sink; unlabeled steps are named by position."""
    name = F.coalesce("label", F.concat(F.lit("step"), F.lpad(F.col("step_no").cast("string"), 2, "0")))
    line = Window.partitionBy("recipe_id").orderBy("step_no")
    named = steps.withColumn("node", name)
    inner = named.select("recipe_id", F.coalesce(F.lag("node").over(line), F.lit("source")).alias("src"), F.col("node").alias("dst"), F.col("step_no").alias("pos"))
    last = named.groupBy("recipe_id").agg(F.max_by("node", "step_no").alias("src"), (F.max("step_no") + 1).alias("pos"))
    return inner.unionByName(last.select("recipe_id", "src", F.lit("sink").alias("dst"), "pos"))
