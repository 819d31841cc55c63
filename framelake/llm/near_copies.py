"""Near-duplicate documents: circulant MinHash bands, exact Jaccard links, connected components.

1. *Sketch.* Each text becomes its set of word shingles and a circulant MinHash signature, cut into bands. Texts with equal sets form a
   class (J = 1), represented by its smallest id.
2. *Hubs.* In every band bucket the class that shares most buckets with others is the hub; all others of the bucket are compared with
   it, each pair once over all bands. Groups of near copies mostly have such a center, so this linear number of pairs links nearly all.
3. *Rest.* Buckets whose members are still in several components are finished exactly: members outside the bucket's largest
   component meet every member, block against block inside tasks, and only links that join components leave the task. A pair is
   compared in the bucket of the first band it shares, and not at all once it is joined or where its sizes rule a link out.
4. *Components* by alternating large and small stars.

Links are confirmed on full sets, recomputed from the texts. With 32 bands of 4 coordinates a pair at the similarity bound meets in no band with
probability 5e-6. No step gathers a bucket or a component: hot hubs and buckets are dealt out in blocks of ``BLOCK`` members and
``BLOCK_CELLS`` shingles, and what is known of a bucket is sent to every ``SALT_ROWS`` of its members.

Defined results: a null, empty or blank text has an empty set, is linked with nothing and is its own component; rows with a null
id have a null component, are kept and link nothing; repeated rows share a class, and the texts of one id count as linked,
so that a repeated id has one component (but for its empty texts); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm import common, shingle_sets
from framelake.session import cut_lineage, ship_package

#: Signature coordinates, and coordinates per band.
SIGNATURE, BAND_ROWS = 128, 4
PERCENT = 75
#: Classes compared with one hub, or with each other, in one step.
BLOCK = 256
#: Shingles of one side of such a step; a longer single text is a block of its own.
BLOCK_CELLS = 1 << 20
#: Rows and shingles that one verification group should hold.
ROWS_PER_GROUP, CELLS_PER_GROUP = 1024, 1 << 20
#: Members of a hot bucket that one task joins with what is known of the bucket.
SALT_ROWS = 4096
#: Up to so many sets are compared with a probe one by one.
FEW = 16


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, set_key, bands`` of every row; key and bands are null for empty sets."""

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_sets.shingles(t) for t in part.column("_text").to_pylist()]
        full = [k for k, s in enumerate(sets) if len(s)]
        keys: list[bytes | None] = [None] * len(sets)
        bands: list[np.ndarray | None] = [None] * len(sets)
        for k, band in zip(full, shingle_sets.bands(shingle_sets.signatures([sets[k] for k in full], SIGNATURE), BAND_ROWS), strict=True):
            keys[k], bands[k] = shingle_sets.set_key(sets[k]), band
        return common.batch(
            [part.column("doc_id"), [len(s) for s in sets], keys, bands], ["doc_id", "n_shingles", "set_key", "bands"],
            [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())],
        )

    slim = common.only(docs, {"doc_id": id_col, "_text": text_col})
    return common.over_texts(slim, "_text", "doc_id BIGINT, n_shingles BIGINT, set_key BINARY, bands ARRAY<BIGINT>", step)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node on an edge, by alternating large and small stars."""
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, seen = cut_lineage(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut_lineage(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _dealt(rows: DataFrame, unit: list[str]) -> DataFrame:
    """``rows`` with a group number: units of bounded size, many to a group, by rows and by the shingles they hold."""
    n, cells = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("cells"), F.lit(0))).first()
    groups = max(1, -(-n // ROWS_PER_GROUP), -(-int(cells) // CELLS_PER_GROUP))
    return rows.drop("cells").withColumn("g", F.pmod(F.xxhash64(*unit), F.lit(groups)).cast("int"))


class _Links:
    """Confirms links on full sets, and keeps those that join what is still apart."""

    def __init__(self, texts: dict[int, set[str]], bands: dict[int, set[tuple[int, ...]]]):
        self.sets = {k: [shingle_sets.shingles(t) for t in sorted(found)] for k, found in texts.items()}
        # Ids that repeat with several sets have several signatures: their pairs are compared wherever they meet.
        self.bands = {k: np.array(next(iter(found)), np.int64) for k, found in bands.items() if len(found) == 1}
        self.up: dict[int, int] = {}
        self.found: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def meet(self, probes: list[tuple[int, int]], base: list[tuple[int, int]], key: int | None = None, main: int | None = None) -> None:
        """Compare ``(node, component)`` probes with a base.

        Left out are pairs that are joined already, pairs whose sizes rule a link out, and, in the bucket ``key``, pairs that
        share an earlier band: these meet in that band's bucket. Of two probes, which meet twice (both are outside the component
        ``main``), the smaller one is compared with the other.
        """
        owners = [(node, comp, s) for node, comp in base for s in self.sets[node] if len(s)]
        if not owners:
            return
        nodes = np.array([node for node, _, _ in owners], np.int64)
        roots = np.array([self.root(comp) for _, comp, _ in owners], np.int64)
        sizes = np.array([len(s) for _, _, s in owners])
        signed = np.array([key is not None and node in self.bands for node in nodes.tolist()])
        keys = np.array([self.bands[node] for node in nodes[signed].tolist()]) if signed.any() else None
        row_of = np.cumsum(signed) - 1
        settled = np.array([main is None or comp == main for _, comp, _ in owners])
        together: tuple[np.ndarray, np.ndarray] | None = None  # all shingles of the base, in order, with their owners
        for node, comp in probes:
            for s in self.sets[node]:
                own = self.root(comp)
                can = (roots != own) & (settled | (nodes > node)) & (nodes != node) & (100 * np.minimum(sizes, len(s)) >= PERCENT * np.maximum(sizes, len(s)))
                if keys is not None and node in self.bands:
                    at = np.flatnonzero(can & signed)
                    same = keys[row_of[at]] == self.bands[node]
                    can[at] = self.bands[node][same.argmax(1)] == key if len(at) else False
                at = np.flatnonzero(can)
                if not len(at):
                    continue
                if len(at) <= FEW:
                    both = np.array([shingle_sets.shared(s, owners[k][2]) for k in at])
                else:
                    if together is None:
                        values = np.concatenate([x for _, _, x in owners])
                        order = np.argsort(values, kind="stable")
                        together = values[order], np.repeat(np.arange(len(owners)), sizes)[order]
                    both = _counts(s, *together, len(owners))[at]
                for k in at[100 * both >= PERCENT * (len(s) + sizes[at] - both)]:
                    if (other := int(roots[k])) != own:
                        self.up[other] = own
                        roots[roots == other] = own
                        self.found.append((node, int(nodes[k])))


def _counts(s: np.ndarray, values: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """How many shingles of ``s`` each owner of the sorted ``values`` holds."""
    low, high = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
    hits = high - low
    at = np.repeat(high - np.cumsum(hits), hits) + np.arange(int(hits.sum()))
    return np.bincount(owner[at], minlength=owners)


def _links_of(rows: DataFrame, texts: DataFrame, unit: list[str], banded: bool = False) -> DataFrame:
    """Verified links ``a, b`` of dealt rows ``g, *unit, node, comp, probe``; probes of a unit meet its other rows.

    ``banded`` units are parts of the bucket ``key`` with the largest component ``main``; each of their pairs is compared in one bucket only.
    """

    def confirm(group: pa.Table) -> pa.Table:
        cols = group.to_pydict()
        found: dict[int, set[str]] = {}
        for node, text in zip(cols["node"], cols["text"], strict=True):
            found.setdefault(node, set()).add(text)
        bands: dict[int, set[tuple[int, ...]]] = {}
        if banded:
            for node, keys in zip(cols["node"], cols["bands"], strict=True):
                bands.setdefault(node, set()).add(tuple(keys))
        links = _Links(found, bands)
        units: dict[tuple, tuple[set, set]] = {}
        for name, node, comp, probe in zip(zip(*[cols[u] for u in unit], strict=True), cols["node"], cols["comp"], cols["probe"], strict=True):
            units.setdefault(name, (set(), set()))[0 if probe else 1].add((node, comp))
        for name, (probes, base) in units.items():
            links.meet(sorted(probes), sorted(base), *[name[unit.index(c)] for c in ("key", "main") if banded])
        return pa.table({"a": pa.array([a for a, _ in links.found], pa.int64()), "b": pa.array([b for _, b in links.found], pa.int64())})

    joined = rows.join(texts, "node").select("g", *unit, "node", "comp", "probe", "text", *["bands"][: int(banded)])
    return joined.groupBy("g").applyInArrow(confirm, "a BIGINT, b BIGINT")


def _blocks(members: str, cells: str) -> Column:
    """In how many blocks so many members with so many shingles are dealt."""
    return F.greatest(F.ceil(F.col(members) / BLOCK), F.ceil(F.col(cells) / BLOCK_CELLS)).cast("bigint")


def _salted_join(rows: DataFrame, per_key: DataFrame) -> DataFrame:
    """``rows`` (with their bucket's ``members``) joined with one row per ``key`` that is sent to every salt of a hot bucket."""
    salts = F.ceil(F.col("members") / SALT_ROWS).cast("bigint")
    left = rows.withColumn("salt", F.pmod(F.xxhash64("node"), salts))
    right = per_key.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("members")
    return left.join(right, ["key", "salt"]).drop("salt")


def _hub_rows(shared: DataFrame) -> DataFrame:
    """Rows for the hub comparisons of bucket members ``key, node, n_shingles, members, cells``.

    A hub stands in at most as many buckets as a signature has bands, so dealing its partners by the size of the bucket they
    share with it bounds its parts without a count per hub.
    """
    weight = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    weighted = shared.join(weight, "node")
    hubs = weighted.groupBy("key").agg(
        F.max_by(F.struct("node", "n_shingles"), F.struct("weight", -F.col("node"))).alias("hub"), F.first("members").alias("members"),
    )
    met = _salted_join(shared.withColumn("blocks", _blocks("members", "cells")), hubs).where("node <> hub.node")
    pairs = cut_lineage(met.groupBy(F.col("hub.node").alias("hub"), "node").agg(
        F.max("blocks").alias("blocks"), F.max("n_shingles").alias("cells"), F.max("hub.n_shingles").alias("hub_cells"),
    )).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")))
    unit = ["hub", "blocks", "part"]
    members = pairs.select(*unit, "node", F.col("node").alias("comp"), F.lit(True).alias("probe"), "cells")
    centers = pairs.groupBy(*unit).agg(F.max("hub_cells").alias("cells"))
    return members.unionByName(centers.select(*unit, F.col("hub").alias("node"), F.col("hub").alias("comp"), F.lit(False).alias("probe"), "cells"))


def _rest_rows(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows for buckets that still hold several components: outsiders against all members, in blocks."""
    members = shared.join(comps, "node", "left").select("key", "node", "n_shingles", "members", F.coalesce("component", "node").alias("comp"))
    sizes = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("cells"), F.first("members").alias("members"))
    main = F.max(F.struct("n", "comp", "cells"))
    bucket = sizes.groupBy("key").agg(main.alias("main"), F.sum("n").alias("n"), F.sum("cells").alias("cells"), F.count(F.lit(1)).alias("comps"), F.first("members").alias("members"))
    bucket = bucket.where("comps > 1").select(
        "key", "members", F.col("main.comp").alias("main"), "n", "cells", (F.col("n") - F.col("main.n")).alias("n_out"), (F.col("cells") - F.col("main.cells")).alias("cells_out")
    ).select("key", "members", "main", _blocks("n", "cells").alias("wide"), _blocks("n_out", "cells_out").alias("many"))
    open_rows = _salted_join(members, bucket).withColumnRenamed("n_shingles", "cells")
    block = lambda count: F.pmod(F.xxhash64("node"), F.col(count))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))
    base = open_rows.select("key", "main", "node", "comp", "cells", F.lit(False).alias("probe"), block("wide").alias("bb"), each("many").alias("pb"))
    probes = open_rows.where("comp <> main").select("key", "main", "node", "comp", "cells", F.lit(True).alias("probe"), block("many").alias("pb"), each("wide").alias("bb"))
    return base.unionByName(probes)


def _same_id(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``a, b`` between the classes of ids that repeat with different sets."""
    several = named.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low <> high")
    held = named.join(several.select("doc_id"), "doc_id", "left_semi").select("doc_id", "set_key").distinct()
    return held.join(classes.select("set_key", "node"), "set_key").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    ship_package(docs.sparkSession)
    rows = cut_lineage(sketch(docs, id_col, text_col))
    named = rows.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = cut_lineage(named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    members = classes.select("node", "n_shingles", F.explode("bands").alias("key"))
    # A repeated id may stand in a bucket with several sets; one row a member, as large as its largest set.
    members = cut_lineage(members.groupBy("key", "node").agg(F.max("n_shingles").alias("n_shingles")))
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("cells")).where("members > 1")
    shared = cut_lineage(members.join(counts, "key"))
    texts = common.only(docs, {"node": id_col, "text": text_col}).where("node IS NOT NULL AND text IS NOT NULL")
    signed = classes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "bands")
    texts = texts.join(signed, "node")
    if not named.groupBy("doc_id").count().where("count > 1").isEmpty():
        texts = texts.distinct()
    texts = cut_lineage(texts)

    unit = ["hub", "blocks", "part"]
    links = _links_of(_dealt(cut_lineage(_hub_rows(shared)), unit), texts.drop("bands"), unit)
    links = cut_lineage(links.unionByName(_same_id(named, classes)))
    comps = cut_lineage(components(links))
    unit = ["key", "main", "pb", "bb"]
    more = cut_lineage(_links_of(_dealt(cut_lineage(_rest_rows(shared, comps)), unit), texts, unit, banded=True))
    if not more.isEmpty():
        comps = cut_lineage(components(more.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b")))))

    known = classes.select("set_key", "node").join(comps, "node", "left").select("set_key", F.coalesce("component", "node").alias("_component"))
    done = rows.drop("bands").join(known, "set_key", "left")
    return done.select(
        "doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"),
    ).withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, columns unchanged; rows with a null id stay."""
    gone = near_duplicates(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("_gone_id"), "left_anti")
