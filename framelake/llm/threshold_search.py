"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors become integers, ``floor(scale * x)``. Candidates are dealt to blocks of bounded size; a block keeps one sorted list per
dimension. Queries walk all lists of a block at one depth (from the top where a component is positive, from the bottom where
negative), many queries side by side: what any of them meets for the first time is scored for all in one product. A query stops
once the best score that an unseen vector could have, the inner product with the values at the present depth, is below its k-th
best so far, which it takes along to the next block. A task holds a few query blocks and a few candidate blocks; the k best of
every task are merged per query.

Defined results: vectors that are null, or hold null or non-finite components, and null ids take no part; an id that
repeats counts once, with its smallest vector; scores compare vectors of equal length only; ties go to the smaller id; a query
with fewer than k partners gets all; components and scores beyond 64 bits become the nearest 64-bit number, such scores after
the ranking inside a block of candidates; empty tables give an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm import common
from framelake.session import cut_lineage, ship_package

CANDIDATES_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 512
#: Depth of the first stop, and how much deeper each next one is.
FIRST_DEPTH, DEEPER = 64, 3
#: Queries that walk side by side.
QUERIES_AT_ONCE = 256
#: Most blocks of either side in a task, and how many tasks a core should get before tasks hold more than one.
MOST_BLOCKS, TASKS_PER_CORE = 8, 4


class Best:
    """The k best partners so far of several queries, as rows ``(query number, id, score)`` in the order of the result."""

    def __init__(self, queries: int, k: int, kind: np.dtype):
        self.k = k
        self.least = np.full(queries, -np.inf, kind)  # the k-th best score of each query
        self.number, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)

    def add(self, live: np.ndarray, own: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take in ``scores`` of the ``live`` queries (rows) with vectors of ascending ``ids``."""
        if not len(ids):
            return
        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        itself = np.flatnonzero(ids[at] == own)
        scores[itself, at[itself]] = -np.inf
        least = self.least[live]
        if len(ids) > self.k and (open_ := np.flatnonzero(least == -np.inf)).size:
            least[open_] = np.partition(scores[open_], len(ids) - self.k, axis=1)[:, len(ids) - self.k]
        good = scores >= least[:, None]
        good[itself, at[itself]] = False
        some = np.flatnonzero(good.any(axis=0))  # few vectors are good for any query once the k best are high
        row, column = np.nonzero(good[:, some])
        column = some[column]
        number = np.concatenate([self.number, live[row]])
        ids, scores = np.concatenate([self.ids, ids[column]]), np.concatenate([self.scores, scores[row, column]])
        order = np.lexsort((ids, -scores, number))
        number = number[order]
        rank = np.arange(len(number)) - np.searchsorted(number, number)
        kept = order[rank < self.k]
        self.number, self.ids, self.scores = number[rank < self.k], ids[kept], scores[kept]
        last = rank == self.k - 1
        self.least[number[last]] = scores[order[last]]


class Block:
    """Candidate vectors with a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.ascontiguousarray(np.argsort(self.vectors, axis=0, kind="stable").T)
        self.values = np.take_along_axis(self.vectors.T, self.lists, 1)

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, scores)`` of the k best partners of a query, exactly."""
        best = Best(1, k, query.dtype)
        self.offer(np.array([own]), query[None], best)
        return best.ids, best.scores

    def offer(self, own: np.ndarray, queries: np.ndarray, best: Best) -> None:
        """Bring ``best`` up to date with this block's vectors; ``own`` are the ids of the queries."""
        n = len(self.ids)
        met = np.zeros(n, bool)
        start, depth, live = 0, 0, np.arange(len(queries))
        while not met.all():
            asked = queries[live]
            # No unseen vector reaches beyond the values at this depth.
            reach = np.maximum(asked, 0) @ self.values[:, n - max(depth, 1)] + np.minimum(asked, 0) @ self.values[:, max(depth, 1) - 1]
            live = live[best.least[live] <= reach]
            if not len(live):
                break
            start, depth = depth, min(n, depth * DEEPER or FIRST_DEPTH)
            asked = queries[live]
            fresh = np.full(n, depth == n)  # a zero query has no list to walk
            fresh[self.lists[(asked > 0).any(axis=0), n - depth : n - start]] = True
            fresh[self.lists[(asked < 0).any(axis=0), start:depth]] = True
            new = np.flatnonzero(fresh & ~met)
            met[new] = True
            best.add(live, own[live], self.ids[new], asked @ self.vectors[new].T)


#: Number kinds, the fastest first.
KINDS = (np.float32, np.float64, object)


def _unpacked(blob: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(blob, np.int64).reshape(-1, dims + 1)
    return values[:, 0], values[:, 1:]


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest number kind in which all inner products of two blocks are exact."""
    most = a.shape[1] * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    return KINDS[0] if most < 2**24 else KINDS[1] if most < 2**53 else KINDS[2]


def _heaps(wide: int, many: int, cores: int) -> tuple[int, int]:
    """Numbers of heaps of candidate blocks and of query blocks: small ones until every core has its tasks, then up to ``MOST_BLOCKS`` each."""
    pairs = max(1, wide * many // (cores * TASKS_PER_CORE))
    held = min(MOST_BLOCKS, pairs)
    return -(-wide // held), -(-many // min(MOST_BLOCKS, max(1, pairs // held)))


def _packed(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """One row per block: ids and integer vectors as bytes. Blocks are of bounded size."""

    def pack(group: pa.Table) -> pa.Table:
        n = group.num_rows
        vectors = np.concatenate([np.asarray(c.flatten()) for c in group.column("ints").chunks]) if n else np.zeros(0, np.int64)
        table = np.column_stack([group.column("vec_id").to_numpy(), vectors.reshape(n, -1)]).astype(np.int64)
        return pa.table([*[group.column(k)[:1] for k in keys], pa.array([table.tobytes()], pa.binary())], names=[*keys, "blob"])

    return blocks.groupBy(*keys).applyInArrow(pack, ", ".join([*[f"{k} INT" for k in keys], "blob BINARY"]))


def integers(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, ints, dims`` of the vectors that take part, one row per id."""
    slim = common.only(vectors, {"vec_id": id_col, "v": vector_col}).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    wrong = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform("v", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))
    rows = slim.where(~wrong).select(F.col("vec_id").cast("bigint").alias("vec_id"), ints.alias("ints"))
    return rows.groupBy("vec_id").agg(F.min("ints").alias("ints")).withColumn("dims", F.size("ints"))


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best partners. ``is_query`` may use ``vec_id``."""
    ship_package(vectors.sparkSession)
    rows = cut_lineage(integers(vectors, scale, id_col, vector_col))
    queries = rows.where(is_query)
    n, m = rows.count(), queries.count()
    many, wide = max(1, -(-m // QUERIES_PER_BLOCK)), max(1, -(-n // CANDIDATES_PER_BLOCK))
    spread = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    asked = _packed(queries.withColumn("qb", spread(many)), ["dims", "qb"]).withColumnRenamed("blob", "asked")
    held = _packed(rows.withColumn("cb", spread(wide)), ["dims", "cb"]).withColumnRenamed("blob", "held")
    # A stated query set against all rows: every heap of candidate blocks meets every heap of query blocks.
    heaps, asks = _heaps(wide, many, vectors.sparkSession.sparkContext.defaultParallelism)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    asked = asked.select("dims", (F.col("qb") % asks).alias("ask"), every(heaps).alias("heap"), "asked")
    held = held.select("dims", every(asks).alias("ask"), (F.col("cb") % heaps).alias("heap"), "held")
    keys = ["dims", "ask", "heap"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            dims = left.column("dims")[0].as_py()
            q_ids, q = (np.concatenate(x) for x in zip(*[_unpacked(b.as_py(), dims) for b in left.column("asked")], strict=True))
            held = [_unpacked(b.as_py(), dims) for b in right.column("held")]
            kind = max((_exact(q, c) for _, c in held), key=KINDS.index)
            blocks = [Block(i, c.astype(kind)) for i, c in held]
            for at in range(0, len(q), QUERIES_AT_ONCE):
                own, asked = q_ids[at : at + QUERIES_AT_ONCE], q[at : at + QUERIES_AT_ONCE].astype(kind)
                # Scores beyond 64 bits are ranked inside their block and saturate after that.
                for together in [[b] for b in blocks] if kind is object else [blocks]:
                    best = Best(len(own), k, np.dtype(kind))
                    for block in together:
                        block.offer(own, asked, best)
                    found.append((own[best.number], best.ids, np.clip(best.scores, -(2**63), 2**63 - 1) if kind is object else best.scores))
        flat = lambda parts: np.concatenate([np.zeros(0, np.int64), *[p.astype(np.int64) for p in parts]])
        return pa.table({"query_id": flat([o for o, _, _ in found]), "vec_id": flat([i for _, i, _ in found]), "score": flat([s for _, _, s in found])})

    sides = [side.repartition(heaps * asks, *keys).groupBy(*keys) for side in (asked, held)]
    met = sides[0].cogroup(sides[1]).applyInArrow(meet, "query_id BIGINT, vec_id BIGINT, score BIGINT")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
