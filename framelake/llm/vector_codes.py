"""Vector codes: one codebook per part of a vector, nearest entries found by Orchard's search.

Components become integers floor(1024 * c); a vector is cut into equal consecutive parts. Codebooks start as the parts of the
rows with the smallest ids and are refined in rounds: assign every part to its nearest entry, then replace each entry by the floor of
its parts' mean. A task sends one sum per part and entry, so a round moves a table of the codebooks' size, however many rows there are.

Orchard's search holds, for every entry, all entries sorted by their distance from it. A point starts at some entry and walks that
entry's list; a nearer entry becomes the current one and its list is walked instead; entries met before are marked and skipped; the
walk ends where the list is more than twice the current distance away, since nothing behind can be nearer. Here all
points that stand at the same place of the same list take its next ``STRIDE`` entries in one product. Distances are exact integers.

Defined results: null vectors and those with null, NaN or infinite components are dropped; so are vectors of another length than most
and those with a component of 2**14 or more (both listed by ``uncoded``). Rows with a null id are coded, but start no codebook while
others can. Repeated ids start codebooks in the order of their vectors. With fewer rows than entries, codebooks are that much
smaller. Equal distances go to the lower index. Null labels are one label. ``label_error`` is null beyond 64 bits. An empty table gives an
empty table. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.errors import INVALID_PARAMETER, LAYOUT, OperatorError
from framelake.llm import common, vectors
from framelake.session import cut_lineage, ship_package

SCALE = 1024.0
LARGEST = 1 << 24  #: scaled components stay below this
PARTS, ENTRIES, ROUNDS = 4, 256, 4
STRIDE = 32  #: list entries a point meets in one step
SEEDS = 16  #: entries, evenly spaced, of which the nearest is where a walk starts
POINTS = 1 << 14  #: points that walk together
HOT_LABELS = 8192  #: labels that can be hot, and are broadcast


class Orchard:
    """Exact nearest entry by walks along distance-sorted neighbor lists."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, np.int64)
        gaps = ((self.entries[:, None] - self.entries[None]) ** 2).sum(axis=2)
        self.lists = np.argsort(gaps, axis=1, kind="stable")
        self.away = np.take_along_axis(gaps, self.lists, 1)
        self.met = 0  #: distances taken so far

    def _distances(self, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
        a, b = (points ** 2).sum(axis=1)[:, None], (entries ** 2).sum(axis=1)[None]
        if max(int(a.max(initial=0)), int(b.max(initial=0))) < 1 << 50:  # every step below is exact in doubles
            return a + b - 2 * (points.astype(np.float64) @ entries.T.astype(np.float64)).astype(np.int64)
        return a + b - 2 * (points @ entries.T)

    def _better(self, distance, index, best, at):
        """Where a distance beats the current one, ties to the lower index."""
        return (distance < best) | ((distance == best) & (index < at))

    def _take(self, points, rows, entries, seen, at, best) -> np.ndarray:
        """Meet ``entries`` that are not marked yet; True where a point found a nearer one."""
        distance = self._distances(points[rows], self.entries[entries])
        known = seen[rows[:, None], entries[None]]
        self.met += int(known.size - known.sum())
        distance[known] = np.iinfo(np.int64).max
        seen[rows[:, None], entries[None]] = True
        low = distance.min(axis=1)
        index = np.where(distance == low[:, None], entries[None], len(self.entries)).min(axis=1)
        won = self._better(low, index, best[rows], at[rows])
        at[rows[won]], best[rows[won]] = index[won], low[won]
        return won

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of every point."""
        index, error = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        for start in range(0, len(points), POINTS):
            index[start : start + POINTS], error[start : start + POINTS] = self._walk(np.asarray(points[start : start + POINTS], np.int64))
        return index, error

    def _walk(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(points), len(self.entries)
        seen = np.zeros((n, k), bool)
        at, best = np.full(n, k), np.full(n, np.iinfo(np.int64).max)
        self._take(points, np.arange(n), np.arange(0, k, max(1, k // SEEDS)), seen, at, best)
        place, walking = np.zeros(n, np.int64), np.arange(n)
        steps = -(-k // STRIDE)
        while len(walking):
            stand = at[walking] * steps + place[walking]
            order = np.argsort(stand, kind="stable")
            walking, stand = walking[order], stand[order]
            cuts = np.flatnonzero(np.diff(stand, prepend=-1))
            for start, stop in zip(cuts, [*cuts[1:], len(stand)], strict=True):
                rows, (entry, step) = walking[start:stop], divmod(int(stand[start]), steps)
                ahead = slice(step * STRIDE, (step + 1) * STRIDE)
                won = self._take(points, rows, self.lists[entry, ahead], seen, at, best)
                place[rows] = np.where(won, 0, step + 1)
            # The walk goes on while the list's next entry is not more than twice the current distance away.
            behind = place[walking] * STRIDE
            inside = behind < k
            gap = self.away[at[walking], np.minimum(behind, k - 1)]
            walking = walking[inside & (gap <= 4 * best[walking])]
        return at, best


def integers(column: pa.Array, width: int) -> np.ndarray:
    """A list column of kept vectors as floored, scaled integers."""
    return np.floor(vectors.matrix(column, width) * SCALE).astype(np.int64)


def first_books(rows: DataFrame, width: int, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the rows with the smallest ids (``entries`` rows reach the driver)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "_v").limit(entries).select("_v").collect()
    whole = np.floor(np.array([r[0] for r in first], np.float64).reshape(len(first), width) * SCALE).astype(np.int64)
    return np.split(whole, parts, axis=1)


def refine(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """One round: assign all parts, then floor the means; a task sends at most one row per part and entry."""
    size = width // len(books)
    finders = [Orchard(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros((len(b), size), np.int64) for b in books]
        for part in batches:
            for p, points in enumerate(np.split(integers(part.column("_v"), width), len(books), axis=1)):
                index, _ = finders[p].nearest(points)
                counts[p] += np.bincount(index, minlength=len(books[p]))
                np.add.at(sums[p], index, points)
        for p in range(len(books)):
            used = np.flatnonzero(counts[p])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * size, pa.int32()), pa.array(sums[p][used].ravel()))
            yield common.batch(
                [np.full(len(used), p), used, counts[p][used], lists], ["part", "entry", "count", "sums"],
                [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())],
            )

    sent = rows.select("_v").mapInArrow(run, "part INT, entry INT, count BIGINT, sums ARRAY<BIGINT>")
    means = sent.groupBy("part", "entry").agg(F.sum("count"), *[F.sum(F.col("sums")[d]) for d in range(size)]).collect()
    done = [b.copy() for b in books]
    for part, entry, count, *sums in means:
        done[part][entry] = [s // count for s in sums]
    return done


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()


def train(
    rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> list[np.ndarray]:
    """The codebooks of all kept rows (``vec_id``, ``_v``)."""
    books = first_books(rows, width, parts, entries)
    for _ in range(rounds):
        books = refine(rows, books, width)
    return books


def encode(
    table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id",
    vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256, label`` of every kept row."""
    if not 1 <= entries <= 256:
        raise OperatorError(INVALID_PARAMETER, "a code digit pair holds 1 to 256 entries")
    spark = table.sparkSession
    ship_package(spark)
    width = vectors.usual_width(table, vector_col)
    if width % parts:
        raise OperatorError(LAYOUT, f"{width} components do not make {parts} equal parts")
    slim = common.only(table, {"vec_id": id_col, "_v": vector_col, "label": label_col})
    if width == 0:
        return slim.limit(0).selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256", "label")
    kept = slim.where(vectors.usable(F.col("_v"), width, SCALE, LARGEST))
    books = train(kept, width, parts, entries, rounds)
    finders = [Orchard(b) for b in books] if len(books[0]) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [f.nearest(p) for f, p in zip(finders, np.split(integers(part.column("_v"), width), parts, axis=1), strict=True)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), part.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                 pa.array(sum(error for _, error in found), pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    coded = cut_lineage(kept.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code STRING, error BIGINT"))
    labels = coded.groupBy("label").agg(F.count("*").alias("_rows"), F.try_sum("error").alias("label_error"))
    joined = vectors.join_spread(coded, labels, "label", "_rows", coded.count(), HOT_LABELS)
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "label")


def decode(codes: DataFrame, books: list[np.ndarray], code_col: str = "code") -> DataFrame:
    """``codes`` with ``vector``: the integer components that each code stands for."""
    tables = [np.asarray(b, np.int64) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            digits = [bytes.fromhex(c) for c in part.column(code_col).to_pylist()]
            whole = [np.concatenate([t[d] for t, d in zip(tables, row, strict=True)]).tolist() for row in digits]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(whole, pa.list_(pa.int64()))], names=[*part.schema.names, "vector"],
            )

    return codes.mapInArrow(run, T.StructType([*codes.schema.fields, T.StructField("vector", T.ArrayType(T.LongType()))]))


def uncoded(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, code, reason`` of sound vectors that ``encode`` leaves out."""
    return vectors.left_out(table, vectors.usual_width(table, vector_col), SCALE, LARGEST, id_col, vector_col)
