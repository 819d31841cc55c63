"""Benchmark items inside documents, with up to a share of edited characters.

Texts are compared in lower case with white space runs as single spaces. An item of ``n`` characters may differ by ``e =
floor(rate * n)`` edits. Cut into ``e + 1`` pieces, at least one piece of it stands unchanged in any text within ``e`` edits
(pigeonhole), so exact hits of pieces, found by one automaton, give all candidate places; each is verified with Myers' bit-parallel edit distance
on the stretch of text around the hits.

Documents are read once per block of items; a block's automaton is bounded by ``BLOCK_CHARS`` and travels as a broadcast.

Items of fewer than ``short`` characters have a budget of their own: they match without edits, and only between word borders (the characters next
to the match are no letters or digits).

Defined results: null and empty texts match nothing; items that are null or without characters match nothing; repeated items count once per id; repeated rows are judged each; a document with a null
id is judged like any other; empty tables on either side give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import common
from framelake.session import cut_lineage

#: Item characters per automaton.
BLOCK_CHARS = 4_000_000


@dataclass(frozen=True)
class Budget:
    """When a document holds an item."""

    rate: float = 0.06  #: edits allowed per item character
    short: int = 30  #: shorter normalized items match whole words without edits

    def errors(self, size: int) -> int:
        """Edits allowed for an item of that many characters."""
        return int(self.rate * size) if size >= self.short else 0


def normal(text: str | None) -> str:
    """Lower case, white space runs as one space, none at the ends."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: Budget) -> list[tuple[int, str]]:
    """``(offset, piece)``: error budget plus one consecutive pieces of nearly equal length."""
    count = budget.errors(len(item)) + 1
    cuts = [k * len(item) // count for k in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' bit vectors of one item."""

    def __init__(self, item: str):
        self.size = len(item)
        self.full, self.high = (1 << self.size) - 1, 1 << (self.size - 1)
        self.at: dict[str, int] = {}
        for k, c in enumerate(item):
            self.at[c] = self.at.get(c, 0) | 1 << k

    def best(self, text: str, enough: int) -> int:
        """Least edit distance of the item to any part of ``text``; above ``enough`` only a number above it."""
        full, high, at = self.full, self.high, self.at
        up, down, score = full, 0, self.size  # rising and falling steps along the column
        best, left = score, len(text)
        for c in text:
            same = at.get(c, 0)
            level = same | down
            diagonal = (((same & up) + up) ^ up) | same
            rise = down | (full & ~(diagonal | up))
            fall = up & diagonal
            if rise & high:
                score += 1
            elif fall & high:
                score -= 1
            rise, fall = rise << 1 & full, fall << 1 & full
            up = fall | (full & ~(level | rise))
            down = rise & level
            left -= 1
            if score < best:
                best = score
                if not best:
                    break
            elif best > enough and score - left > enough:
                break
        return best


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int | None, str]], budget: Budget):
        import ahocorasick

        self.budget = budget
        self.ids, self.items = [i for i, _ in items], [t for _, t in items]
        self.patterns: dict[int, Pattern] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            for offset, piece in pieces(item, budget):
                places.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int | None, int]]:
        """``(item id, distance)`` of every item within its budget, in item order."""
        if not text or not self.items:
            return []
        text = normal(text)
        starts: dict[int, list[int]] = {}
        for end, (n, found) in self.automaton.iter(text):
            for k, offset in found:
                starts.setdefault(k, []).append(end + 1 - n - offset)
        out = []
        for k in sorted(starts):
            item = self.items[k]
            if len(item) < self.budget.short:
                if any(self._whole(text, s, len(item)) for s in starts[k]):
                    out.append((self.ids[k], 0))
                continue
            errors = self.budget.errors(len(item))
            pattern = self.patterns.setdefault(k, Pattern(item))
            best = errors + 1
            for first, last in self._stretches(sorted(starts[k]), errors):
                window = text[max(0, first - errors) : last + len(item) + errors]
                best = min(best, pattern.best(window, errors))
                if not best:
                    break
            if best <= errors:
                out.append((self.ids[k], best))
        return out

    @staticmethod
    def _whole(text: str, start: int, size: int) -> bool:
        """Whether a match lies between word borders."""
        return not text[max(0, start - 1) : start].isalnum() and not text[start + size : start + size + 1].isalnum()

    @staticmethod
    def _stretches(starts: list[int], errors: int) -> Iterator[tuple[int, int]]:
        """Ranges of implied item starts that one verification covers: neighbors at most the budget apart."""
        first = last = starts[0]
        for s in starts[1:]:
            if s - last > errors:
                yield first, last
                first = s
            last = s
        yield first, last


def blocks(items: DataFrame, budget: Budget, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int | None, str]]]:
    """Normalized items in parts of about ``BLOCK_CHARS`` characters; only one part is on the driver at a time."""
    slim = common.only(items, {"item_id": id_col, "_text": text_col}).where(F.col("_text").isNotNull()).distinct()
    chars = slim.agg(F.sum(F.length("_text"))).first()[0] or 0
    count = -(-chars // BLOCK_CHARS)
    for block in range(count):
        rows = slim.where(F.pmod(F.xxhash64("item_id", "_text"), F.lit(count)) == block).collect()
        part = sorted({(r[0], t) for r in rows if (t := normal(r[1]))}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if part:
            yield part


def _matcher(shared, budget: Budget):
    made: list[Matcher] = []

    def get() -> Matcher:
        if not made:
            made.append(Matcher(shared.value, budget))
        return made[0]

    return get


FOUND = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))


def find_leaks(
    docs: DataFrame, items: DataFrame, budget: Budget = Budget(), id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, contaminated, n_items, items`` of every row; ``items`` lists ``(item_id, distance)`` by item id."""
    schema = "doc_id BIGINT, _text STRING, items ARRAY<STRUCT<item_id: BIGINT, distance: INT>>"
    df = common.only(docs, {"doc_id": id_col, "_text": text_col})
    df = df.select(F.col("doc_id").cast("bigint"), "_text", F.expr("CAST(array() AS ARRAY<STRUCT<item_id: BIGINT, distance: INT>>)").alias("items"))
    for n, block in enumerate(blocks(items, budget, item_id_col, item_text_col)):
        get = _matcher(df.sparkSession.sparkContext.broadcast(block), budget)
        df = cut_lineage(df) if n else df  # each further block starts from written rows, one automaton at a time

        def step(part: pa.RecordBatch, get=get) -> pa.RecordBatch:
            text, before = part.column("_text"), part.column("items").to_pylist()
            found = [b + [{"item_id": i, "distance": d} for i, d in get()(t)] for t, b in zip(text.to_pylist(), before, strict=True)]
            return pa.RecordBatch.from_arrays([part.column("doc_id"), text, pa.array(found, FOUND)], names=["doc_id", "_text", "items"])

        df = common.over_texts(df, "_text", schema, step)
    ordered = F.array_sort("items")
    return df.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("bigint").alias("n_items"), ordered.alias("items"))


def drop_leaks(
    docs: DataFrame, items: DataFrame, budget: Budget = Budget(), text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that hold no item, columns unchanged."""
    df = docs
    for n, block in enumerate(blocks(items, budget, item_id_col, item_text_col)):
        get = _matcher(df.sparkSession.sparkContext.broadcast(block), budget)
        df = cut_lineage(df) if n else df

        def step(part: pa.RecordBatch, get=get) -> pa.RecordBatch:
            return part.filter(pa.array([not get()(t) for t in part.column(text_col).to_pylist()], pa.bool_()))

        df = common.over_texts(df, text_col, docs.schema, step)
    return df
