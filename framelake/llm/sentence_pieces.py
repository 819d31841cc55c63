"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search keeps, for every end position inside a window as long as the longest piece, the one best path that ends there.
Every longer path passes through the window, so once all its backpointer paths share a boundary, the ids before that
boundary are final: they are committed and forgotten. Two laws choose the best path:

* ``merge`` (models of the merge kind): a path is lawful if merging the text of any two neighbor pieces gives just these
  two; exactly one lawful path ends at each position, and it is the model's own encoding;
* ``score`` (models of the scoring kind): the path with the highest sum of piece scores, longer last pieces first on ties.

Where a text has two neighbors that no piece holds side by side (found when a model is loaded: before spaces, and mostly
before punctuation), all paths converge; the ids between two such places are remembered per task.

Defined results: a null text encodes to null ids when encoding columns and counts as empty in the query; the empty text has no
ids; null ids decode to null; repeated rows and ids are kept; an empty table gives an empty table. Texts are encoded whole.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framelake.llm import common

SPACE = "▁"
#: Segments and neighbor pairs remembered per task; a full memory is emptied.
REMEMBERED = 200_000
REMEMBERED_PAIRS = 500_000
#: Text bytes encoded together.
STEP_BYTES = 8 << 20
#: Segments longer than this are encoded by the stream and not remembered.
LONG_SEGMENT = 64
#: Stand-ins for the text's start and for a character without a piece; the score of such a character.
START, NO_PIECE, UNKNOWN_SCORE = -2, -1, -1e6


class PieceModel:
    """The pieces of a model file and the law of its kind."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_at: dict[int, int], special: set[int], law: str = "merge", prefix: bool = True):
        self.pieces, self.law, self.prefix = pieces, law, prefix
        plain = [i for i in range(len(pieces)) if i not in bytes_at and i not in special]
        self.ids = {pieces[i]: i for i in plain}
        self.score = {pieces[i]: scores[i] for i in plain}
        self.byte_ids = {b: i for i, b in bytes_at.items()}
        self.byte_of = dict(bytes_at)
        self.special = special
        self.unknown = min(special, default=0)
        self.reach = max(map(len, self.ids), default=1)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds the space mark behind another character")
        self.segments = self._segments()
        self.pairs: dict[int, bool] = {}
        # Pieces that merging never makes cannot be on a lawful path.
        lawful = [p for p in self.ids if law != "merge" or len(p) == 1 or self.merged(p) == [p]]
        self.ends = {p: self.ids[p] for p in lawful}
        # Lengths, longest first, that a piece with the given last characters can have.
        lengths: dict[str, set[int]] = {}
        for p in lawful:
            lengths.setdefault(p[-3:], set()).add(len(p))
            if len(p) > 2:
                lengths.setdefault(p[-2:], set())
        for tail, found in lengths.items():
            found |= {k for k in (1, 2) if k < len(tail) and tail[-k:] in self.ends} | {1}
        self.lengths = {tail: tuple(sorted(found, reverse=True)) for tail, found in lengths.items()}

    @classmethod
    def load(cls, path: str, law: str = "merge") -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if sp.normalize(" a  Ａ ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}Ａ{SPACE}":
            raise ValueError("only models that keep texts as they are, with a space mark in front, are read")
        at = {i: int(sp.id_to_piece(i)[3:5], 16) for i in range(n) if sp.is_byte(i)}
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        return cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], at, special, law)

    def _segments(self) -> re.Pattern:
        """Cuts a marked text only between neighbors that no piece holds side by side: all paths converge there.

        ``closers`` are characters that pieces hold only behind the space mark or each other, so a cut may precede them;
        after ``enders`` no piece goes on at all.
        """
        inside = {pair for p in self.ids for pair in itertools.pairwise(p)}
        closers = {c for c in map(chr, range(0x250)) if not c.isalpha()}
        while drop := {b for a, b in inside if b in closers and a not in closers and a != SPACE}:
            closers -= drop
        enders = closers - {a for a, _ in inside}
        c, e = ("".join(map(re.escape, sorted(x))) for x in (closers, enders))
        some = f"[{c}]+" if c else "(?!)"
        last = f"[{c}]*[{e}]" if e else "(?!)"
        return re.compile(f"{SPACE}*(?:{last}|(?:{some})?[^{SPACE}{c}]+|{some})|{SPACE}+")

    def merged(self, text: str) -> list[str]:
        """Merge neighbors into known pieces, the highest score first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def lawful(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two pieces gives these two again."""
        a, b = self.pieces[left], self.pieces[right]
        known = a + b not in self.ends and self.merged(a + b) == [a, b]
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        self.pairs[left << 20 | right] = known
        return known

    def fallback(self, char: str) -> list[int]:
        """Ids of a character without a piece: its bytes, or the unknown id in models without bytes."""
        if self.byte_ids:
            return [self.byte_ids[b] for b in char.encode()]
        return [self.unknown]


class Stream:
    """Encodes characters as they come; ``feed`` and ``end`` return the ids committed by then."""

    def __init__(self, model: PieceModel):
        self.m = model
        self.text = ""  # characters since the last committed boundary
        self.last: list[int] = [START]  # the last piece of the best path to each position; before 0: the committed one
        self.size: list[int] = [0]  # and its length
        self.total: list[float] = [0.0]  # and the path's score, under the score law

    def _reach_merge(self, stop: int) -> None:
        """Extend the paths to position ``stop`` under the merge law."""
        m, text, last, size = self.m, self.text, self.last, self.size
        ends, lengths, known, shortest = m.ends.get, m.lengths.get, m.pairs.get, (1,)
        for i in range(len(last), stop + 1):
            tail = text[max(0, i - 3) : i]
            options = lengths(tail) or lengths(tail[1:]) or shortest
            for n in options:
                if n > i:
                    continue
                piece = ends(text[i - n : i], NO_PIECE)
                if piece < 0 and n > 1:
                    continue
                before = last[i - n]
                if before < 0 or piece < 0:  # nothing merges with the start or with a character that has no piece
                    break
                fits = known(before << 20 | piece)
                if m.lawful(before, piece) if fits is None else fits:
                    break
            last.append(piece)
            size.append(n)

    def _reach_score(self, stop: int) -> None:
        """Extend the paths to position ``stop`` under the score law."""
        m, text, total = self.m, self.text, self.total
        for i in range(len(self.last), stop + 1):
            best = (-np.inf, NO_PIECE, 1)
            for n in range(min(m.reach, i), 0, -1):
                piece = m.ends.get(text[i - n : i], NO_PIECE)
                if piece < 0 and n > 1:
                    continue
                there = total[i - n] + (m.score[m.pieces[piece]] if piece >= 0 else UNKNOWN_SCORE)
                if there > best[0]:
                    best = (there, piece, n)
            total.append(best[0])
            self.last.append(best[1])
            self.size.append(best[2])

    def _back(self, i: int) -> list[int]:
        """Boundaries of the best path to ``i``, from ``i`` down to 0."""
        out, size = [i], self.size
        while i:
            i -= size[i]
            out.append(i)
        return out

    def _commit(self, end: int) -> list[int]:
        ids: list[int] = []
        for at in self._back(end)[-2::-1]:
            piece = self.last[at]
            ids += [piece] if piece >= 0 else self.m.fallback(self.text[at - 1 : at])
        self.text, self.last, self.size = self.text[end:], self.last[end:], [0, *self.size[end + 1 :]]
        self.total = [t - self.total[end] for t in self.total[end:]]
        return ids

    def feed(self, chars: str) -> list[int]:
        ids: list[int] = []
        self.text += chars
        reach, law = self.m.reach, self._reach_merge if self.m.law == "merge" else self._reach_score
        while (have := len(self.last) - 1) < len(self.text):
            law(min(len(self.text), have + 2 * reach))
            i = len(self.last) - 1
            if i >= 2 * reach:
                shared = set(self._back(i))
                for j in range(i - 1, i - reach, -1):
                    shared &= set(self._back(j))
                if (at := max(shared)) > 0:
                    ids += self._commit(at)
        return ids

    def end(self) -> list[int]:
        return self._commit(len(self.last) - 1)

    def segment(self, text: str) -> tuple[int, ...]:
        """Ids of a short text alone; paths of the part it shares with the text before stay as they are."""
        keep, most = 0, min(len(self.text), len(text))
        before = self.text
        while keep < most and before[keep] == text[keep]:
            keep += 1
        del self.last[keep + 1 :], self.size[keep + 1 :]
        self.text = text
        if self.m.law == "merge":
            self._reach_merge(len(text))
        else:
            del self.total[keep + 1 :]
            self._reach_score(len(text))
        ids: list[int] = []
        at = len(text)
        while at:
            piece = self.last[at]
            ids += [piece] if piece >= 0 else self.m.fallback(text[at - 1])[::-1]
            at -= self.size[at]
        return tuple(ids[::-1])


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, model: PieceModel):
        self.m = model
        self.known: dict[str, tuple[int, ...]] = {}
        self.shown = [p.replace(SPACE, " ") for p in model.pieces]
        for i in model.special:
            self.shown[i] = ""
        self.is_byte = np.zeros(len(model.pieces), bool)
        self.is_byte[list(model.byte_of)] = True

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text. New segments of all texts are searched in sorted order, so that common beginnings, whose
        paths are the same, are searched once."""
        split = [self.m.segments.findall(self._marked(t)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = {seg for segs in split for seg in segs if seg not in self.known}
        state = Stream(self.m)
        for seg in sorted(new):
            if len(seg) <= LONG_SEGMENT:
                self.known[seg] = state.segment(seg)
            else:
                stream = Stream(self.m)
                self.known[seg] = (*stream.feed(seg), *stream.end())
        look, chain = self.known.__getitem__, itertools.chain.from_iterable
        out = [np.fromiter(chain(map(look, segs)), np.int32) for segs in split]
        for seg in new:
            if len(seg) > LONG_SEGMENT:
                del self.known[seg]
        return out

    def _marked(self, text: str) -> str:
        marked = text.replace(" ", SPACE)
        return SPACE + marked if self.m.prefix else marked

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) == 0:
            return ""
        if self.is_byte[ids].any():
            out, run = [], bytearray()
            for i in ids.tolist():
                if i in self.m.byte_of:
                    run.append(self.m.byte_of[i])
                    continue
                if run:
                    out.append(run.decode(errors="replace"))
                    run.clear()
                out.append(self.shown[i])
            text = "".join(out) + run.decode(errors="replace")
        else:
            text = "".join(map(self.shown.__getitem__, ids.tolist()))
        return text[1:] if self.m.prefix and text.startswith(" ") else text


@functools.lru_cache(2)
def codec(path: str, law: str = "merge") -> Codec:
    return Codec(PieceModel.load(path, law))


def _lists(ids: list[np.ndarray], nulls: list[bool]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    if len(ids) and ends[-1] >= 2**31:
        raise ValueError("a step holds too many ids")
    values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values), mask=pa.array(nulls, pa.bool_()))


def _added(df: DataFrame, column: str, name: str, kind: T.DataType, make) -> DataFrame:
    """``df`` with ``name`` computed from ``column``; an existing column of that name (in any case) is replaced."""
    kept = [c for c in df.columns if c.lower() != name.lower()]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(name, kind)])

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], make(part.column(column))], names=[*kept, name])

    return common.over_texts(df, column, schema, step, STEP_BYTES)


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", law: str = "merge") -> DataFrame:
    """``df`` with the piece ids of ``text_col``, as an array column."""

    def make(text: pa.Array) -> pa.Array:
        return _lists(codec(path, law).encode(text.to_pylist()), text.is_null().to_pylist())

    return _added(df, text_col, ids_col, T.ArrayType(T.IntegerType()), make)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded", law: str = "merge") -> DataFrame:
    """``df`` with the text of ``ids_col``; null elements are skipped."""
    ship = df.sparkSession
    common.ship_package(ship)
    kept = [c for c in df.columns if c.lower() != text_col.lower()]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            made = codec(path, law)
            rows = [None if ids is None else made.decode(np.array([i for i in ids if i is not None], np.int64)) for ids in part.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(rows, pa.string())], names=[*kept, text_col])

    return df.mapInArrow(run, schema)


def _encoded(made: Codec, texts: pa.Array) -> list[pa.Array]:
    """Number of ids, ids, and whether they decode to the text; the mark itself decodes to a space."""
    text = [t or "" for t in texts.to_pylist()]
    ids = made.encode(text)
    same = [made.decode(i) == t.replace(SPACE, " ") for i, t in zip(ids, text, strict=True)]
    return [pa.array(list(map(len, ids)), pa.int64()), _lists(ids, [False] * len(ids)), pa.array(same, pa.bool_())]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", law: str = "merge") -> DataFrame:
    """``doc_id, n_ids, ids, round_trip`` of every row: the ids are decoded again and compared with the text."""

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        arrays = [part.column("doc_id").cast(pa.int64()), *_encoded(codec(path, law), part.column("_text"))]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_ids", "ids", "round_trip"])

    slim = common.only(docs, {"doc_id": id_col, "_text": text_col})
    return common.over_texts(slim, "_text", "doc_id BIGINT, n_ids BIGINT, ids ARRAY<INT>, round_trip BOOLEAN", step, STEP_BYTES)


def encode_rows(docs: DataFrame, path: str, text_col: str = "text", law: str = "merge") -> DataFrame:
    """``docs`` with ``n_ids, ids, round_trip`` in place of columns of these names; a null text has no ids."""
    names = ["n_ids", "ids", "round_trip"]
    kept = [c for c in docs.columns if c.lower() not in names]
    kinds = [T.LongType(), T.ArrayType(T.IntegerType()), T.BooleanType()]
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *_encoded(codec(path, law), part.column(text_col))], names=[*kept, *names])

    return common.over_texts(docs, text_col, schema, step, STEP_BYTES)
