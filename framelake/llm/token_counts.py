"""Token counts with a whole-token shortcut.

Most pre-tokens of ordinary text are one token. Which vocabulary strings those are is proven once per vocabulary:
a string qualifies if the pre-tokenizer leaves it whole and the merge rules reduce it to a single symbol. A text is then
counted by looking its pre-tokens up; only pre-tokens outside the proven list go through the merges, once per task.

Defined results: a null text counts as empty (0 tokens, 0 bytes); a null id stays null; repeated rows are counted each;
an empty table gives an empty table; other columns are not read. Texts of any length are counted whole.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from framelake.llm import common

#: Pre-tokens remembered per task beyond the proven ones; the memory is emptied when it is full.
REMEMBERED = 300_000
#: The split rule of the vocabulary file: contractions, letters, single digits, other symbols (fixed values).
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


SYMBOLS = _byte_symbols()


class WordVocabulary:
    """A byte-level vocabulary with word ends, read from a ``tokenizers`` file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.end: str = spec["model"]["end_of_word_suffix"] or ""
        self.ranks = {tuple(pair): n for n, pair in enumerate(spec["model"]["merges"])}
        self.marked = [t["content"] for t in spec["added_tokens"]]
        self.library = Tokenizer.from_file(path)
        self.split_marked = re.compile("|".join(map(re.escape, sorted(self.marked, key=len, reverse=True))) or r"(?!)")
        # Below U+0250 every character is its own composed form and maps to one lower-case character (but U+0130), so
        # plain Python splits such texts; the separators 1C-1F are white space here but not there.
        latin = [chr(c) for c in range(0x250)]
        letters = "".join(re.escape(c) for c in latin if regex.match(r"\p{L}", c))
        digits = "".join(re.escape(c) for c in latin if regex.match(r"\p{N}", c))
        self.foreign = re.compile("[^\x00-\x1b\x20-įı-ɏ]")
        self.words = re.compile("|".join([*CONTRACTIONS, f"[{letters}]+", f"[{digits}]", rf"[^\s{letters}{digits}]+"]))

    def symbols(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else "".join([SYMBOLS[b] for b in piece.encode()])

    def merged(self, symbols: str) -> list[str]:
        """The tokens of one pre-token: the lowest-ranked pair merges first, the leftmost of equals."""
        parts: list[str | None] = [*symbols[:-1], symbols[-1] + self.end]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if 0 <= a and b < n and (r := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p is not None]

    def proven(self) -> list[str]:
        """Lower-case strings that stay one pre-token and merge into one token."""
        back = {s: b for b, s in enumerate(SYMBOLS)}
        out = []
        for token in self.vocab:
            if not token.endswith(self.end) or len(token) == len(self.end):
                continue
            inner = token[: len(token) - len(self.end)] if self.end else token
            try:
                text = bytes(back[c] for c in inner).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if not self.foreign.search(text) and text == text.lower() and self.words.findall(text) == [text] and self.merged(inner) == [token]:
                out.append(text)
        return out


class _Counts(dict):
    """Token counts by pre-token; a missing one is merged and remembered."""

    def __init__(self, known: list[str], count):
        super().__init__(dict.fromkeys(known, 1))
        self.known, self.count, self.first = known, count, len(known)

    def __missing__(self, piece: str) -> int:
        n = self.count(piece)
        if len(piece) <= 64:
            if len(self) >= self.first + REMEMBERED:
                self.clear()
                self.update(dict.fromkeys(self.known, 1))
            self[piece] = n
        return n


class TokenCounter:
    """Counts tokens of whole texts."""

    def __init__(self, vocabulary: WordVocabulary, proven: list[str]):
        self.v = v = vocabulary
        merge = v.library.model.tokenize  # the library's merges; ``merged`` is the proof's own
        self.plain = _Counts(proven, lambda piece: len(merge(v.symbols(piece))))
        self.coded = _Counts([], lambda piece: len(merge(piece)))

    def _part(self, text: str) -> int:
        if not self.v.foreign.search(text):
            return sum(map(self.plain.__getitem__, self.v.words.findall(text.lower())))
        lib = self.v.library
        pieces = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))
        return sum(self.coded[p] for p, _ in pieces if p)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if "<" in text and (marks := self.v.split_marked.findall(text)):
            return len(marks) + sum(map(self._part, self.v.split_marked.split(text)))
        return self._part(text)


@functools.lru_cache(2)
def vocabulary(path: str) -> WordVocabulary:
    return WordVocabulary(path)


@functools.lru_cache(2)
def proven_tokens(path: str) -> tuple[str, ...]:
    return tuple(vocabulary(path).proven())


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    ``path`` is the vocabulary file on every executor. The proven list travels as a broadcast; it has at most as many
    entries as the vocabulary.
    """
    known = docs.sparkSession.sparkContext.broadcast(proven_tokens(path))
    made: list[TokenCounter] = []

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(TokenCounter(vocabulary(path), list(known.value)))
        sizes = [n or 0 for n in pc.binary_length(part.column("_text")).to_pylist()]
        tokens = [made[0](t) for t in part.column("_text").to_pylist()]
        return common.batch(
            [part.column("doc_id"), sizes, tokens, [n > limit for n in tokens]], ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            [pa.int64(), pa.int64(), pa.int64(), pa.bool_()],
        )

    slim = common.only(docs, {"doc_id": id_col, "_text": text_col})
    return common.over_texts(slim, "_text", "doc_id BIGINT, n_bytes BIGINT, n_tokens BIGINT, over_limit BOOLEAN", step)
