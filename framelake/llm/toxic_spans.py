"""Toxic spans from a linear-chain conditional random field, and document scores from its marginals.

A text's words are tokens with two states, clean and toxic. Words between sentence marks form a chain (a longer run goes on in a new
chain after ``CHAIN`` words). A word's emission is the sum of learned weights of its hashed features: the word, its
beginnings and endings, its shape. Forward and backward passes give each token's marginal; runs of tokens at or above one half are the
offending spans; the largest marginal, the marginals' sum and the text's length give the document's score through learned weights.

Labels exist for documents only, so tokens are labelled from them: words and beginnings that stand in toxic texts far too often for
chance (a likelihood-ratio test over texts, near copies counted once) mark their tokens; the field is fitted to
these labels, its own marginals label the tokens of the toxic texts again, and it is fitted a second time.

Fitting reads a bounded sample (``Training``): the labelled rows with the smallest hashes of their ids, up to a number of rows and bytes
of each class; longer texts than a sixteenth of a class's bytes are not learned from. Scoring reads every text whole, in the
tasks that read the table.

Defined results: a null, empty or wordless text gets the score of a text without any marginal and no spans; a null id is held out and is
never learned from; ids with contradictory labels are not learned from; repeated rows get equal scores; an empty table gives an
empty table; without two classes among the labels every score is the share of label 1 (0 without labels) and nothing is tagged.
Extra columns are not read. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm import common

TOKEN = re.compile(r"\w+|[.!?\n]")
CHAIN = 256  #: words of a chain
BUCKETS = 1 << 18  #: hashed features
BEGINNINGS, ENDINGS = (3, 4, 5, 6), (3, 4)
TYPES_KEPT = 400_000  #: distinct words whose emissions a task remembers
BREAK = -1


@dataclass(frozen=True)
class Training:
    """How the field is fitted; ``rows`` and the byte counts bound what is read of each class."""

    rows: int = 4000
    toxic_bytes: int = 3 << 20
    clean_bytes: int = 6 << 20
    steps: int = 40
    rate: float = 0.2
    decay: float = 2e-3
    chance: float = 24.0  #: least likelihood ratio of a marking word or beginning
    odds: float = 2.0  #: least log odds of one
    alike: float = 0.5  #: share of known shingles from which a text counts as a copy


def features(word: str) -> list[int]:
    """Hashed features of a word, always the same number."""
    low = word.lower()
    shape = "digit" if any(c.isdigit() for c in word) else "upper" if word.isupper() else "title" if word[0].isupper() else "lower"
    names = [f"w {low}", f"shape {shape}", *(f"b{n} {low[:n]}" for n in BEGINNINGS), *(f"e{n} {low[-n:]}" for n in ENDINGS)]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in names]


@dataclass
class Chains:
    """Token chains packed step by step: all first tokens by falling chain length, then all second ones, and so on."""

    packed: np.ndarray  #: place of each token, in text order
    starts: np.ndarray  #: where each step begins
    widths: np.ndarray  #: chains that are that long

    @classmethod
    def of(cls, ids: np.ndarray) -> "Chains":
        """From token ids with ``BREAK`` between chains."""
        word = ids != BREAK
        at = np.arange(len(ids))
        last_break = np.maximum.accumulate(np.where(word, -1, at))
        since = (at - last_break - 1)[word]
        step = since % CHAIN
        chain = np.cumsum(step == 0) - 1
        lengths = np.bincount(chain, minlength=chain[-1] + 1 if len(chain) else 0)
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        widths = np.bincount(step, minlength=1) if len(step) else np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(widths)])[:-1].astype(np.int64)
        return cls(starts[step] + rank[chain] if len(step) else np.zeros(0, np.int64), starts, widths)


@dataclass
class Field:
    """Weights of the field and of the document score."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    bias: float = 0.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  #: log weights from one state to the next
    document: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0, 0.0, 0.0]))
    prior: float | None = None

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        return self.weights[np.array([features(w) for w in words])].sum(axis=1, dtype=np.float64) + self.bias

    def passes(self, emission: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Odds of toxic against clean: of the emission, forward, and backward; in packed order."""
        own = np.empty(len(emission))
        own[chains.packed] = np.exp(np.clip(emission, -30, 30))
        ahead, back = own.copy(), np.ones(len(own))
        (cc, ct), (tc, tt) = np.exp(self.moves)
        for t in range(1, len(chains.starts)):
            n, here, before = chains.widths[t], chains.starts[t], chains.starts[t - 1]
            r = ahead[before : before + n]
            ahead[here : here + n] *= (ct + tt * r) / (cc + tc * r)
        for t in range(len(chains.starts) - 1, 0, -1):
            n, here, before = chains.widths[t], chains.starts[t], chains.starts[t - 1]
            x = own[here : here + n] * back[here : here + n]
            back[before : before + n] = (tc + tt * x) / (cc + ct * x)
        return own, ahead, back

    def marginals(self, emission: np.ndarray, chains: Chains) -> np.ndarray:
        """Probability of the toxic state, in text order."""
        _, ahead, back = self.passes(emission, chains)
        odds = (ahead * back)[chains.packed]
        return odds / (1 + odds)

    def gradient(self, emission: np.ndarray, chains: Chains, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood: by emission (text order) and by move."""
        own, ahead, back = self.passes(emission, chains)
        odds = ahead * back
        state = np.zeros(len(own), np.int64)
        state[chains.packed] = truth
        seen, meant = np.zeros((2, 2)), np.zeros((2, 2))
        (cc, ct), (tc, tt) = np.exp(self.moves)
        for t in range(1, len(chains.starts)):
            n, here, before = chains.widths[t], chains.starts[t], chains.starts[t - 1]
            r, x = ahead[before : before + n], own[here : here + n] * back[here : here + n]
            cells = np.stack([np.full(n, cc), ct * x, tc * r, tt * r * x])
            meant += (cells / cells.sum(axis=0)).sum(axis=1).reshape(2, 2)
            seen += np.bincount(2 * state[before : before + n] + state[here : here + n], minlength=4).reshape(2, 2)
        return truth - (odds / (1 + odds))[chains.packed], seen - meant

    def document_score(self, top: np.ndarray, total: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Probability of a toxic document from its largest marginal, the sum of all and their number."""
        if self.prior is not None:
            return np.full(len(top), self.prior)
        out = evidence(top, total, tokens) @ self.document
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def evidence(top: np.ndarray, total: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """What the document score weighs: one, the largest marginal's log odds, the logarithms of one plus all marginals and of the length."""
    top = np.clip(top, 1e-7, 1 - 1e-7)
    return np.stack([np.ones(len(top)), np.log(top / (1 - top)), np.log1p(total), np.log1p(tokens)], axis=1)


class Reader:
    """Turns texts into token ids, and remembers the words' emissions."""

    def __init__(self, model: Field):
        self.model = model
        self.known = {mark: BREAK for mark in ".!?\n"}
        self.values = np.zeros(0)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids with a break behind each text, and the number of the text that each id belongs to."""
        if len(self.known) > TYPES_KEPT:
            self.__init__(self.model)
        ids: list[np.ndarray] = []
        fresh: list[str] = []
        for text in texts:
            tokens = TOKEN.findall(text)
            for word in sorted(t for t in set(tokens) if t not in self.known):
                self.known[word] = len(self.values) + len(fresh)
                fresh.append(word)
            ids.append(np.array([*map(self.known.__getitem__, tokens), BREAK], np.int64))
        if fresh:
            self.values = np.concatenate([self.values, self.model.emissions(fresh)])
        if not ids:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(ids), np.repeat(np.arange(len(texts)), [len(i) for i in ids])

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' scores, and the marginals and text numbers of all tokens."""
        ids, owner = self.read(texts)
        word = ids != BREAK
        owner = owner[word]
        p = self.model.marginals(self.values[ids[word]], Chains.of(ids)) if self.model.prior is None else np.zeros(len(owner))
        return self.model.document_score(*gathered(p, owner, len(texts))), p, owner


def gathered(marginals: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest marginal, the sum of all and their number, of each of ``n`` texts."""
    top = np.zeros(n)
    np.maximum.at(top, owner, marginals)
    return top, np.bincount(owner, weights=marginals, minlength=n), np.bincount(owner, minlength=n)


def spans_of(text: str, marginals: np.ndarray, least: float) -> list[dict]:
    """Runs of tokens with at least this marginal, between sentence marks."""
    found: list[dict] = []
    at, together = 0, False
    for m in TOKEN.finditer(text):
        if m.group() in ".!?\n":
            together = False
            continue
        p = float(marginals[at])
        at += 1
        if p < least:
            together = False
        elif together:
            found[-1]["stop"], found[-1]["marginal"] = m.end(), max(found[-1]["marginal"], p)
        else:
            found.append({"start": m.start(), "stop": m.end(), "marginal": p})
            together = True
    return found


def distinct_texts(texts: list[str], alike: float) -> list[int]:
    """Positions of texts of which less than ``alike`` of the five-word shingles stood in the ones before."""
    seen: set[int] = set()
    kept = []
    for row, text in enumerate(texts):
        words = text.lower().split()
        mine = {hash(tuple(words[k : k + 5])) for k in range(max(1, len(words) - 4))}
        if len(mine & seen) < alike * len(mine):
            kept.append(row)
        seen |= mine
    return kept


def marking_features(tables: list[np.ndarray], labels: np.ndarray, law: Training) -> np.ndarray:
    """Which hashed words and beginnings stand in toxic texts too often for chance; ``tables`` holds each text's features once."""
    held = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for mine, label in zip(tables, labels, strict=True):
        held[label][mine] += 1
    clean, toxic = held
    n = np.array([max(1, (labels == 0).sum()), max(1, (labels == 1).sum())], float)
    share = n[1] / n.sum()
    both = clean + toxic
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(toxic > 0, toxic * np.log(toxic / (both * share)), 0) + np.where(clean > 0, clean * np.log(clean / (both * (1 - share))), 0))
    odds = np.log((toxic + 0.5) / (n[1] + 1)) - np.log((clean + 0.5) / (n[0] + 1))
    ratio = np.where(odds >= law.odds, np.nan_to_num(ratio), 0)
    # Of few texts no feature is that sure; the surest ones mark then.
    return (ratio > 0) & (ratio >= min(law.chance, ratio.max() / 2))


def fit_field(ids: np.ndarray, truth: np.ndarray, table: np.ndarray, law: Training) -> Field:
    """Fit to labelled tokens: ``ids`` (with breaks) number the rows of ``table``, the words' features."""
    model, chains = Field(), Chains.of(ids)
    words = ids[ids != BREAK]
    used, local = np.unique(table, return_inverse=True)
    local = local.reshape(table.shape)
    # Weights of the used features, then the bias, then the moves.
    size = len(used)
    w = np.zeros(size + 5)
    w[size] = -4.0
    first, second = np.zeros_like(w), np.zeros_like(w)
    scale = 1 / max(1.0, truth.sum())
    for k in range(1, law.steps + 1):
        model.moves = w[size + 1 :].reshape(2, 2)
        by_token, by_move = model.gradient((w[local].sum(axis=1) + w[size])[words], chains, truth)
        by_word = np.bincount(words, weights=by_token, minlength=len(table))
        g = np.concatenate([
            np.bincount(local.ravel(), weights=np.repeat(by_word, table.shape[1]), minlength=size), [by_token.sum()], by_move.ravel(),
        ]) * scale - law.decay * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        rate = law.rate * (1 - 0.9 * k / law.steps)
        w += rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-9)
    model.moves = w[size + 1 :].reshape(2, 2)
    model.weights[used], model.bias = w[:size], float(w[size])
    return model


def fit_documents(seen: np.ndarray, labels: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of the document score, by Newton's method with a small penalty."""
    x, w = seen, np.zeros(seen.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(hess, x.T @ (labels - p) - 0.1 * w)
    return w


def fit(texts: list[str], labels: list[int], law: Training = Training()) -> Field:
    """A field fitted to labelled texts."""
    y = np.array(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return Field(prior=float(y.mean()) if len(y) else 0.0)
    rows = distinct_texts(texts, law.alike)
    texts, y = [texts[r] for r in rows], y[rows]
    reader = Reader(Field())
    ids, whose = reader.read(texts)
    table = np.array([features(w) for w, k in reader.known.items() if k != BREAK], np.int64).reshape(-1, 2 + len(BEGINNINGS) + len(ENDINGS))
    words, owner = ids[ids != BREAK], whose[ids != BREAK]
    marks = table[:, [0, *range(3, 2 + len(BEGINNINGS))]]  # the word, and beginnings of four letters and more
    held = [np.unique(marks[np.unique(mine)]) for mine in np.split(words, np.searchsorted(owner, np.arange(1, len(texts))))]
    toxic = y[owner] == 1
    truth = (marking_features(held, y, law)[marks].any(axis=1)[words] & toxic).astype(np.int64)
    if not truth.any():
        return Field(prior=float(y.mean()))
    for _ in range(2):
        # A toxic text without a labelled token says nothing about its tokens yet.
        silent = (y == 1) & (np.bincount(owner, weights=truth, minlength=len(texts)) == 0)
        model = fit_field(ids[~silent[whose]], truth[~silent[owner]], table, law)
        p = model.marginals((model.weights[table].sum(axis=1, dtype=np.float64) + model.bias)[words], Chains.of(ids))
        truth = ((p >= 0.5) & toxic).astype(np.int64)
    model.document = fit_documents(evidence(*gathered(p, owner, len(texts))), y)
    return model


def fold(doc_id: Column) -> Column:
    """``crc32`` of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def train(
    docs: DataFrame, labels: DataFrame, law: Training = Training(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Field:
    """Fit on labelled rows of the folds other than 2.

    At most ``law.rows`` ids of each class, by hash, reach the driver with their texts' sizes; then the texts that fit into the
    class's bytes, in the same order.
    """
    known = common.only(labels, {"_id": id_col, "_label": label_col}).where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1))
    known = known.where(fold(F.col("_id")) != 2).groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other"))
    known = known.where(F.col("_label") == F.col("_other")).drop("_other")
    order = [F.xxhash64("_id"), F.col("_id")]
    picked = known.where("_label = 1").orderBy(*order).limit(law.rows).union(known.where("_label = 0").orderBy(*order).limit(law.rows))
    texts = common.only(docs, {"_id": id_col, "_text": text_col}).where(F.col("_text").isNotNull())
    sizes = texts.join(F.broadcast(picked), "_id").groupBy("_id", "_label").agg(F.max(F.octet_length("_text")).alias("_bytes"))
    left, chosen = {0: law.clean_bytes, 1: law.toxic_bytes}, {}
    for row in sizes.orderBy(*order).collect():
        most = law.toxic_bytes if row["_label"] else law.clean_bytes
        if row["_bytes"] <= min(left[row["_label"]], most // 16):
            left[row["_label"]] -= row["_bytes"]
            chosen[row["_id"]] = int(row["_label"])
    if not chosen:
        return Field(prior=0.0)
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i,) for i in chosen], known.select("_id").schema)
    read = texts.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min("_text").alias("_text")).toPandas()
    got = dict(zip(read["_id"], read["_text"], strict=True))
    return fit([got[i] for i in chosen], list(chosen.values()), law)


def score(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3, tagged: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_tokens, spans`` of every row; ``spans`` are runs of tokens with marginals of ``tagged`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    readers: list[Reader] = []
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("marginal", pa.float64())]))

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        if not readers:
            readers.append(Reader(shared.value))
        texts = [t or "" for t in part.column("_text").to_pylist()]
        p, marginals, owner = readers[0].judge(texts)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        hit = np.zeros(len(texts), bool)
        hit[owner[marginals >= tagged]] = True
        spans = [spans_of(t, marginals[a:b], tagged) if h else [] for t, a, b, h in zip(texts, cuts[:-1], cuts[1:], hit, strict=True)]
        return common.batch(
            [part.column("doc_id"), part.column("held_out"), p, (p >= least).astype(np.int32), np.diff(cuts), spans],
            ["doc_id", "held_out", "score", "predicted", "n_tokens", "spans"], [pa.int64(), pa.bool_(), pa.float64(), pa.int32(), pa.int64(), span],
        )

    slim = common.only(docs, {"doc_id": id_col, "_text": text_col}).withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(True)))
    return common.over_texts(
        slim, "_text",
        "doc_id BIGINT, held_out BOOLEAN, score DOUBLE, predicted INT, n_tokens BIGINT, spans ARRAY<STRUCT<start: INT, stop: INT, marginal: DOUBLE>>", step,
    )


def drop_toxic(docs: DataFrame, model: Field, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score below ``least``, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    readers: list[Reader] = []

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        if not readers:
            readers.append(Reader(shared.value))
        p, _, _ = readers[0].judge([t or "" for t in part.column(text_col).to_pylist()])
        return part.filter(pa.array(p < least))

    return common.over_texts(docs, text_col, docs.schema, step)
