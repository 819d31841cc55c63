"""Removal of long byte strings that already stand in an earlier document.

A byte goes if any ``floor``-byte string that covers it also starts in a document with a smaller id. Matches never cross documents and
are judged on the input. Equal ``floor``-byte windows have the same *anchor*, the least hash among their ``ANCHOR``-byte strings, so
work is dealt by anchors and no task sees the corpus:

1. every text is cut into stretches of windows with one anchor; anchors are counted by distinct contents, dealt by hash, and
   only those that at least two different texts hold go on;
2. the stretches of those anchors are dealt by anchor. In each part, stretches that share no window's hash with another document
   are left out; a run-length compressed Burrows-Wheeler index of the others' distinct ones, ordered by their first document, is
   built, and all of them stream through it: where the matching statistics
   reach ``floor``, the index names the first document that holds the window;
3. covered bytes are collected per document and cut out.

Only the first of documents with equal texts takes part; the others repeat it as a whole. A stretch that a step of ``STEP_BYTES``
meets again in a later document is covered there as a whole and is not sent again. Stretches at the border of a common
passage differ in every document, so where an anchor has more than ``HOT_STRETCHES`` stretches, its windows are dealt by their own
digests instead: a step covers what it meets again and sends each distinct window with its first document. Where anchors are
counted, two texts of a step stand for all of its texts that share an anchor. So no anchor gathers in one part.

Defined results: a null or empty text has no bytes and no removals; rows with a null id are neither judged nor matched; rows
that repeat an id are not earlier than each other; texts shorter than ``floor`` bytes lose nothing; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import common
from framelake.llm.run_length_index import RunLengthIndex
from framelake.session import cut_lineage, ship_package

FLOOR, ANCHOR = 50, 16
#: Most windows of a stretch; a longer run of windows with one anchor (periodic text) is cut.
STRETCH_WINDOWS = FLOOR - ANCHOR + 1
#: Text bytes that a step cuts into stretches together.
STEP_BYTES = 8 << 20
#: Corpus bytes per part when anchors are counted, and stretch bytes per part of the index.
COUNT_BYTES, INDEX_BYTES = 36 << 20, 2 << 20
LEAST_PARTS = 12
#: An anchor with more stretches than one part of the index is meant for is hot: its windows are dealt one by one.
HOT_STRETCHES = INDEX_BYTES // (FLOOR + STRETCH_WINDOWS - 1)
#: Stretches go to a part as lists of their documents, starts and bytes.
STRETCHES = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()))
#: Packed windows of hot anchors per part.
WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("start", "<i4")])
WINDOW_BYTES = 16 << 20
#: Windows worked on together.
PIECE_BYTES = 1 << 19
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A well mixed number for every ``ANCHOR``-byte string of ``data``."""
    words = data.astype(np.uint64)
    for half in (1, 2, 4, 8):  # pack 2, 4, 8 bytes, then mix two halves
        mixed = words[: len(words) - half] << np.uint64(8 * half) if half < 8 else words[: len(words) - half] * np.uint64(0x9E3779B97F4A7C15)
        words = mixed ^ words[half:] if half < 8 else mixed + words[half:]
    words ^= words >> np.uint64(29)
    words *= np.uint64(0xBF58476D1CE4E5B9)
    words ^= words >> np.uint64(32)
    words *= np.uint64(0x94D049BB133111EB)
    return words ^ words >> np.uint64(29)


def stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, first window, windows, anchor)`` of all stretches: consecutive windows with one anchor.

    Texts are worked on in pieces of ``PIECE_BYTES`` windows, so memory does not follow the longest text.
    """
    done, held, size = [], [], 0
    for k, text in enumerate(texts):
        for offset in range(0, len(text) - FLOOR + 1, PIECE_BYTES):
            piece = text[offset : offset + PIECE_BYTES + FLOOR - 1]
            if held and size + len(piece) > PIECE_BYTES:
                done.append(_stretches(held))
                held, size = [], 0
            held.append((k, offset, piece))
            size += len(piece)
    if held:
        done.append(_stretches(held))
    if not done:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def _stretches(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    texts = [p for _, _, p in pieces]
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    low = _anchor_hashes(data)
    width, span = FLOOR - ANCHOR + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    # Stretches begin at a piece's first window and where the anchor changes; windows across pieces are left out.
    first = np.cumsum(sizes) - sizes
    last = first + sizes - FLOOR  # every piece holds a window
    begins = np.zeros(len(low) + 1, bool)
    begins[first] = begins[last + 1] = True
    begins[1:-1] |= low[1:] != low[:-1]
    heads = np.flatnonzero(begins)
    owner = np.searchsorted(first, heads, "right") - 1
    inside = heads <= last[owner]
    windows = np.diff(np.append(heads, last[-1] + 1))[inside]
    heads, owner = heads[inside], owner[inside]
    parts = -(-windows // STRETCH_WINDOWS)
    if len(parts) and parts.max() > 1:
        cut = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        windows = np.minimum(np.repeat(windows, parts) - cut * STRETCH_WINDOWS, STRETCH_WINDOWS)
        heads, owner = np.repeat(heads, parts) + cut * STRETCH_WINDOWS, np.repeat(owner, parts)
    number, offset = np.array([k for k, _, _ in pieces]), np.array([o for _, o, _ in pieces])
    return number[owner], heads - first[owner] + offset[owner], windows, low[heads] >> np.uint64(16)


def _packed_anchors(anchor: np.ndarray, text: np.ndarray, hashes: np.ndarray, weight: np.ndarray) -> bytes:
    heavy = np.flatnonzero(weight != 1)
    return b"".join([
        np.array([len(hashes), len(anchor), len(heavy), 0], np.uint32).tobytes(), hashes.tobytes(), text.astype(np.uint32).tobytes(),
        (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), heavy.astype(np.uint32).tobytes(), weight[heavy].astype(np.uint32).tobytes(),
        (anchor >> np.uint64(32)).astype(np.uint16).tobytes(),
    ])


def _unpacked_anchors(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m, k, _ = (int(x) for x in np.frombuffer(blob, np.uint32, 4))
    hashes = np.frombuffer(blob, np.int64, n, 16)
    at = 16 + 8 * n
    text, low = np.frombuffer(blob, np.uint32, m, at), np.frombuffer(blob, np.uint32, m, at + 4 * m)
    heavy, more = np.frombuffer(blob, np.uint32, k, at + 8 * m), np.frombuffer(blob, np.uint32, k, at + 8 * m + 4 * k)
    high = np.frombuffer(blob, np.uint16, m, at + 8 * m + 8 * k)
    weight = np.ones(m, np.int64)
    weight[heavy] = more
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), hashes[text], weight


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Places where a row differs from the one before in any column; the first row counts."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _lists(anchor: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Owners and the packed anchors of each, in order and each once."""
    order = np.lexsort((anchor, owner))
    anchor, owner = anchor[order], owner[order]
    new = _changes(owner, anchor)
    anchor, owner = anchor[new], owner[new]
    heads = _changes(owner)
    return owner[heads], [anchor[a:b].tobytes() for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(anchor)], strict=False)]


def repeated_anchors(rows: DataFrame, parts: int, hot_from: int) -> DataFrame:
    """``text_hash, anchors`` (packed) of the anchors that texts with different hashes share; ``rows``: ``text_hash, text``.

    Anchors that different texts of one step share are known to be shared, so two of these texts stand for all of them where anchors
    are counted. Rows without a ``text_hash`` hold pairs of an anchor with over ``hot_from`` stretches and their number.
    """

    def send(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hashes, of = np.unique(part.column("text_hash").to_numpy(), return_inverse=True)
        owner, _, _, anchor = stretches([(t or "").encode() for t in part.column("text").to_pylist()])
        owner = of[owner]
        order = np.lexsort((owner, anchor))
        anchor, owner = anchor[order], owner[order]
        new = _changes(anchor, owner)
        times = np.diff(np.append(new, len(anchor)))
        anchor, owner = anchor[new], owner[new]
        names, blobs, known, lists = [], [], [], []
        if len(anchor):
            heads = _changes(anchor)
            ends = np.append(heads[1:], len(anchor)) - 1
            sends = np.zeros(len(anchor), bool)
            sends[heads] = sends[ends] = True
            total = np.add.reduceat(times, heads)
            weight = np.ones(len(anchor), np.int64)
            weight[heads] = total - (ends > heads)  # the last of several counts as one
            known, lists = _lists(anchor[~sends], owner[~sends])
            anchor, owner, weight = anchor[sends], owner[sends], weight[sends]
        to = (anchor % np.uint64(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(parts + 1))
        for p in range(parts):
            mine = order[edges[p] : edges[p + 1]]
            if len(mine):
                used, local = np.unique(owner[mine], return_inverse=True)
                names.append(p)
                blobs.append(_packed_anchors(anchor[mine], local, hashes[used], weight[mine]))
        told = hashes[known].tolist() if len(known) else []
        columns = [names + [h % parts for h in told], blobs + [None] * len(told), [None] * len(names) + told, [None] * len(names) + lists]
        yield common.batch(columns, ["part", "blob", "text_hash", "anchors"], [pa.int32(), pa.binary(), pa.int64(), pa.binary()])

    def count(group: pa.Table) -> pa.Table:
        told = group.filter(pc.is_valid(group.column("text_hash"))).select(["text_hash", "anchors"])
        got = [_unpacked_anchors(b.as_py()) for b in group.column("blob") if b.is_valid]
        if not got:
            return told
        anchor, owner, weight = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(anchor)
        anchor, owner = anchor[order], owner[order]
        heads = _changes(anchor)
        shared = np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads)
        total = np.add.reduceat(weight[order], heads)
        hot = np.flatnonzero(shared & (total > hot_from))
        pairs = np.column_stack([anchor[heads[hot]], total[hot].astype(np.uint64)])
        keep = np.repeat(shared, np.diff(np.append(heads, len(anchor))))
        owners, lists = _lists(anchor[keep], owner[keep])
        owners = owners.tolist()
        if len(hot):
            owners, lists = [*owners, None], [*lists, pairs.tobytes()]
        return pa.concat_tables([told, pa.table({"text_hash": pa.array(owners, pa.int64()), "anchors": pa.array(lists, pa.binary())})])

    sent = common.over_texts(rows, "text", "part INT, blob BINARY, text_hash BIGINT, anchors BINARY", send, STEP_BYTES)
    return sent.groupBy("part").applyInArrow(count, "text_hash BIGINT, anchors BINARY")


def _window_names(text: bytes, at: np.ndarray, windows: np.ndarray, doc: int) -> np.ndarray:
    """The windows of some stretches by 128-bit digests."""
    starts = np.repeat(at - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    out = np.empty(len(starts), WINDOW)
    digests = b"".join([hashlib.blake2b(text[a : a + FLOOR], digest_size=16).digest() for a in starts.tolist()])
    out["a"], out["b"] = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
    out["doc"], out["start"] = doc, starts
    return out


def _first_windows(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the first document that holds each, and those of later documents (by document and start)."""
    found = found[np.lexsort((found["doc"], found["b"], found["a"]))]
    heads = np.concatenate([[True], (found["a"][1:] != found["a"][:-1]) | (found["b"][1:] != found["b"][:-1])])
    later = found["doc"] > found["doc"][np.flatnonzero(heads)][np.cumsum(heads) - 1]
    again = found[later]
    return found[~later], again[np.lexsort((again["start"], again["doc"]))]


def _window_ranges(again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges ``(document, begin, end)`` of windows by document and start."""
    heads, tails = _runs(again["doc"], again["start"])
    return again["doc"][heads], again["start"][heads], again["start"][tails] + FLOOR


def _runs(of: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of runs of windows that touch, of one text each; windows ascend per text."""
    if not len(of):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    apart = (of[1:] != of[:-1]) | (start[1:] > start[:-1] + FLOOR)
    heads = np.flatnonzero(np.concatenate([[True], apart]))
    return heads, np.append(heads[1:], len(of)) - 1


def _packed_ranges(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Documents and the packed ranges of each."""
    order = np.argsort(doc, kind="stable")
    doc, pairs = doc[order], np.column_stack([begin, end])[order].astype(np.int32)
    heads = _changes(doc)
    return doc[heads].tolist(), [pairs[a:b].tobytes() for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(doc)], strict=False)]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the ascending ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _send_stretches(rows: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """Stretches as parallel lists, windows and covered ranges for every part; ``rows``: ``doc_id, text, anchors`` (lists of packed lists).

    Windows of ``hot`` anchors go to parts by their digests, so no anchor gathers in one part.
    """

    def send(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        part = part.sort_by("doc_id")
        ids = part.column("doc_id").to_numpy()
        texts = [(t or "").encode() for t in part.column("text").to_pylist()]
        owner, at, windows, anchor = stretches(texts)
        # What one text shares is in the lists of all texts that hold it, so the lists of a step are one set.
        known = np.unique(np.frombuffer(b"".join(a for lists in part.column("anchors").to_pylist() for a in lists), np.uint64))
        mine = np.flatnonzero(_among(anchor, known))
        named, covered = [], []
        is_hot = _among(anchor[mine], hot)
        warm, mine = mine[is_hot], mine[~is_hot]
        edges = np.searchsorted(owner[warm], np.arange(len(texts) + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            own = warm[edges[k] : edges[k + 1]]
            named.append(_window_names(texts[k], at[own], windows[own], int(ids[k])))
        anchor, owner, begin, end = anchor[mine], owner[mine], at[mine], at[mine] + windows[mine] + FLOOR - 1
        edges = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        first: dict[bytes, int] = {}
        found, holder = [], []
        for k, text in enumerate(texts):
            span, doc = slice(edges[k], edges[k + 1]), int(ids[k])
            cut = [text[a:b] for a, b in zip(begin[span].tolist(), end[span].tolist(), strict=True)]
            holder += [first.setdefault(stretch, doc) for stretch in cut]
            found += cut
        docs = ids[owner]
        later = np.array(holder, np.int64) < docs
        covered.append((docs[later], begin[later], end[later]))
        new = np.flatnonzero(~later)
        to = (anchor[new] % np.uint64(parts)).astype(np.int64)
        new = new[np.argsort(to, kind="stable")]
        heads = _changes(to := np.sort(to))
        names = to[heads].tolist()
        values = [docs[new], begin[new].astype(np.int32), [found[i] for i in new.tolist()]]
        bounds = pa.array(np.append(heads, len(new)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(v, kind.value_type)) for v, kind in zip(values, STRETCHES, strict=True)]
        loose = [None] * len(names)
        if named:
            new, again = _first_windows(np.concatenate(named))
            covered.append(_window_ranges(again))
            to = (new["a"] % np.uint64(parts)).astype(np.int64)
            new = new[np.argsort(to, kind="stable")]
            edges = np.searchsorted(np.sort(to), np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edges)).tolist():
                names.append(p)
                loose.append(new[edges[p] : edges[p + 1]].tobytes())
        told, ranges = _packed_ranges(*(np.concatenate(x) for x in zip(*covered, strict=True)))
        covered = [[None] * len(names) + told, [None] * len(names) + ranges]
        names, loose = names + [d % parts for d in told], loose + [None] * len(told)
        lists = [pa.concat_arrays([x, pa.nulls(len(names) - len(x), x.type)]) for x in lists]
        kinds = [pa.int32(), *STRETCHES, pa.binary(), pa.int64(), pa.binary()]
        yield common.batch([names, *lists, loose, *covered], ["part", "docs", "starts", "stretches", "windows", "doc_id", "ranges"], kinds)

    lists = "docs ARRAY<BIGINT>, starts ARRAY<INT>, stretches ARRAY<BINARY>"
    return common.over_texts(rows, "text", f"part INT, {lists}, windows BINARY, doc_id BIGINT, ranges BINARY", send, STEP_BYTES)


def _may_match(texts: pa.Array, owner: np.ndarray) -> np.ndarray:
    """Numbers of the strings that share the hash of a window with a string of another document; no other string matches."""
    lengths = pc.binary_length(texts).to_numpy().astype(np.int64)
    windows = lengths - FLOOR + 1
    hashes = _anchor_hashes(np.frombuffer(b"".join(texts.to_pylist()), np.uint8))
    at = np.arange(windows.sum()) + np.repeat(np.cumsum(lengths - windows) - lengths + windows, windows)
    mixed = hashes[at]
    for offset in [*range(ANCHOR, FLOOR - ANCHOR, ANCHOR), FLOOR - ANCHOR]:  # strings of anchor length that make up a window
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) ^ hashes[at + offset]
    order = np.argsort(mixed)
    of = np.repeat(np.arange(len(texts)), windows)[order]
    heads = _changes(mixed[order])
    shared = np.minimum.reduceat(owner[of], heads) != np.maximum.reduceat(owner[of], heads)
    found = np.zeros(len(texts), bool)
    found[of[np.repeat(shared, np.diff(np.append(heads, len(of))))]] = True
    return np.flatnonzero(found)


def covered_ranges(doc: np.ndarray, start: np.ndarray, found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered byte ranges ``(document, begin, end)`` of one part's stretches."""
    coded = found.dictionary_encode()
    number, texts = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    lengths = pc.binary_length(texts).to_numpy().astype(np.int64)
    owner = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(owner, number, doc)
    later = np.flatnonzero(doc > owner[number])  # a later document repeats the whole stretch
    whole = doc[later], start[later], start[later] + lengths[number[later]]
    picked = _may_match(texts, owner)
    picked = picked[np.argsort(owner[picked], kind="stable")]
    if not len(picked):
        return whole
    strings = texts.take(pa.array(picked)).to_pylist()
    index = RunLengthIndex(strings, FLOOR)
    _, _, first = index.stream(strings)
    firsts = owner[picked]
    earliest = np.where(first >= 0, firsts[np.maximum(first, 0)], np.iinfo(np.int64).max)
    sizes = lengths[picked]
    begin = np.cumsum(sizes) - sizes
    hit = np.flatnonzero(earliest < np.repeat(firsts, sizes))
    which = np.searchsorted(begin, hit, "right") - 1
    window = hit - begin[which]
    heads, tails = _runs(which, window)
    # Every place where the first document holds a stretch gets the ranges of that stretch.
    order = np.argsort(picked[which[heads]], kind="stable")
    covers, low, high = picked[which[heads]][order], window[heads][order], window[tails][order] + FLOOR
    held = np.flatnonzero(doc == owner[number])
    from_, to = np.searchsorted(covers, number[held]), np.searchsorted(covers, number[held], "right")
    place = np.repeat(held, to - from_)
    nth = np.arange(len(place)) - np.repeat(np.cumsum(to - from_) - to + from_, to - from_)
    r = np.repeat(from_, to - from_) + nth
    return tuple(np.concatenate(x) for x in zip(whole, (doc[place], start[place] + low[r], start[place] + high[r]), strict=True))


def _part(group: pa.Table) -> pa.Table:
    told = group.filter(pc.is_valid(group.column("doc_id"))).select(["doc_id", "ranges"])
    found = []
    if group.column("docs").null_count < group.num_rows:
        flat = lambda name: pc.list_flatten(group.column(name)).combine_chunks()
        found.append(covered_ranges(flat("docs").to_numpy(), flat("starts").to_numpy(), flat("stretches")))
    named = [np.frombuffer(b.as_py(), WINDOW) for b in group.column("windows") if b.is_valid]
    if named:
        found.append(_window_ranges(_first_windows(np.concatenate(named))[1]))
    ids, ranges = _packed_ranges(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else ([], [])
    return pa.concat_tables([told, pa.table({"doc_id": pa.array(ids, pa.int64()), "ranges": pa.array(ranges, pa.binary())})])


def merged(pairs: np.ndarray) -> np.ndarray:
    """Maximal ranges of overlapping or touching ``(start, end)`` pairs."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
    heads = np.flatnonzero(new)
    return np.column_stack([pairs[heads, 0], reach[np.append(heads[1:], len(pairs)) - 1]])


def removal_ranges(docs: DataFrame, rows: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, ranges``: packed covered ranges of the first document of each distinct text, several rows per document."""
    texts = common.only(docs, {"doc_id": id_col, "text": text_col}).where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= FLOOR))
    texts = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    n_bytes = rows.agg(F.sum("n_bytes")).first()[0] or 0
    counted = repeated_anchors(texts.select("text_hash", "text"), max(LEAST_PARTS, -(-n_bytes // COUNT_BYTES)), HOT_STRETCHES)
    anchors = cut_lineage(counted.groupBy("text_hash").agg(F.collect_list("anchors").alias("anchors")))
    found = [np.frombuffer(b, np.uint64).reshape(-1, 2) for r in anchors.where("text_hash IS NULL").collect() for b in r.anchors]
    hot = np.concatenate(found) if found else np.zeros((0, 2), np.uint64)
    n_anchors = anchors.where("text_hash IS NOT NULL").agg(F.sum(F.aggregate("anchors", F.lit(0).cast("bigint"), lambda s, a: s + F.octet_length(a)))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-(n_anchors // 8 * (FLOOR + STRETCH_WINDOWS // 2)) // INDEX_BYTES))
    parts = max(parts, -(-int(hot[:, 1].sum()) * STRETCH_WINDOWS * WINDOW.itemsize // WINDOW_BYTES))
    wanted = classes.select("doc_id", "text_hash").join(anchors, "text_hash")
    held = texts.join(wanted, ["doc_id", "text_hash"]).select("doc_id", "text", "anchors")
    sent = _send_stretches(held, parts, np.sort(hot[:, 0]))
    return sent.groupBy("part").applyInArrow(_part, "doc_id BIGINT, ranges BINARY")


def _cut(texts: DataFrame) -> DataFrame:
    """``doc_id, sha, n_removed, n_spans, kept_sha256, kept`` of ``doc_id, sha, text, ranges`` (lists of packed ranges)."""

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        removed, spans, digest, kept = [], [], [], []
        for text, ranges in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist(), strict=True):
            data = text.encode()
            gone = merged(np.frombuffer(b"".join(ranges), np.int32).reshape(-1, 2).astype(np.int64))
            edges = [0, *gone.ravel().tolist(), len(data)]
            left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            removed.append(len(data) - len(left))
            spans.append(len(gone))
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        return common.batch(
            [part.column("doc_id"), part.column("sha"), removed, spans, digest, kept], ["doc_id", "sha", "n_removed", "n_spans", "kept_sha256", "kept"],
            [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()],
        )

    schema = "doc_id BIGINT, sha STRING, n_removed BIGINT, n_spans BIGINT, kept_sha256 STRING, kept BINARY"
    return common.over_texts(texts, "text", schema, step)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row; ``with_kept`` adds the remaining bytes of rows that lost some."""
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = cut_lineage(docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.sha2(text.cast("binary"), 256).alias("sha"), F.xxhash64(text).alias("text_hash"),
    ))
    long = (F.col("n_bytes") >= FLOOR) & F.col("doc_id").isNotNull()
    classes = cut_lineage(rows.where(long).groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash")))
    ranges = cut_lineage(removal_ranges(docs, rows, classes, id_col, text_col))
    by_doc = ranges.groupBy("doc_id").agg(F.collect_list("ranges").alias("ranges")).join(classes.select("doc_id", "sha"), "doc_id")
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.join(by_doc, "doc_id").where(F.sha2(F.col("text").cast("binary"), 256) == F.col("sha")).select("doc_id", "sha", "text", "ranges")
    cut = _cut(texts)
    if not with_kept:
        cut = cut.drop("kept")
    cut = cut.dropDuplicates(["doc_id", "sha"])
    done = rows.drop("text_hash").join(classes.select("sha", F.col("doc_id").alias("_first")), "sha", "left").join(cut, ["doc_id", "sha"], "left")
    again = F.coalesce(long & (F.col("doc_id") > F.col("_first")), F.lit(False))
    columns = [
        "doc_id", "n_bytes", F.when(again, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(again, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(again, F.lit(EMPTY_SHA256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    if with_kept:
        columns.append(F.when(again, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return done.select(*columns)
