"""Secrets in text: fixed patterns, and strings that a primed compressor finds new.

Base findings come from three patterns (``assign``, ``access``, ``hex``). The novelty method adds ``novel`` findings: a run of
token characters in a sensitive context (a word such as "credential" before it in the line or in the line above, and on through
the lines of a block or of a wrapped run) is compressed by zstandard twice, with a dictionary of the surrounding text and of identifiers: once the context alone, once with the run
behind it. The extra bytes it costs are its novelty, compared with its length and with what a random string over its alphabet
would cost. Words and names seen nearby cost little; random keys cost nearly all their bytes and are reported. Long runs are
judged in consecutive windows and reported whole if one of them is new. Copies of the run itself do not prime the compressor, a distinct run is
judged once per text, and a run that is new is reported at every place where it stands.

Defined results: a null text counts as empty and has no findings; ids and repeated rows are kept as they are; an empty
table gives an empty table; other columns are not read. Texts are scanned whole; a window around one candidate is the only
part a step compresses, so cost follows the text length. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from framelake.llm import common

#: Order of kinds where two findings start at one place.
KINDS = ("assign", "access", "hex", "novel")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run starts where the leftmost match starts
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that make a context sensitive.
SENSITIVE = ("credential", "auth", "bearer", "private", "secret", "token", "passw", "pwd", "key", "signature", "access", "cookie", "session")
SENSITIVE_WORD = re.compile("|".join(SENSITIVE), re.ASCII | re.IGNORECASE)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Characters around a run that stands alone in its line, and such a line.
EDGES = " \t\r\n\"'`,;|>\\+#*-"
BARE_LINE = re.compile(r"""[\x20\t"'`|>#*-]*+([A-Za-z0-9+/_=.-]++)[\x20\t\r"'`,;\\]*+(?:\+\s*+)?$""")
#: Four or more times the same in a row.
PERIODIC = re.compile(r"(.{1,16}?)\1{3,}+")
TOKENS = re.compile(r"[A-Za-z0-9+/_=-]{13,}")
#: First characters by which a reported run is looked up elsewhere; no reported run without padding is shorter.
HEAD = 13
#: Line widths of common encoders.
WRAPPED = (60, 64, 72, 76)
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,}")

#: Identifiers that code and configuration files share.
IDENTIFIERS = """abstract access_key address admin api_key api_secret append application args array async auth_token authorization
await backend base64 bearer boolean bucket buffer bytes callback certificate class client_id client_secret close config
connection const constructor content context cookie create credential database datetime debug decode default delete
description digest dictionary document domain double encode encoding encrypt endpoint environment error event exception
export extends false fetch file filename final float format function generate getElementById handler hash header headers
hostname http https identifier implements import include index initialize input insert instance integer interface
isinstance iterator javascript json label lambda length license list localhost logger login manager message method module
namespace network null number object observer option output override package parameter params parse password path pattern
payload permission placeholder plugin port prefix private_key process production protected provider public public_key
python query random read redirect refresh_token region register request response result return role schema secret_key
select self server service session session_id settings signature simple socket source static status string struct
subprocess super switch template test testing this throw timeout timestamp token true type undefined update upload
username utf-8 value variable version void volume warning webhook width window write your_api_key_here xxxxxxxx example
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 changeme replace_me"""


@dataclass(frozen=True)
class Novelty:
    """How the novelty method decides."""

    window: int = 512  #: characters of surrounding text on either side that prime the dictionary
    bytes_per_char: float = 0.72  #: marginal compressed bytes per character that always suffice
    share: float = 1.02  #: for 64 characters and more, share of a random string's bytes that suffices together with ``table``
    table: float = 8.0  #: bytes of a code table
    span: int = 256  #: characters of a run that are judged together
    level: int = 9


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the pattern findings."""
    out = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def _mixed(run: str) -> bool:
    """Digits and letters together, as keys have and words do not."""
    return any(c.isdigit() for c in run) and any(c.isalpha() for c in run)


def marginal_bytes(run: str, before: str, after: str, level: int) -> int:
    """Compressed bytes that ``run`` adds to ``before`` when both sides and the identifier list prime the compressor."""
    import zstandard

    primer = zstandard.ZstdCompressionDict(f"{IDENTIFIERS}\n{after}\n{before}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    tool = zstandard.ZstdCompressor(level=level, dict_data=primer, write_checksum=False, write_content_size=False)
    tail = before[-64:].encode()
    return len(tool.compress(tail + run.encode())) - len(tool.compress(tail))


def sensitive_stretches(text: str) -> Iterator[tuple[int, int]]:
    """``(start, end)`` of what sensitive words cover, at most one stretch a line.

    A word covers the rest of its line and the next line that is not blank; from there on, and from any line after it, a line that
    is nothing but one run covers the next such line. An armored block (``-----BEGIN``) is covered up to its end.
    """
    start, follows, armored = 0, False, -1
    while start < len(text):
        stop = text.find("\n", start)
        stop = len(text) if stop < 0 else stop
        word = SENSITIVE_WORD.search(text, start, stop)
        bare = BARE_LINE.match(text, start, stop)
        if follows or start < armored:
            yield start, stop
        elif word:
            yield word.end(), stop
        if word and text.find("-----BEGIN", start, stop) >= 0:
            armored = max(armored, text.find("-----END", stop))
        if word or text[start:stop].strip():  # blank lines change nothing
            follows = bool(word) or (follows and bare is not None and len(bare[1]) >= 16)
        start = stop + 1


def _views(run: str) -> Iterator[list[tuple[int, int]]]:
    """Parts of a run that may be keys, best first: what ``=`` parts, all of it, what follows the last sensitive word."""
    parts = [m.span() for m in re.finditer("[^=]+=*", run)]
    yield [(a, b) for a, b in parts if b - a >= 15]
    if len(parts) > 1:
        yield [(parts[0][0], len(run))]
    word = max((m.end() for m in SENSITIVE_WORD.finditer(run)), default=len(run))
    yield [(word, len(run))] if len(run) - word >= 15 else []


def _open_parts(run: re.Match, covered: list[tuple[int, int, str]], at: int) -> list[tuple[int, int]]:
    """Parts of a run that no pattern finding from ``covered[at]`` on covers."""
    out, reach = [], run.start()
    while at < len(covered) and covered[at][0] < run.end():
        out.append((reach - run.start(), covered[at][0] - run.start()))
        reach = max(reach, covered[at][1])
        at += 1
    out.append((reach - run.start(), run.end() - run.start()))
    return [(a, b) for a, b in out if b - a >= 15]


def novel_spans(text: str, taken: list[tuple[int, int, str]], law: Novelty) -> list[tuple[int, int, str]]:
    """Runs in a sensitive context that stay large when compressed against what surrounds them."""
    low = text.lower()
    if not any(w in low for w in SENSITIVE):
        return []
    out, covered = [], sorted(taken)
    verdicts: dict[str, bool] = {}
    at = 0
    wrapped = (-1, 0, False)  # where the last reported run ends, its width, whether more of it follows for sure
    for start, stop in sensitive_stretches(text):
        for m in CANDIDATE.finditer(text, start, stop):
            while at < len(covered) and covered[at][1] <= m.start():
                at += 1
            if not _mixed(m[0]):
                continue
            over = at < len(covered) and covered[at][0] < m.end()
            for parts in [_open_parts(m, covered, at)] if over else _views(m[0]):
                new = []
                for a, b in parts:
                    shown = m[0][a:b]
                    if shown not in verdicts:
                        verdicts[shown] = _mixed(shown) and is_new(text, m.start() + a, m.start() + b, law)
                    if verdicts[shown]:
                        new.append((m.start() + a, m.start() + b, "novel"))
                if new:
                    out += [(m.start(), m.end(), "novel")] if over else new
                    break
        bare = BARE_LINE.match(text, start, stop)
        if bare and wrapped[0] >= 0 and not text[wrapped[0] : bare.start(1)].strip(EDGES) and not (out and out[-1][1] > bare.start(1)):
            # The rest of a run wrapped over lines: too short or too plain to be judged by itself.
            short = bare.end(1) - bare.start(1)
            if short <= wrapped[1] and (wrapped[2] or bare[1].endswith("=") or _mixed(bare[1])) and not _touches(covered, bare.start(1), bare.end(1)):
                out.append((bare.start(1), bare.end(1), "novel"))
        if out and not text[out[-1][1] : stop].strip(EDGES) and out[-1][1] > start:
            width = out[-1][1] - out[-1][0]
            wrapped = (out[-1][1], width, width == wrapped[1] and wrapped[0] >= 0 or width in WRAPPED)
        else:
            wrapped = (-1, 0, False)
    return out + other_places(text, [s for s, yes in verdicts.items() if yes], covered, out)


def other_places(text: str, found: list[str], taken: list[tuple[int, int, str]], novel: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Where else in ``text`` the ``found`` runs stand, sensitive context or not, and without their padding too."""
    strings = {s.rstrip("=") for s in found}
    known: dict[str, set[int]] = {}
    for s in strings:
        known.setdefault(s[:HEAD], set()).add(-len(s))
    if not known:
        return []
    sizes = {head: sorted(n) for head, n in known.items()}  # longest first
    out, novel, at = [], sorted(novel), 0
    for m in TOKENS.finditer(text):
        k = m.start()
        while k <= m.end() - HEAD:
            stop = next((k - n for n in sizes.get(text[k : k + HEAD], ()) if text[k : k - n] in strings), None)
            if stop is None:
                k += 1
                continue
            while at < len(novel) and novel[at][1] <= k:
                at += 1
            if not (at < len(novel) and novel[at][0] < stop) and not _touches(taken, k, stop):
                out.append((k, stop, "novel"))
            k = stop
    return out


def _touches(spans: list[tuple[int, int, str]], start: int, end: int) -> bool:
    """Whether ``start, end`` meets one of the ordered spans."""
    k = bisect.bisect_left(spans, (end,))
    return any(e > start for _, e, _ in spans[max(0, k - 3) : k])


def _without(text: str, start: int, end: int, copies: list[str]) -> str:
    """``text[start:end]`` without what belongs to a copy of one of the strings, even if the copy crosses an end."""
    gone = []
    for s in copies:
        at = text.find(s, max(0, start - len(s) + 1), end + len(s) - 1)
        while at >= 0:
            gone.append((at, at + len(s)))
            at = text.find(s, at + len(s), end + len(s) - 1)
    kept = []
    for a, b in sorted(gone):
        if a > start:
            kept.append(text[start:a])
        start = max(start, b)
    return "".join([*kept, text[start:end]])


def random_bytes(run: str) -> float:
    """Least bytes that the compressor needs for a random string of the length and alphabet of ``run``.

    Up to 63 characters are stored as they are. Longer ones are entropy coded with a table: over few characters what these take, over
    many what the kinds of characters take, since words use a large alphabet unevenly and keys use it evenly.
    """
    if len(run) < 64:
        return float(len(run))
    size = len(set(run))
    if size > 24:
        kinds = (str.islower, 26), (str.isupper, 26), (str.isdigit, 10)
        size = sum(n for has, n in kinds if any(map(has, run))) + len({c for c in run if not c.isalnum()})
    return len(run) * math.log2(max(size, 2)) / 8


def _windows(run: str, span: int) -> Iterator[tuple[int, int]]:
    """Consecutive stretches of a run without what repeats itself; the last of a piece reaches back to be full."""
    edges = [0, *(x for m in PERIODIC.finditer(run) if m.end() - m.start() >= 16 for x in m.span()), len(run)]
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        for k in range(a, b, span):
            end = min(k + span, b)
            k = max(a, end - span)
            if end - k >= 15:
                yield k, end


def is_new(text: str, start: int, end: int, law: Novelty) -> bool:
    """Whether a run, or any window of it, costs as much as a key does next to what surrounds it but for its own copies."""
    run = text[start:end]
    copies = [run, *(p for p in run.split("=") if 15 <= len(p) < len(run))]
    for a, b in _windows(run, law.span):
        before = _without(text, max(0, start + a - law.window), start + a, copies) if a < law.window else run[a - law.window : a]
        after = _without(text, start + b, min(len(text), start + b + law.window), copies) if len(run) - b < law.window else ""
        n = b - a
        if not _mixed(run[a:b]):
            continue
        least = law.bytes_per_char * n
        if n >= 64:
            least = min(least, law.share * random_bytes(run[a:b]) + law.table)
        if marginal_bytes(run[a:b], before, after, law.level) >= least:
            return True
    return False


def find_secrets(text: str | None, law: Novelty = Novelty()) -> list[tuple[int, int, str]]:
    """All findings of one text by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    found = base + novel_spans(text, base, law)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with every maximal covered stretch replaced by ``[secret]``."""
    if not text or not spans:
        return text
    parts, at, reach = [], 0, 0
    for s, e, _ in sorted(spans):
        if s >= reach:
            parts += [text[at:s] if s > at else "", "[secret]"]
        reach = at = max(reach, e)
    return "".join(parts) + text[at:]


def scan_secrets(docs: DataFrame, law: Novelty = Novelty(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans`` of every row."""

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digest, shown = [], []
        for text in part.column("_text").to_pylist():
            spans = find_secrets(text, law)
            for k in KINDS:
                counts[k].append(sum(s[2] == k for s in spans))
            digest.append(hashlib.sha256(_joined([s for s in spans if s[2] != "novel"]).encode()).hexdigest())
            shown.append(_joined(spans))
        names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
        return common.batch([part.column("doc_id"), *counts.values(), digest, shown], names, [*[pa.int64()] * 5, pa.string(), pa.string()])

    slim = common.only(docs, {"doc_id": id_col, "_text": text_col})
    schema = "doc_id BIGINT, n_assign BIGINT, n_access BIGINT, n_hex BIGINT, n_novel BIGINT, base_sha256 STRING, spans STRING"
    return common.over_texts(slim, "_text", schema, step)


def redact_secrets(docs: DataFrame, law: Novelty = Novelty(), text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with findings masked in ``text_col`` and ``length_col`` (if present) counting the new text's code points."""

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        text = [redacted(t, find_secrets(t, law)) for t in part.column(text_col).to_pylist()]
        columns = {n: part.column(n) for n in part.schema.names}
        columns[text_col] = pa.array(text, part.schema.field(text_col).type)
        if length_col in columns:
            kind = part.schema.field(length_col).type
            columns[length_col] = pa.array([None if t is None else len(t) for t in text], pa.int64()).cast(kind)
        return pa.RecordBatch.from_arrays(list(columns.values()), schema=part.schema)

    return common.over_texts(docs, text_col, docs.schema, step)
