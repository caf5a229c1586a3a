"""Secret scans: fixed patterns, and strings near sensitive words that a dictionary-primed compressor finds new."""

from __future__ import annotations

import bisect
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import annotate, plain

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "novel")
# Fixed patterns; the first runs over lowered bytes, where offsets stay.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")  # runs are as long as they can be, so shorter ones can go at once
_HINTS = (b"passw", b"secret", b"token", b"api")
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18

#: Words near which an incompressible string is reported.
SENSITIVE = (b"auth", b"bearer", b"credential", b"passphrase", b"passwd", b"password", b"private", b"pwd", b"secret", b"signature", b"token", b"apikey", b"api_key", b"api-key", b"access_key")
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
#: What may stand between candidates that go on one another: parts of a token, lines of a key, pieces of a string put together.
_JOINT = re.compile(rb"""(?:[.\s"'+,]|\\[rn]){1,8}""")
#: A candidate is at most so many bytes from a sensitive word; so much text around it primes the compressor.
REACH, BEFORE, AFTER = 48, 256, 64
#: Marginal compressed bytes for a byte of the candidate from which it counts as new.
NOVELTY = 0.7
#: Identifiers and code that prime the compressor.
PRIMER = b"""import from return function class public private protected static const void int float double string boolean true false null none self this
def async await for while if else switch case break continue try catch finally raise except with lambda yield print println printf format
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 abcdef0123456789 00000000000000000000000000000000 ffffffffffffffff xxxxxxxxxxxxxxxx
username password passwd secret token api_key apikey access_key private_key public_key client_id client_secret authorization bearer basic
example placeholder changeme your-token-here your_api_key_here YOUR_SECRET_KEY INSERT_TOKEN_HERE REPLACE_ME dummy test sample default
http:// https:// www. .com .org .net .html .json .yaml .xml application/json content-type user-agent localhost 127.0.0.1 config settings environment
get_value set_value to_string from_string read_file write_file open close connect request response message error warning status code data
the and for with that this from have not are was were will would there their which about into could other than then these some"""


@lru_cache(maxsize=1)
def _compressor():
    import zstandard

    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)


def novelty(before: bytes, candidate: bytes, after: bytes) -> float:
    """Compressed bytes that the candidate adds to its surroundings, for each of its bytes."""
    z = _compressor()
    return (len(z.compress(before + after + candidate)) - len(z.compress(before + after))) / len(candidate)


def find_spans(raw: bytes, threshold: float = NOVELTY) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in bytes, by start and kind."""
    low = raw.lower()  # ASCII letters only, as these are bytes
    spans = []
    if any(h in low for h in _HINTS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(low) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if b"AKIA" in raw:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= ACCESS_LENGTH]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(raw)]
    near = []
    for word in SENSITIVE:
        at = low.find(word)
        while at >= 0:
            near.append((at, at + len(word)))
            at = low.find(word, at + 1)
    if near:
        covered, last = _union([(a, b) for a, _, b in spans]), -1
        for a, b in _candidates(raw, near):
            at = bisect.bisect_right(covered, (a, b))
            clear = (not at or covered[at - 1][1] <= a) and (at == len(covered) or covered[at][0] >= b)
            # of candidates that overlap (one begun inside another), the longer stays
            if clear and a >= last and novelty(raw[max(0, a - BEFORE) : a], raw[a:b], raw[b : b + AFTER]) >= threshold:
                spans.append((a, 3, b))
                last = b
    return sorted(spans)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal stretches that spans cover, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _candidates(raw: bytes, near: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs with a letter and a digit near sensitive words, before or after them, those that go on such a run over joints, and what follows a
    word within a run; by start, and longer ones first."""
    mixed = lambda a, b: re.search(rb"[0-9]", raw[a:b]) and re.search(rb"[A-Za-z]", raw[a:b])
    runs = [m.span() for m in _CANDIDATE.finditer(raw) if mixed(*m.span())]
    starts = [a for a, _ in runs]
    chosen, inside = [False] * len(runs), set()
    for s, e in near:
        i = bisect.bisect_left(starts, e)
        if i and runs[i - 1][1] > e:  # the word stands in a run, or its end does
            a, b = e, runs[i - 1][1]
            if b - a >= 16 and mixed(a, b):
                inside.add((a, b))
        while i < len(runs) and runs[i][0] <= e + REACH:
            chosen[i] = True
            i += 1
        i = bisect.bisect_left(starts, s) - 1
        while i >= 0 and runs[i][1] >= s - REACH:
            if runs[i][1] <= s:
                chosen[i] = True
            i -= 1
    for order in (range(1, len(runs)), range(len(runs) - 2, -1, -1)):
        for i in order:
            j = i + (-1 if order.step > 0 else 1)
            if chosen[j] and not chosen[i] and _JOINT.fullmatch(raw, runs[min(i, j)][1], runs[max(i, j)][0]):
                chosen[i] = True
    return sorted(inside.union(r for r, c in zip(runs, chosen, strict=True) if c), key=lambda r: (r[0], -r[1]))


def _code_points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if raw.isascii():
        return spans
    ends = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    at = lambda i: int(ends[i - 1]) if i else 0
    return [(at(a), k, at(b)) for a, k, b in spans]


def scan_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = NOVELTY) -> DataFrame:
    """`keep` columns (all) with secrets: array<struct<kind, start, end>> in code points, by start and then kind as in KINDS.

    assign, access and hex are fixed patterns, leftmost and non-overlapping within a kind. novel: runs of 16 or more of A-Za-z0-9+/_=- with
    a letter and a digit that stand within REACH bytes of a word of SENSITIVE, before or after it, or go on such a run (lines of a key, parts
    of a token), overlap no span of the other kinds, and add at least `threshold` compressed bytes for each of their own to the surroundings
    under the primed compressor. Null and empty texts have none; long ones are scanned whole.
    Rows are independent, so repeated rows, empty tables and any other columns are no special cases.
    """
    def compute(data, offsets):
        raw = data.tobytes()
        rows = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            one = raw[a:b]
            found = find_spans(one, threshold)
            rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in _code_points(one, found)] if found else [])
        return [pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]

    return annotate(docs, compute, "secrets array<struct<kind:string,start:bigint,end:bigint>>", text, keep)


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", mask: str = "[SECRET]", threshold: float = NOVELTY) -> DataFrame:
    """docs with each stretch of text that spans cover replaced by `mask`, and n_chars, if docs has it, counted anew; all else stays.

    Null texts come out empty; empty ones stay so, and long ones are scanned whole. Rows are independent, so repeated rows are treated alike and
    an empty table gives no rows. Other columns stay as they are, whatever their names and types.
    """
    cover = mask.encode()
    names = docs.columns
    docs, (text, n_chars) = plain(docs, text, n_chars)

    def compute(data, offsets):
        raw = data.tobytes()
        out, changed = [], False
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            one = raw[a:b]
            if spans := find_spans(one, threshold):
                changed, parts, at = True, [], 0
                for s, _, e in spans:
                    if s >= at:
                        parts += [one[at:s], cover]
                    at = max(at, e)
                one = b"".join([*parts, one[at:]])
            out.append(one)
        if not changed:
            return [pa.Array.from_buffers(pa.string(), len(out), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
        return [pa.Array.from_buffers(pa.string(), len(out), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(out))])]

    keep = [c for c in docs.columns if c != text]
    clean = annotate(docs, compute, f"{text} string", text, keep)
    fresh = {n_chars: F.length(text).cast(docs.schema[n_chars].dataType)} if n_chars else {}
    return clean.select(*[fresh.get(c, F.col(c)).alias(c) for c in docs.columns]).toDF(*names)
