"""Secret scan: base patterns, and dictionary-primed zstandard novelty.

Every string that could be a secret is compressed by zstandard primed with a dictionary made of a
list of common identifiers and of the text around the string.  The *marginal* size is the compressed
size of context and candidate less that of the context alone.  A candidate in a sensitive context
whose marginal bytes are close to its own length tells nothing the code around it explains: it is
reported as a ``novel`` span.  The context goes on from a reported string to those that follow it
directly (next line, part after a dot) and over the lines of a private key.  Spans of the base patterns (``assign``, ``access``, ``hex``) are
always reported; a novel span never overlaps them: what they leave of a candidate is measured.

Defined results: null and empty texts have no spans and the hash of an empty list; texts are scanned
whole, in one pass; repeated rows give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base patterns; fixed values of the contract.  ASCII case folding only.
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs of 16 and more
KINDS = ("assign", "access", "hex", "novel")
#: Least lengths: of the assigned value, and of an access key.
ASSIGN_MIN, ACCESS_MIN = 12, 18

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(
    r"(?ai:key|secret|token|passw|pwd|auth|bearer|credential|private|signature|login|cert)")
#: Least length of a candidate.
LEAST = 16
#: What may stand between the lines or the parts of one secret: a line break or a dot, with blanks, quotes
#: and marks of comments or joined strings around.
_FILL = r"""[\x20\t"'\\,;>|*#]*"""
GAP = re.compile(rf"(?:(?<=[A-Za-z0-9+/_=.-]){_FILL}(?:\.|\r?\n|\r|\\)(?:{_FILL}(?:\r?\n|\+\x20))*{_FILL})\Z")
MOST_GAP = 64
#: A private key in lines, up to its end mark; its last line where that is shorter than a candidate.
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*KEY[A-Z ]*-----(?:(?!-----(?:BEGIN|END)).)*(?=-----END)", re.DOTALL)
KEY_TAIL = re.compile(r"(?:\r?\n|\\n)[\x20\t]*([A-Za-z0-9+/=]{1,15})(?=\s*(?:\\n)?-----END)")
#: Identifiers and words of source code that prime every dictionary.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key client_id "
    "client_secret authorization bearer credential username user login session cookie header "
    "connection string config configuration settings environment production development default "
    "example localhost https http www com org net json yaml xml import export return function class "
    "public static void const let var null true false self this abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 sha256 sha512 base64 encode decode request response "
    "certificate signature database timestamp checksum identifier").encode()


def marginal_bytes(candidate: bytes, before: bytes, after: bytes, level: int = 9) -> int:
    """Compressed bytes that ``candidate`` adds to its surroundings."""
    primer = zstandard.ZstdCompressionDict(
        IDENTIFIERS + b"\n" + before + b"\n" + after, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compress = zstandard.ZstdCompressor(
        level=level, dict_data=primer, write_content_size=False, write_checksum=False,
        write_dict_id=False).compress
    tail = before[-32:]
    return len(compress(tail + candidate)) - len(compress(tail))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, in order."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text)
             if m.end(1) - m.start(1) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= ACCESS_MIN]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    found.sort(key=lambda x: (x[0], x[2]))
    return found


def novel_spans(text: str, base: list[tuple[int, int, int]], around: int, context: int,
                least_ratio: float) -> list[tuple[int, int, int]]:
    """Candidates in a sensitive context that their surroundings don't explain."""
    taken: list[list[int]] = []  # what the base spans cover, in order
    for s, e, _ in base:
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(e, taken[-1][1])
        else:
            taken.append([s, e])
    # after these a secret may go on: base spans that name one, and every accepted candidate
    goes_on = {e for _, e, kind in base if kind != 2}
    names = {s for s, _, kind in base if kind == 0}
    keys = [m.span() for m in KEY_BLOCK.finditer(text)] if "-----BEGIN" in text else []
    found = []
    at = block = 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        while block < len(keys) and keys[block][1] <= s:
            block += 1
        inside = block < len(keys) and keys[block][0] <= s
        gap = GAP.search(text, max(0, s - MOST_GAP), s)
        if not (inside or gap and gap.start() in goes_on or SENSITIVE.search(text, max(0, s - context), s)):
            continue
        parts = []
        now, i = s, at
        while i < len(taken) and taken[i][0] < e:
            # what stands before an assignment is the rest of its name, unless it is a candidate itself
            if taken[i][0] > now and (taken[i][0] not in names or taken[i][0] - now >= LEAST):
                parts.append((now, taken[i][0]))
            now = max(now, taken[i][1])
            i += 1
        if now < e:
            parts.append((now, e))
        for a, b in parts:
            raw = text[a:b].encode()
            added = marginal_bytes(raw, text[max(0, a - around):a].encode("utf-8", "replace"),
                                   text[b:b + around].encode("utf-8", "replace"))
            if added >= least_ratio * len(raw):
                found.append((a, b, 3))
                goes_on.add(b)
        if e in goes_on:
            tail = KEY_TAIL.match(text, e)
            if tail:
                found.append((*tail.span(1), 3))
    return found


def scan_text(text: str | None, around: int = 1024, context: int = 48,
              least_ratio: float = 0.6) -> tuple[list, list]:
    """(base spans, all spans) of one text."""
    if not text:
        return [], []
    base = base_spans(text)
    spans = base + novel_spans(text, base, around, context, least_ratio)
    spans.sort(key=lambda x: (x[0], x[2]))
    return base, spans


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame, around: int = 1024, context: int = 48,
                 least_ratio: float = 0.6) -> DataFrame:
    """Spans of every document (doc_id, text): counts, hash of the base spans, all spans."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
        ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()),
        ("n_novel", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(t, around, context, least_ratio) for t in batch.column(1).to_pylist()]
            count = [[sum(k == n for _, _, k in spans) for _, spans in rows] for n in range(4)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *(pa.array(c, pa.int64()) for c in count[:3]),
                pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in rows], pa.string()),
                pa.array([joined(a) for _, a in rows], pa.string()), pa.array(count[3], pa.int64()),
            ], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
             "spans string, n_novel long")


def redact_text(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every span replaced by ``mark``; overlapping spans as one."""
    _, spans = scan_text(text)
    if not spans:
        return text
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """Documents with their secrets replaced; columns stay, and ``n_chars`` follows the text."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact_text(t, mark) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                i = names.index("n_chars")
                columns[i] = pa.array([None if t is None else len(t) for t in texts], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
