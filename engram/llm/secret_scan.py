"""Secrets in texts: three fixed patterns, and sliding-window Shannon entropy with an allow list.

Candidate strings are long runs of the characters that keys are written in, without the UUIDs and
placeholders in them. In each, a window of fixed length slides over the strings of every character
class; the counts of its characters, and with them the sum of c * log2(c), are updated by the
character that leaves and the one that enters. A window whose entropy reaches the threshold of its
class is suspicious; suspicious windows merge into spans. Spans that are words or numbers are suppressed.

Defined results: a null or empty text has no spans; equal rows each get their own result; an empty
table gives an empty result; other columns are left alone. Places are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.arrow import map_arrow

#: Fixed patterns; group 2 of assign, and the whole match of the others, must have the least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "entropy")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Character classes: name, its strings, window, least entropy in bits of a window, least pieces of a window. Every class is asked;
#: those of 20 characters pass all but half a percent of random windows of their alphabet by entropy, and tell keys from words and
#: dates by how often the kind of character changes.
CLASSES = (
    ("hex", re.compile(r"(?<![A-Za-z0-9+/=_-])[0-9a-fA-F]{24,}(?![A-Za-z0-9+/=_-])"), 24, 3.2, 0),
    ("base64", re.compile(r"[A-Za-z0-9+/=_-]{24,}"), 24, 4.1, 0),
    ("short hex", re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{20,}(?![A-Za-z0-9])"), 20, 2.82, 4),
    ("lower and digits", re.compile(r"(?<![A-Za-z0-9])[a-z0-9]{20,}(?![A-Za-z0-9])"), 20, 3.34, 4),
    ("upper and digits", re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]{20,}(?![A-Za-z0-9])"), 20, 3.28, 2),
    ("letters", re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{20,}(?![A-Za-z0-9])"), 20, 3.52, 6),
    ("short base64", re.compile(r"[A-Za-z0-9+/=_-]{20,}"), 20, 3.58, 7),
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
#: A capitalised word, capitals or digits in a row.
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Parts of a candidate that are no secrets and end what stands beside them: UUIDs and placeholders.
PLAIN = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9])|(?i:example|placeholder|changeme|your[-_]?(?:api|key|token)|dummy|x{4,})")
#: Spans that are no secrets: words joined by signs and paths of words, unless of the class of letters; numbers.
WORDS, NUMBERS = re.compile(r"[A-Za-z_/=+-]*"), re.compile(r"[0-9_/=+-]*")
_LOG = [0.0, *(c * math.log2(c) for c in range(1, 65))]


def suspicious(text: str, window: int, least: float, pieces: int = 0) -> list[tuple[int, int]]:
    """Spans of text covered by windows with an entropy of at least ``least`` bits and at least so many pieces."""
    if len(text) < window:
        return []
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c) over the window's characters
    most = window * (math.log2(window) - least) + 1e-9
    spans: list[list[int]] = []
    for i, x in enumerate(text):
        c = counts.get(x, 0)
        total += _LOG[c + 1] - _LOG[c]
        counts[x] = c + 1
        if i >= window:
            y = text[i - window]
            c = counts[y]
            total += _LOG[c - 1] - _LOG[c]
            counts[y] = c - 1
        if i >= window - 1 and total <= most:
            a = i - window + 1
            if pieces and len(PIECE.findall(text, a, i + 1)) < pieces:
                continue
            if spans and a <= spans[-1][1]:
                spans[-1][1] = i + 1
            else:
                spans.append([a, i + 1])
    return [(a, b) for a, b in spans]


def parts_of(run: str) -> list[tuple[int, str]]:
    """What is left of a candidate between its plain parts, with places."""
    at, out = 0, []
    for m in PLAIN.finditer(run):
        out.append((at, run[at : m.start()]))
        at = m.end()
    return [*out, (at, run[at:])]


def entropy_spans(text: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        found = []
        for at, part in parts_of(m.group()):
            if NUMBERS.fullmatch(part):
                continue
            for name, members, window, least, pieces in CLASSES:
                for p in members.finditer(part):
                    for a, b in suspicious(p.group(), window, least, pieces):
                        if not NUMBERS.fullmatch(p.group(), a, b) and (name == "letters" or not WORDS.fullmatch(p.group(), a, b)):
                            found.append((m.start() + at + p.start() + a, m.start() + at + p.start() + b))
        last = -1
        for a, b in sorted(found):  # spans of several classes that overlap are one
            if a < last:
                out[-1] = (out[-1][0], max(last, b))
            else:
                out.append((a, b))
            last = out[-1][1]
    return out


def find_secrets(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind as its place in KINDS, end), in order."""
    text = text or ""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out += [(a, 3, b) for a, b in entropy_spans(text)]
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [find_secrets(x) for x in batch.column(1).to_pylist()]
        counts = [pa.array([sum(k == want for _, k, _ in spans) for spans in found], pa.int64()) for want in range(3)]
        base = [hashlib.sha256(written([s for s in spans if s[1] < 3]).encode()).hexdigest() for spans in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base, pa.string()), pa.array(list(map(written, found)), pa.string())], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    wanted = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return map_arrow(wanted, run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones together, replaced by a mark."""
    spans = find_secrets(text)
    if not spans:
        return text
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end:
            if end >= 0:
                at = end
            out += [text[at:a], mark]
        end = max(end, b)
        at = end
    return "".join(out) + text[end:]


def mask_secrets(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The same rows with secrets masked; where a text changed, its length column follows."""
    sized = size_col if size_col in docs.columns else None

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = batch.schema.get_field_index(text_col)
        before = batch.column(at).to_pylist()
        after = [masked(x) for x in before]
        columns = list(batch.columns)
        columns[at] = pa.array(after, batch.schema.field(at).type)
        if sized:
            k = batch.schema.get_field_index(sized)
            columns[k] = pa.array([n if y is x or y == x else len(y) for n, x, y in zip(batch.column(k).to_pylist(), before, after)], batch.schema.field(k).type)
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_arrow(docs, run, docs.schema)
