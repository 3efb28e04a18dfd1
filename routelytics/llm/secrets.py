"""Secret scans: all rules in one automaton, one pass over the bytes of a text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Rule, Scanner

#: The base rules.  ``hex`` is stated with its least length: its matches are maximal runs
#: either way, and runs that are too short are dropped.  For ``assign`` the least length is
#: of the value and is tested behind the search, since a dropped match still uses up its text.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         min_length=6, group=2, ignore_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", min_length=20),
    Rule("hex", r"[0-9a-f]{24,}", min_length=24),
]
#: What the base rules miss: tokens with a public prefix and private keys.
EXTRA = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", min_length=40),
    Rule("google", r"AIza[0-9A-Za-z_-]+", min_length=39),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]+", min_length=15),
    Rule("stripe", r"[sr]k_(live|test)_[0-9A-Za-z]+", min_length=24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_spans(scanner: Scanner, text: str) -> list[tuple[int, int, int]]:
    """(rule, start, end) in code points by start, then rule; failing matches dropped."""
    data, out = text.encode("utf-8", "surrogatepass"), []
    plain, seen, points = len(data) == len(text), 0, 0
    found = sorted(scanner.spans(data), key=lambda x: (x[1], x[0]))
    for r, a, b in found:
        rule = scanner.rules[r]
        size = b - a
        if rule.group:
            m = re.match(rule.pattern, data[a:b].decode("ascii"), re.IGNORECASE if rule.ignore_case else 0)
            size = len(m[rule.group])
        if size < rule.min_length:
            continue
        if not plain:  # matches are ASCII: only what stands before them counts bytes and characters apart
            points += len(data[seen:a].decode("utf-8", "surrogatepass"))
            seen, a, b = a, points, points + b - a
        out.append((r, a, b))
    return out


def find_secrets(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text",
                 id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``id_col`` and secrets, an array of (kind, start, end)
    in code points, end exclusive, by start and then the order of ``rules`` (default:
    ``BASE`` and ``EXTRA``).  Spans of different kinds may overlap.

    Null and empty texts have none; texts are scanned whole.  Null and repeated ids and
    repeated rows each give a row; extra columns are ignored; an empty table gives an
    empty result.
    """
    scanner = Scanner(rules or BASE + EXTRA)
    names = [r.name for r in scanner.rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"kind": names[r], "start": x, "end": y} for r, x, y in find_spans(scanner, t.as_py())]
                     if t.is_valid else [] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(spans, _SPAN_TYPE)], [id_col, "secrets"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, secrets {SPANS}")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by ``[kind]``; of overlapping spans the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def digest(spans) -> str:
    """SHA-256 of ``kind:start:end`` joined by commas."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
