"""Token counts of whole texts, huge documents in overlapping chunks.

A huge document is cut into chunks that overlap, the chunks are spread over all tasks and
each is encoded on its own, with offsets.  Two neighbours are spliced where both begin a
new unit of the pre-tokenizer at the same character of their overlap: its scan looks only
ahead, so from such a boundary on both see the same text and give the same tokens.  What
stands too near a chunk's end, where text that is cut off could still matter, is no
boundary.  Where an overlap has no common boundary (one unit is longer than the overlap),
the document is cut again with chunks and overlaps four times as wide, in the end whole.

That the scan only looks ahead, and how far, is read off the tokenizer's own file
(``splittable``); other tokenizers encode whole texts.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, byte_letters, partitions

#: Characters of a chunk and of the overlap of two, at first; bytes encoded at a time.
CHUNK, OVERLAP, STRETCH = 16_384, 256, 1 << 20
#: Units whose token counts a worker remembers (about 150 bytes each).
CACHE_UNITS = 600_000
WIDER = 4


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def splittable(tokenizer_json: str) -> int:
    """How many characters after a unit's end its extent can depend on, if the tokenizer is
    known to look only ahead: bytes, no normaliser, the byte-level pattern (a contraction
    is up to 3 characters, a run of white space keeps its last one for the next word) and
    special strings that are matched as they stand, and offsets that are not trimmed.
    0: not known."""
    t = json.loads(tokenizer_json)
    pre, model = t.get("pre_tokenizer") or {}, t.get("model") or {}
    added = t.get("added_tokens") or []
    plain = all(not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]) and not re.search(r"\s", a["content"])
                for a in added)
    known = (t.get("normalizer") is None and t.get("post_processor") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
             and not pre.get("add_prefix_space", True) and model.get("type") == "BPE" and not model.get("dropout") and plain)
    return max([4, *(len(a["content"]) + 1 for a in added)]) if known else 0


#: Characters that Python's and the tokenizer's character classes surely take alike: ASCII
#: without the separators 1C to 1F, and Latin letters.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af"
PLAIN = re.compile(f"[\\x00-\\x1b\\x20-\\x7f{LETTERS}]*")
#: The byte-level pre-tokenizer's pattern (fixed) over those characters.
UNITS = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{LETTERS}]+| ?[0-9]+| ?[^\\s0-9{LETTERS}]+|\\s+(?!\\S)|\\s+")


class Counter:
    """Token counts of texts as one tokenizer file gives them, without added tokens."""

    def __init__(self, path_or_json: str, kind: str):
        if kind == "model":
            import sentencepiece
            self.pieces, self.margin = sentencepiece.SentencePieceProcessor(model_file=path_or_json), 0
            return
        from tokenizers import Tokenizer
        self.pieces, self.tokenizer, self.margin = None, Tokenizer.from_str(path_or_json), splittable(path_or_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        # a space before a visible character begins a unit, whatever stands before it (but
        # white space before a special string is a unit of its own)
        no = "".join(f"(?!{re.escape(x)})" for x in self.special)
        self.at = re.compile(rf" (?=\S){no}").split
        self.known: dict[str, int] = {}   # by unit, without its space
        self.parts: dict[str, int] = {}   # by what the pre-tokenizer makes of a unit

    def _whole(self, texts: list[str]) -> list[int]:
        if self.pieces is not None:
            return [len(x) for x in self.pieces.encode(texts, num_threads=1)] if texts else []
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> None:
        """Put the units in ``known``: plain ones by way of their parts and the
        tokenizer's model, the others through the whole tokenizer."""
        known, parts, whole, model = self.known, self.parts, [], self.tokenizer.model.tokenize
        for u in units:
            if not PLAIN.fullmatch(u) or any(x in u for x in self.special):
                whole.append(u)
                continue
            n = 0
            for x in UNITS.findall(" " + u):
                k = parts.get(x)
                if k is None:
                    k = parts[x] = len(model(x.encode().decode("latin-1").translate(self.letters)))
                n += k
            known[u] = n
        for i in range(0, len(whole), 4096):
            some = whole[i:i + 4096]
            known.update(zip(some, self._whole([" " + u for u in some])))

    def _split(self, texts: list[str]) -> tuple[list[int], list[list[str]]]:
        """Tokens before each text's first unit, and its units, which are then known."""
        if len(self.known) + len(self.parts) > CACHE_UNITS:
            self.known.clear()
            self.parts.clear()
        split = [self.at(t) for t in texts]
        first = self._whole([p[0] for p in split])
        units = [p[1:] for p in split]
        self._learn(list(set().union(*units).difference(self.known)))
        return first, units

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if not self.margin:
            return self._whole(texts)
        known = self.known
        return [n + sum(map(known.__getitem__, u)) for n, u in zip(*self._split(texts))]

    def edges(self, chunks: list[str], overlap: int, starts: list[int]) -> list[tuple[int, list, list]]:
        """Of each chunk, its tokens, and (character of the document, tokens of the chunk
        before it) for the boundaries of units in its first and last ``overlap`` characters."""
        out = []
        for body, start, before, units in zip(chunks, starts, *self._split(chunks)):
            counts = list(map(self.known.__getitem__, units))
            total, last = before + sum(counts), len(body) - self.margin
            at, n = len(body) - sum(map(len, units)) - len(units), before
            head, tail = [(start, 0)], []
            for u, k in zip(units, counts):
                if at > overlap:
                    break
                head.append((start + at, n))
                at, n = at + 1 + len(u), n + k
            at, n = len(body), total
            for u, k in zip(reversed(units), reversed(counts)):
                at, n = at - 1 - len(u), n - k
                if at < len(body) - overlap:
                    break
                if at <= last:
                    tail.append((start + at, n))
            if not tail or len(head) < 2:  # no such unit in the overlap: all boundaries there are
                out.append(self._fine(body, overlap, start))
            else:
                out.append((total, head, tail))
        return out

    def _fine(self, body: str, overlap: int, start: int) -> tuple[int, list, list]:
        """``edges`` of one chunk by the tokenizer's own offsets and unit numbers."""
        e = self.tokenizer.encode(body, add_special_tokens=False)
        words, offsets, n = e.word_ids, e.offsets, len(e.ids)
        last = len(body) - self.margin
        begins = lambda i: words[i] != words[i - 1] and offsets[i - 1][1] <= offsets[i][0]
        head, tail, i = [], [], 0
        while i < n and offsets[i][0] <= overlap:
            if i == 0 or begins(i):
                head.append((start + offsets[i][0], i))
            i += 1
        i = n - 1
        while i > 0 and offsets[i][0] >= len(body) - overlap:
            if begins(i) and offsets[i][0] <= last:
                tail.append((start + offsets[i][0], i))
            i -= 1
        return n, head, tail


def _worker(text: str, kind: str) -> Counter:
    """The process's own instance: workers serve many tasks."""
    store = sys.modules["pyarrow"].__dict__.setdefault("_token_counters", {})
    key = hash((text, kind))
    if key not in store:
        store[key] = Counter(text, kind)
    return store[key]


COUNTED = "n_tokens long, _doc long, _k int, _last boolean, _start long, _body string"
EDGES = "array<struct<at:long,n:long>>"


def _cuts(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text: neighbours share ``overlap`` characters."""
    step = chunk - overlap
    starts = range(0, max(1, length - overlap), step)
    return [(a, min(length, a + chunk)) for a in starts]


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``id_col``, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of
    every row of ``docs``, from the tokenizer file ``tokenizer_path`` (.json, or .model of
    SentencePiece): whole texts, no added tokens, special strings in a text as the library
    takes them by default.

    Null and empty texts have no bytes and no tokens.  Null and repeated ids and repeated
    rows are counted as they come, one row each.  Extra columns are ignored; an empty table
    gives an empty result.  A text of more than ``chunk`` characters is encoded in chunks,
    as many tasks as there are; no task holds more than ``chunk`` characters of it unless a
    single unit is longer.
    """
    if not 0 < 4 * overlap <= chunk:
        raise ValueError("a chunk must hold four overlaps")
    spark = docs.sparkSession
    path = tokenizer_path or default_tokenizer()
    kind = "model" if path.endswith(".model") else "json"
    if kind == "json":
        text = Path(path).read_text()
        huge = splittable(text) > 0
    else:  # SentencePiece reads its own file, which workers find where the driver does
        text, huge = path, False
    model = spark.sparkContext.broadcast(text)
    s = Scratch(spark, "token-counts")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, row = _worker(model.value, kind), TaskContext.get().partitionId() << 40
        for b in batches:
            texts = b.column(0).to_pylist()
            ids = b.column(1)
            at, n, doc, k, last, start, body = [], [], [], [], [], [], []
            short, size = [], 0

            def flush():
                n.extend(c.count([texts[i] or "" for i in short]))
                at.extend(short)
                for col in (doc, k, last, start, body):
                    col.extend([None] * len(short))
            for i, t in enumerate(texts):
                row += 1
                if huge and t and len(t) > chunk:
                    cuts = _cuts(len(t), chunk, overlap)
                    for j, (a, z) in enumerate(cuts):
                        at.append(i)
                        n.append(None)
                        doc.append(row)
                        k.append(j)
                        last.append(j == len(cuts) - 1)
                        start.append(a)
                        body.append(t[a:z])
                else:
                    short.append(i)
                    size += len(t or "")
                    if size > STRETCH:
                        flush()
                        short, size = [], 0
            flush()
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), b.column(2).take(take), pa.array(n, pa.int64()), pa.array(doc, pa.int64()), pa.array(k, pa.int32()),
                 pa.array(last, pa.bool_()), pa.array(start, pa.int64()), pa.array(body, pa.string())],
                ["id", "n_bytes", "n_tokens", "_doc", "_k", "_last", "_start", "_body"])

    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(text_col).alias("t"), F.col(id_col).alias("id"),
                      F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    rows = s.table(src.mapInArrow(first, f"id {id_type}, n_bytes long, {COUNTED}"), "counted")
    done = rows.filter("_doc IS NULL").select("id", "n_bytes", "n_tokens")
    open_ = rows.filter("_doc IS NOT NULL")
    wide, lap = chunk, overlap
    while huge and not open_.isEmpty():
        seams = s.table(_seams(open_, model, lap), "seams")
        bad = seams.filter("_doc IS NOT NULL AND NOT ok").select("_doc").distinct()
        sums = seams.groupBy("_doc").agg(F.bool_and("ok").alias("ok"), F.sum("tokens").alias("n_tokens"),
                                         F.max(F.when(F.col("_k") == 0, F.struct("id", "n_bytes"))).alias("d"))
        done = done.unionByName(sums.filter("ok").select("d.id", "d.n_bytes", "n_tokens"))
        wide, lap = wide * WIDER, lap * WIDER
        open_ = s.table(_widened(open_.join(bad, "_doc"), wide, lap), "wider")
    return done.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _seams(chunks: DataFrame, model, overlap: int) -> DataFrame:
    """Every chunk with the tokens that count for it: its own, less those after its splice
    with the next chunk and those before its splice with the previous one.  ok: both found."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _worker(model.value, "json")
        for b in batches:
            bodies, starts = b.column("_body").to_pylist(), b.column("_start").to_pylist()
            some = max(1, STRETCH // max(1, max(map(len, bodies), default=1)))
            got = [x for i in range(0, len(bodies), some) for x in c.edges(bodies[i:i + some], overlap, starts[i:i + some])]
            edge = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
            names = ["id", "n_bytes", "_doc", "_k", "_last"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(x) for x in names), pa.array([x[0] for x in got], pa.int64()),
                 *(pa.array([[{"at": p, "n": n} for p, n in x[i]] for x in got], edge) for i in (1, 2))],
                [*names, "n", "head", "tail"])
    kind = chunks.schema["id"].dataType.simpleString()
    # chunks of one document go to many tasks
    spread = chunks.repartition(partitions(chunks.sparkSession), "_doc", "_k")
    got = spread.select("id", "n_bytes", "_doc", "_k", "_last", "_start", "_body").mapInArrow(
        run, f"id {kind}, n_bytes long, _doc long, _k int, _last boolean, n long, head {EDGES}, tail {EDGES}")
    w = Window.partitionBy("_doc").orderBy("_k")  # the edges of one document: some hundred bytes a chunk
    at = lambda side, p: F.get(F.filter(side, lambda x: x["at"] == p), F.lit(0))["n"]
    seam = F.array_max(F.array_intersect(F.col("tail.at"), F.col("next.at")))
    got = got.withColumn("next", F.lead("head").over(w)).withColumn("p", seam)
    got = got.withColumn("cut", F.when(F.col("_last"), F.lit(0)).otherwise(F.col("n") - at(F.col("tail"), F.col("p"))))
    got = got.withColumn("skip", F.when(F.col("_last"), F.lit(0)).otherwise(at(F.col("next"), F.col("p"))))
    return got.select("id", "n_bytes", "_doc", "_k", (F.col("_last") | F.col("p").isNotNull()).alias("ok"),
                      (F.col("n") - F.col("cut") - F.col("skip")).alias("tokens"))


def _widened(chunks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """The same documents in wider chunks: a new chunk is put together from the old ones
    that it covers, so no more than a new chunk's text meets in one row."""
    old = chunks.withColumn("_end", F.col("_start") + F.length("_body"))
    size = old.groupBy("_doc").agg(F.max("_end").alias("_size"))
    step = chunk - overlap
    old = old.join(size, "_doc")
    # new chunk j covers [j * step, j * step + chunk)
    last = F.greatest(F.lit(0), F.ceil((F.col("_size") - overlap) / step) - 1)
    lo = F.greatest(F.lit(0), F.floor((F.col("_start") - chunk) / step) + 1)
    hi = F.least(last, F.floor((F.col("_end") - 1) / step))
    part = old.select("*", last.cast("int").alias("_n"), F.explode(F.sequence(lo, hi)).alias("_j"))
    a, z = F.col("_j") * step, F.col("_j") * step + chunk
    own = F.greatest(a, F.col("_start"))
    part = part.select("id", "n_bytes", "_doc", F.col("_j").cast("int").alias("_j"), "_n", own.alias("_from"),
                       F.col("_body").substr((own - F.col("_start") + 1).cast("int"),
                                             (F.least(z, F.col("_end")) - own).cast("int")).alias("_text"))
    # neighbours repeat what they share: a part gives what no part before it has
    parts = F.sort_array(F.collect_list(F.struct("_from", "_text")))
    glued = F.aggregate(parts, F.struct(F.lit(-1).cast("long").alias("_to"), F.lit("").alias("_text")), lambda s, x: F.struct(
        F.greatest(s["_to"], x["_from"] + F.length(x["_text"])).alias("_to"),
        F.concat(s["_text"], F.when(s["_to"] < 0, x["_text"]).otherwise(
            x["_text"].substr(F.greatest(s["_to"] - x["_from"] + 1, F.lit(1)).cast("int"), F.length(x["_text"])))).alias("_text")))
    return part.groupBy("_doc", "_j").agg(
        F.max(F.struct("id", "n_bytes", "_n")).alias("d"), glued["_text"].alias("_body")).select(
        F.col("d.id").alias("id"), F.col("d.n_bytes").alias("n_bytes"), "_doc", F.col("_j").alias("_k"),
        (F.col("_j") == F.col("d._n")).alias("_last"), (F.col("_j") * step).cast("long").alias("_start"), "_body")
