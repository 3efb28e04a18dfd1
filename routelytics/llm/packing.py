"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

A round range-sorts the unplaced pieces and the gaps of the open sequences together
by size.  One sweep over each block pairs every gap with the largest unpaired piece
that fits (equally: every piece with its successor among the gaps): pieces are pushed
on a stack, a gap pops the top.  What a block leaves unpaired is some gaps followed
by some pieces, so two counts per block settle the pairs that cross blocks, by rank.
Then the gaps shrink by what they took and the next round begins.

Sequences are opened as many at a time as a lower bound says are needed for what is
left; once all pieces left fit several times into a gap, it offers several slots.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions
from .quality_mil import _stretches

CAPACITY, END = 4096, 1
#: Words whose ids a worker remembers (about 150 bytes each), and bytes of text handled at a time.
CACHE_WORDS, SEGMENT = 600_000, 1 << 20
SEPARATOR = b"~"
#: Pieces and slots that one block of a round is given (about; blocks are at most as many as shuffle partitions).
BLOCK_ROWS = 30_000


def word_wise(tokenizer_json: str) -> bool:
    """Whether the file describes a tokenizer that is known to handle words one by one, as
    ``WordIds`` does: composed, lower-cased text, white space dropped, letters, single
    digits and other characters parted, byte-level BPE within each part."""
    t = json.loads(tokenizer_json)
    norm, pre, model = t.get("normalizer") or {}, t.get("pre_tokenizer") or {}, t.get("model") or {}
    steps = [n.get("type") for n in norm.get("normalizers", [])]
    cuts = pre.get("pretokenizers", [])
    plain = all(not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]) and not re.search(r"\s", a["content"])
                for a in t.get("added_tokens") or [])
    return (plain and t.get("post_processor") is None and steps == ["NFC", "Replace", "Lowercase"]
            and norm["normalizers"][1].get("pattern") == {"Regex": "\\s+"} and norm["normalizers"][1].get("content") == " "
            and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"] == {"Regex": PARTS} and cuts[0].get("invert") and cuts[0].get("behavior") == "Removed"
            and not cuts[1].get("add_prefix_space", True) and not cuts[1].get("use_regex", True)
            and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix"))


#: The pattern of parts that ``WordIds`` relies on (fixed).
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WholeIds:
    """Token ids of texts by any tokenizer: whole texts."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]


class WordIds:
    """Token ids of texts by way of their words: a ``word_wise`` tokenizer never looks across
    white space, so a word's ids do not depend on its neighbours and are worth remembering."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        mark = self.tokenizer.encode(SEPARATOR.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of words that hold no separator and no special token: many at a time."""
        for i in range(0, len(words), 4096):
            some = words[i:i + 4096]
            groups = [some[j:j + 256] for j in range(0, len(some), 256)]
            texts = [(b" " + SEPARATOR + b" ").join(g).decode("utf-8", "replace") for g in groups]
            for g, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                cuts, buf, a = np.flatnonzero(ids == self.mark).tolist(), ids.tobytes(), 0
                for w, c in zip(g, [*cuts, len(ids)]):
                    yield w, buf[4 * a:4 * c]
                    a = c + 1

    def _alone(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def learn(self, words: list[bytes]) -> None:
        """Put all of ``words`` in ``known``.  The tokenizer lower-cases and parts letters
        and digits from punctuation, so a word is looked up as lower-case core and tail."""
        known, text = self.known, b" ".join(words)
        if self.mark is None or any(s in text for s in (SEPARATOR, *self.special)):
            odd = {w for w in words if self.mark is None or any(s in w for s in (SEPARATOR, *self.special))}
            known.update((w, self._alone(w)) for w in odd)
            words = [w for w in words if w not in odd]
            text = b" ".join(words)
        cores, tails = [], []
        for low in text.lower().split():  # bytes: ASCII letters only
            core = low.rstrip(PUNCTUATION)
            if not core[-1:].isalnum():  # not surely a letter or a digit before the tail
                core = low
            cores.append(core)
            tails.append(low[len(core):])
        known[b""] = b""
        need, whole = {*cores, *tails}.difference(known), []
        model = self.tokenizer.model.tokenize
        for w in need:
            if w.isalpha():  # ASCII letters: one unit for the tokenizer, and as its model wants it
                known[w] = array("I", [t.id for t in model(w.decode())]).tobytes()
            else:
                whole.append(w)
        known.update(self._encode(whole))
        known.update((w, known[c] + known[t]) for w, c, t in zip(words, cores, tails))

    def _ids(self, words: list[bytes]) -> bytes:
        known = self.known
        ids = list(map(known.get, words))
        if None in ids:
            self.learn(list({w for w, i in zip(words, ids) if i is None}))
            ids = list(map(known.get, words))
        return b"".join(ids)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of some texts as little-endian unsigned 32-bit numbers."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        split = [t.split() if len(t) <= SEGMENT else [] for t in texts]
        new = set().union(*split).difference(self.known)
        if new:
            self.learn(list(new))
        # all short texts first: a long one may empty ``known``
        short = [b"".join(map(self.known.__getitem__, ws)) for ws in split]
        return [self._long(t) if len(t) > SEGMENT else ids for t, ids in zip(texts, short)]

    def _long(self, text: bytes) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = WHITE.search(text, at + SEGMENT)
            end = cut.start() if cut else len(text)
            if len(self.known) > 2 * CACHE_WORDS:
                self.known.clear()
            out.append(self._ids(text[at:end].split()))
            at = end
        return b"".join(out)


#: ASCII punctuation but for the separator.
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != SEPARATOR[0])
WHITE = re.compile(rb"[\x20\x09-\x0D]")


def _worker_ids(tokenizer_json: str) -> WordIds | WholeIds:
    """The process's own instance: workers serve many tasks."""
    store = sys.modules["tokenizers"].__dict__.setdefault("_word_ids", {})
    key = hash(tokenizer_json)
    if key not in store:
        store[key] = (WordIds if word_wise(tokenizer_json) else WholeIds)(tokenizer_json)
    return store[key]


def _forget_words() -> None:
    """Give back what the process remembers of words: the rounds after tokenising need none."""
    for ids in getattr(sys.modules.get("tokenizers"), "_word_ids", {}).values():
        if isinstance(ids, WordIds):
            ids.known.clear()


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY,
           end_id: int = END, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32 and, with
    ``keep_ids``, ids (binary, little-endian unsigned 32-bit).  A document's ids are the
    tokenizer's for its whole text (null: none), then ``end_id``."""
    from tokenizers import Tokenizer  # noqa: F401  (fails here, not in a task, where it is missing)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Path(tokenizer_path or default_tokenizer()).read_text())
    end, size = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        import tokenizers  # noqa: F401
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encode = _worker_ids(model.value)
        gc.disable()  # millions of short-lived byte strings and no cycles
        try:
            for b in batches:
                at, piece, start, length, crc, kept = [], [], [], [], [], []
                for first, texts in _stretches(b.column("text")):
                    for i, ids in enumerate(encode(texts), first):
                        ids += end
                        for k, a in enumerate(range(0, len(ids), size)):
                            x = ids[a:a + size]
                            at.append(i)
                            piece.append(k)
                            start.append(a // 4)
                            length.append(len(x) // 4)
                            crc.append(zlib.crc32(x))
                            if keep_ids:
                                kept.append(x)
                cols = [b.column("id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()),
                        *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)
        finally:
            gc.enable()  # the worker goes on to other tasks

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col(id_col).alias("id"), F.col("text")).mapInArrow(run, schema)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """A lower bound of the sequences needed for pieces by length (Martello and Toth's L2)."""
    h = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        h[n] += c
    cnt, tot = np.cumsum(h), np.cumsum(h * np.arange(capacity + 1))
    half, best = capacity // 2, -(-int(tot[-1]) // capacity)
    for a in range(half + 1):
        big, mid = cnt[-1] - cnt[capacity - a], cnt[capacity - a] - cnt[half]
        small = tot[half] - (tot[a - 1] if a else 0)
        room = mid * capacity - (tot[capacity - a] - tot[half])
        best = max(best, int(big + mid + max(0, -(-int(small - room) // capacity))))
    return best


SWEPT = "kind int, item long, size int, seq long, gap int, block int, place long"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair gaps and pieces of one sorted block.  kind 2: a pair; 0: a piece and 1: a gap
    without one, with its place among its kind in the block."""
    _forget_words()
    block, stack, gaps = TaskContext.get().partitionId(), [], 0
    for b in batches:
        rows = []
        for kind, item, size, seq, gap in zip(*(b.column(c).to_pylist() for c in ("kind", "item", "size", "seq", "gap"))):
            if kind == 0:
                stack.append((item, size))
            elif stack:
                rows.append((2, *stack.pop(), seq, gap, block, None))
            else:
                rows.append((1, None, None, seq, gap, block, gaps))
                gaps += 1
        if rows:
            yield _batch(rows, SWEPT)
    for i in range(0, len(stack), 10_000):
        yield _batch([(0, x, n, None, None, block, i + k) for k, (x, n) in enumerate(stack[i:i + 10_000])], SWEPT)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    cols = [x.split() for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[t]) for v, (_, t) in zip(zip(*rows), cols)], [c for c, _ in cols])


def _across(left: list[tuple[int, int, int]]) -> dict[tuple[int, int], list[tuple[int, int, int, int]]]:
    """Pairs across blocks from (block, gaps left, pieces left), blocks ascending, as
    intervals: (kind, block) -> [(first place, last place, number of the first, step)]."""
    stack, out, number = [], {}, 0
    for block, gaps, items in left:
        at = 0
        while gaps > at and stack:
            other, have = stack.pop()
            n = min(have, gaps - at)
            out.setdefault((1, block), []).append((at, at + n - 1, number, 1))
            out.setdefault((0, other), []).append((have - n, have - 1, number + n - 1, -1))
            at, number = at + n, number + n
            if have > n:
                stack.append((other, have - n))
        if items:
            stack.append((block, items))
    return out


def _numbered(intervals: dict):
    """Adds ``pair`` (null: none) to the rows that the sweeps left alone."""
    look = {k: np.array(sorted(v), np.int64) for k, v in intervals.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            kind, block, place = (b.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "block", "place"))
            pair, none = np.zeros(len(kind), np.int64), np.ones(len(kind), bool)
            for k, bl in set(zip(kind.tolist(), block.tolist())):
                t = look.get((k, bl))
                if t is None:
                    continue
                at = np.flatnonzero((kind == k) & (block == bl))
                i = np.searchsorted(t[:, 0], place[at], "right") - 1
                ok = (i >= 0) & (place[at] <= t[i, 1])
                pair[at] = t[i, 2] + t[i, 3] * (place[at] - t[i, 0])
                none[at] = ~ok
            keep = [c for c in b.schema.names if c not in ("block", "place")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(pair, mask=none)], [*keep, "pair"])
    return run


def best_fit(lengths: DataFrame, s: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """(item, size, sequence_id, offset) for a table (item long and unique, size int from
    1 to ``capacity``).  Sequences hold at most ``capacity``, without holes."""
    spark = lengths.sparkSession
    full = lengths.filter(F.col("size") == capacity).select(
        "item", "size", (-F.col("item") - 1).alias("seq"), F.lit(0).alias("round"))
    items = lengths.filter(F.col("size") < capacity).select("item", "size")
    placed, gaps, opened, rounds, progress, waves = [full], None, 0, 0, 0, 0
    while True:
        span = items.agg(F.min("size"), F.max("size"), F.count(F.lit(1))).first()
        if not span[2]:
            break
        if not progress:  # open sequences; the lengths' histogram has at most ``capacity`` rows
            waves += 1
            counts = {r[0]: r[1] for r in items.groupBy("size").count().collect()}
            more = lower_bound(counts, capacity)
            if waves > 2:  # what the bound misses: lengths that fit badly together
                more = max(more, int(np.ceil(sum(c / (capacity // k) for k, c in counts.items()))))
            new = spark.range(opened, opened + more).select(F.col("id").alias("seq"), F.lit(capacity).alias("gap"))
            opened += more
            gaps = new if gaps is None else gaps.union(new)
        rounds += 1
        slots = gaps.filter(F.col("gap") >= span[0]).withColumn(
            "_k", F.greatest(F.lit(1), F.floor(F.col("gap") / span[1]).cast("int")))
        # a block's task costs the same few 10 ms however few rows it has
        rows = span[2] + (slots.agg(F.sum("_k")).first()[0] or 0)
        n = max(1, min(partitions(spark), -(-rows // BLOCK_ROWS)))
        slots = slots.select(F.lit(1).alias("kind"), F.lit(None).cast("long").alias("item"),
                             F.floor(F.col("gap") / F.col("_k")).cast("int").alias("size"), "seq", "gap",
                             F.explode(F.sequence(F.lit(1), F.col("_k"))).alias("slot"))
        pool = items.select(F.lit(0).alias("kind"), "item", F.col("size").cast("int").alias("size"),
                            F.lit(None).cast("long").alias("seq"), F.lit(None).cast("int").alias("gap"),
                            F.lit(0).alias("slot")).union(slots)
        order = ["size", "kind", "item", "seq", "slot"]
        swept = s.table(pool.repartitionByRange(n, *order).sortWithinPartitions(*order)
                        .drop("slot").mapInArrow(_sweep, SWEPT), "swept", keep=False)
        left = (swept.filter("kind < 2").groupBy("block").agg(
            F.count(F.when(F.col("kind") == 1, 1)), F.count(F.when(F.col("kind") == 0, 1))).orderBy("block").collect())
        lone = s.table(swept.filter("kind < 2").mapInArrow(
            _numbered(_across([tuple(r) for r in left])), "kind int, item long, size int, seq long, gap int, pair long"),
            "lone", keep=False)
        pairs = lone.filter("pair is not null").groupBy("pair").agg(
            *(F.max(c).alias(c) for c in ("item", "size", "seq", "gap")))
        pairs = s.table(swept.filter("kind = 2").select("item", "size", "seq", "gap")
                        .union(pairs.select("item", "size", "seq", "gap")), "pairs")
        idle = lone.filter("kind = 1 and pair is null").select("seq", "gap", F.lit(0).alias("size"))
        gaps = s.table(pairs.select("seq", "gap", "size").union(idle).groupBy("seq").agg(
            (F.max("gap") - F.sum("size")).cast("int").alias("gap")), "gaps", keep=False)
        placed.append(pairs.select("item", "size", "seq", F.lit(rounds).alias("round")))
        progress = pairs.count()
        items = s.table(lone.filter("kind = 0 and pair is null").select("item", "size"), "items", keep=False)
        s.release(but_last=2)
    # a sequence has at most ``capacity`` pieces, so a window over it is bounded
    w = Window.partitionBy("seq").orderBy("round", F.col("size").desc(), "item")
    return reduce(DataFrame.union, placed).select(
        "item", "size", F.col("seq").alias("sequence_id"),
        (F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END,
         id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Pack all rows of ``docs`` (``id_col``, text) into sequences of at most ``capacity``
    tokens; one row per piece: ``id_col``, piece, start, length, ids_crc32,
    [ids,] sequence_id, offset.  ``tokenizer_path``: a file of the tokenizers library; one
    that handles words one by one (``word_wise``, as the default does) is run word by
    word, any other on whole texts.

    Only documents longer than a sequence are cut, into pieces of ``capacity`` and a
    rest.  Null and empty texts are the end id alone.  Null and repeated ids and repeated
    rows are packed as they come.  Extra columns are ignored; an empty table gives an
    empty result.  Texts are tokenised whole, a stretch at a time.
    """
    s = Scratch(docs.sparkSession, "packing")
    # the ids of rows are frozen by writing them with the pieces
    cut = s.table(pieces(docs, tokenizer_path, capacity, end_id, id_col, keep_ids)
                  .withColumn("_item", F.monotonically_increasing_id()), "pieces")
    fit = best_fit(cut.select(F.col("_item").alias("item"), F.col("length").cast("int").alias("size")), s, capacity)
    return cut.join(fit.select(F.col("item").alias("_item"), "sequence_id", "offset"), "_item").drop("_item")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of every sequence, from ``pack(keep_ids=True)``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # bounded by the capacity
    return packed.groupBy("sequence_id").agg(F.aggregate(
        parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
