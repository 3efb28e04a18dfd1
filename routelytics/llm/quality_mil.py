"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is encoded from
its characters and words; gated attention, learned from document labels alone, weighs
the passages; the weighted representation gives the document's score.  Features are
computed and documents scored inside Spark tasks, many texts at a time; the driver
fits the weights on the features of a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSAGE, STRETCH = 64, 1 << 21
#: Bytes of text whose features are computed at a time: the arrays take about 100 bytes for each.
FEATURE_STRETCH = 1 << 19
#: Labelled rows that the fit may use: the first by hash of the id.
MAX_LABELLED = 3000
FEATURES = ["upper", "digit", "pipe", "symbol", "exclamation", "punctuation", "period", "comma", "newline",
            "non_ascii", "word_length", "word_spread", "distinct", "repeated", "words", "capitalised", "all"]


def _classes() -> np.ndarray:
    table = np.full(256, 10, np.uint8)  # lower case and the rest
    for chars, c in ((b"\x20\t\r\x0b\x0c", 11), (b"\n", 8), (b"|", 2), (b"#*$%&<>", 3), (b"!", 4),
                     (b"\"'()-/:;?@[\\]^_`{}~+=", 5), (b".", 6), (b",", 7)):
        table[list(chars)] = c
    table[ord("A"):ord("Z") + 1] = 0
    table[ord("0"):ord("9") + 1] = 1
    table[128:] = 9
    return table


CLASS = _classes()


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)


ROOT = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(ROOT, -1, 1 << 64)


def passage_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, document number) of the passages of some texts; a text without words
    is one passage of zeros."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    n = len(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    cls = CLASS[data]
    gap = (cls == 11) | (cls == 8)
    first = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    if not len(first):
        return np.zeros((n, len(FEATURES)), np.float32), np.arange(n)
    last = np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1])))  # one behind each word
    doc = np.searchsorted(ends, first, "right")
    per_doc = np.bincount(doc, minlength=n)
    in_doc = np.arange(len(first)) - np.concatenate(([0], np.cumsum(per_doc)[:-1]))[doc]
    count = np.maximum(1, -(-per_doc // PASSAGE))
    base = np.concatenate(([0], np.cumsum(count)[:-1]))
    passage = base[doc] + in_doc // PASSAGE
    total = int(count.sum())
    owner = np.repeat(np.arange(n), count)
    # characters: those from a passage's first word to the end of its last
    head = np.concatenate(([True], passage[1:] != passage[:-1]))
    span = np.zeros(len(data), np.int64)
    span[first[head]] = np.diff(np.concatenate(([0], passage[head])))
    byte_passage = np.cumsum(span)
    begin, stop = np.zeros(total, np.int64), np.zeros(total, np.int64)
    begin[passage[head]], stop[passage] = first[head], last  # a passage's last word is the last written
    place = np.arange(len(data))
    own = (place >= begin[byte_passage]) & (place < stop[byte_passage])
    chars = np.bincount((byte_passage * 12 + cls)[own], minlength=total * 12).reshape(total, 12).astype(np.float64)
    words = np.bincount(passage, minlength=total).astype(np.float64)
    some = np.maximum(words, 1)
    size = (last - first).astype(np.float64)
    mean = np.bincount(passage, size, total) / some
    spread = np.sqrt(np.maximum(np.bincount(passage, size ** 2, total) / some - mean ** 2, 0))
    caps = np.bincount(passage, cls[first] == 0, total) / some
    with np.errstate(over="ignore"):
        power, back = _powers(len(data) + 1, ROOT), _powers(len(data) + 1, INVERSE)
        total_hash = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64, out=total_hash[1:])
        word = (total_hash[last] - total_hash[first]) * back[first]
        mixed = (word ^ (word >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        seen, at = np.unique(mixed + passage.astype(np.uint64) * np.uint64(0x94D049BB133111EB), return_index=True)
        distinct = np.bincount(passage[at], minlength=total) / some
        three = np.zeros(len(word), np.uint64)
        if len(word) > 2:
            three[:-2] = mixed[:-2] * np.uint64(3) + mixed[1:-1] * np.uint64(5) + mixed[2:] * np.uint64(7)
        three += doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    whole = in_doc + 2 < per_doc[doc]
    order = np.argsort(three[whole])
    t = three[whole][order]
    same = np.concatenate(([False], t[1:] == t[:-1]))
    twin = np.zeros(len(t), bool)
    twin[order] = same | np.concatenate((same[1:], [False]))
    where = passage[whole]
    repeated = np.bincount(where, twin, total) / np.maximum(np.bincount(where, minlength=total), 1)
    letters = np.maximum(chars[:, [0, 1, 2, 3, 4, 5, 6, 7, 9, 10]].sum(1), 1)
    x = np.column_stack([
        chars[:, 0] / letters, chars[:, 1] / letters, chars[:, 2] / some, chars[:, 3] / some, chars[:, 4] / some,
        chars[:, 5] / some, chars[:, 6] / some, chars[:, 7] / some, chars[:, 8] / some, chars[:, 9] / letters,
        mean / 10, spread / 10, distinct, repeated, np.log1p(words) / 4, caps, np.log1p(per_doc[owner]) / 10])
    x[words == 0] = 0
    return np.minimum(x, 8).astype(np.float32), owner


def _stretches(column, most: int = STRETCH) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of a column, about ``most`` bytes at a time."""
    texts, size, at = [], 0, 0
    for i, t in enumerate(column.cast(pa.large_binary())):
        t = t.as_py() or b""
        texts.append(t)
        size += len(t)
        if size >= most:
            yield at, texts
            texts, size, at = [], 0, i + 1
    if texts:
        yield at, texts


def _segments(owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class GatedAttention:
    """Passage encoder, gated attention over a bag, and a logistic output."""

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 7):
        r, d = np.random.default_rng(seed), len(FEATURES)
        self.shift, self.scale = np.zeros(d), np.ones(d)
        self.p = {"W": r.normal(0, d ** -.5, (d, hidden)), "b": np.zeros(hidden),
                  "V": r.normal(0, hidden ** -.5, (hidden, gate)), "v": np.zeros(gate),
                  "U": r.normal(0, hidden ** -.5, (hidden, gate)), "u": np.zeros(gate),
                  "w": r.normal(0, gate ** -.5, gate), "c": r.normal(0, hidden ** -.5, hidden), "o": np.zeros(1)}

    def forward(self, x, owner):
        p, at = self.p, _segments(owner)
        h = np.tanh(x @ p["W"] + p["b"])
        a, g = np.tanh(h @ p["V"] + p["v"]), _sigmoid(h @ p["U"] + p["u"])
        e = (a * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, at)[owner])
        weight = e / np.add.reduceat(e, at)[owner]
        z = np.add.reduceat(weight[:, None] * h, at)
        return h, a, g, weight, z, _sigmoid(z @ p["c"] + p["o"][0])

    def score(self, x, owner):
        """Scores of the bags; ``owner`` numbers them from 0 without gaps."""
        return self.forward((x - self.shift) * self.scale, owner)[-1]

    def fit(self, x, owner, y, steps: int = 250, rate: float = 0.03, decay: float = 1e-4):
        self.shift, self.scale = x.mean(0), 1 / np.maximum(x.std(0), 0.05)
        x, at, p = (x - self.shift) * self.scale, _segments(owner), self.p
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
        for step in range(1, steps + 1):
            h, a, g, weight, z, q = self.forward(x, owner)
            ds = (q - y) / len(y)
            dz = ds[:, None] * p["c"]
            dw = (dz[owner] * h).sum(1)
            de = weight * (dw - np.add.reduceat(weight * dw, at)[owner])
            dag = de[:, None] * p["w"]
            da, dg = dag * g * (1 - a ** 2), dag * a * g * (1 - g)
            dh = (weight[:, None] * dz[owner] + da @ p["V"].T + dg @ p["U"].T) * (1 - h ** 2)
            grad = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ da, "v": da.sum(0), "U": h.T @ dg, "u": dg.sum(0),
                    "w": (a * g).T @ de, "c": z.T @ ds, "o": ds.sum(keepdims=True)}
            for k, d in grad.items():  # Adam
                d = d + decay * p[k]
                m[k][0] = .9 * m[k][0] + .1 * d
                m[k][1] = .99 * m[k][1] + .01 * d * d
                p[k] = p[k] - rate * (m[k][0] / (1 - .9 ** step)) / (np.sqrt(m[k][1] / (1 - .99 ** step)) + 1e-8)
        return self


def held_out(id_col: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id does not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED,
                label_col: str = "quality") -> GatedAttention:
    """Fit on at most ``max_labelled`` labelled documents that are not held out, the first
    by hash of their id.  Labels other than 0 and 1 are ignored, of several labels of an id
    the lowest counts.  Without labels of both kinds the model scores its prior."""
    usable = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).filter(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), 4, 2))
    order = [F.xxhash64(F.col("doc_id"), F.lit("quality")), F.col("doc_id")]
    chosen = usable.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(*order).limit(max_labelled)
    # the broadcast side has at most ``max_labelled`` rows
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(
        *order, F.xxhash64("text")).limit(max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column("y").to_pylist()
            for at, texts in _stretches(b.column("text"), FEATURE_STRETCH):
                x, owner = passage_features(texts)
                bags = [x[a:z].tobytes() for a, z in zip(_segments(owner), [*_segments(owner)[1:], len(x)])]
                yield pa.RecordBatch.from_arrays([pa.array(y[at:at + len(texts)], pa.int32()), pa.array(bags, pa.binary())], ["y", "bag"])

    rows = sample.select("y", "text").mapInArrow(run, "y int, bag binary").collect()
    model = GatedAttention()
    if len({r.y for r in rows}) < 2:
        prior = (sum(r.y for r in rows) + 1) / (len(rows) + 2)
        model.p["c"][:], model.p["o"][:] = 0, np.log(prior / (1 - prior))
        return model
    rows.sort(key=lambda r: (r.y, r.bag))  # the order in which tasks end does not matter
    bags = [np.frombuffer(r.bag, np.float32).reshape(-1, len(FEATURES)) for r in rows]
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    return model.fit(np.concatenate(bags).astype(np.float64), owner, np.array([r.y for r in rows], float))


def score_quality(docs: DataFrame, model: GatedAttention, carry: list[str], text_col: str = "text",
                  within: str | None = None) -> DataFrame:
    """The ``carry`` columns of ``docs`` with score (0 to 1, higher: better), as ``_score``.
    ``within``: a carried struct that holds the text, which then is not sent to the workers
    twice.  Null and empty texts are one empty passage.  Whole texts are scored; their
    passages are weighed together however many they are."""
    text = [] if within else [F.col(text_col).alias("_text")]
    src = docs.select(*[F.col(c) for c in carry], *text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = pc.struct_field(b.column(within), text_col) if within else b.column(len(carry))
            scores = [model.score(*passage_features(texts)) for _, texts in _stretches(column, FEATURE_STRETCH)]
            if scores:
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:len(carry)], pa.array(np.concatenate(scores), pa.float64())], [*b.schema.names[:len(carry)], "_score"])

    schema = T.StructType([*src.schema.fields[:len(carry)], T.StructField("_score", T.DoubleType())])
    return src.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7,
             max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 where the score is
    at least ``threshold``).  Only the text enters a score.  Null and repeated ids and
    repeated rows each give a row; extra columns are ignored; an empty table gives an
    empty result."""
    scored = score_quality(docs, fit_quality(docs, labels, max_labelled), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= threshold).cast("int").alias("predicted"))
