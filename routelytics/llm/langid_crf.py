"""Language identification by a linear-chain conditional random field over words.

Every word carries a hidden language.  Its features are affixes and character n-grams
(n-grams of the word between border marks, hashed) and membership in word lists learned
per language; transitions are learned too.  Forward-backward gives each word's
posterior, so text that switches languages is labelled word by word; a document's
language is the one with the largest posterior mass over its words.

Training documents carry one label each, so training sequences are made by joining
stretches of documents of different languages, which shows the chain what a switch is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .quality_mil import _stretches, held_out

UNKNOWN = "und"
BITS, ORDERS = 16, (2, 3, 4, 5)
#: The fit may use this many rows per language and in all, and this many stretches of a row.
PER_LANGUAGE, MAX_ROWS, STRETCHES = 250, 5000, 24
SHORTEST, LONGEST, CHAIN = 6, 24, 48
#: Chains of a fit: as many as hold all words of the stretches, but (of enough stretches) no fewer than this.
LEAST_CHAINS = 4000
CHUNK = 128


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, first feature of each word) of distinct words in lower case."""
    data = np.frombuffer(b"^" + b"$^".join(words) + b"$", np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    word = np.repeat(np.arange(len(words)), size)
    stop = end[word]
    place = np.arange(len(data))
    found, owner = [], []
    with np.errstate(over="ignore"):
        h = data * np.uint64(0x9E3779B97F4A7C15)
        for n in range(2, max(ORDERS) + 1):
            k = len(data) - n + 1
            if k <= 0:
                break
            h = (h[:k] ^ (h[:k] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + data[n - 1:]
            if n in ORDERS:
                ok = place[:k] + n <= stop[:k]
                found.append((h[ok] * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - BITS)).astype(np.int64))
                owner.append(word[:k][ok])
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    return found[order], np.searchsorted(owner, np.arange(len(words)))


class Crf:
    """Weights of one trained field; languages in order of code points."""

    def __init__(self, languages: list[str]):
        n = len(languages)
        self.languages, self.lexicon = languages, {}
        self.W = np.zeros(((1 << BITS), n), np.float32)
        self.lex = np.zeros((n, n), np.float32)  # weight of being on a language's list
        self.bias, self.trans = np.zeros(n), np.zeros((n, n))

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Scores (words, languages) of distinct words; words without a letter score 0."""
        out = np.zeros((len(words), len(self.languages)))
        at = [i for i, w in enumerate(words) if _lettered(w)]
        if at:
            some = [words[i] for i in at]
            found, first = word_features(some)
            score = np.add.reduceat(self.W[found], first).astype(float) + self.bias
            lists = [self.lexicon.get(w, -1) for w in some]
            on = np.array(lists)
            score[on >= 0] += self.lex[on[on >= 0]]
            out[at] = score
        return out

    def posteriors(self, scores: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Posterior (words, languages) of chains laid end to end; ``start`` marks their
        first words.

        The chain is cut into chunks that advance together: first every chunk's product of
        transition matrices, then the messages at the chunks' borders one after the other,
        then all messages inside.  The result is exact whatever the chains' lengths.
        """
        n, m = scores.shape
        k = -(-n // CHUNK)
        e = np.ones((k * CHUNK, m))
        e[:n] = np.exp(scores - scores.max(1, keepdims=True))
        s = np.ones(k * CHUNK, bool)
        s[:n] = start
        e, s = e.reshape(k, CHUNK, m), s.reshape(k, CHUNK)
        a = np.exp(self.trans - self.trans.max())

        def step(c):  # the matrix that leads into position c, for every chunk
            return np.where(s[:, c, None, None], 1.0, a) * e[:, c, None, :]

        product = step(0)
        for c in range(1, CHUNK):
            product = product @ step(c)
            product /= product.max((1, 2), keepdims=True)
        into, back = np.ones((k, m)) / m, np.ones((k, m)) / m
        for i in range(1, k):
            v = into[i - 1] @ product[i - 1]
            into[i] = v / v.sum()
        for i in range(k - 2, -1, -1):
            v = product[i + 1] @ back[i + 1]
            back[i] = v / v.sum()
        post, v = np.empty((k, CHUNK, m)), into
        for c in range(CHUNK):
            v = np.where(s[:, c, None], v.sum(1, keepdims=True), v @ a) * e[:, c]
            v = v / v.sum(1, keepdims=True)
            post[:, c] = v
        v = back
        for c in range(CHUNK - 1, -1, -1):
            post[:, c] *= v
            v = v * e[:, c]
            v = np.where(s[:, c, None], v.sum(1, keepdims=True), v @ a.T)
            v = v / v.sum(1, keepdims=True)
        post = post.reshape(-1, m)[:n]
        return post / post.sum(1, keepdims=True)

    def label(self, texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
        """The texts' words and, for all of them laid end to end, the posteriors and
        whether a word has a letter."""
        split = [t.decode("utf-8", "replace").lower().encode().split() for t in texts]
        size = [len(w) for w in split]
        if not sum(size):
            return split, np.zeros((0, len(self.languages))), np.zeros(0, bool)
        known = pa.array([w for ws in split for w in ws], pa.binary()).dictionary_encode()
        distinct, code = known.dictionary.to_pylist(), known.indices.to_numpy()
        score = self.emissions(distinct)[code]
        start = np.zeros(sum(size), bool)
        firsts = np.concatenate(([0], np.cumsum(size)[:-1]))[np.array(size) > 0]
        start[firsts.astype(int)] = True
        return split, self.posteriors(score, start), np.fromiter(map(_lettered, distinct), bool)[code]

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """Language and its share of the posterior mass over the words with a letter."""
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        split, post, real = self.label(texts)
        doc = np.repeat(np.arange(len(texts)), [len(w) for w in split])
        mass = np.stack([np.bincount(doc[real], post[real, j], len(texts)) for j in range(len(self.languages))], 1)
        n = np.bincount(doc[real], minlength=len(texts))
        best = mass.argmax(1)
        return ([self.languages[b] if c else UNKNOWN for b, c in zip(best, n)],
                [float(min(m[b] / c, 1.0)) if c else 0.0 for m, b, c in zip(mass, best, n)])

    def fit(self, stretches: list[tuple[int, list[bytes]]], steps: int = 25, rate: float = 0.15, decay: float = 1e-4,
            seed: int = 11, lexicon_size: int = 300):
        """Fit on (language number, words): conditional likelihood of chains of ``CHAIN``
        words joined from stretches, by Adam.  As many words are drawn as the stretches
        hold; few stretches are drawn several times (``LEAST_CHAINS``)."""
        r, m = np.random.default_rng(seed), len(self.languages)
        by = [[w for l, w in stretches if l == j] for j in range(m)]
        total = max(min(LEAST_CHAINS, len(stretches)), -(-sum(len(w) for _, w in stretches) // CHAIN))
        words, labels = [], []
        for _ in range(total):  # a chain: stretches of languages drawn evenly, so switches occur
            ws, ls = [], []
            while len(ws) < CHAIN:
                j = int(r.integers(m))
                pick = by[j][int(r.integers(len(by[j])))]
                ws += pick
                ls += [j] * len(pick)
            words += ws[:CHAIN]
            labels += ls[:CHAIN]
        coded = pa.array(words, pa.binary()).dictionary_encode()
        vocab, code, y = coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.array(labels)
        count = np.bincount(code * m + y, minlength=len(vocab) * m).reshape(-1, m)
        share = (count + 0.1) / (count.sum(1, keepdims=True) + 0.1 * m)
        for j in range(m):
            own = [i for i in np.argsort(-count[:, j], kind="stable")[:lexicon_size]
                   if count[i, j] > 2 and share[i].argmax() == j]
            self.lexicon.update({vocab[i]: j for i in own})
        letter = np.array([_lettered(w) for w in vocab])
        feats, first = word_features([w if l else b"" for w, l in zip(vocab, letter)])
        length = np.diff(np.concatenate((first, [len(feats)])))
        member = np.repeat(np.arange(len(vocab)), length)
        lists = np.array([self.lexicon.get(w, -1) for w in vocab])
        start = np.arange(len(y)) % CHAIN == 0
        stay = ~start
        seen = np.zeros((m, m))
        np.add.at(seen, (y[:-1][stay[1:]], y[1:][stay[1:]]), 1)
        p = {"W": self.W.astype(float), "lex": self.lex.astype(float), "bias": self.bias, "trans": self.trans}
        moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
        for t in range(1, steps + 1):
            score = np.add.reduceat(p["W"][feats], first) + p["bias"]
            score[lists >= 0] += p["lex"][lists[lists >= 0]]
            score[~letter] = 0
            self.trans = p["trans"]
            per_word, bias, pairs = np.zeros((len(vocab), m)), np.zeros(m), np.zeros((m, m))
            for i in range(0, len(y), LEAST_CHAINS * CHAIN):  # some chains at a time, which bounds the memory
                c = code[i:i + LEAST_CHAINS * CHAIN]
                post, p2 = self._marginals(score[c].reshape(-1, CHAIN, m))
                diff = (post.reshape(-1, m) - np.eye(m)[y[i:i + len(c)]]) * letter[c][:, None]
                per_word += np.stack([np.bincount(c, diff[:, j], len(vocab)) for j in range(m)], 1)
                bias += diff.sum(0)
                pairs += p2
            grad = {"W": np.stack([np.bincount(feats, per_word[member, j], 1 << BITS) for j in range(m)], 1),
                    "lex": np.stack([np.bincount(lists[lists >= 0], per_word[lists >= 0, j], m) for j in range(m)], 1),
                    "bias": bias, "trans": pairs - seen}
            for k, g in grad.items():
                g = g / total + decay * p[k]
                a, b = moment[k]
                a += .1 * (g - a)
                b += .01 * (g * g - b)
                p[k] = p[k] - rate * (a / (1 - .9 ** t)) / (np.sqrt(b / (1 - .99 ** t)) + 1e-8)
        self.W, self.lex = p["W"].astype(np.float32), p["lex"].astype(np.float32)
        self.bias, self.trans = p["bias"], p["trans"]
        return self

    def _marginals(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word marginals and summed pair marginals of chains of one length (n, t, m)."""
        n, t, m = score.shape
        e, a = np.exp(score - score.max(2, keepdims=True)), np.exp(self.trans - self.trans.max())
        f, b = np.empty_like(e), np.ones_like(e)
        f[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for i in range(1, t):
            v = (f[:, i - 1] @ a) * e[:, i]
            f[:, i] = v / v.sum(1, keepdims=True)
        pairs = np.zeros((m, m))
        for i in range(t - 2, -1, -1):
            right = e[:, i + 1] * b[:, i + 1]
            joint = f[:, i, :, None] * a * right[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            v = right @ a.T
            b[:, i] = v / v.sum(1, keepdims=True)
        post = f * b
        return post / post.sum(2, keepdims=True), pairs


def _lettered(word: bytes) -> bool:
    """Whether a word has a letter of any script."""
    return word.isalpha() or any(c.isalpha() for c in word.decode("utf-8", "replace"))


def choose_rows(docs: DataFrame, per_language: int, label_col: str = "lang") -> DataFrame:
    """(doc_id, lang, _r): of each language the ``per_language`` ids with the smallest
    hashes among the labelled rows that are not held out, and their rank.

    From the rows a language has follows a bound on the hash that about one and a half
    times as many pass as are wanted, so ranking meets that many rows, however many rows
    and tasks there are.  Where too few pass (ids that repeat a lot), the bound is raised
    eightfold until enough do or all pass."""
    s = Scratch(docs.sparkSession, "language-rows")
    rows = docs.select("doc_id", F.col(label_col).alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    rows = rows.withColumn("_h", F.xxhash64(F.col("doc_id"), F.lit("lang")))
    share = per_language + 8 * math.ceil(math.sqrt(per_language))
    span = F.least(F.lit(1.0), F.lit(float(share)) / F.col("n"))
    open_ = s.table(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("span", span), "counts")
    found = None
    while found is None or not open_.isEmpty():
        # the hash as a share of its range; a whole range takes every row
        below = (F.col("_h") / F.lit(float(1 << 63)) + 1) / 2
        some = rows.join(open_, "lang").filter((below <= F.col("span")) | (F.col("span") >= 1)).select("doc_id", "lang", "_h").distinct()
        some = s.table(some, "some")
        enough = some.groupBy("lang").agg(F.count(F.lit(1)).alias("got"))
        state = open_.join(enough, "lang", "left").withColumn("ok", (F.col("span") >= 1) | (F.coalesce("got", F.lit(0)) >= per_language))
        state = s.table(state, "state")
        done = some.join(state.filter("ok").select("lang"), "lang").select("doc_id", "lang", "_h")
        found = done if found is None else found.unionByName(done)
        open_ = state.filter("NOT ok").select("lang", "n", F.least(F.lit(1.0), F.col("span") * 8).alias("span"))
    rank = Window.partitionBy("lang").orderBy("_h", "doc_id")
    return found.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= per_language).drop("_h")


def fit_language(docs: DataFrame, per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS,
                 label_col: str = "lang") -> Crf:
    """Fit on rows with a label that are not held out: of each language the first
    ``per_language`` by hash of the id, at most ``max_rows`` in all.  A row gives up to
    ``STRETCHES`` stretches of words, spread over its whole text."""
    chosen = choose_rows(docs, per_language, label_col).orderBy("_r", "lang").limit(max_rows).select("doc_id", "lang")
    # the broadcast side has at most ``max_rows`` rows
    sample = docs.select("doc_id", "text", F.col(label_col).alias("lang")).join(
        F.broadcast(chosen), ["doc_id", "lang"]).orderBy(F.xxhash64("doc_id", "text")).limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, out = b.column("lang").to_pylist(), ([], [])
            for i, t in enumerate(b.column("text").to_pylist()):
                ws = (t or "").lower().encode().split()
                r = np.random.default_rng(len(ws))
                spots = np.linspace(0, max(0, len(ws) - LONGEST), min(STRETCHES, -(-len(ws) // LONGEST)), dtype=int)
                for a in spots.tolist():
                    out[0].append(lang[i])
                    out[1].append(b" ".join(ws[a:a + int(r.integers(SHORTEST, LONGEST + 1))]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], ["lang", "words"])

    rows = sample.mapInArrow(run, "lang string, words binary").collect()
    pairs = sorted((r.lang, bytes(r.words)) for r in rows)
    languages = sorted({l for l, w in pairs if any(map(_lettered, w.split()))})
    model = Crf(languages)
    number = {l: j for j, l in enumerate(languages)}
    stretches = [(number[l], w.split()) for l, w in pairs if l in number]
    return model.fit(stretches) if len(languages) > 1 else model


def identify(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Only the text enters a prediction.  Null texts and texts without a letter are
    ``und`` with score 0, as is everything if no language could be learned; with one
    learned language every text with a letter has it.  Null and repeated ids and repeated
    rows each give a row; extra columns are ignored; an empty table gives an empty result.
    """
    model = model or fit_language(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = [], []
            for _, texts in _stretches(b.column("text")):
                l, s = model.predict(texts)
                lang += l
                score += s
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_held"), pa.array(lang, pa.string()),
                                              pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("_held"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, words: array of (word, lang, score)): the language of every word."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, texts in _stretches(b.column("text")):
                split, post, _ = model.label(texts)
                at = 0
                for ws in split:
                    p = post[at:at + len(ws)]
                    at += len(ws)
                    out.append([{"word": w.decode(), "lang": model.languages[int(q.argmax())] if _lettered(w) else UNKNOWN,
                                 "score": float(q.max())} for w, q in zip(ws, p)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, spans)], ["doc_id", "words"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, words array<struct<word:string,lang:string,score:double>>")
