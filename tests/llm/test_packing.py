import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from helpers import EDGE_ROWS, clashing, edge, empty, rows

from routelytics.llm import packing as PK
from routelytics.llm.common import Scratch


def _direct(text, capacity):
    from tokenizers import Tokenizer
    t = _direct.__dict__.setdefault("t", Tokenizer.from_file(PK.default_tokenizer()))
    ids = t.encode(text or "", add_special_tokens=False).ids + [1]
    return [(k // capacity, k, len(ids[k:k + capacity]), zlib.crc32(np.array(ids[k:k + capacity], "<u4").tobytes()))
            for k in range(0, len(ids), capacity)]


def _layout(packed, capacity):
    by = defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_pieces_equal_direct_tokenisation_and_layout_is_gapless(spark):
    got = PK.pack(edge(spark)).collect()
    want = sorted(((r[0], *p) for r in EDGE_ROWS for p in _direct(r[1], 4096)), key=repr)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == want
    _layout(got, 4096)


def test_odd_words_tokenise_as_in_their_text():
    from pathlib import Path
    ids = PK.WordIds(Path(PK.default_tokenizer()).read_text())
    texts = ["a~b ~ ~~ x~", "<|endoftext|> a<|startoftext|>b", "don't we're 'tis it's, they'll!", "“quoted…” naïvé ﬁ ı İ ſ K",
             "a b c\x85d", "ẹ́ ́x 1٣4½", "Hello,world!! (foo).bar ab12cd 3.14%", "\x1c\x1f a\x00b", "CAFÉ café, É. é.. dogs' x's ß'll \x00. a\x00. ªº µ× ÷ ǅ ŉ ſ. İ. ~a~ _b_"]
    for t in texts:
        want = np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert ids([t.encode()])[0] == want, t


def test_long_texts_are_tokenised_in_stretches(monkeypatch):
    from pathlib import Path
    monkeypatch.setattr(PK, "SEGMENT", 50)
    ids = PK.WordIds(Path(PK.default_tokenizer()).read_text())
    t = "the quick, brown fox " * 40 + "x" * 200 + " end"
    assert ids([t.encode()])[0] == np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def _decreasing(lengths, capacity):
    """Sequential best-fit decreasing."""
    import bisect
    gaps = []
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        left = (gaps.pop(i) if i < len(gaps) else capacity) - x
        bisect.insort(gaps, left)
    return len(gaps)


@pytest.mark.parametrize("name", ["uniform", "small", "equal", "large", "hot"])
def test_about_as_few_sequences_as_best_fit_decreasing(spark, name):
    r = np.random.default_rng(5)
    lengths = {"uniform": r.integers(1, 100, 1500), "small": r.integers(1, 6, 2000), "equal": np.full(500, 34),
               "large": r.integers(51, 101, 400), "hot": np.concatenate([np.full(1000, 7), r.integers(1, 101, 500)])}[name].tolist()
    df = spark.createDataFrame(list(enumerate(lengths)), "item long, size int").repartition(5)
    got = PK.best_fit(df, Scratch(spark, "test-pack"), 100).collect()
    assert sorted((r["item"], r["size"]) for r in got) == list(enumerate(lengths))
    n = _layout([{"sequence_id": r["sequence_id"], "offset": r["offset"], "length": r["size"]} for r in got], 100)
    assert n <= 1.02 * _decreasing(lengths, 100) + 1


def test_rounds_match_each_gap_with_the_largest_piece_that_fits():
    """The sweep and the cross-block pairing equal one stack over the whole order."""
    r = np.random.default_rng(3)
    for _ in range(200):
        pool = sorted((int(r.integers(1, 12)), int(r.integers(0, 2)), i) for i in range(int(r.integers(1, 30))))
        want, stack = set(), []
        for size, kind, i in pool:
            if kind == 0:
                stack.append(i)
            elif stack:
                want.add((stack.pop(), i))
        cuts = sorted(r.integers(0, len(pool) + 1, 3).tolist())
        blocks = [pool[a:b] for a, b in zip([0, *cuts], [*cuts, len(pool)])]
        got, left, lone = set(), [], {}
        for b, block in enumerate(blocks):
            stack, gaps = [], 0
            for size, kind, i in block:
                if kind == 0:
                    stack.append(i)
                elif stack:
                    got.add((stack.pop(), i))
                else:
                    lone[(1, b, gaps)] = i
                    gaps += 1
            lone.update({(0, b, k): i for k, i in enumerate(stack)})
            left.append((b, gaps, len(stack)))
        number = {}
        for (kind, b), spans in PK._across(left).items():
            for a, z, first, step in spans:
                for place in range(a, z + 1):
                    number.setdefault(first + step * (place - a), {})[kind] = lone[(kind, b, place)]
        got |= {(x[0], x[1]) for x in number.values()}
        assert got == want


def test_sequences_hold_the_documents_ids(spark):
    packed = PK.pack(edge(spark), capacity=512, keep_ids=True)
    ids = {r["sequence_id"]: r["ids"] for r in PK.sequences(packed).collect()}
    for r in packed.collect():
        part = bytes(ids[r["sequence_id"]])[4 * r["offset"]:4 * (r["offset"] + r["length"])]
        assert zlib.crc32(part) == r["ids_crc32"]
    assert all(len(v) <= 4 * 512 for v in ids.values())


def test_empty_table_and_clashing_columns(spark):
    assert PK.pack(empty(spark)).collect() == []
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(PK.pack(clashing(spark)), *cols) == rows(PK.pack(edge(spark)), *cols)


def test_a_long_text_that_empties_the_cache_leaves_its_neighbours(monkeypatch):
    monkeypatch.setattr(PK, "CACHE_WORDS", 40)
    monkeypatch.setattr(PK, "SEGMENT", 300)
    encode = PK.WordIds(Path(PK.default_tokenizer()).read_text())
    texts = [b"before it", b" ".join(b"junk%dx" % i for i in range(400)), b"short words after it"]
    want = [encode.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == want


def test_random_words_tokenise_as_in_their_text():
    import random
    r, ids = random.Random(6), PK.WordIds(Path(PK.default_tokenizer()).read_text())
    some = ["a", "B", "é", "É", "'s", "'", "'LL", ".", "~", "<|endoftext|>", "1", "ß", "İ", "Σ", "\u0301", "\x00", "_", " ", "\u00a0", "漢", "ŋ", "²"]
    for _ in range(6000):
        t = "".join(r.choice(some) for _ in range(r.randint(0, 12)))
        assert ids([t.encode()])[0] == np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_other_tokenizers_take_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers
    words = {w: i for i, w in enumerate(["<unk>", "The", "the", "dog", "Dog", "dog,"])}
    own = Tokenizer(models.WordLevel(words, "<unk>"))  # case matters, white space alone parts
    own.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    own.save(str(tmp_path / "own.json"))
    import public_tokenizers as P
    texts = ["The dog, the Dog", "the the  dog", "", None, "DOG"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for path in (str(tmp_path / "own.json"), P.path("byte_bpe_50k.json")):
        assert not PK.word_wise(Path(path).read_text())
        t = Tokenizer.from_file(path)
        want = [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for x in texts]
        got = PK.pieces(docs, path, keep_ids=True).orderBy("doc_id").collect()
        assert [bytes(r["ids"]) for r in got] == want
    assert PK.word_wise(Path(PK.default_tokenizer()).read_text())
