import random

import public_tokenizers as P
import pytest
from helpers import EDGE_ROWS, clashing, edge, empty, rows
from tokenizers import Tokenizer

from conftest import SF001
from routelytics.llm import token_counts as TC

FRAGMENTS = ["the", " the", "  ", " ", "\n", "\t", "'", "'s", "'ll", "'l", "l", "é", "漢字", "\U0001f600", "1", "23", ".", "!!", "<|endoftext|>",
             "<|endo", "ftext|>", " ", "　", "\x1c", "\x85", "straße", " a", "\r\n", "x" * 40, " " * 30, "-" * 25, "é", "\x00", "   <|endoftext|>", "  <|endoftext", "\n \n <|endoftext|>"]


def _library():
    t = Tokenizer.from_file(TC.default_tokenizer())
    return lambda x: len(t.encode(x or "", add_special_tokens=False).ids)


def _texts(n, size, seed):
    r = random.Random(seed)
    return ["".join(r.choice(FRAGMENTS) for _ in range(r.randint(0, size))) for _ in range(n)]


def test_units_equal_the_library():
    want, c = _library(), TC.Counter(open(TC.default_tokenizer()).read(), "json")
    texts = _texts(6000, 12, 1)
    assert c.margin == len("<|endoftext|>") + 1
    assert c.count(texts) == [want(t) for t in texts]


def test_edges_of_a_chunk_are_the_librarys():
    c = TC.Counter(open(TC.default_tokenizer()).read(), "json")
    for t in _texts(400, 200, 3):
        n, head, tail = c.edges([t], 40, [1000])[0]
        m, fine_head, fine_tail = c._fine(t, 40, 1000)
        assert n == m and set(tail) <= set(fine_tail) and set(head) <= {(1000, 0), *fine_head}


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (128, 20)])
def test_chunks_equal_the_library(spark, chunk, overlap):
    want, texts = _library(), _texts(300, 120, 2)  # runs of 40 are longer than the overlap: some widen
    texts += ["a" * 5000, " " * 1000, "'" * 300 + "ll" * 100, "<|endoftext|>" * 60, "x " * 700 + "é" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_bytes) for r in TC.count_tokens(docs, chunk=chunk, overlap=overlap).collect()}
    assert got == {i: (want(t), len(t.encode())) for i, t in enumerate(texts)}


def test_wider_chunks_are_those_of_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    cut = lambda c, o: [(7, 0, 1, k, k == len(TC._cuts(1000, c, o)) - 1, a, text[a:z])
                        for k, (a, z) in enumerate(TC._cuts(1000, c, o))]
    cols = "id long, n_bytes long, _doc long, _k int, _last boolean, _start long, _body string"
    for c, o in [(64, 16), (100, 7), (300, 75)]:
        got = TC._widened(spark.createDataFrame(cut(c, o), cols), 4 * c, 4 * o).select(*[x.split()[0] for x in cols.split(", ")])
        assert sorted(tuple(r) for r in got.collect()) == cut(4 * c, 4 * o)


def test_documents(spark):
    want = _library()
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = TC.count_tokens(docs, chunk=1000, overlap=64).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {k: want(t) for k, t in texts.items()} and len(got) == len(texts)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_other_tokenizers_encode_whole_texts(spark):
    assert TC.splittable(open(P.path("word_bpe_49k.json")).read()) == 0
    docs = edge(spark)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = rows(TC.count_tokens(docs, P.path("word_bpe_49k.json")), "doc_id", "n_tokens")
    assert got == sorted(((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in EDGE_ROWS), key=repr)
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = rows(TC.count_tokens(docs, P.path("piece_bpe_32k.model")), "doc_id", "n_tokens")
    assert got == sorted(((r[0], len(sp.encode(r[1] or ""))) for r in EDGE_ROWS), key=repr)


def test_edges(spark):
    want = _library()
    got = rows(TC.count_tokens(edge(spark), chunk=4096, overlap=64), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == sorted(((r[0], len((r[1] or "").encode()), want(r[1]), want(r[1]) > 1024) for r in EDGE_ROWS), key=repr)
    assert rows(TC.count_tokens(clashing(spark))) == rows(TC.count_tokens(edge(spark)))
    assert TC.count_tokens(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        TC.count_tokens(edge(spark), chunk=100, overlap=50)


def test_a_very_long_text(spark):
    want, text = _library(), " ".join(f"word{i} is, in part; text" for i in range(60_000))  # 1.6 million characters
    docs = spark.createDataFrame([(1, text), (2, "y" * 300_000), (3, None)], "doc_id long, text string")
    assert rows(TC.count_tokens(docs), "doc_id", "n_tokens") == [(1, want(text)), (2, want("y" * 300_000)), (3, 0)]
