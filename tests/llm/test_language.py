import numpy as np
from helpers import EDGE_ROWS, clashing, edge, empty, rows

from conftest import SF01
from routelytics.llm import langid_crf as LI


def _plain(model, scores):
    """Posteriors by enumeration-free textbook forward-backward in logarithms."""
    n, m = scores.shape
    f, b = np.zeros((n, m)), np.zeros((n, m))
    f[0] = scores[0]
    for i in range(1, n):
        f[i] = scores[i] + np.logaddexp.reduce(f[i - 1][:, None] + model.trans, axis=0)
    for i in range(n - 2, -1, -1):
        b[i] = np.logaddexp.reduce(model.trans + scores[i + 1] + b[i + 1], axis=1)
    x = f + b
    return np.exp(x - np.logaddexp.reduce(x, axis=1)[:, None])


def test_chunked_posteriors_are_exact():
    r, model = np.random.default_rng(0), LI.Crf(["a", "b", "c"])
    model.trans = r.normal(size=(3, 3))
    sizes = [1, 5, 300, 2, 128, 129, 700]
    scores = 2 * r.normal(size=(sum(sizes), 3))
    start = np.zeros(sum(sizes), bool)
    start[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = True
    got, at = model.posteriors(scores, start), 0
    for n in sizes:
        np.testing.assert_allclose(got[at:at + n], _plain(model, scores[at:at + n]), atol=1e-9)
        at += n


def test_held_out_accuracy_and_code_switching(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = LI.fit_language(docs)
    assert model.languages == ["de", "en", "es", "fr"]
    got = LI.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null").toPandas()
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()
    mixed = "the of and that was with is onthe die der und nicht ist ein keitung sch the and of with"
    words = LI.label_words(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first().words
    assert [w.lang for w in words[:6]] == ["en"] * 6 and [w.lang for w in words[9:13]] == ["de"] * 4


def test_fit_learns_transitions_that_favour_staying(spark):
    model = LI.fit_language(spark.read.parquet(f"{SF01}/documents.parquet"), per_language=20)
    off = model.trans[~np.eye(4, dtype=bool)]
    assert np.diag(model.trans).min() > off.max()


def test_edges(spark):
    model = LI.Crf(["de", "en"])
    model.bias[1] = 1.0
    got = LI.identify(edge(spark), model).collect()
    assert len(got) == len(EDGE_ROWS)
    blank = {3, 4, 5}
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in blank or False) for r in got if r["doc_id"] is not None)
    assert sum(r["lang_pred"] == "und" for r in got if r["doc_id"] is None) == 1
    assert rows(LI.identify(clashing(spark), model)) == rows(LI.identify(edge(spark), model))
    assert LI.identify(empty(spark)).collect() == []
    one = LI.identify(edge(spark).withColumn("lang", LI.F.lit("xx")))
    assert {r["lang_pred"] for r in one.collect()} == {"xx", "und"}
    none = LI.identify(edge(spark).withColumn("lang", LI.F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in none.collect()} == {("und", 0.0)}


def test_all_sampled_words_count_in_the_fit(monkeypatch):
    chains, marginals = [], LI.Crf._marginals
    monkeypatch.setattr(LI.Crf, "_marginals", lambda self, s: chains.append(len(s)) or marginals(self, s))
    few = [(i % 2, [b"ab" if i % 2 else b"cd"] * 24) for i in range(1000)]
    LI.Crf(["a", "b"]).fit(few, steps=1)
    assert sum(chains) == 1000
    chains.clear()
    LI.Crf(["a", "b"]).fit(few * 20, steps=1)      # 480,000 words
    assert sum(chains) == 10_000 and max(chains) <= 4000


def test_rows_are_chosen_by_hash_whatever_the_tasks(spark):
    from pyspark.sql import functions as F
    from routelytics.llm.langid_crf import choose_rows, held_out
    # 500 tasks; one id that a third of the rows repeat; a language with few ids, repeated
    ids = spark.range(0, 30_000, 1, 500).select(
        F.when(F.col("id") % 3 == 0, 12).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 1000 == 7, "rare").when(F.col("id") % 7 == 0, None).otherwise("en").alias("lang"))
    few = spark.range(0, 6000, 1, 20).select((F.when(F.col("id") < 5900, 40_000).otherwise(F.col("id") + 40_000)).alias("doc_id"), F.lit("few").alias("lang"))
    docs = ids.unionByName(few).withColumn("_h", F.lit("clash"))
    got = {}
    for r in choose_rows(docs, 20).collect():
        got.setdefault(r.lang, []).append((r._r, r.doc_id))
    rows_ = docs.filter("lang IS NOT NULL").filter(~held_out(F.col("doc_id"), 5, 0)).select(
        "lang", "doc_id", F.xxhash64("doc_id", F.lit("lang")).alias("h")).distinct().collect()
    for lang in ("en", "rare", "few"):
        want = [i for _, i in sorted((r.h, r.doc_id) for r in rows_ if r.lang == lang)[:20]]
        assert [i for _, i in sorted(got[lang])] == want
