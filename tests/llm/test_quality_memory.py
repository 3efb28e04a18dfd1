"""Scoring: texts are taken a little at a time, and reach the workers once."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from routelytics.llm import quality_mil as Q


def _model():
    return Q.GatedAttention()


def test_features_are_computed_a_little_at_a_time(spark, monkeypatch):
    texts = [" ".join(f"word{(i * j) % 97}" for j in range(300)) for i in range(2000)] + [None, ""]  # about 4 MB
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    taken, sizes, real = [], [], Q.passage_features
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: taken.append(f) or self)
    monkeypatch.setattr(Q, "passage_features", lambda ts: sizes.append(sum(map(len, ts))) or real(ts))
    Q.score_quality(df, _model(), ["doc_id"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "_text"])
    got = np.concatenate([b.column("_score").to_numpy() for b in taken[0](iter([batch]))])
    assert sum(sizes) == sum(len(t or "") for t in texts) and max(sizes) < 1 << 20
    alone = np.concatenate([_model().score(*real([(t or "").encode()])) for t in texts])
    assert np.abs(got - alone).max() < 1e-9


def test_text_of_a_carried_row_is_sent_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some words here", "x"), (None, None, None), (3, "", "y")], "doc_id long, text string, source string")
    seen, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: seen.append(self.columns) or real(self, f, schema))
    monkeypatch.setattr(corpus_pipeline, "fit_quality", lambda docs, labels: _model())
    monkeypatch.setattr(corpus_pipeline, "QUALITY_THRESHOLD", 0.0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *a: labels)
    got = corpus_pipeline.quality_stage(spark, docs, "nowhere").collect()
    assert seen == [["row"]]
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
