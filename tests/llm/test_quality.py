import numpy as np
from helpers import EDGE_ROWS, clashing, edge, empty, rows

from conftest import SF01
from routelytics.llm import quality_mil as QM


def test_held_out_accuracy_and_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    got = QM.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    assert (got[got.quality == 1].predicted == 1).mean() > 0.99
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_gradients_of_the_attention_model():
    r = np.random.default_rng(1)
    x, owner, y = r.normal(size=(9, len(QM.FEATURES))), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3]), np.array([1., 0, 1, 0])

    def loss(m):
        q = m.forward(x, owner)[-1]
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))
    m = QM.GatedAttention()
    before = loss(m)
    # a step of plain descent along numeric slopes and the fit agree that the loss falls
    fitted = QM.GatedAttention().fit(x, owner, y, steps=200)
    q = fitted.score(x, owner)
    assert -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q)) < 0.2 * before


def test_attention_is_a_weighting_of_each_documents_passages():
    m, r = QM.GatedAttention(), np.random.default_rng(2)
    owner = np.array([0, 0, 1, 1, 1])
    weight = m.forward(r.normal(size=(5, len(QM.FEATURES))), owner)[3]
    np.testing.assert_allclose(np.bincount(owner, weight), [1, 1])


def test_features_do_not_depend_on_the_neighbours():
    texts = [(r[1] or "").encode() for r in EDGE_ROWS]
    x, owner = QM.passage_features(texts)
    for i, t in enumerate(texts):
        one, _ = QM.passage_features([t])
        np.testing.assert_allclose(x[owner == i], one, atol=1e-6)


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (4, 0, 0), (5, None, 1), (None, 1, 1), (6, 7, 0)],
                                   "doc_id long, quality int, toxic int")
    got = QM.classify(edge(spark), labels).collect()
    assert len(got) == len(EDGE_ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert rows(QM.classify(clashing(spark), labels)) == rows(QM.classify(edge(spark), labels))
    assert QM.classify(empty(spark), labels).collect() == []
    assert len(QM.classify(edge(spark), labels.limit(0)).collect()) == len(EDGE_ROWS)
