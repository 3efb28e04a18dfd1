import re
from collections import Counter, defaultdict

import corpus_pipeline as CP
import pytest
from helpers import EDGE_ROWS, SCHEMA, Union, edge, empty
from test_mixing import _brute as mixed
from test_packing import _direct, _layout
from test_simhash import _fingerprint

from conftest import SF001
from routelytics.llm import quality_mil as QM


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output over a small table, written and read as the pipeline does."""
    base, out = tmp_path_factory.mktemp("pipeline"), []
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for k, (name, stage) in enumerate(CP.STAGES):
        stage(spark, docs, SF001).write.parquet(f"file://{base}/{k}")
        after = spark.read.parquet(f"file://{base}/{k}")
        out.append((docs, after))
        docs = after
    return out


def _tuples(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality_stage(spark, stages):
    before, after = stages[0]
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    model = QM.fit_quality(before, labels)
    want = Counter(t for t in _tuples(before) if model.score(*QM.passage_features([(t[1] or "").encode()]))[0] >= 0.7)
    assert Counter(_tuples(after)) == want
    clean = {r.doc_id for r in labels.collect() if r.quality == 1}
    left = {t[0] for t in _tuples(after)}
    assert len(clean & left) >= 0.97 * len(clean)


def test_exact_dedup_stage(stages):
    before, after = (_tuples(x) for x in stages[1])
    groups = defaultdict(list)
    for t in before:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t[1] or "")].append(t)
    assert Counter(after) == Counter(min(g, key=lambda t: (-len(t[1] or ""), t[0])) for g in groups.values())


def test_simhash_stage(stages):
    before, after = (_tuples(x) for x in stages[2])
    fps, u = [_fingerprint(t[1]) for t in before], Union(len(before))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                u.join(i, j)
    groups = defaultdict(list)
    for i, t in enumerate(before):
        groups[u.find(i)].append(t)
    assert Counter(after) == Counter(min(g) for g in groups.values())


def test_mixing_stage(stages):
    before, after = (_tuples(x) for x in stages[3])
    want = Counter()
    for t, (_, size, _, _, taken) in zip(before, mixed(before)):
        if taken:
            want[t] += taken // size
    assert Counter(after) == want


def test_packing_stage(stages):
    before, after = stages[4]
    got = after.collect()
    want = Counter((t[0], *p) for t in _tuples(before) for p in _direct(t[1], 4096))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    _layout(got, 4096)


def test_run_is_the_stages_one_after_the_other(spark, stages):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = Counter(tuple(r) for r in CP.run(spark, SF001).select(cols).collect())
    assert got == Counter(tuple(r) for r in stages[-1][1].select(cols).collect())


def test_stages_survive_edges_and_empty_tables(spark):
    for name, stage in CP.STAGES:
        stage(spark, edge(spark), SF001).collect()
        assert stage(spark, empty(spark), SF001).collect() == []
    # rows alike in all columns: dedup stages keep one, the mix may repeat them, nothing is lost
    twice = spark.createDataFrame([EDGE_ROWS[0]] * 3 + [(None, "n " * 60, "en", "a", 1)] * 2, SCHEMA)
    assert CP.exact_dedup_stage(spark, twice, SF001).count() == 2
    assert CP.simhash_stage(spark, twice, SF001).count() == 2
    extra = edge(spark).withColumn("_h", CP.F.lit(1)).withColumn("row", CP.F.lit("r")).withColumn("_n", CP.F.lit(2))
    for name, stage in CP.STAGES[:-1]:
        assert stage(spark, extra, SF001).columns == extra.columns
