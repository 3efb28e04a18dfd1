import hashlib
import re
from collections import Counter, defaultdict

import pytest
from helpers import EDGE_ROWS, SCHEMA, clashing, edge, empty, rows

from routelytics.llm.exact_dedup import exact_dedup


def _norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def _check(data, got):
    groups = defaultdict(list)
    for r in data:
        groups[_norm(r[1])].append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    keep = {k: None if min(v)[1] else min(v)[2] for k, v in groups.items()}
    want = Counter((r[0], keep[_norm(r[1])], len(groups[_norm(r[1])]),
                    hashlib.sha256(_norm(r[1]).encode()).hexdigest()) for r in data)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(
        hashlib.sha256(k.encode()).hexdigest() for k in groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_edges_against_brute_force(spark):
    _check(EDGE_ROWS, exact_dedup(edge(spark)).collect())


@pytest.mark.parametrize("partitions", ["3", "37"])
def test_groups_that_span_blocks(spark, partitions):
    data = [(i, "same text " + " " * (i % 3), "en", "a", 1) for i in range(600)]
    data += [(1000 + i, f"text {i % 40}" + " tail" * (i % 2), "en", "a", 1) for i in range(300)]
    data += [(2000 + i, "z" * 500 + str(i % 7), "en", "a", 1) for i in range(50)]  # long common beginnings
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        _check(data, exact_dedup(spark.createDataFrame(data, SCHEMA).repartition(8)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_empty_clashing_and_carried_columns(spark):
    assert exact_dedup(empty(spark)).collect() == []
    assert rows(exact_dedup(clashing(spark))) == rows(exact_dedup(edge(spark)))
    df = clashing(spark)
    kept = exact_dedup(df, carry=df.columns).filter("kept").select("row.*")
    assert kept.columns == df.columns and kept.count() == len({_norm(r[1]) for r in EDGE_ROWS})
