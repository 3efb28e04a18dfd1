import re
from collections import Counter, defaultdict

from helpers import EDGE_ROWS, SCHEMA, clashing, edge, empty, rows

from conftest import SF001
from routelytics.llm.line_rules import line_rules

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed", "kept"]


def _brute(data, max_docs=10):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    plain = lambda x: " ".join(split(x.lower()))
    where = defaultdict(set)
    for r in data:
        for line in (r[1] or "").split("\n"):
            if split(line):
                where[(r[3], plain(line))].add(r[1] or "")
    out = []
    for r in data:
        t = r[1] or ""
        ws = split(t)
        lines = [x for x in t.split("\n") if split(x)]
        wins = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
        many = Counter(wins)
        covered = {i + k for i, w in enumerate(wins) if many[w] > 1 for k in range(3)}
        removed = sum(len(split(x)) for x in lines if len(where[(r[3], plain(x))]) > max_docs)
        failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
        out.append((r[0], len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)),
                    len(covered), failed, removed, not failed and len(ws) - removed >= 0.5 * len(ws)))
    return sorted(out, key=repr)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    assert rows(line_rules(docs, max_docs=2), *COLUMNS) == _brute([tuple(r) for r in docs.collect()], 2)


def test_frequent_lines_are_removed_per_host_and_copies_do_not_count(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    boiler = " ".join(f"b{k}" for k in range(70))
    data = [(i, f"{own(i)}\n  {boiler.upper()}", "en", "hot", 1) for i in range(30)]
    data += [(100 + i, f"{own(i)}\n{boiler}", "en", "cool", 1) for i in range(5)]      # below the limit on its host
    data += [(200 + i, own("copy"), "en", "hot", 1) for i in range(40)]                # one text many times
    data += [(300 + i, f"{own(300 + i)} {own(i)}\n{boiler}", "en", "hot", 1) for i in range(3)]  # more own than removed
    got = {r["doc_id"]: r for r in line_rules(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()}
    assert sorted((tuple(got[i][c] for c in COLUMNS) for i in got), key=repr) == _brute(data)
    assert not any(got[i]["kept"] for i in range(30))
    assert all(got[i]["kept"] for i in got if i >= 100)


def test_edges(spark):
    assert rows(line_rules(edge(spark)), *COLUMNS) == _brute(EDGE_ROWS)
    assert rows(line_rules(clashing(spark))) == rows(line_rules(edge(spark)))
    assert line_rules(empty(spark)).collect() == []


def test_plan_has_no_python(spark):
    plan = line_rules(edge(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
