import random
import re
import time

from helpers import EDGE_ROWS, clashing, edge, empty, rows

from routelytics.llm import pii as PI

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in match.split(".")),
            "card": 14 <= len(digits) <= 19 and _luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def base_spans(text):
    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(PATTERNS.items())
             for m in re.finditer(p, text or "") if _passes(k, m.group())]
    return [(k, a, b) for a, _, k, b in sorted(found)]


FRAGMENTS = ["a@b.co", "x", "@", ".", "foo.bar@baz.qux", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111",
             "4111-1111-1111-1111", "4111111111111112", "+1 (171) 555-2028", "+", " ", "-", "5", "é", "\x01", "\x02", "\n",
             "(555) 234-5678", "123-45-6789", "joe [at] site [dot] com", "call ", "a+b@c-d.e+f@g.h", "\U0001f600"]


def test_base_spans_against_backtracking_search(spark):
    r = random.Random(3)
    data = [(i, "".join(r.choice(FRAGMENTS) for _ in range(r.randint(0, 12)))) for i in range(3000)]
    data += [(-1, None), (-2, "1 " * 30000), (-3, "a@b" + ".c" * 30000), (-4, "x" * 100000), (-5, "+1" + "(" * 30000)]
    got = PI.find_pii(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
    texts = dict(data)
    for row in got:
        assert [(x["kind"], x["start"], x["end"]) for x in row["pii"] if x["base"]] == base_spans(texts[row["doc_id"]])


def test_added_spans_are_personal_data_and_meet_no_base_span(spark):
    clean = [(i, f"order {i} of 2{i % 10} items, version 1.{i}.0.{i}.7 page 12") for i in range(50)]
    data = clean + [(100, "call (555) 234-5678 now"), (101, "write to joe [at] site [dot] com"), (102, "+1 (555) 234-5678"),
                    (103, "mail joe@site.com or ann@site.org"), (104, "server 10.1.2.3"), (105, "card 4111 1111 1111 1111")]
    got = {r["doc_id"]: r["pii"] for r in PI.find_pii(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [x["kind"] for x in got[100]] == ["phone_local"]
    assert [x["kind"] for x in got[101]] == ["email_text"]
    assert [x["kind"] for x in got[102]] == ["phone"]
    for spans in got.values():
        for x in spans:
            assert x["base"] or not any(y["base"] and y["start"] < x["end"] and x["start"] < y["end"] for y in spans)


def test_em_finds_the_reliable_labelers():
    r = random.Random(1)
    from collections import Counter
    counts = Counter()
    for _ in range(4000):
        y = r.random() < 0.4
        rates = [(.95, .05), (.9, .1), (.55, .45), (.8, .2), (.6, .5)]
        counts[(0, tuple(int(r.random() < (a if y else b)) for a, b in rates))] += 1
    labelled, sure = PI.fit_labelers([(k, v, n) for (k, v), n in sorted(counts.items())])
    assert sure["format"][0] > .9 and sure["format"][1] < .1 and sure["gazetteer"][0] < .65
    weights = PI.fit_classifier(labelled)[len(PI.KINDS):]
    assert weights[0] > weights[2] and weights[1] > weights[4]


def test_edges(spark):
    got = PI.find_pii(edge(spark)).collect()
    assert len(got) == len(EDGE_ROWS)
    assert rows(PI.find_pii(clashing(spark))) == rows(PI.find_pii(edge(spark)))
    assert PI.find_pii(empty(spark)).collect() == []


def test_plan_has_no_python(spark):
    plan = PI.find_pii(edge(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_long_runs_of_digits(spark):
    data = [(1, "7" * 1_000_000), (2, "3." + "7" * 1_000_000), (3, "1." * 200_000), (4, "7" * 500_000 + ".1.2.3 10.1.2.3")]
    t0 = time.time()
    got = {r.doc_id: [(x["kind"], x["start"], x["end"]) for x in r.pii if x["base"]] for r in PI.find_pii(
        spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()}
    assert got[1] == got[2] == [] and got[4] == [("ip", 500_007, 500_015)]
    assert got[3] == [("ip", 8 * i, 8 * i + 7) for i in range(50_000)]
    assert time.time() - t0 < 120
