"""Personal data by weak supervision, native.

Patterns propose candidate spans.  Labelers (format, checksum or range, gazetteer,
context, border) vote on each or abstain; expectation-maximisation over the counts of
vote patterns estimates how reliable each labeler is; a logistic span classifier is
trained on the resulting posteriors and decides over the candidates that are not
already certain by the base rules.  Finding, voting, counting and scoring are DataFrame
expressions; the driver sees the counts of vote patterns only (at most a few thousand,
whatever the corpus).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let

#: Candidate patterns, the base kinds first (their order is the order of kinds).  The
#: quantifiers are possessive where the next character cannot be part of the repeat, which
#: changes no match and keeps long runs off the matcher's stack; an e-mail starts where a
#: run of its characters starts or at the previous match's end, an address where a run of
#: digits starts, as a leftmost search would find.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_text": r"[A-Za-z0-9_+-]{2,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{2,64}+\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z]{2,10}+",
    "phone_local": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
BASE = ["email", "ip", "card", "phone"]
KINDS = list(PATTERNS)
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "email_text": "at", "phone": "+", "ip": "."}
#: Gazetteers and context words: fixed lists.
TOP_LEVEL = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|us"
COUNTRY_CODES = "1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CONTEXT = {"email": "mail|contact|write|address", "email_text": "mail|contact|write|address",
           "ip": "ip|host|server|address|login", "card": "card|visa|master|credit|pay",
           "phone": "call|phone|tel|fax|mobile|contact", "phone_local": "call|phone|tel|fax|mobile|contact",
           "national_id": "ssn|social|security|id|insurance", "iban": "iban|account|bank|konto|compte"}
AGAINST = r"version|isbn|page|figure|section|order|build|\bv\.?\s?$"
#: Parts of a text that are gone through at a time.
BLOCK = 512
LABELERS = ["format", "check", "gazetteer", "context", "border"]
MARK, END = "\x01", "\x02"


def candidates(text: Column) -> Column:
    """Array of (kind number, start, end, match, before, after) for all kinds, in code points."""
    clean = F.when(text.rlike("[\x01\x02]"), F.translate(text, MARK + END, "\x03\x03")).otherwise(text)

    def of(kind: str, clean: Column) -> Column:
        number = F.lit(KINDS.index(kind))

        def add(acc: Column, part: Column) -> Column:
            at = F.instr(part, END)
            match, rest = F.substring(part, F.lit(1), at - 1), F.substring(part, at + 1, F.length(part))
            end = acc["pos"] + F.length(match)
            span = F.struct(number.alias("k"), acc["pos"].alias("start"), end.alias("end"), match.alias("match"),
                            acc["tail"].alias("before"), F.substring(rest, 1, 1).alias("after"))
            return F.struct((end + F.length(rest)).alias("pos"), F.right(rest, F.lit(24)).alias("tail"),
                            F.when(at > 0, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

        kinds = "array<struct<k:int,start:bigint,end:bigint,match:string,before:string,after:string>>"
        def block(acc: Column, some: Column) -> Column:
            """The spans of a block of parts, as one array more: growing one array by every
            span would copy it as often."""
            none = F.struct(acc["pos"].alias("pos"), acc["tail"].alias("tail"), F.array().cast(kinds).alias("found"))
            return let(F.aggregate(some, none, add), lambda a: F.struct(
                a["pos"].alias("pos"), a["tail"].alias("tail"), F.concat(acc["found"], F.array(a["found"])).alias("found")))

        start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("tail"),
                         F.array().cast(f"array<{kinds}>").alias("found"))
        parts = F.split(F.regexp_replace(clean, PATTERNS[kind], f"{MARK}$0{END}"), MARK)
        need = clean.contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)
        if kind not in ("email", "email_text"):
            need = need & clean.rlike("[0-9]")
        # a digit run of a card candidate that is too short to be one is no candidate
        blocks = let(parts, lambda p: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda i: F.slice(p, i * BLOCK + 1, BLOCK)))
        found = F.flatten(F.aggregate(blocks, start, block, lambda a: a["found"]))
        if kind == "card":
            found = F.filter(found, lambda x: F.length(_digits(x["match"])).between(14, 19))
        return F.when(need, found).otherwise(F.array().cast(kinds))

    return let(clean, lambda c: F.concat(*[of(k, c) for k in KINDS]))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes(k: Column, match: Column) -> Column:
    """The base rules' checks; false for kinds that are not base kinds."""
    digits = _digits(match)
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return (F.when(k == 0, True).when(k == 1, match.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
            .when(k == 2, F.length(digits).between(14, 19) & F.call_function("luhn_check", digits))
            .when(k == 3, F.length(digits).between(10, 15)).otherwise(False))


def votes(x: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1, 0 or null for abstaining."""
    k, match, digits = x["k"], x["match"], _digits(x["match"])
    by = {n: i for i, n in enumerate(KINDS)}
    ok = {
        "format": F.when(k < len(BASE), passes(k, match))
        .when(k == by["phone_local"], match.rlike(r"^(\([2-9][0-9]{2}\) |[2-9][0-9]{2}([-. ]))[2-9][0-9]{2}[-. ]"))
        .when(k == by["national_id"], ~match.rlike("^(000|666|9..)-|-00-|-0000$")).otherwise(True),
        "check": F.when(k == by["card"], F.call_function("luhn_check", digits))
        .when(k == by["ip"], passes(k, match))
        .when(k == by["iban"], F.length(F.replace(match, F.lit(" "))).between(15, 34)),
        "gazetteer": F.when(k.isin(by["email"], by["email_text"]), match.rlike(f"(?i)(?:{TOP_LEVEL})$"))
        .when(k == by["phone"], match.rlike(rf"^\+(?:{COUNTRY_CODES})")).when(k == by["card"], digits.rlike("^[3-6]"))
        .when(k == by["ip"], ~match.rlike(r"^(?:0|127|255)\.")),
        "border": ~x["after"].rlike("[A-Za-z0-9]") & ~x["before"].rlike("[A-Za-z0-9]$"),
    }
    hint = F.lit(False)
    for kind, w in CONTEXT.items():
        hint = hint | ((k == by[kind]) & x["before"].rlike(f"(?i)(?:{w})"))
    ok["context"] = F.when(hint, True).when(x["before"].rlike(f"(?i)(?:{AGAINST})"), False)
    return {n: ok[n].cast("int") for n in LABELERS}


def fit_labelers(patterns: list[tuple], turns: int = 50) -> tuple[list[tuple], dict]:
    """Expectation-maximisation for (kind, votes, count): every pattern's posterior, and the
    reliabilities: per labeler the probabilities to vote 1 for personal data and for other."""
    post = [(sum(1 for v in vs if v == 1) + .5) / (sum(1 for v in vs if v is not None) + 1) for _, vs, _ in patterns]
    sure: dict = {}
    prior: dict = {}
    for _ in range(turns):
        for j in range(len(LABELERS)):
            one, zero = [1.0, 2.0], [1.0, 2.0]  # a weak prior: votes on personal data and on other
            for (_, vs, n), p in zip(patterns, post):
                if vs[j] is not None:
                    one[0] += n * p * vs[j]
                    one[1] += n * p
                    zero[0] += n * (1 - p) * vs[j]
                    zero[1] += n * (1 - p)
            # a labeler is taken to be no worse than chance, which fixes what the hidden classes mean
            sure[j] = (max(one[0] / one[1], .5), min(zero[0] / zero[1], .5))
        for kind in {k for k, _, _ in patterns}:
            own = [(n, p) for (k, _, n), p in zip(patterns, post) if k == kind]
            prior[kind] = (1 + sum(n * p for n, p in own)) / (2 + sum(n for n, _ in own))
        post = []
        for kind, vs, _ in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for j, v in enumerate(vs):
                if v is not None:
                    a, b = (min(max(x, 1e-3), 1 - 1e-3) for x in sure[j])
                    odds += math.log(a / b) if v else math.log((1 - a) / (1 - b))
            post.append(1 / (1 + math.exp(-max(min(odds, 50), -50))))
    return ([(k, vs, n, p) for (k, vs, n), p in zip(patterns, post)],
            {LABELERS[j]: v for j, v in sure.items()})


def _features(kind: int, vs: tuple) -> list[float]:
    return [float(kind == i) for i in range(len(KINDS))] + [0.0 if v is None else 2.0 * v - 1 for v in vs]


def fit_classifier(labelled: list[tuple], turns: int = 300, rate: float = 1.0, decay: float = 1e-3) -> list[float]:
    """Logistic regression of the posteriors on kind and votes, by gradient descent; patterns
    weigh by the logarithm of their counts, so that rare kinds are learned too."""
    w = [0.0] * (len(KINDS) + len(LABELERS))
    rows = [(_features(k, vs), p, math.log1p(n)) for k, vs, n, p in labelled]
    total = sum(r[2] for r in rows) or 1.0
    for _ in range(turns):
        grad = [decay * x for x in w]
        for x, p, n in rows:
            q = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
            for i, v in enumerate(x):
                if v:
                    grad[i] += n / total * (q - p) * v
        w = [a - rate * g for a, g in zip(w, grad)]
    return w


def find_pii(docs: DataFrame, threshold: float = 0.5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``id_col`` and pii, an array of (kind, start, end, base,
    score) in code points, end exclusive, by start, then kind.

    Spans that pass the base rules are all there, with score 1; a candidate that does not
    is added when the span classifier gives it ``threshold`` and it meets no base span.
    Added candidates of a base pattern that fails its check are called ``<kind>_like``.

    Null and empty texts have no spans; texts are searched whole; null and repeated ids and
    repeated rows each give a row; extra columns are ignored; an empty table, or one
    without candidates, gives no spans.  The control characters 1 and 2 count as any other
    character that no pattern holds.
    """
    s = Scratch(docs.sparkSession, "pii")
    found = s.table(docs.select(F.col(id_col).alias("_id"), candidates(
        F.coalesce(F.col(text_col), F.lit(""))).alias("c"), F.monotonically_increasing_id().alias("_row")), "candidates")
    each = found.filter(F.size("c") > 0).select("_row", F.explode("c").alias("x"))
    voted = s.table(each.select("_row", "x", passes(F.col("x.k"), F.col("x.match")).alias("base"),
                                *[v.alias(n) for n, v in votes(F.col("x")).items()]), "votes")
    patterns = [(r[0], tuple(r[1:-1]), r[-1]) for r in voted.groupBy(F.col("x.k").alias("k"), *LABELERS)
                .count().orderBy("k", *LABELERS).collect()]  # at most kinds x 3^labelers rows
    weights = fit_classifier(fit_labelers(patterns)[0])
    score = F.element_at(F.array(*[F.lit(x) for x in weights[:len(KINDS)]]), F.col("x.k") + 1)
    for n, w in zip(LABELERS, weights[len(KINDS):]):
        score = score + F.coalesce(2 * F.col(n) - 1, F.lit(0)) * F.lit(w)
    scored = voted.select("_row", F.struct(
        F.col("x.start"), F.col("x.k"), F.col("x.end"), "base",
        F.when(F.col("base"), 1.0).otherwise(1 / (1 + F.exp(-score))).alias("score")).alias("x")) \
        .filter(F.col("x.base") | (F.col("x.score") >= threshold))
    names = F.array(*[F.lit(k) for k in KINDS], *[F.lit(f"{k}_like") for k in BASE])

    def tidy(spans: Column) -> Column:
        sure = F.filter(spans, lambda x: x["base"])
        clear = F.filter(spans, lambda x: x["base"] | ~F.exists(
            sure, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
        return F.transform(clear, lambda x: F.struct(
            F.element_at(names, x["k"] + 1 + F.when(~x["base"] & (x["k"] < len(BASE)), len(KINDS)).otherwise(0)).alias("kind"),
            x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), x["score"].alias("score")))

    per = s.table(scored.groupBy("_row").agg(F.sort_array(F.collect_list("x")).alias("x"))  # one document's spans
                  .select("_row", let(F.col("x"), tidy).alias("pii")), "spans")
    empty = F.array().cast(per.schema["pii"].dataType)
    return found.select("_id", "_row").join(per, "_row", "left").select(
        F.col("_id").alias(id_col), F.coalesce("pii", empty).alias("pii"))
