"""The registered queries of the operators, with their DuckDB SQL where SQL can
state them.  Each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as ED
from . import langid_crf as LI
from . import lexical_search as LS
from . import line_rules as LR
from . import mixing as MX
from . import packing as PK
from . import pii as PI
from . import prefix_trie as PT
from . import quality_mil as QM
from . import secrets as SE
from . import simhash as SH
from . import token_counts as TC
from . import warc as WA

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


@query("op1_packing")
def op1_packing(spark, sf):
    """Best-fit packing of all documents into sequences of 4,096 tokens."""
    return PK.pack(_read(spark, sf, "documents"))


@query("op2_exact_dedup", r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (
  SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER w AS rn FROM n WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM g""")
def op2_exact_dedup(spark, sf):
    """Content-sort deduplication of all documents."""
    return ED.exact_dedup(_read(spark, sf, "documents"))


@query("op5_mixing", r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         sha256('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r
  FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((r - 1) % 3 + 1)::INT]::DOUBLE AS wt FROM s),
o AS (
  SELECT *, row_number() OVER (ORDER BY 2 * source_size / wt, r) AS i,
         1.5 * (sum(source_size) OVER ())::DOUBLE AS budget,
         (sum(2 * source_size) OVER (ORDER BY 2 * source_size / wt, r))::DOUBLE - 2 * source_size AS capped,
         sum(wt) OVER () - (sum(wt) OVER (ORDER BY 2 * source_size / wt, r) - wt) AS free
  FROM w),
lv AS (SELECT (budget - capped) / free AS level FROM o WHERE wt * ((budget - capped) / free) <= 2 * source_size
       ORDER BY i LIMIT 1),
t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, wt * (SELECT level FROM lv)) AS target FROM o),
c AS (
  SELECT d.*, t.source_size, t.target,
         (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS sent
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY (copy * source_size + sent) / target, source NULLS LAST, k, doc_id, copy
                                       ROWS UNBOUNDED PRECEDING) AS upto
  FROM c, (VALUES (0), (1)) e(copy) WHERE size > 0),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM q WHERE upto <= (SELECT sum(target) FROM t) GROUP BY doc_id)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(k.taken, 0) AS taken
FROM c LEFT JOIN k ON c.doc_id = k.doc_id""")
def op5_mixing(spark, sf):
    """Weighted fair queueing of all documents."""
    return MX.mix(_read(spark, sf, "documents")).drop("row_hash")


def _joined(spans):
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


@query("op3_language")
def op3_language(spark, sf):
    """The language of all documents, learned from the rows that are not held out."""
    return LI.identify(_read(spark, sf, "documents"))


@query("op4_quality")
def op4_quality(spark, sf):
    """Quality scores of all documents, learned from the labels that are not held out."""
    return QM.classify(_read(spark, sf, "documents"), _read(spark, sf, "labels"))


def _count(spans, kind: str):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query("op6_pii")
def op6_pii(spark, sf):
    """Personal data in all documents; counts and digest of the base spans, spans of all."""
    found = PI.find_pii(_read(spark, sf, "documents"))
    base = F.filter("pii", lambda x: x["base"])
    n = [_count(base, k) for k in PI.BASE]
    return found.select("doc_id", *n, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))


@query("op7_secrets")
def op7_secrets(spark, sf):
    """Secrets in all documents; counts and digest of the base kinds, spans of all."""
    found = SE.find_secrets(_read(spark, sf, "documents"))
    base = [r.name for r in SE.BASE]
    n = [_count(F.col("secrets"), k) for k in base]
    return found.select("doc_id", *n, F.sha2(_joined(F.filter(
        "secrets", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


@query("op8_simhash")
def op8_simhash(spark, sf):
    """Near-duplicate components of all documents: 4-word shingles, 4 bits."""
    return SH.simhash_components(_read(spark, sf, "documents")).drop("component", "text_hash")


@query("op9_line_rules", r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, list_aggregate(ws[i:i + 2], 'string_agg', ' ') AS w
  FROM d, unnest(range(1, len(ws) - 1)) r(i) WHERE len(ws) >= 3),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM rep, unnest([0, 1, 2]) e(k) GROUP BY doc_id),
ln AS (
  SELECT doc_id, source, t, raw, trim(regexp_replace(lower(raw), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line
  FROM d, unnest(string_split(t, chr(10))) u(raw) WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
fr AS (SELECT source, line FROM ln GROUP BY ALL HAVING count(DISTINCT t) > 10),
rm AS (
  SELECT doc_id, sum(len(string_split(ln.line, ' ')))::BIGINT AS n FROM ln
  WHERE EXISTS (SELECT 1 FROM fr WHERE fr.line = ln.line AND fr.source IS NOT DISTINCT FROM ln.source) GROUP BY doc_id),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT raw))::BIGINT AS n FROM ln GROUP BY doc_id),
b AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(length(list_aggregate(ws, 'string_agg', '')), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words, coalesce(rm.n, 0) AS n_removed
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN rm USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_removed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed >= 0.5 * n_words AS kept FROM b""")
def op9_line_rules(spark, sf):
    """Quality rules and cross-document line frequency of all documents."""
    return LR.line_rules(_read(spark, sf, "documents"))


@query("op10_warc", r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keep FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to FROM k""")
def op10_warc(spark, sf):
    """Write all pages as WARC bundles, then read the archives back."""
    out, index = WA.write_archives(_read(spark, sf, "pages"))
    return WA.read_archives(index, out).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op12_token_counts")
def op12_token_counts(spark, sf):
    """Tokens of all whole documents, huge ones in overlapping chunks."""
    return TC.count_tokens(_read(spark, sf, "documents"))


@query("op13_lexical_search", r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
q AS (SELECT item_id, t, count(*)::BIGINT AS times FROM i GROUP BY ALL),
v AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM d GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM v GROUP BY doc_id),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM len),
w AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM v, c WHERE t IN (SELECT t FROM q) GROUP BY t, docs),
m AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // total AS m FROM len, c),
s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN v USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""")
def op13_lexical_search(spark, sf):
    """The ten best of all documents for every benchmark item, by dual trees."""
    return LS.search(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"))


@query("op11_prefix_trie", r"""
WITH o AS (
  SELECT conv_id AS c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, list(t ORDER BY pos) AS ts,
         xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda r, z: xor(r >> 1, 3988292384::BIGINT * (r & 1))))) % 6 AS h
  FROM o GROUP BY c),
re AS (
  SELECT a.c, list_concat(coalesce(b.ts[1:a.h], []), a.ts[a.h + 1:]) AS ts
  FROM own a LEFT JOIN own b ON b.c = a.c - a.c % 100),
path AS (SELECT c, len(ts) AS n, d, ts[1:d] AS k, coalesce(length(ts[d].text), 0) AS cp FROM re, unnest(range(0, len(ts) + 1)) u(d)),
node AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, any_value(cp) AS cp, max(n) = d AS leaf,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
         FROM path GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
sub AS (
  SELECT a.k, a.d, sum(b.leaf::INT) AS n_leaves, sum((b.n_convs - 1) * b.cp) AS saved_tokens
  FROM path a JOIN node b ON b.conv_id = a.c AND b.d >= a.d GROUP BY a.k, a.d)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM node n JOIN sub s ON s.k = n.k AND s.d = n.d LEFT JOIN kids ON kids.k = n.k
LEFT JOIN node p ON n.d > 0 AND p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]""")
def op11_prefix_trie(spark, sf):
    """The prefix trie of all rebuilt conversations."""
    return PT.prefix_trie(_read(spark, sf, "conversations"))
