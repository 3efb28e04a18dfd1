"""Quality rules of documents, native: counts per document and the frequency of lines
across the documents of a host.

Everything is DataFrame expressions.  Counts come from arrays within a row (no
shuffle of words); across documents only the hashes of lines travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, Scratch, let, words

SYMBOLS = "[#*$%&|<>]"


def repeated_words(ws: Column, window: int = 3) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in the text.

    Windows of words are compared as text, joined by blanks (which words never hold).
    Only a text with an equal pair is looked at more closely: its windows are sorted,
    those equal to a neighbour give their positions, and the words they cover are counted.
    """
    n = F.size(ws) - window + 1
    wins = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(ws, i, window), " "))

    def covered(win: Column) -> Column:
        placed = F.sort_array(F.transform(win, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def positions(p: Column) -> Column:
            last = F.size(p) - 1
            again = F.filter(p, lambda x, i: (
                (i > 0) & (F.get(p, i - 1)["w"] == x["w"])) | ((i < last) & (F.get(p, i + 1)["w"] == x["w"])))
            each = F.transform(again, lambda x: F.sequence(x["i"], x["i"] + window - 1))
            return F.size(F.array_distinct(F.flatten(each)))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), 0).otherwise(let(placed, positions))

    return F.when(n >= 2, let(wins, covered)).otherwise(0)


def normal_line(line: Column) -> Column:
    """A line for comparison across documents: lower case, single blanks, no ends."""
    return F.trim(F.regexp_replace(F.lower(line), f"[{WS}]+", " "))


def line_rules(docs: DataFrame, max_docs: int = 10, min_left: float = 0.5, min_words: int = 50,
               max_repeat: int = 50, host_col: str = "source", id_col: str = "doc_id",
               carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, n_removed (words in lines removed), kept.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat`` percent of
    them in repeated windows of three.  A line (normalised, with a word) that stands in
    more than ``max_docs`` distinct documents of its host is removed everywhere on that
    host; a document is kept if not ``base_failed`` and at least ``min_left`` of its words
    are in lines that remain.  Documents are distinct when their texts are: copies of a
    document do not make its lines frequent.

    Null text has no words; a null host is a host; null and repeated ids and repeated
    rows each give a row; extra columns are ignored (but for ``carry``, in a struct
    ``row``); an empty table gives an empty result.
    """
    spark = docs.sparkSession
    s = Scratch(spark, "lines")
    text = F.coalesce(F.col("text"), F.lit(""))
    row = [F.struct(*[F.col(c) for c in carry]).alias("row")] if carry else []
    per_word = let(words(F.col("text")), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        repeated_words(ws).cast("long").alias("n_repeat_words")))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS}]")), lambda ls: F.struct(
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        # normalised lines by hash, with the words each holds
        F.transform(ls, lambda x: let(normal_line(x), lambda y: F.struct(
            F.xxhash64(y).alias("h"), F.size(F.split(y, " ")).alias("n")))).alias("all")))
    stats = s.table(docs.select(
        F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), per_word.alias("w"), lines.alias("l"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.xxhash64(text).alias("_text"), F.monotonically_increasing_id().alias("_row"), *row), "stats")

    # each distinct text of a host once, each of its lines once; counts are partial before the shuffle
    one = stats.groupBy("_host", "_text").agg(F.min("_row").alias("_row"))
    each = stats.join(s.table(one.select("_row"), "distinct"), "_row", "left_semi").select(
        "_host", F.explode(F.array_distinct(F.col("l.all")["h"])).alias("h"))
    frequent = s.table(each.groupBy("_host", "h").agg(F.count(F.lit(1)).alias("n_docs"))
                       .filter(F.col("n_docs") > max_docs), "frequent")
    # a hot line's rows: pre-summed per document, then joined with a written table (split or broadcast by size)
    mine = stats.select("_row", "_host", F.explode("l.all").alias("x")).groupBy("_row", "_host", F.col("x.h").alias("h")) \
        .agg(F.sum("x.n").alias("n"))
    hit = (mine["h"] == frequent["h"]) & mine["_host"].eqNullSafe(frequent["_host"])
    removed = s.table(mine.join(frequent, hit, "left_semi").groupBy("_row").agg(
        F.sum("n").alias("n_removed")), "removed")
    out = stats.join(removed, "_row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))
    failed = (F.col("w.n_words") < min_words) | (100 * F.col("w.n_repeat_words") > max_repeat * F.col("w.n_words"))
    left = F.col("w.n_words") - F.col("n_removed") >= min_left * F.col("w.n_words")
    return out.select(
        F.col("_id").alias(id_col), "w.n_words", "w.word_chars", "n_symbols", F.col("l.n_dup_lines").alias("n_dup_lines"),
        "w.n_repeat_words", failed.alias("base_failed"), "n_removed", (~failed & left).alias("kept"),
        *(["row"] if carry else []))
