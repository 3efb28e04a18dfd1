"""Small inputs that every operator must survive."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "the and of that " * 6000

EDGE_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43),
    (2, "The quick brown  fox\tjumps over the lazy dog", "en", "a", 45),
    (2, "The quick brown  fox\tjumps over the lazy dog", "en", "a", 45),   # a repeated row
    (2, "another text under a repeated id", "en", "b", 10),
    (3, None, "fr", None, None),
    (4, "", None, "b", 0),
    (5, " \t\n\x0b\x0c\r ", "de", "b", 7),
    (None, "a text without an id", "en", "a", 3),
    (None, "a text without an id", "en", "a", 3),
    (None, None, None, None, None),
    (6, "é è ü ß 漢字 \U0001f600 straße", "de", "c", 3),
    (7, "x" * 70_000, "en", "a", 70_000),
    (8, LONG, "en", "a", len(LONG)),
    (9, "\x00\x01\x02 control", "en", "a", 3),
    (10, "one", "en", "c", 3),
]

#: Names that clash with what the operators use inside.
CLASHING = ["_id", "_row", "_norm", "_sha", "_block", "_run", "_h", "_n", "row", "piece", "size", "score", "kept",
            "fp", "root", "component_id", "taken", "target", "sequence_id", "offset", "_score", "_text", "pii", "secrets"]


def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark):
    from pyspark.sql import functions as F
    return edge(spark).select("*", *[F.lit("clash").alias(c) for c in CLASHING])


def rows(df, *columns):
    """Rows as sorted tuples, nulls included."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


class Union:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)
