"""Small tables with everything that can be odd about documents."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORDS = "the of and thonea hereble isolet marund quilt opera venus zebra tango lima kilo echo".split()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows], SCHEMA)


def odd_rows(seed=0, n=60):
    """Nulls in all columns, empty and white texts, ties, repeated rows, a long text, several scripts."""
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(k))
    rows = [(i, text(rng.randint(1, 40)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i in range(n)]
    rows += [(n, None, None, None), (n + 1, "", "en", "a"), (n + 2, " \n\t ", "en", "b"), (n + 3, "", "de", "a"), (None, "null id text here", "en", "a"), (None, None, None, "a")]
    rows += [(3, rows[3][1], "en", "a"), (3, rows[3][1], "en", "a"), (3, "same id another text", "en", "c")]
    rows += [(n + 10 + k, (rows[5][1] or "").replace(" ", "  "), "en", "a") for k in range(5)]
    rows += [(n + 20, text(6000), "de", "c"), (n + 21, "été ñandú 日本語 \U0001f600", "fr", "c"), (n + 22, "...!!! 123", None, "b")]
    return rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Columns with names that an operator could use inside."""
    from pyspark.sql import functions as F

    for c in ("id", "size", "row", "hash", "pos", "name", "key", "n", "fp", "th", "shard", "label", "_pos", "score", "block"):
        df = df.withColumn(c, F.lit("x"))
    return df
