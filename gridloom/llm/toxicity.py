"""Toxicity: logistic regression over character n-grams scaled by naive Bayes log-count ratios.

A feature is a hashed n-gram that a text has or hasn't. Its value is the log-ratio of its smoothed shares of toxic and
of other training texts; n-grams whose ratio is within what chance gives (in standard errors) are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import ngrams
from gridloom.llm.common import bounded_batches, documents, held_out, labels, materialize

ORDERS = (4, 5)
BITS = 18
#: Least log-count ratio in standard errors; and so many of the strongest features at least.
LEAST_ERRORS = 4.0
LEAST_FEATURES = 256
#: Training takes about so many labelled rows at most, drawn by a hash of their ids.
TRAIN_ROWS = 12_000
ROUNDS = 150
RATE = 0.02
PENALTY = 1e-4
THRESHOLD = 0.3
SEED = 5


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        found = ngrams.presence_sums(texts, ORDERS, BITS, self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(found, -60, 60)))


def training_rows(docs: DataFrame, label_rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """y and text of labelled rows that aren't held out: all, or about `rows` of them by a hash of the id. Of several
    labels of an id the larger counts; null labels don't. Of rows that repeat both id and text one counts; different
    texts of one id count each."""
    usable = label_rows.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    usable = usable.groupBy(F.col(id_col).alias("__gl_id")).agg(F.max(label_col).alias("__gl_y"))
    there = usable.count()
    if there > rows:
        usable = usable.where(F.pmod(F.xxhash64(F.lit(SEED), F.col("__gl_id")), F.lit(1_000_000)) < int(rows / there * 1_000_000))
    usable = materialize(usable)
    # About `rows` ids; twice that can't come from the hash, but is checked.
    side = F.broadcast(usable) if usable.count() <= 2 * rows else usable
    return docs.join(side, F.col(id_col) == F.col("__gl_id")).select(F.col("__gl_y").cast("int").alias("y"), F.col(text_col).cast("string").alias("text"), "__gl_id").dropDuplicates().drop("__gl_id")


def fit(y: np.ndarray, row: np.ndarray, feature: np.ndarray, ratio: np.ndarray) -> Model:
    """Full-batch gradient descent with adaptive steps; row and feature list the features that rows have."""
    share = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    w, bias, size = np.zeros(len(ratio)), np.log(share / (1 - share)), len(y)
    m, v, mb, vb = np.zeros(len(ratio)), np.zeros(len(ratio)), 0.0, 0.0
    value = ratio[feature]
    for k in range(1, ROUNDS + 1) if size and 0 < y.sum() < size else ():
        miss = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[feature] * value, minlength=size) + bias, -60, 60))) - y
        grad = np.bincount(feature, weights=miss[row] * value, minlength=len(ratio)) / size + PENALTY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * miss.mean(), 0.999 * vb + 0.001 * miss.mean() ** 2
        one, two = 1 - 0.9**k, 1 - 0.999**k
        w -= RATE * (m / one) / (np.sqrt(v / two) + 1e-8)
        bias -= RATE * (mb / one) / (np.sqrt(vb / two) + 1e-8)
    return Model((w * ratio).astype(np.float32), float(bias))


def train(docs: DataFrame, label_rows: DataFrame, rows: int = TRAIN_ROWS, **columns) -> Model:
    """The driver gets a row for each bucket with its counts, then the few kept features of each training row. Without
    labels, or with those of one class only, every text gets the share of label 1 as its score."""
    bounded_batches(docs.sparkSession)
    sample = materialize(training_rows(docs, label_rows, rows=rows, **columns))

    def count(batches):
        for batch in batches:
            y = np.array(batch["y"].to_pylist())
            own = ngrams.present(batch["text"].to_pylist(), ORDERS, BITS, np.ones(1 << BITS, bool))
            both = [np.bincount(np.concatenate([np.zeros(0, np.int64), *[x for x, t in zip(own, y, strict=True) if t == side]]), minlength=1 << BITS) for side in (0, 1)]
            at = np.flatnonzero(both[0] + both[1])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(both[0][at]), pa.array(both[1][at])], ["bucket", "clean", "toxic"])

    sizes = sample.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    found = sample.mapInArrow(count, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    p, q = np.ones(1 << BITS), np.ones(1 << BITS)
    p[found["bucket"]] += found["toxic"]
    q[found["bucket"]] += found["clean"]
    ratio = np.log(p / (sizes["toxic"] + 2)) - np.log(q / (sizes["n"] - sizes["toxic"] + 2))
    errors = np.abs(ratio) / np.sqrt(1 / p + 1 / q) * ((p > 1) | (q > 1))
    kept = (errors >= min(LEAST_ERRORS, np.sort(errors)[-LEAST_FEATURES])) & (errors > 0)

    def keep(batches):
        for batch in batches:
            own = ngrams.present(batch["text"].to_pylist(), ORDERS, BITS, kept)
            yield pa.RecordBatch.from_arrays([batch["y"], pa.array([x.tolist() for x in own], pa.list_(pa.int32()))], ["y", "features"])

    rows_ = sample.mapInArrow(keep, "y int, features array<int>").toArrow()
    features = rows_["features"].to_pylist()
    row = np.repeat(np.arange(len(features)), [len(x) for x in features]).astype(np.int64)
    feature = np.array([f for x in features for f in x], np.int64)
    return fit(np.array(rows_["y"].to_pylist(), float), row, feature, ratio)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the score after them: the probability of label 1; a column of docs that has the name (in any case) is
    replaced. Null and empty texts get the score of a text without any feature. Equal texts get equal scores."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.bias))
    own = [c for c in docs.columns if c.lower() != out.lower()]

    def run(batches):
        model = Model(*shared.value)
        for batch in batches:
            value = model.score(batch[batch.num_columns - 1].to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(value, pa.float64())], [*own, out])

    bounded_batches(spark)
    fed = docs.select(*own, F.col(text_col).cast("string").alias("__gl_text"))
    return fed.mapInArrow(run, T.StructType([*[docs.schema[c] for c in own], T.StructField(out, T.DoubleType())]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, a row for each row of documents; see train() and score() for odd rows."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = score(docs, train(docs, labels(spark, sf_dir)))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
