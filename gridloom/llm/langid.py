"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import ngrams
from gridloom.llm.common import bounded_batches, documents, held_out

ORDERS = (1, 2, 3)
BITS = 16
SMOOTHING = 0.5
#: Training takes about so many labelled rows at most, drawn by a hash of their ids.
TRAIN_ROWS = 12_000
UNKNOWN = "und"
SEED = 9


class Model:
    """languages, in code point order; table: log-probabilities, buckets x languages; prior: log-priors."""

    def __init__(self, languages: list[str], table: np.ndarray, prior: np.ndarray):
        self.languages, self.table, self.prior = languages, table, prior

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The index of each text's language and its posterior probability."""
        found, _ = ngrams.sums(texts, ORDERS, BITS, self.table)
        found += self.prior
        found = np.exp(found - found.max(axis=1, keepdims=True))
        found /= found.sum(axis=1, keepdims=True)
        return found.argmax(axis=1), found.max(axis=1)


def labelled_sample(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> DataFrame:
    """Labelled rows that aren't held out: all, or about `rows` of them by a hash of the id."""
    usable = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col))
    there = usable.count()
    if there > rows:
        usable = usable.where(F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col)), F.lit(1_000_000)) < int(rows / there * 1_000_000))
    return usable


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Counts n-grams by language over the sample; what reaches the driver is a row for each language and bucket."""
    sample = labelled_sample(docs, id_col, lang_col, rows).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        for batch in batches:
            langs, texts = np.array(batch["lang"].to_pylist(), object), batch["text"].to_pylist()
            for lang in sorted(set(langs)):
                found = ngrams.counts([texts[i] for i in np.flatnonzero(langs == lang)], ORDERS, BITS)
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at])], ["lang", "bucket", "n"])

    bounded_batches(docs.sparkSession)
    found = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    shares = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    languages = sorted(shares, key=lambda x: x.encode())
    table = np.full((1 << BITS, len(languages)), SMOOTHING)
    for k, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        table[own["bucket"], k] += own["n"]
    table = np.log(table) - np.log(table.sum(axis=0)) if languages else table
    return Model(languages, table.astype(np.float32), np.log(np.array([shares[x] for x in languages], float) / max(1, sum(shares.values()))))


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its posterior probability after them; columns of docs that have the names in
    `out` (in any case) are replaced.

    A null text, one without letters, and every text if nothing could be learned give `und` with score 0. Equal texts
    get equal results. Ties go to the language that comes first in code point order.
    """
    spark = docs.sparkSession
    # A row for each bucket, a column for each language of the training rows, of which there are a bounded number.
    shared = spark.sparkContext.broadcast((model.languages, model.table, model.prior))
    own = [c for c in docs.columns if c.lower() not in [x.lower() for x in out]]

    def score(batches):
        model = Model(*shared.value)
        for batch in batches:
            texts = batch[batch.num_columns - 2].to_pylist()
            readable = np.array(batch[batch.num_columns - 1].to_pylist(), bool) & bool(model.languages)
            lang, value = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            at = np.flatnonzero(readable)
            if len(at):
                best, values = model.predict([texts[i] for i in at])
                lang[at], value[at] = np.array(model.languages, object)[best], values
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(lang, pa.string()), pa.array(value, pa.float64())], [*own, *out])

    bounded_batches(spark)
    text = F.col(text_col).cast("string")
    fed = docs.select(*own, text.alias("__gl_text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__gl_readable"))
    return fed.mapInArrow(score, T.StructType([*[docs.schema[c] for c in own], T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())]))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told, with all their columns: those that identify() doesn't call `und`. So null
    texts and texts without letters go, and everything if there is nothing to learn from.

    The posterior isn't a reason to let a document go: summed over all n-grams it is near 1 for any text."""
    found = identify(docs, train(docs), out=("__gl_lang", "__gl_score"))
    return found.where(F.col("__gl_lang") != UNKNOWN).select(*docs.columns)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, a row for each row of documents; see identify() for nulls, empties and ties."""
    docs = documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
