"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import _words as W
from quarry.shipping import ship


SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91] = 65
SHAPE[97:123] = SHAPE[128:] = 97
SHAPE[48:58] = 48


def buckets(text: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all words, word pairs and word shapes, and the row of each.

    A pair of equal words is one pair, whatever the word. A shape has one letter for
    each of upper case, any other letter and digits, and all else as it stands.
    """
    words = W.Words(text, W.SPACED)
    n = words.counts()
    row = np.repeat(np.arange(len(n)), n)
    pair = W.grams(words.hash, 2)
    inside = row[1:] == row[:-1]
    same = words.hash[1:] == words.hash[:-1]
    pair = np.where(same, W.U64(2), pair) if len(pair) else pair
    shape = W.mix(W.Words(text, W.SPACED, SHAPE).hash ^ W.U64(1))
    mask = W.U64((1 << bits) - 1)
    found = np.concatenate((words.hash, pair[inside], shape)) & mask
    return found.astype(np.int64), np.concatenate((row, row[1:][inside], row))


class Model:
    """Weights of a logistic regression; a text is the sum of its buckets' weights over the root of their number."""

    def __init__(self, weights: np.ndarray, bias: float, bits: int):
        self.weights, self.bias, self.bits = weights.astype(np.float32), float(bias), bits

    def score(self, text: pa.Array) -> np.ndarray:
        at, row = buckets(text, self.bits)
        rows = len(text)
        count = np.bincount(row, minlength=rows)
        total = np.bincount(row, weights=self.weights[at], minlength=rows)
        z = self.bias + total / np.sqrt(np.maximum(count, 1))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train(texts: list[str | None], labels: list[int], *, bits: int = 20, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 1.0, seed: int = 1) -> Model:
    """Follow-the-regularised-leader (proximal), an example at a time, in seeded order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0

    def leader(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    examples = []
    for text, label in zip(texts, labels, strict=True):
        at, _ = buckets(pa.array([text], pa.string()), bits)
        at, count = np.unique(at, return_counts=True)
        examples.append((at.astype(np.int32), (count / np.sqrt(max(count.sum(), 1))).astype(np.float32), float(label)))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)).tolist():
            at, x, y = examples[i]
            w = leader(z[at], n[at])
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(bias + w @ x, -35, 35)))
            g = (p - y) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
            g = p - y
            step = (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha
            bias_z += g - step * bias
            bias_n += g * g
    return Model(leader(z, n), -bias_z / ((beta + np.sqrt(bias_n)) / alpha), bits)


def held_out(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = 4000, seed: int = 1,
) -> Model:
    """Train on at most sample labelled rows that are not held out: those with the smallest hashed ids.

    Labels other than 0 and 1, words among them, null labels and ids are ignored, as are
    labels whose id is none of the documents' kind; of repeated ids any row may serve. Without labelled rows the model scores everything 0.5. Only the sample
    reaches the driver.
    """
    known = labels.select(F.col(id_col).try_cast(docs.schema[id_col].dataType).alias("__id"), F.col(label_col).try_cast("int").alias("__y"))
    known = known.where(F.col("__y").isin(0, 1) & F.col("__id").isNotNull() & ~held_out("__id"))
    ids = docs.select(F.col(id_col).alias("__id")).where("__id is not null")
    picked = known.join(ids, "__id", "left_semi").dropDuplicates(["__id"]).orderBy(F.xxhash64(F.lit(seed), "__id"), "__id").limit(sample)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    chosen = {r["__id"]: r["__y"] for r in picked.collect()}
    if not chosen:
        return Model(np.zeros(2), 0.0, 1)
    few = docs.sparkSession.createDataFrame(list(chosen.items()), T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("__y", T.IntegerType())]))
    rows = texts.join(F.broadcast(few), "__id").toLocalIterator()
    seen: dict = {}
    for r in rows:
        key = (r["__id"], r["__text"] or "")
        if r["__id"] not in seen or key[1] < seen[r["__id"]][0]:
            seen[r["__id"]] = (key[1], r["__y"])
    ordered = [seen[i] for i in sorted(seen)]
    return train([t for t, _ in ordered], [y for _, y in ordered], seed=seed)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id_col, held_out, score, predicted (1 from threshold on) of every whole text.

    Null and empty texts are scored by the bias alone, null ids are hashed as an empty
    string, repeated rows have a row each, other columns are ignored.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            for a, b in W.chunks(text):
                scores = sent.value.score(text.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores)], names=["__id", "score"])

    scored = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, out)
    return scored.withColumnRenamed("__id", id_col).select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
