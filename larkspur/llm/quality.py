"""Quality classifier: supervised subword embeddings.

Each word and each character n-gram of a text is hashed to a learned vector;
so is each pair of neighbouring words, as equal or not, in two buckets of its
own (a word said twice is junk in any language, which no n-gram of given words
says). A document is the mean of its vectors, and a softmax layer gives the
classes. The vectors and the layer are trained together by stochastic gradient
descent in numpy, in one task, on a bounded sample of labelled rows
(``train_docs``, the rows of the smallest hashes of their ids); scoring reads
every whole text. At scoring, a vector only counts by its product with the
layer, so the model that comes back and is sent out is one number a bucket.

Defined cases: a null or empty text has no features and gets the score of the
bias; without labelled rows every score is 0.5. Labels other than 0 and 1 and
null labels are ignored, and a document with several labels counts with each
once. Of rows that share an id, the least text is learned from; all are scored.
Repeated rows give repeated rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, drop_encoders, frugal, give_back, id_bucket
from .grams import Words

BUCKETS = 1 << 18
GRAMS = (3, 4)
SCORE_BYTES = 1 << 18


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every feature of every text, and the text it is from."""
    w = Words(texts)
    hashes, docs = [(w.hash & np.uint64(BUCKETS - 1)).astype(np.uint32)], [w.doc]
    # the pair of a word and the one before it has two buckets behind the others
    ditto = np.full(len(w.doc), BUCKETS, np.uint32)
    ditto[1:] += (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    hashes.append(ditto)
    docs.append(w.doc)
    for n in GRAMS:
        h, d = w.chars(n)
        hashes.append(h & np.uint32(BUCKETS - 1))
        docs.append(d)
    return np.concatenate(hashes), np.concatenate(docs)


def train(texts: list[bytes], labels: np.ndarray, dim: int = 10, epochs: int = 4, rate: float = 0.1, seed: int = 5) -> tuple[np.ndarray, float]:
    """The learned weight of each bucket towards class 1, and the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS + 2, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    rows = []
    for t in texts:
        ids, n = np.unique(buckets([t])[0], return_counts=True)
        rows.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    epochs = max(epochs, min(100, -(-12_000 // max(1, len(rows)))))  # small samples need more passes
    steps, at = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            now = rate * (1 - at / steps)
            at += 1
            ids, share = rows[i]
            mean = share @ vectors[ids]
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ layer
            layer -= now * np.outer(p, mean)
            bias -= now * 0.1 * p
            # a mean of many vectors moves little: each moves by its share, scaled by their number
            vectors[ids] -= (now * share * min(len(ids), 200))[:, None] * back
    return vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0])


def score(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of class 1 for each text."""
    out = np.zeros(len(texts))
    at = 0
    while at < len(texts):
        until, held = at, 0
        while until < len(texts) and (held == 0 or held + len(texts[until]) <= SCORE_BYTES):
            held += len(texts[until]) + 1
            until += 1
        ids, docs = buckets(texts[at:until])
        n = np.maximum(np.bincount(docs, minlength=until - at), 1)
        out[at:until] = np.bincount(docs, weights=weights[ids], minlength=until - at) / n
        at = until
    return 1 / (1 + np.exp(-np.clip(out + bias, -50, 50)))


def fit(rows: DataFrame) -> tuple[np.ndarray, float]:
    """The weights and the bias learned from ``rows`` (_i, _y, _t), whose number
    is bounded, in one task; only the model comes to the driver."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        drop_encoders()
        pdf = pdf.sort_values(["_i", "_y"], ignore_index=True)
        texts, labels = [t.encode() for t in pdf["_t"]], pdf["_y"].to_numpy()
        del pdf
        weights, bias = train(texts, labels)
        del texts
        give_back()
        return pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()], "bias": [bias]})

    got = rows.groupBy(F.lit(0).alias("_all")).applyInPandas(run, "weights binary, bias double").collect()
    return (np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"]) if got else (np.zeros(BUCKETS + 2, np.float32), 0.0)


def classify(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    held_fold: int = 0,
    threshold: float = 0.3,
    train_docs: int = 6_000,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Of each row: its id, ``held_out``, ``score`` and ``predicted``, and the
    columns ``keep`` of ``df``.

    Labels are learned from rows whose crc32(id as text) modulo ``folds`` is
    not ``held_fold``, ``train_docs`` of them at most.
    """
    spark = df.sparkSession
    arrow_rows(spark)
    fold = id_bucket(id_col, folds)
    picked = labels.select(id_col, F.col(label_col).alias("_y")).where(F.col("_y").isin(0, 1) & (fold != held_fold) & F.col(id_col).isNotNull()).distinct()
    picked = picked.join(df.select(id_col).distinct(), id_col, "left_semi").orderBy(F.xxhash64(F.col(id_col)), id_col, "_y").limit(train_docs)
    # at most train_docs ids and labels are sent to every task, and as many texts to the one that learns
    found = df.select(id_col, text_col).join(F.broadcast(picked), id_col).groupBy(id_col, "_y").agg(F.min(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
    model = spark.sparkContext.broadcast(fit(found.select(F.col(id_col).cast("string").alias("_i"), F.col("_y").cast("int").alias("_y"), "_t")))
    id_type = df.schema[id_col].dataType.simpleString()

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = score([(t or "").encode() for t in batch.column(2).to_pylist()], *model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype("int32")), *batch.columns[3:]], names=[id_col, "held_out", "score", "predicted", *more])

    more = [c for c in keep if c != id_col]
    rows = df.select(id_col, (fold == held_fold).alias("held_out"), text_col, *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(more)])
    types = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in more)
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int{types}")
