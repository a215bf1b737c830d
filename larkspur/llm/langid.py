"""Language identification: a linear-chain conditional random field over words.

A text is taken as chains of at most ``CHAIN`` words. Each word has affix,
character n-gram and lexicon (whole word) features, hashed into a learned table
of one weight for each language; learned transitions tie neighbouring words.
The forward-backward recursion gives each word's probability of each language,
so text that switches language within a line is labelled word by word. A
document's language is the one with the largest sum over its words that have a
letter, and its score is that sum over their number.

It is trained in numpy by gradient ascent on the log-likelihood of chains made
of documents of known language, some joined from two languages so that the
transitions learn switches. The training rows are a bounded sample
(``train_docs`` for each language, by the smallest hashes of their ids); every
whole text is labelled.

Defined cases: a null text, or one without a letter, gets ``und`` and score 0;
so does every text if nothing could be learned. Ties go to the language that is
first by code point. Repeated rows give repeated rows. Rows with a null
language are never learned from. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, durable, frugal, id_bucket, join_small
from .grams import Words, mix64

CHAIN = 32
BUCKETS = 1 << 17
LABEL_BYTES = 1 << 20
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    """Whether there is a letter of any script."""
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def word_features(w: Words, at: np.ndarray) -> np.ndarray:
    """Buckets of the features of the words at the places ``at``: the word, its
    affixes of 1 to 4 bytes and its two middle n-grams; (words, features)."""
    padded = np.concatenate([np.zeros(4, np.uint8), w.data, np.zeros(4, np.uint8)]).astype(np.uint64)
    s, e = w.start[at] + 4, w.end[at] + 4
    size = e - s
    feats = [w.hash[at]]
    pre, suf = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for k in range(4):
        has = size > k
        pre = np.where(has, pre * np.uint64(257) + padded[np.minimum(s + k, len(padded) - 1)] + np.uint64(1), pre)
        suf = np.where(has, suf * np.uint64(257) + padded[np.maximum(e - 1 - k, 0)] + np.uint64(1), suf)
        feats += [mix64(pre + np.uint64(1000 + k)), mix64(suf + np.uint64(2000 + k))]
    for k, place in ((3000, s + size // 3), (3001, s + size // 2)):
        h = np.zeros(len(at), np.uint64)
        for i in range(3):
            h = h * np.uint64(257) + padded[np.minimum(place + i, e)] + np.uint64(1)
        feats.append(mix64(h + np.uint64(k)))
    return (np.stack(feats, 1) & np.uint64(BUCKETS - 1)).astype(np.int64)


def letters(w: Words) -> np.ndarray:
    """Whether each word has an ASCII letter or a byte beyond ASCII."""
    d = w.data
    own = ((d | 32) >= 97) & ((d | 32) <= 122) | (d >= 128)
    sums = np.concatenate([[0], np.cumsum(own)])
    return sums[w.end] > sums[w.start]


def chains(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(chain, place) for each word: words of a text, ``CHAIN`` at a time."""
    n = len(w.doc)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.searchsorted(w.doc, w.doc, "left")
    place = np.arange(n) - first
    new = place % CHAIN == 0
    return np.cumsum(new) - 1, place % CHAIN


def forward_backward(emit: np.ndarray, mask: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (chains, CHAIN, L), and expected counts of moves (L, L), of
    chains with emission weights ``emit``; places without ``mask`` are empty."""
    c, t, n = emit.shape
    e = np.exp(emit - emit.max(2, keepdims=True))
    a, b = np.exp(move), np.ones((c, n))
    f = np.empty((c, t, n))
    f[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        x = (f[:, i - 1] @ a) * e[:, i]
        f[:, i] = np.where(mask[:, i, None], x / x.sum(1, keepdims=True), f[:, i - 1])
    gamma, pairs = np.empty_like(f), np.zeros((n, n))
    gamma[:, t - 1] = f[:, t - 1]
    for i in range(t - 1, 0, -1):
        on = mask[:, i]
        eb = e[:, i] * b
        joint = f[:, i - 1] * (eb @ a.T)
        z = np.where(on, joint.sum(1), 1.0)
        pairs += (f[:, i - 1] * (on / z)[:, None]).T @ eb * a
        nb = eb @ a.T
        b = np.where(on[:, None], nb / nb.sum(1, keepdims=True), b)
        g = f[:, i - 1] * b
        gamma[:, i - 1] = g / g.sum(1, keepdims=True)
    return gamma, pairs


def train(texts: list[bytes], labels: np.ndarray, n: int, epochs: int = 3, batch: int = 64, rate: float = 0.5, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The weights (BUCKETS, n) and the moves (n, n)."""
    rng = np.random.default_rng(seed)
    w = Words(texts)
    feats = word_features(w, np.arange(len(w.doc)))
    truth = labels[w.doc] if len(w.doc) else np.zeros(0, int)
    first = np.searchsorted(w.doc, np.arange(len(texts) + 1))
    # a chain is a run of words of one document, or the halves of two documents
    runs = [np.arange(s, min(s + CHAIN, first[d + 1])) for d in range(len(texts)) for s in range(first[d], first[d + 1], CHAIN)]
    full = [r for r in runs if len(r) == CHAIN]
    mixed = [np.concatenate([full[i][: CHAIN // 2], full[j][: CHAIN // 2]]) for i, j in zip(rng.permutation(len(full))[: len(full) // 4], rng.permutation(len(full)))]
    runs += mixed
    weights, move = np.zeros((BUCKETS, n)), np.zeros((n, n))
    square = np.full(BUCKETS, 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(runs))
        for k in range(0, len(order), batch):
            some = [runs[i] for i in order[k : k + batch]]
            ids, mask = np.zeros((len(some), CHAIN), np.int64), np.zeros((len(some), CHAIN), bool)
            for i, r in enumerate(some):
                ids[i, : len(r)], mask[i, : len(r)] = r, True
            f = feats[ids]
            emit = weights[f].sum(2) * mask[:, :, None]
            gamma, pairs = forward_backward(emit, mask, move)
            y = np.eye(n)[truth[ids]]
            g = (y - gamma) * mask[:, :, None] / len(some)
            flat = f[mask]
            grads = np.stack([np.bincount(flat.ravel(), np.repeat(g[mask][:, c], flat.shape[1]), BUCKETS) for c in range(n)], 1)
            square += (grads**2).sum(1)
            weights += rate * grads / np.sqrt(square)[:, None]
            seen = np.einsum("cti,ctj->ij", y[:, :-1] * mask[:, 1:, None], y[:, 1:])
            move += 0.05 * (seen - pairs) / len(some)
    return weights, move


def label(texts: list[bytes], weights: np.ndarray, move: np.ndarray) -> np.ndarray:
    """For each text the sum of each language's probability over its words that
    have a letter, and the number of these; (texts, L + 1)."""
    n = weights.shape[1]
    out = np.zeros((len(texts), n + 1))
    at = 0
    while at < len(texts):
        until, held = at, 0
        while until < len(texts) and (held == 0 or held + len(texts[until]) <= LABEL_BYTES):
            held += len(texts[until]) + 1
            until += 1
        w = Words(texts[at:until])
        if len(w.doc):
            _, one, back = np.unique(w.hash, return_index=True, return_inverse=True)
            emit_of = np.zeros((len(one), n))
            for f in word_features(w, one).T:
                emit_of += weights[f]
            chain, place = chains(w)
            emit, mask = np.zeros((chain[-1] + 1, CHAIN, n)), np.zeros((chain[-1] + 1, CHAIN), bool)
            emit[chain, place], mask[chain, place] = emit_of[back], True
            gamma = forward_backward(emit, mask, move)[0][chain, place]
            own = letters(w)
            for c in range(n):
                out[at:until, c] = np.bincount(w.doc[own], gamma[own, c], until - at)
            out[at:until, n] = np.bincount(w.doc[own], minlength=until - at)
        at = until
    return out


def identify(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 4,
    held_fold: int = 2,
    train_docs: int = 200,
) -> DataFrame:
    """Of each row: its id, ``held_out``, ``lang_pred`` and ``score``.

    Languages are learned from rows whose crc32(id as text) modulo ``folds`` is
    not ``held_fold``, ``train_docs`` at most of each language.
    """
    spark = df.sparkSession
    arrow_rows(spark)
    fold = id_bucket(id_col, folds)
    # the smallest hashes of each language, by partial sorted top lists in every task
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold != held_fold)).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_l"), F.xxhash64(F.col(id_col)).alias("_h"))
    cut = durable(known.groupBy("_l").agg(F.count(F.lit(1)).alias("_n")))
    near = join_small(known, cut, ["_l"]).where((F.col("_h") / F.lit(float(1 << 63)) + 1) / 2 <= F.lit(3.0 * train_docs) / F.col("_n"))
    picked = near.withColumn("_k", F.row_number().over(Window.partitionBy("_l").orderBy("_h", "_id"))).where(F.col("_k") <= train_docs).select("_id", "_l").distinct()
    picked = durable(picked)
    # of rows that share an id and a language, the least text is learned from
    found = join_small(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_l")), picked, ["_id", "_l"]).where("_t is not null")
    got = found.groupBy("_id", "_l").agg(F.min("_t").alias("_t")).toArrow().sort_by([("_id", "ascending"), ("_l", "ascending")])
    texts, langs = [t.encode() for t in got.column("_t").to_pylist()], got.column("_l").to_pylist()
    names = sorted(set(langs))
    weights, move = train(texts, np.array([names.index(x) for x in langs]), len(names)) if names else (np.zeros((BUCKETS, 0)), np.zeros((0, 0)))
    model = spark.sparkContext.broadcast((weights, move, names))
    id_type = df.schema[id_col].dataType.simpleString()

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, move, names = model.value
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if names:
                sums = label(texts, weights, move)
                for i, row in enumerate(sums):
                    if row[-1] and has_letter(texts[i]):
                        best = int(row[:-1].argmax())
                        pred[i], score[i] = names[best], min(1.0, row[best] / row[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred), pa.array(score)], names=[id_col, "held_out", "lang_pred", "score"])

    rows = df.select(id_col, (fold == held_fold).alias("held_out"), text_col)
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, held_out boolean, lang_pred string, score double")
