"""Language-model scoring with a log-bilinear model over words, trained in numpy
by noise-contrastive estimation.

The vocabulary holds the most frequent words of the training part, ``VOCABULARY``
times the root of its tokens, so it grows with the corpus; every other word
is in one of ``SHAPES`` groups by its last two bytes, so that any word, seen or
not, has a place. A vector predicted from the two tokens before, the sum of two
learned matrices times their vectors, is multiplied with the vectors of classes
and of the words in a class:

    p(w | u, v) = p(k(w) | u, v) * p(w | k(w), u, v).

The most frequent words, the groups and the end token are classes of their own;
the rest of the vocabulary is dealt to classes of equal size by the words that
stand before (medians along principal directions), as many classes as words in
each, so that a token costs the root of the vocabulary. Within a group a word has
its add-one share (c(w) + 1) / (N_k + V_k + 1), with one further place for unseen
words. Both factors are normalised by batched matrix products, so the
probabilities of all tokens sum to 1.

Both factors are trained by noise-contrastive estimation, with unigram noise, on
every trigram of the training part. A start is trained in one task on trigrams
drawn by hashes of text and place, ``DRAWS`` times the root of the tokens, which also
deal the classes. From it each task goes on with all trigrams of its rows, in
batches that share their noise, and the tasks' vectors are averaged, each by how
often the task saw what it stands for. A training part that is drawn whole is
trained on in one task.

A logit of a class is a sum of what either token before gives to it, so its power is a
product, and a token's sum over all classes is the product of two rows of a table of
powers; only rare tokens before, beyond a bounded table, are compared with all classes.

Counts of words are kept in a table; the ``top`` most frequent short words (a
bounded table) are looked up in each task, and only the other words of a
document are joined with the table of counts, so a hot word of at most
``TOP_BYTES`` bytes is never shuffled, and a longer one once a document.

Defined cases: a null or empty text is its end token alone; a null id is in the
training part; without training documents all counts are 0 and classes are
equally likely. Repeated rows are separate documents. Only the named columns
are read.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import chain, repeat
from math import ceil, log10, sqrt
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, by_bytes, durable, frugal, give_back, id_bucket

#: Groups of words outside the vocabulary.
SHAPES = 63
#: Words of the vocabulary, and drawn trigrams, for each root of a training token.
VOCABULARY, DRAWS = 2.0, 400.0
#: Frequent words that are classes of their own.
SINGLE = 128
#: Words by which what stands before a word is told apart.
MARKS = 512
#: Distinct words that a task counts before it passes them on.
COUNT_WORDS = 500_000
TOP_WORDS = 300_000
TOP_BYTES = 64
#: Texts that are looked into for each one that as many trigrams as are drawn would fill.
TEXTS = 4
#: Tokens that a task mixes, those of a step, those that share their noise, and how
#: many noise classes these have; noise words that the tokens of a class share in a step.
MIXED, STEP, SHARE, CLASS_NOISE, WORD_NOISE = 1 << 17, 1 << 13, 512, 32, 16
#: Tasks that train, for each core at most, tokens of each at least, about; rows of a
#: model that are averaged together.
TRAINERS, TASK_TOKENS, MODEL_ROWS = 4, 500_000, 4_096
#: Tokens that are compared with all classes at once; bytes of a table of powers.
ROWS, POWER_BYTES = 1_024, 32 << 20
#: Tokens of a class that are multiplied together in training.
CHUNK = 16
#: Bytes of text whose tokens are scored together, about.
SCORE_BYTES = 1 << 18


def _shape_table() -> np.ndarray:
    pairs = np.arange(1 << 16, dtype=np.uint32)
    x = pairs * np.uint32(0x9E3779B1)
    return ((x ^ (x >> np.uint32(15))) % np.uint32(SHAPES)).astype(np.int32)


_TABLE = _shape_table()


def word_shape(word: bytes) -> int:
    """The group of a word by its last two bytes."""
    return int(_TABLE[word[-1] << 8 | (word[-2] if len(word) > 1 else 0)])


def token_numbers(texts: list[bytes], places: Mapping[bytes, int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Numbers of all tokens of lower-case texts, each text's end token last; the
    text of each; each word's place in ``places``, -1 if none; the words. A word of
    a place below ``size`` has its place as number; then come the groups and the end."""
    split = [t.split() for t in texts]
    per = np.array([len(w) for w in split], np.int64)
    words = list(chain.from_iterable(split))
    at = np.fromiter(map(places.get, words, repeat(-1)), np.int32, len(words))
    number = at.copy()
    far = np.flatnonzero((at < 0) | (at >= size))
    if len(far):
        length = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum(length)[far] - 1
        before = np.where(length[far] > 1, data[np.maximum(end - 1, 0)], 0)
        number[far] = size + _TABLE[data[end].astype(np.int32) << 8 | before]
    last = np.cumsum(per + 1) - 1
    out = np.full(len(words) + len(texts), size + SHAPES, np.int32)
    inner = np.ones(len(out), bool)
    inner[last] = False
    out[inner] = number
    return out, np.repeat(np.arange(len(texts)), per + 1), at, words


def number_is_word(number: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each token is a word, no end."""
    out = np.ones(len(number), bool)
    out[:-1] = owner[1:] == owner[:-1]
    out[-1:] = False
    return out


def contexts(number: np.ndarray, owner: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens before each one, the end token before the first."""
    one, two = np.full_like(number, end), np.full_like(number, end)
    same = owner[1:] == owner[:-1]
    one[1:][same] = number[:-1][same]
    two[2:][same[1:] & same[:-1]] = number[:-2][same[1:] & same[:-1]]
    return two, one


def _counts(df: DataFrame, text_col: str) -> DataFrame:
    """(``word``, ``c``): the counts of all words of the texts."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])
            words.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                words.update((t or "").encode().lower().split())
                if len(words) > COUNT_WORDS:
                    yield flush()
        yield flush()

    return durable(df.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")))


@dataclass
class Model:
    """Vectors of contexts (``near``, ``far``: already multiplied with the two
    matrices), of classes and of the words in classes of several; ``share`` of
    each number is its class; ``members`` are the words of class ``first`` + i."""

    near: np.ndarray
    far: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    words: np.ndarray
    word_bias: np.ndarray
    share: np.ndarray
    first: int
    members: list[np.ndarray]
    #: vectors, matrices and the sums of squared gradients, to train on from
    state: list[np.ndarray] | None = None
    #: what ``powers`` gives, once asked for
    _powers: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def guess(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        return self.near.take(one, 0) + self.far.take(two, 0)

    def powers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The powers of all classes' logits as products: exp of what the token before
        gives to them, exp of what the one before that gives, and each number's row in
        both; -1 for a rare one beyond ``POWER_BYTES`` and for powers that a float
        might not hold. A token's sum over classes is then the product of two rows."""
        if self._powers is None:
            n, last = len(self.near), SHAPES + 1
            fit = max(last, POWER_BYTES // (4 * len(self.out)))
            # the most frequent words come first, the groups and the end last
            kept = np.arange(n) if n <= fit else np.concatenate([np.arange(fit - last), np.arange(n - last, n)])
            one, two = self.near[kept] @ self.out.T + self.bias, self.far[kept] @ self.out.T
            fine = np.maximum(np.abs(one).max(1), np.abs(two).max(1)) < 40
            row = np.full(n, -1, np.int32)
            row[kept[fine]] = np.arange(fine.sum())
            self._powers = np.exp(one[fine]), np.exp(two[fine]), row
        return self._powers

    def _picked(self, q: np.ndarray, table: np.ndarray, shift: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log of the share of row ``at`` of each in a softmax over a table."""
        got = np.einsum("nd,nd->n", q, table.take(at, 0)) + shift[at]
        z = q @ table.T
        z += shift
        with np.errstate(over="ignore"):
            np.exp(z, out=z)
            total = z.sum(1)
        # only where a float cannot hold the sum are logits shifted before they are raised
        far = np.flatnonzero(~((total > 1e-30) & (total < 1e38)))
        if len(far):
            z = q[far] @ table.T + shift
            top = z.max(1)
            got[far] -= top
            total[far] = np.exp(z - top[:, None]).sum(1)
        return got - np.log(total)

    def log10(self, two: np.ndarray, one: np.ndarray, number: np.ndarray) -> np.ndarray:
        """log10 p of each token, of a group's place for a word outside the vocabulary."""
        near, far, row = self.powers()
        k = self.share[number]
        got = np.empty(len(k))
        v, u = row[one], row[two]
        held = (v >= 0) & (u >= 0)
        at, rest = np.flatnonzero(held), np.flatnonzero(~held)
        at = at[_sorted(v[at], len(near))]
        # so many at once as a processor's cache holds
        for s in range(0, len(at), ROWS):
            part = at[s : s + ROWS]
            x, y, here = near.take(v[part], 0), far.take(u[part], 0), (np.arange(len(part)), k[part])
            got[part] = np.log(x[here] * y[here] / np.einsum("nk,nk->n", x, y))
        for s in range(0, len(rest), ROWS):
            part = rest[s : s + ROWS]
            got[part] = self._picked(self.guess(two[part], one[part]), self.out, self.bias, k[part])
        many = np.flatnonzero((k >= self.first) & (k < self.first + len(self.members)))
        order = many[_sorted(k[many], len(self.out))]
        q, w = self.guess(two[order], one[order]), number[order]
        cuts = np.searchsorted(k[order], np.arange(self.first, self.first + len(self.members) + 1))
        more = np.empty(len(order))
        for i in np.flatnonzero(np.diff(cuts)):
            own = self.members[i]
            words, bias = self.words.take(own, 0), self.word_bias[own]
            for s in range(cuts[i], cuts[i + 1], ROWS):
                e = min(s + ROWS, cuts[i + 1])
                more[s:e] = self._picked(q[s:e], words, bias, np.searchsorted(own, w[s:e]))
        got[order] += more
        return got / np.log(10)


def deal(two: np.ndarray, one: np.ndarray, number: np.ndarray, size: int, single: int) -> list[np.ndarray]:
    """The words from ``single`` to ``size`` in classes of equal size, by the words
    before them: halves by the median along one principal direction after another."""
    n = size - single
    if n <= 0:
        return []
    classes = max(1, int(sqrt(n)))
    seen = np.zeros((n, MARKS), np.float32)
    at = np.flatnonzero((number >= single) & (number < size))
    for before in (one, two):
        np.add.at(seen, (number[at] - single, before[at] % MARKS), np.float32(1))
    seen = np.sqrt(seen)
    seen /= np.maximum(np.sqrt((seen * seen).sum(1, keepdims=True)), 1e-6)
    seen -= seen.mean(0)
    depth = max(1, ceil(np.log2(classes)))
    axes = np.linalg.eigh(seen.T @ seen)[1][:, ::-1][:, :depth]
    place = seen @ axes
    parts = [(np.arange(n), classes)]
    for d in range(depth):
        new = []
        for ids, k in parts:
            if k < 2:
                new.append((ids, k))
                continue
            ids = ids[np.argsort(place[ids, d], kind="stable")]
            cut = len(ids) * (k // 2) // k
            new += [(ids[:cut], k // 2), (ids[cut:], k - k // 2)]
        parts = new
    return [np.sort(ids) + single for ids, _ in parts if len(ids)]


def _sorted(at: np.ndarray, n: int) -> np.ndarray:
    """The stable order of places below ``n``; two-byte places are sorted in linear time."""
    return np.argsort(at.astype(np.uint16) if n <= 1 << 16 else at, kind="stable")


def _spread(rows: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of ``rows`` of the same place, and these places."""
    order = _sorted(at, n)
    sorted_at = at[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_at[1:] != sorted_at[:-1]]))
    count = np.diff(starts, append=len(at))
    out = rows.take(order[starts], 0)
    # a row that is alone needs no sum
    several = count > 1
    if several.any():
        count, held = count[several], order[np.repeat(several, count)]
        out[several] = np.add.reduceat(rows.take(held, 0), np.cumsum(count) - count, 0)
    return out, sorted_at[starts]


def train(two: np.ndarray, one: np.ndarray, number: np.ndarray, size: int, dim: int = 24, noise: int = 12, batch: int = 2048, passes: int = 2, rate: float = 0.12, seed: int = 3) -> Model:
    """The model of drawn trigrams, for a vocabulary of ``size`` words."""
    rng = np.random.default_rng(seed)
    n, end = size + SHAPES + 1, size + SHAPES
    single = min(SINGLE, size)
    members = deal(two, one, number, size, single)
    share = np.arange(n)
    for i, own in enumerate(members):
        share[own] = single + i
    share[size:] = single + len(members) + np.arange(SHAPES + 1)
    classes = single + len(members) + SHAPES + 1
    local, width = np.zeros(n, np.int64), np.zeros(classes, np.int64)
    for i, own in enumerate(members):
        local[own], width[single + i] = np.arange(len(own)), len(own)
    freq = np.bincount(number, minlength=n) + 1.0
    per = np.bincount(share, weights=freq, minlength=classes)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    vectors, mixes = draw(n, dim), np.stack([np.eye(dim, dtype=np.float32)] * 2)
    out, words = draw(classes, dim), draw(n, dim)
    bias = np.log(per / per.sum()).astype(np.float32)
    word_bias = np.log(freq / per[share]).astype(np.float32)
    squares = [np.full(x.shape, 1e-2, np.float32) for x in (vectors, mixes, out, bias, words, word_bias)]
    log_class, log_word = np.log(noise * per / per.sum()).astype(np.float32), np.log(noise * freq / per[share]).astype(np.float32)
    until = np.cumsum(per) / per.sum()
    # the words of a class of several stand side by side, by which noise is drawn within it
    flat = np.concatenate(members) if members else np.zeros(0, np.int64)
    begin = np.zeros(classes, np.int64)
    begin[single : single + len(members)] = np.cumsum([0, *[len(m) for m in members]])[:-1]
    inside = np.cumsum(freq[flat]) if len(flat) else np.zeros(1)
    floor = np.concatenate([[0.0], inside])

    def move(k: int, at: np.ndarray | None, g: np.ndarray, x: np.ndarray) -> None:
        if at is None:
            squares[k] += g * g
            x += rate * g / np.sqrt(squares[k])
        else:
            g, at = _spread(g, at, len(x))
            squares[k][at] += g * g
            x[at] += rate * g / np.sqrt(squares[k][at])

    def contrast(q: np.ndarray, ids: np.ndarray, table: np.ndarray, shift: np.ndarray, log_noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = table[ids]
        logit = np.einsum("bd,bkd->bk", q, rows) + shift[ids] - log_noise[ids]
        slope = -1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        slope[:, 0] += 1
        return slope, np.einsum("bk,bkd->bd", slope, rows), (slope[:, :, None] * q[:, None, :]).reshape(-1, q.shape[1])

    for _ in range(passes if len(number) else 0):
        order = rng.permutation(len(number))
        for s in range(0, len(order), batch):
            u, v, w = (x[order[s : s + batch]] for x in (two, one, number))
            q = vectors[v] @ mixes[0] + vectors[u] @ mixes[1]
            k = share[w]
            ids = np.concatenate([k[:, None], np.minimum(np.searchsorted(until, rng.random((len(w), noise))), classes - 1)], 1)
            slope, back, moved = contrast(q, ids, out, bias, log_class)
            move(2, ids.ravel(), moved, out)
            move(3, ids.ravel(), slope.ravel(), bias)
            many = np.flatnonzero(width[k] > 1)
            if len(many):
                b, c = begin[k[many]], width[k[many]]
                low, high = floor[b], floor[b + c]
                wrong = np.searchsorted(inside, low[:, None] + rng.random((len(many), noise)) * (high - low)[:, None], "right")
                wrong = flat[np.clip(wrong, b[:, None], (b + c - 1)[:, None])]
                ids = np.concatenate([w[many][:, None], wrong], 1)
                slope, more, moved = contrast(q[many], ids, words, word_bias, log_word)
                move(4, ids.ravel(), moved, words)
                move(5, ids.ravel(), slope.ravel(), word_bias)
                back[many] += more
            g = np.stack([vectors[v].T @ back, vectors[u].T @ back])
            move(0, np.concatenate([v, u]), np.concatenate([back @ mixes[0].T, back @ mixes[1].T]), vectors)
            move(1, None, g / len(w), mixes)
    return Model(vectors @ mixes[0], vectors @ mixes[1], out, bias, words, word_bias, share, single, members, [vectors, mixes, *squares])


class Trainer:
    """Training of a model on, by batches whose tokens share their noise; ``freq``
    are the counts of all numbers in the whole training part."""

    RATE = 0.06

    def __init__(self, lm: Model, freq: np.ndarray, seed: int = 3) -> None:
        vectors, mixes, *squares = lm.state
        self.lm, self.rng = lm, np.random.default_rng(seed)
        # the two matrices one above the other, biases as last columns
        self.tables = [vectors.copy(), mixes.reshape(-1, mixes.shape[2]).copy(), np.column_stack([lm.out, lm.bias]), np.column_stack([lm.words, lm.word_bias])]
        self.squares = [squares[0].copy(), squares[1].reshape(self.tables[1].shape).copy(), np.column_stack(squares[2:4]), np.column_stack(squares[4:6])]
        freq = freq + 1.0
        self.per = np.bincount(lm.share, weights=freq, minlength=len(lm.out))
        self.until = np.cumsum(self.per) / self.per.sum()
        self.log_class = np.log(CLASS_NOISE * self.per / self.per.sum()).astype(np.float32)
        self.log_word = np.log(WORD_NOISE * freq / self.per[lm.share]).astype(np.float32)
        # the words of a class of several stand side by side, by which noise is drawn within it
        width = np.zeros(len(lm.out), np.int64)
        width[lm.first : lm.first + len(lm.members)] = [len(own) for own in lm.members]
        self.width, self.begin = width, np.cumsum(width) - width
        self.flat = np.concatenate([np.zeros(0, np.int64), *lm.members])
        self.until_word = np.concatenate([[0.0], np.cumsum(freq[self.flat])])
        #: how often each number was a token, and stood before one
        self.seen, self.before = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)

    def _move(self, k: int, at: np.ndarray | slice, g: np.ndarray) -> None:
        squares = self.squares[k][at]
        squares += g * g
        self.squares[k][at] = squares
        self.tables[k][at] += self.RATE * g / np.sqrt(squares)

    def _right(self, q: np.ndarray, k: int, right: np.ndarray, log_noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What flows back into ``q`` from each token's own row, and into that row."""
        own = self.tables[k].take(right, 0)
        up = np.einsum("nd,nd->n", q, own) - log_noise[right]
        up = (1 / (1 + np.exp(np.clip(up, -30, 30))))[:, None]
        return up * own[:, :-1], up * q

    def _wrong(self, q: np.ndarray, k: int, wrong: np.ndarray, log_noise: np.ndarray, groups: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """The same from noise that all of a group of ``q`` share."""
        noise = self.tables[k].take(wrong, 0)
        noise[..., -1] -= log_noise[wrong]
        noise = noise[groups]
        down = q @ -noise.transpose(0, 2, 1)
        # beyond the largest float the slope is nothing
        with np.errstate(over="ignore"):
            np.exp(down, out=down)
        down += 1
        np.divide(-1, down, out=down)
        return down @ noise[..., :-1], down.transpose(0, 2, 1) @ q

    def step(self, two: np.ndarray, one: np.ndarray, number: np.ndarray) -> None:
        vectors, mixes = self.tables[:2]
        lm, n, dim = self.lm, len(number), len(mixes) // 2
        k = lm.share[number]
        order = _sorted(k, len(self.per))
        pairs, w, k = np.stack([one, two], 1)[order].ravel(), number[order], k[order]
        before = vectors.take(pairs, 0).reshape(n, 2 * dim)
        # room for as many tokens in each block; the last column meets the biases
        blocks = -(-n // SHARE)
        q = np.zeros((-(-n // blocks) * blocks, dim + 1), np.float32)
        q[:n, :-1] = before @ mixes
        q[:n, -1] = 1
        back = np.zeros((len(q), dim), np.float32)
        back[:n], moved = self._right(q[:n], 2, k, self.log_class)
        # the tokens stand by their classes
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        out = np.zeros_like(self.tables[2])
        out[k[starts]] = np.add.reduceat(moved, starts, 0)
        wrong = np.minimum(np.searchsorted(self.until, self.rng.random((blocks, CLASS_NOISE))), len(self.per) - 1)
        more, moved = self._wrong(q.reshape(-1, blocks, dim + 1).transpose(1, 0, 2), 2, wrong, self.log_class)
        back.reshape(-1, blocks, dim).transpose(1, 0, 2)[:] += more
        g, at = _spread(moved.reshape(-1, dim + 1), wrong.ravel(), len(out))
        out[at] += g
        self._move(2, slice(None), out)
        many = np.flatnonzero(self.width[k] > 1)
        if len(many):
            self._within(q, back, k[many], w[many], many)
        back = back[:n]
        g, at = _spread((back @ mixes.T).reshape(-1, dim), pairs, len(vectors))
        self._move(0, at, g)
        self._move(1, slice(None), before.T @ back / np.float32(n))
        self.seen += np.bincount(number, minlength=len(vectors))
        self.before += np.bincount(pairs, minlength=len(vectors))

    def _within(self, q: np.ndarray, back: np.ndarray, k: np.ndarray, w: np.ndarray, many: np.ndarray) -> None:
        """The factor of the words in classes of several, for the tokens ``many``, which
        stand by their classes ``k``: those of a class share its noise."""
        here = q.take(many, 0)
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        count = np.diff(starts, append=len(k))
        b, c = self.begin[k[starts]], self.width[k[starts]]
        low, high = self.until_word[b], self.until_word[b + c]
        wrong = np.searchsorted(self.until_word[1:], low[:, None] + self.rng.random((len(b), WORD_NOISE)) * (high - low)[:, None], "right")
        wrong = self.flat[np.clip(wrong, b[:, None], (b + c - 1)[:, None])]
        # a class fills whole chunks, with rows of zeros at the end
        chunks = -(-count // CHUNK)
        first = np.cumsum(chunks) - chunks
        place = np.repeat(first * CHUNK - starts, count) + np.arange(len(k))
        padded = np.zeros((chunks.sum() * CHUNK, q.shape[1]), np.float32)
        padded[place] = here
        more, down = self._wrong(padded.reshape(-1, CHUNK, q.shape[1]), 3, wrong, self.log_word, np.repeat(np.arange(len(b)), chunks))
        own, up = self._right(here, 3, w, self.log_word)
        own += more.reshape(-1, more.shape[2]).take(place, 0)
        back[many] += own
        down = np.add.reduceat(down, first, 0).reshape(-1, q.shape[1])
        g, at = _spread(np.concatenate([up, down]), np.concatenate([w, wrong.ravel()]), len(self.tables[3]))
        self._move(3, at, g)

    def train(self, two: np.ndarray, one: np.ndarray, number: np.ndarray) -> None:
        """All the trigrams, once each, in a drawn order."""
        order = self.rng.permutation(len(number))
        for s in range(0, len(order), STEP):
            at = order[s : s + STEP]
            self.step(two[at], one[at], number[at])

    def parts(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(table, block, rows, weights) of what was trained, biases beside their rows."""
        vectors, mixes, out, words = self.tables
        classes = np.bincount(self.lm.share, weights=self.seen, minlength=len(out))
        tables = [
            (vectors, self.before),
            (mixes.reshape(2, -1), np.full(2, self.seen.sum())),
            (out, classes),
            (words, self.seen),
        ]
        for k, (x, weight) in enumerate(tables):
            # what was only noise here counts little
            weight = weight + 1e-3
            for s in range(0, len(x), MODEL_ROWS):
                yield k, s // MODEL_ROWS, x[s : s + MODEL_ROWS].astype(np.float32).tobytes(), weight[s : s + MODEL_ROWS].tobytes()


def averaged(lm: Model, parts: list[tuple[int, int, bytes]]) -> Model:
    """The model of the averages of all blocks (table, block, rows)."""
    vectors, mixes = lm.state[:2]
    shapes = [vectors.shape[1], mixes[0].size, lm.out.shape[1] + 1, lm.words.shape[1] + 1]
    tables = [np.concatenate([np.frombuffer(b, np.float32).reshape(-1, shapes[k]) for t, _, b in sorted(parts, key=lambda p: p[:2]) if t == k]) for k in range(4)]
    mixes = tables[1].reshape(mixes.shape)
    return Model(tables[0] @ mixes[0], tables[0] @ mixes[1], tables[2][:, :-1].copy(), tables[2][:, -1].copy(), tables[3][:, :-1].copy(), tables[3][:, -1].copy(), lm.share, lm.first, lm.members)


def _train_on(df: DataFrame, text_col: str, places: Mapping[bytes, int], size: int, start: Model, freq: np.ndarray) -> Model:
    """``start`` trained on with all trigrams of the texts, once each, each task
    with those of its rows; blocks of the model are averaged in tasks of their own."""
    context = df.sparkSession.sparkContext
    sent = context.broadcast((places, start, freq))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, start, freq = sent.value
        trainer = Trainer(start, freq)
        held, count = [], 0

        def flush() -> None:
            trainer.train(*(np.concatenate(x) for x in zip(*held)))
            held.clear()

        for batch in batches:
            for _, texts in by_bytes(batch.column(0).to_pylist(), SCORE_BYTES):
                number, owner, _, _ = token_numbers([t.lower() for t in texts], places, size)
                held.append((*contexts(number, owner, size + SHAPES), number))
                count += len(number)
                if count >= MIXED:
                    flush()
                    count = 0
        if held:
            flush()
        if not trainer.seen.any():
            return
        task = TaskContext.get().partitionId()
        for k, block, x, weight in trainer.parts():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.int32()), pa.array([task], pa.int32()), pa.array([x], pa.binary()), pa.array([weight], pa.binary())], names=["k", "block", "task", "x", "weight"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total, mass = 0.0, 0.0
        for r in pdf.sort_values("task").itertuples():
            weight = np.frombuffer(r.weight)
            total = total + np.frombuffer(r.x, np.float32).reshape(len(weight), -1) * weight[:, None]
            mass = mass + weight
        return pd.DataFrame({"k": pdf["k"][:1], "block": pdf["block"][:1], "x": [(total / mass[:, None]).astype(np.float32).tobytes()]})

    # so many copies of the model are passed on as there are tasks
    tasks = df.select(text_col).coalesce(max(1, min(TRAINERS * context.defaultParallelism, int(freq.sum()) // TASK_TOKENS)))
    trained = tasks.mapInArrow(run, "k int, block int, task int, x binary, weight binary")
    got = trained.groupBy("k", "block").applyInPandas(add, "k int, block int, x binary").collect()
    return averaged(start, [(r["k"], r["block"], bytes(r["x"])) for r in got])


def _draws(df: DataFrame, text_col: str, places: Mapping[bytes, int], size: int, rate: float) -> DataFrame:
    """Trigrams of token numbers of the texts, packed, each with chance ``rate``
    by a hash of its text and place; of few, those of some texts only."""
    sent = df.sparkSession.sparkContext.broadcast(places)
    some = min(1.0, TEXTS * rate)
    cut = np.uint32(min(rate / some, 1.0) * 0xFFFFFFFF) if rate else np.uint32(0)
    df = df.where(F.pmod(F.xxhash64(text_col), F.lit(1_000_000)) < ceil(some * 1_000_000))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, texts in by_bytes(batch.column(0).to_pylist(), SCORE_BYTES):
                texts = [t.lower() for t in texts]
                number, owner, _, _ = token_numbers(texts, sent.value, size)
                two, one = contexts(number, owner, size + SHAPES)
                h = np.array([crc32(t) for t in texts], np.uint32)[owner] + np.arange(len(number), dtype=np.uint32) - np.searchsorted(owner, np.arange(len(texts))).astype(np.uint32)[owner]
                h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
                h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
                at = np.flatnonzero((h ^ (h >> np.uint32(16))) <= cut)
                out.append(np.stack([two[at], one[at], number[at]], 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(out).tobytes()], pa.binary())], names=["grams"])

    return df.select(text_col).mapInArrow(run, "grams binary")


def learn(df: DataFrame, text_col: str, words: list[bytes], tokens: int, freq: np.ndarray) -> Model:
    """The model of the texts, whose number of tokens is given, over ``words``;
    ``freq`` counts the tokens of each number. The model comes back as arrays."""
    size = len(words)
    places = {w: i for i, w in enumerate(words)}
    rate = DRAWS * sqrt(tokens) / max(1, tokens)
    grams = _draws(df, text_col, places, size, rate)
    # all trigrams follow after a start that is not of all
    whole = rate >= 1

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = np.concatenate([np.frombuffer(g, np.int32).reshape(-1, 3) for g in pdf["grams"]])
        # one order, whatever the order of the rows
        found = found[np.lexsort(found.T)]
        model = train(found[:, 0].copy(), found[:, 1].copy(), found[:, 2].copy(), size, passes=2 if whole else 1)
        if whole:
            model.state = None
        give_back()
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    got = grams.groupBy(F.lit(0).alias("_all")).applyInPandas(run, "model binary").collect()
    if got:
        start = pickle.loads(got[0]["model"])
        return start if whole else _train_on(df, text_col, places, size, start, freq)
    none = np.zeros(0, np.int32)
    model = train(none, none, none, size)
    if tokens:
        return _train_on(df, text_col, places, size, model, freq)
    model.out[:], model.bias[:] = 0, 0
    return model


def score(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    held_fold: int = 2,
    top: int = TOP_WORDS,
) -> DataFrame:
    """Of each row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (add-one unigrams) and ``score`` (the model's), in log10."""
    spark = df.sparkSession
    arrow_rows(spark)
    fold = id_bucket(id_col, folds)
    training = df.where(fold != held_fold)
    n_docs = training.count()
    counts = _counts(training, text_col)
    known = counts.where(F.octet_length("word") <= TOP_BYTES).orderBy(F.desc("c"), "word").limit(top).toArrow()
    words, freq = known.column("word").to_pylist(), np.array(known.column("c").to_pylist(), np.int64)
    pair = F.conv(F.hex(F.substring(F.concat(F.lit(b"\x00"), F.col("word")), -2, 2)), 16, 10).cast("int")
    per_pair = counts.groupBy(pair.alias("pair")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # 65,536 rows at most
    mass, kinds = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in per_pair:
        shape = _TABLE[(r["pair"] & 255) << 8 | r["pair"] >> 8]
        mass[shape] += r["n"]
        kinds[shape] += r["v"]
    n_all, v_all = int(mass.sum()) + n_docs, int(kinds.sum()) + (n_docs > 0)
    size = min(len(words), int(VOCABULARY * sqrt(n_all)))
    for w, c in zip(words[:size], freq[:size].tolist()):
        mass[word_shape(w)] -= c
        kinds[word_shape(w)] -= 1
    # what a token's count is divided by: its group's places; nothing for the end; its own count for a word of the vocabulary
    inner = np.concatenate([np.log10(freq[:size] + 1), np.log10(mass + kinds + 1), [0.0]])
    lm = learn(training, text_col, words[:size], n_all, np.concatenate([freq[:size], mass, [n_docs]]))
    model = spark.sparkContext.broadcast(({w: i for i, w in enumerate(words)}, np.log10(freq + 1), lm, inner))
    unit, end_value = log10(n_all + v_all + 1), log10(n_docs + 1)
    id_type = df.schema[id_col].dataType.simpleString()
    names = ["_row", "_key", id_col, "held_out", "n_tokens", "_known", "_logs", "_model", "_tf"]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, logs, lm, inner_log = model.value
        at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            texts = [(t or "").encode().lower() for t in batch.column(2).to_pylist()]
            m = len(texts)
            rows = np.arange(at, at + m)
            at += m
            sums, seen, model_log, n_tokens = np.zeros(m), np.zeros(m, np.int64), np.zeros(m), np.zeros(m, np.int64)
            rare_row, rare_word, rare_n = [], [], []
            for first, part in by_bytes(texts, SCORE_BYTES):
                here = slice(first, first + len(part))
                number, owner, place, words = token_numbers(part, places, size)
                two, one = contexts(number, owner, size + SHAPES)
                n_tokens[here] = np.bincount(owner, minlength=len(part))
                model_log[here] = np.bincount(owner, lm.log10(two, one, number) - inner_log[number], len(part))
                inside = owner[number_is_word(number, owner)]
                got = place >= 0
                sums[here] = np.bincount(inside[got], logs[place[got]], len(part))
                seen[here] = np.bincount(inside[got], minlength=len(part))
                far = np.flatnonzero(~got)
                rare = Counter(zip((first + inside[far]).tolist(), map(words.__getitem__, far.tolist())))
                rare_row += [i for i, _ in rare]
                rare_word += [w for _, w in rare]
                rare_n += rare.values()
            # a document's own row has a key that no word has and that spreads the rows
            keys = [b" %d" % r for r in rows.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(keys, pa.binary()), batch.column(0), batch.column(1), pa.array(n_tokens), pa.array(seen), pa.array(sums), pa.array(model_log), pa.array(np.zeros(m, np.int64))], names=names)
            for s in range(0, len(rare_row), 50_000):
                part = rare_row[s : s + 50_000]
                none = [pa.nulls(len(part), x) for x in (batch.column(0).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(rows[part]), pa.array(rare_word[s : s + 50_000], pa.binary()), *none, pa.array(rare_n[s : s + 50_000], pa.int64())], names=names)

    texts = df.select(id_col, (fold == held_fold).alias("held_out"), text_col)
    parts = texts.mapInArrow(run, f"_row long, _key binary, `{id_col}` {id_type}, held_out boolean, n_tokens long, _known long, _logs double, _model double, _tf long")
    joined = parts.join(counts.hint("merge"), parts["_key"] == counts["word"], "left")
    value = F.when(F.col("c").isNotNull(), F.col("_tf") * F.log10(F.col("c") + 1)).otherwise(0.0)
    doc = joined.groupBy("_row").agg(
        F.max(id_col).alias(id_col),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum(F.coalesce("_known", F.lit(0))) + F.sum(F.when(F.col("c").isNotNull(), F.col("_tf")).otherwise(0)) + F.lit(int(n_docs > 0))).alias("n_known"),
        (F.sum(F.coalesce("_logs", F.lit(0.0))) + F.sum(value)).alias("_sum"),
        F.sum("_model").alias("_m"),
    )
    return doc.select(
        id_col,
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("_sum") + F.lit(end_value) - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("_sum") + F.col("_m")).alias("score"),
    )
