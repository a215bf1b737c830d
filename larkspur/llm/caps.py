"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction; a vector belongs to it if it lies in the cap around
it. The directions are a structured random product code: after a random
rotation, each half of the space has ``k`` random code words, and the k * k
directions are their pairs. A vector is decoded to the list of all directions
that exceed the cap's height: words of one half in the order of their products,
each with the words of the other that are left above the height. Vectors that
share a filter are compared in blocks, in double precision, so every reported
link is exact.

The height is measured for each length of vectors on the drawn code, by random
pairs at the threshold's angle: they share ``shared`` filters on average, and at
most ``MISSED`` of them share none. The number of filters grows with the number
of vectors, which keeps caps small. Equal vectors are one class and are decoded
once; with their filters they are kept in the shared folder. A vector is sent
once for each word of the first half in its filters, and what all vectors send
is dealt to rounds of about the input's size, of which only one lies on the
disks at a time. A cap with more than ``BLOCK`` vectors is cut into blocks, and pairs of
blocks are compared in different tasks. A pair that shares several filters
counts in the first of them. No pairs leave a task: it returns, for each
vector, the number of its links and one link to its local component.

Defined cases: vectors that are null, zero, or hold null or non-finite numbers,
and rows with a null id, link with nothing and are components of their own;
vectors of different lengths never link. Repeated rows are separate vectors.
An empty table gives an empty result. Columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import arrow_rows, durable, forget, frugal, sweep
from .components import components
from .grams import mix64

#: Vectors of a cap that are compared in one piece at most.
BLOCK = 1_000
#: Random pairs on which a cap's height is measured, and the share of them that
#: may have no filter in common.
PAIRS = 1_000
MISSED = 0.001
#: Bytes that a task of caps holds, about.
PART_BYTES = 80_000_000
#: Bytes of vectors that one round of comparisons sends; those of all vectors, if these are more.
ROUND_BYTES = 256_000_000


def unit(x: np.ndarray) -> np.ndarray:
    """The vectors at length 1, in double precision and safe from overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Code:
    """The product code for vectors of one length."""

    def __init__(self, dim: int, k: int, height: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.half = (dim + 1) // 2
        self.k = k
        words = [rng.normal(size=(k, n)) for n in (self.half, dim - self.half)]
        words = [w / np.maximum(np.sqrt((w * w).sum(1, keepdims=True)), 1e-300) * sqrt(w.shape[1]) for w in words]
        # halves of one or no number have two words or one: equal filters would only repeat each other
        self.words = [np.unique(w, axis=0) if w.shape[1] == 1 else w[:1] if w.shape[1] == 0 else w for w in words]
        self.height = height

    def products(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Products of unit vectors with the words of the first half; the order of
        those of the second half, and their products in it."""
        y = x @ self.turn
        one, two = y[:, : self.half] @ self.words[0].T, y[:, self.half :] @ self.words[1].T
        order = np.argsort(-two, 1)
        return one, order, np.take_along_axis(two, order, 1)

    def filters(self, one: np.ndarray, order: np.ndarray, ranked: np.ndarray, height: float) -> np.ndarray:
        """The sorted filters of one vector's products at a height."""
        first = np.flatnonzero(one + ranked[0] >= height)
        n = np.searchsorted(-ranked, one[first] - height, "right")
        return np.sort(np.repeat(first, n) * self.k + np.concatenate([order[:m] for m in n]) if len(first) else np.zeros(0, np.int64))

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the sorted filters whose caps hold it."""
        return [self.filters(*p, self.height) for p in zip(*self.products(x))]

    def shares(self, one: tuple, two: tuple, height: float) -> np.ndarray:
        """How many filters each pair of vectors, given by their products, shares at a height."""
        return np.array([len(np.intersect1d(self.filters(*p, height), self.filters(*q, height), assume_unique=True)) for p, q in zip(zip(*one), zip(*two))])


def pairs_at(dim: int, rho: float, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` random pairs of unit vectors of cosine ``rho``."""
    rng = np.random.default_rng([seed, dim, n])
    x, z = rng.normal(size=(2, n, dim))
    x = unit(x)
    if dim == 1:
        return x, x
    z = unit(z - (z * x).sum(1, keepdims=True) * x)
    return x, rho * x + sqrt(1 - rho * rho) * z


def cap_height(dim: int, k: int, rho: float, shared: float, seed: int, pairs: int = PAIRS, missed: float = MISSED) -> float:
    """About the largest height at which random pairs of cosine ``rho`` share
    ``shared`` filters of the drawn code on average, and a share of ``missed``
    of them at most shares none. It is measured on the code, since the products
    of unit vectors are bounded and have lighter tails than normal numbers."""
    code = Code(dim, k, 0.0, seed)
    one, two = (code.products(x) for x in pairs_at(dim, rho, pairs, seed))
    need = min(shared, len(code.words[0]) * len(code.words[1]) / 8)

    def enough(height: float) -> bool:
        got = code.shares(one, two, height)
        return got.mean() >= need and (got == 0).mean() <= missed

    high = sqrt(dim)
    low = high * 0.96
    while not enough(low):
        low, high = low * 0.96, low
    for _ in range(6):
        mid = (low + high) / 2
        low, high = (mid, high) if enough(mid) else (low, mid)
    return low


def compare(key_filter: int, ids: np.ndarray, side: np.ndarray, count: np.ndarray, x: np.ndarray, filters: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links within a block (all ``side`` 0) or between two: for each vector the
    links that this filter counts, and the smallest id of its local component."""
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    if side.any():
        hit &= side[:, None] != side[None, :]
    some = np.flatnonzero(hit.any(1))
    links, root = np.zeros(len(ids), np.int64), ids.copy()
    if not len(some):
        return links, root
    hit = hit[np.ix_(some, some)]
    # pairs that share an earlier filter are counted there
    early = [f[f < key_filter] for f in (filters[i] for i in some)]
    flat = np.concatenate(early)
    if len(flat):
        names, at = np.unique(flat, return_inverse=True)
        row = np.repeat(np.arange(len(some)), [len(e) for e in early])
        owned = hit.copy()
        for s in range(0, len(names), 2_048):
            inside = (at >= s) & (at < s + 2_048)
            has = np.zeros((len(some), min(2_048, len(names) - s)), np.float32)
            has[row[inside], at[inside] - s] = 1
            owned &= has @ has.T < 0.5
    else:
        owned = hit
    links[some] = owned @ count[some]
    label = ids[some]
    while True:
        new = np.minimum(label, np.where(hit, label[None, :], np.iinfo(np.int64).max).min(1))
        if (new == label).all():
            break
        label = new
    root[some] = label
    return links, root


def _flat(batch: pa.RecordBatch, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of decoded vectors: their lengths; all their filters, and the row of each."""
    lists = [np.frombuffer(b, kind) for b in batch.column("fs").to_pylist()]
    flat = np.concatenate(lists) if lists else np.zeros(0, kind)
    return batch.column("dim").to_numpy(), flat, np.repeat(np.arange(len(lists)), [len(f) for f in lists])


def _firsts(word: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which are the first of their word and row, in sorted lists."""
    out = np.ones(len(word), bool)
    out[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
    return out


def _pieces(f: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """In how many blocks the cap of each filter is cut, by the sorted filters of cut caps."""
    names, blocks = cuts
    out = np.ones(len(f), np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, f), len(names) - 1)
        hit = names[at] == f
        out[hit] = blocks[at[hit]]
    return out


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, shared: float = 40.0, seed: int = 23) -> DataFrame:
    """One row for each row of ``df``: its id, ``n_links``, ``component_id`` and ``kept``."""
    spark = df.sparkSession
    arrow_rows(spark)
    v = F.col("_v")
    fine = F.coalesce(v.isNotNull() & F.col("_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    # vectors travel as they are given, in four or eight bytes a number
    single = df.schema[vector_col].dataType.elementType == FloatType()
    rows = df.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("_v")).withColumn("_ok", fine)
    classes = durable(rows.where("_ok").groupBy("_v").agg(F.min("_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("m")))
    n = classes.count()
    k = max(64, ceil(sqrt(2 * n)))
    # one row for each length of vectors
    heights = {r["d"]: cap_height(r["d"], k, threshold, shared, seed) for r in classes.select(F.size("_v").alias("d")).distinct().collect()}

    kind = np.int32 if k * k < 1 << 31 else np.int64

    @frugal
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Code] = {}
        for batch in batches:
            vectors = batch.column(0)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                if int(dim) not in codes:
                    codes[int(dim)] = Code(int(dim), k, heights[int(dim)], seed)
                code = codes[int(dim)]
                at = np.flatnonzero(sizes == dim)
                raw = np.stack([flat[starts[i] : starts[i + 1]] for i in at])
                lists = code.decode(unit(raw))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), dim, np.int32)),
                        batch.column(1).take(pa.array(at)),
                        batch.column(2).take(pa.array(at)),
                        pa.array([x.tobytes() for x in raw], pa.binary()),
                        pa.array([f.astype(kind).tobytes() for f in lists], pa.binary()),
                    ],
                    names=["dim", "rep", "m", "x", "fs"],
                )

    # a vector and its filters lie in the shared folder once
    decoded = durable(classes.mapInArrow(decode, "dim int, rep long, m long, x binary, fs binary"))

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, flat, row = _flat(batch, kind)
            for dim in np.unique(dims):
                here = flat[dims[row] == dim]
                f, c = np.unique(here, return_counts=True)
                # besides, how often its vectors travel: once a word of the first half
                sent = _firsts(here // k, row[dims[row] == dim]).sum()
                yield pa.RecordBatch.from_arrays([pa.array(np.append(f, -1), pa.int64()), pa.array(np.full(len(f) + 1, dim, np.int32)), pa.array(np.append(c, sent), pa.int64())], names=["f", "dim", "c"])

    loads = durable(decoded.select("dim", "fs").mapInArrow(count, "f long, dim int, c long").groupBy("f", "dim").agg(F.sum("c").alias("n")))
    big = loads.where(f"f >= 0 and n > {BLOCK}").withColumn("g", F.ceil(F.col("n") / BLOCK).cast("int")).select("f", "dim", "g", "n").toArrow()
    cut = {}
    for dim in heights:
        at = np.flatnonzero(big.column("dim").to_numpy() == dim)
        f, g = (big.column(c).to_numpy()[at].astype(np.int64) for c in ("f", "g"))
        cut[dim] = f[np.argsort(f)], g[np.argsort(f)]
    sent = spark.sparkContext.broadcast(cut)
    whole = loads.agg(F.sum(F.when(F.col("f") < 0, F.col("n"))).alias("rows"), F.sum(F.when(F.col("f") >= 0, F.col("n"))).alias("n"), F.max("dim").alias("dim")).first()
    total = (whole["rows"] or 0) + int((big.column("g").to_numpy() * big.column("n").to_numpy()).sum())
    listed = (4 if single else 8) * (whole["dim"] or 0) + np.dtype(kind).itemsize * (whole["n"] or 0) / max(1, n)
    rounds = max(1, ceil(total * (listed + 40) / max(ROUND_BYTES, n * listed)))
    # more partitions, where a task could not hold its vectors
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while min(n, total / rounds / parts) * (listed + 400) > PART_BYTES:
        parts *= 2

    def emit(turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """The rows of a round: a vector for each word of the first half of its
        filters, and for each pair of blocks of a cut cap that has its own."""

        @frugal
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims, flat, row = _flat(batch, kind)
                reps = batch.column("rep").to_numpy()
                for dim in np.unique(dims):
                    on = dims[row] == dim
                    f, r = flat[on].astype(np.int64), row[on]
                    pieces = _pieces(f, sent.value[int(dim)])
                    light = pieces == 1
                    word, at = f[light] // k, r[light]
                    first = _firsts(word, at)
                    none = np.full(int(first.sum()), -1, np.int64)
                    cols = [[word[first], none, none, np.zeros_like(none), at[first]]]
                    if not light.all():
                        f, at, g = f[~light], r[~light], pieces[~light]
                        own = np.repeat((mix64(reps[at].astype(np.uint64)) % g.astype(np.uint64)).astype(np.int64), g)
                        other = np.arange(g.sum()) - np.repeat(np.cumsum(g) - g, g)
                        i, j = np.minimum(own, other), np.maximum(own, other)
                        cols.append([np.repeat(f, g), i, j, ((i != j) & (own == j)).astype(np.int64), np.repeat(at, g)])
                    f, i, j, side, at = (np.concatenate(c) for c in zip(*cols))
                    mine = mix64((f * 1_000_003 + i * 1_009 + j).astype(np.uint64)) % np.uint64(rounds) == turn
                    f, i, j, side, at = (c[mine] for c in (f, i, j, side, at))
                    order = np.argsort(at, kind="stable")
                    for s in range(0, len(at), 5_000):
                        o = order[s : s + 5_000]
                        take = pa.array(at[o])
                        yield pa.RecordBatch.from_arrays([pa.array(c[o]) for c in (f, i, j, side)] + [pa.array(np.full(len(o), dim, np.int32)), *(batch.column(c).take(take) for c in ("rep", "m", "x", "fs"))], names=["f", "i", "j", "side", "dim", "rep", "m", "x", "fs"])

        return run

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each vector is held once, however many caps of the task it is in
        place: dict[int, int] = {}
        held: list[tuple[np.ndarray, int]] = []
        fs: list[np.ndarray] = []
        keys, cells, at = [], [], []
        for batch in batches:
            if not len(batch):
                continue
            reps, first, back = np.unique(batch.column("rep").to_numpy(), return_index=True, return_inverse=True)
            for rep, i in zip(reps.tolist(), first.tolist()):
                if rep not in place:
                    place[rep] = len(held)
                    held.append((np.frombuffer(batch.column("x")[i].as_py(), np.float32 if single else np.float64), batch.column("m")[i].as_py()))
                    fs.append(np.frombuffer(batch.column("fs")[i].as_py(), kind))
            own = np.array([place[rep] for rep in reps.tolist()], np.int32)[back]
            f, i, j, side, dims = (batch.column(c).to_numpy().astype(np.int64) for c in ("f", "i", "j", "side", "dim"))
            heavy = i >= 0
            if heavy.any():
                keys.append(f[heavy])
                cells.append(np.stack([dims[heavy], i[heavy], j[heavy], side[heavy]]))
                at.append(own[heavy])
            # the filters of a vector that have the row's word
            for dim in np.unique(dims[~heavy]):
                rows = np.flatnonzero(~heavy & (dims == dim))
                low = [np.searchsorted(fs[o], (w * k, w * k + k)) for o, w in zip(own[rows].tolist(), f[rows].tolist())]
                many = np.array([e - s for s, e in low])
                got = np.concatenate([fs[o][s:e] for o, (s, e) in zip(own[rows].tolist(), low)]).astype(np.int64)
                alone = _pieces(got, sent.value[int(dim)]) == 1
                keys.append(got[alone])
                none = np.zeros(int(alone.sum()), np.int64)
                cells.append(np.stack([none + dim, none, none, none]))
                at.append(np.repeat(own[rows], many)[alone])
        if not keys:
            return
        ids, count = np.fromiter(place, np.int64, len(place)), np.array([m for _, m in held])
        keys, cells, at = np.concatenate(keys), np.concatenate(cells, 1), np.concatenate(at)
        order = np.lexsort((*cells[:3], keys))
        keys, cells, at = keys[order], cells[:, order], at[order]
        del order
        new = (keys[1:] != keys[:-1]) | (cells[:3, 1:] != cells[:3, :-1]).any(0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:]):
            if e - s < 2:
                continue
            here = at[s:e]
            links, root = compare(keys[s], ids[here], cells[3, s:e], count[here], unit(np.stack([held[i][0] for i in here])), [fs[i] for i in here], threshold)
            on = (links > 0) | (root != ids[here])
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[here][on]), pa.array(links[on]), pa.array(root[on])], names=["rep", "links", "root"])

    # a round's shuffle is deleted before the next one is written
    found = []
    for turn in range(rounds):
        dealt = decoded.mapInArrow(emit(turn), "f long, i long, j long, side long, dim int, rep long, m long, x binary, fs binary").repartition(parts, "f", "dim", "i", "j")
        found.append(durable(dealt.mapInArrow(run, "rep long, links long, root long").groupBy("rep", "root").agg(F.sum("links").alias("links"))))
        del dealt
        if rounds > 1:
            sweep(spark)
    forget(decoded)
    found = reduce(DataFrame.unionByName, found)
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found, "rep", "root")
    classes = classes.join(degree, "rep", "left").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    classes = durable(classes.select(F.col("_v").alias("_cv"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    good = rows.where("_ok").join(classes, F.col("_v") == F.col("_cv")).select("_id", "n_links", "component_id")
    lone = rows.where("not _ok").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").cast("long").alias("component_id"))
    return good.unionByName(lone).select(F.col("_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"))
