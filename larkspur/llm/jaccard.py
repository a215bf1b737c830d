"""N-gram Jaccard join with set-relation skipping.

The join is exact. Sets are the distinct five-word shingles of whole texts.

* Equal sets are one class, found by a 128-bit hash; only classes are joined.
* Shingles have one global order: those that a count sketch of the whole corpus
  holds frequent come last; others stand by the product of their words' counts,
  which such a sketch holds too, the rarest first, so that lists hold few sets
  that meet by chance, also in a large corpus. Sets whose Jaccard similarity is
  at least t share a shingle among the first n - ceil(t n) + 1 of each; these
  make up the index lists.
* Block skipping: a list is ordered by set size, and a pair is skipped where
  sizes, or the shingles left after the position in each set, cannot reach the
  needed overlap. A list in which nothing can is dropped. Where pairs of a list
  are formed, sets meet in bands of sizes, of which all but their own and the
  two beside it are skipped whole.
* Before a pair's sets are fetched, a parity bitmap of each (``BITS`` bits, the
  exclusive or of the shingles' bits) bounds their overlap from above by
  (|a| + |b| - differing bits) / 2; a pair that the bound excludes is dropped.
* A pair whose fronts share less than a link of their sizes needs is skipped: at
  least the needed overlap less what can stand behind the larger front.
* Answer derivation: in each list, sets are first compared with one leading set.
  Sets that link to it share its component, so they need no comparison with one
  another; only pairs of a list that are still in different components are left.
  Of these, a set's answers follow from the leader's: it shares with another set
  at most what the leader shares with that one, and what the leader lacks of it;
  a pair that this bound excludes is not compared. This yields the same
  components as all links, without all pairs of a group.

The index is passed on in packed blobs, dealt by the shingle's hash to a number
of groups that follows the corpus, so a task holds a bounded share of it.

Defined cases: a null or empty text, or one without words, has an empty set and
links with nothing; a text of one to four words is one shingle, its whole
sequence. Repeated rows are separate documents; rows that share an id are one
node of the links, whatever their texts; a null id is a component of its
own and links nothing. An empty table gives an empty result. Columns that are
not named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, by_bytes, durable, forget, frugal, join_small, sweep
from .components import components
from .grams import Words, mix64

WIDTH = 5
#: Cells of the sketches of shingle counts and word counts, and cells that are summed together.
CELLS, WORD_CELLS, PART = 1 << 20, 1 << 18, 1 << 16
#: Postings of a group of the index, about, and those that a task holds at most.
GROUP_POSTINGS, HELD_POSTINGS = 250_000, 1_000_000
#: Classes that a task remembers to pass on each once, at most.
SEEN = 1_000_000
#: Sets of a list that are paired in one task at most, rows of lists that a task
#: holds, about, and pairs that are looked at together.
LIST_BLOCK, TASK_ROWS, PAIRS = 50_000, 200_000, 1_000_000
MOST = 0xFFFF
BITS = 1024


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return [s for s, _ in sets_of(Words(texts, lower=True), width)]


def sets_of(w: Words, width: int = WIDTH, places: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The same of the texts whose words are given; with ``places``, also the
    first word of each shingle of a text of ``width`` words or more."""
    first = np.searchsorted(w.doc, np.arange(w.count + 1))
    h = w.hash
    run = np.zeros(0, np.uint64)
    if len(h) >= width:
        run = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            run = mix64(run * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - width + 1 + k])
    for s, e in zip(first, first[1:]):
        if e - s >= width:
            own = run[s : e - width + 1]
            if places:
                found, at = np.unique(own, return_index=True)
                yield found, s + at
            else:
                yield np.unique(own), None
        elif e > s:
            x = np.array([e - s], np.uint64)
            for k in range(s, e):
                x = mix64(x * np.uint64(0xA0761D6478BD642F) + h[k])
            yield x, None
        else:
            yield np.zeros(0, np.uint64), None


def ranked_sets(texts: list[bytes], levels: tuple[np.ndarray, np.ndarray], width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The set of each text and the places of its shingles in the global order."""
    w = Words(texts, lower=True)
    own = levels[1][(w.hash & np.uint64(WORD_CELLS - 1)).astype(np.int64)].astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own)])
    for s, at in sets_of(w, width, places=True):
        rank = s >> np.uint64(17)
        if at is not None:
            rank |= (sums[at + width] - sums[at]) << np.uint64(47)
            rank |= levels[0][(s & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(57)
        yield s, rank


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of ``n`` with any set that it links to."""
    return -(-percent * n // 100)


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def parity(s: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The parity bitmap of a set, as 64-bit numbers. Half of a bitmap is the
    exclusive or of its two halves."""
    odd = np.bincount((s >> np.uint64(32)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_parity(s: np.ndarray) -> np.ndarray | None:
    """A bitmap that grows with the set, three bits for two shingles or more;
    None where ``BITS`` are as many."""
    bits = BITS
    while 2 * bits < 3 * len(s):
        bits *= 2
    return None if bits == BITS else parity(s, bits)


def _number(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _survey(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each row ``_id``, ``n``, ``key``; besides, parts of each task's sketches."""
    id_type = df.schema[id_col].dataType

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = np.zeros(CELLS, np.uint32), np.zeros(WORD_CELLS, np.uint32)
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            ns, keys, bits, wide = [], [], [], []
            for _, texts in by_bytes(batch.column(1).to_pylist()):
                words = Words(texts, lower=True)
                sets = [s for s, _ in sets_of(words)]
                ns += [len(s) for s in sets]
                keys += [set_key(s) if len(s) else None for s in sets]
                bits += [parity(s) if len(s) else None for s in sets]
                wide += [wide_parity(s) for s in sets]
                cells += np.bincount((np.concatenate(sets) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint32)
                seen += np.bincount((words.hash & np.uint64(WORD_CELLS - 1)).astype(np.int64), minlength=WORD_CELLS).astype(np.uint32)
            m = len(ns)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.nulls(m, pa.int32()), pa.array(bits, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64()))], names=["_id", "n", "key", "part", "bits", "wide"])
        if kind is not None and cells.any():
            rows = np.concatenate([cells, seen]).reshape(-1, PART)
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(range(n), pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], names=["_id", "n", "key", "part", "bits", "wide"])

    return df.select(id_col, text_col).mapInArrow(run, f"_id {id_type.simpleString()}, n long, key binary, part int, bits array<long>, wide array<long>")


def _levels(survey: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The order class of each cell of the sketch of shingles, the logarithm of
    its count above the usual, 0 for most, and of the sketch of words, the
    logarithm of its count. 20 rows of fixed size come back."""

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PART, np.int64)
        for b in pdf["key"]:
            total += np.frombuffer(b, np.uint32)
        return pd.DataFrame({"part": [key[0]], "sums": [total.tobytes()]})

    cells = np.zeros(((CELLS + WORD_CELLS) // PART, PART), np.int64)
    for r in survey.where("part is not null").groupBy("part").applyInPandas(add, "part int, sums binary").collect():
        cells[r["part"]] = np.frombuffer(r["sums"], np.int64)
    cells, seen = cells.ravel()[:CELLS], cells.ravel()[CELLS:]
    usual = cells.mean()
    above = np.maximum(0, (cells - usual - 4 * np.sqrt(usual) - 4))
    # five words' levels add up to less than ten bits
    return np.minimum(127, np.ceil(np.log2(above + 1) * 4)).astype(np.uint8), np.minimum(204, np.rint(np.log2(seen + 1) * 4)).astype(np.uint8)


def _postings(df: DataFrame, text_col: str, levels: tuple[np.ndarray, np.ndarray], groups: int, percent: int) -> DataFrame:
    """Packed index lists: rows of (group, token, set, size, position) arrays."""
    sent = df.sparkSession.sparkContext.broadcast(levels)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sent.value
        seen: set[bytes] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            token, number, size, place = (np.concatenate(c) for c in zip(*held))
            group = ((token >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            cut = np.searchsorted(group[order], np.arange(groups + 1))
            cols = [token.astype(np.uint32)[order], number[order], size[order], place[order]]
            some = [g for g in range(groups) if cut[g + 1] > cut[g]]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array([c[cut[g] : cut[g + 1]].tobytes() for g in some], pa.binary()) for c in cols]], names=["g", "token", "number", "size", "place"])

        for batch in batches:
            for _, texts in by_bytes(batch.column(0).to_pylist()):
                for s, rank in ranked_sets(texts, level):
                    if not len(s):
                        continue
                    key = set_key(s)
                    if key in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    n = len(s)
                    m = n - int(needed(np.int64(n), percent)) + 1
                    front = np.argsort(rank, kind="stable")[:m] if m < n else np.arange(n)
                    # sizes and positions beyond two bytes are kept as unknown, which skips nothing
                    held.append((s[front], np.full(m, _number(key), np.int64), np.full(m, min(n, MOST), np.uint16), np.arange(m, dtype=np.int64).clip(0, MOST).astype(np.uint16)))
                    count += m
                    if count >= HELD_POSTINGS:
                        yield flush()
                        held, count = [], 0
        if held:
            yield flush()

    return df.select(text_col).mapInArrow(run, "g int, token binary, number binary, size binary, place binary")


def _lists(postings: DataFrame, percent: int) -> DataFrame:
    """(``list``, ``number``, ``tokens``): the distinct index lists in which some
    pair can link, each named by the hash of its sets; and, with a null list, how
    many ``tokens`` of a set's front other sets have in theirs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        token, number, size, place = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("token", np.uint32), ("number", np.int64), ("size", np.uint16), ("place", np.uint16)))
        _, back, many = np.unique(token, return_inverse=True, return_counts=True)
        on = many[back] > 1
        token, number, size, place = token[on], number[on], size[on].astype(np.int64), place[on].astype(np.int64)
        order = np.lexsort((number, token))
        token, number, size, place = token[order], number[order], size[order], place[order]
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (number[1:] != number[:-1])
        token, number, size, place = token[first], number[first], size[first], place[first]
        size = np.where(size == MOST, -1, size)
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
        ends = np.append(starts[1:], len(token))
        names, found = [], []

        def can(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            na, nb = size[a], size[b]
            known = (na >= 0) & (nb >= 0)
            overlap = -(-percent * (na + nb) // (100 + percent))
            return ~known | ((100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (np.minimum(na - place[a], nb - place[b]) >= overlap))

        two = starts[ends - starts == 2]
        two = two[can(two, two + 1)]
        if len(two):
            tag = mix64(mix64(number[two].view(np.uint64)) + mix64(number[two + 1].view(np.uint64))).view(np.int64)
            names.append(np.repeat(tag, 2))
            found.append(np.stack([number[two], number[two + 1]], 1).ravel())
        for s, e in zip(starts, ends):
            if e - s < 3:
                continue
            at = np.arange(s, e)
            at = at[np.argsort(np.where(size[at] < 0, MOST, size[at]), kind="stable")]
            if len(at) <= 512:
                pairs = can(at[:, None], at[None, :])
                np.fill_diagonal(pairs, False)
                at = at[pairs.any(1)]
            if len(at) < 2:
                continue
            kept = np.sort(number[at])
            tag = mix64(mix64(kept.view(np.uint64)).sum(keepdims=True)).view(np.int64)
            names.append(np.repeat(tag, len(kept)))
            found.append(kept)
        # shared tokens are counted in all lists, also where the position lets no pair through
        many = ends - starts > 1
        own, tokens = np.unique(np.concatenate([number[s:e] for s, e in zip(starts[many], ends[many])]), return_counts=True) if many.any() else (number[:0], starts[:0])
        parts = [pd.DataFrame({"list": pd.array([None] * len(own), "Int64"), "number": own, "tokens": tokens})]
        if names:
            both = pd.DataFrame({"list": pd.array(np.concatenate(names), "Int64"), "number": np.concatenate(found)}).drop_duplicates()
            parts.append(both.assign(tokens=0))
        return pd.concat(parts)

    dealt = postings.groupBy("g").applyInPandas(run, "list long, number long, tokens long")
    return dealt.groupBy("list", "number").agg(F.sum("tokens").alias("tokens"))


def _sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``rep``, ``s``): the sets of the documents ``wanted``, as arrays."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in by_bytes(batch.column(1).to_pylist()):
                sets = [s.view(np.int64) for s in shingle_sets(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "s"])

    id_type = df.schema[id_col].dataType.simpleString()
    texts = join_small(df.select(F.col(id_col).alias("rep"), F.col(text_col).alias("_t")), wanted, ["rep"])
    return texts.select("rep", "_t").mapInArrow(run, f"rep {id_type}, s array<long>")


def _may_link(percent: int, na: Column, nb: Column, ma: Column, mb: Column) -> Column:
    """Whether the sizes allow a link, and enough of each front is shared: the
    overlap that a link needs, less what can stand behind the larger front."""
    overlap = F.ceil(F.lit(percent) * (na + nb) / (100 + percent))
    behind = F.ceil(F.lit(percent) * F.greatest(na, nb) / 100) - 1
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.least(ma, mb) >= overlap - behind)


def _bound(percent: int) -> Column:
    """Whether the bitmaps ``pa``, ``pb`` of sets of ``na``, ``nb`` allow a link."""
    differ = F.lit(0)
    for i in range(BITS // 64):
        differ = differ + F.bit_count(F.col("pa")[i].bitwiseXOR(F.col("pb")[i]))
    most = F.floor((F.col("na") + F.col("nb") - differ) / 2)
    return 100 * most >= percent * (F.col("na") + F.col("nb") - most)


def _wide_bound(percent: int) -> Column:
    """The same of the growing bitmaps ``wa``, ``wb``, the longer one folded;
    true where one of the sets has none."""

    def fold(x: Column, other: Column) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        folded = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > F.size(other), folded).otherwise(x)

    a, b = fold(F.col("wa"), F.col("wb")), fold(F.col("wb"), F.col("wa"))
    differ = F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, x: t + F.coalesce(x, F.lit(0)))
    most = F.floor((F.col("na") + F.col("nb") - differ) / 2)
    known = F.col("wa").isNotNull() & F.col("wb").isNotNull() & (F.greatest(F.size("wa"), F.size("wb")) <= 2 * F.least(F.size("wa"), F.size("wb")))
    return F.when(known, 100 * most >= percent * (F.col("na") + F.col("nb") - most)).otherwise(True)


def _compared(df: DataFrame, pairs: DataFrame, classes: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that their bitmaps let pass, compared as sets:
    their overlap ``both`` (null where an id has several texts) and whether they ``link``."""
    one = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bits").alias("pa"), F.col("wide").alias("wa"))
    two = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("pb"), F.col("wide").alias("wb"))
    may = durable(pairs.join(one, "a").join(two, "b").where(_bound(percent) & _wide_bound(percent)).select("a", "b").distinct())
    wanted = may.select(F.col("a").alias("rep")).unionByName(may.select(F.col("b").alias("rep"))).distinct()
    sets = durable(_sets(df, wanted, id_col, text_col))
    left = sets.select(F.col("rep").alias("a"), F.col("s").alias("_sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("s").alias("_sb"))
    total = F.size("_sa") + F.size("_sb")
    found = may.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("_sa", "_sb")).alias("both"), total.alias("_t"))
    # rows that share an id are one node: it links if any of its texts does, and has no one overlap
    found = found.groupBy("a", "b").agg(F.when(F.count(F.lit(1)) == 1, F.max("both")).alias("both"), F.max(100 * F.col("both") >= percent * (F.col("_t") - F.col("both"))).alias("link"))
    done = durable(found)
    forget(sets)
    forget(may)
    return done


def _band(n: Column, percent: int) -> Column:
    """The band of a set's size: linked sets are in one band or in two side by side."""
    return F.floor(F.log(n) / F.log(F.lit(100 / percent))).cast("int") if percent < 100 else n.cast("int")


def crossing(rows: dict[str, np.ndarray], bits: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (a, b), a < b, of a row that asks and one that does not, of one
    ``group`` but different components ``c``, that all bounds let pass. ``both``
    is what a set shares with its list's leader, -1 if unknown."""
    asks = np.flatnonzero(rows["asks"])
    told = np.flatnonzero(~rows["asks"])
    told = told[np.lexsort((rows["n"][told], rows["group"][told]))]
    if not len(asks) or not len(told):
        return
    # sizes that can link are one run of those that stand in a group
    wide = int(rows["n"].max()) + 1
    place = rows["group"][told] * wide + rows["n"][told]
    base, n = rows["group"][asks] * wide, rows["n"][asks]
    low = np.searchsorted(place, base + needed(n, percent))
    high = np.searchsorted(place, base + np.minimum(100 * n // percent, wide - 1), "right")
    until = np.cumsum(high - low)
    cuts = np.unique(np.searchsorted(until, np.arange(0, until[-1] + PAIRS, PAIRS)))
    for s, e in zip(cuts, [*cuts[1:], len(asks)]):
        many = (high - low)[s:e]
        i = np.repeat(asks[s:e], many)
        j = told[np.repeat(low[s:e] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        a, b = rows["rep"][i], rows["rep"][j]
        # of two rows that both ask, the one of the smaller id does
        on = (rows["c"][i] != rows["c"][j]) & ((rows["c"][j] == rows["main"][j]) | (a < b))
        i, j = i[on], j[on]
        na, nb, oa, ob = rows["n"][i], rows["n"][j], rows["both"][i], rows["both"][j]
        overlap = -(-percent * (na + nb) // (100 + percent))
        # enough of each front is shared; two sets share at most what one shares with the leader, and all of the other that the leader lacks
        on = np.minimum(rows["m"][i], rows["m"][j]) >= overlap - needed(np.maximum(na, nb), percent) + 1
        on &= (oa < 0) | (ob < 0) | (np.minimum(na - oa + ob, nb - ob + oa) >= overlap)
        i, j, total = i[on], j[on], (na + nb)[on]
        most = np.zeros(len(i), np.int64)
        for t in range(0, len(i), 1 << 16):
            here = slice(t, t + (1 << 16))
            most[here] = (total[here] - np.bitwise_count(bits[i[here]] ^ bits[j[here]]).sum(1, dtype=np.int64)) // 2
        on = 100 * most >= percent * (total - most)
        a, b = rows["rep"][i[on]], rows["rep"][j[on]]
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        if len(found):
            yield found[:, 0], found[:, 1]


def _cross(lists: DataFrame, members: int, percent: int) -> DataFrame:
    """The pairs (a, b), a < b, of a list's sets outside its ``main`` component
    with those of other components that the bounds let pass. A row goes to the
    band of its size, and asks there and in the two beside it; a list of more
    than ``LIST_BLOCK`` sets is cut, and pairs of its blocks are formed apart."""
    own = F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    what = ["list", "rep", "n", "m", "c", "main", F.coalesce("both", F.lit(-1)).cast("long").alias("both"), "bits"]
    asking = lists.where("c <> main").select("*", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("_band"))
    asking = asking.select(*what, F.col("_band").alias("band"), own.alias("i"), every.alias("j"), F.lit(True).alias("asks"))
    told = lists.select(*what, "band", own.alias("j"), every.alias("i"), F.lit(False).alias("asks"))
    spark = lists.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * members // TASK_ROWS))
    names = ["list", "band", "i", "j", "rep", "n", "m", "c", "main", "both"]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, maps = [], []
        for batch in batches:
            if len(batch):
                held.append([np.array(batch.column(c), np.int64) for c in names] + [np.array(batch.column("asks").to_numpy(zero_copy_only=False), bool)])
                maps.append(np.array(batch.column("bits").flatten(), np.int64).view(np.uint64).reshape(len(batch), -1))
        if not held:
            return
        rows = dict(zip([*names, "asks"], (np.concatenate(c) for c in zip(*held))))
        bits = np.concatenate(maps)
        del held, maps
        keys = [rows.pop(c) for c in names[:4]]
        order = np.lexsort(keys)
        new = np.zeros(len(order), np.int64)
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        rows["group"] = np.empty(len(order), np.int64)
        rows["group"][order] = np.cumsum(new)
        for a, b in crossing(rows, bits, percent):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = asking.unionByName(told).repartition(parts, "list", "band", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row for each row of ``df``: its id, ``n_shingles`` and ``component_id``,
    the smallest id that links of similarity ``percent`` / 100 or more lead to."""
    spark = df.sparkSession
    arrow_rows(spark)
    survey = durable(_survey(df, id_col, text_col))
    rows = survey.where("part is null").select("_id", "n", "key", "bits", "wide")
    filled = rows.where("key is not null and _id is not null")
    classes = durable(filled.groupBy("key").agg(F.min("_id").cast("long").alias("rep"), F.max("n").alias("n"), F.first("bits").alias("bits"), F.first("wide").alias("wide")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    groups = max(8, -(-int(total * (1 - percent / 100) + classes.count()) // GROUP_POSTINGS))
    postings = _postings(df, text_col, _levels(survey), groups, percent)
    lists = durable(_lists(postings, percent))
    sweep(spark)

    # the number of a class: its key's first eight bytes, least significant first, with sign
    octets = [F.conv(F.hex(F.substring("key", i + 1, 1)), 16, 10).cast("long") for i in range(8)]
    number = octets[0]
    for i in range(1, 8):
        number = number.bitwiseOR(F.shiftleft(octets[i], 8 * i))
    # m: the shingles of a set's front that other sets have in theirs
    shared = lists.where("list is null").select("number", F.col("tokens").alias("m"))
    named = durable(shared.join(classes.select(number.alias("number"), "rep", "n", "bits"), "number"))
    members = durable(lists.where("list is not null").join(named.select("number", "rep", "n", "m"), "number").select("list", "rep", "n", "m"))

    # each list is led by the set most of which is shared: of near copies, the one they were made from
    lead = members.groupBy("list").agg(F.max(F.struct((F.col("m") / F.col("n")).alias("r"), (-F.col("rep")).alias("o"), "n", "m")).alias("l"))
    stars = members.join(lead, "list").where((F.col("rep") != -F.col("l.o")) & _may_link(percent, F.col("n"), F.col("l.n"), F.col("m"), F.col("l.m")))
    stars = durable(stars.select((-F.col("l.o")).alias("a"), F.col("rep").alias("b")).distinct())
    compared = _compared(df, stars, classes, percent, id_col, text_col)
    sweep(spark)
    links = compared.where("link").select("a", "b")
    joined = components(links)
    sweep(spark)
    placed = members.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select("list", "rep", F.coalesce("component", "rep").alias("c"))
    placed = durable(placed)
    # of each list that spans components: every pair with at least one set outside its largest component
    sizes = placed.groupBy("list", "c").agg(F.count(F.lit(1)).alias("k"))
    span = sizes.groupBy("list").agg(F.max(F.struct("k", "c")).alias("m"), F.count(F.lit(1)).alias("parts"), F.ceil(F.sum("k") / LIST_BLOCK).cast("int").alias("g")).where("parts > 1").select("list", F.col("m.c").alias("main"), "g")
    open_lists = placed.join(span, "list").join(lead.select("list", (-F.col("l.o")).alias("leader")), "list").join(named.select("rep", "n", "m", "bits"), "rep")
    # what a set shares with its list's leader, as far as it was compared with it
    answers = compared.select(F.col("a").alias("leader"), F.col("b").alias("rep"), "both")
    open_lists = open_lists.join(answers, ["leader", "rep"], "left").withColumn("both", F.when(F.col("rep") == F.col("leader"), F.col("n")).otherwise(F.col("both"))).withColumn("band", _band(F.col("n"), percent))
    cross = _cross(open_lists, members.count(), percent)
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = durable(cross.join(done, ["a", "b"], "left_anti"))
    sweep(spark)
    more = None if cross.limit(1).count() == 0 else _compared(df, cross, classes, percent, id_col, text_col).where("link").select("a", "b")
    # the components so far stand for their links
    final = joined if more is None else components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    found = classes.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select(F.col("key").alias("_k"), F.coalesce("component", "rep").alias("component_id"))
    good = filled.join(found, F.col("key") == F.col("_k")).select("_id", "n", "component_id")
    lone = rows.where("key is null or _id is null").select("_id", "n", F.col("_id").cast("long").alias("component_id"))
    return good.unionByName(lone).select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
