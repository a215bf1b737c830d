"""Best-fit packing of token sequences by bin completion, branch and bound.

Documents become pieces of at most ``capacity`` tokens (only longer ones are
cut). Only the lengths of pieces matter for packing, and there are at most
``capacity`` of these, so the search works on a histogram: a step takes the
largest length that is left, a filling of the room beside it, and applies both
as often as the counts allow. Its size does not depend on the number of
documents. The pieces then take the places of the plan by their rank within
their length, which is computed in salted groups, so a length that most pieces
share is spread over all tasks.

Bin completion: around the largest length, undominated fillings (no filling is
kept whose room another one uses better) are tried from the fullest; a branch
is left when the bins it implies, from the tokens and the waste so far, are not
fewer than the incumbent's. The first incumbent is best-fit decreasing. The
search ends at the lower bound or after ``nodes`` steps; the plan is whole in
either case.

Defined cases: a null or empty text is its end token alone; repeated rows are
packed each; an empty table gives an empty result. Columns that are not named
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, durable, join_small, thrifty
from .tokens import encoder

#: Pieces of one length and salt that are ranked together, about.
RANK_ROWS = 20_000

Step = tuple[tuple[int, ...], int]


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """The pieces of each row: id, ``piece``, ``start``, ``length``, ``ids_crc32``.
    All but the first piece of a document have ``capacity`` tokens."""
    arrow_rows(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")
    names = ["piece", "start", "length", "ids_crc32"]

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            for i, ids in enumerate(encode(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                at = 0
                size = n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    rows.append((i, piece, at, size, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + size)])))
                    at += size
                    size = capacity
            took = list(zip(*rows)) or [()] * 5
            ids_of = batch.column(0).take(pa.array(took[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_of, pa.array(took[1], pa.int32()), *[pa.array(c, pa.int64()) for c in took[2:]]], names=[id_col, *names])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long")


def fillings(counts: dict[int, int], room: int, most: int = 12, tries: int = 400) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` with the lengths that are left, from the fullest."""
    sizes = sorted((s for s, c in counts.items() if c and s <= room), reverse=True)
    found: dict[tuple[int, ...], int] = {}
    left_tries = tries

    def grow(start: int, room_left: int, chosen: tuple[int, ...]) -> None:
        nonlocal left_tries
        if left_tries <= 0 or len(found) >= 4 * most:
            return
        left_tries -= 1
        grown = False
        for i in range(start, len(sizes)):
            s = sizes[i]
            if s <= room_left and counts[s] > chosen.count(s):
                grown = True
                if room_left == s or len(chosen) < 6:
                    grow(i, room_left - s, (*chosen, s))
                else:
                    found[(*chosen, s)] = room_left - s
                if left_tries <= 0:
                    break
                if room_left == s:
                    break  # an exact filling with fewer parts dominates the rest here
        if not grown:
            found[chosen] = room_left

    # exact fillings by one and by two lengths first: nothing dominates these
    if counts.get(room, 0):
        return [(room,)]
    for a in sizes:
        b = room - a
        if b > a:
            continue
        if b and counts.get(b, 0) > (a == b):
            found[(a, b)] = 0
            if len(found) >= most:
                break
    if len(found) < most:
        grow(0, room, ())
    kept: list[tuple[int, ...]] = []
    for f in sorted(found, key=lambda f: (found[f], len(f), tuple(-s for s in f))):
        if not any(len(k) <= len(f) and sum(k) >= sum(f) and all(x >= y for x, y in zip(k, f)) for k in kept):
            kept.append(f)
        if len(kept) == most:
            break
    return kept or [()]


def times(counts: dict[int, int], items: tuple[int, ...]) -> int:
    """How often the lengths ``items`` can be taken together."""
    return min(counts[s] // items.count(s) for s in set(items))


def best_fit(counts: dict[int, int], capacity: int) -> list[Step]:
    """Best-fit decreasing on a histogram."""
    left, steps = dict(counts), []
    for s in sorted(counts, reverse=True):
        while left[s]:
            items, room = (s,), capacity - s
            for t in sorted((t for t, c in left.items() if c), reverse=True):
                while t <= room and left[t] > items.count(t):
                    items, room = (*items, t), room - t
            n = times(left, items)
            for t in items:
                left[t] -= n
            steps.append((items, n))
    return steps


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = 6_000) -> list[Step]:
    """Steps (lengths of a sequence, how often) that use all counts."""
    counts = {s: c for s, c in counts.items() if c}
    total = sum(s * c for s, c in counts.items())
    best = best_fit(counts, capacity)
    best_bins, least = sum(n for _, n in best), -(-total // capacity)
    budget = nodes
    # depth first without recursion: (counts left, steps, bins, waste, untried fillings)
    stack: list[tuple[dict[int, int], list[Step], int, int]] = [(counts, [], 0, 0)]
    while stack and budget > 0 and best_bins > least:
        left, steps, bins, waste = stack.pop()
        budget -= 1
        if not left:
            if bins < best_bins:
                best, best_bins = steps, bins
            continue
        if -(-(total + waste) // capacity) >= best_bins:
            continue
        s = max(left)
        left[s] -= 1
        options = fillings(left, capacity - s)
        left[s] += 1
        branches = []
        for f in options:
            items = (s, *f)
            n = times(left, items)
            rest = dict(left)
            for t in items:
                rest[t] -= n
            branches.append(({t: c for t, c in rest.items() if c}, [*steps, (items, n)], bins + n, waste + n * (capacity - sum(items))))
        stack += branches[::-1]
    return best


def plan_rows(steps: list[Step]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) of each place."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for items, n in steps:
        offset = 0
        for s in items:
            at = used.get(s, 0)
            rows.append((s, at, at + n, sequence, offset))
            used[s] = at + n
            offset += s
        sequence += n
    return rows


def pack(parts: DataFrame, capacity: int = 1024, nodes: int = 6_000, id_col: str = "doc_id") -> DataFrame:
    """``parts`` (as ``pieces`` returns them) with ``sequence_id`` and ``offset``."""
    spark = parts.sparkSession
    # at most ``capacity`` rows come to the driver
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan_rows(complete_bins(counts, capacity, nodes))
    plan = spark.createDataFrame(rows, "length long, _lo long, _hi long, _seq long, offset long")
    salts = max(1, -(-max(counts.values(), default=1) // RANK_ROWS))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col), F.col("piece")), F.lit(salts)))
    cells = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")
    cells = durable(cells.select("length", "_salt", before.alias("_before")))
    own = Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "start", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(own) - 1)
    ranked = join_small(ranked, cells, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # the plan has at most a few places for each step, and at most ``capacity`` lengths run out
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))).drop(plan["length"])
    return placed.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("_seq") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), "offset")


def best_fit_packing(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 1024, nodes: int = 6_000) -> DataFrame:
    """The pieces of all rows of ``df`` and their places in as few sequences as the search finds."""
    return pack(durable(pieces(df, tokenizer, id_col, text_col, end_id, capacity)), capacity, nodes, id_col)
