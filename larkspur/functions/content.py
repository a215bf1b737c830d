"""Content hashes, addresses and chunks (HSH1-HSH10, CNT1-CNT13, WIN10, SET5, AGG34)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def address(data: Column, algorithm: str = "sha256") -> Column:
    """CNT1: ``algorithm:hex``."""
    return F.concat(F.lit(f"{algorithm}:"), F.sha2(data, int(algorithm[3:])))


def storage_key(addr: Column) -> Column:
    """CNT1: ``algorithm/first four/rest``."""
    algorithm, hexed = F.substring_index(addr, ":", 1), F.substring_index(addr, ":", -1)
    return F.concat_ws("/", algorithm, F.left(hexed, F.lit(4)), F.substring(hexed, 5, 200))


def parse_key(key: Column) -> Column:
    """CNT2: the address of a storage key; null for other text."""
    p = F.split(key, "/")
    ok = (F.size(p) == 3) & F.get(p, 0).isin("sha256", "sha512", "blake3") & (F.length(F.get(p, 1)) == 4)
    return F.when(ok, F.concat(F.get(p, 0), F.lit(":"), F.get(p, 1), F.get(p, 2)))


def verified(data: Column, addr: Column) -> Column:
    """CNT3, HSH5."""
    return address(data) == addr


def chunk_rows(df: DataFrame, keys: list[str], data: str, size: int) -> DataFrame:
    """CNT4: fixed chunks of a binary or text column: keys, idx, offset, length, chunk, hash."""
    raw = F.col(data).cast("binary")
    n = F.octet_length(raw)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array(F.lit(0)))
    rows = df.select(*keys, raw.alias("_d"), F.posexplode(starts).alias("idx", "offset"))
    chunk = F.expr(f"substring(_d, offset + 1, {size})")
    return rows.select(*keys, "idx", "offset", F.octet_length(chunk).alias("length"), chunk.alias("chunk"), F.sha2(chunk, 256).alias("hash"))


def reassemble(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """CNT6: each object's text of its chunks in order, and whether all verify."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("idx", F.hex("chunk").alias("h")))), lambda x: x["h"])
    return chunks.groupBy(*keys).agg(F.unhex(F.array_join(parts, "")).alias("data"), F.every(F.sha2("chunk", 256) == F.col("hash")).alias("verified"))


def manifest_check(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """WIN10: whether the indexes run from 0 and the offsets follow the sizes."""
    w = Window.partitionBy(*keys).orderBy("idx")
    before = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = chunks.withColumn("_ok", (F.col("idx") == F.row_number().over(w) - 1) & (F.col("offset") == before))
    return rows.groupBy(*keys).agg(F.every("_ok").alias("valid"), F.count(F.lit(1)).alias("chunks"), F.sum("length").alias("total"))


#: A byte whose low six bits are zero, and two zero bytes.
BOUNDARY = re.compile(rb"[\x00\x40\x80\xc0]\x00\x00")


def content_chunks(df: DataFrame, key: str, data: str, least: int = 256, most: int = 4096) -> DataFrame:
    """CNT5: content-defined chunks. A chunk of ``least`` bytes or more ends after
    a byte b[i] with b[i] = b[i-1] = 0 and the low six bits of b[i-2] zero, or at ``most``."""
    kind = df.schema[key].dataType.simpleString()

    def cuts(raw: bytes) -> list[int]:
        out, start = [], 0
        while start < len(raw):
            end = min(start + most, len(raw))
            found = BOUNDARY.search(raw, max(0, start + least - 3), end)
            if found:
                end = found.end()
            out.append(end - start)
            start = end
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, n) for k, raw in zip(pdf[key], pdf["_d"]) for i, n in enumerate(cuts(bytes(raw or b"")))]
            yield pd.DataFrame(rows, columns=[key, "idx", "length"])

    return df.select(key, F.col(data).cast("binary").alias("_d")).mapInPandas(run, f"`{key}` {kind}, idx int, length int")


def unique_contents(df: DataFrame, data: str) -> DataFrame:
    """SET5, AGG34: each distinct content once, with its number of references."""
    return df.groupBy(F.sha2(F.col(data), 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("ref_count"), F.first(F.octet_length(F.col(data))).alias("size_bytes"))


def hmac_sha256(key: str, message: Column) -> Column:
    """HSH2, CNT12: the hex code of a message under one key, of two hashes over
    padded keys; keys of 64 bytes at most."""
    raw = key.encode()
    if len(raw) > 64:
        raise ValueError("the key is longer than a block")
    raw = raw.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def canonical_context(context: Column) -> Column:
    """HSH7: sorted ``k=v`` pairs joined by commas."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(context), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")


_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)


def _compress(cv: list[int], block: bytes, counter: int, size: int, flags: int) -> list[int]:
    """The BLAKE3 compression function, from its published description."""
    m = [int.from_bytes(block[i : i + 4].ljust(4, b"\0"), "little") for i in range(0, 64, 4)]
    s = [*cv, *_IV[:4], counter & 0xFFFFFFFF, counter >> 32, size, flags]

    def mix(a: int, b: int, c: int, d: int, x: int, y: int) -> None:
        for word, r, q in ((x, 16, 12), (y, 8, 7)):
            s[a] = (s[a] + s[b] + word) & 0xFFFFFFFF
            t = s[d] ^ s[a]
            s[d] = (t >> r | t << (32 - r)) & 0xFFFFFFFF
            s[c] = (s[c] + s[d]) & 0xFFFFFFFF
            t = s[b] ^ s[c]
            s[b] = (t >> q | t << (32 - q)) & 0xFFFFFFFF

    for _ in range(7):
        for i in range(4):
            mix(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            mix(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        m = [m[j] for j in _ORDER]
    return [s[i] ^ s[i + 8] for i in range(8)]


def blake3_hex(data: bytes) -> str:
    """HSH1: BLAKE3 of bytes."""

    def chunk(at: int, root: bool) -> list[int]:
        cv, piece = list(_IV), data[at * 1024 : at * 1024 + 1024]
        blocks = [piece[i : i + 64] for i in range(0, len(piece), 64)] or [b""]
        for i, b in enumerate(blocks):
            flags = (1 if i == 0 else 0) | (2 if i == len(blocks) - 1 else 0) | (8 if root and i == len(blocks) - 1 else 0)
            cv = _compress(cv, b.ljust(64, b"\0"), at, len(b), flags)
        return cv

    def tree(low: int, high: int, root: bool) -> list[int]:
        if high - low == 1:
            return chunk(low, root)
        mid = low + (1 << ((high - low - 1).bit_length() - 1))
        pair = b"".join(w.to_bytes(4, "little") for w in tree(low, mid, False) + tree(mid, high, False))
        return _compress(list(_IV), pair, 0, 64, 4 | (8 if root else 0))

    words = tree(0, max(1, -(-len(data) // 1024)), True)
    return b"".join(w.to_bytes(4, "little") for w in words).hex()


def blake3(data: Column) -> Column:
    """HSH1: BLAKE3 as a Column, by an Arrow function, as no built-in one exists."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else blake3_hex(bytes(b)))

    return run(data.cast("binary"))


def codes_equal(one: Column, two: Column) -> Column:
    """HSH3: whether two codes are the same, by their hashes, so that where they
    differ is not told by how long the comparison takes."""
    return F.sha2(one.cast("binary"), 256) == F.sha2(two.cast("binary"), 256)
