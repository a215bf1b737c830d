"""JSON documents of any shape, evaluation scores, envelopes (DET9, DET19,
ANO19, UDF1, STR2, STR16, HSH8, HSH9, HSH10, DQL22)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import anonymize as A
from . import detection as D


def _walk(value: object, path: str) -> Iterator[tuple[str, str]]:
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from _walk(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _walk(v, f"{path}.[{i}]" if path else f"[{i}]")


def _rebuild(value: object, path: str, new: dict[str, str]) -> object:
    if isinstance(value, str):
        return new.get(path, value)
    if isinstance(value, dict):
        return {k: _rebuild(v, f"{path}.{k}" if path else k, new) for k, v in value.items()}
    if isinstance(value, list):
        return [_rebuild(v, f"{path}.[{i}]" if path else f"[{i}]", new) for i, v in enumerate(value)]
    return value


def _parsed(text: str | None) -> object:
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def leaves(document: Column) -> Column:
    """DET9: the strings of a JSON text with their paths (``a.b.[0]``), by an Arrow
    function, as VARIANT cannot be walked to any depth by Columns."""

    @F.pandas_udf("array<struct<path:string,value:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"path": p, "value": v} for p, v in _walk(_parsed(t), "")])

    return run(document)


def detect_json(df: DataFrame, keys: Sequence[str], document: str, **options: object) -> DataFrame:
    """DET9, DET19: one row for each hit in a string of a document, with its path."""
    rows = df.select(*keys, F.explode_outer(leaves(F.col(document))).alias("_l")).where("_l IS NOT NULL").select(*keys, "_l.path", F.col("_l.value").alias("text"))
    return D.hit_rows(rows, [*keys, "path"], "text", **options).drop("text")


def anonymize_json(df: DataFrame, key: str, document: str, rules: dict[str, str] | None = None, default: str = "mask") -> DataFrame:
    """ANO19: (key, document) with the strings that have hits rewritten; keys,
    numbers and structure stay. ``key`` must be unique."""
    rows = df.select(key, F.explode_outer(leaves(F.col(document))).alias("_l")).where("_l IS NOT NULL").select(key, "_l.path", F.col("_l.value").alias("text"))
    hit = D.detect(rows).where(F.size("hits") > 0)
    new = hit.select(key, "path", A.anonymize(F.col("text"), F.col("hits"), A.DEFAULTS if rules is None else rules, default).alias("new"))
    maps = new.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("path", "new"))).alias("_m"))

    @F.pandas_udf("string")
    def put(texts: pd.Series, changes: pd.Series) -> pd.Series:
        return pd.Series([t if m is None else json.dumps(_rebuild(_parsed(t), "", dict(m)), ensure_ascii=False, separators=(",", ":")) for t, m in zip(texts, changes)], dtype=object)

    return df.select(key, document).join(maps, key, "left").select(key, put(F.col(document), F.col("_m")).alias(document))


def json_depth(document: Column) -> Column:
    """STR2: the depth of brackets of a JSON text, strings apart."""
    bare = F.regexp_replace(F.regexp_replace(document, r'"(?:[^"\\]++|\\.)*+"', ""), r"[^\[\]{}]", "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(bare, ""), zero, step, lambda acc: acc["most"])


def with_custom_detector(df: DataFrame, keys: Sequence[str], detector: Callable[[str], list[tuple[int, int, str, float]]], text_col: str = "text") -> DataFrame:
    """UDF1: built-in hits and those of a Python detector (start, end, type,
    confidence), with the pairwise removal of overlaps."""

    @F.pandas_udf("array<struct<start:int,end:int,confidence:double,pii_type:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": s, "end": e, "confidence": c, "pii_type": k} for s, e, k, c in (detector(t) if t else [])])

    own = F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["confidence"].alias("confidence"), h["pii_type"].alias("pii_type")))
    found = D.detect(df.select(*keys, text_col), text_col).select(*keys, F.concat(own, run(F.col(text_col))).alias("_h"))
    return found.select(*keys, F.inline(D.dedup_pairwise(F.col("_h"))))


def envelope_encrypt(value: Column, master: Column, dek: Column) -> Column:
    """HSH8: the value under its own data key, and that key under the master key."""
    return F.struct(F.base64(F.aes_encrypt(value, dek, F.lit("GCM"))).alias("data"), F.base64(F.aes_encrypt(dek, master, F.lit("GCM"))).alias("key"))


def envelope_decrypt(sealed: Column, master: Column) -> Column:
    dek = F.aes_decrypt(F.unbase64(sealed["key"]), master, F.lit("GCM"))
    return F.aes_decrypt(F.unbase64(sealed["data"]), dek, F.lit("GCM")).cast("string")


def rewrap(sealed: Column, old: Column, new: Column) -> Column:
    """HSH10: the data key under a new master key; the data stays as it is."""
    dek = F.aes_decrypt(F.unbase64(sealed["key"]), old, F.lit("GCM"))
    return F.struct(sealed["data"].alias("data"), F.base64(F.aes_encrypt(dek, new, F.lit("GCM"))).alias("key"))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def rouge1(candidate: Column, reference: Column) -> Column:
    """DQL22: the share of the reference's distinct words that the candidate has."""
    r = F.array_distinct(tokens(reference))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(r, tokens(candidate))), F.size(r)), F.lit(0.0))


def exact_match(candidate: Column, reference: Column) -> Column:
    return (F.trim(candidate) == F.trim(reference)).cast("double")


def _with_paths(df: DataFrame, column: str, paths: Sequence[str], change: Callable[[Column], Column]) -> Column:
    """A struct with the texts at dotted paths changed; missing paths are passed over."""
    out = F.col(column)
    for path in paths:
        kind = df.schema[column].dataType
        for name in path.split("."):
            kind = kind[name].dataType if hasattr(kind, "names") and name in kind.names else None
            if kind is None:
                break
        if kind is not None:
            out = out.withField(path, change(F.col(f"{column}.{path}")))
    return out


def seal_fields(df: DataFrame, column: str, paths: Sequence[str], key: Column) -> Column:
    """HSH9: the texts at these paths encrypted."""
    return _with_paths(df, column, paths, lambda v: A.encrypt(v, key))


def open_fields(df: DataFrame, column: str, paths: Sequence[str], key: Column) -> Column:
    """HSH9: the texts at these paths decrypted."""
    return _with_paths(df, column, paths, lambda v: A.decrypt(v, key))
