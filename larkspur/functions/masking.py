"""Further anonymization as Columns: presets, label masks, typed tokens, salted
hashes, generalization levels, pseudonyms, strategies of the user's own, and
tags of sub-words merged to entities (ANO21, ANO24-ANO28, ANO30, ANO33, DET25, LIF20, UDF7)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .anonymize import DEFAULTS, apply_strategy, decrypt, encrypt, strategy_for, tokenize

# The labels of masked types.
LABELS = {
    "Email": "[EMAIL_REDACTED]",
    "Phone": "[PHONE_REDACTED]",
    "Ssn": "[SSN_REDACTED]",
    "CreditCard": "[CARD_REDACTED]",
    "Name": "[NAME_REDACTED]",
    "IpAddress": "[IP_REDACTED]",
    "ApiKey": "[KEY_REDACTED]",
}
# The names of strategies that clients send, and what they are here.
ALIASES = {"redact": "redact", "mask": "mask", "replace": "substitute", "pseudonymize": "substitute", "generalize": "generalize", "encrypt": "encrypt", "remove": "remove"}


@dataclass(frozen=True)
class Preset:
    """ANO21: what is found, and how it is rewritten."""

    default: str = "mask"
    rules: Mapping[str, str] = field(default_factory=lambda: dict(DEFAULTS))
    min_confidence: float = 0.5
    min_risk: str = "Low"


# The presets' rules over the usual ones.
PRESETS = {
    "hipaa": Preset("redact", {**DEFAULTS, "Name": "substitute", "DateOfBirth": "generalize", "Ssn": "redact", "MedicalRecord": "tokenize", "HealthInfo": "redact"}, 0.3),
    "gdpr": Preset("mask", dict(DEFAULTS)),
    "pci": Preset("mask", {**DEFAULTS, "CreditCard": "mask", "BankAccount": "redact"}, 0.5, "High"),
}


def label_mask(value: Column, pii_type: Column, labels: Mapping[str, str] = LABELS, mark: str = "*", partial: int = 0, keep_length: bool = True) -> Column:
    """ANO24: the type's label; without one, marks for all but ``partial``
    characters at both ends, or for all of them, or eight."""
    n = F.length(value)
    whole = F.repeat(F.lit(mark), n) if keep_length else F.lit(mark * 8)
    shown = F.concat(F.left(value, F.lit(partial)), F.repeat(F.lit(mark), n - 2 * partial), F.right(value, F.lit(partial)))
    out = F.when(n > 2 * partial, shown).otherwise(whole) if partial else whole
    for kind, text in labels.items():
        out = F.when(pii_type == kind, F.lit(text)).otherwise(out)
    return F.when(value.isNotNull(), out)


def typed_token(pii_type: Column, number: Column | None = None, prefix: str = "TOK") -> Column:
    """ANO25: ``PREFIX_00000042`` of a number, else ``TYPE_TOKEN_uuid``."""
    if number is None:
        return F.concat(F.upper(pii_type), F.lit("_TOKEN_"), F.expr("uuid()"))
    return F.format_string(f"{prefix}_%08d", number)


def sequential_tokens(values: DataFrame, value: str = "value", shards: int = 1 << 12) -> DataFrame:
    """ANO25: (value, token): the distinct values numbered from 1 by hash. A
    number is a place in a slice of the hashes after the slices before it, so
    no task sees all values."""
    h = F.xxhash64(F.col(value))
    rows = values.select(value).where(F.col(value).isNotNull()).distinct().select(value, h.alias("_h"), F.pmod(F.shiftright(h, 52), shards).alias("_s"))
    sizes = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    # at most ``shards`` rows
    before = sizes.select("_s", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_s")) - F.col("_n")).alias("_b"))
    place = F.row_number().over(Window.partitionBy("_s").orderBy("_h", value))
    numbered = rows.withColumn("_k", place).join(F.broadcast(before), "_s")
    return numbered.select(value, typed_token(F.lit(""), F.col("_k") + F.col("_b")).alias("token"))


def salted(value: Column, salt: str, pepper: str = "", bits: int = 256) -> Column:
    """ANO26: SHA-2 of value, pepper and salt, in this order."""
    return F.sha2(F.concat(value, F.lit(pepper), F.lit(salt)), bits)


def generalized(value: Column, kind: str, level: int) -> Column:
    """ANO27: an age, a ZIP code or an ISO date at a level of its hierarchy;
    ``[GENERALIZED]`` where the level or the value has none. Dates become month,
    year and decade of the date itself."""
    n = F.when(value.rlike("^[0-9]{1,9}$"), value.cast("long"))
    five, ten = F.floor(n / 5) * 5, F.floor(n / 10) * 10
    year, month = F.regexp_extract(value, r"^(\d{4})-(\d{2})", 1), F.regexp_extract(value, r"^(\d{4})-(\d{2})", 2)
    dated = year != ""
    levels: dict[str, list[Column]] = {
        "age": [F.concat_ws("-", five.cast("string"), (five + 4).cast("string")), F.concat(ten.cast("string"), F.lit("s")), F.lit("Adult")],
        "zip": [F.when(F.length(value) >= 3, F.concat(F.left(value, F.lit(3)), F.lit("**"))), F.lit("US")],
        "date": [F.when(dated, F.concat_ws("/", month, year)), F.when(dated, year), F.when(dated, F.concat(F.left(year, F.lit(3)), F.lit("X")))],
    }
    of_kind = levels.get(kind, [])
    out = of_kind[level] if level < len(of_kind) else F.lit(None).cast("string")
    if kind == "age" and level < 2:
        out = F.when(n.isNotNull(), out)
    return F.when(value.isNotNull(), F.coalesce(out, F.lit("[GENERALIZED]")))


def pseudonym(value: Column, pools: Mapping[str, Sequence[str]], pii_type: Column) -> Column:
    """ANO28: a stand-in from the type's pool by the value's hash, the same for
    the same value; types without a pool are redacted."""
    h = F.conv(F.left(F.sha2(value, 256), F.lit(7)), 16, 10).cast("long")
    out = F.lit("[REDACTED]")
    for kind, pool in pools.items():
        out = F.when(pii_type == kind, F.element_at(F.array(*[F.lit(p) for p in pool]), (h % len(pool) + 1).cast("int"))).otherwise(out)
    return F.when(value.isNotNull(), out)


@dataclass(frozen=True)
class Strategy:
    """UDF7: a strategy of the user's own: its Column, the types that it takes
    (none named: all), and whether it can be undone."""

    name: str
    apply: Callable[[Column, Column], Column]
    types: tuple[str, ...] = ()
    reversible: bool = False


def with_strategies(value: Column, pii_type: Column, strategy: Column, own: Sequence[Strategy]) -> Column:
    """ANO33, UDF7: the built-in strategies, under clients' names too, and the
    user's own where they take the type."""
    name = strategy
    for alias, known in ALIASES.items():
        name = F.when(strategy == alias, known).otherwise(name)
    out = apply_strategy(value, pii_type, name)
    for s in own:
        fits = strategy == s.name
        if s.types:
            fits = fits & pii_type.isin(*s.types)
        out = F.when(fits, s.apply(value, pii_type)).otherwise(out)
    return out


def preset_value(value: Column, pii_type: Column, preset: Preset) -> Column:
    return apply_strategy(value, pii_type, strategy_for(pii_type, preset.rules, preset.default))


def merge_tags(tags: Column) -> Column:
    """DET25: entities of tagged sub-words, an array of (start, end, label,
    confidence) in order: ``B-X`` starts an entity; ``I-X`` (or ``X``) extends one
    of its kind or starts one; ``O`` ends it; others are passed over. The
    entity's confidence is the mean. Result: array of (label, start, end, confidence)."""
    kind = "struct<label:string,start:int,end:int,total:double,n:int>"
    zero = F.struct(F.lit(None).cast(kind).alias("now"), F.array().cast(f"array<{kind}>").alias("out"))

    def closed(acc: Column) -> Column:
        return F.when(acc["now"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["now"]))

    def step(acc: Column, t: Column) -> Column:
        dashed = F.contains(t["label"], F.lit("-"))
        tag = F.when(t["label"] == "O", "O").when(dashed, F.substring_index(t["label"], "-", 1)).otherwise("I")
        label = F.when(dashed, F.get(F.split(t["label"], "-"), 1)).otherwise(t["label"])
        fresh = F.struct(label.alias("label"), t["start"].cast("int").alias("start"), t["end"].cast("int").alias("end"), t["confidence"].cast("double").alias("total"), F.lit(1).alias("n"))
        longer = F.struct(acc["now"]["label"].alias("label"), acc["now"]["start"].alias("start"), t["end"].cast("int").alias("end"), (acc["now"]["total"] + t["confidence"]).alias("total"), (acc["now"]["n"] + 1).alias("n"))
        same = acc["now"].isNotNull() & (acc["now"]["label"] == label)
        ended = F.struct(F.lit(None).cast(kind).alias("now"), closed(acc).alias("out"))
        begun = F.struct(fresh.alias("now"), closed(acc).alias("out"))
        return F.when(tag == "O", ended).when(tag == "B", begun).when((tag == "I") & same, F.struct(longer.alias("now"), acc["out"].alias("out"))).when(tag == "I", begun).otherwise(acc)

    entities = F.aggregate(tags, zero, step, closed)
    return F.transform(entities, lambda e: F.struct(e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end"), (e["total"] / e["n"]).alias("confidence")))


def context_tokens(hits: DataFrame) -> DataFrame:
    """LIF20: (value, token, uses) of an anonymization: each value's token and
    each token's value, with the number of hits."""
    return hits.groupBy("value").agg(F.count(F.lit(1)).alias("uses")).select("value", tokenize(F.col("value")).alias("token"), "uses")


def vault_store(values: DataFrame, value: str, key: Column, created: Column, days: int) -> DataFrame:
    """ANO30: (token, sealed, created_at, expires_at, access_count): values under
    their tokens, encrypted."""
    rows = values.select(F.col(value).alias("_v"), created.alias("created_at")).where("_v IS NOT NULL")
    rows = rows.groupBy("_v").agg(F.max("created_at").alias("created_at"))
    return rows.select(tokenize(F.col("_v")).alias("token"), encrypt(F.col("_v"), key).alias("sealed"), "created_at", (F.col("created_at") + F.expr(f"INTERVAL {days} DAYS")).alias("expires_at"), F.lit(0).cast("long").alias("access_count"))


def vault_read(vault: DataFrame, now: Column, key: Column) -> tuple[DataFrame, DataFrame]:
    """ANO30: the vault with one more access of each live token, and (token,
    opened) of these."""
    live = F.col("expires_at") > now
    counted = vault.withColumn("access_count", F.col("access_count") + live.cast("long"))
    return counted, vault.where(live).select("token", decrypt(F.col("sealed"), key).alias("opened"))


def vault_cleanup(vault: DataFrame, now: Column) -> DataFrame:
    """ANO30: the vault without expired tokens."""
    return vault.where(F.col("expires_at") > now)
