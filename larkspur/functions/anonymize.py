"""Anonymization strategies as Columns (ANO1-ANO35 but ANO24, ANO27, ANO30)."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .detection import digits

# The strategy of each type where no rule says otherwise.
DEFAULTS: dict[str, str] = {"CreditCard": "mask", "Ssn": "mask", "Phone": "mask", "Email": "substitute", "Password": "redact", "ApiKey": "redact"}
NAMES = ("John Doe", "Jane Smith", "Alex Johnson", "Sam Wilson", "Morgan Lee", "Taylor Brown")
AGES = ((17, "0-17"), (24, "18-24"), (34, "25-34"), (44, "35-44"), (54, "45-54"), (64, "55-64"), (74, "65-74"))
# ANO22: rules of the policy presets, (type, strategy).
POLICIES: dict[str, tuple[tuple[str, str], ...]] = {
    "gdpr": (("Email", "mask"), ("Phone", "mask"), ("Name", "substitute"), ("Address", "generalize"), ("IpAddress", "hash"), ("DateOfBirth", "generalize")),
    "hipaa": (("Name", "redact"), ("Ssn", "redact"), ("Phone", "redact"), ("Email", "redact"), ("Address", "redact"), ("DateOfBirth", "generalize")),
    "pci": (("CreditCard", "mask"),),
}
Generator = Callable[[Column], Column]


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def relayout(value: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """ANO4: ``value`` with each digit starred unless ``keep(place, digits)``,
    other characters as they are; places count digits from 0."""
    n = F.length(digits(value))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        shown = F.when(~digit | keep(acc["at"], n), c).otherwise("*")
        return F.struct((acc["at"] + digit.cast("int")).alias("at"), F.concat(acc["out"], shown).alias("out"))

    return F.aggregate(F.split(value, ""), zero, step, lambda acc: acc["out"])


def mask(value: Column, pii_type: Column) -> Column:
    """ANO3: the mask of each type; other types star every byte."""
    n = F.length(digits(value))
    stars = F.repeat(F.lit("*"), F.octet_length(value))
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    named = F.when(F.length(local) <= 2, F.repeat(F.lit("*"), F.length(local))).otherwise(F.concat(F.left(local, F.lit(1)), F.repeat(F.lit("*"), F.length(local) - 2), F.right(local, F.lit(1))))
    return (
        F.when((pii_type == "CreditCard") & (n >= 4), relayout(value, lambda at, n: at >= n - 4))
        .when((pii_type == "Ssn") & (n >= 4), F.concat(F.lit("***-**-"), F.right(digits(value), F.lit(4))))
        .when((pii_type == "Email") & F.contains(value, F.lit("@")), F.concat(named, F.lit("@"), domain))
        .when((pii_type == "Phone") & (n >= 6), relayout(value, lambda at, n: (at < 3) | (at >= n - 2)))
        .otherwise(stars)
    )


def redact(value: Column) -> Column:
    """ANO5."""
    return F.when(value.isNotNull(), F.lit("[REDACTED]"))


def email_like(value: Column) -> Column:
    """ANO13."""
    return F.concat(F.lit("user"), F.left(sha256(value), F.lit(8)), F.lit("@example.com"))


def phone_like(value: Column) -> Column:
    """ANO14: from the first seven decimal characters of the hash."""
    d = F.left(F.regexp_replace(sha256(value), "[a-f]", ""), F.lit(7))
    return F.concat(F.lit("555-"), F.left(d, F.lit(3)), F.lit("-"), F.substring(d, 4, 4))


def name_like(value: Column) -> Column:
    """ANO15."""
    at = F.conv(F.left(sha256(value), F.lit(2)), 16, 10).cast("int") % len(NAMES)
    return F.element_at(F.array(*[F.lit(n) for n in NAMES]), at + 1)


def address_like(value: Column) -> Column:
    """ANO16."""
    n = F.conv(F.left(sha256(value), F.lit(3)), 16, 10).cast("int") % 900 + 100
    return F.concat(n.cast("string"), F.lit(" Main St, Anytown, ST 00000"))


GENERATORS: dict[str, Generator] = {"Email": email_like, "Phone": phone_like, "Name": name_like, "Address": address_like}


def substitute(value: Column, pii_type: Column, generators: Mapping[str, Generator] = GENERATORS) -> Column:
    """ANO6, UDF4: a likeness by type, else redacted."""
    out = redact(value)
    for kind, f in generators.items():
        out = F.when(pii_type == kind, f(value)).otherwise(out)
    return out


def tokenize(value: Column) -> Column:
    """ANO7: the same token for the same value."""
    return F.concat(F.lit("TOK_"), F.left(sha256(value), F.lit(16)))


def random_token() -> Column:
    """ANO7, ANO25: a token that tells nothing of the value."""
    return F.concat(F.lit("TOK_"), F.expr("uuid()"))


def encrypt(value: Column, key: Column) -> Column:
    """ANO8, HSH6: AES-GCM under a given key, as ``ENC:`` and base64."""
    return F.concat(F.lit("ENC:"), F.base64(F.aes_encrypt(value, key, F.lit("GCM"))))


def decrypt(value: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(F.substring(value, 5, 1_000_000_000)), key, F.lit("GCM")).cast("string")


def hashed(value: Column, bits: int = 256, salt: str = "", pepper: str = "") -> Column:
    """ANO9, ANO26: hex SHA-2 of value, pepper and salt."""
    return F.sha2(F.concat(value, F.lit(pepper + salt)), bits)


def age_range(value: Column) -> Column:
    """ANO10: a range of ages; text that is no whole number stays."""
    n = F.when(value.rlike("^[0-9]+$"), value.cast("long"))
    out = F.when(n.isNull(), value)
    for top, label in AGES:
        out = out.when(n <= top, label)
    return out.otherwise("75+")


def date_to_year(value: Column) -> Column:
    """ANO10: what stands before the first dash, if four characters long."""
    year = F.substring_index(value, "-", 1)
    return F.when(F.length(year) == 4, year).otherwise(value)


def number_range(value: Column, step: float = 10.0) -> Column:
    """ANO10: the range of width ``step`` that holds the number."""
    n = value.try_cast("double")
    low = F.floor(n / step) * step
    show = lambda x: x.cast("long").cast("string")
    return F.when(n.isNull(), value).otherwise(F.concat(show(low), F.lit("-"), show(low + step)))


def truncate(value: Column, length: int = 3) -> Column:
    """ANO11."""
    return F.when(F.length(value) > length, F.concat(F.left(value, F.lit(length)), F.lit("..."))).otherwise(value)


def noise(value: Column, level: float = 0.1, seed: int | None = None) -> Column:
    """ANO12: a number within ``level`` of the value, two decimals; null, not an
    error, for text that is no number (filter on it to reject the record)."""
    n = value.try_cast("double")
    return F.round(n * (1 + (F.rand(seed) * 2 - 1) * level), 2).cast("string")


def laplace(value: Column, sensitivity: float, epsilon: float, seed: int | None = None) -> Column:
    """ANO29: Laplace noise by its inverse distribution."""
    u = F.rand(seed) - 0.5
    return value - F.lit(sensitivity / epsilon) * F.signum(u) * F.log(1 - 2 * F.abs(u))


def gaussian(value: Column, sensitivity: float, epsilon: float, delta: float = 1e-5, seed: int | None = None) -> Column:
    """ANO29: Gaussian noise with the usual calibration."""
    return value + F.randn(seed) * F.lit(sensitivity / epsilon) * F.sqrt(F.lit(2.0) * F.log(F.lit(1.25 / delta)))


def apply_strategy(value: Column, pii_type: Column, strategy: Column, key: Column | None = None) -> Column:
    """ANO1: the value under the named strategy (shuffle acts on datasets, and
    is the identity here); an unknown name redacts."""
    return (
        F.when(strategy == "mask", mask(value, pii_type))
        .when(strategy == "redact", redact(value))
        .when(strategy.isin("substitute", "pseudonymize", "replace"), substitute(value, pii_type))
        .when(strategy == "tokenize", tokenize(value))
        .when(strategy == "hash", hashed(value))
        .when(strategy == "remove", F.lit(""))
        .when(strategy == "generalize", F.when(pii_type == "DateOfBirth", date_to_year(value)).otherwise(value))
        .when(strategy == "truncate", truncate(value))
        .when(strategy == "encrypt", encrypt(value, key) if key is not None else redact(value))
        .when(strategy.isin("shuffle", "none"), value)
        .otherwise(redact(value))
    )


def strategy_for(pii_type: Column, rules: Mapping[str, str] = DEFAULTS, default: str = "mask") -> Column:
    """ANO2: the strategy of a type."""
    out = F.lit(default)
    for kind, name in rules.items():
        out = F.when(pii_type == kind, name).otherwise(out)
    return out


def splice(text: Column, hits: Column, replacement: Callable[[Column], Column]) -> Column:
    """ANO17: ``text`` with each hit, in order and apart, replaced."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, h["start"] - acc["at"])
        return F.struct(h["end"].alias("at"), F.concat(acc["out"], gap, replacement(h)).alias("out"))

    whole = F.aggregate(hits, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(hits) == 0, text).otherwise(whole)


def anonymize(text: Column, hits: Column, rules: Mapping[str, str] = DEFAULTS, default: str = "mask", key: Column | None = None) -> Column:
    """ANO18: each hit of ``text`` rewritten by its type's strategy."""
    return splice(text, hits, lambda h: apply_strategy(h["value"], h["pii_type"], strategy_for(h["pii_type"], rules, default), key))


def token_table(hits: DataFrame) -> DataFrame:
    """ANO20, LIF20: (token, value) of all hits, once each."""
    return hits.select(tokenize(F.col("value")).alias("token"), "value").distinct()


def reidentify(df: DataFrame, tokens: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """ANO20: every known token in the texts replaced by its value, by a join of
    the texts' tokens with the token table."""
    regex = "TOK_[0-9a-f]{16}"
    rows = df.select(*keys, text_col, F.posexplode_outer(F.regexp_extract_all(F.col(text_col), F.lit(regex), F.lit(0))).alias("_i", "_t"))
    rows = rows.join(tokens.select(F.col("token").alias("_t"), F.col("value").alias("_value")), "_t", "left")
    parts = rows.groupBy(*keys, text_col).agg(F.sort_array(F.collect_list(F.struct("_i", F.coalesce("_value", "_t").alias("v")))).alias("_p"))
    gaps = F.split(F.col(text_col), regex, -1)
    whole = F.array_join(F.zip_with(gaps, F.transform("_p", lambda p: p["v"]), lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    return parts.select(*keys, whole.alias(text_col))


def shuffle_column(df: DataFrame, key: str, column: str, seed: int = 1) -> DataFrame:
    """ANO35: the values of ``column`` permuted over the rows: the k-th key by
    hash gets the value of the k-th key by another hash. Ranks are taken in
    slices of the hash, so no task sees all rows."""

    def ranked(salt: int, *cols: str) -> DataFrame:
        h = F.xxhash64(F.col(key), F.lit(salt))
        rows = df.select(*cols, h.alias("_h"), F.shiftright(h, 52).alias("_s"))
        sizes = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
        before = sizes.withColumn("_b", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_s")) - F.col("_n")).select("_s", "_b")
        inner = F.row_number().over(Window.partitionBy("_s").orderBy("_h", key))
        return rows.withColumn("_k", inner).join(F.broadcast(before), "_s").withColumn("_k", F.col("_k") + F.col("_b")).drop("_h", "_s", "_b")

    other = [c for c in df.columns if c != column]
    return ranked(seed, *other).join(ranked(seed + 1, key, column).select("_k", column), "_k").select(*df.columns)
