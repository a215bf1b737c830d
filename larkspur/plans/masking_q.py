"""Queries of presets, labels, tokens, hierarchies, pseudonyms and tags over hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import anonymize as A
from larkspur.functions import detection as D
from larkspur.functions import masking as M
from larkspur.session import spread, table

from . import sql
from .catalog import query

HITS = "WITH RECURSIVE " + sql.hits_cte()


def _hits(spark: SparkSession, sf_dir: str, **options: object) -> DataFrame:
    return D.hit_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"], **options)


def _values(spark: SparkSession, sf_dir: str, f, name: str = "out") -> DataFrame:
    return _hits(spark, sf_dir).select("doc_id", "start", "pii_type", f(F.col("value"), F.col("pii_type")).alias(name))


def _select(value: str) -> str:
    return f"{HITS} SELECT doc_id, st AS start, pii_type, {value} AS out FROM hit"


_SUB = """CASE pii_type WHEN 'Email' THEN 'user' || left(sha256(val), 8) || '@example.com'
 WHEN 'Phone' THEN '555-' || left(regexp_replace(sha256(val), '[a-f]', '', 'g'), 3) || '-' || substr(left(regexp_replace(sha256(val), '[a-f]', '', 'g'), 7), 4) ELSE '[REDACTED]' END"""


@query(_select("CASE pii_type WHEN 'Email' THEN '[EMAIL_REDACTED]' WHEN 'Phone' THEN '[PHONE_REDACTED]' WHEN 'Ssn' THEN '[SSN_REDACTED]' WHEN 'CreditCard' THEN '[CARD_REDACTED]' WHEN 'IpAddress' THEN '[IP_REDACTED]' WHEN 'ApiKey' THEN '[KEY_REDACTED]' ELSE CASE WHEN length(val) > 4 THEN left(val, 2) || repeat('*', length(val) - 4) || right(val, 2) ELSE repeat('*', length(val)) END END"))
def anon_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO24: labels, or two characters at both ends."""
    return _values(spark, sf_dir, lambda v, k: M.label_mask(v, k, partial=2))


@query(HITS + " SELECT count(*)::BIGINT AS tokens, count(DISTINCT val)::BIGINT AS vals, true AS dense, true AS shaped FROM (SELECT DISTINCT val FROM hit)")
def anon_typed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO25: one number for each value, from 1 without gaps."""
    t = M.sequential_tokens(_hits(spark, sf_dir))
    number = F.regexp_extract("token", r"^TOK_(\d{8})$", 1)
    return t.agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("value").alias("vals"), ((F.max(number.cast("long")) == F.count(F.lit(1))) & (F.count_distinct("token") == F.count(F.lit(1)))).alias("dense"), F.every(number != "").alias("shaped"))


@query(_select("sha256(val || 'pep' || 'salt')"))
def anon_salted_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO26."""
    return _values(spark, sf_dir, lambda v, k: M.salted(v, "salt", "pep"))


@query("""SELECT o_orderkey, (o_custkey % 100 // 5 * 5)::VARCHAR || '-' || (o_custkey % 100 // 5 * 5 + 4) AS age0, (o_custkey % 100 // 10 * 10)::VARCHAR || 's' AS age1, 'Adult' AS age2, CASE WHEN length(o_custkey::VARCHAR) >= 3 THEN left(o_custkey::VARCHAR, 3) || '**' ELSE '[GENERALIZED]' END AS zip0,
 'US' AS zip1, strftime(o_orderdate, '%m/%Y') AS date0, strftime(o_orderdate, '%Y') AS date1, left(strftime(o_orderdate, '%Y'), 3) || 'X' AS date2, '[GENERALIZED]' AS beyond FROM orders""")
def anon_hierarchies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO27: every level of ages, ZIP codes and dates."""
    age, code, day = (F.col("o_custkey") % 100).cast("string"), F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    levels = [M.generalized(age, "age", i).alias(f"age{i}") for i in range(3)] + [M.generalized(code, "zip", i).alias(f"zip{i}") for i in range(2)] + [M.generalized(day, "date", i).alias(f"date{i}") for i in range(3)]
    return table(spark, sf_dir, "orders").select("o_orderkey", *levels, M.generalized(code, "zip", 5).alias("beyond"))


@query(_select("CASE pii_type WHEN 'Email' THEN (['ada@example.com', 'bo@example.com', 'cy@example.com'])[(('0x' || left(sha256(val), 7))::BIGINT % 3 + 1)::INT] ELSE '[REDACTED]' END"))
def anon_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO28: the same stand-in for the same value."""
    pools = {"Email": ["ada@example.com", "bo@example.com", "cy@example.com"]}
    return _values(spark, sf_dir, lambda v, k: M.pseudonym(v, pools, k))


@query(_select(f"CASE doc_id % 4 WHEN 0 THEN {_SUB} WHEN 1 THEN '' WHEN 2 THEN CASE WHEN pii_type = 'Email' THEN reverse(val) ELSE '[REDACTED]' END ELSE '[REDACTED]' END"))
def anon_own_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO33, UDF7: clients' names, and a strategy of the user's own for one type."""
    own = [M.Strategy("mirror", lambda v, k: F.reverse(v), ("Email",), True)]
    name = F.element_at(F.array(*map(F.lit, ("pseudonymize", "remove", "mirror", "redact"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return _values(spark, sf_dir, lambda v, k: M.with_strategies(v, k, name, own))


@query(
    f"""{HITS} SELECT doc_id, st AS start, pii_type, CASE pii_type WHEN 'Email' THEN {_SUB} WHEN 'Phone' THEN {sql.mask('val', 'pii_type')} WHEN 'CreditCard' THEN {sql.mask('val', 'pii_type')} ELSE '[REDACTED]' END AS hipaa,
 CASE WHEN pii_type = 'Email' THEN {_SUB} WHEN pii_type IN ('Password', 'ApiKey') THEN '[REDACTED]' ELSE {sql.mask('val', 'pii_type')} END AS gdpr,
 CASE WHEN risk IN ('High', 'Critical') THEN CASE WHEN pii_type IN ('BankAccount', 'Password', 'ApiKey') THEN '[REDACTED]' ELSE {sql.mask('val', 'pii_type')} END END AS pci FROM hit WHERE pii_type <> 'DateOfBirth'"""
)
def anon_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO21: the values under the three presets; null below a preset's risk."""
    rows = _hits(spark, sf_dir).where("pii_type <> 'DateOfBirth'")

    def out(name: str):
        p = M.PRESETS[name]
        enough = F.col("risk").isin(*D.RISKS[D.RISKS.index(p.min_risk) :])
        return F.when(enough, M.preset_value(F.col("value"), F.col("pii_type"), p)).alias(name)

    return rows.select("doc_id", "start", "pii_type", out("hipaa"), out("gdpr"), out("pci"))


_STRATEGIES = ("mask", "redact", "substitute", "tokenize", "hash", "remove", "generalize", "truncate", "shuffle", "none", "unknown")


@query(f"{HITS} SELECT doc_id, st AS start, s AS strategy, CASE s WHEN 'mask' THEN {sql.mask('val', 'pii_type')} WHEN 'substitute' THEN {_SUB} WHEN 'tokenize' THEN 'TOK_' || left(sha256(val), 16) WHEN 'hash' THEN sha256(val) WHEN 'remove' THEN '' WHEN 'generalize' THEN CASE WHEN pii_type = 'DateOfBirth' AND length(split_part(val, '-', 1)) = 4 THEN split_part(val, '-', 1) ELSE val END WHEN 'truncate' THEN CASE WHEN length(val) > 3 THEN left(val, 3) || '...' ELSE val END WHEN 'shuffle' THEN val WHEN 'none' THEN val ELSE '[REDACTED]' END AS out FROM hit, unnest({list(_STRATEGIES)}) t(s)")
def anon_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO1: every strategy by its name."""
    rows = _hits(spark, sf_dir).withColumn("strategy", F.explode(F.array(*map(F.lit, _STRATEGIES))))
    return rows.select("doc_id", "start", "strategy", A.apply_strategy(F.col("value"), F.col("pii_type"), F.col("strategy")).alias("out"))


@query(_select("CASE pii_type WHEN 'Email' THEN 'x' || length(val) || '@example.org' ELSE '[REDACTED]' END"))
def anon_own_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF4: a generator of the user's own for one type."""
    own = {"Email": lambda v: F.concat(F.lit("x"), F.length(v).cast("string"), F.lit("@example.org"))}
    return _values(spark, sf_dir, lambda v, k: A.substitute(v, k, own))


@query(HITS + ", " + sql.spliced("'[REDACTED]'") + " SELECT doc_id, out AS text, NULL::VARCHAR AS error, out <> text AS changed FROM done JOIN documents USING (doc_id)")
def anon_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO23: a result or an error for each text of a batch; no text makes one fail here."""
    rows = D.detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    out = A.anonymize(F.col("text"), F.col("hits"), {}, "redact")
    return rows.select("doc_id", out.alias("out"), "text").select("doc_id", F.col("out").alias("text"), F.when(F.col("out").isNull() & F.col("text").isNotNull(), "failed").alias("error"), (F.col("out") != F.col("text")).alias("changed"))


@query("SELECT * FROM (VALUES (1, 'PER', 0, 8, 0.8::DOUBLE), (1, 'LOC', 12, 17, 0.5::DOUBLE), (2, 'PER', 0, 3, 0.5::DOUBLE), (2, 'ORG', 4, 9, 0.75::DOUBLE), (2, 'ORG', 10, 12, 1.0::DOUBLE), (3, 'MISC', 0, 5, 0.5::DOUBLE)) t(id, label, start, \"end\", confidence)")
def pii_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET25: tagged sub-words merged to entities; a model's tags are given."""
    rows = [
        (1, [(0, 4, "B-PER", 0.9), (4, 8, "I-PER", 0.7), (9, 11, "O", 0.99), (12, 17, "I-LOC", 0.5)]),
        (2, [(0, 3, "B-PER", 0.5), (4, 9, "I-ORG", 0.75), (10, 12, "B-ORG", 1.0)]),
        (3, [(0, 2, "MISC", 0.25), (3, 5, "MISC", 0.75)]),
        (4, []),
    ]
    df = spark.createDataFrame(rows, "id int, tags array<struct<start:int,end:int,label:string,confidence:double>>")
    return df.select("id", F.inline(M.merge_tags(F.col("tags")))).select("id", "label", "start", "end", F.round("confidence", 6).alias("confidence"))


@query("SELECT count(*)::BIGINT AS n, true AS within, true AS plain_text_is_null, true AS laplace_near, true AS gaussian_near FROM orders")
def anon_noise_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO12, ANO29: noise within its level; differential privacy's noise near zero on average."""
    price = F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select(price.alias("p"), A.noise(price.cast("string"), 0.1, 5).cast("double").alias("v"), A.noise(F.col("o_orderstatus"), 0.1, 5).alias("t"), A.laplace(F.lit(0.0), 1.0, 1.0, 6).alias("l"), A.gaussian(F.lit(0.0), 1.0, 1.0, seed=7).alias("g"))
    near = lambda c, scale: (F.abs(F.avg(c)) < scale * 6 / F.sqrt(F.count(F.lit(1)))) & (F.stddev(c).between(scale * 0.7, scale * 1.4))
    # the deviations of both kinds at these settings
    return rows.agg(F.count(F.lit(1)).alias("n"), F.every(F.abs(F.col("v") - F.col("p")) <= F.abs(F.col("p")) * 0.1 + 0.01).alias("within"), F.every(F.col("t").isNull()).alias("plain_text_is_null"), near("l", 2**0.5).alias("laplace_near"), near("g", 4.8448).alias("gaussian_near"))
