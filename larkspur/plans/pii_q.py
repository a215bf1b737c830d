"""Queries of detection and anonymization over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import anonymize as A
from larkspur.functions import detection as D
from larkspur.session import spread, table

from . import sql
from .catalog import query

HITS = "WITH RECURSIVE " + sql.hits_cte()


@query(HITS + " SELECT pii_type, risk, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs, round(avg(confidence), 6) AS avg_confidence FROM hit GROUP BY ALL")
def pii_detect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET8, AGG1: hits by type and risk."""
    hits = D.hit_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])
    return hits.groupBy("pii_type", "risk").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


@query(
    HITS
    + """ SELECT h.doc_id, st AS start, en AS "end", pattern, pii_type, confidence, risk, val AS value,
 (CASE WHEN st > 100 THEN '...' ELSE '' END) || substr(text, greatest(st - 100, 0) + 1, least(en + 100, length(text)) - greatest(st - 100, 0)) || (CASE WHEN en + 100 < length(text) THEN '...' ELSE '' END) AS context
 FROM hit h JOIN documents d USING (doc_id)"""
)
def pii_detect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1, DET4, DET10: every hit and the text around it."""
    hits = D.hit_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])
    return hits.select("doc_id", "start", "end", "pattern", "pii_type", "confidence", "risk", "value", D.context(F.col("text"), F.col("start"), F.col("end")).alias("context"))


@query("WITH RECURSIVE plain AS (SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages), " + sql.hits_cte("plain", "page_id") + " SELECT page_id, pii_type, count(*)::BIGINT AS n FROM hit GROUP BY ALL")
def pii_pages_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4, DET8: hits in pages without their tags."""
    plain = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", "").alias("text"))
    return D.hit_rows(spread(plain), ["page_id"]).groupBy("page_id", "pii_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH n AS (SELECT o_orderkey AS k, lpad((o_orderkey * 7919 + 100000007)::VARCHAR, 9, '0') AS nine, '4' || lpad((o_orderkey * 104729 % 1000000007)::VARCHAR, 15, '0') AS card FROM orders)
SELECT k, {sql.luhn('card')} AS luhn, {sql.ssn('right(nine, 9)')} AS ssn, {sql.routing('right(nine, 9)')} AS routing,
 right(nine, 9) IN ('123456789', '111111111') AS blacklisted, length(card) BETWEEN 10 AND 15 AS phone_ok FROM n"""
)
def pii_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET5, DET6, DET7, DET21, DET22 on numbers made of order keys."""
    k = F.col("o_orderkey")
    nine = F.right(F.lpad((k * 7919 + 100000007).cast("string"), 9, "0"), F.lit(9))
    card = F.concat(F.lit("4"), F.lpad((k * 104729 % 1000000007).cast("string"), 15, "0"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), D.luhn_valid(card).alias("luhn"), D.ssn_valid(nine).alias("ssn"), D.routing_valid(nine).alias("routing"), nine.isin("123456789", "111111111").alias("blacklisted"), D.phone_length_ok(card).alias("phone_ok"))


_KEY = "(VALUES " + ", ".join(f"({i}, '{k[0]}', '{k[1]}', {k[2]}::DOUBLE, '{k[3]}', {k[4]})" for i, k in enumerate(D.KEYWORDS)) + ") kw(i, word, kind, boost, place, far)"


@query(
    HITS
    + f""", near AS (
  SELECT h.doc_id, h.st, h.pii_type, kw.* FROM hit h JOIN documents d USING (doc_id) JOIN {_KEY}
  ON contains(lower(substr(text, greatest(st - far, 0) + 1, st - greatest(st - far, 0))), word) OR (place = 'around' AND contains(lower(substr(text, en + 1, far)), word))
) SELECT h.doc_id, h.st AS start, h.pii_type, least(0.4::DOUBLE, coalesce(round(sum(boost) FILTER (kind = h.pii_type), 6), 0)) AS boost, arg_min(kind, i) FILTER (kind <> h.pii_type) AS suggested
FROM hit h LEFT JOIN near n ON n.doc_id = h.doc_id AND n.st = h.st GROUP BY h.doc_id, h.st, h.pii_type"""
)
def pii_context_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET13: the boost and the suggestion of the keywords near each hit."""
    hits = D.hit_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])
    args = (F.col("text"), F.col("start"), F.col("end"), F.col("pii_type"))
    return hits.select("doc_id", "start", "pii_type", F.round(D.context_boost(*args), 6).alias("boost"), D.suggested_type(*args).alias("suggested"))


_FIELDS = " ".join(f"WHEN replace(replace(lower(name), '-', '_'), ' ', '_') IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in D.FIELD_TYPES.items())
_COLUMNS = ("User-Email", "Phone Number", "c_name", "full_name", "IP", "dob", "api_key", "amount", "client ip", "passwd")


@query(f"SELECT name, CASE {_FIELDS} END AS pii_type FROM (VALUES {', '.join(f'({c!r})' for c in _COLUMNS)}) t(name)")
def pii_field_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET14: types that field names hint at."""
    return spark.createDataFrame([(c,) for c in _COLUMNS], "name string").select("name", D.field_type(F.col("name")).alias("pii_type"))


@query(HITS + r" SELECT h.doc_id, st AS start, len(string_split(left(text, st), chr(10)))::INT AS line, (length(split_part(left(text, st), chr(10), -1)) + 1)::INT AS col FROM hit h JOIN documents d USING (doc_id)")
def pii_line_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET26: line and column of every hit."""
    line, col = D.line_col(F.col("text"), F.col("start"))
    return D.hit_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"]).select("doc_id", "start", line.alias("line"), col.alias("col"))


@query("SELECT doc_id, regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}') AS has_email, regexp_matches(text, '\\b4[0-9]{12}(?:[0-9]{3})?\\b') AS has_visa FROM documents")
def pii_is_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET2: whether one pattern matches."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(D.PATTERNS[0].regex).alias("has_email"), F.col("text").rlike(D.PATTERNS[4].regex).alias("has_visa"))


@query(
    HITS
    + """, freq(fw, kinds) AS (VALUES ('gdpr', ['Email', 'Phone', 'IpAddress', 'Name', 'Address', 'DateOfBirth']), ('pci', ['CreditCard']), ('hipaa', ['Email', 'Phone', 'Ssn', 'Name', 'DateOfBirth']))
SELECT fw AS framework, count(DISTINCT doc_id)::BIGINT AS docs, count(*)::BIGINT AS hits FROM hit JOIN freq ON list_contains(kinds, pii_type) GROUP BY fw"""
)
def pii_framework_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET17, DET18: hits that each framework asks about, by a small dimension."""
    rows = [("gdpr", t) for t in ("Email", "Phone", "IpAddress", "Name", "Address", "DateOfBirth")] + [("pci", "CreditCard")] + [("hipaa", t) for t in ("Email", "Phone", "Ssn", "Name", "DateOfBirth")]
    dim = spark.createDataFrame(rows, "framework string, pii_type string")
    hits = D.hit_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"]).join(F.broadcast(dim), "pii_type")
    return hits.groupBy("framework").agg(F.count_distinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("hits"))


_KEYWORDS = ", ".join(f"('{k[0]}', '{k[1]}')" for k in D.KEYWORDS)
# a keyword's characters other than letters are the point, the hyphen, the underscore and the blank
_REST = "regexp_split_to_array(text, '(?i)' || replace(keyword, '.', '[.]'))"


@query(f"WITH k(keyword, pii_type) AS (VALUES {_KEYWORDS}), r AS (SELECT doc_id, keyword, pii_type, unnest({_REST}[2:]) AS rest FROM documents JOIN k ON contains(lower(text), keyword)), v AS (SELECT *, regexp_extract(rest, '^[:= \\t\"'']*([^\\s,\"'']+)', 1) AS value FROM r) SELECT doc_id, keyword, pii_type, count(*)::BIGINT AS n, min(value) AS first_value, max(value) AS last_value FROM v WHERE value <> '' GROUP BY ALL")
def pii_keyword_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET15, DET16: every occurrence of every keyword that a value follows."""
    rows = D.keyword_rows(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.groupBy("doc_id", "keyword", "pii_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first_value"), F.max("value").alias("last_value"))


def _rewritten(spark: SparkSession, sf_dir: str, strategy: str | None) -> DataFrame:
    docs = D.detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    rules = A.DEFAULTS if strategy is None else {}
    out = A.anonymize(F.col("text"), F.col("hits"), rules, strategy or "mask")
    return docs.select("doc_id", F.sha2(out, 256).alias("out_sha256"), F.size("hits").cast("long").alias("n"))


def _rewritten_sql(replacement: str) -> str:
    return HITS + ", " + sql.spliced(replacement) + " SELECT doc_id, sha256(out) AS out_sha256, (SELECT count(*) FROM hit WHERE hit.doc_id = done.doc_id)::BIGINT AS n FROM done"


_HASH = "sha256(val)"
_DIGITS7 = f"left(regexp_replace({_HASH}, '[a-f]', '', 'g'), 7)"


@query(_rewritten_sql(sql.mask("val", "pii_type")))
def anon_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO3, ANO17, ANO18: every hit masked."""
    return _rewritten(spark, sf_dir, "mask")


@query(_rewritten_sql("'[REDACTED]'"))
def anon_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO5."""
    return _rewritten(spark, sf_dir, "redact")


@query(_rewritten_sql(_HASH))
def anon_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO9."""
    return _rewritten(spark, sf_dir, "hash")


@query(_rewritten_sql(f"'TOK_' || left({_HASH}, 16)"))
def anon_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO7."""
    return _rewritten(spark, sf_dir, "tokenize")


@query(_rewritten_sql("CASE WHEN length(val) > 3 THEN left(val, 3) || '...' ELSE val END"))
def anon_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO11."""
    return _rewritten(spark, sf_dir, "truncate")


@query(
    _rewritten_sql(
        f"CASE WHEN pii_type IN ('CreditCard', 'Ssn', 'Phone') THEN {sql.mask('val', 'pii_type')} WHEN pii_type = 'Email' THEN 'user' || left({_HASH}, 8) || '@example.com' WHEN pii_type IN ('Password', 'ApiKey') THEN '[REDACTED]' ELSE {sql.mask('val', 'pii_type')} END"
    )
)
def anon_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO2, ANO6, ANO13: every hit by its type's default strategy."""
    return _rewritten(spark, sf_dir, None)


@query(
    f"""SELECT c_custkey, 'user' || left(sha256(c_name), 8) || '@example.com' AS email, '555-' || left(d, 3) || '-' || substr(d, 4, 4) AS phone,
 ['John Doe', 'Jane Smith', 'Alex Johnson', 'Sam Wilson', 'Morgan Lee', 'Taylor Brown'][(('0x' || left(sha256(c_name), 2))::INT % 6) + 1] AS name,
 (('0x' || left(sha256(c_name), 3))::INT % 900 + 100)::VARCHAR || ' Main St, Anytown, ST 00000' AS address
 FROM (SELECT *, left(regexp_replace(sha256(c_name), '[a-f]', '', 'g'), 7) AS d FROM customer)"""
)
def anon_generators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO13-ANO16 on customer names."""
    v = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", A.email_like(v).alias("email"), A.phone_like(v).alias("phone"), A.name_like(v).alias("name"), A.address_like(v).alias("address"))


@query(
    """SELECT o_orderkey, CASE WHEN o_custkey % 100 <= 17 THEN '0-17' WHEN o_custkey % 100 <= 24 THEN '18-24' WHEN o_custkey % 100 <= 34 THEN '25-34' WHEN o_custkey % 100 <= 44 THEN '35-44'
 WHEN o_custkey % 100 <= 54 THEN '45-54' WHEN o_custkey % 100 <= 64 THEN '55-64' WHEN o_custkey % 100 <= 74 THEN '65-74' ELSE '75+' END AS age, left(o_orderdate::VARCHAR, 4) AS year,
 (floor(o_totalprice / 1000) * 1000)::BIGINT::VARCHAR || '-' || (floor(o_totalprice / 1000) * 1000 + 1000)::BIGINT::VARCHAR AS price FROM orders"""
)
def anon_generalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO10: ages, years and price ranges."""
    return table(spark, sf_dir, "orders").select("o_orderkey", A.age_range((F.col("o_custkey") % 100).cast("string")).alias("age"), A.date_to_year(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"), A.number_range(F.col("o_totalprice").cast("string"), 1000.0).alias("price"))


_RULES = [(policy, 10 * (i + 1), kind, strategy) for i, (policy, rules) in enumerate(A.POLICIES.items()) for kind, strategy in rules]


@query(
    HITS
    + f""", rules(policy, priority, pii_type, strategy) AS (VALUES {', '.join(str(r) for r in _RULES)}),
 best AS (SELECT pii_type, arg_max(policy, priority) AS policy, arg_max(strategy, priority) AS strategy FROM rules GROUP BY pii_type)
 SELECT pii_type, coalesce(policy, 'default') AS policy, coalesce(strategy, 'mask') AS strategy, count(*)::BIGINT AS n FROM hit LEFT JOIN best USING (pii_type) GROUP BY ALL"""
)
def anon_policy_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN10, ANO22, ANO31, ANO32, AGG2: each hit by the first policy, by priority,
    that has a rule for its type."""
    rules = spark.createDataFrame(_RULES, "policy string, priority int, pii_type string, strategy string")
    best = rules.groupBy("pii_type").agg(F.max_by("policy", "priority").alias("policy"), F.max_by("strategy", "priority").alias("strategy"))
    hits = D.hit_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"]).join(F.broadcast(best), "pii_type", "left")
    return hits.groupBy("pii_type", F.coalesce("policy", F.lit("default")).alias("policy"), F.coalesce("strategy", F.lit("mask")).alias("strategy")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, sha256(text) AS out_sha256 FROM documents")
def anon_reidentify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO20: texts are the same after tokens were put in and taken out again."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    tokens = A.token_table(D.hit_rows(docs, ["doc_id"]))
    hidden = D.detect(docs).select("doc_id", A.anonymize(F.col("text"), F.col("hits"), {}, "tokenize").alias("text"))
    return A.reidentify(hidden, tokens, ["doc_id"]).select("doc_id", F.sha2("text", 256).alias("out_sha256"))


@query(HITS + " SELECT doc_id, pii_type, st AS start_offset, en AS end_offset, (en - st)::INT AS length, confidence::DECIMAL(3,2) AS confidence, sha256(val) AS value_hash FROM hit")
def pii_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF8, LIF9: rows of the entity table."""
    hits = D.hit_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])
    return hits.select("doc_id", "pii_type", F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), (F.col("end") - F.col("start")).alias("length"), F.col("confidence").cast("decimal(3,2)").alias("confidence"), F.sha2("value", 256).alias("value_hash"))


@query(HITS + " SELECT h.doc_id, st AS start, pii_type FROM hit h WHERE NOT (pii_type = 'Email' AND regexp_matches(val, '@mail[0-4]\\.')) AND val NOT IN (SELECT min(val) FROM hit WHERE pii_type = 'IpAddress')")
def pii_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT24: hits less those that an exact or a regex entry allows."""
    hits = D.hit_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])
    exact = hits.where("pii_type = 'IpAddress'").agg(F.min("value").alias("_v")).where("_v is not null")
    kept = hits.where(~((F.col("pii_type") == "Email") & F.col("value").rlike(r"@mail[0-4]\.")))
    return kept.join(F.broadcast(exact), F.col("value") == F.col("_v"), "left_anti").select("doc_id", "start", "pii_type")


@query()
def anon_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO12, ANO29: noisy balances."""
    v = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", A.noise(v.cast("string"), seed=7).alias("noisy"), A.laplace(v, 1.0, 0.5, 7).alias("laplace"), A.gaussian(v, 1.0, 0.5, seed=7).alias("gaussian"))


@query("SELECT c_custkey, c_name AS plain, true AS same FROM customer")
def anon_encrypt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO8, HSH6: values come back from AES-GCM."""
    key = F.lit("0123456789abcdef")
    out = A.decrypt(A.encrypt(F.col("c_name"), key), key)
    return table(spark, sf_dir, "customer").select("c_custkey", out.alias("plain"), (out == F.col("c_name")).alias("same"))


@query("SELECT count(*)::BIGINT AS rows, count(DISTINCT c_custkey)::BIGINT AS keys, round(sum(c_acctbal), 2) AS total FROM customer")
def anon_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO35: a shuffled column keeps its values."""
    out = A.shuffle_column(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal")
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("c_custkey").alias("keys"), F.round(F.sum("c_acctbal"), 2).alias("total"))
