"""Queries of sanitizing, threats, schemas and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import detection as D
from larkspur.functions import rules as V
from larkspur.functions import security as S
from larkspur.session import spread, table

from . import sql
from .catalog import query


@query(r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))) AS text_hash FROM pages")
def sanitize_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR3, STR4, STR5."""
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(S.sanitize(F.col("html")), 256).alias("text_hash"))


def _any(column: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


@query(f"SELECT page_id, {_any('html', S.SQL_PATTERNS)} AS sql_injection, {_any('html', S.XSS_PATTERNS)} AS xss, {_any('url', S.TRAVERSAL_PATTERNS)} AS traversal FROM pages")
def threat_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR6, STR7, STR8, STR12."""
    return table(spark, sf_dir, "pages").select("page_id", S.any_match(F.col("html"), S.SQL_PATTERNS).alias("sql_injection"), S.any_match(F.col("html"), S.XSS_PATTERNS).alias("xss"), S.any_match(F.col("url"), S.TRAVERSAL_PATTERNS).alias("traversal"))


@query(f"SELECT page_id, list_filter([CASE WHEN length(html) > 10000 THEN 'length' END, CASE WHEN {_any('html', S.SQL_PATTERNS)} THEN 'sql_injection' END, CASE WHEN {_any('html', S.XSS_PATTERNS)} THEN 'xss' END, CASE WHEN {_any('html', S.TRAVERSAL_PATTERNS)} THEN 'path_traversal' END], lambda x: x IS NOT NULL) AS errors FROM pages")
def string_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR1."""
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", S.violations(F.col("html")).alias("errors"))


@query("SELECT page_id, regexp_replace(path, '/[0-9]+(/|$)', '/{id}\\1', 'g') AS path FROM (SELECT page_id, '/api/' || page_id || '/pages/x' || page_id AS path FROM pages)")
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR14."""
    path = F.concat(F.lit("/api/"), F.col("page_id"), F.lit("/pages/x"), F.col("page_id"))
    return table(spark, sf_dir, "pages").select("page_id", S.normalize_path(path).alias("path"))


@query(f"SELECT page_id, regexp_matches(url, '^(?i)https?://[^/\\s?#]+') AND length(url) <= 10000 AND NOT {_any('url', S.SQL_PATTERNS + S.XSS_PATTERNS + S.TRAVERSAL_PATTERNS)} AS url_ok, length(f) BETWEEN 1 AND 255 AND f NOT LIKE '.%' AND NOT regexp_matches(f, '[/\\\\:*?\"<>|]') AND NOT {_any('f', S.TRAVERSAL_PATTERNS)} AS filename_ok FROM (SELECT *, split_part(url, '/', -1) AS f FROM pages)")
def url_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR10, STR11."""
    return table(spark, sf_dir, "pages").select("page_id", S.url_ok(F.col("url")).alias("url_ok"), S.filename_ok(F.substring_index("url", "/", -1)).alias("filename_ok"))


_NETS = (("10.0.0.0/8", "private"), ("96.0.0.0/3", "block a"), ("27.96.0.0/11", "block b"), ("55.63.178.0/24", "block c"))


@query(
    "WITH RECURSIVE "
    + sql.hits_cte()
    + f""", nets(cidr, note) AS (VALUES {', '.join(str(n) for n in _NETS)}), lim AS (SELECT cidr, note, string_split(split_part(cidr, '/', 1), '.') AS p, split_part(cidr, '/', 2)::INT AS bits FROM nets),
 r2 AS (SELECT cidr, note, p[1]::BIGINT * 16777216 + p[2]::BIGINT * 65536 + p[3]::BIGINT * 256 + p[4]::BIGINT AS b, (2 ** (32 - bits))::BIGINT AS n FROM lim),
 ips AS (SELECT doc_id, val, string_split(val, '.') AS p FROM hit WHERE pattern = 'ipv4'), num AS (SELECT doc_id, val, p[1]::BIGINT * 16777216 + p[2]::BIGINT * 65536 + p[3]::BIGINT * 256 + p[4]::BIGINT AS ip FROM ips)
SELECT doc_id, val AS ip, cidr, note FROM num JOIN r2 ON ip BETWEEN b - b % n AND b - b % n + n - 1"""
)
def ip_blocklist_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN13: addresses in documents by the networks that hold them. The list of
    networks is a literal, so the range join is a broadcast one."""
    hits = D.hit_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"]).where("pattern = 'ipv4'").select("doc_id", F.col("value").alias("ip"), S.ip_number(F.col("value")).alias("_n"))
    nets = spark.createDataFrame(list(_NETS), "cidr string, note string")
    low, high = S.cidr_range(F.col("cidr"))
    return hits.join(F.broadcast(nets.select("cidr", "note", low.alias("_lo"), high.alias("_hi"))), F.col("_n").between(F.col("_lo"), F.col("_hi"))).select("doc_id", "ip", "cidr", "note")


_RULES = (V.Field("k", "Integer", nullable=False, minimum=10, maximum=90), V.Field("name", "String", required=True))


@query("SELECT event_id, list_filter([CASE WHEN (props->>'k')::INT < 10 THEN 'k:min_value' END, CASE WHEN (props->>'k')::INT > 90 THEN 'k:max_value' END, 'name:required'], lambda x: x IS NOT NULL) AS errors FROM events")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCH1-SCH4: what a small schema says of the events' documents."""
    return spread(table(spark, sf_dir, "events").select("event_id", "props")).select("event_id", V.violations(F.col("props"), _RULES).alias("errors"))


@query("SELECT count(*) FILTER (k BETWEEN 10 AND 90)::BIGINT AS accepted, count(*) FILTER (k NOT BETWEEN 10 AND 90)::BIGINT AS rejected FROM (SELECT (props->>'k')::INT AS k FROM events)")
def schema_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCH6: accepted and rejected documents."""
    bad = F.size(V.violations(F.col("props"), _RULES[:1])) > 0
    return table(spark, sf_dir, "events").agg(F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected"))
