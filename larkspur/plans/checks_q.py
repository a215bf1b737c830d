"""Queries of further detection, validation and hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import checks as K
from larkspur.functions import content as C
from larkspur.functions import detection as D
from larkspur.functions import documents as J
from larkspur.functions import masking as M
from larkspur.functions import rules as V
from larkspur.functions import security as S
from larkspur.operators import access as X
from larkspur.session import spread, table

from . import sql
from .catalog import query

HITS = "WITH RECURSIVE " + sql.hits_cte()
_EMAIL = next(p for p in D.PATTERNS if p.name == "email")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _raw(p: D.Pattern) -> str:
    re = p.regex.replace("'", "''")
    return f"SELECT doc_id, m[k] AS val, (list_sum(list_transform(g[1:k], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:k-1], lambda z: length(z))), 0))::INT AS st FROM (SELECT doc_id, regexp_extract_all(text, '{re}') m, regexp_split_to_array(text, '{re}') g FROM documents), unnest(range(1, len(m) + 1)) u(k)"


@query(" UNION ALL ".join(f"SELECT doc_id, st AS start, (st + length(val))::INT AS \"end\" FROM ({_raw(p)})" for p in D.PATTERNS if p.pii_type == "CreditCard"))
def pii_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET3: matches of one type's patterns, neither swept nor validated."""
    found = D.raw_hits(F.col("text"), "CreditCard")
    return _docs(spark, sf_dir).select("doc_id", F.inline(found)).select("doc_id", "start", "end")


@query(HITS + " SELECT doc_id, st AS start, pii_type, risk FROM hit WHERE confidence >= 0.9 AND risk IN ('Medium', 'High', 'Critical') AND pii_type IN ('Email', 'Ssn', 'CreditCard') AND pii_type NOT IN ('Ssn')")
def pii_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT20: least confidence and risk, types asked for and types left out."""
    return D.hit_rows(_docs(spark, sf_dir), ["doc_id"], min_confidence=0.9, min_risk="Medium", include=["Email", "Ssn", "CreditCard"], exclude=["Ssn"]).select("doc_id", "start", "pii_type", "risk")


@query(HITS + " SELECT doc_id, count(h.doc_id)::INT AS n, count(h.doc_id) = 0 AS is_clean FROM documents d LEFT JOIN hit h USING (doc_id) GROUP BY doc_id")
def pii_is_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET12, DET27: the hits of every text of a batch, and whether there are none."""
    return D.detect(_docs(spark, sf_dir)).select("doc_id", F.size("hits").alias("n"), (F.size("hits") == 0).alias("is_clean"))


@query(HITS + " SELECT doc_id, pii_type AS label, st AS start, en AS \"end\", confidence AS score, 'pattern:' || pattern AS source FROM hit")
def pii_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET19: hits as annotations."""
    h = D.hit_rows(_docs(spark, sf_dir), ["doc_id"])
    return h.select("doc_id", F.col("pii_type").alias("label"), "start", "end", F.col("confidence").alias("score"), F.concat(F.lit("pattern:"), "pattern").alias("source"))


@query(
    HITS
    + """ SELECT doc_id, st AS start, pii_type, CASE WHEN pii_type = 'Email' THEN NOT (suffix(val, 'tempmail.com') OR suffix(val, 'throwaway.email') OR suffix(val, 'guerrillamail.com')) END AS lasting,
 CASE WHEN pii_type = 'IpAddress' THEN starts_with(val, '10.') OR starts_with(val, '192.168.') OR starts_with(val, '127.') OR starts_with(val, '172.16.') OR starts_with(val, '172.17.') END AS private,
 CASE WHEN pii_type = 'BankAccount' THEN length(regexp_replace(val, '\\s', '', 'g')) BETWEEN 15 AND 34 END AS iban_ok FROM hit"""
)
def pii_strict_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET20, DET23, DET24."""
    h, v, k = D.hit_rows(_docs(spark, sf_dir), ["doc_id"]), F.col("value"), F.col("pii_type")
    return h.select("doc_id", "start", "pii_type", F.when(k == "Email", D.email_not_disposable(v)).alias("lasting"), F.when(k == "IpAddress", D.private_ip(v)).alias("private"), F.when(k == "BankAccount", D.iban_length_ok(v)).alias("iban_ok"))


_OVERLAPS = [(1, [(0, 5, 0.9), (3, 8, 0.95), (7, 9, 0.5), (20, 22, 0.1)]), (2, [(0, 5, 0.9), (5, 8, 0.95), (6, 7, 0.95)]), (3, [(0, 4, 0.5), (2, 6, 0.5), (3, 9, 0.6)]), (4, [])]


def _overlaps(spark: SparkSession, fold) -> DataFrame:
    df = spark.createDataFrame(_OVERLAPS, "id int, h array<struct<start:int,end:int,confidence:double>>")
    return df.select("id", F.inline(fold(F.col("h"))))


@query("SELECT * FROM (VALUES (1, 3, 8, 0.95::DOUBLE), (1, 20, 22, 0.1), (2, 0, 5, 0.9), (2, 5, 8, 0.95), (3, 3, 9, 0.6)) t(id, start, \"end\", confidence)")
def overlap_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN2, WIN3: an overlapping hit replaces the last kept one if it is surer."""
    return _overlaps(spark, D.dedup_pairwise)


@query("SELECT * FROM (VALUES (1, 3, 8, 0.95::DOUBLE), (1, 20, 22, 0.1), (2, 5, 8, 0.95), (3, 3, 9, 0.6)) t(id, start, \"end\", confidence)")
def overlap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN4: the best of each chain of hits that touch the best one's end."""
    return _overlaps(spark, D.merge_clusters)


@query("WITH RECURSIVE " + sql.hits_cte(patterns=(*D.PATTERNS, D.with_custom("license", "Other", r"Licen[cs]e[a-z]*", 0.9))) + " SELECT doc_id, st AS start, pattern, val AS value FROM hit")
def pii_own_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF2: a pattern of the user's own beside the built-in ones."""
    own = (*D.PATTERNS, D.with_custom("license", "Other", r"Licen[cs]e[a-z]*", 0.9, guard="Licen"))
    return D.hit_rows(_docs(spark, sf_dir), ["doc_id"], patterns=own).select("doc_id", "start", "pattern", "value")


@query(f"SELECT doc_id, st AS start, val AS value FROM ({_raw(_EMAIL)}) WHERE NOT contains(val, 'mail1')")
def pii_own_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF3: a validator of the user's own by its name; unknown names pass."""
    own = (D.with_custom("email", "Email", _EMAIL.regex, 0.95, validator="not_first", guard="@"), D.with_custom("never", "Other", "zqzqzq+", 0.9, validator="unknown", guard="zqzq"))
    check = {"not_first": lambda v: ~F.contains(v, F.lit("mail1"))}
    return D.hit_rows(_docs(spark, sf_dir), ["doc_id"], patterns=own, validators=check).select("doc_id", "start", "value")


@query(HITS + ", marks AS (SELECT doc_id, (strpos(text, 'Licensed') - 1)::INT AS st FROM documents WHERE contains(text, 'Licensed')) SELECT doc_id, st AS start, pii_type FROM hit WHERE NOT EXISTS (FROM marks m WHERE m.doc_id = hit.doc_id AND m.st < en AND m.st + 8 > hit.st) UNION ALL SELECT doc_id, st, 'Mark' FROM marks m WHERE NOT EXISTS (FROM hit h WHERE h.doc_id = m.doc_id AND h.st < m.st + 8 AND h.en > m.st)")
def pii_own_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET11, UDF1: a Python detector's findings among the built-in ones."""

    def marks(text: str) -> list[tuple[int, int, str, float]]:
        at = text.find("Licensed")
        return [] if at < 0 else [(at, at + 8, "Mark", 0.5)]

    return J.with_custom_detector(_docs(spark, sf_dir), ["doc_id"], marks).select("doc_id", "start", "pii_type")


_TRY = ["ada@example.com", "a@b", "x" * 250 + "@a.com", "", "no mail", "A.b+c@d-e.org"]


@query("SELECT * FROM (VALUES (0, true), (1, false), (2, false), (3, false), (4, false), (5, true)) t(id, ok)")
def email_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR9."""
    return spark.createDataFrame(list(enumerate(_TRY)), "id int, t string").select("id", S.email_ok(F.col("t")).alias("ok"))


@query("SELECT event_id, contains(lower(event_type || '/' || user_id), 'error') OR contains(lower(event_type || '/' || user_id), '/7') AS blocked FROM events")
def agent_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR13: blocked parts in any case."""
    agent = F.concat(F.upper("event_type"), F.lit("/"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", S.agent_blocked(agent, ["Error", "/7"]).alias("blocked"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 1 THEN n_name WHEN 2 THEN n_name END AS resource, CASE n_nationkey % 4 WHEN 1 THEN 'read' WHEN 2 THEN 'write' END AS action, CASE n_nationkey % 4 WHEN 2 THEN 'all' END AS scope FROM nation")
def permission_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR17: two or three parts; other texts give nothing."""
    m, n = F.col("n_nationkey") % 4, F.col("n_name")
    text = F.when(m == 0, n).when(m == 1, F.concat(n, F.lit(":read"))).when(m == 2, F.concat(n, F.lit(":write:all"))).otherwise(F.concat(n, F.lit(":a:b:c")))
    p = S.permission_parts(text)
    return table(spark, sf_dir, "nation").select("n_nationkey", p["resource"].alias("resource"), p["action"].alias("action"), p["scope"].alias("scope"))


@query("SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 OR c_acctbal > 5000 THEN 'c_acctbal:range' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'c_mktsegment:one_of' END, CASE WHEN NOT regexp_matches(c_name, '[13579]$') THEN 'c_name:pattern' END, CASE WHEN length(c_mktsegment) > 8 THEN 'c_mktsegment:max_length' END, CASE WHEN c_custkey % 7 = 0 THEN 'c_custkey:lucky' END], lambda x: x IS NOT NULL) AS errors FROM customer")
def fluent_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR16, UDF9: checks by name, one of them the user's own."""
    v = K.Validator().required("c_name").range("c_acctbal", 0, 5000).one_of("c_mktsegment", ["BUILDING", "MACHINERY"]).pattern("c_name", "[13579]$").length("c_mktsegment", 1, 8)
    v = v.custom("c_custkey", "lucky", F.col("c_custkey") % 7 == 0)
    return table(spark, sf_dir, "customer").select("c_custkey", v.errors().alias("errors"))


@query("SELECT * FROM (VALUES (0, true, false), (1, false, true), (2, false, true), (3, false, false), (4, false, false), (5, false, true)) t(id, dataset_ok, path_ok)")
def id_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR19: ids of datasets, and paths into JSON."""
    rows = [(0, "data-set_1é"), (1, "$.a.b[0]"), (2, "$"), (3, ""), (4, "x" * 129 + "."), (5, "$['k'][*].z")]
    df = spark.createDataFrame(rows, "id int, t string")
    return df.select("id", K.dataset_id_ok(F.col("t")).alias("dataset_ok"), K.json_path_ok(F.col("t")).alias("path_ok"))


@query("SELECT * FROM (VALUES ('email', 'Email'), ('Home-Address', 'Address')) t(field, pii_type)")
def schema_pii_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCH5."""
    fields = [V.Field("email", "String"), V.Field("total", "Float"), V.Field("Home-Address", "String")]
    return spark.createDataFrame(K.pii_fields(fields), "field string, pii_type string")


@query("SELECT page_id, true AS verified, false AS other FROM pages")
def checksum_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH3, HSH5: a content against its address and its code, and against another's."""
    data = F.col("html")
    right = C.verified(data, C.address(data)) & C.codes_equal(C.hmac_sha256("k", data), C.hmac_sha256("k", data))
    return table(spark, sf_dir, "pages").select("page_id", right.alias("verified"), C.verified(data, C.address(F.concat(data, F.lit("!")))).alias("other"))


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment, c_name AS opened, true AS sealed FROM customer")
def field_encryption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH9: fields of a nested document by their dotted paths, sealed and opened; a missing path is passed over."""
    key = F.lit("0123456789abcdef")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.struct(F.struct(F.col("c_name").alias("name")).alias("who"), F.col("c_mktsegment").alias("segment")).alias("doc"))
    paths = ["who.name", "who.missing"]
    rows = rows.withColumn("s", J.seal_fields(rows, "doc", paths, key))
    rows = rows.withColumn("o", J.open_fields(rows, "s", paths, key))
    return rows.select("c_custkey", F.col("o.who.name").alias("name"), F.col("s.segment").alias("segment"), F.col("o.who.name").alias("opened"), (F.startswith("s.who.name", F.lit("ENC:")) & (F.col("s.who.name") != F.col("c_name"))).alias("sealed"))


@query("""WITH RECURSIVE d AS (SELECT page_id, length(html) AS n FROM pages), c(page_id, idx, start, length) AS (
 SELECT page_id, 0, 0, CASE WHEN n > 300 THEN 300 ELSE n END FROM d WHERE n > 0
 UNION ALL SELECT c.page_id, idx + 1, start + length, least(300, n - start - length) FROM c JOIN d USING (page_id) WHERE start + length < n) SELECT page_id, idx::INT AS idx, length::INT AS length FROM c""")
def cdc_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNT5: every 300th byte and the two before it made zero, which are boundaries by content."""
    n = F.length("html")
    zeros = F.concat(F.repeat(F.lit("x"), 297), F.lit("\x00\x00\x00"))
    data = F.left(F.repeat(zeros, F.ceil(n / 300).cast("int")), n)
    return C.content_chunks(table(spark, sf_dir, "pages").select("page_id", data.alias("d")).where("d <> ''"), "page_id", "d", 256, 4096)


@query("SELECT c_custkey, list_filter([CASE WHEN c_custkey = 7 THEN 'eq' END, CASE WHEN c_custkey <> 7 THEN 'ne' END, CASE WHEN c_custkey < 50 THEN 'lt' END, CASE WHEN c_custkey <= 50 THEN 'le' END, CASE WHEN c_custkey > 50 THEN 'gt' END, CASE WHEN c_custkey >= 50 THEN 'ge' END, CASE WHEN contains(c_custkey::VARCHAR, '3') THEN 'contains' END, CASE WHEN starts_with(c_custkey::VARCHAR, '1') THEN 'starts_with' END, CASE WHEN suffix(c_custkey::VARCHAR, '9') THEN 'ends_with' END, CASE WHEN regexp_matches(c_custkey::VARCHAR, '^[12]+$') THEN 'matches' END, CASE WHEN c_custkey IN (1, 2) THEN 'in' END, CASE WHEN c_custkey NOT IN (1, 2) THEN 'not_in' END], lambda x: x IS NOT NULL) AS ops FROM customer")
def policy_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL21: the twelve operators."""
    ops = {"eq": "7", "ne": "7", "lt": "50", "le": "50", "gt": "50", "ge": "50", "contains": "3", "starts_with": "1", "ends_with": "9", "matches": "^[12]+$", "in": ["1", "2"], "not_in": ["1", "2"]}
    value = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_compact(F.array(*[F.when(X.compare(value, o, v), o) for o, v in ops.items()])).alias("ops"))


@query(HITS + " SELECT val AS value, 'TOK_' || left(sha256(val), 16) AS token, count(*)::BIGINT AS uses FROM hit GROUP BY val")
def token_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF20: the token of each value, the value of each token, and how often it was used."""
    h = D.hit_rows(_docs(spark, sf_dir), ["doc_id"])
    return M.context_tokens(h)


@query(HITS + " SELECT count(DISTINCT val) FILTER (length(val) % 2 = 0)::BIGINT AS live, count(DISTINCT val) FILTER (length(val) % 2 = 1)::BIGINT AS expired, true AS opened, 2::BIGINT AS accesses FROM hit")
def token_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO30: values sealed under tokens; expired ones are gone, a read counts."""
    h = D.hit_rows(_docs(spark, sf_dir), ["doc_id"]).select("value").distinct()
    key, now = F.lit("0123456789abcdef"), F.lit("2024-06-01").cast("timestamp")
    made = F.when(F.length("value") % 2 == 0, F.lit("2024-05-31")).otherwise("2023-01-01").cast("timestamp")
    vault = M.vault_store(h, "value", key, made, days=30)
    live = M.vault_cleanup(vault, now)
    read = M.vault_read(M.vault_read(live, now, key)[0], now, key)
    out = read[1].join(h.select("value", F.concat(F.lit("TOK_"), F.left(F.sha2("value", 256), F.lit(16))).alias("token")), "token")
    counts = out.agg(F.count(F.lit(1)).alias("live"), F.every(F.col("opened") == F.col("value")).alias("opened"))
    total = h.agg(F.count(F.lit(1)).alias("all"))
    accesses = read[0].agg(F.max("access_count").alias("accesses"))
    one = counts.select(F.lit(1).alias("_k"), "*").join(total.select(F.lit(1).alias("_k"), "*"), "_k").join(accesses.select(F.lit(1).alias("_k"), "*"), "_k")
    return one.select("live", (F.col("all") - F.col("live")).alias("expired"), "opened", "accesses")
