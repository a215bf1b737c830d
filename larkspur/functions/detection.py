"""Detection of personal data in text, as Columns (DET1-DET27 but
DET25's BIO merge, WIN1-WIN4).

A text is searched by a registry of patterns. Matches of all patterns are swept
from the left: the earliest start wins, then the higher confidence, then the
pattern registered first. Validators and thresholds apply after the sweep, so a
match that a validator drops does not revive the one it covered.

Places are in characters. A null text gives no hits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RISKS = ("Low", "Medium", "High", "Critical")
#: A token that anonymization puts in a value's place.
TOKEN = "TOK_[0-9a-f]{16}"


@dataclass(frozen=True)
class Pattern:
    """A registered pattern. Any match implies a match of the regex ``guard``, and
    one of the strings ``needs`` in the text, or a digit if there are none."""

    name: str
    pii_type: str
    regex: str
    confidence: float
    risk: str
    validator: str | None = None
    guard: str | None = None
    needs: tuple[str, ...] = ()


# The built-in patterns, in the order of registration.
PATTERNS: tuple[Pattern, ...] = (
    Pattern("email", "Email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 0.95, "Medium", None, "@", ("@",)),
    Pattern("phone_us", "Phone", r"(?:\+1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}", 0.85, "Medium", None, "[0-9]{4}"),
    Pattern("phone_intl", "Phone", r"\+[1-9]\d{1,14}", 0.80, "Medium", None, r"\+[1-9]"),
    Pattern("ssn", "Ssn", r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", 0.90, "Critical", "validate_ssn", "[0-9]{4}"),
    Pattern("credit_card_visa", "CreditCard", r"\b4[0-9]{12}(?:[0-9]{3})?\b", 0.90, "Critical", "validate_luhn", "4[0-9]{12}"),
    Pattern("credit_card_mc", "CreditCard", r"\b(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}\b", 0.90, "Critical", "validate_luhn", "[25][0-9]{15}"),
    Pattern("credit_card_amex", "CreditCard", r"\b3[47][0-9]{13}\b", 0.90, "Critical", "validate_luhn", "3[0-9]{14}"),
    Pattern("credit_card_generic", "CreditCard", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", 0.75, "Critical", "validate_luhn", "[0-9]{4}"),
    Pattern("ipv4", "IpAddress", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", 0.95, "Low", None, r"[0-9]\.[0-9]"),
    Pattern("ipv6", "IpAddress", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", 0.95, "Low", None, "[0-9a-fA-F]:[0-9a-fA-F]{1,4}:", (":",)),
    Pattern("mac_address", "IpAddress", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", 0.95, "Low", None, "[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]", (":", "-")),
    Pattern("dob_us", "DateOfBirth", r"\b(?:0[1-9]|1[0-2])[/-](?:0[1-9]|[12][0-9]|3[01])[/-](?:19|20)\d{2}\b", 0.70, "Medium", None, "[0-9]{2}[/-]"),
    Pattern("dob_iso", "DateOfBirth", r"\b(?:19|20)\d{2}[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12][0-9]|3[01])\b", 0.70, "Medium", None, "[0-9]{2}[/-]"),
    Pattern("drivers_license", "DriversLicense", r"\b[A-Z]{1,2}\d{5,8}\b", 0.50, "High", None, "[A-Z][0-9]{5}"),
    Pattern("passport_us", "PassportNumber", r"\b[A-Z]\d{8}\b", 0.60, "High", None, "[A-Z][0-9]{8}"),
    Pattern("bank_account_iban", "BankAccount", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}(?:[A-Z0-9]?){0,16}\b", 0.85, "High", None, "[A-Z]{2}[0-9]{2}"),
    Pattern("bank_routing_us", "BankAccount", r"\b\d{9}\b", 0.40, "High", "validate_routing", "[0-9]{9}"),
    Pattern("api_key_generic", "ApiKey", r"""\b(?:api[_-]?key|apikey|api_secret)[=:]\s*['"]?([a-zA-Z0-9_-]{20,})['"]?""", 0.80, "Critical", None, "api", ("api",)),
    Pattern("aws_key", "ApiKey", r"\b(?:AKIA|ABIA|ACCA|ASIA)[0-9A-Z]{16}\b", 0.95, "Critical", None, "A[KBCS][IC]A", ("AKIA", "ABIA", "ACCA", "ASIA")),
    Pattern("password_field", "Password", r"""(?i)(?:password|passwd|pwd)[=:]\s*['"]?([^'"\s]{4,})['"]?""", 0.85, "Critical", None, "(?i)pass|pwd", ("=", ":")),
    Pattern("gps_coords", "Coordinates", r"\b[-+]?(?:[1-8]?\d(?:\.\d+)?|90(?:\.0+)?),\s*[-+]?(?:180(?:\.0+)?|(?:(?:1[0-7]\d)|(?:[1-9]?\d))(?:\.\d+)?)\b", 0.70, "Medium", None, "[0-9],"),
)

# The context keywords (keyword, type, boost, position, distance).
KEYWORDS: tuple[tuple[str, str, float, str, int], ...] = (
    ("email", "Email", 0.15, "before", 50),
    ("e-mail", "Email", 0.15, "before", 50),
    ("phone", "Phone", 0.2, "before", 50),
    ("tel", "Phone", 0.15, "before", 30),
    ("mobile", "Phone", 0.2, "before", 50),
    ("call", "Phone", 0.1, "before", 30),
    ("ssn", "Ssn", 0.3, "before", 30),
    ("social security", "Ssn", 0.3, "before", 50),
    ("card", "CreditCard", 0.15, "before", 50),
    ("credit", "CreditCard", 0.2, "before", 50),
    ("payment", "CreditCard", 0.15, "before", 50),
    ("name", "Name", 0.15, "before", 30),
    ("mr.", "Name", 0.2, "before", 10),
    ("ms.", "Name", 0.2, "before", 10),
    ("dr.", "Name", 0.2, "before", 10),
    ("address", "Address", 0.2, "before", 50),
    ("street", "Address", 0.15, "around", 100),
    ("dob", "DateOfBirth", 0.3, "before", 30),
    ("birth", "DateOfBirth", 0.25, "before", 50),
    ("born", "DateOfBirth", 0.2, "before", 50),
    ("password", "Password", 0.4, "before", 30),
    ("pwd", "Password", 0.3, "before", 20),
    ("api_key", "ApiKey", 0.4, "before", 30),
    ("secret", "ApiKey", 0.25, "before", 30),
)
# Field names that hint at a type.
FIELD_TYPES: dict[str, tuple[str, ...]] = {
    "Email": ("email", "email_address", "user_email"),
    "Phone": ("phone", "phone_number", "mobile", "tel"),
    "Ssn": ("ssn", "social_security", "social_security_number"),
    "Name": ("name", "full_name", "first_name", "last_name"),
    "Address": ("address", "street_address", "home_address"),
    "CreditCard": ("credit_card", "card_number", "cc_number"),
    "DateOfBirth": ("dob", "date_of_birth", "birthdate"),
    "IpAddress": ("ip", "ip_address", "client_ip"),
    "Password": ("password", "passwd", "pwd"),
    "ApiKey": ("api_key", "apikey", "secret_key"),
}

Validator = Callable[[Column], Column]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_valid(value: Column) -> Column:
    """DET5: 13 to 19 digits whose Luhn sum is divisible by 10."""
    d = digits(value)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def ssn_valid(value: Column) -> Column:
    """DET6: nine digits; area not 000, 666 or 900 on; group and serial not zero."""
    d = digits(value)
    area = F.substring(d, 1, 3)
    return (F.length(d) == 9) & ~area.isin("000", "666") & (area < "900") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def routing_valid(value: Column) -> Column:
    """DET7: nine digits whose sum with weights 3, 7, 1 is divisible by 10."""
    d = digits(value)
    total = sum((F.substring(d, i + 1, 1).cast("int") * w for i, w in enumerate((3, 7, 1) * 3)), F.lit(0))
    return (F.length(d) == 9) & (total % 10 == 0)


VALIDATORS: dict[str, Validator] = {"validate_luhn": luhn_valid, "validate_ssn": ssn_valid, "validate_routing": routing_valid}


def spans(text: Column, regex: str, guard: str | None = None) -> Column:
    """DET1: leftmost non-overlapping matches as array of (start, end)."""
    hit = text.rlike(guard if guard is not None else regex)
    lengths = F.transform(F.when(hit, F.regexp_extract_all(text, F.lit(regex), F.lit(0))), lambda m: F.length(m))
    gaps = F.transform(F.when(hit, F.split(text, regex, -1)), lambda g: F.length(g))
    pairs = F.zip_with(gaps, lengths, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + x["m"]
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"))).alias("out")))

    return F.coalesce(F.aggregate(pairs, zero, step, lambda acc: acc["out"]), F.array().cast("array<struct<start:int,end:int>>"))


def _ordered(i: int, p: Pattern) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(-p.confidence).alias("neg"), F.lit(i).alias("idx"), s["end"].alias("end"))


def sweep(matches: Column) -> Column:
    """WIN1: of (start, neg, idx, end), sorted, those that start at or after the
    end of the last one kept."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,neg:double,idx:int,end:int>>").alias("out"))
    return F.aggregate(
        F.array_sort(matches),
        zero,
        lambda acc, x: F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), F.array_append(acc["out"], x).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )


def may_match(text: Column, patterns: Sequence[Pattern]) -> Column:
    """Whether some pattern can match: a search for plain strings or for a digit
    comes first, so most texts are passed over once, without any alternation."""
    if any(p.guard is None for p in patterns):
        return text.isNotNull()
    out = F.lit(False)
    digit = list(dict.fromkeys(f"(?:{p.guard})" for p in patterns if not p.needs))
    if digit:
        out = text.rlike("[0-9]") & text.rlike("|".join(digit))
    for p in patterns:
        if p.needs:
            there = F.lit(False)
            for n in p.needs:
                there = there | F.contains(text, F.lit(n))
            out = out | (there & text.rlike(p.guard))
    return out


def _pick(values: Sequence[object], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx + 1)


def hits(text: Column, patterns: Sequence[Pattern] = PATTERNS, min_confidence: float = 0.5, min_risk: str = "Low", include: Sequence[str] = (), exclude: Sequence[str] = (), validators: dict[str, Validator] | None = None, keep_tokens: bool = True) -> Column:
    """DET4, DET8, FLT20: swept, validated and filtered hits of ``text``: array of
    (start, end, pattern, pii_type, confidence, risk, value). Tokens of earlier
    anonymizations are passed over whole, unless ``keep_tokens`` is false."""
    checks = VALIDATORS | (validators or {})
    if keep_tokens:
        # surer than any pattern, so a token wins the sweep where both start together
        patterns = (*patterns, Pattern("", "", TOKEN, 2.0, RISKS[0], None, "TOK_"))
    found = F.concat(*[F.transform(spans(text, p.regex, p.guard), _ordered(i, p)) for i, p in enumerate(patterns)])

    def shaped(x: Column) -> Column:
        value = F.substring(text, x["start"] + 1, x["end"] - x["start"])
        return F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            _pick([p.name for p in patterns], x["idx"]).alias("pattern"),
            _pick([p.pii_type for p in patterns], x["idx"]).alias("pii_type"),
            (-x["neg"]).alias("confidence"),
            _pick([p.risk for p in patterns], x["idx"]).alias("risk"),
            value.alias("value"),
        )

    def valid(x: Column) -> Column:
        out = x["pattern"] != ""
        for name in {p.validator for p in patterns if p.validator in checks}:
            of = [p.name for p in patterns if p.validator == name]
            out = out & (~x["pattern"].isin(*of) | F.coalesce(checks[name](x["value"]), F.lit(False)))
        wanted = (x["confidence"] >= min_confidence) & x["risk"].isin(*RISKS[RISKS.index(min_risk) :])
        if include:
            wanted = wanted & x["pii_type"].isin(*include)
        if exclude:
            wanted = wanted & ~x["pii_type"].isin(*exclude)
        return out & wanted

    return F.filter(F.transform(sweep(found), shaped), valid)


EMPTY = "array<struct<start:int,end:int,pattern:string,pii_type:string,confidence:double,risk:string,value:string>>"


def detect(df: DataFrame, text_col: str = "text", out: str = "hits", patterns: Sequence[Pattern] = PATTERNS, **options: object) -> DataFrame:
    """``df`` with the column ``out`` of hits; texts that no pattern can match are not searched."""
    text = F.col(text_col)
    return df.withColumn(out, F.when(may_match(text, patterns), hits(text, patterns, **options)).otherwise(F.array().cast(EMPTY)))


def hit_rows(df: DataFrame, keys: Sequence[str], text_col: str = "text", patterns: Sequence[Pattern] = PATTERNS, **options: object) -> DataFrame:
    """One row for each hit: ``keys`` and the hit's fields. The texts without a
    candidate are left out at the scan."""
    some = df.select(*keys, text_col).where(may_match(F.col(text_col), patterns))
    # the outer form, as the other one would have the hits computed again for a filter on their number
    return some.withColumn("_h", F.explode_outer(hits(F.col(text_col), patterns, **options))).where("_h IS NOT NULL").select(*keys, text_col, "_h.*")


def raw_hits(text: Column, pii_type: str, patterns: Sequence[Pattern] = PATTERNS) -> Column:
    """DET3: matches of the patterns of one type, neither swept nor validated."""
    return F.concat(*[F.transform(spans(text, p.regex, p.guard), _ordered(i, p)) for i, p in enumerate(patterns) if p.pii_type == pii_type])


def dedup_pairwise(found: Column) -> Column:
    """WIN2: of hits (start, end, confidence, ...) in order of start, an
    overlapping one replaces the last kept if its confidence is higher."""
    return _fold_replace(found, lambda x, last: x["start"] < last["end"])


def merge_clusters(found: Column) -> Column:
    """WIN4: like WIN2, over chains of hits that overlap the best one's end."""
    return _fold_replace(found, lambda x, last: x["start"] <= last["end"])


def _fold_replace(found: Column, overlaps: Callable[[Column, Column], Column]) -> Column:
    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        better = x["confidence"] > last["confidence"]
        return F.when(F.size(acc) == 0, F.array(x)).when(~overlaps(x, last), F.array_append(acc, x)).when(better, F.array_append(F.slice(acc, 1, F.size(acc) - 1), x)).otherwise(acc)

    ordered = F.array_sort(found)
    return F.aggregate(ordered, F.slice(ordered, 1, 0), step)


def context(text: Column, start: Column, end: Column, window: int = 100) -> Column:
    """DET10: the text around a hit, with ``...`` where it is cut."""
    low = F.greatest(start - window, F.lit(0))
    high = F.least(end + window, F.length(text))
    return F.concat(F.when(low > 0, "...").otherwise(""), F.substring(text, low + 1, high - low), F.when(high < F.length(text), "...").otherwise(""))


def _has(text: Column, start: Column, end: Column, keyword: tuple[str, str, float, str, int]) -> Column:
    word, _, _, place, far = keyword
    low = F.greatest(start - far, F.lit(0))
    before = F.contains(F.lower(F.substring(text, low + 1, start - low)), F.lit(word))
    after = F.contains(F.lower(F.substring(text, end + 1, F.lit(far))), F.lit(word))
    return {"before": before, "after": after, "around": before | after}[place]


def context_boost(text: Column, start: Column, end: Column, pii_type: Column) -> Column:
    """DET13: the summed boosts of keywords of the hit's type near it, at most 0.4."""
    total = F.lit(0.0)
    for k in KEYWORDS:
        total = total + F.when((pii_type == k[1]) & _has(text, start, end, k), k[2]).otherwise(0.0)
    return F.least(F.lit(0.4), total)


def suggested_type(text: Column, start: Column, end: Column, pii_type: Column) -> Column:
    """DET13: the type of the first keyword near the hit that is of another type."""
    return F.coalesce(*[F.when((pii_type != k[1]) & _has(text, start, end, k), k[1]) for k in KEYWORDS])


def field_type(name: Column) -> Column:
    """DET14: the type that a field's name hints at; null if none."""
    key = F.translate(F.lower(name), "- ", "__")
    return F.coalesce(*[F.when(key.isin(*names), t) for t, names in FIELD_TYPES.items()])


def value_after(rest: Column) -> Column:
    """DET16: the token after a keyword, past ``: = " '`` and blanks; '' if none."""
    return F.regexp_extract(rest, r"""^[:= \t"']*([^\s,"']+)""", 1)


def keyword_rows(df: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """DET15: one row for each keyword occurrence that a token follows:
    keyword, pii_type, value, confidence 0.5 + boost."""
    rows = None
    low = F.lower(F.col(text_col))
    for word, kind, boost, _, _ in KEYWORDS:
        if_any = df.where(F.contains(low, F.lit(word)))
        parts = F.split(F.col(text_col), f"(?i)\\Q{word}\\E", -1)
        parts = F.slice(parts, F.lit(2), F.size(parts))
        one = if_any.select(*keys, F.lit(word).alias("keyword"), F.lit(kind).alias("pii_type"), F.explode(parts).alias("_rest"), F.lit(0.5 + boost).alias("confidence"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("value", value_after(F.col("_rest"))).where("value <> ''").drop("_rest")


def line_col(text: Column, start: Column) -> tuple[Column, Column]:
    """DET26: line and column, from 1, of a place in the text."""
    head = F.left(text, start)
    return F.size(F.split(head, "\n", -1)), F.length(F.substring_index(head, "\n", -1)) + 1


# DET20 - DET24: the stricter checks of the design tier.
DISPOSABLE = ("tempmail.com", "throwaway.email", "guerrillamail.com")


def email_not_disposable(value: Column, domains: Sequence[str] = DISPOSABLE) -> Column:
    out = F.lit(True)
    for d in domains:
        out = out & ~F.endswith(value, F.lit(d))
    return out


def phone_length_ok(value: Column) -> Column:
    return F.length(digits(value)).between(10, 15)


def private_ip(value: Column) -> Column:
    out = F.lit(False)
    for p in ("10.", "192.168.", "127.", "172.16.", "172.17."):
        out = out | F.startswith(value, F.lit(p))
    return out


def iban_length_ok(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"\s", "")).between(15, 34)


def with_custom(name: str, pii_type: str, regex: str, confidence: float = 0.8, risk: str = "Medium", validator: str | None = None, guard: str | None = None, needs: tuple[str, ...] = ("",)) -> Pattern:
    """UDF2: a pattern of the user's own; append it to ``PATTERNS``. Unless it
    names strings that it ``needs``, any text that has its guard is searched."""
    return Pattern(name, pii_type, regex, confidence, risk, validator, guard, needs)


def without_validator(p: Pattern) -> Pattern:
    return replace(p, validator=None)
