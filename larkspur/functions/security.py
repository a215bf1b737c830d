"""Input validation and sanitizing as Columns (STR1-STR19, JN13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The threat patterns.
SQL_PATTERNS = (
    r"(?i)\b(union\s+select|select\s+.*\s+from|insert\s+into|update\s+.*\s+set|delete\s+from)",
    r"(?i)\b(drop\s+table|alter\s+table|create\s+table|truncate\s+table)",
    r"(?i)\b(or\s+1\s*=\s*1|and\s+1\s*=\s*1|'\s*or\s*')",
    r"(?i)\b(exec|execute|xp_|sp_)",
    r"(?i)--\s*$|/\*.*\*/",
    r"(?i)\b(waitfor\s+delay|benchmark\s*\(|sleep\s*\()",
    r"(?i)'\s*(;|--)",
)
XSS_PATTERNS = (
    r"(?i)<script[^>]*>",
    r"(?i)</script>",
    r"(?i)javascript\s*:",
    r"(?i)on\w+\s*=",
    r"(?i)<iframe[^>]*>",
    r"(?i)<object[^>]*>",
    r"(?i)<embed[^>]*>",
    r"(?i)<link[^>]*>",
    r"(?i)<meta[^>]*>",
    r"(?i)expression\s*\(",
    r"(?i)url\s*\(\s*['\"]?\s*javascript:",
    r"(?i)data\s*:\s*text/html",
    r"(?i)vbscript\s*:",
)
TRAVERSAL_PATTERNS = (
    r"(?i)\.\./",
    r"(?i)\.\.\\",
    r"(?i)%2e%2e/",
    r"(?i)%2e%2e\\",
    r"(?i)\.\.%2f",
    r"(?i)\.\.%5c",
    r"(?i)%252e%252e/",
    r"(?i)\.%00\.",
)
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
BAD_FILENAME = r"""[/\\:*?"<>|\x00]"""


def any_match(text: Column, patterns: Sequence[str]) -> Column:
    """Whether any of the patterns matches; each stays a literal, compiled once."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def violations(text: Column, longest: int = 10_000, blocked: Sequence[str] = ()) -> Column:
    """STR1: the names of the checks that ``text`` fails."""
    checks = {
        "length": F.length(text) > longest,
        "null_byte": F.contains(text, F.lit("\x00")),
        "sql_injection": any_match(text, SQL_PATTERNS),
        "xss": any_match(text, XSS_PATTERNS),
        "path_traversal": any_match(text, TRAVERSAL_PATTERNS),
    }
    if blocked:
        checks["blocked"] = any_match(text, [f"\\Q{b}\\E" for b in blocked])
    return F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()]))


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def normalize_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def sanitize(text: Column, html: bool = True, space: bool = True, trim: bool = True, lower: bool = False, longest: int | None = None, allowed: str | None = None) -> Column:
    """STR3: NUL, tags, white space, ends, case, length, characters, in this order."""
    out = F.translate(text, "\x00", "")
    if html:
        out = strip_html(out)
    if space:
        out = normalize_space(out)
    if trim:
        out = F.trim(out)
    if lower:
        out = F.lower(out)
    if longest is not None:
        out = F.left(out, F.lit(longest))
    if allowed is not None:
        out = F.array_join(F.regexp_extract_all(out, F.lit(allowed), F.lit(0)), "")
    return out


def email_ok(text: Column) -> Column:
    return (F.length(text) <= 254) & text.rlike(EMAIL)


def url_ok(text: Column) -> Column:
    """STR10: http or https with a host, and no threat in it."""
    return text.rlike(r"^(?i)https?://[^/\s?#]+") & (F.size(violations(text)) == 0)


def filename_ok(text: Column) -> Column:
    """STR11."""
    return (F.length(text).between(1, 255)) & ~F.startswith(text, F.lit(".")) & ~text.rlike(BAD_FILENAME) & ~any_match(text, TRAVERSAL_PATTERNS)


def agent_blocked(agent: Column, blocked: Sequence[str]) -> Column:
    """STR13."""
    out = F.lit(False)
    for b in blocked:
        out = out | F.contains(F.lower(agent), F.lit(b.lower()))
    return out


def normalize_path(path: Column) -> Column:
    """STR14: UUIDs and numeric segments as ``{id}``."""
    out = F.regexp_replace(path, "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "{id}")
    return F.regexp_replace(out, r"/\d+(?=/|$)", "/{id}")


def glob_regex(pattern: Column, question: bool = True, escape_dots: bool = True) -> Column:
    """JN4, STR15: the anchored regex of a glob; ``*`` any run, ``?`` one character."""
    out = F.replace(pattern, F.lit("."), F.lit("\\.")) if escape_dots else pattern
    out = F.replace(out, F.lit("*"), F.lit(".*"))
    if question:
        out = F.replace(out, F.lit("?"), F.lit("."))
    return F.concat(F.lit("^"), out, F.lit("$"))


def name_matches(name: Column, pattern: str) -> Column:
    """SRC6: ``*x*`` contains, ``*x`` ends with, ``x*`` starts with, else equals."""
    if len(pattern) > 1 and pattern.startswith("*") and pattern.endswith("*"):
        return F.contains(name, F.lit(pattern[1:-1]))
    if pattern.startswith("*"):
        return F.endswith(name, F.lit(pattern[1:]))
    if pattern.endswith("*"):
        return F.startswith(name, F.lit(pattern[:-1]))
    return name == pattern


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for other text."""
    parts = F.split(ip, r"\.")
    ok = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    value = sum((F.get(parts, i).try_cast("long") * (256 ** (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(ok, value)


def cidr_range(cidr: Column) -> tuple[Column, Column]:
    """First and last address of a network, as numbers."""
    base, bits = ip_number(F.substring_index(cidr, "/", 1)), F.substring_index(cidr, "/", -1).cast("int")
    size = F.pow(F.lit(2.0), F.lit(32) - bits).cast("long")
    low = base - base % size
    return low, low + size - 1


def redact_context(context: Column, keys: Sequence[str]) -> Column:
    """STR18: the listed keys of a map as ``[REDACTED]``."""
    return F.transform_values(context, lambda k, v: F.when(F.lower(k).isin(*keys), "[REDACTED]").otherwise(v))


def permission_parts(text: Column) -> Column:
    """STR17: ``resource:action[:scope]`` as a struct; other shapes: null."""
    p = F.split(text, ":")
    return F.when(F.size(p).isin(2, 3), F.struct(F.get(p, 0).alias("resource"), F.get(p, 1).alias("action"), F.get(p, 2).alias("scope")))
