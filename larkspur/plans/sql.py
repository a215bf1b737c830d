"""Pieces of DuckDB SQL that the queries' oracles share."""

from __future__ import annotations

from collections.abc import Sequence

from larkspur.functions.detection import PATTERNS, Pattern

DIGITS = "regexp_replace({v}, '[^0-9]', '', 'g')"


def luhn(v: str) -> str:
    d = DIGITS.format(v=v)
    total = f"list_sum(list_transform(range(1, len({d}) + 1), lambda i: CASE WHEN (len({d}) - i) % 2 = 0 THEN substr({d}, i, 1)::INT WHEN substr({d}, i, 1)::INT * 2 > 9 THEN substr({d}, i, 1)::INT * 2 - 9 ELSE substr({d}, i, 1)::INT * 2 END))"
    return f"(len({d}) BETWEEN 13 AND 19 AND {total} % 10 = 0)"


def ssn(v: str) -> str:
    d = DIGITS.format(v=v)
    return f"(len({d}) = 9 AND substr({d}, 1, 3) NOT IN ('000', '666') AND substr({d}, 1, 3) < '900' AND substr({d}, 4, 2) <> '00' AND substr({d}, 6, 4) <> '0000')"


def routing(v: str) -> str:
    d = DIGITS.format(v=v)
    total = " + ".join(f"{w} * substr({d}, {i + 1}, 1)::INT" for i, w in enumerate((3, 7, 1) * 3))
    return f"(len({d}) = 9 AND ({total}) % 10 = 0)"


def hits_cte(source: str = "documents", key: str = "doc_id", text: str = "text", patterns: Sequence[Pattern] = PATTERNS, least: float = 0.5) -> str:
    """CTEs that end in ``hit``: key, st, en, pattern, pii_type, confidence, risk, val."""
    arms = []
    for i, p in enumerate(patterns):
        re = p.regex.replace("'", "''")
        arms.append(
            f"SELECT {key}, {i} AS idx, -{p.confidence}::DOUBLE AS neg, m[k] AS val, (list_sum(list_transform(g[1:k], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:k-1], lambda z: length(z))), 0))::INT AS st "
            f"FROM (SELECT {key}, regexp_extract_all({text}, '{re}') m, regexp_split_to_array({text}, '{re}') g FROM {source}), unnest(range(1, len(m) + 1)) u(k)"
        )
    dim = ", ".join(f"({i}, '{p.name}', '{p.pii_type}', {p.confidence}::DOUBLE, '{p.risk}', '{p.validator or ''}')" for i, p in enumerate(patterns))
    return f"""h AS MATERIALIZED ({' UNION ALL '.join(arms)}
), r({key}, last, st, idx) AS (
  SELECT DISTINCT {key}, 0, -1, -1 FROM h
  UNION ALL
  SELECT {key}, nl, st, idx FROM (
    SELECT r.{key}, h.st + length(h.val) nl, h.st, h.idx, row_number() OVER (PARTITION BY r.{key} ORDER BY h.st, h.neg, h.idx) rn
    FROM r JOIN h ON h.{key} = r.{key} AND h.st >= r.last) WHERE rn = 1
), dim(idx, pattern, pii_type, confidence, risk, validator) AS (VALUES {dim}
), hit AS (
  SELECT h.{key}, h.st, (h.st + length(h.val))::INT AS en, pattern, pii_type, confidence, risk, val
  FROM r JOIN h USING ({key}, st, idx) JOIN dim USING (idx)
  WHERE confidence >= {least} AND (validator = '' OR (validator = 'validate_luhn' AND {luhn('val')}) OR (validator = 'validate_ssn' AND {ssn('val')}) OR (validator = 'validate_routing' AND {routing('val')}))
)"""


def mask(v: str, kind: str) -> str:
    d = DIGITS.format(v=v)
    n = f"len({d})"
    nth = f"len(regexp_replace({v}[1:i], '[^0-9]', '', 'g'))"

    def layout(keep: str) -> str:
        return f"array_to_string(list_transform(range(1, length({v}) + 1), lambda i: CASE WHEN {v}[i] NOT BETWEEN '0' AND '9' OR ({keep}) THEN {v}[i] ELSE '*' END), '')"

    local, domain = f"split_part({v}, '@', 1)", f"split_part({v}, '@', -1)"
    return f"""CASE WHEN {kind} = 'CreditCard' AND {n} >= 4 THEN {layout(f'{nth} - 1 >= {n} - 4')}
 WHEN {kind} = 'Ssn' AND {n} >= 4 THEN '***-**-' || right({d}, 4)
 WHEN {kind} = 'Email' AND contains({v}, '@') THEN (CASE WHEN length({local}) <= 2 THEN repeat('*', length({local})) ELSE left({local}, 1) || repeat('*', length({local}) - 2) || right({local}, 1) END) || '@' || {domain}
 WHEN {kind} = 'Phone' AND {n} >= 6 THEN {layout(f'{nth} - 1 < 3 OR {nth} - 1 >= {n} - 2')}
 ELSE repeat('*', strlen({v})) END"""


def spliced(replacement: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """A CTE ``done`` (key, out): texts with the hits replaced by an expression of ``hit``."""
    return f"""cut AS (
  SELECT {key}, st, en, {replacement} AS rep, lag(en, 1, 0) OVER (PARTITION BY {key} ORDER BY st) AS prev, lead(st) OVER (PARTITION BY {key} ORDER BY st) AS nxt FROM hit
), built AS (
  SELECT c.{key}, string_agg(substr(d.{text}, prev + 1, st - prev) || rep || CASE WHEN nxt IS NULL THEN substr(d.{text}, en + 1) ELSE '' END, '' ORDER BY st) AS out
  FROM cut c JOIN {source} d USING ({key}) GROUP BY c.{key}
), done AS (SELECT d.{key}, coalesce(b.out, d.{text}) AS out FROM {source} d LEFT JOIN built b USING ({key}))"""
