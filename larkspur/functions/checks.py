"""A fluent validator and checks of ids and paths as Columns (STR16, STR19, SCH5, UDF9)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .detection import field_type
from .rules import Field
from .security import email_ok, url_ok

UUID = "^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


class Validator:
    """STR16, UDF9: checks of a row's fields; ``errors`` has one ``field:check`` for
    each that fails, in order. Empty text passes all checks but ``required`` and lengths."""

    def __init__(self) -> None:
        self._checks: list[tuple[str, Column]] = []

    def custom(self, field: str, check: str, fails: Column | Callable[[], Column]) -> Validator:
        self._checks.append((f"{field}:{check}", F.coalesce(fails() if callable(fails) else fails, F.lit(False))))
        return self

    def required(self, field: str) -> Validator:
        return self.custom(field, "required", F.col(field).isNull() | (F.trim(F.col(field).cast("string")) == ""))

    def length(self, field: str, least: int = 0, most: int | None = None) -> Validator:
        n = F.octet_length(F.col(field))
        self.custom(field, "min_length", n < least)
        return self if most is None else self.custom(field, "max_length", n > most)

    def range(self, field: str, least: float, most: float) -> Validator:
        return self.custom(field, "range", ~F.col(field).between(least, most))

    def _unless_empty(self, field: str, check: str, ok: Column) -> Validator:
        return self.custom(field, check, (F.col(field) != "") & ~ok)

    def email(self, field: str) -> Validator:
        return self._unless_empty(field, "email", email_ok(F.col(field)))

    def url(self, field: str) -> Validator:
        return self._unless_empty(field, "url", url_ok(F.col(field)))

    def uuid(self, field: str) -> Validator:
        return self._unless_empty(field, "uuid", F.col(field).rlike(UUID))

    def pattern(self, field: str, regex: str) -> Validator:
        return self._unless_empty(field, "pattern", F.col(field).rlike(regex))

    def one_of(self, field: str, allowed: Sequence[str]) -> Validator:
        return self._unless_empty(field, "one_of", F.col(field).isin(*allowed))

    def errors(self) -> Column:
        found = F.array(*[F.when(fails, name) for name, fails in self._checks]) if self._checks else F.array().cast("array<string>")
        return F.array_compact(found)


def dataset_id_ok(text: Column) -> Column:
    """STR19: 1 to 128 bytes of letters, digits, hyphens and underscores."""
    return F.coalesce(F.octet_length(text).between(1, 128) & text.rlike(r"^[\p{L}\p{N}_-]+$"), F.lit(False))


def json_path_ok(text: Column) -> Column:
    """STR19: ``$`` and steps by name or by place."""
    return F.coalesce(text.rlike(r"^\$(?:\.[A-Za-z_][A-Za-z0-9_-]*|\[(?:[0-9]+|\*|'[^']+')\])*$"), F.lit(False))


def pii_fields(fields: Sequence[Field]) -> list[tuple[str, str]]:
    """SCH5: the fields of a schema whose names hint at a type, with that type."""
    from .detection import FIELD_TYPES

    names = {n: kind for kind, of in FIELD_TYPES.items() for n in of}
    plain = lambda n: n.lower().replace("-", "_").replace(" ", "_")
    return [(f.name, names[plain(f.name)]) for f in fields if plain(f.name) in names]


def field_is_pii(name: Column) -> Column:
    """SCH5 over a table of field names."""
    return field_type(name).isNotNull()
