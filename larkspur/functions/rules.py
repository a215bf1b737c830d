"""Declarative schemas over JSON documents as Columns (SCH1-SCH6)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A field's type and constraints. ``required``: it must be there unless it
    may be null; lengths count bytes."""

    name: str
    kind: str
    nullable: bool = True
    required: bool = False
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    minimum: float | None = None
    maximum: float | None = None
    one_of: tuple[str, ...] = ()


def type_ok(value: Column, kind: str) -> Column:
    """SCH3: whether a VARIANT is of the kind; ``Enum`` and ``Binary`` are strings."""
    t = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return {
        "String": t == "STRING",
        "Binary": t == "STRING",
        "Enum": t == "STRING",
        "Integer": t == "BIGINT",
        "Float": t.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"),
        "Boolean": t == "BOOLEAN",
        "Json": F.startswith(t, F.lit("OBJECT")),
        "Struct": F.startswith(t, F.lit("OBJECT")),
        "Array": F.startswith(t, F.lit("ARRAY")),
        "Date": (t == "STRING") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(),
        "Timestamp": (t == "STRING") & text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"),
    }[kind]


def violations(document: Column, fields: Sequence[Field], strict: bool = False) -> Column:
    """SCH1, SCH2: ``field:constraint`` of everything that a JSON text breaks. A
    text that is no object breaks ``type`` alone; a null value breaks at most
    ``nullable``; a wrong type does not stop the other constraints."""
    doc = F.try_parse_json(document)
    out = []
    for f in fields:
        value = F.try_variant_get(doc, f"$.{f.name}", "variant")
        text, number = F.try_variant_get(doc, f"$.{f.name}", "string"), F.try_variant_get(doc, f"$.{f.name}", "double")
        there = value.isNotNull()
        null = there & F.is_variant_null(value)
        live = there & ~F.is_variant_null(value)
        if f.required or not f.nullable:
            out.append(F.when(~there, f"{f.name}:required"))
        if not f.nullable:
            out.append(F.when(null, f"{f.name}:nullable"))
        out.append(F.when(live & ~type_ok(value, f.kind), f"{f.name}:type"))
        size = F.octet_length(text)
        for name, broken in (
            ("min_length", size < f.min_length if f.min_length is not None else None),
            ("max_length", size > f.max_length if f.max_length is not None else None),
            ("pattern", ~text.rlike(f.pattern) if f.pattern is not None else None),
            ("min_value", number < f.minimum if f.minimum is not None else None),
            ("max_value", number > f.maximum if f.maximum is not None else None),
            ("one_of", ~text.isin(*f.one_of) if f.one_of else None),
        ):
            if broken is not None:
                out.append(F.when(live & F.coalesce(broken, F.lit(False)), f"{f.name}:{name}"))
    found = F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")
    if strict:
        keys = F.json_object_keys(document)
        unknown = F.transform(F.filter(keys, lambda k: ~k.isin(*[f.name for f in fields])), lambda k: F.concat(k, F.lit(":unknown")))
        found = F.concat(found, F.coalesce(unknown, F.array().cast("array<string>")))
    is_object = F.startswith(F.schema_of_variant(doc), F.lit("OBJECT"))
    return F.when(F.coalesce(is_object, F.lit(False)), found).otherwise(F.array(F.lit(":type")))
