"""Semi-structured values: text that is parsed once into a VARIANT, and typed fields of it that fail gently."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The value of JSON text; null for what isn't any."""
    return F.try_parse_json(text)


def kind(value: Column, path: str = "$") -> Column:
    """What a part is: ``object``, ``array``, ``string``, ``number``, ``boolean``, ``null``; null where there is none."""
    part = F.try_variant_get(value, path, "variant")
    name = F.schema_of_variant(part)
    return (
        F.when(part.isNull(), None).when(F.is_variant_null(part), "null").when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").otherwise("number")
    )


def with_fields(df: DataFrame, text: str, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``df`` with a column for each of ``fields``, name: (path, type). The text is parsed once for all; a field that isn't there, or
    can't be had as its type, is null."""
    held = df.withColumn("_document", parsed(F.col(text)))
    return held.select(*df.columns, *(F.try_variant_get("_document", path, kind).alias(name) for name, (path, kind) in fields.items()))
