"""Public result shape (P13): camelCase names, nested fields included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def camel_case(name: str) -> str:
    """snake_case -> camelCase (``on_time_percentage`` -> ``onTimePercentage``)."""
    head, *rest = name.split("_")
    return head + "".join(w[:1].upper() + w[1:] for w in rest)


def _camel_type(t: T.DataType) -> T.DataType:
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(camel_case(f.name), _camel_type(f.dataType), f.nullable) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_camel_type(t.elementType), t.containsNull)
    if isinstance(t, T.MapType):
        return T.MapType(t.keyType, _camel_type(t.valueType), t.valueContainsNull)
    return t


def public_shape(df: DataFrame) -> DataFrame:
    """Rename columns -- and fields of nested structs, e.g. scorecard
    pages -- to the camelCase public names.  A projection only: struct casts
    rename fields by position, so no data moves and nothing is shuffled."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = _camel_type(f.dataType)
        cols.append((c.cast(t) if t != f.dataType else c).alias(camel_case(f.name)))
    return df.select(*cols)


def result_json(df: DataFrame) -> DataFrame:
    """Every row as ``{"result": {...}}`` with public names; nulls are kept."""
    p = public_shape(df)
    return p.select(F.to_json(F.struct(F.struct(*[F.col(f"`{c}`") for c in p.columns]).alias("result")),
                              {"ignoreNullFields": "false"}).alias("json"))
