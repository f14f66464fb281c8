"""JSON text, arrays and structs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engagelake.schemas import quoted


def decode_list(c: Column, element: T.StructType, strict: bool = False) -> Column:
    """JSON text to an array of structs; null gives an empty array, bad text too unless ``strict``."""
    options = {"mode": "FAILFAST"} if strict else {}
    decoded = F.from_json(c, T.ArrayType(element), options)
    return F.coalesce(decoded, F.array().cast(T.ArrayType(element)))


def infer_element(df: DataFrame, column: str) -> T.StructType:
    """Declare the element type from all texts, for sources whose fields vary; bad texts are passed over."""
    found = df.select(F.schema_of_variant_agg(F.try_parse_json(quoted(column)))).first()[0] or ""
    # Variants call a struct an object, keep decimals apart by their digits, and know values of no type.
    ddl = re.sub(r"\bDECIMAL\(\d+,\d+\)", "DOUBLE", found.replace("OBJECT<", "STRUCT<"))
    ddl = re.sub(r"\bVOID\b", "STRING", ddl)
    if not ddl.startswith("ARRAY<STRUCT<"):
        raise ValueError(f"{column} does not hold JSON lists of objects")
    return T.StructType.fromDDL("v " + ddl)["v"].dataType.elementType


def flatten(source: Column, schema: T.StructType, prefix: str = "") -> list[Column]:
    """Columns for every leaf of a struct, nested ones under dotted names."""
    out: list[Column] = []
    for field in schema:
        value, name = source.getField(field.name), prefix + field.name
        if isinstance(field.dataType, T.StructType):
            out += flatten(value, field.dataType, name + ".")
        else:
            out.append(value.alias(name))
    return out
