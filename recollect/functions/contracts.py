"""Records against schemas: JSON Schema from a type, and strict decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAMES = {T.StringType: "string", T.BooleanType: "boolean", T.LongType: "integer", T.IntegerType: "integer", T.DoubleType: "number", T.FloatType: "number"}


def json_schema(kind: T.DataType, nullable: bool = False) -> dict:
    """The JSON Schema of a Spark type; objects take no other fields, nullable ones need not be there."""
    if isinstance(kind, T.StructType):
        out: dict = {
            "type": "object",
            "properties": {f.name: json_schema(f.dataType, f.nullable) for f in kind.fields},
            "required": [f.name for f in kind.fields if not f.nullable],
            "additionalProperties": False,
        }
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": json_schema(kind.elementType, kind.containsNull)}
    elif isinstance(kind, T.MapType):
        out = {"type": "object", "additionalProperties": json_schema(kind.valueType, kind.valueContainsNull)}
    else:
        out = {"type": _NAMES[type(kind)]}
    return {"anyOf": [out, {"type": "null"}]} if nullable else out


def decode_problem(payload: Column, kind: T.StructType) -> Column:
    """Why a JSON text is no record of this type; null if it is one.

    Fields that the type lacks, and values after the record, are not allowed; fields
    that are not nullable are required.
    """
    # Inside brackets, anything after the record is an error or a second element.
    listed = F.concat(F.lit("["), payload, F.lit("]"))
    value = F.when(F.get_json_object(listed, "$[1]").isNull(), F.try_parse_json(listed))
    keys = F.json_object_keys(payload)
    extra = F.array_except(keys, F.array(*(F.lit(f.name) for f in kind.fields)))
    missing = [F.when(~F.coalesce(F.array_contains(keys, f.name), F.lit(False)), F.lit(f.name)) for f in kind.fields if not f.nullable]
    first_missing = F.coalesce(*missing) if missing else F.lit(None).cast("string")
    wrong = [F.when(F.array_contains(keys, f.name) & (F.get_json_object(payload, f"$.{f.name}").isNotNull()) & F.from_json(payload, T.StructType([f]))[f.name].isNull(), F.lit(f.name)) for f in kind.fields]
    first_wrong = F.coalesce(*wrong) if wrong else F.lit(None).cast("string")
    return (
        F.when(value.isNull() | keys.isNull(), F.lit("not a JSON object"))
        .when(F.size(extra) > 0, F.concat(F.lit("unknown field "), extra[0]))
        .when(first_missing.isNotNull(), F.concat(F.lit("missing field "), first_missing))
        .when(first_wrong.isNotNull(), F.concat(F.lit("wrong type of "), first_wrong))
    )


def fingerprint(*parts: Column, size: int = 6) -> Column:
    """The first bytes, in hex, of the SHA-256 of texts with NULs between."""
    return F.left(F.sha2(F.concat_ws("\x00", *parts), 256), F.lit(2 * size))
