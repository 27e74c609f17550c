"""Which Spark type stands for which Arrow, numpy or Python type."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

#: Arrow types that Spark does not take, and what they are widened to.
_WIDER = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32(), pa.date64(): pa.timestamp("us"), pa.time32("s"): pa.time64("us"), pa.time32("ms"): pa.time64("us"), pa.time64("ns"): pa.time64("us")}
_BY_NAME = {"str": "string", "object": "string", "int": "bigint", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float": "double", "float16": "float", "float32": "float", "float64": "double", "bool": "boolean", "datetime64[ns]": "timestamp_ntz", "datetime": "timestamp_ntz"}
_PYTHON = {int: "bigint", float: "double", str: "string", bool: "boolean", bytes: "binary"}


def storable_arrow(kind: pa.DataType) -> pa.DataType:
    """The Arrow type that ``kind`` must be cast to before Spark takes it; TypeError for types that no table can hold."""
    if kind in _WIDER:
        return _WIDER[kind]
    if pa.types.is_timestamp(kind):
        return pa.timestamp("us", kind.tz)
    if pa.types.is_large_string(kind):
        return pa.string()
    if pa.types.is_large_binary(kind) or pa.types.is_fixed_size_binary(kind):
        return pa.binary()
    if pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_fixed_size_list(kind):
        return pa.list_(storable_arrow(kind.value_type))
    if pa.types.is_dictionary(kind):
        return storable_arrow(kind.value_type)
    if pa.types.is_null(kind):
        return pa.string()
    if pa.types.is_interval(kind) or pa.types.is_union(kind):
        raise TypeError(f"no table can hold {kind}")
    return kind


def from_arrow_schema(schema: pa.Schema) -> T.StructType:
    """The Spark schema of an Arrow table after ``storable_arrow``."""
    from pyspark.sql.pandas.types import from_arrow_schema as convert

    return convert(pa.schema([(f.name, storable_arrow(f.type)) for f in schema]))


def resolve_type(kind) -> T.DataType:
    """A Spark type from a name, Python type, numpy dtype, Arrow type or Spark type; ValueError for others."""
    if isinstance(kind, T.DataType):
        return kind
    try:
        if isinstance(kind, pa.DataType):
            return from_arrow_schema(pa.schema([("x", kind)]))["x"].dataType
        if kind in _PYTHON:
            return T._parse_datatype_string(_PYTHON[kind])
        if isinstance(kind, str):
            return T._parse_datatype_string(_BY_NAME.get(kind, kind))
        return T._parse_datatype_string(_BY_NAME[np.dtype(kind).name])
    except Exception as e:
        raise ValueError(f"unknown type {kind!r}") from e


#: numpy's classes of types, for ``select_dtypes``.
def class_of(kind: T.DataType) -> set[str]:
    """Names under which a Spark type may be selected."""
    if isinstance(kind, T.BooleanType):
        return {"bool", "boolean"}
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return {"number", "int", "integer", {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64"}[kind.simpleString()], kind.simpleString()}
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return {"number", "float", "floating", "float32" if isinstance(kind, T.FloatType) else "float64", kind.simpleString()}
    if isinstance(kind, T.DecimalType):
        return {"number", "decimal"}
    if isinstance(kind, (T.StringType, T.VarcharType)):
        return {"object", "str", "string"}
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return {"datetime", "datetime64", kind.simpleString()}
    return {"object", kind.simpleString()}
