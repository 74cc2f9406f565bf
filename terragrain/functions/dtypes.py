"""Pixel types: name -> (bytes, Spark type). Complex types count the bytes of their scalar part."""

from __future__ import annotations

DTYPES = {
    "Unknown": (0, None),
    "Byte": (1, "tinyint"),
    "UInt16": (2, "int"),
    "Int16": (2, "smallint"),
    "UInt32": (4, "bigint"),
    "Int32": (4, "int"),
    "Float32": (4, "float"),
    "Float64": (8, "double"),
    "CInt16": (2, "struct<re:smallint,im:smallint>"),
    "CInt32": (4, "struct<re:int,im:int>"),
    "CFloat32": (4, "struct<re:float,im:float>"),
    "CFloat64": (8, "struct<re:double,im:double>"),
}


def size_of(name: str) -> int:
    return DTYPES[name][0]


def spark_type(name: str) -> str | None:
    return DTYPES[name][1]
