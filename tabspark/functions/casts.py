"""Strict casts with the rounding rules of the logical type system.

All casts run under ANSI mode, so one bad value fails the whole job (the
strict-cast contract).  Two shims keep integer casts rounding instead of
truncating:

* binary floating point -> integer rounds half to even (``rint``);
* decimal and text -> integer round half away from zero via ``decimal(38,18)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cast_to(col: Column, source: T.DataType, target: str) -> Column:
    if target == "integer":
        if isinstance(source, (T.FloatType, T.DoubleType)):
            return F.rint(col.cast("double")).cast("bigint")
        if isinstance(source, (T.DecimalType, T.StringType, T.VarcharType, T.CharType)):
            return F.round(col.cast("decimal(38,18)")).cast("bigint")
        return col.cast("bigint")
    if target == "float":
        return col.cast("double")
    if target == "string":
        return col.cast("string")
    if target == "boolean":
        if isinstance(source, (T.StringType, T.VarcharType, T.CharType)):
            return F.trim(col).cast("boolean")
        return col.cast("boolean")
    if target == "date":
        return col.cast("date")
    if target == "datetime":
        return col.cast("timestamp_ntz")
    raise ValueError(f"unsupported cast target: {target}")
