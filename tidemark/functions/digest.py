"""Order-insensitive content digests and hash buckets, equal on every engine that has md5."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MASK = (1 << 20) - 1
_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
#: Nested values keep their microseconds and their NULL fields.
_NESTED = {"timestampFormat": _MICROS, "timestampNTZFormat": _MICROS, "ignoreNullFields": "false"}


def column_text(field: T.StructField) -> Column:
    """Lossless text of one column; NULL has its own mark and separators are escaped."""
    col, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(col, _MICROS)
    elif isinstance(kind, T.BinaryType):
        text = F.hex(col)
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(col, _NESTED)
    else:
        text = col.cast("string")
    if isinstance(kind, (T.StringType, T.StructType, T.ArrayType, T.MapType)):
        text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))
    return F.coalesce(text, F.lit("\\N"))


def row_text(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    """One text per row over the given columns, in the given order."""
    return F.concat_ws("|", *[column_text(df.schema[name]) for name in (cols or df.columns)])


def hash60(text: Column) -> Column:
    """First 60 bits of the md5 of a text as a non-negative bigint."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def digest_sum(hashed: Column) -> Column:
    """Exact sum of 60-bit hashes as text.

    Three bigint sums over 20-bit parts stay in compiled code and hold 2^43 rows; the wide decimal
    is only formed once per group, at the end.
    """
    low = F.sum(hashed.bitwiseAND(F.lit(_MASK)))
    mid = F.sum(F.shiftright(hashed, 20).bitwiseAND(F.lit(_MASK)))
    high = F.sum(F.shiftright(hashed, 40))
    wide = "decimal(38,0)"
    total = (high.cast("decimal(20,0)") * F.lit(1 << 40).cast("decimal(14,0)")).cast(wide)
    total = (total + (mid.cast("decimal(20,0)") * F.lit(1 << 20).cast("decimal(8,0)")).cast(wide)).cast(wide)
    return F.coalesce((total + low.cast(wide)).cast(wide), F.lit(0).cast(wide)).cast("string")


def bucket_of(key: Column, modulus: int) -> Column:
    """Remainder of a key's hash; the same key always lands in the same bucket."""
    return F.pmod(hash60(key.cast("string")), F.lit(modulus)).cast("int")
