"""Column functions with the same values in any engine, and a portable output form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Linear congruential steps, multiplier and increment, modulus 2**31.
STEPS = ((1103515245, 12345), (1140671485, 12820163), (1103495837, 7919), (1140690005, 104729))
MODULUS = 2147483648
FOLD = 69069


def uniform(ident: Column, stream: int = 0) -> Column:
    """Repeatable number in [0, 1) from an integer id; different streams are not correlated."""
    first, second = STEPS[stream % len(STEPS)], STEPS[(stream + 1) % len(STEPS)]
    # ids beyond the modulus are mixed in, so that the sequence does not simply repeat
    value = (F.pmod(ident, F.lit(MODULUS)) + F.shiftright(ident, 31) * F.lit(FOLD).cast("long")) % F.lit(MODULUS)
    for factor, add in (first, second):
        value = (value * F.lit(factor).cast("long") + F.lit(add)) % F.lit(MODULUS).cast("long")
    return value.cast("double") / F.lit(MODULUS).cast("double")


def bucket_of(text: Column, buckets: Column) -> Column:
    """Number in [0, buckets) from a text id, the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % buckets


def portable(df: DataFrame) -> DataFrame:
    """Plain types for comparing results between engines.

    Ids become text, decimals double, dates ISO text, arrays JSON text. In
    factorised lineage, where outputs are null in sub rows, integers become
    text too, since frames outside Spark keep no null integers.
    """
    factorised = "branch" in df.columns
    columns = []
    for f in df.schema.fields:
        column, kind = F.col(f"`{f.name}`"), f.dataType
        integer = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType))
        if f.name.endswith(("_rid", "hs_id")) and not isinstance(kind, T.ArrayType):
            column = column.cast("string")
        elif integer:
            column = column.cast("string" if factorised else "long")
        elif isinstance(kind, (T.DecimalType, T.FloatType)):
            column = column.cast("double")
        elif isinstance(kind, T.DateType):
            column = column.cast("string")
        elif isinstance(kind, T.ArrayType):
            column = F.to_json(column)
        columns.append(column.alias(f.name))
    return df.select(*columns)
