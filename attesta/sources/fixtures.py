"""JSON records as tables: tolerant of the shapes that hand-written files have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.schemas import TABLES


def _lax(kind: T.DataType) -> T.DataType:
    """The same shape with every leaf read as text; lists of text too, since some files write {} for them."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _lax(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return T.ArrayType(_lax(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(T.StringType(), _lax(kind.valueType))
    return T.StringType()


def _strict(c, kind: T.DataType):
    """A lax column as its own type; what can't be read is null, booleans may be 0 or 1."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_strict(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(c, lambda x: _strict(x, kind.elementType))
    if isinstance(kind, T.ArrayType):
        return F.when(c.startswith("["), F.from_json(c, kind)).when(c == "{}", F.array().cast(kind))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _strict(v, kind.valueType))
    if isinstance(kind, T.BooleanType):
        return F.when(c.isin("true", "1", "1.0"), True).when(c.isin("false", "0", "0.0"), False)
    if isinstance(kind, T.StringType):
        return c
    number = F.when(c == "true", "1").when(c == "false", "0").otherwise(c)
    instant = F.unix_millis(F.try_to_timestamp(c)) if isinstance(kind, T.LongType) else F.lit(None)
    return F.coalesce(number.try_cast(kind), number.try_cast("double").try_cast(kind), instant.cast(kind))


def read_json(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A file of one record or a list of them; ISO texts in time columns become milliseconds, P_cited is p_cited."""
    kind = T.StructType.fromDDL(TABLES[table])
    names = [f.name for f in kind.fields]
    lax = T.ArrayType(T.StructType([T.StructField(f.name, _lax(f.dataType)) for f in kind.fields]))
    text = F.regexp_replace("value", '"P_cited"\\s*:', '"p_cited":')  # names differ by case alone
    df = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(text, lax)).alias("r")).select("r.*")
    rows = df.select(*[_strict(F.col(f.name), f.dataType).alias(f.name) for f in kind.fields])
    return rows.select(*names)
