"""The data model: points of typed values, their validation, and typed views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.clock import MAX_CLOCK, MIN_CLOCK

DOUBLE, INTEGER, BOOLEAN, STRING, DATETIME, EMPTY = range(6)
VALUE_COLUMNS = {DOUBLE: "v_double", INTEGER: "v_long", BOOLEAN: "v_bool", STRING: "v_string"}
VALUE_TYPES = {DOUBLE: "double", INTEGER: "bigint", BOOLEAN: "boolean", STRING: "string"}
#: Bytes a point counts for; a string counts its bytes besides.
POINT_BYTES = {DOUBLE: 20, INTEGER: 20, BOOLEAN: 13, STRING: 12}
POINTS_DDL = "sid bigint, clock bigint, dtype tinyint, v_double double, v_long bigint, v_bool boolean, v_string string, quality int, seq bigint"
POINT_COLUMNS = ["sid", "clock", "dtype", "v_double", "v_long", "v_bool", "v_string", "quality", "seq"]
_TAGS = {
    "double": DOUBLE, "float": DOUBLE, "decimal": DOUBLE, "bigint": INTEGER, "int": INTEGER, "smallint": INTEGER, "boolean": BOOLEAN, "string": STRING,
    "timestamp": STRING, "timestamp_ntz": STRING,
}


def type_tag(dtype: str) -> int:
    """Tag of a Spark type name; EMPTY for types that are not stored (tinyint among them)."""
    return _TAGS.get(dtype.split("(")[0], EMPTY)


def points_of(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows (sid, clock, value[, quality][, seq]) as points with typed columns. Timestamps become text."""
    tag = type_tag(dict(df.dtypes)[value])
    if tag == EMPTY:
        raise TypeError(f"values of type {dict(df.dtypes)[value]} are not stored")
    typed = [F.col(value).cast(VALUE_TYPES[t]).alias(c) if t == tag else F.lit(None).cast(VALUE_TYPES[t]).alias(c) for t, c in VALUE_COLUMNS.items()]
    quality = F.coalesce(F.col("quality"), F.lit(0)) if "quality" in df.columns else F.lit(0)
    seq = F.coalesce(F.col("seq"), F.lit(0)) if "seq" in df.columns else F.lit(0)
    return df.select(F.col("sid").cast("long").alias("sid"), F.col("clock").cast("long").alias("clock"), F.lit(tag).cast("tinyint").alias("dtype"), *typed, quality.cast("int").alias("quality"), seq.cast("long").alias("seq"))


def fault() -> Column:
    """Why a point cannot be stored; null if it can: it needs a sid, a clock in the domain and a value that is not NaN (infinite ones are stored)."""
    return F.expr(
        f"""case when sid is null then 'no sid' when clock is null or clock < {MIN_CLOCK} or clock > {MAX_CLOCK} then 'clock'
        when v_double is null and v_long is null and v_bool is null and v_string is null then 'no value'
        when isnan(v_double) then 'nan'
        when int(v_double is not null) + int(v_long is not null) + int(v_bool is not null) + int(v_string is not null) > 1 then 'mixed types' end"""
    )


def validate(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points that can be stored, and quarantined ones with the column ``fault``."""
    marked = points.withColumn("fault", fault())
    return marked.filter("fault is null").drop("fault"), marked.filter("fault is not null")


def mixed_series(points: DataFrame) -> DataFrame:
    """(sid) of series that have values of more than one type."""
    return points.groupBy("sid").agg(F.min("dtype").alias("a"), F.max("dtype").alias("b")).filter("a <> b").select("sid")


def typed_view(points: DataFrame, tag: int) -> DataFrame:
    """(sid, clock, value, quality, seq) of the points of one type."""
    return points.filter(F.col("dtype") == tag).select("sid", "clock", F.col(VALUE_COLUMNS[tag]).alias("value"), "quality", "seq")


def type_of(points: DataFrame) -> DataFrame:
    """(sid, dtype) by each series' first point."""
    return points.groupBy("sid").agg(F.min_by("dtype", "clock").alias("dtype"))


def point_bytes() -> Column:
    return F.expr(" ".join(["case dtype", *[f"when {t} then {n}{' + octet_length(v_string)' if t == STRING else ''}" for t, n in POINT_BYTES.items()], "else 0 end"]))
