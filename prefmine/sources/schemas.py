"""Declared row types of the inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names of a retail review, in file order.
_TEXT = T.StringType()
RETAIL_REVIEW = T.StructType(
    [T.StructField(n, _TEXT) for n in ("marketplace", "customer_id", "review_id", "product_id", "product_parent", "product_title", "product_category")]
    + [T.StructField(n, T.IntegerType()) for n in ("star_rating", "helpful_votes", "total_votes")]
    + [T.StructField(n, _TEXT) for n in ("vine", "verified_purchase", "review_headline", "review_body")]
    + [T.StructField("review_date", T.DateType())]
)

# Field names of a raw book review.
BOOK_REVIEW = T.StructType(
    [T.StructField(n, _TEXT) for n in ("user_id", "book_id", "review_id")]
    + [T.StructField("rating", T.ByteType()), T.StructField("review_text", _TEXT)]
    + [T.StructField(n, _TEXT) for n in ("date_added", "date_updated", "read_at", "started_at")]
    + [T.StructField(n, T.IntegerType()) for n in ("n_votes", "n_comments")]
)

BOOK_META = T.StructType(
    [T.StructField(n, _TEXT) for n in ("book_id", "title", "description")]
    + [T.StructField("authors", T.ArrayType(T.StructType([T.StructField("author_id", _TEXT)])))]
    + [T.StructField(n, _TEXT) for n in ("publication_year", "num_pages", "average_rating")]
)

BOOK_GENRES = T.StructType([T.StructField("book_id", _TEXT), T.StructField("genres", T.MapType(_TEXT, T.LongType()))])

CHAIN_ROW = T.StructType(
    [T.StructField("user_id", T.IntegerType()), T.StructField("book_id", T.IntegerType()), T.StructField("is_read", T.ByteType()), T.StructField("rating", T.ByteType())]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in declared order and type; text that does not fit becomes null."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def require(df: DataFrame, columns: set[str]) -> DataFrame:
    """Fails before any job runs if a needed column is missing."""
    missing = sorted(columns - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def timestamp_of(df: DataFrame, column: str):
    """Timestamp expression that fits the column's type: a cast, or the textual forms."""
    from prefmine.functions.scalars import any_timestamp, utc_wall_clock

    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return utc_wall_clock(F.col(column))
    if isinstance(kind, ( T.TimestampNTZType, T.DateType)):
        return F.col(column).cast("timestamp_ntz")
    return any_timestamp(column)


def contract(df: DataFrame, required: set[str]) -> DataFrame:
    """One row per column of the schema: name, type, whether it is required."""
    require(df, required)
    fields = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("column_type"), F.lit(f.name in required).alias("required")) for f in df.schema.fields])
    profile = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return profile.select(F.explode(fields).alias("f"), "total_rows").select("f.*", "total_rows")
