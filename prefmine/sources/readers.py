"""Sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmine.sources.schemas import BOOK_GENRES, BOOK_META, BOOK_REVIEW, CHAIN_ROW, RETAIL_REVIEW


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RETAIL_REVIEW, multi_line: bool = True) -> DataFrame:
    """Tab-separated reviews. Rows that do not fit the schema are kept, with their text in ``_corrupt_record``.

    Quoted fields may span lines, which makes a file one split. For files without line breaks in
    fields pass ``multi_line=False`` so that large files are read by many tasks.
    """
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return (
        spark.read.schema(with_bad)
        .options(sep="\t", header="true", quote='"', escape='"', multiLine=str(multi_line).lower(), mode="PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .csv(path)
    )


def load_data(spark: SparkSession, path: str, format: str = "parquet", multi_line: bool = True) -> DataFrame:
    """Reviews by format name.

    A TSV file whose quoted fields hold no newlines can be read in splits with ``multi_line=False``;
    otherwise each file is one task. ``read_tsv`` keeps the text of malformed rows, which are dropped here.
    """
    if format == "parquet":
        return spark.read.parquet(path)
    if format == "tsv":
        return read_tsv(spark, path, multi_line=multi_line).drop("_corrupt_record")
    raise ValueError(f"unknown format {format!r}: use 'parquet' or 'tsv'")


def read_hive_rating(spark: SparkSession, path: str, column: str = "overall") -> DataFrame:
    """Files under ``column=N/`` folders with N as an int column; files elsewhere are not read."""
    return spark.read.option("basePath", path).parquet(f"{path}/*{column}=*").withColumn(column, F.col(column).cast("int"))


def read_union_by_name(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files of a glob, columns matched by name; a column a file lacks is null."""
    return spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "false").parquet(path)


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the named columns reach the scan."""
    return spark.read.parquet(path).select(*columns)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = BOOK_REVIEW) -> DataFrame:
    """JSON lines; malformed lines are skipped, missing text is ``""`` and missing numbers are 0."""
    raw = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    filled = [
        F.coalesce(F.col(f.name), F.lit("") if isinstance(f.dataType, T.StringType) else F.lit(0).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    return raw.select(*filled)


def top_labels(counts: str, n: int = 3) -> Column:
    """The ``n`` keys with the largest counts of a map, ties by key."""
    entries = F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("key"), e["value"].alias("value")))
    return F.slice(F.array_sort(entries), 1, n)


def read_genres(spark: SparkSession, path: str) -> DataFrame:
    """Primary, second and third genre per book from its genre counts; books without any drop out."""
    raw = spark.read.schema(BOOK_GENRES).json(path).filter(F.size("genres") > 0)
    top = raw.select("book_id", top_labels("genres").alias("top"))
    return top.select(
        "book_id", F.get("top", F.lit(0))["key"].alias("primary_genre"), F.get("top", F.lit(1))["key"].alias("genre_2"),
        F.get("top", F.lit(2))["key"].alias("genre_3"), F.get("top", F.lit(0))["value"].alias("primary_genre_count"),
    )


def read_book_meta(spark: SparkSession, path: str, max_chars: int | None = None) -> DataFrame:
    """Flat book attributes with the first author. Descriptions stay whole unless ``max_chars`` is given."""
    raw = spark.read.schema(BOOK_META).json(path)
    description = F.coalesce("description", F.lit(""))
    if max_chars is not None:
        description = F.substring(description, 1, max_chars)
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("publication_year", "num_pages", "average_rating")]
    return raw.select(
        "book_id", F.coalesce("title", F.lit("")).alias("title"), description.alias("description"),
        F.coalesce(F.get("authors", F.lit(0))["author_id"], F.lit("")).alias("author_id"), *text,
    )


def read_chain_csv(spark: SparkSession, path: str, schema: T.StructType = CHAIN_ROW) -> DataFrame:
    """Typed CSV of chain interactions."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Every Parquet file under ``path`` with its size and row count; ``rows`` is null if none could be read.

    Row counts come from the file footers: no column is read and no schema is inferred.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        .load(path).select("path", F.col("length").alias("bytes"))
    )
    # the metadata's path is URL-encoded, that of binary files isn't; a plus sign stands for itself in either
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    readable = (
        spark.read.schema("unused string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", "true")
        .parquet(path).select(decoded.alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("rows"))
    )
    norm = lambda c: F.regexp_replace(c, r"^file:/+", "file:/")
    return (
        files.withColumn("path", norm("path")).join(readable.withColumn("path", norm("path")), "path", "left")
        .withColumn("readable", F.col("rows").isNotNull())
    )
