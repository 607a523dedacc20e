"""Scanning labelled files: the validation ladder over binary files, one row a file."""

from __future__ import annotations

from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.functions.keys import filter_key
from veilgraph.functions.text import front_matter

SUFFIXES = ("md", "txt")
MAX_BYTES = 2 * 1024 * 1024


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content, length) of the files in one folder, hidden ones left out."""
    rows = spark.read.format("binaryFile").load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return rows.where(~F.col("name").startswith(".")).select("name", "content", "length")


def check_files(rows: DataFrame) -> DataFrame:
    """(doc_key, scope, ctype, filter_key, body, reject_code): the first failing test names the code."""
    text = F.regexp_replace(F.decode(F.col("content"), "UTF-8"), "^\\uFEFF", "")
    read = rows.withColumn("_text", F.when(F.is_valid_utf8(F.col("content").cast("string")), text)).withColumn("_front", front_matter(F.coalesce("_text", F.lit(""))))
    label = lambda k: F.coalesce(F.element_at("_front.meta", k), F.lit(""))
    scope, ctype, body = label("scope"), label("content_type"), F.col("_front.body")
    suffix = F.lower(F.element_at(F.split("name", "\\."), -1))
    blank = lambda c: F.length(F.regexp_replace(c, "\\s+", "")) == 0
    code = (
        F.when(~F.col("name").contains(".") | ~suffix.isin(*SUFFIXES), "UNKNOWN_FORMAT")
        .when(F.col("length") > MAX_BYTES, "TOO_LARGE")
        .when(F.col("_text").isNotNull() & blank(F.col("_text")), "EMPTY_FILE")
        .when(F.col("_text").isNull(), "NOT_UTF8")
        .when(blank(scope) | blank(ctype) | filter_key(scope, ctype).isNull(), "NO_METADATA")
        .when(blank(body), "EMPTY_FILE")
    )
    out = read.withColumn("reject_code", code)
    good = lambda c: F.when(F.col("reject_code").isNull(), c)
    return out.select(F.col("name").alias("doc_key"), good(F.trim(scope)).alias("scope"), good(F.trim(ctype)).alias("ctype"), good(filter_key(scope, ctype)).alias("filter_key"), good(body).alias("body"), "reject_code")


def check_space(path: str, space: str) -> None:
    """Refuses a folder that is not declared for the space: its `.space` file must hold the name and nothing else.

    Read in the driver, by path or URI: Spark's readers leave hidden files out.
    """
    store, folder = FileSystem.from_uri(path)
    name = f"{folder.rstrip('/')}/.space"
    found = None
    if store.get_file_info(name).is_file:
        with store.open_input_stream(name) as stream:
            found = stream.read().decode().strip()
    if found != space:
        raise ValueError(f"{path} is declared for {found}, not for {space}")


def visible_key(space: Column, name: str) -> Column:
    """Rows of one space (tenant); spaces are partition columns of stored tables."""
    return space == F.lit(name)
