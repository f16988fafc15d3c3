"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscript.schemas import schema


def ranked_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, rank) of a small list file: blank and # lines off, file order is the rank."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "value"))
    kept = rows.withColumn("value", F.trim("value")).where("value <> '' and not startswith(value, '#')")
    return kept.select("value", F.row_number().over(Window.orderBy("at")).alias("rank"))


def json_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(schema(name)).json(path)


def csv_rows(spark: SparkSession, path: str, name: str, sep: str = ",") -> DataFrame:
    """CSV with a header; blank cells and written-out nulls are null."""
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')
    known = [f.name for f in schema(name).fields]
    lower = {c.lower(): c for c in df.columns}
    blank = lambda c: F.when(~F.lower(F.trim(c)).isin("", "nan", "none", "null"), F.trim(c))
    return df.select(*((blank(F.col(f"`{lower[k.lower()]}`")) if k.lower() in lower else F.lit(None).cast("string")).alias(k) for k in known))


def parallel_rows(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of (arabic, english); the split comes from the file's name, the row number from its footer."""
    df = spark.read.parquet(path).select("arabic", "english", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select("arabic", "english", F.regexp_extract("file", "^([a-z]+)", 1).alias("source_split"), F.concat_ws("-", F.regexp_extract("file", "^([a-z]+)", 1), F.col("row").cast("string")).alias("source_native_id"))


def nested_books(spark: SparkSession, path: str) -> DataFrame:
    """JSON books with a list of hadiths as (book, native_id, arabic, english); one-sided entries off."""
    ddl = "metadata struct<english:struct<title:string,author:string>>, hadiths array<struct<idInBook:long,arabic:string,english:struct<narrator:string,text:string>>>"
    h = spark.read.schema(ddl).json(path, multiLine=True).select(F.col("metadata.english.title").alias("book"), F.explode("hadiths").alias("h"))
    english = F.trim(F.concat_ws(" ", "h.english.narrator", "h.english.text"))
    return h.select("book", F.col("h.idInBook").cast("string").alias("native_id"), F.col("h.arabic").alias("arabic"), english.alias("english")).where("trim(arabic) <> '' and english <> ''")


def marked_texts(spark: SparkSession, path: str) -> DataFrame:
    """(uri, at, line) of plain-text corpus files, uri from the file's name."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[a-z]+)?$", 1).alias("uri"), "value")
    return raw.select("uri", F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))


def run_file(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Rows and summary of a run file, whose last element is the only one with _run_summary."""
    raw = spark.read.text(path)
    summary = raw.where("value like '%_run_summary%'").limit(2).collect()
    if len(summary) != 1:
        raise ValueError(f"{path} has {len(summary)} run summaries")
    import json

    ddl = "id string, english string, output_tokens int, latency_s double, error string"
    rows = raw.where("value not like '%_run_summary%' and trim(value) <> ''").select(F.from_json("value", ddl).alias("r")).select("r.*")
    return rows, json.loads(summary[0][0])["_run_summary"]
