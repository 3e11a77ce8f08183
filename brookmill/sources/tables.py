"""Reading tables and literal fixture tables, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGES = "page_id BIGINT, url STRING, html STRING"
DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
FETCHES = "url STRING, final_url STRING, status INT, content_type STRING, body BINARY, rendered BOOLEAN, error STRING"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, sql: str) -> DataFrame:
    """A fixture table written as SQL VALUES that both engines read alike."""
    return spark.sql(sql)


def crawl_graph(spark: SparkSession, path: str) -> DataFrame:
    """Crawl-graph JSON lines: nodes with their links and the terms of each link."""
    return spark.read.schema("id STRING, payload_bytes BIGINT, target BOOLEAN, links ARRAY<STRUCT<`to`: STRING, anchor_terms: ARRAY<STRING>>>").json(path)


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines dataset under an explicit schema; rows that do not parse have nulls and their text in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record STRING").json(path)


def bodies(spark: SparkSession, path: str, most_bytes: int = 10_485_760) -> DataFrame:
    """Files as fetched bodies, without those over the byte bound."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(f"length <= {most_bytes}").selectExpr("path AS url", "length AS n_bytes", "content AS body")


def spread(scan: DataFrame) -> DataFrame:
    """A plain table scan dealt to all cores where its files give fewer tasks than that: one small file with one row
    group is one task, too few for a parser. Larger tables stay as they are, without a shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
