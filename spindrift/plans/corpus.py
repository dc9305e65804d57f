"""Stand-ins over the driver tables: a corpus of files, a graph of entities, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file, source) of documents."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("file"), F.coalesce("text", F.lit("")).alias("source"))


FILES_SQL = "SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS file, coalesce(text, '') AS source FROM documents"


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def edges(spark: SparkSession, sf_dir: str, repeated: bool = False) -> DataFrame:
    """(src, dst, kind): orders call customers and parts, parts call suppliers; keys inherit upwards.

    repeated: an edge may stand there several times, which spares a shuffle of all lines.
    """
    once = lambda df: df if repeated else df.distinct()
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem")
    parts = [
        t("nation").select(_id("n", "n_nationkey").alias("src"), _id("r", "n_regionkey").alias("dst"), F.lit("inherits").alias("kind")),
        t("customer").select(_id("c", "c_custkey").alias("src"), _id("n", "c_nationkey").alias("dst"), F.lit("inherits").alias("kind")),
        t("orders").select(_id("o", "o_orderkey").alias("src"), _id("c", "o_custkey").alias("dst"), F.lit("calls").alias("kind")),
        once(line.select(_id("o", "l_orderkey").alias("src"), _id("p", "l_partkey").alias("dst"))).withColumn("kind", F.lit("calls")),
        once(line.select(_id("p", "l_partkey").alias("src"), _id("s", "l_suppkey").alias("dst"))).withColumn("kind", F.lit("calls")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


EDGES_SQL = """
SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'inherits' AS kind FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'inherits' FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'calls' FROM orders
UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'calls' FROM lineitem
UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey, 'calls' FROM lineitem
"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, file, name) of every entity; the file groups entities of a kind."""
    t = lambda n: table(spark, sf_dir, n)
    month = F.concat(F.lit("orders/"), F.date_format("o_orderdate", "yyyy-MM"))
    parts = [
        t("region").select(_id("r", "r_regionkey").alias("id"), F.lit("regions").alias("file"), F.col("r_name").alias("name")),
        t("nation").select(_id("n", "n_nationkey").alias("id"), F.lit("nations").alias("file"), F.col("n_name").alias("name")),
        t("customer").select(_id("c", "c_custkey").alias("id"), F.concat(F.lit("customers/"), F.col("c_nationkey").cast("string")).alias("file"), F.col("c_name").alias("name")),
        t("orders").select(_id("o", "o_orderkey").alias("id"), month.alias("file"), F.col("o_orderpriority").alias("name")),
        t("part").select(_id("p", "p_partkey").alias("id"), F.concat(F.lit("parts/"), F.col("p_brand")).alias("file"), F.col("p_name").alias("name")),
        t("supplier").select(_id("s", "s_suppkey").alias("id"), F.concat(F.lit("suppliers/"), F.col("s_nationkey").cast("string")).alias("file"), F.col("s_name").alias("name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NODES_SQL = """
SELECT 'r' || r_regionkey AS id, 'regions' AS file, r_name AS name FROM region
UNION ALL SELECT 'n' || n_nationkey, 'nations', n_name FROM nation
UNION ALL SELECT 'c' || c_custkey, 'customers/' || c_nationkey, c_name FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'orders/' || strftime(o_orderdate, '%Y-%m'), o_orderpriority FROM orders
UNION ALL SELECT 'p' || p_partkey, 'parts/' || p_brand, p_name FROM part
UNION ALL SELECT 's' || s_suppkey, 'suppliers/' || s_nationkey, s_name FROM supplier
"""


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as run-log events: a run is a user, clicks are checks that pass from 10 up, views model calls,
    purchases outcomes."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "check").when(F.col("event_type") == "view", "model_call").when(F.col("event_type") == "purchase", "outcome").otherwise(F.col("event_type"))
    value = F.col("value").cast("decimal(18,2)").cast("string")
    data = F.create_map(
        F.lit("latency"), value, F.lit("ok"), (F.col("value") >= 10).cast("string"), F.lit("resolved"), (F.col("value") >= 20).cast("string"),
        F.lit("won_by"), F.when(F.col("value") >= 60, "oracle").otherwise("repair"), F.lit("attempts"), F.expr("cast(cast(value as int) % 4 as string)"), F.lit("files"), F.lit(""),
    )
    return e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").cast("int").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), kind.alias("kind"), data.alias("data"))
