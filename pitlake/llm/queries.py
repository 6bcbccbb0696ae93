"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.llm.bpe import encoded, token_counts
from pitlake.llm.conversations import conversations
from pitlake.llm.nearest import nearest
from pitlake.llm.packing import packed
from pitlake.llm.splitting import pieces
from pitlake.llm.topn import top_n
from pitlake.operators.instants import instants
from pitlake.session import spread
from pitlake.sources.tables import table

TOLERANCE_US = 20 * 60 * 1_000_000
CAPACITY, LIMIT, OVERLAP = 2048, 512, 64


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    tests = table(spark, folder, "backtest_results").select(F.lit("backtest_results").alias("rec_table"), F.col("run_id").alias("rec_id"), F.col("ticker").alias("entity"), F.unix_micros("as_of").alias("us"))
    legs = instants(table(spark, folder, "legs").select("client_order_id", "asset", "filled_at", "feed").where("filled_at is not null"), "filled_at", table(spark, folder, "feeds"))
    legs = legs.select(F.lit("legs").alias("rec_table"), F.col("client_order_id").alias("rec_id"), F.col("asset").alias("entity"), F.col("instant_us").alias("us"))
    col = F.col
    return nearest(
        tests.unionByName(legs), table(spark, folder, "bars"), TOLERANCE_US, col("rec_table"), col("rec_id"), col("entity"), col("us"), col("bar_id"), col("ticker"), F.unix_micros("timestamp")
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "ledger").where("type = 'decision'").select("cohort", F.regexp_replace(F.lower("sector"), r"(?U)\s+", " ").alias("sector"), "logodds", "written_at", "seq")
    items = items.withColumn("sector", F.trim("sector")).where("sector <> ''")
    return top_n(items, ["cohort", "sector"], "logodds", ["written_at"], "seq", 3)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(table(spark, folder, "agent_messages"), table(spark, folder, "agent_roles"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(spread(table(spark, folder, "documents").select("doc_id", "text")), F.col("text"), ["doc_id"])


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = token_counts(spread(table(spark, folder, "documents").select("doc_id", "text")), F.col("text"), ["doc_id"])
    return packed(sizes, "doc_id", "tokens", CAPACITY)


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text", LIMIT, OVERLAP)


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p7_found, p8_ids, p9_containers, p10_pieces)}
