"""Registry of the engine's queries and their SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.plans import relational, states
from tesserine.sources.tables import table


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query in which tables stand in braces."""
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"{(\w+)}", text))})


QUERIES: dict = {n: lambda spark, sf_dir, q=q: run_sql(spark, sf_dir, q) for n, q in relational.Q.items()} | states.QUERIES
ORACLE_SQL: dict = {n: relational.TWIN.get(n, re.sub(r"{(\w+)}", r"\1", q)) for n, q in relational.Q.items() if n not in relational.ROWS_ONLY} | states.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by market segment: filter, join, group, having, order, limit."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_totalprice") > 1000)
    customer = table(spark, sf_dir, "customer")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment")
        .agg(F.count("*").alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"))
        .filter(F.col("n_orders") > 0)
        .orderBy(F.desc("revenue"), "c_mktsegment")
        .limit(10)
    )


QUERIES["flagship"] = flagship
ORACLE_SQL["flagship"] = """SELECT c_mktsegment, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment HAVING count(*) > 0 ORDER BY revenue DESC, c_mktsegment LIMIT 10"""
