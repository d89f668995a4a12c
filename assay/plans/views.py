"""Candidate and validation views over the driver's tables.

The same expressions serve Spark (``selectExpr``) and the DuckDB oracles, so
both engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def percent(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE) / CAST(100 AS DOUBLE)"


CAND = [
    "p_partkey AS candidate_id", "p_partkey AS _ord", "p_brand AS prototype", "p_type AS family", "p_size AS atoms", "p_partkey % 7 AS space_group",
    percent("(p_partkey * 37) % 101") + " AS f1", percent("(p_partkey * 53) % 101") + " AS f2",
    "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE " + percent("(p_partkey * 71) % 101") + " END AS f3",
    "CASE WHEN p_partkey % 4 = 0 THEN " + percent("(p_partkey * 29) % 101") + " END AS f4",
    "CAST(0.5 AS DOUBLE) AS confidence", "p_partkey % 13 <> 0 AS is_valid",
    percent("(p_partkey * 17) % 101") + " AS novelty", percent("(p_partkey * 19) % 101") + " AS diversity",
]
VAL = [
    "l_partkey AS candidate_id", "CASE l_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS validator",
    "l_discount AS force_max", "l_tax AS stress_max", "l_linestatus = 'F' AS relaxation_converged",
    "CASE WHEN l_quantity = 7 THEN NULL ELSE l_discount <= CAST(5 AS DOUBLE) / CAST(100 AS DOUBLE) AND l_linestatus = 'F' END AS is_stable",
    "l_extendedprice AS energy", "CASE l_linenumber % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'completed' END AS validation_status",
    "CASE l_returnflag WHEN 'A' THEN 'novel' WHEN 'R' THEN 'known' END AS novelty_label", "l_tax AS e_above_hull", "l_orderkey % 50 AS spacegroup",
    "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
]
#: Total order of the rows of VAL; (orderkey, linenumber) alone is not unique.
VAL_ORDER = ["l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "validator", "candidate_id"]
VALIDATORS = ["A", "B", "C"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*CAND)


def val(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*VAL)


CAND_SQL = f"cand AS (SELECT {', '.join(CAND)} FROM part)"
VAL_SQL = f"val AS (SELECT {', '.join(VAL)} FROM lineitem)"
ORDER_SQL = ", ".join(VAL_ORDER)
LAST_SQL = f"last AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, validator ORDER BY {', '.join(c + ' DESC' for c in VAL_ORDER)}) AS rn FROM val) WHERE rn = 1)"
