"""Measurement lines derived from the driver's tables, and the same in SQL. Both give the same rows at every size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calipra.functions import fixed

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled lines (file_name, split, pos, prefix, label, value, unit, text) and what an engine made of them (pred_text, confidence, engine_name, corruption).

    A file is an order, so a window sorts an order's few lines. Parts are small and meet by a hash join, broadcast only if Spark finds them small.
    """
    l, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    d = l.withColumn("pos", pos).join(p, F.col("l_partkey") == F.col("p_partkey"))
    number = F.col("l_quantity").cast("decimal(10,1)")
    unit = F.element_at(F.array(*map(F.lit, fixed.UNITS)), 1 + F.col("p_size") % 13)
    d = d.select(
        F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("file_name"),
        F.when(F.col("l_orderkey") % 5 == 0, "validation").otherwise("train").alias("split"), "pos",
        F.when((F.col("pos") % 3 == 1) & (F.col("pos") < 100), F.col("pos").cast("string")).alias("prefix"),
        F.concat_ws(" ", "p_type", "p_name").alias("label"), number.cast("string").alias("value"), unit.alias("unit"),
        (number * 10).cast("decimal(12,1)").cast("string").alias("tenfold"), (F.col("l_partkey") % 10).cast("int").alias("corruption"),
        (1 - F.col("l_discount")).alias("confidence"), F.col("l_returnflag").alias("engine_name"),
    )
    wrong_unit = F.when(F.col("unit") == "cm", "em").when(F.col("unit") == "mmHg", "mhg").when(F.col("unit") == "m/s", "mis").otherwise(F.col("unit"))
    join = lambda *c: F.concat_ws(" ", *c)
    c = F.col("corruption")
    pred = (
        F.when(c == 0, join("prefix", "label", "value", wrong_unit)).when(c == 1, join("prefix", "label", "tenfold", "unit")).when(c == 2, join("prefix", "label", "value"))
        .when(c == 3, join("prefix", F.lower("label"), "value", "unit")).when(c == 4, join("prefix", "label", F.concat("value", "unit")))
        .when(c == 5, join("prefix", "label", "value", "unit", F.lit("____"))).otherwise(join("prefix", "label", "value", "unit"))
    )
    return d.withColumn("text", join("prefix", "label", "value", "unit")).withColumn("pred_text", pred).drop("tenfold")


_UNITS = ", ".join(f"'{u}'" for u in fixed.UNITS)
#: WITH clauses: meas has the columns of lines(); got has what the prediction reads as (g_label, g_value, g_unit, g_text).
SQL_LINES = f"""
base AS (
  SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS pos FROM lineitem l),
meas AS (
  SELECT 'f' || l_orderkey AS file_name, CASE WHEN l_orderkey % 5 = 0 THEN 'validation' ELSE 'train' END AS split, CAST(pos AS INTEGER) AS pos,
    CASE WHEN pos % 3 = 1 AND pos < 100 THEN CAST(pos AS VARCHAR) END AS prefix, p_type || ' ' || p_name AS label,
    CAST(CAST(l_quantity AS DECIMAL(10,1)) AS VARCHAR) AS value, CAST(CAST(CAST(l_quantity AS DECIMAL(10,1)) * 10 AS DECIMAL(12,1)) AS VARCHAR) AS tenfold,
    ([{_UNITS}])[CAST(1 + p_size % 13 AS INTEGER)] AS unit, CAST(l_partkey % 10 AS INTEGER) AS corruption, 1 - l_discount AS confidence, l_returnflag AS engine_name
  FROM base JOIN part ON l_partkey = p_partkey),
got AS (
  SELECT *, concat_ws(' ', prefix, label, value, unit) AS text,
    CASE WHEN corruption = 3 THEN lower(label) ELSE label END AS g_label, CASE WHEN corruption = 1 THEN tenfold ELSE value END AS g_value,
    CASE WHEN corruption = 2 THEN NULL ELSE unit END AS g_unit,
    concat_ws(' ', prefix, CASE WHEN corruption = 3 THEN lower(label) ELSE label END, CASE WHEN corruption = 1 THEN tenfold ELSE value END, CASE WHEN corruption = 2 THEN NULL ELSE unit END) AS g_text
  FROM meas)"""
