"""Lexicon statistics of parsed lines, as tables rather than maps: counts, value ranges, transitions, exemplars, preferred units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calipra.functions.parse import line_pattern


def _weight(lines: DataFrame) -> list[str]:
    """Lines may be given once with the number of times that they occur (weight); without that column each row is one line."""
    return ["weight"] if "weight" in lines.columns else []


def _count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum("weight") if _weight(df) else F.count(F.lit(1))).alias("n"))


def of_splits(lines: DataFrame, *splits: str) -> DataFrame:
    """FLT-1: lines of the named splits; of all, if none is named. A lexicon that is to judge a split is built without it."""
    names = [s.strip().lower() for s in splits if s.strip()]
    return lines.filter(F.lower(F.trim("split")).isin(names)) if names else lines


def split_counts(lines: DataFrame) -> DataFrame:
    return _count(lines.filter("canonical <> ''"), "split")


def exact_line_counts(lines: DataFrame) -> DataFrame:
    return _count(lines.filter("canonical <> ''"), "canonical")


def family_counts(lines: DataFrame) -> DataFrame:
    return _count(lines.select(F.col("parsed.family").alias("family"), *_weight(lines)).filter("family <> ''"), "family")


def token_counts(lines: DataFrame) -> DataFrame:
    """AGG-5: words of labels."""
    words = lines.filter("parsed.label is not null").select(F.explode(F.split(F.lower("parsed.label"), " ")).alias("token"), *_weight(lines))
    return _count(words.filter("token <> ''"), "token")


def unit_counts(lines: DataFrame) -> DataFrame:
    return _count(lines.select(F.col("parsed.unit").alias("unit"), *_weight(lines)).filter("unit is not null"), "unit")


def prefix_counts(lines: DataFrame) -> DataFrame:
    return _count(lines.select(F.col("parsed.prefix").alias("prefix"), *_weight(lines)).filter("prefix is not null"), "prefix")


def pattern_counts(lines: DataFrame) -> DataFrame:
    return _count(lines.filter("canonical <> ''").select(line_pattern(F.col("parsed")).alias("pattern"), *_weight(lines)), "pattern")


def family_units(lines: DataFrame) -> DataFrame:
    """AGG-2."""
    return _count(lines.select(F.col("parsed.family").alias("family"), F.col("parsed.unit").alias("unit"), *_weight(lines)).filter("family <> '' and unit is not null"), "family", "unit")


def family_orders(lines: DataFrame) -> DataFrame:
    """AGG-2, with orders as text."""
    return _count(lines.select(F.col("parsed.family").alias("family"), F.col("pos").cast("string").alias("line_order"), *_weight(lines)).filter("family <> ''"), "family", "line_order")


def value_stats(lines: DataFrame, *by: str) -> DataFrame:
    """AGG-3: count, min, max and mean of numeric values of a family (and unit). The mean is rounded, as sums of doubles depend on order."""
    d = lines.filter("parsed.is_measurement").select(F.col("parsed.family").alias("family"), F.col("parsed.unit").alias("unit"), F.col("parsed.value").try_cast("double").alias("v"), *_weight(lines))
    n, mean = (F.sum("weight"), F.sum(F.col("v") * F.col("weight")) / F.sum("weight")) if _weight(lines) else (F.count("v"), F.avg("v"))
    return d.filter("v is not null").groupBy("family", *by).agg(n.alias("n"), F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.round(mean, 6).alias("mean_value"))


def exemplars(lines: DataFrame) -> DataFrame:
    """AGG-4: of each family its number of different lines and the least one."""
    d = lines.select(F.col("parsed.family").alias("family"), "canonical").filter("family <> ''")
    return d.groupBy("family").agg(F.countDistinct("canonical").alias("n_lines"), F.min("canonical").alias("exemplar"))


def transitions(lines: DataFrame) -> DataFrame:
    """AGG-6, WIN-1: how often a family follows another in a file."""
    order = Window.partitionBy("split", "file_name").orderBy("pos")
    d = lines.filter("canonical <> ''").select("split", "file_name", "pos", F.col("parsed.family").alias("next_family"))
    d = d.withColumn("family", F.lag("next_family").over(order)).filter("family <> '' and next_family <> ''")
    return _count(d, "family", "next_family")


def preferred_units(lines: DataFrame) -> DataFrame:
    """AGG-7: each family's most frequent unit; of equals the least."""
    best = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("n"), "unit"))
    return family_units(lines).withColumn("r", best).filter("r = 1").drop("r")


def save(tables: dict[str, DataFrame], path: str) -> None:
    """SNK-7: the lexicon's tables as Parquet, a folder each."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/table={name}")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SRC-12: the tables of a saved lexicon by name."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    names = sorted(f.getPath().getName().removeprefix("table=") for f in found if f.getPath().getName().startswith("table="))
    return {n: spark.read.parquet(f"{path}/table={n}") for n in names}


class Cached:
    """STM-5: a saved lexicon, loaded when asked for and again only when its files have changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.stamp, self.tables = spark, path, None, {}

    def get(self) -> dict[str, DataFrame]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        stamp = max(((f.getModificationTime(), f.getPath().getName()) for f in fs.listStatus(root)), default=None)
        if stamp != self.stamp:
            self.stamp, self.tables = stamp, load(self.spark, self.path)
        return self.tables
