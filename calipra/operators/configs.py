"""Configurations of runs as tables: factorials with pruning, selection by name, and runs of all files under all configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words for the levels of the factors.
RECIPES = {"plain": "pln", "pln": "pln", "p": "pln", "unsharp": "ush", "ush": "ush", "u": "ush"}
BINS = {"none": "nbin", "off": "nbin", "nbin": "nbin", "no": "nbin", "otsu": "otsu", "bin": "otsu"}
ORDERS = {"st": "scale_then_threshold", "scale_then_threshold": "scale_then_threshold", "ts": "threshold_then_scale", "threshold_then_scale": "threshold_then_scale"}


def _levels(d: DataFrame, name: str, given: list, known: dict | None = None) -> DataFrame:
    """Each row of d once for each level of a factor, with its place; levels come once, in the order given, and unknown ones are left out."""
    found = list(dict.fromkeys(known[g] if known else g for g in given if known is None or g in known))
    return d.select("*", F.posexplode(F.array(*map(F.lit, found)) if found else F.array().cast("array<string>")).alias(f"{name}_i", name))


def factorial(spark: SparkSession, scales: list[int], bins: list[str], orders: list[str], recipes: list[str], inputs: list[str], multiview: list[str] = ("none",), scale_algo: str = "lanczos", binary_scale_algo: str = "nearest", morph_close: bool = True, bin_at_1x: bool = False) -> DataFrame:
    """JON-14: name and settings of all combinations: without threshold one order is enough, and a threshold at 1x is left out unless asked for.

    Six short lists, exploded from one row: a few hundred rows, and no join.
    """
    d = _levels(spark.range(1), "multiview", [m for m in multiview if m in ("none", "pipeline")] or ["none"])
    d = _levels(d, "input_mode", [i for i in inputs if i in ("gray", "bgr")])
    d = _levels(d, "recipe", recipes, RECIPES)
    d = _levels(d, "scale", [s for s in scales if 1 <= s <= 6])
    d = _levels(d, "bin", bins, BINS)
    d = _levels(d, "preprocess_order", orders, ORDERS)
    d = d.filter((F.col("bin") == "otsu") | (F.col("preprocess_order_i") == 0)).filter((F.col("bin") == "nbin") | (F.col("scale") > 1) | F.lit(bin_at_1x))
    d = d.withColumn("preprocess_order", F.when(F.col("bin") == "nbin", "scale_then_threshold").otherwise(F.col("preprocess_order"))).withColumn("morph_close", (F.col("bin") == "otsu") & F.lit(morph_close))
    name = F.concat_ws("_", F.lit("om"), "input_mode", "recipe", F.concat(F.lit("s"), "scale"), "bin", F.when(F.col("preprocess_order") == "scale_then_threshold", "st").otherwise("ts"), F.when(F.col("bin") == "otsu", F.when(F.col("morph_close"), "mc").otherwise("nm")), F.when(F.col("multiview") == "none", "mv0").otherwise("mv1"))
    return d.select(name.alias("name"), "input_mode", "recipe", "scale", F.lit(scale_algo).alias("scale_algo"), F.when(F.col("bin") == "otsu", "otsu").otherwise("none").alias("threshold_mode"), "preprocess_order", "morph_close", F.lit(binary_scale_algo).alias("binary_scale_algo"), "multiview")


def plan_configs(spark: SparkSession) -> DataFrame:
    """CFG-1, the plan of eight: no threshold, threshold after scaling, and before it, at 1x and at 3x by two ways of scaling."""
    rows = [(f"plan_{k}_{s}", s.split("_")[0], s.split("_")[1] if "_" in s else "lanczos", t, o) for k, t, o, sizes in (("no_binarize", "none", "scale_then_threshold", ("1x", "3x_lanczos", "3x_cubic")), ("scale_then_otsu", "otsu", "scale_then_threshold", ("1x", "3x_lanczos", "3x_cubic")), ("otsu_then_scale", "otsu", "threshold_then_scale", ("3x_lanczos", "3x_cubic"))) for s in sizes]
    d = spark.createDataFrame(rows, "name string, scale string, scale_algo string, threshold_mode string, preprocess_order string")
    return d.withColumn("scale", F.regexp_extract("scale", r"\d", 0).cast("int")).withColumn("input_mode", F.lit("gray"))


def select_configs(configs: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """FLT-16."""
    d = configs.filter(F.col("name").isin(*include)) if include else configs
    return d.filter(~F.col("name").isin(*exclude)) if exclude else d


def with_defaults(rows: DataFrame, column: str = "spec") -> DataFrame:
    """SRC-19: settings from JSON: unknown keys are passed over, missing ones have their default."""
    d = rows.withColumn("s", F.from_json(column, "contrast_mode string, scale_factor int, scale_algo string, unsharp boolean, threshold_mode string, morph_close boolean, smooth boolean, input_mode string, preprocess_order string"))
    default = {"contrast_mode": "none", "scale_factor": 1, "scale_algo": "lanczos", "unsharp": False, "threshold_mode": "none", "morph_close": False, "smooth": False, "input_mode": "gray", "preprocess_order": "scale_then_threshold"}
    return d.select(*[c for c in rows.columns if c != column], *[F.coalesce(F.col(f"s.{k}"), F.lit(v)).alias(k) for k, v in default.items()])


def runs(files: DataFrame, configs: DataFrame) -> DataFrame:
    """JON-12, JON-13: each file under each configuration; configurations are few and broadcast."""
    return files.crossJoin(F.broadcast(configs))


def as_bool(text: str | None, default: bool = False) -> bool:
    """NUM-7."""
    return default if text is None or not str(text).strip() else str(text).strip().lower() in {"1", "true", "yes", "on"}
