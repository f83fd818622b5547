"""Structured reports: trees of content items as rows, units in their spellings, and companions of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calipra.functions.parse import with_parsed
from calipra.functions.text import let, lookup, normalize_space

# Units as reports write them.
REPORT_UNITS = {
    "%": "%", "percent": "%", "mm[hg]": "mmHg", "mmhg": "mmHg", "mm hg": "mmHg", "cm": "cm", "centimeter": "cm", "mm": "mm", "millimeter": "mm", "m/s": "m/s", "meter per second": "m/s",
    "cm/s": "cm/s", "centimeter per second": "cm/s", "ml": "ml", "milliliter": "ml", "ms": "ms", "millisecond": "ms", "s": "s", "second": "s", "cm2": "cm2", "square centimeter": "cm2",
    "ml/m2": "ml/m2", "m/s2": "m/s2", "bpm": "bpm", "{h.b}/min": "bpm", "beats per minute": "bpm", "1": "",
}
#: Confidence of numeric items and of lines read from text; files compared as companions; modalities whose text is read.
NUMERIC, TEXTUAL, COMPANIONS = 0.995, 0.94, 256
TEXT_MODALITIES = ("DOC", "OT", "PR", "SR")


def report_unit(code: Column) -> Column:
    """STR-37."""
    return let(F.trim(code), lambda u: F.nullif(F.coalesce(lookup(F.lower(u), REPORT_UNITS), u), F.lit("")))


def walk(reports: DataFrame, key: str = "path", content: str = "content", depth: int = 8) -> DataFrame:
    """SRC-21: key, order_path, value_type, concept, numeric_value, unit, text of all items of trees kept as JSON (content: an array of items with children).

    Levels are taken off one by one, by built-in functions; a tree deeper than depth is an error, not cut.
    """
    item = "value_type string, concept string, numeric_value string, unit_code string, text string, children string"
    schema = f"array<struct<{item.replace(' string', ':string')}>>"
    level = reports.select(key, F.array().cast("array<int>").alias("order_path"), F.col(content).alias("children"))
    out = None
    for k in range(depth + 1):
        rows = level.filter("children is not null").select(key, "order_path", F.posexplode(F.from_json("children", schema)).alias("at", "i"))
        rows = rows.select(key, F.array_append("order_path", F.col("at")).alias("order_path"), "i.*")
        if k == depth:
            rows = rows.withColumn("value_type", F.raise_error(F.concat(F.lit(f"a report is deeper than {depth}: "), F.coalesce("value_type", F.lit("?")))).cast("string"))
        level = rows.select(key, "order_path", "children")
        found = rows.select(key, "order_path", "value_type", "concept", "numeric_value", "unit_code", "text")
        out = found if out is None else out.unionByName(found)
    return out


def measurements(items: DataFrame, key: str = "path") -> DataFrame:
    """SRC-21, SRC-28: key, order_path, name, value, unit, confidence: numeric items, and text items that parse; a file's texts only where it has no numbers."""
    number = items.filter(F.upper("value_type") == "NUM").select(key, "order_path", normalize_space(F.col("concept")).alias("name"), F.trim("numeric_value").alias("value"), report_unit(F.col("unit_code")).alias("unit"), F.lit(NUMERIC).alias("confidence")).filter("name <> '' and value <> ''")
    text = items.filter(F.upper("value_type") == "TEXT").withColumn("line", F.concat_ws(" ", "concept", "text"))
    text = with_parsed(text, "line", "p").filter("p.is_measurement")
    text = text.select(key, "order_path", F.col("p.display_name").alias("name"), F.col("p.value").alias("value"), F.col("p.unit").alias("unit"), F.lit(TEXTUAL).alias("confidence"))
    return number.unionByName(text.join(number.select(key).distinct(), key, "left_anti"))


def companions(files: DataFrame, limit: int = COMPANIONS) -> DataFrame:
    """JON-8: path and companion: the other files of its study, the first limit by path, as the definition asks. Studies without a uid have none."""
    f = files.filter("study_uid is not null and study_uid <> ''").select("study_uid", "path")
    pairs = f.join(f.withColumnRenamed("path", "companion"), "study_uid").filter(F.col("path") != F.col("companion"))
    r = F.row_number().over(Window.partitionBy("path").orderBy("companion"))
    return pairs.withColumn("r", r).filter(F.col("r") <= limit).select("study_uid", "path", "companion")
