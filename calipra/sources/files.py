"""Files as rows: discovery, allow-lists, paths that have moved, and labels matched to files on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def discover(spark: SparkSession, root: str, pattern: str = "*.dcm", recursive: bool = True, any_case: bool = False) -> DataFrame:
    """SRC-1 to SRC-4: path, name, length and modification time of files, content unread. With any_case, names match without regard to case.

    Only metadata columns of the binary source are used, so that Spark prunes the content.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if not any_case:
        reader = reader.option("pathGlobFilter", pattern)
    d = reader.load(root).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime")
    if any_case:
        regex = "".join(".*" if c == "*" else "." if c == "?" else f"\\Q{c}\\E" for c in pattern)
        d = d.filter(F.col("name").rlike(f"(?i)^{regex}$"))
    return d


def allow_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-20: lines of a text file less blanks and comments."""
    d = spark.read.text(path).select(F.trim("value").alias("path"))
    return d.filter((F.col("path") != "") & ~F.col("path").startswith("#")).distinct()


def restrict(files: DataFrame, *lists: DataFrame) -> DataFrame:
    """FLT-15, SET-2: files that all lists have."""
    for other in lists:
        files = files.join(other.select("path").distinct(), "path", "left_semi")
    return files


def newest(files: DataFrame, n: int) -> DataFrame:
    """SRC-14: the n files modified last; a top-k, not a sort of all."""
    return files.orderBy(F.desc("modificationTime"), "path").limit(n)


def path_ids(path: Column) -> Column:
    """STR-39: patient and exam from a path's last folders."""
    p = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    return F.struct(F.coalesce(F.try_element_at(p, F.lit(-3)), F.lit("unknown")).alias("patient"), F.coalesce(F.try_element_at(p, F.lit(-2)), F.lit("unknown")).alias("exam"))


def reroot(path: Column, roots: dict[str, str]) -> Column:
    """SRC-25: a path whose beginning is one of roots' keys, with its value instead; drive letters and backslashes are unified first."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^[A-Za-z]:", "")
    out = p
    for old, new in sorted(roots.items(), key=lambda kv: len(kv[0])):
        out = F.when(p.startswith(old), F.concat(F.lit(new), F.substring(p, len(old) + 1, 100_000))).otherwise(out)
    return out


def match_labels(labels: DataFrame, files: DataFrame) -> DataFrame:
    """SRC-26, JON-17: each label path with the file of the same name whose path has the longest tail in common; null where no file has the name.

    Of each tail that files have, one aggregate keeps the first path; a label meets its own tails, and the longest that is there wins.
    So labels and files of one name, however many, form no pairs.
    """

    def tails(d: DataFrame, path: str) -> DataFrame:
        p = F.split(F.regexp_replace(path, r"\\", "/"), "/")
        n = F.size(p)
        return d.select(path, F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("n"), F.array_join(F.slice(p, n - k + 1, k), "/").alias("tail")))).alias("t")).select(path, "t.*")

    a = labels.select(F.col("path").alias("label_path")).distinct()
    b = files.select(F.col("path").alias("file_path")).filter("file_path is not null").distinct()
    first = tails(b, "file_path").groupBy("tail").agg(F.min("file_path").alias("file_path"))  # a tail's parts are those between its slashes
    best = tails(a.filter("label_path is not null"), "label_path").join(first, "tail").groupBy("label_path").agg(F.max_by("file_path", "n").alias("file_path"))
    return a.join(best, "label_path", "left").select("label_path", "file_path")
