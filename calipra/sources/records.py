"""JSON and CSV records of labelling and evaluation runs as tables, and the same written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calipra.sources.scratch import written

# Version and task of label files.
LABEL_VERSION, LABEL_TASK = 1, "exact_roi_measurement_transcription"
#: Lines of a label file, which is one record, at most; and so many are aimed at where there are several.
MAX_LABELS, LABELS_A_FILE = 1_000_000, 50_000
#: Matches of a score file, which is one record.
SCORES_A_FILE = 20_000
LABELS = "version int, task string, files array<struct<file_name:string,file_path:string,split:string,measurements:array<struct<order:string,text:string>>>>"
SCORES = "file_details array<struct<file_name:string,split:string,matches:array<struct<expected_text:string,predicted_text:string,full_match:boolean,line_match:boolean,label_match:boolean,value_match:boolean,unit_match:boolean,prefix_match:boolean>>>>"
ITEM = "dicom_path string, status string, measurements array<struct<name:string,value:string,unit:string,source:string>>, line_predictions array<struct<`order`:int,text:string,manual_verify_required:boolean,fallback_trigger_reason:string,line_ocr_count_matches:boolean,review_status:string>>, source struct<dicomid:string,frame:int>, metadata map<string,string>, error struct<type:string,message:string>"


def read_labels(spark: SparkSession, path: str, strict_order: bool = False) -> DataFrame:
    """SRC-11, SRC-30: file_name, file_path, split, pos, line_order, text of label files. A wrong version, task, or a file without split is an error.

    Orders that are no integers become null, or drop their rows if strict; blank texts drop out and leave gaps in pos.
    """
    d = spark.read.schema(LABELS).option("multiLine", True).json(path)
    good = (F.col("version") == LABEL_VERSION) & (F.col("task") == LABEL_TASK) & F.col("files").isNotNull()
    d = d.withColumn("files", F.when(F.coalesce(good, F.lit(False)), F.col("files")).otherwise(F.raise_error(F.lit("not a label file of a known version and task")).cast("array<struct<file_name:string,file_path:string,split:string,measurements:array<struct<order:string,text:string>>>>")))
    d = d.select(F.explode("files").alias("f")).select("f.*")
    split = F.lower(F.trim("split"))
    d = d.withColumn("split", F.when(F.coalesce(split, F.lit("")) != "", split).otherwise(F.raise_error(F.concat(F.lit("no split: "), F.col("file_name"))).cast("string")))
    d = d.select("file_name", "file_path", "split", F.posexplode("measurements").alias("pos", "m")).select("file_name", "file_path", "split", (F.col("pos") + 1).alias("pos"), F.col("m.order").try_cast("int").alias("line_order"), F.trim("m.text").alias("text"))
    d = d.filter("text <> ''")
    return d.filter("line_order is not null") if strict_order else d


def write_labels(lines: DataFrame, path: str) -> None:
    """SNK-5's file: one JSON record of all files, sorted by split, name and path. More lines than MAX_LABELS are several such records, each of a range of files.

    read_labels() reads them all. A file of more lines than MAX_LABELS by itself is refused, as it fits no record.
    """
    by = ("split", "file_name", "file_path")
    n, most = lines.groupBy(*by).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if most > MAX_LABELS:
        raise ValueError(f"a file of more than {MAX_LABELS} lines fits no label file")
    m = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: F.struct(x["pos"].cast("string").alias("order"), x["text"].alias("text")))
    record = F.sort_array(F.collect_list(F.struct(*by, "measurements"))).alias("files")
    if n <= MAX_LABELS:
        records = lines.groupBy(*by).agg(m.alias("measurements")).agg(record).coalesce(1)
    else:
        ranges = lines.repartitionByRange(n // min(LABELS_A_FILE, MAX_LABELS) + 1, *by)  # a file's lines are in one range
        records = ranges.groupBy(F.spark_partition_id().alias("part"), *by).agg(m.alias("measurements")).groupBy("part").agg(record)
    records.select(F.lit(LABEL_VERSION).alias("version"), F.lit(LABEL_TASK).alias("task"), "files").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def upsert(old: DataFrame, new: DataFrame, key: str = "file_path", version: str = "version") -> DataFrame:
    """SNK-5: rows of new and old, the latest version of each key."""
    both = old.unionByName(new)
    latest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    return both.withColumn("r", latest).filter("r = 1").drop("r")


def write_scores(files: DataFrame, path: str) -> None:
    """SRC-13's files: file_name, split and matches of files as records of SCORES_A_FILE matches or so; a file's matches stay together, and are few.

    A record is gathered in memory, so as many partitions as records are asked for: a number that is given is not made smaller, whatever Spark thinks of their size.
    """
    files = written(files.select("file_name", "split", "matches"), "score-files")
    n = files.agg(F.coalesce(F.sum(F.size("matches")), F.lit(0))).first()[0] // SCORES_A_FILE + 1
    part = F.pmod(F.xxhash64("file_name"), F.lit(n)).alias("part")
    d = files.select(part, F.struct("file_name", "split", "matches").alias("d")).repartition(n, "part")
    d.groupBy("part").agg(F.collect_list("d").alias("file_details")).drop("part").write.option("maxRecordsPerFile", 1).json(path)


def read_scores(spark: SparkSession, path: str, mismatches: bool = True) -> DataFrame:
    """SRC-13: a row a match of score files; exact ones only, if mismatches aren't wanted."""
    d = spark.read.schema(SCORES).option("multiLine", True).json(path).select(F.explode("file_details").alias("f"))
    d = d.select(F.col("f.file_name").alias("file_name"), F.col("f.split").alias("split"), F.posexplode("f.matches").alias("line_index", "m")).select("file_name", "split", "line_index", "m.*")
    return d if mismatches else d.filter("full_match")


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15: failure tables whose columns have one of several names."""
    d = spark.read.option("header", True).csv(path)
    some = lambda *names: F.coalesce(*[F.col(n) for n in names if n in d.columns], F.lit(None).cast("string"))
    return d.select(some("file_name", "file", "path").alias("file_name"), some("expected_text", "expected", "label").alias("expected_text"), some("predicted_text", "predicted", "actual").alias("predicted_text")).filter("expected_text is not null")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """SRC-16 to SRC-18: batch items of a checkpoint, one JSON object a line. A line that is no JSON is read with its backslashes doubled; what is none then is left out."""
    read = lambda c: F.from_json(c, ITEM + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    d = spark.read.text(path).select(read(F.col("value")).alias("x"), "value")
    twice = F.when(F.col("x._corrupt").isNotNull(), read(F.replace("value", F.lit("\\"), F.lit("\\\\")))).otherwise(F.col("x"))
    return d.select(twice.alias("x")).filter("x._corrupt is null").select("x.*").drop("_corrupt").filter("dicom_path is not null")


def append_items(items: DataFrame, path: str) -> None:
    """SNK-4: adds a batch of items to a checkpoint, one JSON object a line; read_items() reads all batches."""
    items.write.mode("append").json(path)


def pending(files: DataFrame, done: DataFrame, retry_errors: bool = False) -> DataFrame:
    """JON-10: files that no item has; with retry_errors, those of failed items as well."""
    kept = done.filter("error is null") if retry_errors else done
    return files.join(kept.select(F.col("dicom_path").alias("path")), "path", "left_anti")


def in_scope(items: DataFrame, files: DataFrame) -> DataFrame:
    """JON-11: items of a checkpoint whose file was found again."""
    return items.join(files.select(F.col("path").alias("dicom_path")), "dicom_path", "left_semi")


def normal_lines(lines: Column) -> Column:
    """FLT-19: lines with text, numbered from 1 where they have no order."""
    numbered = F.transform(lines, lambda x, i: F.struct(F.coalesce(x["order"], i + 1).alias("order"), F.trim(x["text"]).alias("text")))
    return F.filter(numbered, lambda x: F.coalesce(x["text"], F.lit("")) != "")


def flat_items(items: DataFrame) -> DataFrame:
    """SNK-2: a row a measurement, and one with blanks for an item without."""
    return items.select("dicom_path", "status", F.explode_outer("measurements").alias("m"), F.col("error.message").alias("error")).select("dicom_path", "status", F.coalesce("m.name", F.lit("")).alias("name"), F.coalesce("m.value", F.lit("")).alias("value"), F.coalesce("m.unit", F.lit("")).alias("unit"), F.coalesce("m.source", F.lit("")).alias("source"), F.coalesce("error", F.lit("")).alias("error"))


def nested(items: DataFrame) -> DataFrame:
    """SNK-3, AGG-26: a row a patient, with exams and their items as arrays of structs; keys sorted. Bounded by a patient's files."""
    exam = items.groupBy("patient", "exam").agg(F.sort_array(F.collect_list(F.struct("dicom_path", "status", "lines"))).alias("dicoms"))
    return exam.groupBy("patient").agg(F.sort_array(F.collect_list(F.struct("exam", "dicoms"))).alias("exams"))


def write_sidecars(records: DataFrame, path: str) -> None:
    """SNK-1: records of each study as CSV and JSON lines, in folders by study; nothing is written where there is nothing."""
    if records.isEmpty():
        return
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in records.dtypes]
    records.write.mode("append").partitionBy("study_uid").json(f"{path}/jsonl")
    records.select(*flat).write.mode("append").option("header", True).partitionBy("study_uid").csv(f"{path}/csv")


def append_log(spark: SparkSession, path: str, **entry: object) -> None:
    """SNK-10, STM-11: appends an entry with its time."""
    d = spark.createDataFrame([{k: str(v) for k, v in entry.items() if v is not None}])
    d.withColumn("timestamp_utc", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")).coalesce(1).write.mode("append").json(path)


def loose_json(text: Column) -> Column:
    """JSN-1 and JSN-2: rows (order, name, value, unit) of the outermost array in a text, else of the outermost object's measurements, else none. What is no row is left out."""
    row = "struct<`order`:int,name:string,value:string,unit:string>"
    array = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    single = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    each = F.coalesce(F.from_json(F.nullif(array, F.lit("")), "array<string>"), F.from_json(F.nullif(single, F.lit("")), "struct<measurements:array<string>>")["measurements"], F.array().cast("array<string>"))
    return F.filter(F.transform(each, lambda x: F.from_json(x, row)), lambda r: r["name"].isNotNull() | r["value"].isNotNull())


def reply_measurements(text: Column) -> Column:
    """JSN-3: rows of a reply, with orders from 0; without order, the place."""
    return F.transform(loose_json(text), lambda r, i: F.struct(F.coalesce(r["order"] - 1, i).alias("order_hint"), r["name"].alias("name"), r["value"].alias("value"), r["unit"].alias("unit")))
