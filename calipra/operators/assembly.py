"""Lines, measurements and candidates put together: provenance, review rows, batch items, boxes and orders of presentation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calipra.functions import fixed
from calipra.functions.text import canonical_line, char_count, is_filler_line, line_from_source, lookup, normalize_space

#: Readings of a line keep so many lines and characters.
TEXT_LINES, TEXT_CHARS = 3, 160
#: Units that make a text look like measurements, and representations and keywords of header fields that hold texts.
LOOKED_FOR_UNITS = ("mmhg", "m/s", "cm", "mm", "%", "ml")
TEXTUAL_KINDS, TEXT_KEYWORDS = ("LT", "ST", "UT"), ("TextValue", "ImageComments", "ContentDescription", "StudyDescription")


def _parts(*cols: Column) -> Column:
    """The columns that hold more than nothing, joined by blanks."""
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in cols])


def measurement_line(name: Column, value: Column, unit: Column) -> Column:
    """STR-33: the canonical line of a measurement."""
    return canonical_line(_parts(name, value, unit))


def exact_line_source(line: Column, confidence: Column, parser: Column) -> Column:
    """STR-33: exact_line:LINE:CONFIDENCE, and |parser=NAME where there is a parser."""
    tag = F.replace(F.trim(F.coalesce(parser, F.lit(""))), F.lit("|"), F.lit("/"))
    return F.concat(F.lit("exact_line:"), canonical_line(line), F.lit(":"), F.format_string("%.3f", confidence), F.when(tag != "", F.concat(F.lit("|parser="), tag)).otherwise(""))


def parser_of(source: Column) -> Column:
    """STR-33: the parser in a source, or nothing."""
    return F.trim(F.regexp_extract(F.coalesce(source, F.lit("")), r"(?s)^.*?\|parser=([^|]*)", 1))


def best_text_line(text: Column, name: Column, value: Column) -> Column:
    """STR-34: of a text's lines, the first with name and value, else the first with the value, else the first; the text without lines."""
    found = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: x != "")
    n, v = F.lower(F.trim(name)), F.lower(F.trim(value))
    both = F.filter(found, lambda x: F.lower(x).contains(n) & F.lower(x).contains(v))
    one = F.filter(found, lambda x: F.lower(x).contains(v))
    return F.coalesce(F.get(both, F.lit(0)), F.get(one, F.lit(0)), F.get(found, F.lit(0)), F.trim(text))


def label_text(source: Column, name: Column, value: Column, unit: Column) -> Column:
    """STR-41: what a label file says of a measurement: the line in its source, else name, value and unit."""
    own = F.nullif(canonical_line(line_from_source(source)), F.lit(""))
    return F.coalesce(own, canonical_line(_parts(*[normalize_space(c) for c in (name, value, unit)])))


def segmentation_text(text: Column) -> Column:
    """STR-43."""
    return F.lower(F.trim(canonical_line(text)))


def evaluation_unit(unit: Column) -> Column:
    """STR-45: a known unit without regard to case, else as it is; no spellings of readers; blank becomes null."""
    u = F.nullif(F.trim(unit), F.lit(""))
    return F.coalesce(lookup(F.lower(u), {x.lower(): x for x in fixed.UNITS}), u)


def text_lines(text: Column) -> Column:
    """SRT-10: the first lines of a reading that are no filler, else its first line; cut to a number of characters."""
    found = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: x != "")
    good = F.filter(found, lambda x: ~is_filler_line(x))
    chosen = F.when(F.size(good) > 0, F.slice(good, 1, TEXT_LINES)).otherwise(F.slice(found, 1, 1))
    return F.substring(F.trim(F.array_join(chosen, "\n")), 1, TEXT_CHARS)


def candidate(text: Column, confidence: Column, engine: Column, source: Column, view: Column) -> Column:
    """PRJ-5: what an engine returned, as a candidate."""
    return F.struct(text_lines(text).alias("text"), confidence.cast("double").alias("confidence"), engine.alias("engine_name"), view.alias("view_name"), source.alias("source"))


def annotated(text: Column, expected_chars: Column) -> Column:
    """PRJ-5: characters of a candidate's canonical line, those expected, and whether they agree (also where none are expected)."""
    n, want = char_count(text), F.coalesce(expected_chars, F.lit(0))
    return F.struct(want.alias("expected_char_count"), n.alias("line_ocr_char_count"), ((want <= 0) | (n == want)).alias("line_ocr_count_matches"))


def panel_tokens(lines: DataFrame, *panel: str) -> DataFrame:
    """PRJ-6: per panel, the tokens of each line's first candidate that has the line's source and engine, in order of lines. A panel has few lines."""
    own = F.filter("candidates", lambda c: (c["source"] == F.col("source")) & (c["engine_name"] == F.col("engine_name")))
    tokens = F.coalesce(F.get(own, F.lit(0))["tokens"], F.array().cast("array<string>"))
    gathered = lines.select(*panel, "line_order", tokens.alias("tokens")).groupBy(*panel).agg(F.sort_array(F.collect_list(F.struct("line_order", "tokens"))).alias("t"))
    return gathered.select(*panel, F.flatten(F.transform("t", lambda x: x["tokens"])).alias("tokens"))


def with_line_sources(measurements: DataFrame, lines: DataFrame, *panel: str, parser: str = "") -> DataFrame:
    """JON-2, STR-33: measurements (name, value, unit, order_hint, pos from 0) with the line that their hint, else their place, names.

    Adds source, line_text and line_order; without a line, the source holds the measurement itself, at confidence 0. Of lines with one order, the last is taken.
    """
    last = F.row_number().over(Window.partitionBy(*panel, "line_order").orderBy(F.desc("line_pos")))
    l = lines.withColumn("r", last).filter("r = 1").select(*panel, F.col("line_order").alias("at"), F.col("text").alias("line_text"), F.col("confidence").alias("line_confidence"))
    m = measurements.withColumn("at", F.coalesce("order_hint", "pos"))
    own = exact_line_source(_parts(F.col("name"), F.col("value"), F.col("unit")), F.lit(0.0), F.lit(parser))
    source = F.when(F.col("line_confidence").isNull(), own).otherwise(exact_line_source(F.col("line_text"), F.col("line_confidence"), F.lit(parser)))
    return m.join(l, [*panel, "at"], "left").withColumn("source", source).withColumn("line_order", F.when(F.col("line_confidence").isNotNull(), F.col("at")).otherwise(F.col("order_hint"))).drop("at", "line_confidence")


def review_rows(exact_lines: Column, measurements: Column) -> Column:
    """PRJ-7: a row for each exact line with text, its place as order; without any, the measurements (name, value, unit, source, order_hint)."""
    rows = F.transform(exact_lines, lambda x, i: F.struct(F.trim(x).alias("name"), F.lit("").alias("value"), F.lit(None).cast("string").alias("unit"), F.concat(F.lit("ocr_line:"), F.trim(x)).alias("source"), i.alias("order_hint")))
    rows = F.filter(rows, lambda r: r["name"] != "")
    return F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, rows).otherwise(measurements)


def companion_records(rows: DataFrame) -> DataFrame:
    """PRJ-1: measurements of reports and tags as records of frame 0, without a region."""
    zero = F.array(*[F.lit(0)] * 4)
    return rows.withColumns({"frame_index": F.lit(0), "roi_bbox": zero, "text_order": F.coalesce("order_hint", F.lit(0)), "parser_confidence": F.col("confidence")})


def batch_items(results: DataFrame, keep_flags: bool = False) -> DataFrame:
    """PRJ-3: results (path, measurements, lines, error) as items with status; flags and raw texts only if asked."""
    fields = ("name", "value", "unit", "source") + (("flags", "raw_ocr_text") if keep_flags else ())
    m = F.transform("measurements", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return results.select(F.col("path").alias("dicom_path"), F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), m.alias("measurements"), "lines", "error")


def frame_benchmarks(frames: DataFrame) -> DataFrame:
    """PRJ-2: a row a frame with times and counts; unknown ones are 0."""
    number = {"latency_ms": "double", "line_count": "int", "measurement_count": "int", "uncertain_line_count": "int", "fallback_invocations": "int"}
    return frames.select("path", "frame_index", "engine_name", *[(F.coalesce(F.col(c), F.lit(0)).cast(t) if c in frames.columns else F.lit(0).cast(t)).alias(c) for c, t in number.items()])


def cropped(box: Column, width: Column, height: Column) -> Column:
    """PRJ-8: a box (x, y, width, height) cut to the image, as x1, y1, x2, y2."""
    clamp = lambda v, low, high: F.greatest(low, F.least(v, high))
    x1, y1 = clamp(box[0], F.lit(0), width), clamp(box[1], F.lit(0), height)
    return F.struct(x1.alias("x1"), y1.alias("y1"), F.greatest(x1, F.least(box[0] + box[2], width)).alias("x2"), F.greatest(y1, F.least(box[1] + box[3], height)).alias("y2"))


def distinct_boxes(lines: DataFrame, *file: str, order: str = "line_order") -> DataFrame:
    """SET-7: the different regions of a file's lines that came from pixels, with the confidence of their first line."""
    box = [F.col("roi_bbox")[i].cast("double").alias(c) for i, c in enumerate(("x", "y", "width", "height"))]
    kind = F.coalesce(F.nullif(F.trim("source_kind"), F.lit("")), F.lit("pixel_ocr"))
    d = lines.filter((kind == "pixel_ocr") & (F.size("roi_bbox") == 4)).select(*file, order, "confidence", *box).filter("width > 0 and height > 0")
    first = F.min_by("confidence", order)
    return d.groupBy(*file, "x", "y", "width", "height").agg(first.alias("confidence"))


def in_reading_order(measurements: DataFrame, *file: str, then: str = "pos") -> DataFrame:
    """SRT-1: adds place, from 1: by frame, order of text, and the region's y and x; of equals, by then."""
    w = Window.partitionBy(*file).orderBy("frame_index", "text_order", F.col("roi_bbox")[1], F.col("roi_bbox")[0], then)
    return measurements.withColumn("place", F.row_number().over(w))


def labels_in_order(labels: DataFrame, with_split: bool = True) -> DataFrame:
    """SRT-2, and SNK-6 without split: label files by split, name and path."""
    return labels.orderBy(*(["split"] if with_split else []), "file_name", "file_path")


def items_in_order(items: DataFrame) -> DataFrame:
    """SRT-3: items by path, then status."""
    return items.orderBy("dicom_path", "status")


def first_frames(frames: DataFrame, parameter: int | None = None, config: int | None = None, environment: int | None = None) -> DataFrame:
    """SRT-4: frames before the limit that is named first: parameter, configuration, environment; none that is positive is no limit."""
    limit = next((x for x in (parameter, config, environment) if x is not None), 0)
    return frames.filter(F.col("frame_index") < limit) if limit > 0 else frames


def first_files(files: DataFrame, limit: int, key: str = "path") -> DataFrame:
    """SRT-5: the first files by path; a top-k, all where the limit isn't positive."""
    return files.orderBy(key).limit(limit) if limit > 0 else files.orderBy(key)


def looks_measured(text: Column) -> Column:
    """SRC-22: whether a text has a digit, a letter and a unit."""
    low = F.lower(text)
    units = F.lit(False)
    for u in LOOKED_FOR_UNITS:
        units = units | low.contains(u)
    return low.rlike(r"\p{Nd}") & low.rlike(r"\p{L}") & units


def textual_chunks(fields: Column) -> Column:
    """SRC-22: of header fields (keyword, vr, value), texts under telling keywords, and long texts that look like measurements."""
    told = lambda f: f["keyword"].isin(*TEXT_KEYWORDS)
    kept = F.filter(fields, lambda f: F.coalesce((F.trim(f["value"]) != "") & (told(f) | (f["vr"].isin(*TEXTUAL_KINDS) & looks_measured(F.trim(f["value"])))), F.lit(False)))
    return F.transform(kept, lambda f: F.trim(f["value"]))


def slice_text(chars: Column, space_after: Column) -> Column:
    """IMG-13: the text of a line's slices: each one's first character, and a blank where the line has a gap and a character follows."""
    clean = F.transform(chars, lambda c: F.substring(F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))), 1, 1))
    last = F.array_max(F.transform(clean, lambda c, i: F.when(c != "", i)))
    pieces = F.transform(clean, lambda c, i: F.concat(c, F.when(F.coalesce(F.get(space_after, i), F.lit(False)) & (i < last), " ").otherwise("")))
    return F.coalesce(F.trim(F.regexp_replace(F.array_join(pieces, ""), "  +", " ")), F.lit(""))


def sorted_tokens(tokens: Column) -> Column:
    """SRT-9: tokens (x, y, text) from top to bottom, then left to right."""
    return F.transform(F.array_sort(F.transform(tokens, lambda t, i: F.struct(t["y"].alias("y"), t["x"].alias("x"), i.alias("i"), t["text"].alias("text")))), lambda t: t["text"])


def utc_stamp(at: Column) -> Column:
    """DAT-1: a time as ISO text in UTC."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def sorted_distinct(values: Column) -> Column:
    """ARR-1: an array's different values in order, less nulls."""
    return F.array_sort(F.array_distinct(F.array_compact(values)))


def enriched(items: DataFrame, found: DataFrame, key: str = "dicom_path") -> DataFrame:
    """STM-10: items with measurements get what a second pass found for their path (found: key and extra); others have none."""
    positive = F.size("measurements") > 0
    return items.join(found.select(F.col(key), F.col("extra").alias("found")), key, "left").withColumn("extra", F.when(positive, F.col("found"))).drop("found")


def replayed(frames: DataFrame, cached: DataFrame, file: str = "file_name", order: str = "pos") -> DataFrame:
    """UDF-9: an engine that gives a file's cached results (place from 1, text) one after the other; beyond them, empty text."""
    at = F.row_number().over(Window.partitionBy(file).orderBy(order))
    return frames.withColumn("place", at).join(cached.select(file, "place", "text"), [file, "place"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def normalising(results: DataFrame) -> DataFrame:
    """UDF-10: an engine's results with the canonical form of each line of their text, blank ones left out."""
    made = F.filter(F.transform(F.split("text", "\n"), lambda x: canonical_line(x)), lambda x: x != "")
    return results.withColumn("text", F.array_join(made, "\n"))


def source_candidates(queries: DataFrame, files: DataFrame) -> DataFrame:
    """FLT-23: for each query (path, exam, study, rows, cols), files of its exam with several frames and the same size, or an unknown one; those of its study, if there are any."""
    f = files.filter("n_frames > 1").select("exam", F.col("path").alias("candidate"), F.col("study").alias("of_study"), F.col("rows").alias("r"), F.col("cols").alias("c"))
    fits = (F.col("r").isNull() | (F.col("r") == F.col("rows"))) & (F.col("c").isNull() | (F.col("c") == F.col("cols")))
    d = queries.join(f, "exam").filter((F.col("candidate") != F.col("path")) & F.coalesce(fits, F.lit(True)))
    same = F.coalesce(F.col("study") == F.col("of_study"), F.lit(False))
    any_same = F.max(same).over(Window.partitionBy("path"))
    return d.withColumn("same", same).withColumn("any_same", any_same).filter(F.col("same") | ~F.col("any_same")).select("path", "candidate", "same")


def companion_matches(cleaned: DataFrame, rows: DataFrame, file: str = "path") -> DataFrame:
    """JON-15: each cleaned measurement (pos, name, value, unit), in order, takes the companion row that is left and fits best: 2 for the name, 2 for the value, 1 for the unit, and its confidence; of equals the first.

    What is taken depends on what was before, so a file's few rows are gathered and matched in Python, many files to a batch.
    """
    gather = lambda d, name, *c: d.groupBy(file).agg(F.sort_array(F.collect_list(F.struct("pos", "name", "value", "unit", *c))).alias(name))

    def worth(a: dict, b: dict) -> float:
        return 2.0 * (a["name"] == b["name"]) + 2.0 * (a["value"] == b["value"]) + 1.0 * ((a["unit"] or "") == (b["unit"] or "")) + b["confidence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, taken, score = [], [], [], []
            for i, (wanted, free) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                free = free or []
                for w in wanted:
                    if not free:
                        break
                    k = max(range(len(free)), key=lambda j: (worth(w, free[j]), -j))
                    at.append(i)
                    pos.append(w["pos"])
                    score.append(worth(w, free[k]))
                    taken.append(free.pop(k)["pos"])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(pos, pa.int32()), pa.array(taken, pa.int32()), pa.array(score, pa.float64())], names=[file, "pos", "taken", "score"])

    kind = cleaned.schema[file].dataType.simpleString()
    return gather(cleaned, "w").join(gather(rows, "r", "confidence"), file, "left").mapInArrow(run, f"{file} {kind}, pos int, taken int, score double")
