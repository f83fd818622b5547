"""Lines from a blob of text without line ends: splitting at units, and dynamic programming over spans of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calipra.functions.parse import parse_canonical, with_parsed
from calipra.functions.text import canonical_line, has, let
from calipra.sources.scratch import written

_UNITISH = r"^(%|mmhg|cm/s|m/s|cm|mm|ms|s|bpm|ml/m2|cm2|ml|m/s2)$"


def starts_label(token: Column) -> Column:
    """Whether a token can begin a line: an integer, or letters that are no unit."""
    return ~has(token, _UNITISH, "iU") & (token.rlike(r"^\d+$") | has(token, r"\p{L}"))


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")


def spans(blobs: DataFrame, key: str = "blob_id") -> DataFrame:
    """A row for each blob (key, tokens): its tokens, and (start, end, canonical, parsed) of each span, all made by built-in expressions.

    Spans grow with the square of a blob's tokens, as any of them may be a line.
    """
    d = blobs.select(key, "tokens").filter(F.size("tokens") > 0)
    size = F.size("tokens")
    d = d.withColumn("start", F.explode(F.sequence(F.lit(0), size - 1))).withColumn("end", F.explode(F.sequence(F.col("start") + 1, size)))
    d = with_parsed(d.withColumn("line", F.array_join(F.slice("tokens", F.col("start") + 1, F.col("end") - F.col("start")), " ")), "line", "p")
    part = F.struct("start", "end", "canonical", F.col("p.label").isNotNull().alias("label"), F.col("p.value").isNotNull().alias("value"), F.col("p.unit").isNotNull().alias("unit"), F.col("p.prefix").isNotNull().alias("prefix"), F.col("p.confidence").alias("syntax"), has(F.col("canonical"), r"\p{L}").alias("letters"), has(F.col("canonical"), r"\d").alias("digits"))
    return d.groupBy(key, "tokens").agg(F.collect_list(part).alias("spans"))


def split_at_units(tokens: Column) -> Column:
    """STR-36: canonical lines of tokens, blank ones left out. A line ends where it has label and value and the next token can begin one, if it has a unit or the next is an integer.

    One walk over the tokens. A span is parsed only where it may have a value: letters of a to z, after two digits at most, have none.
    """
    at = lambda i: F.get(tokens, i)
    size = F.size(tokens)

    def ends(line: Column, i: Column) -> Column:
        p = lambda x: x["label"].isNotNull() & x["value"].isNotNull() & (x["unit"].isNotNull() | at(i).rlike(r"^\d+$"))
        return F.when(i == size, True).otherwise(let(parse_canonical(line), p))

    def step(acc: Column, i: Column) -> Column:
        last, first = at(i - 1), i - 1 == acc["start"]
        odd = acc["odd"] | ~last.rlike("^[A-Za-z]+$") & ~(first & last.rlike("^[0-9]{1,2}$"))
        going = lambda o: F.struct(acc["start"].alias("start"), o.alias("odd"), acc["lines"].alias("lines"))
        cut = lambda line: F.struct(i.alias("start"), F.lit(False).alias("odd"), F.when(line == "", acc["lines"]).otherwise(F.concat(acc["lines"], F.array(line))).alias("lines"))
        line = canonical_line(F.array_join(F.slice(tokens, acc["start"] + 1, i - acc["start"]), " "))
        asked = lambda o: F.when((i == size) | (o & starts_label(at(i))), let(line, lambda c: F.when(ends(c, i), cut(c)).otherwise(going(o)))).otherwise(going(o))
        return let(odd, asked)

    begin = F.struct(F.lit(0).alias("start"), F.lit(False).alias("odd"), F.array().cast("array<string>").alias("lines"))
    return F.when(size > 0, F.aggregate(F.sequence(F.lit(1), size), begin, step)["lines"]).otherwise(F.array().cast("array<string>"))


def _score(s: dict, expected: float, most: int, inner: int, last: bool) -> float:
    """The worth of a span as a line (weights are fixed values)."""
    n = s["end"] - s["start"]
    x = s["syntax"] * 12.0 + (2.5 if s["label"] else -2.5) + (3.0 if s["value"] else -2.5) + (1.0 if s["unit"] else 0.0) + (0.75 if s["prefix"] else 0.0)
    x += -0.45 * abs(n - expected) - 2.0 * max(0, n - most) - 2.25 * inner
    return x + (0.5 if s["letters"] else -3.0) + (0.5 if s["digits"] else -1.5) + (1.2 if last else 0.0) + (0.4 if s["start"] == 0 else 0.0)


def _segment(n: int, count: int, span: dict, ints: list[int]) -> tuple[float, list[tuple[int, int]]] | None:
    """SEQ-2: the best cut into so many lines."""
    expected = max(1.0, n / count)
    most = max(4, round(expected * 2.5))
    before = {0: (0.0, ())}
    for k in range(1, count + 1):
        now = {}
        for end in range(k, n - (count - k) + 1):
            best = None
            for start in range(max(k - 1, end - most), end):
                s = span.get((start, end))
                if start in before and s and s["canonical"]:
                    x = before[start][0] + _score(s, expected, most, ints[end] - ints[start + 1], end == n)
                    if best is None or x > best[0]:
                        best = (x, (*before[start][1], (start, end)))
            if best:
                now[end] = best
        before = now
    return before.get(n)


def recover_lines(blobs: DataFrame, key: str = "blob_id", text: str = "text", target: str = "target_line_count") -> DataFrame:
    """STR-35: key, lines, source. Lines that the text has are kept; else it is cut at units, else by the best average score of up to target lines.

    Cuts at units are made by built-in expressions, and so are the spans of blobs that have none, canonicalised and parsed; Python only runs the recurrence over these.
    """
    kind = blobs.schema[key].dataType.simpleString()
    once = lambda c: F.explode(F.array(c))  # noqa: E731  (computed once, see with_parsed)
    pieces = F.split(F.coalesce("text", F.lit("")), "\n")
    made = F.filter(F.transform(pieces, canonical_line), lambda x: x != "")
    d = blobs.select(key, F.col(text).alias("text"), F.col(target).cast("int").alias("target"))
    # the lines of a text of one line count only where one is wanted
    d = d.select("*", once(F.when((F.size(pieces) > 1) | F.coalesce(F.col("target") <= 1, F.lit(True)), made)).alias("own"))
    plain = (F.col("target") <= 0) | ((F.size("own") == F.col("target")) & (F.size("own") > 0))
    d = d.withColumn("source", F.when(F.coalesce(plain, F.lit(False)), "raw_newlines").when(F.size("own") >= 2, "raw_newlines_relaxed"))
    d = d.select("*", once(F.when(F.col("source").isNull(), tokens_of(F.col("text")))).alias("tokens"))
    d = d.select("*", once(F.when(F.col("source").isNotNull(), F.col("own")).otherwise(split_at_units(F.col("tokens")))).alias("lines"))
    d = written(d.withColumn("source", F.when(F.col("source").isNull() & (F.size("lines") > 1), "unit_boundary_split").otherwise(F.col("source"))), "cut-blobs")

    def batch_of(out: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.list_(pa.string())), pa.array(cols[2], pa.string())], names=[key, "lines", "source"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                tokens, n, most = b["tokens"], len(b["tokens"]), b["target"] or 0
                span = {(s["start"], s["end"]): s for s in b["spans"]}
                ints = [0]
                for t in tokens:
                    ints.append(ints[-1] + t.isdigit())
                best = None
                for count in range(1, min(most, n) + 1):
                    found = _segment(n, count, span, ints)
                    if found:
                        worth = found[0] / count
                        whole = span.get((0, n))
                        if count == 1 and whole and whole["label"] and whole["value"] and ints[n] - ints[1] == 0:
                            worth += 3.0
                        if best is None or worth > best[0]:
                            best = (worth, found[1])
                if best and n >= most:
                    out.append((b[key], [span[r]["canonical"] for r in best[1]], "dp_token_segmentation"))
                else:
                    out.append((b[key], b["own"], "fallback_raw_text"))
            yield batch_of(out, batch)

    left = d.filter("source is null").select(key, "target", "tokens", once(F.coalesce("own", made)).alias("own"))
    done = spans(left, key).join(left.select(key, "target", "own"), key).select(key, "tokens", "spans", "target", "own").mapInArrow(run, f"{key} {kind}, lines array<string>, source string")
    none = left.filter(F.size("tokens") == 0).select(key, F.col("own").alias("lines"), F.lit("fallback_raw_text").alias("source"))
    return d.filter("source is not null").select(key, "lines", "source").unionByName(done).unionByName(none)
