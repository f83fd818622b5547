"""Parsing of measurement lines into prefix, label, value and unit, with built-in expressions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calipra.functions import fixed
from calipra.functions.text import NUMBER, canonical_line, family_key, has, let, normalize_space, normalize_unit, normalize_value

_LETTER = r"[A-Za-z%]"


def parse_canonical(canonical: Column) -> Column:
    """STR-10 on a canonical line: struct of prefix, label, value, unit, confidence, reasons, is_measurement, display_name, family.

    A line's numbers split it; the last number that no letter touches and that has a letter before it is the value. All after it
    is the unit, known or not. A value alone has its text as label too.
    """
    numbered = has(canonical, r"^\d{1,2}\s+.*[A-Za-z]")
    prefix = F.when(numbered, F.regexp_extract(canonical, r"(?U)^(\d{1,2})\s+", 1))
    body = F.when(numbered, normalize_space(F.regexp_replace(canonical, r"(?U)^\d{1,2}\s+", ""))).otherwise(canonical)
    return let(F.struct(prefix.alias("prefix"), body.alias("body")), lambda x: _parse_body(x["prefix"], x["body"]))


def _parse_body(prefix: Column, body: Column) -> Column:
    numbers = F.regexp_extract_all(body, F.lit(f"(?U)({NUMBER})"), F.lit(1))
    between = F.split(body, f"(?U){NUMBER}")  # one more than numbers

    def pick(p: Column) -> Column:
        b, n = p["between"], p["numbers"]
        # where a letter has been seen, in what stands before each number
        seen = lambda i: F.exists(F.slice(b, 1, i + 1), lambda t: t.rlike(_LETTER))
        free = lambda i: ~has(b[i], r"\p{L}$") & ~has(b[i + 1], r"^\p{L}")
        places = F.filter(F.transform(n, lambda _, i: i), lambda i: free(i) & seen(i))
        return F.when(F.size(n) > 0, F.array_max(places))

    def cut(p: Column, at: Column) -> Column:
        b, n = p["between"], p["numbers"]
        both = F.flatten(F.transform(b, lambda t, i: F.array(t, F.coalesce(F.get(n, i), F.lit("")))))
        label = normalize_space(F.array_join(F.slice(both, 1, 2 * at + 1), ""))
        rest = normalize_space(F.array_join(F.slice(both, 2 * at + 3, F.size(both)), ""))
        return F.struct(label.alias("label"), normalize_value(n[at]).alias("value"), normalize_unit(rest).alias("unit"))

    found = let(F.struct(between.alias("between"), numbers.alias("numbers")), lambda p: let(pick(p), lambda at: F.when(at.isNotNull(), cut(p, at))))
    units = "|".join(f"\\Q{u}\\E" for u in sorted({*fixed.UNITS, *fixed.UNIT_ALIASES}, key=len, reverse=True))
    alone = rf"(?iU)^({NUMBER})\s*({units})?$"

    def finish(f: Column) -> Column:
        lone = f.isNull() & body.rlike(alone)
        named = F.when(f.isNull(), F.when(body.rlike(_LETTER), normalize_space(body))).otherwise(f["label"])
        value = F.when(lone, normalize_value(F.regexp_extract(body, alone, 1))).otherwise(f["value"])
        unit = F.when(lone, normalize_unit(F.regexp_extract(body, alone, 2))).otherwise(f["unit"])
        reasons = F.array_compact(F.array(F.when(lone, "missing_label"), F.when(f.isNull(), "missing_value"), F.when(named.isNull() & ~lone, "missing_label")))
        confidence = 1.0 - F.when(f.isNull(), 0.35).otherwise(0.0) - F.when(named.isNull() | lone, 0.35).otherwise(0.0) - F.when(prefix.isNotNull() & value.isNull(), 0.05).otherwise(0.0)
        display = F.when(named.isNotNull(), F.concat_ws(" ", prefix, named))
        return F.struct(
            prefix.alias("prefix"), named.alias("label"), value.alias("value"), unit.alias("unit"), F.greatest(F.lit(0.0), confidence).alias("confidence"), reasons.alias("reasons"),
            (named.isNotNull() & value.isNotNull()).alias("is_measurement"), display.alias("display_name"), family_key(named).alias("family"),
        )

    return let(found, finish)


def with_canonical(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the canonical form of a column (canonical), made once; for what needs no parse."""
    return df.select("*", F.explode(F.array(canonical_line(F.col(text)))).alias("canonical"))


def with_parsed(df: DataFrame, text: str = "text", out: str = "parsed") -> DataFrame:
    """Adds the canonical form of a column (canonical) and its parse (out). Lines are parsed once; what follows reads the struct.

    The parse comes out of a generator of one row: else the optimizer would put it in place of each use of its fields, in filters
    and projections, and run it again for each.
    """
    return with_canonical(df, text).select("*", F.explode(F.array(parse_canonical(F.col("canonical")))).alias(out))


def with_parses(df: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """As with_parsed(), by a join with known parses, see parses(). A text that is not known has no row."""
    return df.join(known.withColumnRenamed("parsed_text", "_text"), F.coalesce(F.col(text), F.lit("")) == F.col("_text")).drop("_text")


def parses(*texts: DataFrame) -> DataFrame:
    """Each different text of tables of one column, parsed once (parsed_text, canonical, parsed); null counts as empty. For lines that are many and mostly repeat."""
    each = reduce(DataFrame.union, [t.select(F.coalesce(t[t.columns[0]], F.lit("")).alias("parsed_text")) for t in texts]).distinct()
    return with_parsed(each, "parsed_text")


def line_pattern(parsed: Column) -> Column:
    """STR-8: the shape of a line, with its value and unit named."""
    words = F.when(parsed["label"].isNotNull(), F.lower(normalize_space(parsed["label"])))
    joined = F.concat_ws(" ", F.when(parsed["prefix"].isNotNull(), "<PREFIX>"), words, F.when(parsed["value"].isNotNull(), "<VALUE>"), F.when(parsed["unit"].isNotNull(), F.concat(F.lit("<UNIT:"), F.lower(parsed["unit"]), F.lit(">"))))
    return F.when(joined == "", "<EMPTY>").otherwise(joined)


def structured(text: Column) -> Column:
    """STR-14: the evaluation's own parse: struct of prefix, label, value, unit; the shortest label before a number at the end."""
    whole = r"(?iU)^(?:(\d{1,2})\s+)?(.*?)(?:\s+([-+]?\d+(?:[.,]\d+)?)(?:\s*([A-Za-z%][A-Za-z0-9/%]*))?)?$"
    part = lambda k: F.nullif(F.trim(F.regexp_extract(text, whole, k)), F.lit(""))
    return F.struct(part(1).alias("prefix"), part(2).alias("label"), F.replace(part(3), F.lit(","), F.lit(".")).alias("value"), normalize_unit(part(4)).alias("unit"))


def safe_correction(label: Column, value: Column, unit: Column) -> Column:
    """STR-32: struct of corrected_value and flags. The value as read is never overwritten; a digit that lost its ten gets it back."""
    number = value.try_cast("double")
    out = None
    for pattern, of_unit, low, high in fixed.BOUNDED_LABELS:
        mine = has(label, pattern, "iU") & (F.lower(F.trim(F.coalesce(unit, F.lit("")))) == of_unit.lower())
        ok = number.between(low, high)
        back = F.trim(value).rlike("^[1-9]$") & (number + 10).between(low, high)
        made = lambda v, *flags: F.struct(v.alias("corrected_value"), F.array(*map(F.lit, flags)).cast("array<string>").alias("flags"))
        case = F.when(number.isNull(), made(value, "invalid_numeric_value")).when(ok, made(value)).when(back, made((number + 10).cast("int").cast("string"), "implausible_value", "rule_recovered_leading_digit")).otherwise(made(value, "implausible_value"))
        out = F.when(mine, case) if out is None else out.when(mine, case)
    return out.otherwise(F.struct(value.alias("corrected_value"), F.array().cast("array<string>").alias("flags")))
