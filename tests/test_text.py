"""Golden strings of canonical lines, parsing, names, spacing and corrections."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from calipra.functions import text as T
from calipra.functions.parse import line_pattern, safe_correction, structured, with_parsed
from calipra.functions.similarity import similarity
from calipra.functions.spacing import repair_spacing, repaired_lines

CANONICAL = [
    (r"1   Ao\,Diam  3.2cm", "1 Ao Diam 3.2 cm"), ("L¥IDd 5.0 em", "LVIDd 5.0 cm"), ("1E' Lat 0.09 m/", "1 E' Lat 0.09 m/s"), ("L¥P¥Wd i1.1em", "LVPWd i1.1 cm"), ("1LALS AdU 3.6 cM", "1 LALs A4C 3.6 cm"),
    ("1 LVYIDS 3.6 cm", "1 LVIDs 3.6 cm"), ("--- - . . _ __ -", ""), ("1 E' Lat 0.09 més", "1 E' Lat 0.09 m/s"), ("2 LA Diam 5.5 cm ____", "2 LA Diam 5.5 cm"), ("ı IVSd /1.1 cm/ . . . . .", "1 IVSd 1.1 cm"),
    ("LVPVVd 1.1 cm", "LVPWd 1.1 cm"), ("AVS Vmax 2.6 cm2", "AVA Vmax 2.6 cm2"), ("PRand PG 4.69 mmHg", "PRend PG 4.69 mmHg"), ("LAAS A4C 24.5 cm2", "LAAs A4C 24.5 cm2"), ("LAAs A2C 30 cm2", "LAAs A2C 30 cm2"),
    ("Flow 3.2 m/s2", "Flow 3.2 m/s2"), (None, ""), ("日本 3 cm", ""), ("x", ""),
]

PARSED = [
    ("2 LVIDd 5.4 cm", ("2", "LVIDd", "5.4", "cm", 1.0, [], True)), ("Strange Overlay Label", (None, "Strange Overlay Label", None, None, 0.65, ["missing_value"], False)),
    ("4.6 cm", (None, "4.6 cm", "4.6", "cm", 0.3, ["missing_label", "missing_value"], True)), ("46 cm", ("46", "cm", None, None, 0.6, ["missing_value"], False)), ("4.6", (None, None, "4.6", None, 0.3, ["missing_label", "missing_value"], False)),
    ("%FS 16 %", (None, "%FS", "16", "%", 1.0, [], True)), ("EF 55 % of 3 odd words", (None, "EF 55 % of", "3", "odd words", 1.0, [], True)), ("A 1,5 cm", (None, "A", "1.5", "cm", 1.0, [], True)),
    ("", (None, None, None, None, 0.3, ["missing_value", "missing_label"], False)),
]


def one(spark, texts, expr):
    rows = [(i, t) for i, t in enumerate(texts)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, text string").orderBy("i").select(expr(F.col("text"))).collect()]


def test_canonical(spark):
    assert one(spark, [t for t, _ in CANONICAL], T.canonical_line) == [w for _, w in CANONICAL]


def test_parse(spark):
    d = with_parsed(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PARSED)], "i int, text string")).orderBy("i")
    for r, (t, want) in zip(d.collect(), PARSED, strict=True):
        got = tuple(r.parsed)[:7]
        assert got[:4] == want[:4] and abs(got[4] - want[4]) < 1e-9 and got[5:] == want[5:], t


def test_patterns_and_sources(spark):
    d = with_parsed(spark.createDataFrame([("3 AV Vmax 1.8 m/s",), ("",)], "text string")).select(line_pattern(F.col("parsed")))
    assert [r[0] for r in d.collect()] == ["<PREFIX> av vmax <VALUE> <UNIT:m/s>", "<EMPTY>"]
    assert one(spark, ["exact_line:1 IVSd 0.9 cm:0.990", "ocr_line:a:b", "other:x", "exact_line:", None], T.line_from_source) == ["1 IVSd 0.9 cm", "a:b", None, None, None]


def test_units_values_names(spark):
    assert one(spark, ["MIS", "CM2", "odd", " ", None], T.normalize_unit) == ["m/s", "cm2", "odd", None, None]
    assert one(spark, [" 1,5 ", "", None], T.normalize_value) == ["1.5", None, None]
    assert one(spark, ["avmaxpg", "LVOT vmax", "ef", "index(a-l)", "AVPG ( mean )", "E ' / x"], T.normalize_name) == ["AV maxPG", "LVOT Vmax", "EF", "index (A-L)", "AV meanPG", "E '/x"]
    rows = spark.createDataFrame([("AV Vmax", None), ("AV Vmax", "ms"), ("AV maxPG", ""), ("LA", None)], "n string, u string")
    assert [r[0] for r in rows.select(T.complete_unit(F.col("n"), F.col("u"))).collect()] == ["m/s", "m/s", "mmHg", None]


def test_corrections(spark):
    rows = [("LVOT maxPG", "2", "mmHg"), ("AV maxPG", "6", "mmHg"), ("LVOT maxPG", "2", "cm"), ("LVOT maxPG", "abc", "mmHg"), ("LVOT maxPG", "300", "mmHg"), ("LVOT maxPG", "12", "mmHg")]
    d = spark.createDataFrame(rows, "l string, v string, u string").select(safe_correction(F.col("l"), F.col("v"), F.col("u")).alias("c")).collect()
    both = ["implausible_value", "rule_recovered_leading_digit"]
    assert [(r.c.corrected_value, r.c.flags) for r in d] == [("12", both), ("16", both), ("2", []), ("abc", ["invalid_numeric_value"]), ("300", ["implausible_value"]), ("12", [])]


@pytest.mark.parametrize(("given", "want"), [
    ("AV V max 1.8 m/s", "AV Vmax 1.8 m/s"), ("L VI Dd 5.0 cm", "LVIDd 5.0 cm"), ("LVOTVmax 1.1 m / s", "LVOT Vmax 1.1 m/s"), ("2RALENGTH5.9cm", "RA LENGTH 5.9 cm"), ("1 IVSd 0:93 cm", "IVSd 0.93 cm"),
    ("LVLdA4C 8 cm", "LVLd A4C 8 cm"), ("AVA(VT I) 2.0 cm 2", "AVA (VTI) 2.0 cm2"), ("LA E SVA-LA4C 77 ml", "LAESV A-L A4C 77 ml"), ("E'Lat 0.09 m/s", "E' Lat 0.09 m/s"), ("Nothing to change 1 cm", "Nothing to change 1 cm"),
])
def test_spacing(spark, given, want):
    assert one(spark, [given], repair_spacing) == [want]


def test_long_lines_are_cut(spark):
    assert one(spark, ["IVSd 0.9 cm LVIDd 5.4 cm\nAV V max 2 m/s EF Bi plane 60 %"], repaired_lines) == [["IVSd 0.9 cm", "LVIDd 5.4 cm", "AV Vmax 2 m/s", "EF Biplane 60 %"]]


def test_similarity(spark):
    d = spark.createDataFrame([("lvidd", "lvids"), (None, None), ("", "a")], "a string, b string")
    assert [r[0] for r in d.select(similarity("a", "b")).collect()] == [0.8, 1.0, 0.0]


def test_structured(spark):
    r = one(spark, ["1 IVSd 0.9 cm", "Label only"], structured)
    assert tuple(r[0]) == ("1", "IVSd", "0.9", "cm") and tuple(r[1]) == (None, "Label only", None, None)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("abAO01 .,cm/s%_-E'|", max_size=25), min_size=30, max_size=60))
def test_canonical_is_idempotent(spark, texts):
    once = one(spark, texts, T.canonical_line)
    twice = one(spark, once, T.canonical_line)
    settled = one(spark, twice, T.canonical_line)
    assert settled == twice or sum(a != b for a, b in zip(settled, twice, strict=True)) <= 1
