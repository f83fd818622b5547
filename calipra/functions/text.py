"""Text functions on columns: canonical lines, units, predicates and keys. All are built-in expressions; nothing here runs Python."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from calipra.functions import fixed

NUMBER = r"[-+]?\d+(?:[.,]\d+)?"
_ANY_UNIT = "|".join(f"\\Q{u}\\E" for u in sorted({*fixed.UNITS, *fixed.UNIT_ALIASES}, key=len, reverse=True))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def replace(text: Column, pattern: str, by: str, flags: str = "U") -> Column:
    return F.regexp_replace(text, f"(?{flags})" + pattern, by)


def has(text: Column, pattern: str, flags: str = "U") -> Column:
    return text.rlike(f"(?{flags})" + pattern)


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value for a key, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def normalize_space(text: Column) -> Column:
    """STR-1: runs of white space become a blank, none at the ends."""
    return F.trim(replace(text, r"\s+", " "))


def normalize_value(value: Column) -> Column:
    """STR-2: decimal commas become points; blank becomes null."""
    return F.nullif(F.replace(normalize_space(value), F.lit(","), F.lit(".")), F.lit(""))


def _known_unit(word: Column) -> Column:
    """A word without white space as the unit that it stands for, else as it is."""
    return F.coalesce(lookup(F.lower(word), {u.lower(): u for u in fixed.UNITS} | fixed.UNIT_ALIASES), word)


def normalize_unit(unit: Column) -> Column:
    """STR-3: a known unit, by alias or without regard to case; else as it is; blank becomes null."""
    return let(F.nullif(normalize_space(unit), F.lit("")), _known_unit)


def is_known_unit(unit: Column) -> Column:
    return F.coalesce(unit.isin(*fixed.UNITS), F.lit(False))


#: What lines have that markup, odd characters or a value between slashes are to be cleaned of.
_ODD = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in fixed.CHARS_FROM + "\\{}|") + r"]|/\s*[-+\d]"


def _without_markup(text: Column) -> Column:
    x = replace(text, r"\\(?:text|mathrm)\{([^}]*)\}", "$1")
    x = F.translate(x, fixed.CHARS_FROM, fixed.CHARS_TO)
    x = replace(x, r"\\[,;! ]", " ")
    x = F.translate(x, "{}", "  ")
    x = F.replace(x, F.lit("\\%"), F.lit(" %"))
    x = F.replace(F.replace(x, F.lit("\\,"), F.lit(" ")), F.lit("|"), F.lit(" "))
    return replace(x, rf"/\s*({NUMBER})\s*({_ANY_UNIT})\s*/", "$1 $2", "iU")


def clean_noise(text: Column) -> Column:
    """STR-4: markup, odd characters and glued values, in the order that results depend on. Steps that a line can't need are passed over."""
    x = F.when(has(text, _ODD), _without_markup(text)).otherwise(text)
    x = replace(x, r"^(?:ı|I|l)\s+(?=[A-Za-z])", "1 ")
    x = F.replace(x, F.lit("EF("), F.lit("EF ("))
    x = replace(x, r"^(\d{1,2})(?=[A-Za-z'])", "$1 ")
    x = replace(x, rf"({NUMBER})({_ANY_UNIT})(?=\s|$)", "$1 $2", "iU")
    return normalize_space(x)


#: Any line that a repair of labels changes holds one of their patterns as it comes.
_STARTS = [pattern.removeprefix(r"\b") for pattern, _ in fixed.LABEL_REPAIRS if pattern.startswith(r"\b")]
_ANY_REPAIR = "|".join([rf"\b(?:{'|'.join(_STARTS)})", *(pattern for pattern, _ in fixed.LABEL_REPAIRS if not pattern.startswith(r"\b"))])


def repair_labels(line: Column) -> Column:
    """The repairs of labels, in their order, of lines that have any to repair."""
    return let(line, lambda x: F.when(has(x, _ANY_REPAIR, "iU"), reduce(lambda c, r: replace(c, r[0], r[1], "iU"), fixed.LABEL_REPAIRS, x)).otherwise(x))


def strip_unit_filler(line: Column) -> Column:
    """STR-6: what follows the last known unit goes, if it is dots, dashes, slashes and underscores; longest unit first."""
    tail = r"(?=[^_]*_[^_]*_|[^.]*\.[^.]*\.|[^-]*-[^-]*-|[^/]*/)[\s_.\-/]*$"

    def strip(x: Column) -> Column:
        cases = []
        for unit in sorted(fixed.UNITS, key=len, reverse=True):
            pattern = rf"^(.*)\Q{unit}\E{tail}"
            cases.append(F.when(has(x, pattern, "iU"), replace(x, pattern, "$1" + unit, "iU")))
        return F.when(has(x, r"[_.\-/]\s*$"), F.coalesce(*cases, x)).otherwise(x)

    return let(line, strip)


def count_alnum(text: Column) -> Column:
    return F.length(replace(text, r"[^\p{L}\p{N}]+", ""))


def count_punctuation(text: Column) -> Column:
    """Characters that are neither letters, numbers nor white space."""
    return F.length(replace(text, r"[\p{L}\p{N}\s]+", ""))


def is_symbol_junk(text: Column) -> Column:
    """FLT-4: nothing, other scripts or markup, a character at most, or mostly punctuation."""
    n, p = count_alnum(text), count_punctuation(text)
    odd = has(text, r"[\u4e00-\u9fff\u0400-\u04ff]|\\mathbf|\\text|\\Delta")
    return (text == "") | odd | (n <= 1) | (p >= F.greatest(F.lit(4), n * 2))


def is_filler_line(text: Column) -> Column:
    """FLT-5: blank, of filler characters alone, without letters and numbers, or with two at most and as much punctuation."""
    return let(replace(text, r"^\s+|\s+$", ""), lambda x: let(F.struct(count_alnum(x).alias("n"), count_punctuation(x).alias("p")), lambda c: (x == "") | has(x, r"^[_.\-/ ~]*$") | (c["n"] == 0) | ((c["n"] <= 2) & (c["p"] >= F.greatest(F.lit(2), c["n"])))))


def canonical_line(text: Column) -> Column:
    """STR-5: the canonical form of a line; empty for junk and null."""
    x = clean_noise(F.coalesce(text, F.lit("")))
    x = strip_unit_filler(repair_labels(x))
    x = let(x, lambda c: F.when(has(c, r"[_.\-]\s*$"), replace(c, r"(?:\s*(?:_+|(?:[.-]\s*){3,}|-+))+\s*$", "")).otherwise(c))
    x = F.array_join(F.transform(F.split(normalize_space(x), " "), lambda t: _known_unit(t)), " ")
    return let(normalize_space(x), lambda c: F.when(is_symbol_junk(c), "").otherwise(c))


def family_key(label: Column) -> Column:
    """STR-7."""
    return F.lower(normalize_space(F.coalesce(label, F.lit(""))))


def line_from_source(source: Column) -> Column:
    """STR-9: the line in a source of the form kind:line; of an exact line, without what follows the last colon."""
    body = F.trim(F.regexp_extract(source, r"(?s)^(?:exact_line|ocr_line|decoded_line):(.*)$", 1))
    cut = F.when(source.startswith("exact_line:"), F.regexp_replace(body, r"(?s):[^:]*$", "")).otherwise(body)
    return F.nullif(F.trim(cut), F.lit(""))


def canonical_label_line(text: Column, split_any_case: bool = False, fix_squares: bool = True) -> Column:
    """STR-13, and by its options STR-15 (no squares) and STR-44 (any case, no squares): the canonical form of labelled lines."""
    x = replace(text, r"\\(?:text|mathrm)\{([^}]*)\}", "$1")
    x = replace(x, r"\\[,;! ]", " ")
    x = F.translate(x, "{}", "  ")
    x = F.replace(x, F.lit("\\"), F.lit(" "))
    if fix_squares:
        x = replace(x, r"\b(m/s|cm)\s+2\b", "$12")  # group 1, then 2
    x = replace(x, r"(\d)(%|mmHg|ml|cm2|cm/s|cm|mm|m/s2|m/s|ms|bpm|s)\b", "$1 $2", "iU" if split_any_case else "U")
    return normalize_space(x)


def same_text(a: Column, b: Column) -> Column:
    """STR-16: equal without regard to case and spacing; null is empty."""
    key = lambda c: F.lower(normalize_space(F.coalesce(c, F.lit(""))))
    return key(a) == key(b)


def name_key(name: Column) -> Column:
    """STR-20."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def _unmarked(text: Column) -> Column:
    x = replace(text, r"\\(?:text|mathrm)\{([^}]*)\}", "$1")
    return F.translate(replace(x, r"\\[,;! ]", " "), "{}\\", "   ")


def parser_value(value: Column) -> Column:
    """STR-18, values."""
    return replace(F.replace(_unmarked(value), F.lit(","), F.lit(".")), r"^\s+|\s+$", "")


def parser_unit(unit: Column) -> Column:
    """STR-18, units: aliases, else as they are; blank becomes null."""
    return let(F.nullif(replace(_unmarked(unit), r"^\s+|\s+$", ""), F.lit("")), lambda u: F.coalesce(lookup(F.lower(u), fixed.PARSER_UNIT_ALIASES), u))


def complete_unit(name: Column, unit: Column) -> Column:
    """STR-19: velocities without unit, or in ms, are in m/s; gradients without unit in mmHg."""
    low = F.lower(F.coalesce(unit, F.lit("")))
    return F.when(has(name, fixed.VELOCITY_HINT, "iU") & low.isin("", "ms"), "m/s").when(has(name, fixed.GRADIENT_HINT, "iU") & (low == ""), "mmHg").otherwise(unit)


def is_telemetry(name: Column, unit: Column) -> Column:
    """FLT-2."""
    return F.lower(name).rlike("|".join(fixed.TELEMETRY_WORDS)) | F.coalesce(F.lower(unit).isin(*fixed.TELEMETRY_UNITS), F.lit(False))


def is_number(value: Column) -> Column:
    """FLT-3."""
    return value.rlike(r"^[-+]?\d+(?:\.\d+)?$")


#: STR-17: how measured quantities at the end of a name are written, by their lower-case spelling.
_ENDINGS = {"maxpg": "maxPG", "meanpg": "meanPG", "vmax": "Vmax", "vmean": "Vmean", "vti": "VTI", "dect": "DecT"}
_UPPER_NAMES = ("ef", "fs", "ivc", "ivsd", "lvidd", "lvids", "lvpwd", "rvidd")


def _name_token(token: Column) -> Column:
    marked = has(token, r"[),.;:]$")
    base = F.when(marked, F.regexp_replace(token, r"(?s).$", "")).otherwise(token)
    tail = F.when(marked, F.right(token, F.lit(1))).otherwise("")

    def spell(b: Column) -> Column:
        low = F.lower(b)
        glued = r"^([a-z]{2,4})(maxpg|meanpg|vmax|vmean|vti|dect)$"
        out = F.when(low.rlike(glued), F.concat(F.upper(F.regexp_extract(low, glued, 1)), F.lit(" "), lookup(F.regexp_extract(low, glued, 2), _ENDINGS)))
        for end, written in _ENDINGS.items():
            out = out.when(low.endswith(end), F.concat(F.left(b, F.length(b) - len(end)), F.lit(written)))
        return out.when(low.isin(*_UPPER_NAMES), F.upper(b)).otherwise(b)

    return F.concat(let(base, spell), tail)


def normalize_name(name: Column) -> Column:
    """STR-17: separators, brackets and the spelling of quantities in a name."""
    x = F.translate(name, "|_¥’", "  V'")
    x = normalize_space(_unmarked(x))
    x = replace(replace(x, r"\s*/\s*", "/"), r"\s*-\s*", "-")
    x = replace(replace(x, r"\(\s*", "("), r"\s*\)", ")")
    x = replace(x, r"([A-Za-z0-9])\(", "$1 (", "")
    x = F.array_join(F.transform(F.split(x, " "), _name_token), " ")
    for a in ("a-l", "a-p"):
        x = F.replace(x, F.lit(f"({a})"), F.lit(f"({a.upper()})"))
    x = replace(x, r"\bAVPG\s*\(\s*mean\s*\)", "AV meanPG", "iU")
    return F.trim(replace(x, r"\bAVPG\b", "AV maxPG", "iU"))


def char_count(text: Column) -> Column:
    """STR-24: characters of the canonical line that are no white space."""
    return F.length(replace(canonical_line(text), r"\s", ""))


def noise_penalty(text: Column) -> Column:
    """STR-25: a fifth of the share of odd characters, and 0.05 for each run of punctuation; 0.2 for nothing."""
    odd = F.length(replace(text, r"[\p{L}\p{N}\s%'./\-()]", ""))
    runs = F.size(F.regexp_extract_all(text, F.lit(r"([._\-=]{3,})"), F.lit(1)))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0.2)).otherwise(odd / F.length(text) * 0.2 + runs * 0.05)


def measurement_stem(text: Column) -> Column:
    """STR-29: the first three words after a number in front."""
    words = F.split(normalize_space(replace(text, r"^\s*\d{1,2}\s+", "")), " ")
    return F.array_join(F.slice(words, 1, 3), " ")


def safe_name(name: Column) -> Column:
    """STR-40: a name for files."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def stable_split(key: Column, ratio: float) -> Column:
    """HSH-1: val for a share of keys, else train, by the first 32 bits of SHA-1."""
    return F.when(F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("double") / 4294967295.0 < ratio, "val").otherwise("train")


def values_match(a: Column, b: Column, tolerance: float = 0.011) -> Column:
    """NUM-1: numbers within the tolerance, else equal texts; null equals null."""
    x, y = a.try_cast("double"), b.try_cast("double")
    both = F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tolerance).otherwise(F.trim(a) == F.trim(b))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(both)


def flatten_error(kind: Column, message: Column) -> Column:
    """STR-42."""
    return F.concat_ws(": ", F.nullif(kind, F.lit("")), F.nullif(message, F.lit("")))
