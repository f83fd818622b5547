"""Word lists, patterns and constants on which results depend. Patterns are Java's, with Unicode classes."""

# Units, and spellings that readers of images produce for them.
UNITS = ("%", "mmHg", "ml/m2", "m/s2", "cm2", "cm/s", "m/s", "bpm", "cm", "mm", "ms", "ml", "s")
UNIT_ALIASES = {"mis": "m/s", "mls": "m/s", "m1s": "m/s", "m/": "m/s", "mmha": "mmHg", "més": "m/s", "mhg": "mmHg", "mmhg": "mmHg", "em": "cm"}
PARSER_UNIT_ALIASES = {"mis": "m/s", "mls": "m/s", "m1s": "m/s", "mhg": "mmHg", "mmhg": "mmHg", "m/s;": "m/s", "m/s.": "m/s", "m/s,": "m/s", "mmhg,": "mmHg", "mmhg.": "mmHg"}

# Characters that are mapped one to one.
CHARS_FROM = "’‘`´“”–—−•·→~¥¢"
CHARS_TO = "''''\"\"---    Vc"

# Repairs of labels, applied in this order.
LABEL_REPAIRS = (
    (r"\bAVS\b", "AVA"),
    (r"\bL[YV]IDd\b", "LVIDd"),
    (r"\bL[VY](?:I|YI)DS\b", "LVIDs"),
    (r"\bL[YV]P(?:W|VW)d\b", "LVPWd"),
    (r"\bL[YV][YV]P(?:W|VW)d\b", "LVPWd"),
    (r"\bL[VY]P[VW]{2,}d\b", "LVPWd"),
    (r"\bI[VY]Sd\b", "IVSd"),
    (r"\bLALS\b", "LALs"),
    (r"\bLALS\s+AdU\b", "LALs A4C"),
    (r"\bLALS\s+A&v\b", "LALs A4C"),
    (r"\bL[YV]OT\b", "LVOT"),
    (r"\bA[o0]\b", "Ao"),
    (r"\bA20\b", "A2C"),
    (r"\bA40\b", "A4C"),
    (r"\bLAAS\b", "LAAs"),
    (r"\bPRand\s+PG\b", "PRend PG"),
    (r"\b1E['’]?\b", "1 E'"),
    (r"\bE['’]?\s*Lat\b", "E' Lat"),
    (r"\bE['’]?\s*Sept\b", "E' Sept"),
    (r"\bMV\s+Dect\b", "MV DecT"),
    (r"\(eich\s+\d*\s*", "EF (Teich) "),
    (r"\bP\s+Vein\s+s\b", "P Vein S"),
)

# Names and units of what is on the screen but measures nothing.
TELEMETRY_WORDS = ("fps", "mhz", "hz", "frequency", "frame", "gain", "depth", "diastole", "systole")
TELEMETRY_UNITS = ("mhz", "hz", "fps")
VELOCITY_HINT, GRADIENT_HINT = r"(vmax|vmean|\bvel\b|e')", r"(?:^|\s)(pg|maxpg|meanpg)\b"

# Labels whose values are bounded, with their unit and bounds.
BOUNDED_LABELS = ((r"\bLVOT\s+maxPG\b", "mmHg", 10.0, 250.0), (r"\bAV\s+maxPG\b", "mmHg", 10.0, 250.0))
