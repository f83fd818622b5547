"""Lines whose tokens an engine has split or glued: repairs in order, and cuts before known labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from calipra.functions.text import replace

# What begins a line after a frame number.
FIRST_WORDS = ("IVSd", "LVI", "LVP", "LVE", "LVL", "LVOT", "LVEF", "LVESV", "LVEDV", "LAL", "LAA", "LAESV", "LAES", "LA", "RA", "AV", "AVA", "TR", "PV", "MV", "SV", "EF", "Ao", "RVI", "IVC", "E'", "E ", "P Vein")

# Fixed values: (pattern, replacement, whether case counts), applied in this order: glued tokens, split tokens, units.
REPAIRS = (
    (r"\bMOD\s*A\s*([24])\s*C\b", "MOD A$1C", True),
    (r"\bLVOTVmax\b", "LVOT Vmax", False),
    (r"\bLVOTVmean\b", "LVOT Vmean", False),
    (r"\bLVOTmaxPG\b", "LVOT maxPG", False),
    (r"\bLVOTmeanPG\b", "LVOT meanPG", False),
    (r"\bLVOTVTI\b", "LVOT VTI", False),
    (r"\bLVOTDiam\b", "LVOT Diam", False),
    (r"\bAVVmax\b", "AV Vmax", False),
    (r"\bAVVmean\b", "AV Vmean", False),
    (r"\bAVmaxPG\b", "AV maxPG", False),
    (r"\bAVmeanPG\b", "AV meanPG", False),
    (r"\bAVVTI\b", "AV VTI", False),
    (r"\bPVVmax\b", "PV Vmax", False),
    (r"\bPVmaxPG\b", "PV maxPG", False),
    (r"\bPVmeanPG\b", "PV meanPG", False),
    (r"\bPVVTI\b", "PV VTI", False),
    (r"\bTRVmax\b", "TR Vmax", False),
    (r"\bTRmaxPG\b", "TR maxPG", False),
    (r"\bMVDecT\b", "MV DecT", False),
    (r"\bLVLd\s*A\s*([24])\s*C\b", "LVLd A$1C", True),
    (r"\bLVLs\s*A\s*([24])\s*C\b", "LVLs A$1C", True),
    (r"\bLV\s+Ld\s*A\s*([24])\s*C\b", "LVLd A$1C", True),
    (r"\bLV\s+Ls\s*A\s*([24])\s*C\b", "LVLs A$1C", True),
    (r"\bLALs\s*A\s*([24])\s*C\b", "LALs A$1C", True),
    (r"\bLAAs\s*A\s*([24])\s*C\b", "LAAs A$1C", True),
    (r"\bLAL\s+s\s*A\s*([24])\s*C\b", "LALs A$1C", False),
    (r"\bLAESV\s*A-L\s*A\s*([24])\s*C\b", "LAESV A-L A$1C", True),
    (r"\bLA\s*E\s*SV\s*A-L\s*A\s*([24])\s*C\b", "LAESV A-L A$1C", True),
    (r"\d+\s*RALENGTH\s*([\d.]+)\s*cm\b", "RA LENGTH $1 cm", False),
    (r"\d+\s*LALENGTH\s*([\d.]+)\s*cm\b", "LA LENGTH $1 cm", False),
    (r"\bRALENGTH\s*([\d.]+)\s*cm\b", "RA LENGTH $1 cm", False),
    (r"\bLALENGTH\s*([\d.]+)\s*cm\b", "LA LENGTH $1 cm", False),
    (r"\bE'Lat\b", "E' Lat", False),
    (r"\bE'Sept\b", "E' Sept", False),
    (r"\bAVA\s*\(\s*VT\s+I\s*\)", "AVA (VTI)", False),
    (r"\bVT\s+I\b", "VTI", True),
    (r"\bL\s+VED\s+V\b", "LVEDV", True),
    (r"\bLVED\s+V\b", "LVEDV", True),
    (r"\bL\s+VES\s+V\b", "LVESV", True),
    (r"\bLVES\s+V\b", "LVESV", True),
    (r"\bLA\s+E\s+SV\b", "LAESV", True),
    (r"\bLAES\s+V\b", "LAESV", True),
    (r"\bLAESV\s+\(", "LAESV(", True),
    (r"\bL\s+VI\s+Dd\b", "LVIDd", False),
    (r"\bLVI\s+Dd\b", "LVIDd", False),
    (r"\bL\s+VI\s+Ds\b", "LVIDs", False),
    (r"\bLVI\s+Ds\b", "LVIDs", False),
    (r"\bL\s+VP\s+Wd\b", "LVPWd", False),
    (r"\bLVPW\s+d\b", "LVPWd", False),
    (r"\b1\s+VSd\b", "IVSd", False),
    (r"\bIV\s+Sd\b", "IVSd", False),
    (r"\bLV\s+Ld\b", "LVLd", True),
    (r"\bLV\s+Ls\b", "LVLs", True),
    (r"\b1\s+LV\s+Ld\b", "LVLd", True),
    (r"\b1\s+LV\s+Ls\b", "LVLs", True),
    (r"\bLA\s+As\b", "LAAs", True),
    (r"\bLA\s+Ls\b", "LALs", True),
    (r"\b1\s+LAL\s+s\b", "LALs", False),
    (r"\bLAL\s+s\b", "LALs", False),
    (r"\bAo\s+As\s+c\b", "Ao asc", True),
    (r"\bAo\s+as\s+c\b", "Ao asc", True),
    (r"\bE'\s+Lat\b", "E' Lat", False),
    (r"\bE'\s+Sept\b", "E' Sept", False),
    (r"\bE\s+Sept\b", "E' Sept", False),
    (r"\bV\s+max\b", "Vmax", False),
    (r"\bV\s+mean\b", "Vmean", False),
    (r"\bV\s+TI\b", "VTI", False),
    (r"\bmax\s+PG\b", "maxPG", False),
    (r"\bmean\s+PG\b", "meanPG", False),
    (r"\bDec\s+T\b", "DecT", False),
    (r"\bBi\s+plane\b", "Biplane", False),
    (r"%\s+FS\b", "%FS", True),
    (r"\bE\s+F\s+\(Teich\)", "EF(Teich)", False),
    (r"\bE\s+F\s+Biplane\b", "EF Biplane", False),
    (r"\bE\s+F\s+MOD\b", "EF MOD", False),
    (r"\bLV\s+Ot\b", "LVOT", False),
    (r"\bLV\s+Ef\b", "LVEF", False),
    (r"\bI\s+VC\b", "IVC", True),
    (r"\bIV\s+C\b", "IVC", True),
    (r"\bRVI\s+Dd\b", "RVIDd", False),
    (r"\bi\s+Rvid\b", "RVIDd", False),
    (r"\bS\s+V\s+MOD\b", "SV MOD", False),
    (r"\bS\s*/\s*D\b", "S/D", True),
    (r"\bE\s*/\s*A\b", "E/A", True),
    (r"\bAV\s+A\s+(?=Vmax\b)", "AVA ", False),
    (r"\bAV\s+A\s+(?=VTI\b)", "AVA ", False),
    (r"\bAV\s+A\s+(?=\(VTI\))", "AVA ", True),
    (r"\bm\s*/\s*s\b", "m/s", True),
    (r"\bmm\s+Hg\b", "mmHg", False),
    (r"\bcm\s*2\b", "cm2", True),
    (r"\bml\s*/\s*m\s*2\b", "ml/m2", False),
    (r"\bcm\s*/\s*s\b", "cm/s", True),
    (r"\bm/s\s+2\b", "m/s2", True),
)

# Labels before which a long line is cut.
LABELS = (
    r"LAESV(?:\s*\(|\s+(?:Index|A-L))", "LVEDV", "LVESV", "LVEF", "LVOT", "LVIDd", "LVIDs", "LVPWd", "LVLd", "LVLs", "LALs", "LAAs", r"MV\s+(?:E\s+VEL|A\s+Vel|Dec|E/A)", r"P\s+Vein\s+(?:A|D|S)",
    r"EF\s*(?:Biplane|\(Teich\)|MOD)", r"SV\s+MOD", r"TR\s+(?:Vmax|maxPG)", r"PV\s+(?:Vmax|maxPG)", r"AV\s+(?:Vmax|Vmean|maxPG|meanPG|VTI)", r"AVA\s+(?:Vmax|VTI|\(VTI\))",
    r"LVOT\s+(?:Vmax|maxPG|VTI|Diam)", r"RA\s+LENGTH", r"LA\s+LENGTH", "IVSd", "IVSDd", r"E'\s+(?:Lat|Sept)", "%FS",
)


def repair_spacing(line: Column) -> Column:
    """STR-22: a frame number before a known label goes, colons in numbers become points, then the repairs."""
    first = "|".join(f"\\Q{w}\\E" for w in FIRST_WORDS)
    x = replace(line, rf"^\d+\s+(?={first})", "")
    x = replace(x, r"\b(\d+):(\d{2})\b", "$1.$2")
    return reduce(lambda c, r: replace(c, r[0], r[1], "U" if r[2] else "iU"), REPAIRS, x)


def cut_lines(line: Column) -> Column:
    """STR-23: line feeds before known labels that follow a word."""
    return replace(line, rf"(?<=[\d\w])\s+(?=(?:{'|'.join(LABELS)}))", "\n", "iU")


def repaired_lines(text: Column) -> Column:
    """STR-23: the lines of a whole text, repaired and cut, as an array."""
    return F.flatten(F.transform(F.split(text, r"\r\n|\r|\n"), lambda t: F.split(cut_lines(repair_spacing(t)), "\n")))
