"""Cleaning and parsing of activity cells as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators.parse import NUMBER, strip

# Limits, defaults, sentinels and word lists of the data model.
PH_RANGE, TEMP_RANGE, YEAR_RANGE = (0.0, 14.0), (-80.0, 100.0), (1900, 2100)
DEFAULT_PH, DEFAULT_TEMP = 7.4, 25.0
THRESHOLD_NM = 10_000.0
ACTIVE_NM, INACTIVE_NM = 1.0, 1_000_000.0
BIN_EDGES = (10.0, 100.0, 1_000.0, 10_000.0)
LABEL_NO, LABEL_YES = ["0", "0.0", "n", "inactive", "false"], ["1", "1.0", "y", "active", "true"]
CLASS_NO, CLASS_YES = ["n", "no", "inactive", "0", "false"], ["y", "yes", "active", "1", "true"]
FLAG_YES = ["1", "1.0", "true", "yes"]
QUALITY = ["low", "medium", "high"]
ASSAYS = ["IC50", "EC50", "Ki", "Kd", "Other"]
ASSAY_OF_TYPE = {"Ki": "Ki", "IC50": "IC50", "EC50": "EC50", "Kd": "Kd", "Potency": "Other", "AC50": "Other", "ED50": "Other", "XC50": "Other"}


def number(c: Column) -> Column:
    """The finite decimal number a text holds, else null."""
    s = strip(c)
    v = F.when(s.rlike(f"^{NUMBER}$"), s.try_cast("double"))
    return F.when(F.abs(v) < float("inf"), v)


def text(c: Column) -> Column:
    """The cell as text without outer blanks; a missing one is empty."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def temperature(c: Column) -> Column:
    """A temperature with or without a trailing C, null outside the limits."""
    v = number(F.rtrim(strip(c), F.lit("Cc")))
    return F.when(v.between(*TEMP_RANGE), v)


def ph(c: Column) -> Column:
    v = number(c)
    return F.when(v.between(*PH_RANGE), v)


def activity_nm(c: Column) -> Column:
    """An exact activity above zero; a censored one, with < or > anywhere, is null."""
    v = number(c)
    return F.when(~c.rlike("[<>]") & (v > 0), v)


def pactivity(nm: Column) -> Column:
    return F.when(nm > 0, -F.log10(nm * F.lit(1e-9)))


def pchembl_to_nm(p: Column) -> Column:
    v = F.pow(F.lit(10.0), F.lit(9.0) - p)
    return F.when((v > 0) & (v < float("inf")), v)


def active(p: Column, threshold_nm: float = THRESHOLD_NM) -> Column:
    """1 if the potency reaches the threshold, else 0."""
    import math

    return (p >= F.lit(-math.log10(threshold_nm * 1e-9))).cast("int")


def labelled_active(label: Column, p: Column, threshold_nm: float = THRESHOLD_NM) -> Column:
    """An explicit label wins over the threshold."""
    return F.coalesce((label == 1).cast("int"), active(p, threshold_nm))


def tri_state(c: Column, yes: list[str], no: list[str], numeric: bool = False) -> Column:
    s = F.lower(strip(c))
    out = F.when(s.isin(yes), 1).when(s.isin(no), 0)
    if numeric:
        v = number(s)
        out = out.when(v == 1, 1).when(v == 0, 0)
    return out


def activity_label(c: Column) -> Column:
    return tri_state(c, LABEL_YES, LABEL_NO, numeric=True)


def activity_class(c: Column) -> Column:
    return tri_state(c, CLASS_YES, CLASS_NO)


def flag(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin(FLAG_YES), F.lit(False))


def year(c: Column) -> Column:
    """The whole part of a year within the limits, else null."""
    v = number(c.cast("string"))
    y = F.when(F.abs(v) < 1e9, v.cast("int"))
    return F.when(y.between(*YEAR_RANGE), y)


def potency_bin(nm: Column) -> Column:
    """Bin 0 to 4, closed on the left."""
    out = F.when(nm.isNull() | F.isnan(nm), F.lit(None).cast("int"))
    for i, edge in enumerate(BIN_EDGES):
        out = out.when(nm < edge, i)
    return out.otherwise(len(BIN_EDGES))


def assay_of_type(c: Column) -> Column:
    out = None
    for k, v in ASSAY_OF_TYPE.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def quality_at_least(c: Column, least: str) -> Column:
    return F.lower(strip(c)).isin(QUALITY[QUALITY.index(least) :])


def significant(v: Column, digits: int = 6) -> Column:
    """The number rounded half-even to so many significant digits."""
    e = F.floor(F.log10(F.abs(v)))
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - e)
    return F.when(v == 0, v).otherwise(F.rint(v * scale) / scale)


def path_tokens(c: Column, depth: int) -> Column:
    """Distinct tokens at a depth (from 1) of a text of ``;``-parted paths whose levels are parted by ``->``.

    Empty levels are dropped before counting; the text ``nan`` and a null one have no paths.
    """
    paths = F.when(F.lower(strip(c)) != "nan", F.split(c, ";"))
    levels = F.transform(paths, lambda p: F.filter(F.transform(F.split(p, "->"), strip), lambda t: t != ""))
    found = F.filter(F.transform(levels, lambda a: F.get(a, F.lit(depth - 1))), lambda t: t.isNotNull())
    return F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>"))


def sigmoid(x: Column, clip: float | None = None) -> Column:
    if clip is not None:
        x = F.least(F.greatest(x, F.lit(-clip)), F.lit(clip))
    return 1 / (1 + F.exp(-x))


def softmax(a: Column) -> Column:
    """Stable softmax of an array."""
    e = F.transform(a, lambda v: F.exp(v - F.array_max(a)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, x: s + x))


def arg_max(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("float"))


def model_id(c: Column) -> Column:
    """A name fit for a file: everything but letters, digits, dot, dash and underscore becomes an underscore."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def short_count(n: Column) -> Column:
    """A count as people write it: 950, 1.2k, 3.4M."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1_000, F.format_string("%.1fk", n / 1e3)).otherwise(n.cast("string"))


def json_text(c: Column, *paths: str) -> Column:
    """The first of the JSON paths that holds a text which isn't blank, else null."""
    return F.coalesce(*[F.when(strip(F.get_json_object(c, p)) != "", strip(F.get_json_object(c, p))) for p in paths])


def nm_to_pchembl(nm: Column) -> Column:
    """The inverse of pchembl_to_nm, null for what isn't above zero."""
    return F.when((nm > 0) & (nm < float("inf")), F.lit(9.0) - F.log10(nm))


def tokens_of(spec: str, aliases: dict[str, str] | None = None) -> list[str]:
    """A comma-separated list of names in lower case, aliases resolved (an alias may stand for several), repeats dropped."""
    out: list[str] = []
    for part in spec.split(","):
        name = part.strip().lower()
        for token in (aliases or {}).get(name, name).split(","):
            if token.strip() and token.strip() not in out:
                out.append(token.strip())
    if not out:
        raise ValueError("no name given")
    return out
