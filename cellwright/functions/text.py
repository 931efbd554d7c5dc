"""Character statistics, blanks, tokens and other text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip knows it.
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
#: Default tokens: runs of letters, single digits (numbers fall into digits), single other marks.
TOKEN = rf"\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]"

BASIC = ["char_count", "digit_count", "alpha_count", "space_count", "punct_count", "upper_count", "lower_count", "digit_ratio", "alpha_ratio", "upper_ratio", "punct_ratio"]


def blank(c: Column) -> Column:
    """Nothing but white space; null for null."""
    return c.rlike(rf"^[{SPACE}]*$")


def filled(c: Column) -> Column:
    """Neither null nor blank."""
    return c.isNotNull() & ~blank(c)


def count_class(c: Column, keep: str) -> Column:
    """How many characters are in the regex class body ``keep``. Others go a run at a time."""
    return F.length(F.regexp_replace(c, f"[^{keep}]++", "")).cast("long")


def basic_features(c: Column) -> dict[str, Column]:
    """Eleven statistics of a text, in the order of ``BASIC``; ratios of an empty text are 0."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    n = F.length(c).cast("long")
    counts = {
        "char_count": n,
        "digit_count": count_class(c, r"\p{Nd}²³¹"),
        "alpha_count": count_class(c, r"\p{L}"),
        "space_count": (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long"),
        "punct_count": F.length(F.regexp_replace(c, rf"[\p{{L}}\p{{N}}{SPACE}]++", "")).cast("long"),
        "upper_count": count_class(c, r"\p{IsUppercase}"),
        "lower_count": count_class(c, r"\p{IsLowercase}"),
    }
    ratio = lambda k: F.coalesce(counts[k] / F.nullif(n, F.lit(0)), F.lit(0.0))
    return counts | {f"{k}_ratio": ratio(f"{k}_count") for k in ("digit", "alpha", "upper", "punct")}


def tokens(c: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def collapsed(c: Column) -> Column:
    """Lower case, runs of two or more white-space characters as one space."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s\s+", " ")


def differs(a: Column, b: Column) -> Column:
    """Cell inequality; a null on either side is a difference."""
    return F.coalesce(a != b, F.lit(True))


def value_of(c: Column) -> Column:
    """The cell as text, null being a value of its own."""
    return F.coalesce(c.cast("string"), F.lit("nan"))
