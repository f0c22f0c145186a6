"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremolo.config import Geometry

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def rounded(v: Column, digits: int = 6) -> Column:
    """Rounded, or null if it isn't finite."""
    return F.when(finite(v), F.round(v, digits))


def positive(v: Column) -> Column:
    """The value if it is finite and above 0, else null."""
    return F.when(finite(v) & (v > 0), v)


def parsed(text: Column) -> Column:
    """A decimal number in text as a finite double, else null (no suffixes, words or grouping)."""
    t = F.trim(text)
    value = F.when(t.rlike(_NUMBER), t.try_cast("double"))
    return F.when(finite(value), value)


def hz_text(v: Column) -> Column:
    """Whole frequencies without decimals, others with one."""
    return F.when(v == F.floor(v), F.format_string("%d", v.cast("long"))).otherwise(F.format_string("%.1f", v))


def band_label(lo: Column, hi: Column) -> Column:
    return F.concat(hz_text(lo), F.lit("-"), hz_text(hi), F.lit("Hz"))


def formatted(form: str, *values: Column | str) -> Column:
    """Values in a printf form; null if any is null."""
    columns = [F.col(v) if isinstance(v, str) else v for v in values]
    known = F.lit(True)
    for c in columns:
        known = known & c.isNotNull()
    return F.when(known, F.format_string(form, *columns))


def significant(v: Column, digits: int) -> Column:
    """As many significant digits without trailing zeros; an exponent from -5 down and from ``digits`` up, as C's %g has it.

    Where the next digit is a lone 5 in decimal, the last may differ from exact binary rounding.
    """
    v = v.cast("double")
    place = lambda x: F.floor(F.log10(F.abs(x)) + 1e-12)
    ten = F.lit(10.0)
    short = lambda size: F.when(size < digits, F.bround(v * F.pow(ten, digits - 1 - size)) / F.pow(ten, digits - 1 - size)).otherwise(F.bround(v / F.pow(ten, size - digits + 1)) * F.pow(ten, size - digits + 1))
    w = short(place(v))
    size = place(w)  # rounding may have made it a digit longer
    plain = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits + 4}f", w), "0+$", ""), r"\.$", "")
    mantissa = F.bround(w / F.pow(ten, size) * 10.0 ** (digits - 1)) / 10.0 ** (digits - 1)
    sci = F.regexp_replace(F.format_string(f"%.{digits - 1}fe%+03d", mantissa, size), r"\.?0+e", "e")
    return F.when(v.isNull(), None).when(v == 0, "0").when((size < -4) | (size >= digits), sci).otherwise(plain)


def short_number(v: Column) -> Column:
    return significant(v, 4)


def fault_frequencies(rpm: Column, g: Geometry = Geometry()) -> dict[str, Column]:
    """Shaft frequency and the four characteristic frequencies in Hz, rounded to 4 digits."""
    shaft = rpm / 60.0
    r = F.lit(g.ball / g.pitch) * F.cos(F.radians(F.lit(g.angle)))
    return {
        "shaft": F.round(shaft, 4),
        "bpfo": F.round(shaft * (g.balls / 2.0) * (1 - r), 4),
        "bpfi": F.round(shaft * (g.balls / 2.0) * (1 + r), 4),
        "bsf": F.round(shaft * (g.pitch / (2 * g.ball)) * (1 - r * r), 4),
        "ftf": F.round(shaft / 2.0 * (1 - r), 4),
    }


def change(normal: Column, abnormal: Column, with_ratio: bool = True) -> Column:
    """{normal, abnormal, delta, ratio}, 4 digits; the ratio is null where the baseline is 0."""
    ratio = F.when(normal != 0, rounded(F.try_divide(abnormal, normal), 4)) if with_ratio else F.lit(None).cast("double")
    return F.struct(rounded(normal, 4).alias("normal"), rounded(abnormal, 4).alias("abnormal"), rounded(abnormal - normal, 4).alias("delta"), ratio.alias("ratio"))


def trend(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "changed").when(ratio >= 1, "rose").otherwise("fell")


def percent(ratio: Column) -> Column:
    return F.coalesce(formatted("%.0f%%", F.bround(F.abs(ratio - 1) * 100)), F.lit("unknown"))  # of ties the even one


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def normal_question(text: Column) -> Column:
    """Letters and digits of any script, lower-cased."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"https?://[^\s，。；、）)\]}\"'<>]+"), F.lit(0))


def folded(text: Column, most: int) -> Column:
    """White space folded; longer texts are cut and end in an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer: from the first brace to the last, code fences ignored; null if none parses."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), body)
