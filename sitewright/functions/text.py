"""Column expressions over text, numbers and dates.  Spaces are Unicode spaces, rounding is half to even."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import contracts as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def falsy(c, default) -> Column:
    """c unless it is null or empty."""
    return F.coalesce(F.nullif(col(c), F.lit("")), default if isinstance(default, Column) else F.lit(default))


def collapse(c) -> Column:
    """Runs of space become one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)\s+", " "), r"^ | \z", "")


def ratio(part, whole, places: int = 4) -> Column:
    """part / whole, null without a whole."""
    return F.bround(F.try_divide(col(part).cast("double"), col(whole).cast("double")), places)


def script_of(c) -> Column:
    """ko if at least 15 % of the characters (and one) are Hangul syllables, else en."""
    n = F.regexp_count(col(c), F.lit("[가-힣]"))
    return F.when(n >= F.greatest(F.lit(1.0), F.char_length(col(c)) * 0.15), "ko").otherwise("en")


def band_edge(c, bands: dict, end: int) -> Column:
    return F.when(script_of(c) == "ko", bands["ko"][end]).otherwise(bands["en"][end])


def length_verdict(c, bands: dict) -> Column:
    """none, short, ok or long against the band of the text's script."""
    n = F.char_length(F.coalesce(col(c), F.lit("")))
    text = F.coalesce(col(c), F.lit(""))
    return F.when(n == 0, "none").when(n < band_edge(text, bands, 0), "short").when(n > band_edge(text, bands, 1), "long").otherwise("ok")


def yes_no(c) -> Column:
    """true, false or null from the accepted words."""
    word = F.lower(collapse(c))
    return F.when(word.isin(*C.YES), True).when(word.isin(*C.NO), False)


def split_multi(c) -> Column:
    """Items between spaces, commas, semicolons and bars."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), r"(?U)[\s,;|]+"), lambda x: x != "")


def fingerprint(kind, text) -> Column:
    return F.sha2(F.regexp_replace(F.concat_ws("\n", col(kind), col(text)), r"(?U)^\s+|\s+\z", ""), 256)


def set_fingerprint(c) -> Column:
    """Of all fingerprints of a group, in ascending order."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(col(c))), "\n"), 256)


def strict_date(c) -> Column:
    """A date written year-month-day, with or without leading zeros; null if it is none."""
    t = collapse(c)
    return F.when(t.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"), F.try_to_date(t, "yyyy-M-d"))


def wilson(successes, trials) -> Column:
    """95 % interval of a share as struct(low, high), null without trials."""
    z = 1.959963984540054
    s, n = col(successes).cast("double"), col(trials).cast("double")
    p = s / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.struct(F.bround(F.greatest(F.lit(0.0), middle - half), 4).alias("low"), F.bround(F.least(F.lit(1.0), middle + half), 4).alias("high")))


def price_forms(c) -> Column:
    """A price as it stands and, if it is a number, with thousands parted by commas."""
    number = F.expr(f"try_cast(try_cast({c} as double) as bigint)")
    return F.array_compact(F.array(col(c), F.when(number.isNotNull(), F.format_number(number, 0))))


def html_escape(c) -> Column:
    out = col(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def json_in_html(c) -> Column:
    """JSON text that cannot end a script element."""
    out = col(c)
    for raw, safe in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out
