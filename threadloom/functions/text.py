"""Column functions on text, labels and small scalars."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published marker lists.
SYSTEM = ["model", "framework", "structure", "system", "pipeline", "architecture", "taxonomy", "theory", "design", "mechanism"]
FUTURE = ["build", "develop", "implement", "publish", "launch", "create", "scale", "design", "construct"]
META = ["conceptually", "structurally", "let's step back", "zoom out", "in principle", "abstractly"]
RELATIONAL = ["you", "we", "us", "together", "partner", "brother", "hermano", "coach", "companion"]
UNCERTAINTY = ["maybe", "perhaps", "not sure", "i guess", "possibly"]

#: Common English function words, which topics leave out.
ENGLISH_STOP = """a about above after again against all also am an and any are as at be because been before being below
between both but by can could did do does doing down during each few for from further had has have having he her
here hers herself him himself his how if in into is it its itself just me more most my myself no nor not now of
off on once only or other our ours ourselves out over own same she should so some such than that the their theirs
them themselves then there these they this those through to too under until up very was we were what when where
which while who whom why will with would you your yours yourself yourselves""".split()


def marker_count(text: Column, words: list[str]) -> Column:
    """Whole-word occurrences of any of the words or phrases, in lower case; 0 for null."""
    pattern = r"(?U)\b(" + "|".join(re.escape(w) for w in words) + r")\b"
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(pattern)), F.lit(0))


#: What stands between words.
NOT_WORD = r"(?U)[^\w]+"


def is_ascii_word(word: Column) -> Column:
    return word.rlike("^[a-z]+$")


def ascii_words(text: Column) -> Column:
    """Lower-case words of a to z that stand between non-word characters."""
    return F.filter(F.split(F.lower(text), NOT_WORD), is_ascii_word)


def safe_title(title: Column, length: int = 120) -> Column:
    """A title fit for a file name: word characters, blanks, - . ( ), blanks squeezed, cut; "untitled" if nothing is left."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)[^\w\s\-.()]", ""), r"(?U)\s+", " "))
    return F.when(t == "", "untitled").otherwise(F.substring(t, 1, length))


def epoch_to_iso(seconds: Column) -> Column:
    """ISO-8601 UTC of epoch seconds with its offset, and with microseconds where there are any; "" for null."""
    # Without a time zone, so the session's doesn't matter.
    at = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    parts = F.date_format(at, "SSSSSS")
    return F.coalesce(F.concat(whole, F.when(parts != "000000", F.concat(F.lit("."), parts)).otherwise(""), F.lit("+00:00")), F.lit(""))


def role_label(role: Column) -> Column:
    """The speaker of a transcript: the role in capitals, OTHER without one."""
    r = F.upper(F.trim(role))
    return F.when(r.isNull() | (r == ""), "OTHER").otherwise(r)


def week_label(ts: Column) -> Column:
    """The week from Monday to Sunday, as its first and last day."""
    first = F.to_date(F.date_trunc("week", ts))
    return F.concat_ws("/", F.date_format(first, "yyyy-MM-dd"), F.date_format(F.date_add(first, 6), "yyyy-MM-dd"))


def int_list(s: Column) -> Column:
    """All integers in a string."""
    return F.transform(F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))


def month_label(month: Column, year: bool = False) -> Column:
    """Jul, or Jul '25, of 2025-07; what is no month stays as it is."""
    day = F.try_to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd")
    return F.coalesce(F.date_format(day, "MMM ''yy" if year else "MMM"), month)


def trend_word(rho: Column) -> Column:
    """Wording of a rank correlation with time, by thresholds 0.1, 0.4 and 0.7 either way."""
    size = F.abs(rho)
    how = F.when(size >= 0.7, "strongly").when(size >= 0.4, "moderately").otherwise("slightly")
    return F.when(size >= 0.1, F.concat_ws(" ", how, F.when(rho > 0, "increasing").otherwise("decreasing"))).otherwise("stable")


def per(x: Column, n: Column) -> Column:
    """x over n, n counting as 1 at least."""
    return x / F.greatest(n, F.lit(1))


def share(x: Column, n: Column) -> Column:
    """x over n; null where n is 0."""
    return x / F.nullif(n, F.lit(0))
