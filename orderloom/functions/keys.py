"""Keys of names, tokens and other text functions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderloom.functions import lists
from orderloom.functions.nulls import col

#: Accented letters and what they read as.
ACCENTED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
SUFFIXES = r"\b(jr|sr|ii|iii|iv)\b"


def strip_accents(c: Column | str) -> Column:
    return F.translate(F.lower(col(c)), ACCENTED, PLAIN)


#: Letters that have no decomposition, and how they are written without them.
TRANSLITERATED = {"ı": "i", "İ": "I", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "Ae"}


def transliterated(c: Column | str) -> Column:
    """Letters without a decomposition written in plain ones."""
    one = {a: b for a, b in TRANSLITERATED.items() if len(b) == 1}
    out = F.translate(col(c), "".join(one), "".join(one.values()))
    for a, b in TRANSLITERATED.items():
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


def norm_key(c: Column | str) -> Column:
    """Letters of a name, lower case, without accents and generational suffixes."""
    return F.regexp_replace(F.regexp_replace(strip_accents(c), SUFFIXES, ""), "[^a-z]", "")


def spaced_key(c: Column | str) -> Column:
    """As norm_key, but words stay apart and suffixes stay."""
    return F.trim(F.regexp_replace(strip_accents(c), "[^a-z]+", " "))


def place_key(c: Column | str, stop: tuple[str, ...] = ("the", "of", "university", "college")) -> Column:
    words = F.regexp_replace(F.lower(col(c)), rf"\b({'|'.join(stop)})\b", "")
    return F.regexp_replace(F.regexp_replace(words, r"\bstate\b", "st"), "[^a-z]", "")


def positions(c: Column | str, part: str) -> Column:
    """Where a fixed text starts in another, from 0, each occurrence behind the one before."""
    ends = lists.running_totals(F.transform(F.split(col(c), rf"\Q{part}\E", -1), F.length))
    return lists.bound(ends, lambda e: F.transform(F.slice(e, F.lit(1), F.size(e) - 1), lambda at, i: at + len(part) * i))


def words(c: Column | str) -> Column:
    return F.filter(F.split(F.trim(col(c)), r"\s+"), lambda w: w != "")


def last_word(c: Column | str) -> Column:
    return F.try_element_at(words(c), F.lit(-1))


def ends_key(c: Column | str) -> Column:
    """First and last word."""
    return F.concat_ws(" ", F.get(words(c), F.lit(0)), last_word(c))


def flip_name(c: Column | str) -> Column:
    """``Last, First`` read as ``First Last``."""
    c = col(c)
    return F.when(c.contains(","), F.concat_ws(" ", F.trim(F.split_part(c, F.lit(","), F.lit(2))), F.trim(F.split_part(c, F.lit(","), F.lit(1))))).otherwise(c)


def similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, 0 for such as share nothing, by edit distance."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def feet_inches(c: Column | str) -> Column:
    """``6-10`` or ``6'10.5"`` in inches."""
    feet = F.regexp_extract(col(c), r"^(\d+)['-](\d+(?:\.\d+)?)", 1).try_cast("double")
    return feet * 12 + F.regexp_extract(col(c), r"^(\d+)['-](\d+(?:\.\d+)?)", 2).try_cast("double")


def made_attempted(c: Column | str) -> tuple[Column, Column]:
    """Both parts of ``12-25``."""
    return tuple(F.regexp_extract(col(c), r"^(\d+)-(\d+)$", k).try_cast("double") for k in (1, 2))


def percent(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("%"), F.lit("")).try_cast("double")


def season_end(c: Column | str) -> Column:
    """2014 for ``2013/14``."""
    return F.regexp_extract(col(c), r"^(\d{4})/\d{2}$", 1).try_cast("int") + 1


def any_date(c: Column | str, *formats: str) -> Column:
    return F.to_date(F.coalesce(*(F.try_to_timestamp(col(c), F.lit(f)) for f in formats)))


def years_between(a: Column, b: Column, year: float = 365.25) -> Column:
    """Age in years. year: days of a year, which differs by operator."""
    return F.datediff(b, a) / year


def lexicon_rate(c: Column | str, terms: tuple[str, ...]) -> tuple[Column, Column]:
    """(occurrences of any term, occurrences per 1000 words)."""
    n = F.regexp_count(F.lower(col(c)), F.lit(rf"(?<![a-z0-9_])({'|'.join(terms)})(?![a-z0-9_])"))
    return n, F.try_divide(1000.0 * n, F.size(words(c)).cast("double"))


def tone(good: Column, bad: Column) -> Column:
    return (good - bad) / (good + bad + 3)


def comparison(c: Column | str) -> Column:
    """The first name of a comparison: no parenthesis, no hedge, nothing behind a slash or an ``and``."""
    bare = F.regexp_replace(F.regexp_replace(col(c), r"\([^)]*\)", ""), r"(?i)\b(a )?(poor|rich) man's\b", "")
    return F.trim(F.get(F.split(bare, r"/|\band\b"), F.lit(0)))


def escape_html(c: Column | str) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fixed(c: Column | str) -> Column:
    """One decimal, a dash for missing; what rounds to zero has no sign."""
    x = col(c).cast("double")
    return F.when(x.isNull(), "—").when(F.abs(x) < 0.05, "0.0").otherwise(F.format_string("%.1f", x))


def signed(c: Column | str) -> Column:
    """As ``fixed``, with the sign always shown but at zero."""
    x = col(c).cast("double")
    return F.when(x.isNull(), "—").when(F.abs(x) < 0.05, "0.0").otherwise(F.format_string("%+.1f", x))


def ordinal_text(c: Column | str) -> Column:
    """``1st``, ``2nd``, ``11th``; a dash for missing."""
    n = col(c).cast("long")
    last, teens = F.abs(n) % 10, (F.abs(n) % 100).between(11, 13)
    end = F.when(teens, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.when(n.isNull(), "—").otherwise(F.concat(n.cast("string"), end))


def percent_text(c: Column | str) -> Column:
    """A share as a whole percentage; a dash for missing."""
    return F.when(col(c).isNull(), "—").otherwise(F.concat(F.format_string("%.0f", F.floor(col(c) * 100 + 0.5).cast("double")), F.lit("%")))


def whole_text(c: Column | str) -> Column:
    """A count with thousands set apart; a dash for missing."""
    return F.when(col(c).isNull(), "—").otherwise(F.format_number(col(c).cast("long"), 0))


def first_in_range(c: Column | str, patterns: tuple[str, ...], low: float, high: float) -> Column:
    """Number of the first pattern (two groups: feet and inches, or one group) that gives a plausible one."""
    found = []
    for p in patterns:
        one, two = (F.regexp_extract(col(c), p, i).try_cast("double") for i in (1, 2)) if p.count("(") - p.count("(?:") > 1 else (None, F.regexp_extract(col(c), p, 1).try_cast("double"))
        value = two if one is None else one * 12 + two
        found.append(F.when(value.between(low, high), value))
    return F.coalesce(*found)


def date_of(year: Column | str, month_day: Column | str) -> Column:
    """A date from a year and ``MM-DD``; NULL where there is none such."""
    return F.try_to_date(F.concat_ws("-", col(year).cast("string"), col(month_day)), "yyyy-MM-dd")


def birth_year(age: Column | str, on: Column | str) -> Column:
    """The likelier year of birth of who has a whole age on a day: before the middle of the year, the earlier one."""
    y = F.year(col(on)) - col(age)
    return F.when(F.month(col(on)) < 7, y - 1).otherwise(y)
