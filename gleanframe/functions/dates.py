"""Columns over written dates, and the window of dates that a crawl keeps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the months, as boards print them.
MONTHS = (
    ("jan", "january", "janv", "janvier", "ene", "enero", "gen"),
    ("feb", "february", "febrero", "févr", "fevr", "février", "fevrier", "fev"),
    ("mar", "march", "marzo", "mars"),
    ("apr", "april", "abr", "abril", "avr", "avril"),
    ("may", "mayo", "mai", "mag"),
    ("jun", "june", "junio", "juin", "giu"),
    ("jul", "july", "julio", "juil", "juillet", "lug"),
    ("aug", "august", "ago", "agosto", "août", "aout"),
    ("sep", "sept", "september", "septiembre", "setiembre", "septembre", "set"),
    ("oct", "october", "octubre", "octobre", "ott", "out"),
    ("nov", "november", "noviembre", "novembre"),
    ("dec", "december", "dic", "diciembre", "déc", "décembre", "decembre", "dez"),
)
TODAY = r"(?iu)\b(?:hoy|today|aujourd'hui|oggi|hoje)\b"
YESTERDAY = r"(?iu)\b(?:ayer|yesterday|hier|ieri|ontem)\b"
_MONTH = "|".join(sorted((m for names in MONTHS for m in names), key=lambda m: (-len(m), m)))
_ISO = r"\b((?:20|19)\d\d)-(\d\d)-(\d\d)(?!\d)"
_DMY = r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})\b"
_D_MON_Y = rf"(?iu)\b(\d{{1,2}})(?:\s+de)?\s+({_MONTH})\.?(?:\s+de)?,?\s+(\d{{4}})\b"
_MON_D_Y = rf"(?iu)\b({_MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b"


def _month(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, names in enumerate(MONTHS):
        out = F.when(F.lower(name).isin(*names), i + 1).otherwise(out)
    return out


def _date(year: Column, month: Column, day: Column) -> Column:
    """Null if there is no such day. Years of two digits are of 1970 to 2069."""
    y = F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year)
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), month.cast("string"), day.cast("string")), "yyyy-M-d")


def parse_date(text: Column, as_of: Column) -> Column:
    """The first date written in a text. The first pattern that matches decides, even if its date doesn't exist."""
    t = F.coalesce(text, F.lit(""))
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    number = lambda pattern, i: F.when(part(pattern, i) != "", part(pattern, i)).cast("int")
    return (
        F.when(t.rlike(TODAY), as_of)
        .when(t.rlike(YESTERDAY), F.date_sub(as_of, 1))
        .when(t.rlike(_ISO), _date(number(_ISO, 1), number(_ISO, 2), number(_ISO, 3)))
        .when(t.rlike(_D_MON_Y), _date(number(_D_MON_Y, 3), _month(part(_D_MON_Y, 2)), number(_D_MON_Y, 1)))
        .when(t.rlike(_MON_D_Y), _date(number(_MON_D_Y, 3), _month(part(_MON_D_Y, 1)), number(_MON_D_Y, 2)))
        .when(t.rlike(_DMY), _date(number(_DMY, 3), number(_DMY, 2), number(_DMY, 1)))
    )


def all_dates(text: Column, as_of: Column) -> Column:
    """Every numeric date of a text, and the relative ones; an array without nulls."""
    t = F.coalesce(text, F.lit(""))
    one = lambda found, pattern, y, m, d: F.transform(found, lambda x: _date(*[F.regexp_extract(x, pattern, i).cast("int") for i in (y, m, d)]))
    iso = one(F.regexp_extract_all(t, F.lit(_ISO), F.lit(0)), _ISO.replace(r"(?!\d)", ""), 1, 2, 3)
    dmy = one(F.regexp_extract_all(t, F.lit(_DMY), F.lit(0)), _DMY, 3, 2, 1)
    said = F.array(F.when(t.rlike(TODAY), as_of), F.when(t.rlike(YESTERDAY), F.date_sub(as_of, 1)))
    return F.filter(F.concat(iso, dmy, said), lambda d: d.isNotNull())


def newest(text: Column, as_of: Column) -> Column:
    return F.array_max(all_dates(text, as_of))


def cutoff(as_of: Column, months: Column) -> Column:
    """The day on which a window of so many months begins; null without a limit. Short months are clamped."""
    return F.when(months > 0, F.add_months(as_of, -months))


def too_old(day: Column, since: Column) -> Column:
    """Known to be before the window; what isn't known isn't old."""
    return F.coalesce(day < since, F.lit(False))
