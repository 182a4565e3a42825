"""Columns over names: clean text, safe path components, file, folder and cover names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import decoded, path, unescape


def clean_text(text: Column) -> Column:
    """Plain quotes and dashes, single spaces, lists of names joined by "&", fractions by "-"."""
    t = F.translate(unescape(F.coalesce(text, F.lit(""))), " ’‘“”", " ''\"\"")
    t = F.regexp_replace(t, r"\s*[–—‒]\s*", " - ")
    t = F.regexp_replace(t, r"\s+/\s+", " & ")
    t = F.regexp_replace(t, r"(?<=\S)/(?=\S)", "-")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def safe_component(name: Column) -> Column:
    """One part of a path that all systems accept."""
    n = F.replace(F.replace(clean_text(name), F.lit(":"), F.lit(" -")), F.lit('"'), F.lit("'"))
    n = F.regexp_replace(n, r'[<>"/\\|?*\x00-\x1f]', "")
    n = F.regexp_replace(F.trim(F.regexp_replace(n, r"\s+", " ")), "[. ]+$", "")
    return F.regexp_replace(n, r"\A\z", "untitled")  # not by cases of n, which would compute it twice


def job_safe(name: Column) -> Column:
    n = F.regexp_replace(F.coalesce(name, F.lit("")), r'[<>:"/\\|?*]+', "_")
    n = F.regexp_replace(F.trim(n), "[. ]+$", "")
    return F.when(n == "", "release").otherwise(n)


def upload_name(url: Column) -> Column:
    return F.substring_index(path(url), "/", -1)


def upload_words(name: Column) -> Column:
    """Words of an upload name, entities and percent signs decoded, without its extension."""
    base = F.regexp_replace(unescape(decoded(name)), r"\.[^.]*\z", "")
    parted = F.regexp_replace(base, r"(?U)[\s_()\[\]]+|(?<!\w)-(?!\w)", "_")  # split compiles longer patterns for each row
    return F.array_remove(F.split(parted, "_"), "")


def url_words(url: Column) -> Column:
    return upload_words(upload_name(url))


def tape_of(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\btape\s*(\d+)", 1)


def side_of(text: Column) -> Column:
    return F.upper(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\bside\s*([A-Z0-9]+)\b", 1))


def file_name(i: Column, total: Column, title: Column, extension: Column) -> Column:
    """01 - title.ext, with as many digits as the total has."""
    width = F.greatest(F.lit(2), F.length(total.cast("string")))
    return F.concat(F.lpad(i.cast("string"), width, F.lit("0")), F.lit(" - "), safe_component(title), F.lit("."), F.lower(extension))


def folder_name(title: Column, year: Column) -> Column:
    """The title with the year behind it, unless it names that year: digits inside a longer number name none."""
    name = safe_component(title)
    named = F.contains(F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0)), " "), F.lit(" ")), F.concat(F.lit(" "), year, F.lit(" ")))
    return F.when((F.coalesce(year, F.lit("")) == "") | named, name).otherwise(F.concat(name, F.lit(" ("), year, F.lit(")")))


def release_title(artists: Column, name: Column) -> Column:
    who = F.array_join(artists, ", ")
    return F.concat(F.when(F.coalesce(who, F.lit("")) == "", "Unknown").otherwise(who), F.lit(" - "), name)


def cover_name(i: Column, url: Column) -> Column:
    """The first image is the cover; the others keep their upload name, made safe, under a number."""
    base = F.substring_index(path(url), "/", -1)
    ext = F.lower(F.substring_index(base, ".", -1))
    return F.when(i == 0, F.concat(F.lit("cover."), F.when(ext == "jpeg", "jpg").otherwise(ext))).otherwise(safe_component(F.concat(F.lit("artwork "), i.cast("string"), F.lit(" - "), base)))


def name_from_url(url: Column) -> Column:
    last = decoded(F.substring_index(F.regexp_replace(path(url), "/+$", ""), "/", -1))
    return F.when(F.coalesce(last, F.lit("")) == "", url).otherwise(last)


def labelled_year(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\byear\s*:\s*((?:19|20)\d\d)\b", 1)


def target_path(folder: Column, name: Column) -> Column:
    """Nested folders made safe, part by part."""
    parts = F.filter(F.split(F.coalesce(folder, F.lit("")), "/"), lambda p: (F.trim(p) != "") & (p != ".") & (p != ".."))
    return F.array_join(F.concat(F.transform(parts, safe_component), F.array(safe_component(name))), "/")
