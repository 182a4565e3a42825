"""Columns over titles and file names: lossless, lossy, request; and the verdict on a release's files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import host_only

# Words of formats and requests.
LOSSLESS = r"(?i)(?<![a-z0-9])(?:flac|wav|wave|lossless|aiff?|alac|ape|wv|dsd)(?![a-z0-9])"
LOSSY = r"(?i)(?<![a-z0-9])(?:lossy|mp3|aac|m4a|ogg|opus|\d{3}\s*kbps)(?![a-z0-9])"
REQUEST = r"(?i)(?<![a-z0-9])(?:peticion(?:es)?|se[\s-]+buscan?|busco|request(?:s|ed)?)(?![a-z0-9])"
LOSSLESS_FILE = r"(?i)\.(flac|wav|aiff?|ape|wv|dsf|dff|alac)$"
LOSSY_FILE = r"(?i)\.(mp3|m4a|aac|ogg|opus|wma)$"
LOSSLESS_TEXT = r"(?i)(?<![a-z0-9])(flac|wav|wave|lossless|aiff?|ape)(?![a-z0-9])"
LOSSY_TEXT = r"(?i)(?<![a-z0-9])(mp3|\d{3}\s*kbps|aac|lossy)(?![a-z0-9])"


def looks_lossless(title: Column) -> Column:
    return title.rlike(LOSSLESS) & ~title.rlike(LOSSY) & ~title.rlike(REQUEST)


def looks_lossy(title: Column) -> Column:
    return title.rlike(REQUEST) | (title.rlike(LOSSY) & ~title.rlike(LOSSLESS))


def verdict(names: Column, text: Column) -> Column:
    """From the files' names if they tell; else, with a question mark, from the words around."""
    known = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n.isNotNull() & (n != "") & (n != "?"))
    lossless = F.size(F.filter(known, lambda n: n.rlike(LOSSLESS_FILE)))
    lossy = F.size(F.filter(known, lambda n: n.rlike(LOSSY_FILE)))
    blob = F.concat_ws(" ", F.array_join(known, " "), F.coalesce(text, F.lit("")))
    return (
        F.when(lossless + lossy > 0, F.when(lossless >= lossy, "lossless").otherwise("lossy"))
        .when(blob.rlike(LOSSLESS_TEXT) & ~blob.rlike(LOSSY_TEXT), "lossless?")
        .when(blob.rlike(LOSSY_TEXT), "lossy?")
        .otherwise("unknown")
    )


def keep(alive: Column, verdict_: Column) -> Column:
    """Dropped is what a host proves to be dead, or by its files to be lossy."""
    return ~alive.eqNullSafe(False) & (verdict_ != "lossy")


# Hosts whose links can be looked up.
CHECKABLE = ("mega.nz", "mega.co.nz", "mediafire.com", "pixeldrain.com", "swisstransfer.com", "rapidgator.net", "rg.to")


def checkable(url: Column) -> Column:
    """Whether a link's host can tell if its file is there; all others stay unknown."""
    return host_only(url).isin(*CHECKABLE)
