"""The file hosts that links may lead to: a small dimension, one row for each domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Key, domains (the first is the main one), label, premium, how urls are reduced, prefix of identities.
HOSTS = (
    ("rapidgator", ("rapidgator.net",), "Rapidgator", True, "rapidgator", "rapidgator"),
    ("nitroflare", ("nitroflare.com",), "Nitroflare", True, "plain", "nitroflare.com"),
    ("ddownload", ("ddownload.com",), "DDownload", True, "plain", "ddownload.com"),
    ("katfile", ("katfile.com",), "Katfile", True, "plain", "katfile.com"),
    ("turbobit", ("turbobit.net",), "Turbobit", True, "plain", "turbobit.net"),
    ("hitfile", ("hitfile.net",), "HitFile", True, "plain", "hitfile.net"),
    ("uploadgig", ("uploadgig.com",), "UploadGig", True, "plain", "uploadgig.com"),
    ("fikper", ("fikper.com",), "Fikper", True, "plain", "fikper.com"),
    ("onefichier", ("1fichier.com",), "1fichier", True, "plain", "1fichier.com"),
    ("mega", ("mega.nz", "mega.co.nz"), "MEGA", False, "mega", "mega"),
    ("mediafire", ("mediafire.com",), "MediaFire", False, "plain", "mediafire.com"),
    ("pixeldrain", ("pixeldrain.com",), "Pixeldrain", False, "plain", "pixeldrain.com"),
    ("gofile", ("gofile.io",), "GoFile", False, "plain", "gofile.io"),
    ("gdrive", ("drive.google.com", "docs.google.com", "drive.usercontent.google.com"), "Google Drive", False, "gdrive", "gdrive"),
    ("terabox", ("terabox.com", "1024terabox.com", "teraboxapp.com", "terabox.app", "1024tera.com", "freeterabox.com", "4funbox.com", "mirrobox.com", "nephobox.com", "momerybox.com", "tibibox.com", "teraboxlink.com", "terasharelink.com"), "TeraBox", False, "plain", "terabox"),
    ("dropbox", ("dropbox.com", "db.tt"), "Dropbox", False, "plain", "dropbox.com"),
    ("onedrive", ("onedrive.live.com", "1drv.ms"), "OneDrive", False, "plain", "onedrive"),
    ("pcloud", ("u.pcloud.link", "e.pcloud.link", "pcloud.com"), "pCloud", False, "plain", "pcloud"),
    ("yandex", ("disk.yandex.com", "disk.yandex.ru", "yadi.sk", "disk.360.yandex.ru"), "Yandex Disk", False, "plain", "yandex"),
    ("workupload", ("workupload.com",), "Workupload", False, "plain", "workupload.com"),
    ("krakenfiles", ("krakenfiles.com",), "KrakenFiles", False, "plain", "krakenfiles.com"),
    ("sendcm", ("send.cm",), "Send.cm", False, "plain", "send.cm"),
    ("wetransfer", ("wetransfer.com", "we.tl"), "WeTransfer", False, "plain", "wetransfer"),
    ("swisstransfer", ("swisstransfer.com",), "SwissTransfer", False, "plain", "swisstransfer.com"),
    ("transferit", ("transfer.it",), "Transfer.it", False, "plain", "transfer.it"),
    ("transfernow", ("transfernow.net",), "TransferNow", False, "plain", "transfernow.net"),
    ("opendrive", ("od.lk", "opendrive.com"), "OpenDrive", False, "plain", "od.lk"),
    ("ravetapepacks", ("ravetapepacks.com",), "Rave Tape Packs", False, "site", "ravetapepacks.com"),
)
# Folders and extensions of files on sites that host their own.
SITE_DIRS = {"ravetapepacks.com": ("/music/", "/wp-content/uploads/")}
SITE_EXTENSIONS = ("mp3", "flac", "wav", "aiff", "aif", "ogg", "m4a", "opus", "zip", "rar", "7z", "jpg", "jpeg", "png", "gif", "webp")


def enabled_hosts(wanted: str | None = None) -> tuple[str, ...]:
    """Keys of the hosts to harvest: "all", "cloud" (needing no premium account, and the first), or a list of keys.

    Unknown keys are ignored; nothing left means the first host.
    """
    known, wanted = [h[0] for h in HOSTS], (wanted or "").strip().lower()
    if wanted == "all":
        return tuple(known)
    if wanted == "cloud":
        return (known[0], *(h[0] for h in HOSTS if not h[3]))
    return tuple(k for k in (w.strip() for w in wanted.split(",")) if k in known) or (known[0],)


def domains(keys: tuple[str, ...] | None = None) -> list[str]:
    return [d for h in HOSTS if keys is None or h[0] in keys for d in h[1]]


def host_table(spark: SparkSession) -> DataFrame:
    """key, domain, alias, label, premium, reducer, prefix: some fifty rows, to be broadcast."""
    rows = [(h[0], h[1][0], d, *h[2:]) for h in HOSTS for d in h[1]]
    return spark.createDataFrame(rows, "key string, domain string, alias string, label string, premium boolean, reducer string, prefix string")


def with_label(links: DataFrame, host: str = "host", bucket: str = "bucket") -> DataFrame:
    """links with a display label: the host's, or the bucket."""
    names = host_table(links.sparkSession).select(F.col("alias").alias(host), F.col("label").alias("_label"))
    return links.join(F.broadcast(names), host, "left").withColumn("label", F.coalesce("_label", bucket)).drop("_label")


def by_domain(field: str, keys: tuple[str, ...] | None = None) -> Column:
    """A map of constants from each host's domains to a field of the host."""
    at = {"label": 2, "premium": 3, "reducer": 4, "prefix": 5}[field]
    pairs = [F.lit(x) for h in HOSTS if keys is None or h[0] in keys for d in h[1] for x in (d, h[at])]
    return F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.lit(None).cast("string"))


def prefix_of(host: Column) -> Column:
    """The identity prefix of a host; null if it isn't known."""
    return by_domain("prefix")[host]
