"""The memory of what was handled: annotations, anti joins, upserts, and its reconciliation with a downstream snapshot.

Histories are far larger than a batch: joins are on file_key alone, so that a table bucketed by it shuffles no further.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from .dedupe import first_of, identified


def annotate(links: DataFrame, history: DataFrame) -> DataFrame:
    """links with seen_before, prior_state and prior_sent."""
    past = history.select("file_key", F.col("state").alias("prior_state"), F.col("first_sent").alias("prior_sent"), F.lit(True).alias("seen_before"))
    return links.join(past, "file_key", "left").withColumns({"seen_before": F.coalesce("seen_before", F.lit(False)), "prior_state": F.coalesce("prior_state", F.lit(""))})


def fresh(links: DataFrame, history: DataFrame) -> DataFrame:
    return links.join(history, "file_key", "left_anti")


def items_with(items: DataFrame, links: DataFrame) -> DataFrame:
    """Items that still have a link."""
    return items.join(links, "item_id", "left_semi")


def done_releases(release_files: DataFrame, history: DataFrame, release: str = "release_url") -> DataFrame:
    """Releases (lower-cased, without closing slash) with at least one file, all of whose files are in the history."""
    files = release_files.where("file_key is not null").select(U.plain_key(F.col(release)).alias("release"), "file_key").distinct()
    known = files.join(history.select("file_key", F.lit(True).alias("known")), "file_key", "left")
    return known.groupBy("release").agg(F.count("*").alias("files"), F.count("known").alias("known")).where("files = known").select("release", "files")


def skip_done(candidates: DataFrame, done: DataFrame) -> DataFrame:
    return candidates.withColumn("release", U.plain_key(F.col("url"))).join(done, "release", "left_anti")


def caught_up(pages: DataFrame, direct: DataFrame, candidates: DataFrame, done: DataFrame) -> DataFrame:
    """page, caught_up: no download on it, at least one candidate, and all candidates done."""
    judged = candidates.withColumn("release", U.plain_key(F.col("url"))).join(done.select("release", F.lit(True).alias("is_done")), "release", "left")
    by_page = judged.groupBy("page").agg(F.bool_and(F.coalesce("is_done", F.lit(False))).alias("all_done"))
    with_direct = direct.select("page").distinct().withColumn("has_direct", F.lit(True))
    out = pages.select("page").join(by_page, "page", "left").join(with_direct, "page", "left")
    return out.select("page", (F.col("has_direct").isNull() & F.coalesce("all_done", F.lit(False))).alias("caught_up"))


def snapshot_keys(snapshot: DataFrame) -> DataFrame:
    """file_key, offline of the snapshot's urls on known hosts; a file is offline if one of its entries says so."""
    known = identified(snapshot.where(U.is_known_file_host(F.col("url"))))
    return known.groupBy(F.coalesce("file_key", U.plain_key(F.col("url"))).alias("file_key")).agg(F.bool_or(F.col("availability") == "OFFLINE").alias("offline"))


def reconcile(history: DataFrame, snapshot: DataFrame, newest: int | None = 5000) -> DataFrame:
    """history with new states: present files are confirmed, confirmed ones that are absent or offline are gone.

    Only the newest rows are looked at (None: all); the others keep their state.
    """
    keys = snapshot_keys(snapshot).withColumn("present", F.lit(True))
    looked = history
    if newest is not None:
        looked = history.orderBy(F.desc("last_seen"), "file_key").limit(newest)
    met = looked.join(keys, "file_key", "left")
    state = F.when(F.coalesce("offline", F.lit(False)), "gone").when(F.col("present") & (F.col("state") != "in_jd"), "in_jd").when(F.col("present").isNull() & (F.col("state") == "in_jd"), "gone").otherwise(F.col("state"))
    out = met.withColumn("state", state).select(history.columns)
    return out if newest is None else out.unionByName(history.join(looked.select("file_key"), "file_key", "left_anti"))


def remove_packages(snapshot: DataFrame, packages: DataFrame, names: DataFrame) -> DataFrame:
    """Links of the packages with the given names."""
    return snapshot.join(packages.join(names, "package", "left_semi"), "package_id", "left_semi")


def drop_offline(snapshot: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The snapshot without dead links, the history without their files."""
    dead = snapshot_keys(snapshot).where("offline").select("file_key")
    return snapshot.where("availability is null or availability <> 'OFFLINE'"), history.join(dead, "file_key", "left_anti")


def completeness(wanted: DataFrame, collected: DataFrame, age_s: str | None = None, patience_s: int = 900) -> DataFrame:
    """package, found, wanted, complete: all names of a package have come in, or it has been waited for long enough.

    age_s: a column of wanted with the seconds that a package has been waited for."""
    came = collected.select(U.echo_key(F.col("url")).alias("key")).distinct().withColumn("came", F.lit(True))
    met = wanted.withColumn("key", U.echo_key(F.col("url"))).join(came, "key", "left")
    out = met.groupBy("package").agg(F.count("came").alias("found"), F.count("*").alias("wanted"), F.max(F.col(age_s) if age_s else F.lit(0)).alias("_age"))
    return out.withColumn("complete", (F.col("found") == F.col("wanted")) | F.coalesce(F.col("_age") >= patience_s, F.lit(False))).drop("_age")


def record_sent(history: DataFrame, batch: DataFrame) -> DataFrame:
    """The history after a batch (file_key, url, package, sent): a new snapshot by a full outer join.

    A known file keeps its state, url and first sending; last_seen is the latest, a package that isn't empty replaces the
    older one. Rows whose key is their plain url are no identities, and left out. Repeats apply in order of `sent`.
    """
    real = batch.where(F.col("file_key").isNotNull() & (F.col("file_key") != U.plain_key(F.col("url"))))
    new = real.groupBy("file_key").agg(
        F.min_by("url", "sent").alias("n_url"), F.min("sent").alias("n_first"), F.max("sent").alias("n_last"), F.max_by("package", F.when(F.coalesce("package", F.lit("")) != "", F.col("sent"))).alias("n_package")
    )
    met = history.join(new, "file_key", "full_outer")
    return met.select(
        "file_key", F.coalesce("url", "n_url").alias("url"), F.coalesce("state", F.lit("sent")).alias("state"), F.coalesce("n_package", "package").alias("package"), F.coalesce("first_sent", "n_first").alias("first_sent"), F.coalesce("n_last", "last_seen").alias("last_seen")
    )


def mark(history: DataFrame, keys: DataFrame, state: str) -> DataFrame:
    met = history.join(keys.select("file_key").distinct().withColumn("_hit", F.lit(True)), "file_key", "left")
    return met.withColumn("state", F.when(F.col("_hit"), state).otherwise(F.col("state"))).drop("_hit")


def forget(history: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return history.where("false") if keys is None else history.join(keys, "file_key", "left_anti")


def remember_releases(release_files: DataFrame, release: str = "release_url", stored: DataFrame | None = None) -> DataFrame:
    """release, keys: sorted distinct keys of each release; releases without keys are skipped. A release that is met again
    replaces the stored one (release, keys)."""
    new = release_files.where("file_key is not null").groupBy(F.col(release).alias("release")).agg(F.array_sort(F.collect_set("file_key")).alias("keys"))
    return new if stored is None else stored.select("release", "keys").join(new, "release", "left_anti").unionByName(new)


def insert_or_ignore(existing: DataFrame, new: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """existing, and of each key that it lacks the first new row."""
    return existing.unionByName(first_of(new.join(existing, by, "left_anti"), by, order).select(existing.columns))


def latest(rows: DataFrame, by: str, at: str) -> DataFrame:
    """The latest row of each key."""
    rest = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("r")).select(by, "r.*")


def changed_pages(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """pages that aren't as the cache (url, hash, maybe etag and last_modified) has them.

    Validators decide where page and cache both have one, the etag before the date; the content's hash does elsewhere.
    """
    validators = [c for c in ("etag", "last_modified") if c in pages.columns and c in cache.columns]
    past = cache.select("url", F.col("hash").alias("_hash"), *[F.nullif(F.col(c), F.lit("")).alias(f"_{c}") for c in validators])
    now = pages.withColumn("hash", F.xxhash64("html"))
    same = F.coalesce(*[F.nullif(F.col(c), F.lit("")) == F.col(f"_{c}") for c in validators], F.col("hash").eqNullSafe(F.col("_hash")))
    return now.join(past, "url", "left").where(~same).drop("_hash", *[f"_{c}" for c in validators])


def retry_state(outcome, code, tries):
    """The next state of a download: done, failed for good, or queued again."""
    return F.when(outcome == "ok", "done").when(outcome == "stopped", "queued").when((tries >= 6) | code.isin(404, 410), "failed").otherwise("queued")


def retry_failed(downloads: DataFrame) -> DataFrame:
    """downloads (state, tries, error, whatever else) with the failed ones queued as if never tried."""
    failed = F.col("state").eqNullSafe("failed")
    return downloads.withColumns({"tries": F.when(failed, 0).otherwise(F.col("tries")), "error": F.when(failed, "").otherwise(F.col("error")), "state": F.when(failed, "queued").otherwise(F.col("state"))})


def without_files(items: DataFrame, links: DataFrame) -> DataFrame:
    """Items none of whose links names a file."""
    return items.join(links.where("file_key is not null"), "item_id", "left_anti")


def participated(posts: DataFrame, author) -> DataFrame:
    """topic_id of the topics that an author has posted in."""
    return posts.where(F.col("author") == author).select("topic_id").distinct()


def not_in_baseline(rows: DataFrame, baseline: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(baseline, by, "left_anti")


def newest_first(rows: DataFrame, at: str, ties: list[str], most: int, where: str | None = None) -> DataFrame:
    """The last `most` rows by `at`, newest first; no full sort."""
    return (rows if where is None else rows.where(where)).orderBy(F.desc(at), *ties).limit(most)


def tail(rows: DataFrame, at: str, most: int, where: str | None = None) -> DataFrame:
    """The last `most` rows by `at`, oldest first."""
    return newest_first(rows, at, [], most, where).orderBy(at)


def pending_first(rows: DataFrame, ids: str, most: int) -> DataFrame:
    return rows.orderBy(F.when(F.col("state") == "pending", 0).otherwise(1), ids).limit(most)


def watch_list(watches: DataFrame) -> DataFrame:
    return watches.orderBy("store", "name")
