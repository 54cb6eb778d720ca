"""Export manifests as pure functions: old table and change in, new table out.

A manifest has one row per time window or per controller, far fewer rows than the readings it
describes, and its keys are unique, so joins between manifests are left to Spark. Every change takes
the time as an explicit ``as_of`` text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.functions.times import HOUR_MS
from tidemark.operators.joins import inserted, latest_by_key, touched, upsert

# States of a rolling CSV file.
PENDING, UPLOADED, UPLOAD_FAILED = "Pending", "Uploaded", "UploadFailed"
# Outcomes of an upload attempt, as handed in by whatever moves the files.
OK, FAILED, MISSING = "ok", "failed", "missing"


# Parquet windows

def partition_records(stats: DataFrame, site: str, hours: int) -> DataFrame:
    """What an export of the windows in ``stats`` adds to the manifest."""
    return stats.select(
        "partition_start", F.lit(hours).alias("partition_hours"),
        names.partition_file(F.lit(site), F.col("partition_start")).alias("file_name"),
        "row_count", "max_reading_id",
    )


def record_partitions(manifest: DataFrame, records: DataFrame, as_of: str) -> DataFrame:
    """Add exported windows; exporting a window again makes it pending again."""
    new = records.select(
        *[c for c in manifest.columns if c in records.columns], F.lit(as_of).alias("exported_at"),
        F.lit(None).cast("string").alias("uploaded_at"), F.lit(0).alias("local_deleted"),
    )
    return upsert(manifest, new, ["partition_start"], {})


def _is_pending() -> Column:
    return F.col("uploaded_at").isNull() & (F.col("local_deleted") == 0)


def pending_partitions(manifest: DataFrame) -> DataFrame:
    return (
        manifest.filter(_is_pending())
        .select("partition_start", "file_name", "max_reading_id").orderBy("partition_start")
    )


def kept_partitions(manifest: DataFrame, cutoff_ms: int) -> DataFrame:
    """Uploaded windows whose files are still here although they start before the cutoff."""
    old = F.col("uploaded_at").isNotNull() & (F.col("local_deleted") == 0) & (F.col("partition_start") < cutoff_ms)
    return manifest.filter(old).select("partition_start", "file_name").orderBy("partition_start")


def overlapping_partitions(manifest: DataFrame) -> DataFrame:
    """Windows that share an hour with another one, as happens after the window size was changed."""
    hour = F.explode(F.transform(F.sequence(F.lit(0), F.col("partition_hours") - 1), lambda n: F.col("partition_start") + n * HOUR_MS))
    hours = manifest.select("partition_start", "partition_hours", hour.alias("_hour"))
    shared = hours.groupBy("_hour").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    return hours.join(shared, "_hour", "left_semi").select("partition_start", "partition_hours").distinct()


def mark_partitions_uploaded(manifest: DataFrame, starts: DataFrame, as_of: str) -> DataFrame:
    return _mark(manifest, starts, "partition_start", {"uploaded_at": F.lit(as_of)})


def mark_partitions_deleted(manifest: DataFrame, starts: DataFrame) -> DataFrame:
    return _mark(manifest, starts, "partition_start", {"local_deleted": F.lit(1)})


def _mark(table: DataFrame, keys: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    hits = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    marked = table.join(hits, key, "left")
    for column, value in values.items():
        kind = table.schema[column].dataType
        marked = marked.withColumn(column, F.when(F.col("_hit"), value.cast(kind)).otherwise(F.col(column)))
    return marked.select(*table.columns)


def cleanup_kept(manifest: DataFrame, cutoff_ms: int | None) -> DataFrame:
    """Mark kept files past retention as deleted; without a cutoff everything is kept."""
    return manifest if cutoff_ms is None else mark_partitions_deleted(manifest, kept_partitions(manifest, cutoff_ms))


def _with_attempts(table: DataFrame, outcomes: DataFrame, pending: Column, order: str) -> DataFrame:
    """Add ``_outcome``: what happened to each pending file, null for those after the first failure.

    Of several outcomes for one file the newest by ``at`` counts; an outcome without a time is the oldest,
    and of equal times a failure counts before anything else.
    """
    rank = F.struct(F.col("at").isNotNull().alias("dated"), "at", (F.col("outcome") == FAILED).alias("bad"), "outcome")
    newest = latest_by_key(outcomes.select("file_name", "outcome", rank.alias("_rank")), ["file_name"], "_rank")
    joined = table.join(newest.select("file_name", F.col("outcome").alias("_outcome")), "file_name", "left")
    first_failure = joined.filter(pending & (F.col("_outcome") == FAILED)).agg(F.min(order)).first()[0]
    tried = pending if first_failure is None else pending & (F.col(order) <= first_failure)
    return joined.withColumn("_outcome", F.when(tried, F.col("_outcome")))


def apply_partition_outcomes(manifest: DataFrame, outcomes: DataFrame, as_of: str, keep: bool) -> DataFrame:
    """Mark what an upload cycle achieved.

    Windows go in time order and stop at the first failure. A missing file is written off so that
    it is not tried again. Without ``keep`` an uploaded file is deleted.
    """
    tried = _with_attempts(manifest, outcomes, _is_pending(), "partition_start")
    gone = F.col("_outcome").isin([MISSING] if keep else [MISSING, OK])
    return (
        tried.withColumn("uploaded_at", F.when(F.col("_outcome") == OK, F.lit(as_of)).otherwise(F.col("uploaded_at")))
        .withColumn("local_deleted", F.when(gone, F.lit(1)).otherwise(F.col("local_deleted")))
        .select(*manifest.columns)
    )


# Rolling CSV files

def export_records(stats: DataFrame, site: str, directory: str) -> DataFrame:
    """``file_path`` is the folder that holds the controller's files."""
    file_name = names.rolling_csv_file(F.lit(site), F.col("plc_name"))
    folder = F.concat(F.lit(f"{directory}/plc="), names.folder_name(F.col("plc_name")))
    return stats.select(
        "plc_id", file_name.alias("file_name"), folder.alias("file_path"),
        F.col("max_reading_id").alias("last_reading_id"), "row_count",
    )


def record_exports(state: DataFrame, records: DataFrame, as_of: str) -> DataFrame:
    """Record freshly written files; a file that moved past its last upload becomes pending."""
    new = records.select(
        "plc_id", "file_name", "file_path", "last_reading_id", "row_count", F.lit(as_of).alias("exported_at"),
        F.lit(0).cast("long").alias("uploaded_reading_id"), F.lit(None).cast("string").alias("uploaded_at"),
        F.lit(PENDING).alias("status"),
    )
    fresh = F.when(F.col("n.last_reading_id") > 0, F.lit(PENDING)).otherwise(F.lit(UPLOADED))
    moved = F.col("n.last_reading_id") > F.col("o.uploaded_reading_id")
    rules = {
        "uploaded_reading_id": F.coalesce("o.uploaded_reading_id", "n.uploaded_reading_id"),
        "uploaded_at": F.col("o.uploaded_at"),
        "status": F.when(inserted(), fresh).when(touched() & moved, F.lit(PENDING)).otherwise(F.col("o.status")),
    }
    return upsert(state, new, ["plc_id"], rules)


def _is_due() -> Column:
    return (F.col("last_reading_id") > F.col("uploaded_reading_id")) | (F.col("status") == UPLOAD_FAILED)


def pending_uploads(state: DataFrame) -> DataFrame:
    return (
        state.filter(_is_due())
        .select("plc_id", "file_name", "file_path", "last_reading_id").orderBy("plc_id")
    )


def mark_uploaded(state: DataFrame, sent: DataFrame, as_of: str) -> DataFrame:
    """``sent``: plc_id and the reading id its uploaded file reached (last_reading_id)."""
    hits = sent.select("plc_id", F.col("last_reading_id").alias("_reached"))
    marked = state.join(hits, "plc_id", "left")
    hit = F.col("_reached").isNotNull()
    return (
        marked.withColumn("status", F.when(hit, F.lit(UPLOADED)).otherwise(F.col("status")))
        .withColumn("uploaded_reading_id", F.coalesce("_reached", "uploaded_reading_id"))
        .withColumn("uploaded_at", F.when(hit, F.lit(as_of)).otherwise(F.col("uploaded_at")))
        .select(*state.columns)
    )


def mark_upload_failed(state: DataFrame, failed: DataFrame) -> DataFrame:
    return _mark(state, failed, "plc_id", {"status": F.lit(UPLOAD_FAILED)})


def apply_export_outcomes(state: DataFrame, outcomes: DataFrame, as_of: str) -> DataFrame:
    """Uploads go in controller order and stop at the first failure; missing files are passed over."""
    tried = _with_attempts(state, outcomes, _is_due(), "plc_id")
    sent, failed = F.col("_outcome") == OK, F.col("_outcome") == FAILED
    return (
        tried.withColumn("status", F.when(sent, F.lit(UPLOADED)).when(failed, F.lit(UPLOAD_FAILED)).otherwise(F.col("status")))
        .withColumn("uploaded_reading_id", F.when(sent, F.col("last_reading_id")).otherwise(F.col("uploaded_reading_id")))
        .withColumn("uploaded_at", F.when(sent, F.lit(as_of)).otherwise(F.col("uploaded_at")))
        .select(*state.columns)
    )


# Merging

def merge_changed(current: DataFrame, before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``current`` with the rows that a job changed from ``before`` to ``after``.

    What others wrote meanwhile stays, also to the same key if it was exported later than the job's own row.
    """
    rest = [c for c in after.columns if c != key]
    known = before.select(key, F.struct(*rest).alias("_known"))
    changed = after.join(known, key, "left").filter(~F.col("_known").eqNullSafe(F.struct(*rest))).drop("_known")
    mine = inserted() | (touched() & (F.coalesce("n.exported_at", F.lit("")) >= F.coalesce("o.exported_at", F.lit(""))))
    return upsert(current, changed, [key], {c: F.when(mine, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in rest})


# Settings

def put_setting(settings: DataFrame, key: str, value: int) -> DataFrame:
    new = settings.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(str(value)).alias("value"))
    return settings.filter(F.col("key") != key).unionByName(new)
