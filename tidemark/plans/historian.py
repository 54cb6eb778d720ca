"""One folder that holds a fleet's history, and the jobs a user runs on it.

Layout: ``readings`` by date, ``tables/<name>/version=N`` for the state tables, ``feeds/selection`` for the changes of
the tags that streams follow, ``partitions`` for exported windows, ``csv`` for rolling CSV files, ``windows-csv`` and ``snapshots`` for one-off copies.
Every job reads the newest complete version of what it needs and writes the next one; the last fifty
versions of a table are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import schemas
from tidemark.functions import times
from tidemark.operators import aggregates, health, manifests, registry, scans
from tidemark.plans import exports, fleet, retention
from tidemark.session import configure
from tidemark.sinks import state
from tidemark.sources import inputs
from tidemark.streaming import jobs

TABLES = {
    "plcs": schemas.PLCS, "tags": schemas.TAGS, "parquet_partitions": schemas.PARTITIONS,
    "export_state": schemas.EXPORT_STATE, "settings": schemas.SETTINGS,
}


class Historian:
    def __init__(self, spark: SparkSession, root: str, site: str = "Site"):
        self.spark, self.root, self.site = configure(spark), root.rstrip("/"), site

    # Tables

    def table(self, name: str) -> DataFrame:
        return state.read_latest(self.spark, f"{self.root}/tables/{name}", TABLES[name])

    def change(self, name: str, change: Callable[[DataFrame], DataFrame]) -> int:
        """Replace a table by a change of its newest version; no other writer's change is lost."""
        folder = f"{self.root}/tables/{name}"
        version = state.update(self.spark, folder, TABLES[name], change)
        state.drop_old_versions(self.spark, folder, keep=50)
        if name == "tags":
            self.publish_selection()
        return version

    def save(self, name: str, table: DataFrame) -> int:
        return self.change(name, lambda _: table)

    def put_setting(self, key: str, value: int) -> None:
        """Set one key and leave the others as they are now."""
        self.change("settings", lambda settings: manifests.put_setting(settings, key, value))

    def readings(self) -> DataFrame:
        path = f"{self.root}/readings"
        if not state.exists(self.spark, path):
            return self.spark.createDataFrame([], schemas.READINGS)
        return inputs.readings(self.spark, path)

    def register_views(self) -> None:
        """Name the tables for ``spark.sql``: readings, plcs, tags and the manifests."""
        self.readings().createOrReplaceTempView("readings")
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)

    def _dims(self) -> tuple[DataFrame, DataFrame]:
        return self.table("tags"), self.table("plcs")

    # Registry

    def upsert_plcs(self, incoming: DataFrame) -> None:
        self.change("plcs", lambda plcs: registry.upsert_plcs(plcs, incoming))

    def sync_discovery(self, edges: DataFrame, as_of_ms: int, namespaces=None, tokens=None) -> None:
        plcs, as_of = self.table("plcs"), times.ms_to_iso(as_of_ms)
        self.change("tags", lambda tags: fleet.discovery_sync(edges, tags, plcs, as_of, namespaces, tokens))

    def set_tags_enabled(self, saved: DataFrame, chosen: DataFrame) -> None:
        self.change("tags", lambda tags: registry.set_tags_enabled(tags, saved, chosen))

    def toggle_subtree(self, folder: str, on: bool, plc_id: int | None = None) -> None:
        self.change("tags", lambda tags: registry.toggle_subtree(tags, folder, on, plc_id))

    # Ingest

    def publish_selection(self) -> None:
        """Append what changed in the selection to the feed that running streams read.

        Compared is with what the feed says itself, so a change that a run failed to publish comes with the next one.
        """
        feed = f"{self.root}/feeds/selection"
        version = max(state.versions(self.spark, f"{self.root}/tables/tags"), default=0)
        published = self.spark.createDataFrame([], schemas.SELECTION)
        if state.exists(self.spark, feed):
            published = self.spark.read.schema(schemas.SELECTION).parquet(feed)
        changed = registry.selection_changes(registry.selection(*self._dims(), version), published).persist()
        if not changed.isEmpty():
            changed.coalesce(1).write.mode("append").parquet(feed)
        changed.unpersist()

    def start_ingest(
        self, raw: DataFrame, checkpoint: str, default_deadband: float = 0.0, exempt_boolean: bool = False, once: bool = False,
        **options: object,
    ) -> StreamingQuery:
        """Store a stream of notifications of selected tags, and record the tags' types.

        A change of the selection, or of a tag's deadband, reaches the running stream with its next micro-batch.
        ``options`` are those of ``jobs.start_ingest``: rows_per_task, buckets, seconds.
        """
        self.publish_selection()
        feed = f"{self.root}/feeds/selection"
        changes = inputs.selection_stream(self.spark, feed) if state.exists(self.spark, feed) else None
        return jobs.start_ingest(
            raw, *self._dims(), f"{self.root}/readings", checkpoint, default_deadband, exempt_boolean, once,
            on_types=self._record_types, changes=changes, **options,
        )

    def _record_types(self, typed: DataFrame) -> None:
        """Tags of unknown type get the type of their first reading that has one; if none is new, nothing is written."""
        unknown = registry.of_unknown_type(self.table("tags")).select("tag_id")
        fresh = typed.filter(F.col("data_type") != registry.NULL_TYPE).join(unknown, "tag_id", "left_semi").persist()
        if not fresh.isEmpty():
            self.change("tags", lambda tags: registry.set_data_types(tags, fresh))
        fresh.unpersist()

    # Jobs

    def run_partition_cycle(
        self, outcomes: exports.Outcomes, as_of_ms: int, hours: int = 6, keep: bool = False, retention_days: int = 90
    ) -> exports.CycleResult:
        """Export closed windows, have them uploaded, record both, and remove the files that are done with.

        Manifest and cursor are saved before the uploader is called. The outcomes of an uploader that yields them are saved
        one by one, others when it returns; then folders go, then they are marked as gone. A run that stops in between leaves
        nothing unrecorded. Only rows that the run changed are written, so what other jobs record meanwhile stays.
        """
        path, as_of = f"{self.root}/partitions", times.ms_to_iso(as_of_ms)
        before = self.table("parquet_partitions")

        def merge(manifest: DataFrame) -> None:
            self.change("parquet_partitions", lambda now: manifests.merge_changed(now, before, manifest, "partition_start"))

        def recorded(manifest: DataFrame, cursor: int) -> None:
            merge(manifest)
            self.put_setting(aggregates.EXPORT_CURSOR_KEY, cursor)

        def sent(outcome: DataFrame) -> None:
            self.change("parquet_partitions", lambda now: manifests.apply_partition_outcomes(now, outcome, as_of, keep=True))

        run = exports.partition_cycle(
            self.readings(), *self._dims(), before, self.table("settings"), outcomes,
            path, self.site, as_of_ms, hours, keep, retention_days, recorded, sent,
        )
        here = self.table("parquet_partitions").filter("local_deleted = 0").select("partition_start")
        gone = run.manifest.filter("local_deleted = 1").join(here, "partition_start", "left_semi")
        starts = sorted(row[0] for row in gone.select("partition_start").collect())  # the windows of one cycle
        still = F.when(F.col("partition_start").isin(starts), F.lit(0)).otherwise(F.col("local_deleted"))
        merge(run.manifest.withColumn("local_deleted", still))
        if starts:
            state.drop_folders(self.spark, [f"{path}/partition_start={start}" for start in starts])
            marked = F.when(F.col("partition_start").isin(starts), F.lit(1)).otherwise(F.col("local_deleted"))
            self.change("parquet_partitions", lambda manifest: manifest.withColumn("local_deleted", marked))
        return run

    def run_rolling_csv(self, outcomes: exports.Outcomes, as_of_ms: int) -> None:
        as_of, before = times.ms_to_iso(as_of_ms), self.table("export_state")

        def merge(after: DataFrame) -> None:
            self.change("export_state", lambda now: manifests.merge_changed(now, before, after, "plc_id"))

        def sent(outcome: DataFrame) -> None:
            self.change("export_state", lambda now: manifests.apply_export_outcomes(now, outcome, as_of))

        merge(exports.rolling_csv(
            self.readings(), *self._dims(), before, outcomes, f"{self.root}/csv", self.site, as_of, merge, sent,
        ))

    def run_window_csv(self, start_ms: int, end_ms: int) -> DataFrame:
        path = f"{self.root}/windows-csv/{start_ms}_{end_ms}"
        return exports.window_csv(self.readings(), *self._dims(), path, self.site, start_ms, end_ms)

    def run_snapshot(self, as_of_ms: int, delivered: bool) -> DataFrame:
        tables = {"readings": self.readings(), **{name: self.table(name) for name in TABLES}}
        summary, highest = exports.snapshot_highest(tables, f"{self.root}/snapshots/{as_of_ms}")
        if delivered:
            self.put_setting(aggregates.BACKUP_WATERMARK_KEY, highest)
        return summary

    def run_retention(self, as_of_ms: int, days: int, upload_enabled: bool) -> int:
        """Prune the stored readings; returns how many went."""
        return retention.sweep_dataset(
            self.spark, f"{self.root}/readings", self.table("parquet_partitions"), self.table("settings"),
            as_of_ms, days, upload_enabled,
        )

    def run_compaction(self, before_ms: int, **options: object) -> tuple[int, int]:
        """Pack the small files that ingest left for dates before ``before_ms``; how many there were, and became."""
        return retention.compact_dataset(self.spark, f"{self.root}/readings", before_ms, **options)

    # Views

    def latest(self, n: int = 20) -> DataFrame:
        return scans.latest_readings(self.readings(), self.table("tags"), n)

    def plc_health(self) -> DataFrame:
        return health.plc_health(self.readings(), *self._dims())

    def health(self, events: DataFrame, samples: DataFrame | None = None, accepted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The fleet's health: a row per controller that has connected, and one row for the whole store.

        ``samples`` (tag_id, ts_received_utc) are the notifications before the deadband, ``accepted`` those
        that passed it, whether written yet or not; without them the stored readings stand for both.
        """
        stored = self.readings()
        fleet_rows = health.health_snapshot(events, stored if samples is None else samples, *self._dims())
        return fleet_rows, health.health_summary(stored, stored if accepted is None else accepted, self.table("export_state"), self.site)
