"""The registered queries. Each takes a session and a folder of driver tables, and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import (
    AS_OF, AS_OF_MS, FIRST_WINDOW_MS, SITE, WINDOW_HOURS, WINDOW_MS, Tables,
)
from tidemark.functions import names, times, values
from tidemark.operators import (
    aggregates, deadband, discovery, health, joins, manifests, registry, retention, sampling, scans, tree,
)
from tidemark.plans import exports, fleet
from tidemark.plans import retention as retention_plan
from tidemark.session import configure, cut_lineage, shared_dir
from tidemark.sinks import exports as writers
from tidemark.sinks import state
from tidemark.sources import feeds, inputs
from tidemark.streaming import figures, jobs, processors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Parameters shared with the SQL side.
PLC = 7
RANGE_START_MS = FIRST_WINDOW_MS + 5 * 86_400_000
RANGE_END_MS = FIRST_WINDOW_MS + 12 * 86_400_000
RETENTION_DAYS = 10
DEFAULT_DEADBAND = 5.0
SAMPLE_MS = 6 * 3_600_000
QUEUE_MS, QUEUE_SIZE = 24 * 3_600_000, 2
FOLDER = "MACHINERY.fb_1"


def query(fn: Callable[[Tables], DataFrame]):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables.of(configure(spark), sf_dir))
    return fn


def _three(t: Tables):
    return t.readings(), t.tags(), t.plcs()


# Scans

@query
def scan_plc(t):
    return scans.export_rows(*_three(t), plc_id=PLC)


@query
def scan_plc_range_closed(t):
    return scans.export_rows_in_range(*_three(t), RANGE_START_MS, RANGE_END_MS)


@query
def scan_range_half_open(t):
    return scans.range_readings(*_three(t), RANGE_START_MS, RANGE_END_MS)


@query
def latest_n(t):
    return scans.latest_readings(t.readings(), t.tags(), 20)


@query
def latest_n_sql(t):
    """The same question asked in SQL over the tables as views."""
    t.readings().createOrReplaceTempView("tidemark_readings")
    t.tags().createOrReplaceTempView("tidemark_tags")
    return t.spark.sql(
        "WITH named AS (SELECT * FROM tidemark_tags JOIN tidemark_readings USING (tag_id)) "
        "SELECT id, tag_name, date_format(timestamp_millis(ts_utc), 'yyyy-MM-dd HH:mm:ss') AS ts, value, quality "
        "FROM named ORDER BY id DESC LIMIT 20"
    )


@query
def stored_range_scan(t):
    """Store the readings by date, then scan a half-open range of the dataset."""
    path = shared_dir(t.spark, "readings")
    writers.write_readings(t.readings(), path)
    return scans.range_readings(inputs.readings(t.spark, path), t.tags(), t.plcs(), RANGE_START_MS, RANGE_END_MS)


# Scalar functions

@query
def normalise_notifications(t):
    return fleet.normalise(t.raw_notifications())


@query
def resolve_tags(t):
    raw = registry.resolve_notifications(t.raw_notifications(), t.tags(), t.plcs())
    return raw.select("seq", "plc_name", "node_id", "tag_id")


@query
def quality_codes(t):
    name = values.status_quality(F.col("status_code"))
    code = values.quality_code(name)
    return (
        t.raw_notifications().groupBy(name.alias("quality"), code.alias("code"), values.quality_name(code).alias("back"))
        .agg(F.count("*").alias("n"))
    )


@query
def iso_timestamps(t):
    ts = F.col("ts_utc")
    return t.readings().select(
        "id", times.iso_utc(ts).alias("iso"), times.seconds_text(ts).alias("seconds"),
        times.utc_date(ts).cast("string").alias("day"), times.window_start(ts, WINDOW_MS).alias("window_start"),
    )


@query
def csv_lines(t):
    rows = scans.export_rows(*_three(t))
    line = values.csv_line(*scans.csv_columns(rows))
    return rows.select("id", line.alias("line"))


@query
def derive_tag_names(t):
    edges = t.address_edges().filter(F.col("node_class") == "Variable")
    leaf = names.leaf_name(F.col("display_name"), F.col("browse_name"), F.col("child"))
    return edges.select(
        "plc_name", "parent", F.col("child").alias("node_id"), leaf.alias("leaf"),
        names.tag_name(F.col("child"), leaf).alias("tag_name"),
    )


@query
def tag_filter(t):
    node = F.col("node_id")
    return t.tags().select(
        "tag_id", names.namespace_index(node).alias("namespace"), names.identifier(node).alias("identifier"),
        registry.passes_tag_filter(node).alias("by_default"),
        registry.passes_tag_filter(node, namespaces=[], tokens=["|VAR|", "machinery"]).alias("by_token"),
        registry.passes_tag_filter(node, namespaces=[], tokens=[], exclude_namespace_zero=False).alias("by_nothing"),
    )


@query
def file_names(t):
    start = times.window_start(F.col("ts_utc"), WINDOW_MS)
    rows = joins.named_readings(t.readings(), t.tags(), t.plcs()).select("plc_name", start.alias("start")).distinct()
    site = F.lit(SITE)
    return rows.select(
        "plc_name", "start", names.partition_file(site, F.col("start")).alias("window_file"),
        names.rolling_csv_file(site, F.col("plc_name")).alias("rolling_file"),
        names.window_csv_file(site, F.col("plc_name"), F.col("start"), F.col("start") + WINDOW_MS).alias("range_file"),
        names.rolling_csv_file(F.lit(" "), F.col("plc_name")).alias("unnamed_file"),
    )


@query
def tag_path_parts(t):
    return tree.path_parts(t.tags())


@query
def effective_deadband(t):
    return deadband.effective_deadbands(t.tags(), DEFAULT_DEADBAND)


@query
def deadbanded_tags(t):
    return deadband.deadbanded_tags(t.tags(), DEFAULT_DEADBAND)


# Fleet configuration

def _documents(t):
    return inputs.site_documents(t.spark, t.fleet_files())


@query
def registry_entries(t):
    return registry.explode_plcs(_documents(t))


@query
def registry_validate(t):
    return registry.validate_registry(registry.explode_plcs(_documents(t)))


@query
def schedule_validate(t):
    return registry.validate_schedules(_documents(t))


@query
def duplicate_names(t):
    return registry.duplicate_names(registry.explode_plcs(_documents(t)))


@query
def config_issues(t):
    return registry.config_issues(_documents(t))


@query
def issue_counts(t):
    return registry.issue_counts(registry.config_issues(_documents(t)))


@query
def config_report(t):
    return fleet.config_report(_documents(t))


@query
def config_backfill(t):
    filled = registry.backfill_documents(_documents(t), "Seed", "03:30", 45)
    return filled.select(
        "site", F.col("SiteName").alias("site_name"), F.col("Schedule.Mode").alias("mode"),
        F.col("Schedule.DailyAtLocalTime").alias("daily_at"), F.col("Schedule.IntervalMinutes").alias("interval_minutes"),
        F.col("Schedule.PartitionHours").alias("partition_hours"),
        F.col("Schedule.KeepUploadedPartitions").alias("keep"), F.col("RetentionDays").alias("retention_days"),
    )


def _registry(t):
    """One entry per name and site, as a registry that went through upserts holds it."""
    entries = registry.explode_plcs(_documents(t)).filter(~names.is_blank(F.col("name")))
    columns = ["site", "name", "endpoint_url", "security_policy"]
    empty = entries.select(*columns).limit(0)
    return registry.upsert_registry(empty, entries.withColumnRenamed("position", "seq"))


def _changes(t):
    """Edits to the registry: two per controller with an even position, one new name per site."""
    entries = registry.explode_plcs(_documents(t)).filter(~names.is_blank(F.col("name")))
    seq = (F.col("site") * 100 + F.col("position") * 2).cast("long")
    even = entries.filter(F.col("position") % 2 == 0)
    moved = F.when(F.col("position") % 4 == 0, F.col("endpoint_url")).otherwise(F.lit("opc.tcp://moved:4840"))
    first = even.select("site", F.upper("name").alias("name"), F.lit("opc.tcp://old:4840").alias("endpoint_url"),
                        "security_policy", seq.alias("seq"))
    second = even.select("site", F.upper("name").alias("name"), moved.alias("endpoint_url"),
                         F.upper("security_policy").alias("security_policy"), (seq + 1).alias("seq"))
    new = entries.filter(F.col("position") == 1).select(
        "site", F.lit("New").alias("name"),
        F.when(F.col("site") % 2 == 0, F.lit("opc.tcp://new:4840")).otherwise(F.lit("new")).alias("endpoint_url"),
        F.lit("None").alias("security_policy"), (seq + 50).alias("seq"),
    )
    return first.unionByName(second).unionByName(new)


@query
def registry_upsert(t):
    return registry.upsert_registry(_registry(t), _changes(t))


@query
def registry_remove(t):
    return registry.remove_from_registry(_registry(t), _changes(t))


@query
def registry_diff(t):
    running = _registry(t)
    desired = registry.upsert_registry(running, _changes(t))
    gone = running.filter(F.col("site") % 3 == 0).filter(F.lower("name").endswith("_3"))
    return registry.registry_diff(running, registry.remove_from_registry(desired, gone))


# Tags and their selection

@query
def logged_plcs(t):
    return joins.plcs_with_tags(t.plcs(), t.tags()).select("plc_id", "name").orderBy("name")


@query
def enabled_bindings(t):
    return registry.enabled_bindings(t.tags())


@query
def tag_selection(t):
    return registry.tag_selection(t.tags())


@query
def set_tags_enabled(t):
    tags = t.tags()
    saved = t.plcs().filter(F.col("plc_id") < 20).select("plc_id")
    chosen = tags.filter(F.col("tag_name").contains("fb_2")).select("plc_id", "tag_id")
    return registry.set_tags_enabled(tags, saved, chosen).select("tag_id", "active", "enabled")


@query
def subtree_toggle(t):
    off = registry.toggle_subtree(t.tags(), FOLDER, False)
    return registry.toggle_subtree(off, "HOUSEHOLD", True, PLC).select("tag_id", "active", "enabled")


@query
def folder_rollup(t):
    return tree.folder_rollup(t.tags())


@query
def sibling_order(t):
    return tree.sibling_order(t.tags())


@query
def upsert_plcs(t):
    supplier = t._read("supplier")
    key = F.col("s_suppkey")
    known = F.concat(F.lit("NATION_"), (key % 40).cast("string"))
    incoming = supplier.select(
        F.when(key % 3 == 0, known).otherwise(F.col("s_name")).alias("name"),
        F.concat(F.lit("opc.tcp://10.1.0."), key.cast("string"), F.lit(":4840")).alias("endpoint_url"),
        F.lit("None").alias("security_policy"), key.alias("seq"),
    )
    return registry.upsert_plcs(t.plcs(), incoming)


@query
def sync_tags(t):
    scanned = t.plcs().filter(F.col("plc_id") != 3).select("plc_id")
    discovered = t.discovered().filter(~F.col("plc_id").isin(3, 4))
    return registry.sync_tags(t.tags(), discovered, scanned, AS_OF)


def _typed(t):
    raw = registry.resolve_notifications(t.raw_notifications(), t.tags(), t.plcs())
    return fleet.normalise(raw).select("tag_id", "data_type", "id")


@query
def tag_data_types(t):
    return registry.set_data_types(t.tags(), _typed(t)).select("tag_id", "data_type")


@query
def first_names(t):
    return registry.first_names(t.discovered())


@query
def display_names(t):
    return registry.display_names(registry.enabled_bindings(t.tags()), t.discovered()).select("tag_id", "display_name")


@query
def add_missing_column(t):
    old = t.tags().drop("enabled")
    upgraded = registry.add_missing_column(old, "enabled", 1, "int")
    return registry.add_missing_column(upgraded, "active", 9, "int").select("tag_id", "active", "enabled")


# Aggregates

@query
def reading_bounds(t):
    full, none = t.readings(), t.readings().filter(F.col("id") < 0)
    bounds = aggregates.reading_bounds(full).withColumn("source", F.lit("all"))
    return bounds.unionByName(aggregates.reading_bounds(none).withColumn("source", F.lit("none")))


@query
def csv_stats(t):
    return aggregates.csv_stats(*_three(t))


@query
def window_stats(t):
    return aggregates.window_stats(*_three(t), WINDOW_MS)


@query
def run_totals(t):
    return aggregates.run_totals(aggregates.csv_stats(*_three(t)), t.partition_outcomes())


@query
def last_export_upload(t):
    return aggregates.last_export_upload(t.export_state(), t.partitions())


@query
def prune_watermark(t):
    manifest, settings = t.partitions(), t.settings()
    cases = [("both", manifest, settings), ("backup", manifest.limit(0), settings),
             ("windows", manifest, t.no_settings()), ("none", manifest.limit(0), t.no_settings())]
    found = None
    for name, partitions, values_ in cases:
        line = aggregates.prune_watermark(partitions, values_).withColumn("source", F.lit(name))
        found = line if found is None else found.unionByName(line)
    return found


# Files written and read back

@query
def partition_export(t):
    path = shared_dir(t.spark, "windows")
    span = exports.elapsed_range(t.readings(), t.settings(), AS_OF_MS, WINDOW_MS)
    writers.write_windows(scans.range_readings(*_three(t), *span), path, WINDOW_MS)
    return inputs.exported_windows(t.spark, path)


@query
def csv_rolling(t):
    path = shared_dir(t.spark, "csv")
    writers.write_rolling_csv(scans.export_rows(*_three(t)), path)
    return _text(inputs.exported_csv(t.spark, path))


@query
def csv_window(t):
    path = shared_dir(t.spark, "csv")
    writers.write_window_csv(scans.export_rows_in_range(*_three(t), RANGE_START_MS, RANGE_END_MS), path)
    return _text(inputs.exported_csv(t.spark, path))


def _text(rows):
    """An empty CSV field reads back as null; the export wrote it as empty text."""
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])


def _store(t):
    return {
        "readings": t.readings(), "tags": t.tags(), "plcs": t.plcs(), "parquet_partitions": t.partitions(),
        "export_state": t.export_state(), "settings": t.settings(),
    }


@query
def snapshot(t):
    return exports.snapshot(_store(t), shared_dir(t.spark, "snapshot"))


@query
def snapshot_watermark(t):
    return exports.snapshot_watermark(_store(t), shared_dir(t.spark, "snapshot"), delivered=True)[1]


# Manifests

def _records(t):
    """A second export of the last ten days of windows, after Bad readings were taken out."""
    late = t.readings().filter((F.col("ts_utc") >= FIRST_WINDOW_MS + 20 * 86_400_000) & (F.col("quality") != 2))
    stats = aggregates.window_stats(late, t.tags(), t.plcs(), WINDOW_MS)
    return manifests.partition_records(stats, SITE, WINDOW_HOURS)


def _old_manifest(t):
    """The manifest as of day 25: later windows have no row yet."""
    return t.partitions().filter(F.col("partition_start") < FIRST_WINDOW_MS + 25 * 86_400_000)


@query
def record_partition(t):
    return manifests.record_partitions(_old_manifest(t), _records(t), "2024-01-31T06:00:00.000Z")


@query
def pending_partitions(t):
    return manifests.pending_partitions(t.partitions())


@query
def overlapping_partitions(t):
    """Six-hour windows, and four-hour ones exported from day 20 on after the size was changed."""
    smaller = t.readings().filter(F.col("ts_utc") >= FIRST_WINDOW_MS + 20 * 86_400_000)
    stats = aggregates.window_stats(smaller, t.tags(), t.plcs(), 4 * times.HOUR_MS)
    resized = manifests.record_partitions(_old_manifest(t), manifests.partition_records(stats, SITE, 4), AS_OF)
    return manifests.overlapping_partitions(resized)


@query
def mark_partitions(t):
    return manifests.apply_partition_outcomes(t.partitions(), t.partition_outcomes(), "2024-01-31T06:00:00.000Z", keep=False)


@query
def kept_partitions_cleanup(t):
    return manifests.cleanup_kept(t.partitions(), times.retention_cutoff(AS_OF_MS, RETENTION_DAYS))


@query
def record_export(t):
    stats = aggregates.csv_stats(*_three(t))
    known = t.export_state().filter(F.col("plc_id") != 11)
    return manifests.record_exports(known, manifests.export_records(stats, SITE, "exports"), AS_OF)


@query
def pending_uploads(t):
    return manifests.pending_uploads(t.export_state())


@query
def mark_uploads(t):
    return manifests.apply_export_outcomes(t.export_state(), t.export_outcomes(), AS_OF)


@query
def cursor_set(t):
    span = exports.elapsed_range(t.readings(), t.settings(), AS_OF_MS, WINDOW_MS)
    return manifests.put_setting(t.settings(), aggregates.EXPORT_CURSOR_KEY, span[1])


@query
def backup_watermark(t):
    highest = aggregates.reading_bounds(t.readings()).first()["max_id"]
    return manifests.put_setting(t.no_settings(), aggregates.BACKUP_WATERMARK_KEY, highest)


# Retention

@query
def prune_by_age(t):
    return retention.retained(t.readings(), times.retention_cutoff(AS_OF_MS, RETENTION_DAYS))


@query
def prune_uploaded(t):
    watermark = aggregates.prune_watermark(t.partitions().limit(0), t.settings()).first()[0]
    return retention.retained(t.readings(), times.retention_cutoff(AS_OF_MS, RETENTION_DAYS), watermark)


@query
def prune_listed(t):
    pruned = t.readings().filter(retention.is_prunable(times.retention_cutoff(AS_OF_MS, RETENTION_DAYS)))
    return retention.without_pruned(t.readings(), pruned)


@query
def prune_safe(t):
    return retention.retained_safely(t.readings(), times.retention_cutoff(AS_OF_MS, RETENTION_DAYS), t.partitions())


@query
def retention_sweep(t):
    """What five sweeps leave: by age, by watermark, nothing uploaded, upload off, retention off."""
    readings, manifest, settings = t.readings(), t.partitions(), t.settings()
    empty = manifest.limit(0)
    cases = [
        ("age binds", manifest, settings, RETENTION_DAYS, True), ("id binds", empty, settings, RETENTION_DAYS, True),
        ("nothing uploaded", empty, t.no_settings(), RETENTION_DAYS, True),
        ("upload off", empty, t.no_settings(), RETENTION_DAYS, False), ("keep all", manifest, settings, 0, True),
    ]
    found = None
    for name, partitions, values_, days, upload in cases:
        left = retention.sweep(readings, partitions, values_, AS_OF_MS, days, upload)
        line = left.agg(F.count("*").alias("retained"), F.min("id").alias("min_id"), F.sum("id").alias("sum_id"))
        line = line.withColumn("source", F.lit(name))
        found = line if found is None else found.unionByName(line)
    return found


@query
def prune_stored(t):
    """Prune a stored dataset in place, by date folders, and read what is left."""
    path = shared_dir(t.spark, "readings")
    writers.write_readings(t.readings(), path)
    cutoff = times.retention_cutoff(AS_OF_MS, RETENTION_DAYS) + 7 * 3_600_000
    watermark = aggregates.prune_watermark(t.partitions().limit(0), t.settings()).first()[0]
    retention_plan.prune_dataset(t.spark, path, cutoff, watermark)
    return inputs.readings(t.spark, path).drop("dt")


# Deadband and sampling

@query
def deadband_batch(t):
    return deadband.deadband(t.readings(), t.tags(), DEFAULT_DEADBAND)


@query
def deadband_sharded(t):
    """The same result with every tag of more than twenty rows cut into shards of about five."""
    return deadband.deadband(t.readings(), t.tags(), DEFAULT_DEADBAND, target=20)


@query
def deadband_resumed(t):
    """The history thinned in two runs, the second starting from what the first stored last."""
    readings, tags = t.readings(), t.tags()
    cut = FIRST_WINDOW_MS + 15 * 86_400_000
    before = cut_lineage(deadband.deadband(readings.filter(F.col("ts_utc") < cut), tags, DEFAULT_DEADBAND))
    baseline = deadband.last_stored(before, tags, DEFAULT_DEADBAND)
    after = deadband.deadband(readings.filter(F.col("ts_utc") >= cut), tags, DEFAULT_DEADBAND, baseline=baseline)
    return before.unionByName(after)


@query
def deadband_segments(t):
    return deadband.segments(t.readings(), t.tags(), DEFAULT_DEADBAND)


@query
def ingest_batch(t):
    return fleet.ingest(t.raw_notifications(), t.tags(), t.plcs(), DEFAULT_DEADBAND)


@query
def ingest_exempt_booleans(t):
    return fleet.ingest(t.raw_notifications(), t.tags(), t.plcs(), DEFAULT_DEADBAND, exempt_boolean=True)


def _coarse(t):
    """Readings whose values are rounded to tens, so that runs of equal rows occur."""
    return t.readings().withColumn("value", F.floor(F.col("value") / 20).cast("double") * 20)


@query
def change_only(t):
    return sampling.change_only(_coarse(t))


@query
def sample_interval(t):
    return sampling.sample_latest(t.readings(), SAMPLE_MS)


@query
def queue_last_n(t):
    return sampling.keep_last(t.readings(), QUEUE_MS, QUEUE_SIZE)


@query
def compact_stored(t):
    """The readings after the many files that they were stored in have been packed."""
    path = shared_dir(t.spark, "packed")
    pieces = t.readings().withColumn("dt", times.utc_date(F.col("ts_utc"))).repartition(8, "id")
    pieces.write.partitionBy("dt").parquet(path)
    retention_plan.compact_dataset(t.spark, path, AS_OF_MS)
    return inputs.readings(t.spark, path).drop("dt")


# Streams

def _stream(t):
    path, files = t.notification_files()
    raw = inputs.notification_stream(t.spark, path, files_per_trigger=files)
    return jobs.resolved_stream(raw, t.tags(), t.plcs())


def _run(t, start):
    """Start a stream with one state partition per core of the session, and wait for its end."""
    setting = "spark.sql.shuffle.partitions"
    before = t.spark.conf.get(setting)
    t.spark.conf.set(setting, str(t.spark.sparkContext.defaultParallelism))
    try:
        start().awaitTermination()
    finally:
        t.spark.conf.set(setting, before)


def _paths(t, name):
    return shared_dir(t.spark, name), shared_dir(t.spark, f"{name}-checkpoint")


@query
def stream_ingest(t):
    path, checkpoint = _paths(t, "ingested")
    raw = feeds.notification_feed(t.spark, t.site_feeds(), files_per_trigger=1)

    def start():
        stream = jobs.start_ingest(raw, t.tags(), t.plcs(), path, checkpoint, DEFAULT_DEADBAND, seconds=0.0)
        stream.processAllAvailable()
        stream.stop()
        return stream

    _run(t, start)
    return t.spark.read.parquet(path).drop("dt")


@query
def deadband_stream(t):
    path, checkpoint = _paths(t, "thinned")
    stream = _stream(t).drop("plc_name", "node_id")
    thinned = processors.deadband_stream(stream, t.tags(), DEFAULT_DEADBAND, exempt_boolean=True)
    _run(t, lambda: jobs.start_append(thinned, path, checkpoint, once=True))
    return t.spark.read.parquet(path)


@query
def change_stream(t):
    path, checkpoint = _paths(t, "changed")
    coarse = _stream(t).drop("plc_name", "node_id").withColumn("value", F.floor(F.col("value") / 20).cast("double") * 20)
    _run(t, lambda: jobs.start_append(processors.change_stream(coarse), path, checkpoint, once=True))
    return t.spark.read.parquet(path)


@query
def stream_closed_windows(t):
    path, checkpoint = _paths(t, "closed")
    _run(t, lambda: jobs.start_append(jobs.closed_windows(_stream(t), WINDOW_HOURS, "1 hour"), path, checkpoint, once=True))
    return t.spark.read.parquet(path)


@query
def stream_health(t):
    root, checkpoint = _paths(t, "health")
    figures_of = figures.health_changes(_stream(t))
    _run(t, lambda: figures.start_changes(figures_of, root, figures.merge_health, checkpoint, jobs.trigger(True), fold_every=3))
    return figures.current_health(t.spark, root).drop("silent")


@query
def stream_silent_plcs(t):
    """Controllers whose newest row lies a day or more behind the watermark of the whole stream."""
    root, checkpoint = _paths(t, "silent")
    stream = _stream(t).filter((F.col("ts_utc") < FIRST_WINDOW_MS + 20 * 86_400_000) | ~F.startswith("plc_name", F.lit("I")))
    figures_of = figures.health_changes(stream, silence_ms=86_400_000, lateness="1 hour")
    _run(t, lambda: figures.start_changes(figures_of, root, figures.merge_health, checkpoint, jobs.trigger(True)))
    return figures.current_health(t.spark, root).select("plc_name", "samples", "silent")


@query
def stream_first_type(t):
    root, checkpoint = _paths(t, "types")
    types = figures.type_changes(_stream(t))
    _run(t, lambda: figures.start_changes(types, root, figures.merge_types, checkpoint, jobs.trigger(True)))
    return figures.current_types(t.spark, root)


@query
def stream_window_report(t):
    """Files out of time order: how many rows of each window were counted when it closed, and how many came too late."""
    root, checkpoint = _paths(t, "windows")
    path, files = t.disordered_files()
    raw = inputs.notification_stream(t.spark, path, files_per_trigger=files)
    stream = jobs.resolved_stream(raw, t.tags(), t.plcs())
    _run(t, lambda: figures.start_window_report(stream, root, checkpoint, jobs.trigger(True), WINDOW_HOURS, "1 hour"))
    closed = t.spark.read.parquet(f"{root}/closed").drop("batch")
    late = t.spark.read.parquet(f"{root}/late").groupBy("partition_start").agg(F.count("*").alias("late_rows"))
    both = closed.join(late, "partition_start", "full_outer")
    return both.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("row_count", "late_rows")})


def _late(t):
    """An export that had half the readings when its cursor stood at day 20."""
    readings = t.readings()
    half = readings.agg(F.floor(F.max("id") / 2)).first()[0]
    return retention.late_readings(readings, FIRST_WINDOW_MS + 20 * 86_400_000, half)


@query
def late_readings(t):
    return _late(t)


@query
def late_windows(t):
    return retention.windows_to_reexport(_late(t), WINDOW_MS)


@query
def stream_late_report(t):
    """Late rows of a stream whose export cursor already stands at day 20."""
    path, checkpoint = _paths(t, "late")
    stream = _stream(t).select("id", "tag_id", "ts_utc")
    cursor = FIRST_WINDOW_MS + 20 * 86_400_000
    _run(t, lambda: jobs.start_late_report(stream, path, checkpoint, lambda: cursor, WINDOW_HOURS, once=True))
    return t.spark.read.parquet(path).drop("batch")


# Health

def _samples(t):
    """Notifications of selected tags as they came in, before the deadband."""
    return jobs.resolved_stream(t.raw_notifications(), t.tags(), t.plcs()).select("tag_id", "ts_received_utc")


def _accepted(t):
    """Readings that the deadband let pass, and those of them that a writer so far behind has stored."""
    accepted = cut_lineage(fleet.ingest(t.raw_notifications(), t.tags(), t.plcs(), DEFAULT_DEADBAND))
    return accepted, accepted.filter(F.col("ts_utc") < RANGE_END_MS)


@query
def health_plcs(t):
    return health.plc_health(_samples(t), t.tags(), t.plcs())


@query
def health_summary(t):
    accepted, written = _accepted(t)
    return health.health_summary(written, accepted, t.export_state(), SITE)


@query
def health_snapshot(t):
    return health.health_snapshot(t.connection_events(), _samples(t), t.tags(), t.plcs())


@query
def write_totals(t):
    return aggregates.write_totals(t.readings())


@query
def connection_state(t):
    return health.connection_state(t.connection_events())


@query
def backlog(t):
    return aggregates.backlog(*_accepted(t))


# Discovery

@query
def discover_tags(t):
    return discovery.discover_tags(t.address_edges())


@query
def discovery_sync(t):
    return fleet.discovery_sync(t.address_edges(), t.tags(), t.plcs(), AS_OF)


# Jobs

def _cycle(t, keep):
    return exports.partition_cycle(
        *_three(t), _old_manifest(t), t.settings(), t.partition_outcomes(), shared_dir(t.spark, "windows"), SITE,
        AS_OF_MS, WINDOW_HOURS, keep=keep, retention_days=RETENTION_DAYS,
    )


@query
def partition_cycle(t):
    return _cycle(t, keep=False).manifest


@query
def partition_cycle_keep(t):
    return _cycle(t, keep=True).manifest


@query
def partition_cycle_settings(t):
    return _cycle(t, keep=False).settings


@query
def csv_run(t):
    path = shared_dir(t.spark, "csv")
    state = exports.rolling_csv(*_three(t), t.export_state(), t.export_outcomes(), path, SITE, AS_OF)
    return state.withColumn("file_path", F.replace("file_path", F.lit(path), F.lit("exports")))


@query
def window_csv_run(t):
    path = shared_dir(t.spark, "csv")
    return exports.window_csv(*_three(t), path, SITE, RANGE_START_MS, RANGE_END_MS)


def closed_window_stats(t: Tables) -> DataFrame:
    """Rows and highest id of every window that has fully elapsed: the flagship query."""
    span = exports.elapsed_range(t.readings(), t.no_settings(), AS_OF_MS, WINDOW_MS)
    rows = t.readings() if span is None else scans.in_range(t.readings(), *span, closed=False)
    return aggregates.window_stats(rows, t.tags(), t.plcs(), WINDOW_MS)


query(closed_window_stats)
