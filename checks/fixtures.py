"""Historian tables derived from the driver's Parquet tables, at the scale of those tables.

Controllers come from ``nation``, tags from ``customer``, readings from ``events``. ``oracle.py``
derives the same tables in SQL, independently.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import names, times
from tidemark.operators import aggregates
from tidemark.session import cut_lineage, shared_dir
from tidemark.sinks import state
from tidemark.sources import feeds

AS_OF = "2024-01-31T00:00:00.000Z"
AS_OF_MS = 1706659200000
FIRST_WINDOW_MS = 1704067200000
WINDOW_HOURS = 6
WINDOW_MS = WINDOW_HOURS * 3_600_000
SEEN_AT = "2024-01-01T00:00:00.000Z"
SITE = "a/b:c"
FILE_ROWS = 500_000


def _choose(*pairs, default) -> Column:
    column = F.when(*pairs[0])
    for condition, value in pairs[1:]:
        column = column.when(condition, value)
    return column.otherwise(default)


def _planned_once(method):
    """Build a table's plan once per folder; the plan is evaluated anew by every query."""
    return lru_cache(maxsize=64)(method)


class Tables:
    """The derived tables over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @staticmethod
    @lru_cache(maxsize=8)
    def of(spark: SparkSession, sf_dir: str) -> Tables:
        return Tables(spark, sf_dir)

    @_planned_once
    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @_planned_once
    def plcs(self) -> DataFrame:
        rows = self._read("nation").select(
            F.col("n_nationkey").cast("int").alias("plc_id"), F.col("n_name").alias("name"),
            F.concat(F.lit("opc.tcp://10.0."), F.col("n_regionkey").cast("string"), F.lit("."),
                     F.col("n_nationkey").cast("string"), F.lit(":4840")).alias("endpoint_url"),
            F.when(F.col("n_regionkey") == 0, F.lit("None")).otherwise(F.lit("Basic256Sha256")).alias("security_policy"),
        )
        spare = self.spark.range(25, 26).select(
            F.col("id").cast("int").alias("plc_id"), F.lit("SPARE").alias("name"),
            F.lit("opc.tcp://10.0.9.25:4840").alias("endpoint_url"), F.lit("None").alias("security_policy"),
        )
        return rows.unionByName(spare)

    @_planned_once
    def tags(self) -> DataFrame:
        nation = self._read("nation").select("n_nationkey", "n_name")
        key = F.col("c_custkey")
        text_key = key.cast("string")
        node = _choose(
            (key % 11 == 0, F.concat(F.lit("ns=0;i="), text_key)),
            (key % 11 == 1, F.concat(F.lit("ns=4;s=|vprop|"), F.col("n_name"), F.lit("."), F.col("c_name"))),
            default=F.concat(
                F.lit("ns=4;s=|var|"), F.col("n_name"), F.lit(".Application."), F.col("c_mktsegment"),
                F.lit(".fb_"), (key % 5).cast("string"), F.lit("."), F.col("c_name"),
            ),
        )
        rows = self._read("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.withColumn("node_id", node).select(
            key.cast("int").alias("tag_id"), F.col("c_nationkey").cast("int").alias("plc_id"),
            "node_id", names.tag_name(F.col("node_id"), F.col("c_name")).alias("tag_name"),
            F.lit("Double").alias("data_type"), F.lit(None).cast("string").alias("units"),
            F.when(key % 3 == 0, F.lit(20.0)).when(key % 3 == 1, F.lit(0.0)).alias("deadband_override"),
            F.lit(SEEN_AT).alias("first_seen_at"), F.lit(SEEN_AT).alias("last_seen_at"),
            F.when(key % 13 == 0, F.lit(0)).otherwise(F.lit(1)).alias("active"),
            F.when(key % 7 == 0, F.lit(0)).otherwise(F.lit(1)).alias("enabled"),
        )

    @_planned_once
    def readings(self) -> DataFrame:
        ts = F.unix_millis(F.col("ts").cast("timestamp"))
        view = F.col("event_type") == "view"
        return self._read("events").select(
            (F.col("event_id") + 1).alias("id"), F.col("user_id").cast("int").alias("tag_id"), ts.alias("ts_utc"),
            F.when(F.col("event_id") % 97 != 0, ts + F.col("event_id") % 5000).alias("ts_received_utc"),
            F.when(~view, F.col("value")).alias("value"), F.when(view, F.col("props")).alias("value_text"),
            F.when(F.col("event_type") == "error", F.lit(2)).when(F.col("event_type") == "signup", F.lit(1))
            .otherwise(F.lit(0)).alias("quality"),
        )

    @_planned_once
    def raw_notifications(self) -> DataFrame:
        tags = self.tags().select("tag_id", "plc_id", "node_id")
        nodes = tags.join(self.plcs().select("plc_id", F.col("name").alias("plc_name")), "plc_id")
        kind, ts = F.col("event_type"), F.col("ts").cast("timestamp")
        rows = self._read("events").join(nodes, F.col("user_id") == F.col("tag_id"))
        return rows.select(
            "plc_name", "node_id", F.when(F.col("event_id") % 101 != 0, ts).alias("source_ts"),
            F.timestamp_micros(F.unix_micros(ts) + 1000 * (F.col("event_id") % 5000)).alias("received_ts"),
            F.when(kind == "error", F.lit(0x80000000)).when(kind == "signup", F.lit(0x40000000))
            .otherwise(F.lit(0)).cast("long").alias("status_code"),
            F.when(kind == "view", F.lit("String")).when(kind == "purchase", F.lit("Boolean"))
            .otherwise(F.lit("Double")).alias("data_type"),
            F.when(kind == "purchase", F.col("value") > 50).alias("v_bool"),
            F.when(~kind.isin("purchase", "view") & (F.col("event_id") % 103 != 0), F.col("value")).alias("v_num"),
            F.when(kind == "view", F.col("props")).alias("v_text"),
            (F.col("event_id") + 1).alias("seq"),
        )

    def _in_turn(self, path: str, pieces: list[DataFrame], rows: int) -> int:
        """Write the pieces one after the other, each as the same number of files, about FILE_ROWS rows a file; return that number."""
        width = max(1, -(-rows // FILE_ROWS))
        files = state._file_system(self.spark, path)
        for n, piece in enumerate(pieces, 1):
            (piece.repartition(width, "seq") if width > 1 else piece.coalesce(1)).write.mode("append").parquet(path)
            while width > 1 and len(files.globStatus(state._path(self.spark, f"{path}/part-*"))) < n * width:
                piece.limit(0).coalesce(1).write.mode("append").parquet(path)  # a trigger takes whole pieces
        return width

    def notification_files(self, pieces: int = 4) -> tuple[str, int]:
        """The raw notifications as several pieces of consecutive ids, in a folder a stream can read, and the files of a piece."""
        path = shared_dir(self.spark, "notifications")
        raw = cut_lineage(self.raw_notifications())
        top = raw.agg(F.max("seq")).first()[0] or 0
        step = -(-top // pieces) or 1
        parts = [raw.filter((F.col("seq") > n * step) & (F.col("seq") <= (n + 1) * step)) for n in range(pieces)]
        return path, self._in_turn(path, parts, step)

    def site_feeds(self, sites: int = 2, pieces: int = 4) -> str:
        """The raw notifications as numbered files of consecutive ids, the controllers dealt to sites."""
        path = shared_dir(self.spark, "feeds")
        raw = cut_lineage(self.raw_notifications())
        top = raw.agg(F.max("seq")).first()[0] or 0
        step = -(-top // pieces) or 1
        number, site = F.floor((F.col("seq") - 1) / step).cast("int"), F.pmod(F.hash("plc_name"), F.lit(sites)).cast("int")
        dealt = raw.withColumns({"site": site, "number": number}).repartitionById(sites * pieces, F.col("site") * pieces + F.col("number"))
        dealt.write.partitionBy("site", "number").parquet(f"{path}/_written")
        files = state._file_system(self.spark, path)
        for found in files.globStatus(state._path(self.spark, f"{path}/_written/site=*/number=*/part-*")):
            site, number = (found.getPath().toString().split(f"{name}=")[1].split("/")[0] for name in ("site", "number"))
            files.mkdirs(state._path(self.spark, f"{path}/site{site}"))
            files.rename(found.getPath(), state._path(self.spark, f"{path}/site{site}/{feeds.file_name(int(number))}"))
        return path

    def disordered_files(self) -> tuple[str, int]:
        """The raw notifications as four pieces by time, of which the second and the third have changed places, and the files of a piece."""
        path = shared_dir(self.spark, "disordered")
        raw = cut_lineage(self.raw_notifications())
        day = (times.epoch_ms(times.event_time(F.col("source_ts"), F.col("received_ts"))) - FIRST_WINDOW_MS) / 86_400_000
        parts = [raw.filter((day >= first) & (day < last)) for first, last in ((0, 10), (16, 21), (10, 16), (21, 1000))]
        return path, self._in_turn(path, parts, raw.count() // len(parts))

    @_planned_once
    def partitions(self) -> DataFrame:
        stats = aggregates.window_stats(self.readings(), self.tags(), self.plcs(), WINDOW_MS)
        number = ((F.col("partition_start") - FIRST_WINDOW_MS) / WINDOW_MS).cast("int")
        uploaded = F.when(number % 4 != 3, F.lit(AS_OF))
        return stats.select(
            "partition_start", F.lit(WINDOW_HOURS).alias("partition_hours"),
            names.partition_file(F.lit(SITE), F.col("partition_start")).alias("file_name"),
            "row_count", "max_reading_id", F.lit(AS_OF).alias("exported_at"), uploaded.alias("uploaded_at"),
            F.when((number % 5 == 0) & uploaded.isNotNull(), F.lit(1)).otherwise(F.lit(0)).alias("local_deleted"),
        )

    @_planned_once
    def export_state(self) -> DataFrame:
        """The first half of the history as last exported: some files sent, some behind, some failed."""
        half = FIRST_WINDOW_MS + 15 * 86_400_000
        older = self.readings().filter(F.col("ts_utc") < half)
        stats = aggregates.csv_stats(older, self.tags(), self.plcs())
        file_name = names.rolling_csv_file(F.lit(SITE), F.col("plc_name"))
        turn = F.col("plc_id") % 3
        last = F.col("max_reading_id")
        return stats.select(
            "plc_id", file_name.alias("file_name"), F.concat(F.lit("exports/"), file_name).alias("file_path"),
            last.alias("last_reading_id"), "row_count", F.lit(SEEN_AT).alias("exported_at"),
            F.when(turn == 0, last).when(turn == 1, F.floor(last / 2)).otherwise(F.lit(0)).cast("long")
            .alias("uploaded_reading_id"),
            F.when(turn != 2, F.lit(SEEN_AT)).alias("uploaded_at"),
            F.when(turn == 0, F.lit("Uploaded")).when(turn == 1, F.lit("Pending"))
            .otherwise(F.lit("UploadFailed")).alias("status"),
        )

    @_planned_once
    def settings(self) -> DataFrame:
        """Cursor ten days into the history, backup watermark at three tenths of the ids."""
        values = self.readings().agg(
            F.lit(FIRST_WINDOW_MS + 10 * 86_400_000).cast("long").cast("string").alias("cursor"),
            F.floor(F.max("id") * 3 / 10).cast("string").alias("backup"),
        )
        return values.select(F.expr(
            f"stack(2, '{aggregates.EXPORT_CURSOR_KEY}', cursor, '{aggregates.BACKUP_WATERMARK_KEY}', backup)"
            " AS (key, value)"
        ))

    @_planned_once
    def no_settings(self) -> DataFrame:
        return self.spark.createDataFrame([], "key string, value string")

    @_planned_once
    def partition_outcomes(self) -> DataFrame:
        """Windows upload in time order; the 90th fails, one before it is missing on disk."""
        manifest = aggregates.window_stats(self.readings(), self.tags(), self.plcs(), WINDOW_MS)
        number = ((F.col("partition_start") - FIRST_WINDOW_MS) / WINDOW_MS).cast("int")
        return manifest.select(
            names.partition_file(F.lit(SITE), F.col("partition_start")).alias("file_name"),
            F.when(number == 91, F.lit("failed")).when(number % 47 == 43, F.lit("missing"))
            .otherwise(F.lit("ok")).alias("outcome"), F.lit(AS_OF).alias("at"),
        )

    @_planned_once
    def export_outcomes(self) -> DataFrame:
        """Controller 20 fails, controller 7's file is missing."""
        key = F.col("plc_id")
        return self.plcs().select(
            names.rolling_csv_file(F.lit(SITE), F.col("name")).alias("file_name"),
            F.when(key == 20, F.lit("failed")).when(key == 7, F.lit("missing")).otherwise(F.lit("ok")).alias("outcome"),
            F.lit(AS_OF).alias("at"),
        )

    @_planned_once
    def discovered(self) -> DataFrame:
        """A later discovery run: nodes whose key ends in 0 moved to a new node id, and nodes whose
        key ends in 1 are reported twice, the second time under another name."""
        key = F.col("tag_id")
        seq = (key * 10).cast("long")
        tags = self.tags()
        moved = F.when(key % 10 == 0, F.concat("node_id", F.lit("_v2"))).otherwise(F.col("node_id"))
        once = tags.select("plc_id", moved.alias("node_id"), "tag_name", seq.alias("seq"))
        again = tags.filter(key % 10 == 1).select(
            "plc_id", "node_id", F.concat("tag_name", F.lit("_dup")).alias("tag_name"), (seq + 1).alias("seq")
        )
        return once.unionByName(again)

    @_planned_once
    def address_edges(self) -> DataFrame:
        """Folders and tags of every controller below 'i=85', with the shapes a walk must survive:
        a Server subtree, a cycle, a node with two parents, and a chain deeper than the limit."""
        plc_names = self.plcs().select("plc_id", F.col("name").alias("plc_name"))
        tags = self.tags().join(plc_names, "plc_id")
        folder = names.folder_path(F.col("tag_name"))
        to_node = lambda path: F.when(path == "", F.lit("i=85")).otherwise(F.concat(F.lit("ns=4;s=folder|"), path))
        columns = ["plc_name", "parent", "child", "node_class", "display_name", "browse_name"]
        none = F.lit(None).cast("string")
        leaf = F.element_at(names.path_segments(F.col("tag_name")), -1)
        leaves = tags.select(
            "plc_name", to_node(folder).alias("parent"), F.col("node_id").alias("child"), F.lit("Variable").alias("c"),
            F.when(F.col("tag_id") % 17 != 0, leaf).alias("d"), F.when(F.col("tag_id") % 34 != 0, leaf).alias("b"),
        ).toDF(*columns)
        folders = (
            tags.select("plc_name", F.explode(names.folder_prefixes(F.col("tag_name"))).alias("path"))
            .filter(F.col("path") != "").distinct()
            .select("plc_name", to_node(names.folder_path(F.col("path"))).alias("parent"),
                    to_node(F.col("path")).alias("child"), F.lit("Object").alias("c"), none.alias("d"), none.alias("b"))
            .toDF(*columns)
        )
        # every tag below the first folder level is also listed directly under the controller's hub
        per_plc = plc_names.select("plc_name")
        hubs = per_plc.select(
            "plc_name", F.lit("i=85"), F.lit("ns=4;s=hub"), F.lit("Object"), none, none
        ).toDF(*columns)
        second = tags.filter(F.col("tag_id") % 9 == 0).select(
            "plc_name", F.lit("ns=4;s=hub"), "node_id", F.lit("Variable"), leaf, none
        ).toDF(*columns)
        cycle = per_plc.select("plc_name", F.lit("ns=4;s=hub"), F.lit("i=85"), F.lit("Object"), none, none).toDF(*columns)
        method = per_plc.select(
            "plc_name", F.lit("ns=4;s=hub"), F.lit("ns=4;s=|var|M.Application.reset"), F.lit("Method"), none, none
        ).toDF(*columns)
        server = per_plc.select("plc_name", F.lit("i=85"), F.lit("i=2253"), F.lit("Object"), none, none).toDF(*columns)
        below_server = tags.filter(F.col("tag_id") % 8 == 0).select(
            "plc_name", F.lit("i=2253"), F.concat(F.lit("ns=4;s=|var|S.Application.diag"), F.col("tag_id").cast("string")),
            F.lit("Variable"), leaf, none,
        ).toDF(*columns)
        step = F.explode(F.sequence(F.lit(1), F.lit(34))).alias("n")
        node = lambda n: F.concat(F.lit("ns=4;s=|var|C.Application.chain"), n.cast("string"))
        chain = per_plc.select("plc_name", step).select(
            "plc_name", F.when(F.col("n") == 1, F.lit("i=85")).otherwise(node(F.col("n") - 1)), node(F.col("n")),
            F.lit("Variable"), none, none,
        ).toDF(*columns)
        parts = [folders, hubs, second, cycle, method, server, below_server, chain]
        for part in parts:
            leaves = leaves.unionByName(part)
        return leaves

    @_planned_once
    def fleet_documents(self) -> DataFrame:
        """One configuration document per ten customers, with one controller entry per customer."""
        key = F.col("c_custkey")
        site, slot = F.floor(key / 10), (key % 10)
        text = lambda c: c.cast("string")
        name = _choose(
            (key % 37 == 0, F.lit("  ")),
            ((slot == 9) & (site % 4 == 0), F.concat(F.lit("plc_"), text(site), F.lit("_8"))),
            default=F.concat(F.lit("PLC_"), text(site), F.lit("_"), text(slot)),
        )
        endpoint = _choose(
            (key % 23 == 0, F.concat(F.lit("http://10.0.0."), text(slot))), (key % 29 == 0, F.lit("")),
            default=F.concat(F.lit("opc.tcp://10."), text(site % 250), F.lit(".0."), text(slot), F.lit(":4840")),
        )
        policy = _choose((key % 19 == 0, F.lit("Basic999")), (key % 3 == 0, F.lit("none")), default=F.lit("Basic256Sha256"))
        entry = F.struct(name.alias("Name"), endpoint.alias("EndpointUrl"), policy.alias("SecurityPolicy"))
        entries = self._read("customer").select(site.alias("site"), slot.alias("slot"), entry.alias("entry"))
        listed = entries.groupBy("site").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("slot", "entry"))), lambda e: e["entry"]).alias("all")
        )
        s = F.col("site")
        mode = _choose((s % 4 == 0, F.lit("Interval")), (s % 4 == 1, F.lit("Daily")), (s % 4 == 2, F.lit("Weekly")),
                       default=F.lit("Monthly"))
        schedule = F.struct(
            mode.alias("Mode"), (30 * (s % 20)).cast("int").alias("IntervalMinutes"),
            F.when(s % 13 == 0, F.lit("")).otherwise(F.lit("02:00")).alias("DailyAtLocalTime"),
            (s % 9).cast("int").alias("DayOfWeek"), (s % 31).cast("int").alias("DayOfMonth"),
            (6 * (s % 9)).cast("int").alias("PartitionHours"), (s % 2 == 0).alias("KeepUploadedPartitions"),
        )
        provider = _choose((s % 6 == 0, F.lit("Dropbox")), (s % 6 == 1, F.lit("GoogleDrive")), default=F.lit("None"))
        return listed.select(
            "site",
            _choose((s % 7 == 0, F.lit("")), (s % 11 == 0, F.lit("a/b:c")), default=F.concat(F.lit("Site "), text(s)))
            .alias("SiteName"),
            F.when(s % 17 != 0, schedule).alias("Schedule"), (30 * (s % 5)).cast("int").alias("RetentionDays"),
            F.when(s % 8 == 5, F.slice("all", 1, 0)).otherwise(F.col("all")).alias("Plcs"),
            F.struct(
                provider.alias("Provider"), F.lit("Tags").alias("DestinationFolder"),
                F.struct(
                    F.when(s % 12 == 1, F.lit("")).otherwise(F.lit("google_client.json")).alias("CredentialsPath"),
                    F.lit("google_token").alias("TokenStorePath"),
                ).alias("GoogleDrive"),
            ).alias("Upload"),
        )

    def fleet_files(self) -> str:
        path = shared_dir(self.spark, "documents")
        self.fleet_documents().write.json(path)
        return path

    @_planned_once
    def connection_events(self) -> DataFrame:
        """Clicks and purchases connect, views and sign-ups disconnect (views without a message)."""
        nation = self.plcs().select("plc_id", "name", "endpoint_url")
        users = self._read("customer").select("c_custkey", "c_nationkey")
        rows = self._read("events").join(users, F.col("user_id") == F.col("c_custkey")).join(
            nation, F.col("c_nationkey") == F.col("plc_id")
        )
        kind = F.col("event_type")
        return rows.select(
            F.col("event_id").alias("seq"), F.col("name").alias("plc_name"),
            _choose((kind == "error", F.lit("removed")), (kind.isin("click", "purchase"), F.lit("connected")),
                    default=F.lit("disconnected")).alias("kind"),
            F.when(kind.isin("click", "purchase"), F.col("endpoint_url")).alias("endpoint_url"),
            F.when(kind == "signup", F.concat(F.lit("lost "), F.col("event_id").cast("string"))).alias("error"),
            F.col("ts").cast("timestamp").alias("at"),
        )
