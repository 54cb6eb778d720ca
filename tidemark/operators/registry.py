"""Controllers, tags and their selection: reconciling, upserting, filtering, naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import names, rules
from tidemark.operators.joins import inserted, latest_by_key, lookup_join, touched, upsert
from tidemark.operators.shards import with_dense_number

# The default tag filter, the type of a tag nothing was read from yet, and the type
# name of an empty notification.
DEFAULT_NAMESPACES = [4]
DEFAULT_TOKENS = ["|var|", ".Application."]
UNKNOWN_TYPE = "Unknown"
NULL_TYPE = "Null"


# Filters

def passes_tag_filter(
    node_id: Column,
    namespaces: list[int] | None = None,
    tokens: list[str] | None = None,
    exclude_namespace_zero: bool = True,
) -> Column:
    """Namespace allowed (an empty list allows any) and every token present, ignoring case."""
    namespaces = DEFAULT_NAMESPACES if namespaces is None else namespaces
    tokens = DEFAULT_TOKENS if tokens is None else tokens
    namespace = names.namespace_index(node_id)
    keep = F.lit(True)
    if exclude_namespace_zero:
        keep = keep & (namespace != 0)
    if namespaces:
        keep = keep & namespace.isin(namespaces)
    for token in tokens:
        keep = keep & F.coalesce(F.contains(F.lower(names.identifier(node_id)), F.lit(token.lower())), F.lit(False))
    return keep


def is_live() -> Column:
    """Exposed by the controller and selected for logging."""
    return (F.col("active") == 1) & (F.col("enabled") == 1)


def enabled_bindings(tags: DataFrame) -> DataFrame:
    return tags.filter(is_live()).select("plc_id", "node_id", "tag_id", "deadband_override")


def tag_selection(tags: DataFrame) -> DataFrame:
    """Active tags with their selection flag, by controller and name."""
    return (
        tags.filter(F.col("active") == 1)
        .select("plc_id", "tag_id", "tag_name", (F.col("enabled") != 0).alias("enabled"))
        .orderBy("plc_id", "tag_name")
    )


def selection(tags: DataFrame, plcs: DataFrame, version: int = 0) -> DataFrame:
    """Every tag as a stream has to know it: controller and node, whether its readings are wanted, its deadband."""
    plc_names = plcs.select("plc_id", F.col("name").alias("plc_name"))
    named = lookup_join(tags, plc_names, ["plc_id"], salt_on="tag_id")
    return named.select("plc_name", "node_id", "tag_id", is_live().alias("live"), "deadband_override", F.lit(version).cast("long").alias("version"))


def selection_changes(current: DataFrame, published: DataFrame) -> DataFrame:
    """The rows of a selection that say something else than the newest published row of their node."""
    newest = latest_by_key(published, ["plc_name", "node_id"], "version")
    columns = ["tag_id", "live", "deadband_override"]
    known = newest.select("plc_name", "node_id", F.struct(*columns).alias("known"))
    joined = current.join(known, ["plc_name", "node_id"], "left")
    return joined.filter(~F.col("known").eqNullSafe(F.struct(*columns))).select(*current.columns)


def resolve_notifications(raw: DataFrame, tags: DataFrame, plcs: DataFrame) -> DataFrame:
    """Attach the tag id to raw notifications; those of unknown or deselected tags drop out."""
    plc_names = plcs.select("plc_id", F.col("name").alias("plc_name"))
    live = tags.filter(is_live()).select("plc_id", "node_id", "tag_id")
    bindings = lookup_join(live, plc_names, ["plc_id"], salt_on="tag_id").drop("plc_id")
    return lookup_join(raw, bindings, ["plc_name", "node_id"], salt_on="seq")


# Tables: controllers and tags

def upsert_plcs(plcs: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or update controllers by name. ``incoming``: name, endpoint_url, security_policy, seq.

    A known name keeps its id; new names get the next ids in the order they first appeared.
    """
    newest = latest_by_key(incoming.select("name", "endpoint_url", "security_policy", "seq"), ["name"], "seq")
    arrival = incoming.groupBy("name").agg(F.min("seq").alias("_arrival"))
    unknown = arrival.join(plcs.select("name"), "name", "left_anti")
    next_ids = _next_ids(unknown, "_arrival", plcs, "plc_id").select("name", "plc_id")
    new = newest.join(next_ids, "name", "left").select("plc_id", "name", "endpoint_url", "security_policy")
    rule = {"plc_id": F.coalesce(F.col("o.plc_id"), F.col("n.plc_id"))}
    return upsert(plcs, new, ["name"], rule)


def _next_ids(rows: DataFrame, order: str, table: DataFrame, id_column: str) -> DataFrame:
    """Number ``rows`` along ``order`` after the highest id in ``table``."""
    highest = table.agg(F.max(id_column)).first()[0]
    base = 0 if highest is None else highest
    kind = table.schema[id_column].dataType
    numbered = with_dense_number(rows, order, "_number")
    return numbered.withColumn(id_column, (F.col("_number") + base).cast(kind)).drop("_number")


def sync_tags(tags: DataFrame, discovered: DataFrame, scanned: DataFrame, as_of: str) -> DataFrame:
    """Bring the tag registry in step with a discovery run; nothing is ever deleted.

    ``discovered``: plc_id, node_id, tag_name, seq (a node may occur twice: the last name wins).
    ``scanned``: plc_id of every controller that was browsed, also those that returned nothing.
    New tags start active, enabled and of unknown type; known ones are refreshed and keep their
    selection, type, deadband and first sighting; missing ones of a scanned controller go inactive.
    """
    keys = ["plc_id", "node_id"]
    per_node = discovered.groupBy(*keys).agg(
        F.max_by("tag_name", "seq").alias("tag_name"), F.min("seq").alias("_arrival")
    )
    unknown = per_node.join(tags.select(*keys), keys, "left_anti")
    next_ids = _next_ids(unknown.select(*keys, "_arrival"), "_arrival", tags, "tag_id").select(*keys, "tag_id")
    text, double = F.lit(None).cast("string"), F.lit(None).cast("double")
    new = per_node.join(next_ids, keys, "left").select(
        "tag_id", *keys, "tag_name", F.lit(UNKNOWN_TYPE).alias("data_type"), text.alias("units"),
        double.alias("deadband_override"), F.lit(as_of).alias("first_seen_at"),
        F.lit(as_of).alias("last_seen_at"), F.lit(1).alias("active"), F.lit(1).alias("enabled"),
    )
    old = lookup_join(tags, scanned.select("plc_id").distinct().withColumn("_scanned", F.lit(1)), ["plc_id"], "left",
                      salt_on="tag_id")
    missing = F.col("o._scanned").isNotNull() & ~touched()
    kept = ["data_type", "units", "deadband_override", "first_seen_at", "enabled"]
    column_rules = {
        "tag_id": F.coalesce(F.col("o.tag_id"), F.col("n.tag_id")),
        "active": F.when(touched(), F.lit(1)).when(missing, F.lit(0)).otherwise(F.col("o.active")),
        **{c: F.when(inserted(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in kept},
    }
    merged = upsert(old, new.withColumn("_scanned", F.lit(1)), keys, column_rules)
    return merged.select(*tags.columns)


def set_tags_enabled(tags: DataFrame, saved: DataFrame, chosen: DataFrame) -> DataFrame:
    """Make the selection of every controller in ``saved`` exactly ``chosen`` (plc_id, tag_id).

    Active tags that are not chosen go off; chosen ones go on even while inactive.
    """
    marked = lookup_join(tags, saved.select("plc_id").distinct().withColumn("_saved", F.lit(1)), ["plc_id"], "left",
                         salt_on="tag_id")
    picks = chosen.select("plc_id", "tag_id").distinct().withColumn("_chosen", F.lit(1))
    marked = marked.join(picks, ["plc_id", "tag_id"], "left")
    on = F.col("_saved").isNotNull() & F.col("_chosen").isNotNull()
    off = F.col("_saved").isNotNull() & (F.col("active") == 1)
    enabled = F.when(on, F.lit(1)).when(off, F.lit(0)).otherwise(F.col("enabled"))
    return marked.withColumn("enabled", enabled).select(*tags.columns)


def toggle_subtree(tags: DataFrame, folder: str, on: bool, plc_id: int | None = None) -> DataFrame:
    """Switch every active tag below a folder (whole path segments) and save the selection."""
    inside = F.col("tag_name").startswith(folder + ".") if folder else F.lit(True)
    scope = tags if plc_id is None else tags.filter(F.col("plc_id") == plc_id)
    selected = F.when(inside, F.lit(on)).otherwise(F.col("enabled") == 1)
    chosen = scope.filter((F.col("active") == 1) & selected)
    return set_tags_enabled(tags, scope, chosen)


def first_types(typed: DataFrame) -> DataFrame:
    """The first type other than ``Null`` seen per tag. ``typed``: tag_id, data_type, id.

    The first id per tag and type is found first: that is a hash aggregation with a number as its
    only state, and leaves a few rows per tag for the choice of the type.
    """
    seen = typed.filter(F.col("data_type") != NULL_TYPE)
    per_type = seen.groupBy("tag_id", "data_type").agg(F.min("id").alias("_first"))
    return per_type.groupBy("tag_id").agg(F.min_by("data_type", "_first").alias("data_type"))


def set_data_types(tags: DataFrame, typed: DataFrame) -> DataFrame:
    types = first_types(typed).withColumnRenamed("data_type", "_type")
    return (
        tags.join(types, "tag_id", "left")
        .withColumn("data_type", F.coalesce("_type", "data_type")).select(*tags.columns)
    )


def of_unknown_type(tags: DataFrame) -> DataFrame:
    return tags.filter(F.col("data_type") == UNKNOWN_TYPE)


def first_names(discovered: DataFrame) -> DataFrame:
    """The first name a node was reported under."""
    return discovered.groupBy("plc_id", "node_id").agg(F.min_by("tag_name", "seq").alias("tag_name"))


def display_names(bindings: DataFrame, discovered: DataFrame) -> DataFrame:
    """What a subscribed item is called: its discovered name, else its node id."""
    found = first_names(discovered).withColumnRenamed("tag_name", "_name")
    return (
        bindings.join(found, ["plc_id", "node_id"], "left")
        .withColumn("display_name", F.coalesce("_name", "node_id")).drop("_name")
    )


def add_missing_column(df: DataFrame, column: str, default: object, kind: str) -> DataFrame:
    """Schema upgrade: older copies lack the column, newer ones keep theirs."""
    present = {c.lower() for c in df.columns}
    return df if column.lower() in present else df.withColumn(column, F.lit(default).cast(kind))


# Fleet registries read from site documents

def explode_plcs(documents: DataFrame) -> DataFrame:
    """One row per configured controller, with its position in the site's list."""
    return documents.select("site", F.posexplode("Plcs").alias("position", "_plc")).select(
        "site", "position", F.col("_plc.Name").alias("name"),
        F.col("_plc.EndpointUrl").alias("endpoint_url"), F.col("_plc.SecurityPolicy").alias("security_policy"),
    )


def validate_registry(registry: DataFrame) -> DataFrame:
    error = rules.plc_error(F.col("name"), F.col("endpoint_url"), F.col("security_policy"))
    return registry.withColumn("error", error)


def validate_schedules(documents: DataFrame) -> DataFrame:
    """Per site: the upload period in hours and the first broken schedule rule."""
    schedule = [F.col(f"Schedule.{c}") for c in ("Mode", "IntervalMinutes", "DayOfWeek", "DayOfMonth", "PartitionHours")]
    return documents.filter(F.col("Schedule").isNotNull()).select(
        "site", schedule[0].alias("mode"), schedule[4].alias("partition_hours"),
        rules.upload_period_hours(schedule[0], schedule[1]).alias("upload_period_hours"),
        rules.schedule_error(*schedule).alias("error"),
    )


def duplicate_names(registry: DataFrame) -> DataFrame:
    """Names that occur more than once in a site's list, ignoring case, as first written."""
    return (
        registry.groupBy("site", F.lower("name").alias("name_key"))
        .agg(F.min_by("name", "position").alias("name"), F.count("*").alias("copies"))
        .filter(F.col("copies") > 1)
    )


def upsert_registry(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Add controllers or replace the ones of the same name, ignoring case; the last change wins."""
    columns = ["site", "name", "endpoint_url", "security_policy"]
    newest = latest_by_key(changes.withColumn("_key", F.lower("name")), ["site", "_key"], "seq")
    return remove_from_registry(registry, changes).unionByName(newest.select(*columns))


def remove_from_registry(registry: DataFrame, names_to_remove: DataFrame) -> DataFrame:
    columns = ["site", "name", "endpoint_url", "security_policy"]
    keys = names_to_remove.select("site", F.lower("name").alias("_key")).distinct()
    return registry.withColumn("_key", F.lower("name")).join(keys, ["site", "_key"], "left_anti").select(*columns)


def registry_diff(running: DataFrame, desired: DataFrame) -> DataFrame:
    """What to do with each controller to get from the running set to the desired one.

    ``remove``: not wanted any more, or changed into something invalid; ``restart``: connection
    changed; ``start``; ``skip``: wanted, not running and invalid; ``keep``.
    """
    keyed = [
        df.select("site", F.lower("name").alias("name_key"), F.struct("name", "endpoint_url", "security_policy").alias(side))
        for df, side in ((running, "r"), (desired, "d"))
    ]
    both = keyed[0].join(keyed[1], ["site", "name_key"], "full_outer")
    error = rules.plc_error(F.col("d.name"), F.col("d.endpoint_url"), F.col("d.security_policy"))
    same = (F.lower("r.endpoint_url") == F.lower("d.endpoint_url")) & (
        F.lower("r.security_policy") == F.lower("d.security_policy")
    )
    wanted, runs = F.col("d").isNotNull(), F.col("r").isNotNull()
    action = (
        F.when(~wanted, F.lit("remove"))
        .when(runs & F.coalesce(same, F.lit(False)), F.lit("keep"))
        .when(runs & F.col("error").isNotNull(), F.lit("remove"))
        .when(F.col("error").isNotNull(), F.lit("skip"))
        .when(runs, F.lit("restart"))
        .otherwise(F.lit("start"))
    )
    judged = both.withColumn("error", F.when(wanted, error)).withColumn("action", action)
    return judged.select(
        "site", F.coalesce("d.name", "r.name").alias("name"), "action",
        F.when(F.col("action").isin("remove", "skip"), F.col("error")).alias("error"),
    )


def backfill_documents(
    documents: DataFrame, site_name: str, daily_at: str = "02:00", retention_days: int = 90
) -> DataFrame:
    """Give documents written by older versions the values they lack."""
    default = F.struct(
        F.lit(rules.DAILY).alias("Mode"), F.lit(360).alias("IntervalMinutes"), F.lit(daily_at).alias("DailyAtLocalTime"),
        F.lit(1).alias("DayOfWeek"), F.lit(1).alias("DayOfMonth"), F.lit(6).alias("PartitionHours"),
        F.lit(False).alias("KeepUploadedPartitions"),
    )
    no_schedule = F.col("Schedule").isNull() | names.is_blank(F.col("Schedule.DailyAtLocalTime"))
    no_retention = F.coalesce(F.col("RetentionDays"), F.lit(0)) <= 0
    return (
        documents
        .withColumn("SiteName", F.when(names.is_blank(F.col("SiteName")), F.lit(site_name)).otherwise(F.col("SiteName")))
        .withColumn("Schedule", F.when(no_schedule, default).otherwise(F.col("Schedule")))
        .withColumn("RetentionDays", F.when(no_retention, F.lit(retention_days)).otherwise(F.col("RetentionDays")))
    )


def config_issues(documents: DataFrame) -> DataFrame:
    """Every issue of every site document: site, severity, message."""
    def issue(df, severity, message):
        return df.select("site", F.lit(severity).alias("severity"), message.alias("message"))

    registry = validate_registry(explode_plcs(documents))
    unnamed = issue(documents.filter(names.is_blank(F.col("SiteName"))), "Warning", F.lit(rules.SITE_NAME_EMPTY))
    listed = F.coalesce(F.size("Plcs"), F.lit(0))
    empty = issue(documents.filter(listed <= 0), "Warning", F.lit(rules.NO_PLCS))
    broken = issue(
        registry.filter(F.col("error").isNotNull()), "Error",
        F.format_string(rules.PLC_ERROR, F.coalesce("name", F.lit("")), F.col("error")),
    )
    twice = issue(duplicate_names(registry), "Error", F.format_string(rules.DUPLICATE_NAME, F.col("name")))
    provider = rules.provider_error(F.col("Upload.Provider"), F.col("Upload.GoogleDrive.CredentialsPath"))
    uploads = documents.withColumn("_error", provider).filter(F.col("_error").isNotNull())
    return unnamed.unionByName(empty).unionByName(broken).unionByName(twice).unionByName(
        issue(uploads, "Error", F.col("_error"))
    )


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("issues"))
