"""The reading scans: by controller, by closed or half-open time range, newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import times, values
from tidemark.operators.joins import lookup_join, named_readings

LISTED_TAGS = 1000


def in_range(readings: DataFrame, start_ms: int, end_ms: int, closed: bool) -> DataFrame:
    """Readings between two instants; the end belongs to a closed range only.

    A stored dataset also gets the date range, so that whole ``dt`` partitions are never listed.
    """
    ts = F.col("ts_utc")
    inside = ts.between(start_ms, end_ms) if closed else (ts >= start_ms) & (ts < end_ms)
    if "dt" in readings.columns:
        last = end_ms if closed else end_ms - 1
        first_day, last_day = times.ms_to_date(start_ms), times.ms_to_date(max(last, start_ms))
        readings = readings.filter(F.col("dt").between(F.lit(first_day), F.lit(last_day)))
    return readings.filter(inside)


def _of_plc(tags: DataFrame, plc_id: int | None) -> DataFrame:
    return tags if plc_id is None else tags.filter(F.col("plc_id") == plc_id)


def of_tags(readings: DataFrame, tags: DataFrame) -> DataFrame:
    """The readings of some tags, by a filter that reaches the files.

    Stored files are sorted by tag, and tags of a controller are numbered together, so statistics leave most row groups
    unread. A few tags are listed, of many the range is given and the join after this decides.
    """
    ids = [row[0] for row in tags.select("tag_id").limit(LISTED_TAGS + 1).collect()]
    if len(ids) <= LISTED_TAGS:
        return readings.filter(F.col("tag_id").isin(ids)) if ids else readings.filter(F.lit(False))
    low, high = tags.agg(F.min("tag_id"), F.max("tag_id")).first()
    return readings.filter(F.col("tag_id").between(low, high))


def export_rows(readings: DataFrame, tags: DataFrame, plcs: DataFrame, plc_id: int | None = None) -> DataFrame:
    """Every reading of one controller (or of all), with the quality as a name.

    Restricting the tags before the join keeps the lookup small and leaves the reading scan as the
    only large input.
    """
    tags = _of_plc(tags, plc_id)
    rows = named_readings(readings if plc_id is None else of_tags(readings, tags), tags, plcs)
    return rows.select(
        "id", "ts_utc", "plc_name", "tag_name", "value", "value_text",
        values.quality_name(F.col("quality")).alias("quality"),
    )


def export_rows_in_range(
    readings: DataFrame, tags: DataFrame, plcs: DataFrame, start_ms: int, end_ms: int, plc_id: int | None = None
) -> DataFrame:
    """As ``export_rows`` for a closed range: a reading exactly at the end is included."""
    return export_rows(in_range(readings, start_ms, end_ms, closed=True), tags, plcs, plc_id)


def range_readings(readings: DataFrame, tags: DataFrame, plcs: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """All controllers, half-open range, raw quality code and receive time."""
    return named_readings(in_range(readings, start_ms, end_ms, closed=False), tags, plcs).select(
        "id", "ts_utc", "ts_received_utc", "plc_name", "tag_name", "value", "value_text", "quality"
    )


def latest_readings(readings: DataFrame, tags: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` readings by id with their tag names; a per-task top-n, never a full sort.

    Of a stored dataset the newest dates are asked first: once they have ``n`` readings of known tags, the lowest of those ids
    is a bound that statistics apply to the files of all other dates, of which few hold an id as high.
    """
    known = tags.select("tag_id", "tag_name")
    if "dt" in readings.columns:
        readings = readings.filter(F.col("id") >= _id_floor(readings, known.select("tag_id"), n))
    return (
        lookup_join(readings.select("id", "tag_id", "ts_utc", "value", "quality"), known, ["tag_id"], salt_on="id")
        .orderBy(F.desc("id")).limit(n)
        .select("id", "tag_name", times.seconds_text(F.col("ts_utc")).alias("ts"), "value", "quality")
    )


def _id_floor(readings: DataFrame, known: DataFrame, n: int) -> int:
    """An id that at least ``n`` readings of known tags reach, as low as the newest dates that hold so many make it; 0 if there are fewer."""
    days = [row[0] for row in readings.select("dt").distinct().orderBy(F.desc("dt")).collect()]  # a row per stored date
    found: list[int] = []
    for day in days:
        rows = lookup_join(readings.filter(F.col("dt") == F.lit(day)).select("id", "tag_id"), known, ["tag_id"], "left_semi", salt_on="id")
        found += [row[0] for row in rows.orderBy(F.desc("id")).limit(n).select("id").collect()]
        if len(found) >= n > 0:
            return sorted(found, reverse=True)[n - 1]
    return 0


def csv_columns(rows: DataFrame) -> list[Column]:
    """The five text columns of an exported CSV row."""
    return [
        times.iso_utc(rows["ts_utc"]).alias("timestamp_utc"), rows["plc_name"], rows["tag_name"],
        values.display_value(rows["value"], rows["value_text"]).alias("value"), rows["quality"],
    ]
