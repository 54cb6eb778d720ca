"""Pruning a stored reading dataset in place, file by file, and packing its small files."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.operators import retention
from tidemark.sinks import rewrite, state
from tidemark.sources import inputs

FILE_BYTES = 128 * 1024 * 1024


def prune_dataset(spark: SparkSession, path: str, cutoff_ms: int, watermark: int | None = None) -> int:
    """Remove prunable readings from the dataset at ``path``; returns how many were removed.

    Ingest may go on meanwhile, also for old dates: only files that hold prunable rows are replaced, by what remains of
    them, and those without any other row just go. See ``sinks.rewrite`` for a run that stops.
    """
    if not state.exists(spark, path):
        return 0
    finish_prune(spark, path)
    prunable = retention.is_prunable(cutoff_ms, watermark)
    rows = inputs.readings(spark, path).filter(F.col("dt") <= F.lit(times.ms_to_date(cutoff_ms)))
    found = rewrite.input_files(rows, prunable).collect()  # a row per file that loses rows
    if found:
        mixed = [row["file"] for row in found if row["others"]]
        kept = rewrite.read_files(spark, path, mixed).filter(~prunable) if mixed else None
        rewrite.replace(spark, path, [row["file"] for row in found], kept)
    return sum(row["matching"] for row in found)


def finish_prune(spark: SparkSession, path: str) -> None:
    """Carry on with a prune or a compaction that stopped."""
    rewrite.finish(spark, path)


def compact_dataset(
    spark: SparkSession, path: str, before_ms: int, file_bytes: int = FILE_BYTES, least: int = 4
) -> tuple[int, int]:
    """Pack the small files of dates that end by ``before_ms`` into sorted ones of about ``file_bytes``: files before and after.

    Files of half that size or more stay as they are. A date with fewer than ``least`` small files, or whose small files would
    not become fewer, is left alone. Rows that arrive meanwhile, also for these dates, are not touched.
    """
    if not state.exists(spark, path):
        return 0, 0
    finish_prune(spark, path)
    small: dict[str, list[rewrite.StoredFile]] = defaultdict(list)
    for file in rewrite.stored_files(spark, path):
        if file.day < times.ms_to_date(before_ms).isoformat() and file.size < file_bytes / 2:
            small[file.day].append(file)
    bins = {day: -(-sum(f.size for f in files) // file_bytes) for day, files in small.items()}
    chosen = {day: files for day, files in small.items() if len(files) >= max(2, least) and bins[day] < len(files)}
    uris = [f.uri for files in chosen.values() for f in files]
    if not uris:
        return 0, 0
    before = len(rewrite.stored_files(spark, path))
    rewrite.replace(spark, path, uris, rewrite.read_files(spark, path, uris), sum(bins[day] for day in chosen))
    return len(uris), len(uris) + len(rewrite.stored_files(spark, path)) - before


def sweep_dataset(
    spark: SparkSession, path: str, partitions: DataFrame, settings: DataFrame, as_of_ms: int, days: int,
    upload_enabled: bool,
) -> int:
    """A retention sweep over the stored dataset; returns how many readings were removed."""
    decision = retention.sweep_decision(partitions, settings, as_of_ms, days, upload_enabled)
    return 0 if decision is None else prune_dataset(spark, path, *decision)
