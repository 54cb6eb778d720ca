"""Exact duplicates: a tree merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.digest_tree import FAN_IN, keep_rows, normalised, tree_merge
from tidemark.session import cut_lineage


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN, rounds: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of ASCII white space became one space. Only digests
    travel: SHA-256, and beside it the byte length and an independent 64-bit hash, which are part of the
    identity and so verify it in every round.

    Null texts count as empty; all empty texts are one group. The smallest id of a group stays; a null id
    is larger than any other. Of rows equal in id and text, one stays. An empty table gives an empty
    result. Other columns are ignored.
    """
    text = normalised(F.col(text_col))
    members = cut_lineage(docs.select(
        F.sha2(text, 256).alias("text_sha256"), F.octet_length(text).alias("n_bytes"), F.xxhash64(text).alias("check"),
        F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("seq")).alias("me"),
    ))
    merged = tree_merge(members, ["text_sha256", "n_bytes", "check"], "me", fan_in, rounds)
    return merged.select(
        F.col("me.id").alias(id_col), F.col("first.id").alias("keep_id"), "group_size",
        (F.col("me.seq") == F.col("first.seq")).alias("kept"), "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    decided = exact_dedup(docs, id_col, text_col).filter("kept")
    return keep_rows(docs, decided.select(F.col(id_col).alias("id"), "text_sha256"), id_col, text_col)
