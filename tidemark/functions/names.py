"""Node ids, tag names, folder paths and file names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The application marker inside a symbolic node id, the node-id form, the
# characters no file name may hold, and the name used for a blank site.
APPLICATION_MARKER = ".Application."
NODE_ID_PATTERN = r"(?s)^(?:ns=(\d+);)?[isgb]=(.*)$"
INVALID_FILE_CHARS = r'[\x00-\x1f<>:"/\\|?*]'
BLANK_SITE = "Site"
FOLDER_ESCAPES = r"""[\x01-\x1F\x7F"#%'*/:=?\\{\[\]^]"""


def namespace_index(node_id: Column) -> Column:
    """The namespace of a node id; ids without one are in namespace 0, numbers too large to be one give null."""
    found = F.regexp_extract(node_id, NODE_ID_PATTERN, 1)
    return F.when(found == "", F.lit(0)).otherwise(found.try_cast("int"))


def identifier(node_id: Column) -> Column:
    return F.when(node_id.rlike(NODE_ID_PATTERN), F.regexp_extract(node_id, NODE_ID_PATTERN, 2))


def tag_name(node_id: Column, leaf: Column) -> Column:
    """The path below the first application marker of a symbolic id, else the leaf name."""
    symbolic = F.when(node_id.rlike(r"^(?:ns=\d+;)?s="), identifier(node_id))
    at = F.instr(symbolic, APPLICATION_MARKER)
    tail = symbolic.substr(at + len(APPLICATION_MARKER), F.length(symbolic))
    return F.when(at > 0, tail).otherwise(leaf)


def leaf_name(display_name: Column, browse_name: Column, node_id: Column) -> Column:
    return F.coalesce(display_name, browse_name, node_id)


def path_segments(name: Column) -> Column:
    return F.split(name, "[.]", -1)


def folder_path(name: Column) -> Column:
    """Everything before the last dot; empty for a tag at the root."""
    parts = path_segments(name)
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".")


def folder_prefixes(name: Column) -> Column:
    """Every folder above a tag, from the root (empty path) downwards."""
    parts = path_segments(name)
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def file_name_part(name: Column) -> Column:
    cleaned = F.regexp_replace(name, INVALID_FILE_CHARS, "_")
    return F.when(is_blank(cleaned), F.lit(BLANK_SITE)).otherwise(cleaned)


def is_blank(text: Column) -> Column:
    """Null, empty or nothing but Unicode white space."""
    return text.isNull() | text.rlike(r"(?U)^\s*$")


def partition_file(site: Column, start_ms: Column) -> Column:
    stamp = F.date_format(F.timestamp_millis(start_ms), "yyyyMMdd'T'HHmm'Z'")
    return F.concat(file_name_part(site), F.lit("-"), stamp, F.lit(".parquet"))


def rolling_csv_file(site: Column, plc_name: Column) -> Column:
    return F.concat(file_name_part(site), F.lit("-"), file_name_part(plc_name), F.lit(".csv"))


def folder_name(value: Column) -> Column:
    """A value as it stands in the name of a partition folder, signs that folders cannot hold as %XX."""
    escaped = F.transform(F.split(value, ""), lambda c: F.when(
        c.rlike(FOLDER_ESCAPES), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.array_join(escaped, "")


def window_csv_file(site: Column, plc_name: Column, start_ms: Column, end_ms: Column) -> Column:
    start, end = (F.date_format(F.timestamp_millis(ms), "yyyyMMddHHmm") for ms in (start_ms, end_ms))
    return F.concat(
        file_name_part(site), F.lit("-"), file_name_part(plc_name), F.lit("-"), start, F.lit("_"), end, F.lit(".csv")
    )
