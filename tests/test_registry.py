"""Tag and controller registries, selections, folder tree, site documents."""

import json

from helpers import rows
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import health, joins, registry, tree
from tidemark.plans import fleet
from tidemark.sources import inputs


def tags(spark, *lines):
    data = [(tag, plc, node, name, "Double", "bar", 2.0, "t0", "t0", active, enabled) for tag, plc, node, name, active, enabled in lines]
    return spark.createDataFrame(data, schemas.TAGS)


def found(spark, *lines):
    return spark.createDataFrame(list(lines) or [], "plc_id int, node_id string, tag_name string, seq long")


def test_sync_adds_refreshes_and_deactivates(spark):
    old = tags(spark, (1, 1, "a", "A", 1, 1), (2, 1, "b", "B", 1, 0), (3, 1, "gone", "G", 1, 1), (4, 2, "c", "C", 1, 1),
               (5, 3, "d", "D", 1, 1), (6, 1, "back", "K", 0, 0))
    run = found(spark, (1, "a", "A2", 5), (1, "b", "B", 6), (1, "new", "first", 7), (1, "new", "second", 8), (1, "back", "K", 9),
                (1, "newer", "N", 3))
    scanned = spark.createDataFrame([(1,), (3,)], "plc_id int")  # controller 3 answered with nothing
    new = registry.sync_tags(old, run, scanned, "t1")
    assert rows(new, "tag_id", "node_id", "tag_name", "data_type", "first_seen_at", "last_seen_at", "active", "enabled") == [
        (1, "a", "A2", "Double", "t0", "t1", 1, 1), (2, "b", "B", "Double", "t0", "t1", 1, 0),
        (3, "gone", "G", "Double", "t0", "t0", 0, 1), (4, "c", "C", "Double", "t0", "t0", 1, 1),
        (5, "d", "D", "Double", "t0", "t0", 0, 1), (6, "back", "K", "Double", "t0", "t1", 1, 0),
        (7, "newer", "N", "Unknown", "t1", "t1", 1, 1), (8, "new", "second", "Unknown", "t1", "t1", 1, 1),
    ]
    assert rows(registry.sync_tags(new, run, scanned, "t1")) == rows(new)
    assert rows(registry.first_names(run).filter("node_id = 'new'"), "tag_name") == [("first",)]


def test_first_sync_of_an_empty_registry(spark):
    new = registry.sync_tags(tags(spark).limit(0), found(spark, (1, "a", "A", 1)), found(spark, (1, "a", "A", 1)), "t1")
    assert rows(new, "tag_id", "active") == [(1, 1)]


def test_upsert_plcs_keeps_ids(spark):
    old = spark.createDataFrame([(4, "P", "u", "None")], schemas.PLCS)
    incoming = spark.createDataFrame(
        [("Q", "q1", "None", 1), ("P", "u2", "X", 2), ("Q", "q2", "None", 3), ("A", "a", "None", 4)],
        "name string, endpoint_url string, security_policy string, seq long",
    )
    assert rows(registry.upsert_plcs(old, incoming).select("plc_id", "name", "endpoint_url", "security_policy")) == [
        (4, "P", "u2", "X"), (5, "Q", "q2", "None"), (6, "A", "a", "None")
    ]


def test_selection_is_set_exactly(spark):
    old = tags(spark, (1, 1, "a", "A", 1, 1), (2, 1, "b", "B", 1, 0), (3, 1, "c", "C", 0, 0), (4, 1, "d", "D", 0, 1), (5, 2, "e", "E", 1, 1))
    saved = spark.createDataFrame([(1,)], "plc_id int")
    chosen = spark.createDataFrame([(1, 2), (1, 3), (2, 99)], "plc_id int, tag_id int")
    assert rows(registry.set_tags_enabled(old, saved, chosen), "tag_id", "enabled") == [(1, 0), (2, 1), (3, 1), (4, 1), (5, 1)]
    nothing = chosen.limit(0)
    assert rows(registry.set_tags_enabled(old, saved, nothing), "tag_id", "enabled") == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)]


def test_subtree_matches_whole_segments(spark):
    old = tags(spark, (1, 1, "a", "A.x", 1, 0), (2, 1, "b", "AB.x", 1, 0), (3, 1, "c", "A.y", 0, 0), (4, 2, "d", "A.x", 1, 0))
    on = registry.toggle_subtree(old, "A", True, plc_id=1)
    assert rows(on, "tag_id", "enabled") == [(1, 1), (2, 0), (3, 0), (4, 0)]
    assert rows(registry.toggle_subtree(on, "", False), "tag_id", "enabled") == [(1, 0), (2, 0), (3, 0), (4, 0)]


def test_rollup_and_order(spark):
    old = tags(spark, (1, 1, "a", "F.x", 1, 1), (2, 1, "b", "F.G.y", 1, 0), (3, 1, "c", "top", 1, 1), (4, 1, "d", "F.off", 0, 1), (5, 1, "e", "b.z", 1, 0))
    assert rows(tree.folder_rollup(old), "folder", "leaves", "selected", "state") == [
        ("", 4, 2, "partial"), ("F", 2, 1, "partial"), ("F.G", 1, 0, "none"), ("b", 1, 0, "none")
    ]
    order = [(r["parent"], r["name"], r["is_leaf"]) for r in tree.sibling_order(old).collect()]
    assert order == [("", "F", 0), ("", "b", 0), ("", "top", 1), ("F", "G", 0), ("F", "x", 1), ("F.G", "y", 1), ("b", "z", 1)]


def test_types_skip_empty_notifications(spark):
    typed = spark.createDataFrame([(1, "Null", 1), (1, "Int32", 3), (1, "Double", 2), (2, "Null", 4)], "tag_id int, data_type string, id long")
    old = tags(spark, (1, 1, "a", "A", 1, 1), (2, 1, "b", "B", 1, 1))
    assert rows(registry.set_data_types(old, typed), "tag_id", "data_type") == [(1, "Double"), (2, "Double")]
    assert rows(registry.first_types(typed)) == [(1, "Double")]


def test_controllers_with_tags_only(spark):
    plcs = spark.createDataFrame([(1, "P", "", ""), (2, "Q", "", "")], schemas.PLCS)
    assert rows(joins.plcs_with_tags(plcs, tags(spark, (1, 1, "a", "A", 0, 0))), "name") == [("P",)]


def test_site_documents_indented_or_one_per_line(spark, tmp_path):
    document = {
        "site": 1, "SiteName": " ", "RetentionDays": 0, "Schedule": {"Mode": "Weekly", "DailyAtLocalTime": " "},
        "Plcs": [{"Name": "A", "EndpointUrl": "opc.tcp://a", "SecurityPolicy": "None"}, {"Name": "a", "EndpointUrl": "x", "SecurityPolicy": "None"}],
        "Upload": {"Provider": "googledrive", "GoogleDrive": {"CredentialsPath": ""}},
    }
    (tmp_path / "indented.json").write_text(json.dumps(document, indent=2))
    (tmp_path / "lines.jsonl").write_text(json.dumps(document) + "\n" + json.dumps({**document, "site": 2, "Plcs": []}))
    single = inputs.site_documents(spark, str(tmp_path / "indented.json"), one_per_line=False)
    many = inputs.site_documents(spark, str(tmp_path / "lines.jsonl"))
    assert single.count() == 1 and many.count() == 2
    assert rows(fleet.config_report(many)) == [(1, "Error", 3), (1, "Warning", 1), (2, "Error", 1), (2, "Warning", 2)]
    filled = registry.backfill_documents(single, "Seed", "04:00", 30).first()
    assert (filled["SiteName"], filled["Schedule"]["Mode"], filled["Schedule"]["PartitionHours"], filled["RetentionDays"]) == ("Seed", "Daily", 6, 30)


def test_registry_changes_ignore_case(spark):
    schema = "site long, name string, endpoint_url string, security_policy string"
    good = "opc.tcp://h"
    running = spark.createDataFrame([(1, "A", good, "None"), (1, "B", good, "None"), (1, "C", good, "None"), (1, "D", good, "None")], schema)
    changes = spark.createDataFrame(
        [(1, "a", "x", "None", 1), (1, "A", good, "none", 2), (1, "b", "bad", "None", 3), (1, "E", good, "None", 4), (1, "F", "bad", "None", 5),
         (1, "d", good + "2", "None", 6)], schema + ", seq long",
    )
    desired = registry.upsert_registry(running, changes)
    assert len(rows(desired)) == 6 and (1, "A", good, "none") in rows(desired)
    desired = registry.remove_from_registry(desired, spark.createDataFrame([(1, "c")], "site long, name string"))
    actions = {r["name"]: (r["action"], r["error"] is not None) for r in registry.registry_diff(running, desired).collect()}
    assert actions == {
        "A": ("keep", False), "b": ("remove", True), "C": ("remove", False), "d": ("restart", False), "E": ("start", False), "F": ("skip", True)
    }


def test_connection_state(spark):
    data = [
        (1, "P", "connected", "u1", None), (2, "P", "disconnected", None, "lost"), (3, "P", "disconnected", None, None),
        (1, "Q", "disconnected", None, "bad"), (2, "Q", "connected", "u2", None), (1, "R", "connected", "u3", None), (2, "R", "removed", None, None),
        (1, "S", "connected", "u4", None), (2, "S", "removed", None, None), (3, "S", "disconnected", None, None),
    ]
    events = spark.createDataFrame(data, "seq long, plc_name string, kind string, endpoint_url string, error string").withColumn("at", F.timestamp_millis(F.col("seq")))
    assert rows(health.connection_state(events)) == [
        ("P", False, "u1", "1970-01-01T00:00:00.001Z", "lost"), ("Q", True, "u2", "1970-01-01T00:00:00.002Z", None), ("S", False, "", None, None)
    ]


def test_health_summary_without_rows(spark):
    none = spark.createDataFrame([], schemas.READINGS)
    row = health.health_summary(none, none, spark.createDataFrame([], schemas.EXPORT_STATE), "S").first()
    assert tuple(row) == ("S", 0, None, 0, None, None)


def test_add_missing_column(spark):
    frame = spark.createDataFrame([(1,)], "Enabled int")
    assert registry.add_missing_column(frame, "enabled", 9, "int").columns == ["Enabled"]
    assert rows(registry.add_missing_column(frame, "units", None, "string")) == [(1, None)]
