"""Address-space walks: cycles, second parents, the Server subtree, the depth limit."""

from helpers import rows

from tidemark import schemas
from tidemark.operators import discovery, joins
from tidemark.plans import fleet

TAG = "ns=4;s=|var|P.Application."


def edges(spark, *lines):
    return spark.createDataFrame([(plc, a, b, kind, label, None) for plc, a, b, kind, label in lines], schemas.ADDRESS_EDGES)


def test_walk(spark):
    space = edges(
        spark, ("P", "i=85", "f", "Object", None), ("P", "f", TAG + "G.x", "Variable", "x"), ("P", TAG + "G.x", TAG + "G.x.sub", "Variable", "sub"),
        ("P", "f", "i=85", "Object", None), ("P", "i=85", "i=2253", "Object", None), ("P", "i=2253", TAG + "diag", "Variable", None),
        ("P", "i=85", TAG + "G.x", "Variable", "again"), ("P", "f", TAG + "m", "Method", None), ("P", "f", "ns=4;s=|vprop|P.y", "Variable", "y"),
        ("P", "orphan", TAG + "lost", "Variable", None), ("Q", "i=85", TAG + "q", "Variable", None),
    )
    expected = [("P", TAG + "G.x", "G.x"), ("P", TAG + "G.x.sub", "G.x.sub"), ("Q", TAG + "q", "q")]
    assert rows(discovery.discover_tags(space)) == expected
    depths = {(r["plc_name"], r["node"]): r["depth"] for r in discovery.reachable(space).collect()}
    assert depths[("P", "i=85")] == 0 and depths[("P", TAG + "G.x")] == 1 and ("P", "i=2253") not in depths
    spark.conf.set(joins.BROADCAST_SETTING, "0")
    try:
        assert rows(discovery.discover_tags(space)) == expected
    finally:
        spark.conf.unset(joins.BROADCAST_SETTING)


def test_any_namespace_and_leaf_names(spark):
    space = edges(spark, ("P", "i=85", "ns=2;i=5", "Variable", None), ("P", "i=85", "ns=0;i=6", "Variable", "zero"))
    assert rows(discovery.discover_tags(space, namespaces=[], tokens=[])) == [("P", "ns=2;i=5", "ns=2;i=5")]


def test_depth_limit(spark):
    chain = [("P", "i=85" if n == 1 else f"{TAG}c{n - 1}", f"{TAG}c{n}", "Variable", None) for n in range(1, 7)]
    found = discovery.discover_tags(edges(spark, *chain), max_depth=3)
    assert rows(found, "tag_name") == [("c1",), ("c2",), ("c3",), ("c4",)]  # c4 is met below the last node read


def test_sync_numbers_new_tags_in_order(spark):
    plcs = spark.createDataFrame([(1, "P", "", ""), (2, "Q", "", "")], schemas.PLCS)
    old = spark.createDataFrame([(7, 2, TAG + "gone", "gone", "Double", None, None, "t0", "t0", 1, 1)], schemas.TAGS)
    space = edges(spark, ("Q", "i=85", TAG + "a", "Variable", None), ("P", "i=85", TAG + "z", "Variable", None), ("P", "i=85", TAG + "b", "Variable", None))
    new = fleet.discovery_sync(space, old, plcs, "t1")
    assert rows(new, "tag_id", "plc_id", "tag_name", "active") == [(7, 2, "gone", 0), (8, 1, "b", 1), (9, 1, "z", 1), (10, 2, "a", 1)]
