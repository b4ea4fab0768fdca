"""What queries move and hold, as Spark counts it."""

import pytest

from regimeforge.operators import gates, signals
from regimeforge.plans import registry

SF = "/root/testdata/sf0.01"
LINES = 60_000


def measured(spark, build):
    """Bytes shuffled, and the number of tasks' input rows, of all stages that ``build`` runs."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return [found.apply(k) for k in range(found.size())]

    last = max((s.stageId() for s in stages()), default=-1)
    build()
    new = [s for s in stages() if s.stageId() > last]
    return sum(s.shuffleWriteBytes() for s in new), sum(s.inputRecords() for s in new)


def run(spark, name):
    registry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()


@pytest.fixture
def large(spark):
    """Joins as on tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_audit_of_decisions_moves_hashes_once_each_way(large):
    shuffled, _ = measured(large, lambda: run(large, "lg_decisions"))
    assert shuffled / LINES < 350


def test_gates_read_the_trades_twice_and_leave_candidates_in_place(large):
    shuffled, read = measured(large, lambda: run(large, "sg_component_gate"))
    assert shuffled / LINES < 90 and read / LINES < 9


def test_funnel_counts_before_it_lists_gates(spark):
    rows = spark.createDataFrame([("a", True, None), ("a", True, True), ("b", False, True)], "asset_class string, x boolean, y boolean")
    found = signals.gate_breakdown(rows, "asset_class", ("x", "y"))
    got = {(r.asset_class, r.gate_name): (r.candidate_count, r.rejected_count, r.remaining_count) for r in found.collect()}
    assert got == {("a", "x"): (2, 0, 2), ("a", "y"): (2, 1, 1), ("b", "x"): (1, 1, 0), ("b", "y"): (1, 0, 0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


def test_hard_filters_count_in_one_pass(spark):
    rows = spark.createDataFrame([("a", True, None, None), ("a", False, "state", "s"), (None, False, "state", "s"), (None, None, "state", "s")], "g string, selection_passed boolean, hard_block_category string, hard_block_reason string")
    got = {r.g: (r.blocked_count, r.candidate_count, r.blocked_rate) for r in gates.hard_filter_summary(rows, "g").collect()}
    assert got == {"a": (1, 2, 0.5), None: (2, 2, 1.0)}


def test_signed_lots_are_evaluated_once(large):
    shuffled, _ = measured(large, lambda: run(large, "lg_fifo_signed"))
    assert shuffled / LINES < 400


def test_signed_lots_exchange_fills_once_and_write_none(large):
    shuffled, _ = measured(large, lambda: run(large, "lg_fifo_signed"))
    assert shuffled / LINES < 100


def test_signed_lots_of_quiet_symbols_have_one_exchange_of_fills(spark):
    plan = registry.queries()["lg_fifo_signed"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
