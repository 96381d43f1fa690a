"""Plan shape: per-user scans are sliced, filters and columns reach the scan."""

from tabsight.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(spark, key):
    df = QUERIES[key](spark, SF)
    return df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_user_windows_are_sliced(spark):
    import re

    p = _plan(spark, "suppress_state")
    specs = re.findall(r"windowspecdefinition\(([^)]*)\)", p)
    row_level = [sp for sp in specs if re.search(r"\bts#\d+L ASC", sp)]
    assert row_level, "expected event-ordered windows"
    # every window over events is partitioned by the (user, slice) cell; the
    # only per-user windows order the small per-slice table by slice
    for sp in row_level:
        assert re.match(r"__cell#\d+, ", sp), sp
    for sp in specs:
        if sp not in row_level:
            assert re.match(r"user_id#\d+L, __slice#\d+L ASC", sp), sp


def test_outcome_filter_and_pruning_reach_scan(spark):
    p = _plan(spark, "outcome_resolve")
    assert "PushedFilters: [IsNotNull(event_type), In(event_type" in p or "In(event_type" in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in p
    assert "props" not in p.split("ReadSchema")[1].split("\n")[0]


def test_parse_reads_only_needed_columns(spark):
    p = _plan(spark, "route_action")
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int>" in p


def test_session_state_is_one_scan(spark):
    """One scan of the log with its carry: the round-robin spread of the small test
    file apart, at most four exchanges (the spread is planned for both branches)."""
    for key in ("suppress_state", "outcome_resolve"):
        p = _plan(spark, key)
        assert p.count("hashpartitioning(") <= 4, key
