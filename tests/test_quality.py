import pytest
from conftest import rows

from millrace.quality import recon
from millrace.quality.rules import DQError, DQRule, Evaluator, load_rules, run_checks

NOW = "2024-06-01 12:00:00"


@pytest.fixture
def evaluator(spark, frame):
    tables = {
        "t": frame([(1, "a", 10.0, "2024-05-30 13:00:00", "2024-05-01"), (2, None, -5.0, "2024-01-01 00:00:00", None), (3, "c", None, None, None), (3, "d", 2.0, None, None)],
                   "id int, name string, amount double, at timestamp_ntz, day date"),
        "ref": frame([("1",), (" 2",), ("x",), (None,)], "code string"),
        "none": frame([], "id int, at timestamp_ntz"),
    }
    return Evaluator(spark, tables.__getitem__, NOW)


@pytest.mark.parametrize("rule, failed", [
    (dict(type="not_null", column="name"), 1), (dict(type="unique", column="id"), 1), (dict(type="unique", column=["id", "name"]), 0),
    (dict(type="accepted_values", column="name", values=["a", "c"]), 1), (dict(type="range", column="amount", min=0, max=5), 2), (dict(type="range", column="amount", min=-5), 0),
    (dict(type="row_count_min", threshold=4), 0), (dict(type="row_count_min", threshold=5), 1), (dict(type="freshness", column="at", max_age_days=1), 0),
    (dict(type="freshness", column="at", max_age_days=2), 0), (dict(type="freshness", column="day", max_age_days=30), 1), (dict(type="referential", column="id", ref_table="ref", ref_column="code"), 2),
    (dict(type="freshness", column="at", max_age_days=9, table="none"), 1), (dict(type="not_null", column="absent"), -1), (dict(type="not_null", column="id", table="nowhere"), -1),
])
def test_each_rule(evaluator, rule, failed):
    r = DQRule.of({"name": "r", "table": "t", **rule})
    assert evaluator.evaluate([r])[0][2] == failed


def test_broken_rule_does_not_spoil_the_others(evaluator):
    rules = [DQRule.of(dict(name=n, table="t", type="not_null", column=c)) for n, c in (("a", "absent"), ("b", "name"))]
    assert [x[2] for x in evaluator.evaluate(rules)] == [-1, 1]


def test_loader(tmp_path):
    import os

    rules = load_rules(os.path.join(os.path.dirname(__file__), "..", "conf", "dq_rules.yml"))
    assert len(rules) == 13 and len(load_rules(os.path.join(os.path.dirname(__file__), "..", "conf", "dq_rules.yml"), "silver")) == 9
    with pytest.raises(ValueError):
        DQRule.of(dict(name="x", table="t", type="magic"))
    with pytest.raises(ValueError):
        DQRule.of(dict(name="x", table="t", type="range"))
    assert DQRule.of(dict(name="x", table="t", type="not_null", column="a")).severity == "error"


def test_results_are_stored_before_the_error(evaluator):
    kept = []
    rules = [DQRule.of(dict(name="bad", table="t", type="not_null", column="name")), DQRule.of(dict(name="warned", table="t", type="unique", column="id", severity="warn"))]
    with pytest.raises(DQError, match="bad"):
        run_checks(evaluator, rules, "run", "dev", kept.append)
    assert kept[0].count() == 2
    assert run_checks(evaluator, rules[1:], "run", "dev", kept.append) == {"rules_evaluated": 1, "rules_failed": 1}


@pytest.mark.parametrize("a, b, tol, ok", [(100, 100, 0, True), (100, 99, 0, False), (1000.004, 1000, 0.01, True), (1000, 990, 1, False), (None, 0, 0, True)])
def test_comparator(a, b, tol, ok):
    assert recon.compare(a, b, tol)[1] is ok


def test_source_vs_bronze(frame):
    m = frame([("f1", 2, "LANDED"), ("f1", 1, "LANDED"), ("f2", 5, "LANDED"), ("f3", 1, "FAILED")], "file_name string, source_row_count bigint, status string")
    b = frame([("f1",), ("f1",), ("f9",)], "_source_file string")
    assert rows(recon.source_vs_bronze(m, b), "scope", "source_value", "target_value", "passed") == [("f1", 2.0, 2.0, True), ("f2", 5.0, 0.0, False), ("f9", 0.0, 1.0, False)]


def test_totals_and_runner(frame):
    a, b = frame([(1.0,), (2.5,)], "total_amount double"), frame([(3.505,), (None,)], "total_amount double")
    checks = [recon.rows_equal(a, b), recon.amounts_equal(a, b)]
    kept = []
    assert recon.run_recon(checks, "r", "dev", NOW, kept.append) == {"checks": 2, "failed": 0}
    with pytest.raises(recon.ReconError, match="silver_vs_fact_rows"):
        recon.run_recon([recon.rows_equal(a, b.limit(1)), recon.amounts_equal(a.limit(0), b.limit(0))], "r", "dev", NOW, kept.append)
    assert [k.count() for k in kept] == [2, 2]


def test_clean_and_quarantined(frame):
    a, b = frame([("h1",), ("h2",)], "trip_hash string"), frame([("h2",), ("h3",)], "trip_hash string")
    assert rows(recon.clean_and_quarantined(a, b), "source_value", "passed") == [(1.0, False)]
