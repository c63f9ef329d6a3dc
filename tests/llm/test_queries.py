def test_queries_are_registered():
    import __spark_entry__ as e

    from millrace.llm.queries import ORACLE, QUERIES

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(QUERIES)
    assert {"p4_percentiles", "p7_found", "p8_packed", "p9_sample", "p10_found"} <= set(QUERIES)
