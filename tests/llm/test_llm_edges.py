import os

import edges
import pytest

from millrace.llm.queries import QUERIES


@pytest.mark.skipif(not os.path.isdir(edges.SOURCE), reason="no test tables")
@pytest.mark.parametrize("kind", ["empty", "nulls", "twice"])
def test_every_query_has_a_defined_result(spark, tmp_path, kind):
    d = edges.make(spark, kind, tmp_path)
    got = {n: q(spark, d).count() for n, q in QUERIES.items()}
    if kind == "empty":
        assert all(got[n] == 0 for n in QUERIES if n != "p9_shares")
    if kind == "nulls":
        assert got["p10_found"] == 1 and got["p8_packed"] == got["p9_sample"] == got["p7_found"] == 0
    if kind == "twice":
        assert got["p10_found"] == QUERIES["p10_found"](spark, edges.SOURCE).count()
