import os

import edges
import pytest

from millrace.plans import core, training


@pytest.mark.skipif(not os.path.isdir(edges.SOURCE), reason="no test tables")
@pytest.mark.parametrize("kind", ["empty", "nulls", "twice"])
def test_every_query_has_a_defined_result(spark, tmp_path, kind):
    d = edges.make(spark, kind, tmp_path)
    got = {n: q(spark, d).count() for n, q in {**training.QUERIES, **core.QUERIES}.items()}
    if kind != "twice":
        assert all(got[n] == 0 for n in ("p1_found", "p2_found", "p3_found", "p5_found", "p6_found"))
    else:
        once = {n: training.QUERIES[n](spark, edges.SOURCE).count() for n in ("p1_found", "p2_found", "p3_found", "p6_found")}
        assert {n: got[n] for n in once} == once
