import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def frame(spark):
    """A frame with an explicit schema; text columns of timestamp type are given as text."""

    def make(rows, ddl):
        from pyspark.sql import functions as F
        from pyspark.sql.types import _parse_datatype_string

        kinds = _parse_datatype_string(ddl)
        times = {f.name: f.dataType.simpleString() for f in kinds.fields if f.dataType.typeName() in ("timestamp", "timestamp_ntz", "date")}
        as_text = ", ".join(f"`{f.name}` {'string' if f.name in times else f.dataType.simpleString()}" for f in kinds.fields)
        df = spark.createDataFrame(rows, as_text)
        return df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in times.items()}) if times else df

    return make


def rows(df, *cols):
    """The rows as a sorted list of tuples, times as text."""
    out = [tuple(str(v) if hasattr(v, "isoformat") else v for v in r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(out, key=repr)
