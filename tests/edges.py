"""Edge versions of the test tables: empty, all null, every row twice."""

import glob
import os

SOURCE = "/root/testdata/sf0.001"


def make(spark, kind, target):
    for p in glob.glob(f"{SOURCE}/*.parquet"):
        df = spark.read.parquet(p)
        if kind == "empty":
            df = df.limit(0)
        elif kind == "nulls":
            df = spark.createDataFrame([tuple(None for _ in df.columns)] * 2, df.schema)
        else:
            df = df.unionByName(df)
        df.write.parquet(f"{target}/{os.path.basename(p)}")
    return str(target)
