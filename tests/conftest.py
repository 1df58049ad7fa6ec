import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from shopcast.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4)
    yield s
    s.stop()


def actions_df(spark, rows):
    """rows: (user_id, sku_id, 'yyyy-MM-dd HH:mm:ss', type[, cate[, brand[, model_id]]])"""
    from pyspark.sql import functions as F
    full = []
    for r in rows:
        u, s, t, k = r[:4]
        cate = r[4] if len(r) > 4 else 8
        brand = r[5] if len(r) > 5 else 1
        model = r[6] if len(r) > 6 else 0
        full.append((u, s, t, model, k, cate, brand))
    df = spark.createDataFrame(full, "user_id long, sku_id long, t string, model_id int, type int, cate int, brand int")
    return df.select("user_id", "sku_id", F.col("t").cast("timestamp_ntz").alias("time"), "model_id", "type",
                     "cate", "brand")


END = dt.datetime(2016, 4, 11)
