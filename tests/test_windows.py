import random

from papercairn.operators import windows
from pyspark.sql import functions as F


def test_against_plain_loops(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), i, r.choice([None, None, r.randint(0, 9)])) for i in r.sample(range(5000), 2000)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = {(x["k"], x["o"]): x["w"] for x in windows.carried(df, "k", ["o"], F.col("v"), "w").collect()}
    n = {(x["k"], x["o"]): x["n"] for x in windows.numbered(df, "k", ["o"], "n").collect()}
    for k in ("hot", "a", None):
        last = None
        for i, (_, o, v) in enumerate(sorted((x for x in rows if x[0] == k), key=lambda x: x[1]), 1):
            assert got[k, o] == last and n[k, o] == i
            last = v if v is not None else last
    assert len(got) == len(rows)
    assert windows.carried(df.filter("false"), "k", ["o"], F.col("v"), "w").count() == 0
