import random

from pyspark.sql import functions as F

from spanforge.operators.ordered import running


def test_running_values_do_not_depend_on_the_ranges(spark):
    rng = random.Random(6)
    data = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.choice([None, "x", "y"]), rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "k string, i int, t string, n int")
    state, want = {}, {}
    for k, i, t, n in sorted(data, key=lambda r: r[1]):
        total, last = state.get(k, (0, None))
        state[k] = (total + n, t if t is not None else last)
        want[i] = (*state[k], last)
    for ranges in (1, 9):
        rows = running(df, "k", ["i"], {"total": F.col("n")}, {"last": F.col("t")}, {"earlier": F.col("t")}, ranges).collect()
        assert {r["i"]: (r["total"], r["last"], r["earlier"]) for r in rows} == want
    assert running(df.filter("false"), "k", ["i"], {"total": F.col("n")}).count() == 0
