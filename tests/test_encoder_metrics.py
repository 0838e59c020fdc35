"""Encoders of several columns and files; user metrics as mergeable states."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskloom.operators import encoder as en
from riskloom.operators import user_metrics as um
from riskloom.sources import readers

ROWS = [("a", "x", 10), ("a", "é", 9), ("a", None, 10), ("b", "é", 1), ("b", "Z", 10), ("b", "x", None), ("a", "x", 10)]


def test_codes_are_those_of_sorted_values_per_file(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "file string, c string, n int")
    codes = en.fit(df, ["c", "n"], "file")
    want = sorted((f, c, v, i) for f in "ab" for c, k in (("c", 1), ("n", 2)) for i, v in enumerate(sorted({str(r[k]) for r in ROWS if r[0] == f and r[k] is not None})))
    assert sorted(map(tuple, codes.collect())) == want
    readers.write_parquet(codes, str(tmp_path / "codes"))
    kept = spark.read.parquet(str(tmp_path / "codes"))
    own = {(r.file, r.c, r.n): (r.c_code, r.n_code) for r in en.encode(df, kept, ["c", "n"], file="file").collect()}
    look = {w[:3]: w[3] for w in want}
    assert own == {r: (look.get((r[0], "c", r[1])), look.get((r[0], "n", str(r[2])))) for r in ROWS}
    # fitted on one file, applied to another, by broadcast and by join
    for most in (200_000, 0):
        other = {(r.c, r.n): (r.c_code, r.n_code) for r in en.encode(df.where("file = 'b'"), kept, ["c", "n"], fitted_on="a", max_broadcast=most).collect()}
        assert other == {("é", 1): (1, -1), ("Z", 10): (-1, 0), ("x", None): (0, None)}
    with pytest.raises(PySparkException, match="no code for Z"):
        en.encode(df, kept, ["c"], fitted_on="a", unseen=None).collect()
    with pytest.raises(ValueError, match="not fitted"):
        en.encode(df, kept, ["c"], fitted_on="nowhere")


def test_empty_fit(spark):
    df = spark.createDataFrame([], "c string")
    codes = en.fit(df, ["c"])
    assert codes.count() == 0 and en.encode(df, codes, ["c"]).count() == 0


class Distinct:
    """How many different values; the state is a set."""

    columns = ("v",)

    def init(self):
        return set()

    def update(self, state, batch):
        return state | set(batch.column("v").to_pylist())

    def merge(self, a, b):
        return a | b

    def finish(self, state):
        return float(len(state))


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_user_metric_does_not_hang_on_partitions(spark, parts):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, "rare").alias("g"), (F.col("id") % 17).alias("v")).repartition(parts)
    got = {r.g: r.n for r in um.evaluate(df, {"n": Distinct()}, "g", fan=3).collect()}
    assert got == {"hot": 17.0, "rare": float(len({i % 17 for i in range(5000) if i % 1000 == 1 and i % 3})), None: 17.0}
    assert um.evaluate(df.limit(0), {"n": Distinct()}, "g").count() == 0
