"""Pairing by position with its count check; checks that count on the running plan."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskloom.operators import checks as ck
from riskloom.operators import pairing as pg
from riskloom.operators import sampling as sp


def files(spark, path, values, name, parts=7, kind="parquet"):
    df = spark.createDataFrame([(v,) for v in values], f"{name} long").repartitionByRange(parts, name).sortWithinPartitions(name)
    (df.write.parquet if kind == "parquet" else df.write.json)(str(path))
    return spark.read.parquet(str(path)) if kind == "parquet" else spark.read.schema(f"{name} long").json(str(path))


def test_files_of_equal_length_pair_by_position(spark, tmp_path):
    truth = pg.with_position(files(spark, tmp_path / "a", range(5000), "truth"))
    preds = pg.with_position(files(spark, tmp_path / "b", range(100_000, 105_000), "pred", parts=3))
    rows = pg.pair_by_position(truth, preds).collect()
    assert len(rows) == 5000 and all(r.pred == r.truth + 100_000 and r.position == r.truth for r in rows)


def test_blocks_of_a_text_file(spark, tmp_path):
    path = tmp_path / "lines.json"
    path.write_text("".join(json.dumps({"pred": i, "pad": "x" * 50}) + "\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        scan = spark.read.schema("pred long").json(str(path))
        assert scan.rdd.getNumPartitions() > 4
        rows = pg.with_position(scan, parquet=False).collect()
        assert len(rows) == 20_000 and all(r.position == r.pred for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("sizes", [(50, 49), (49, 50), (50, 0)])
def test_unequal_lengths_fail(spark, tmp_path, sizes):
    truth = pg.with_position(files(spark, tmp_path / "a", range(sizes[0]), "truth"))
    preds = pg.with_position(files(spark, tmp_path / "b", range(sizes[1]), "pred")) if sizes[1] else spark.createDataFrame([], "pred long, position long")
    with pytest.raises(PySparkException, match="has no row on the"):
        pg.pair_by_position(truth, preds).collect()


def test_clashing_columns_are_refused(spark):
    df = spark.createDataFrame([(1, 0)], "x long, position long")
    with pytest.raises(ValueError, match="both sides"):
        pg.pair_by_position(df, df.withColumnRenamed("x", "X"))


def test_keys_that_do_not_pair_fail(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k long, truth string")
    assert sorted(map(tuple, pg.pair_by_key(a, a.withColumnRenamed("truth", "pred"), "k").collect())) == [(1, "a", "a"), (2, "b", "b")]
    for rows in ([(1, "x")], [(1, "x"), (2, "y"), (3, "z")], [(1, "x"), (2, "y"), (2, "y")], [(1, "x"), (None, "y")]):
        with pytest.raises(PySparkException, match="once on each side"):
            pg.pair_by_key(a, spark.createDataFrame(rows, "k long, pred string"), "k").collect()


def test_dropped_rows_are_counted_in_the_one_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(1000).mapInArrow(note, "id long")
    kept = F.col("id") % 10 != 0
    checks = ck.dropping(kept, most=0.2)
    checks.watch(df).where(kept).write.parquet(str(tmp_path / "out"))
    assert checks.passed() == {"n_in": 1000, "n_dropped": 100} and seen.value == 1000
    checks = ck.dropping(kept, most=0.05)
    checks.watch(df).where(kept).write.parquet(str(tmp_path / "out2"))
    with pytest.raises(ck.DataCheckError, match="more than 0.05"):
        checks.passed()


def test_empty_input_and_shares(spark):
    checks = ck.dropping(F.col("id") > 0)
    checks.watch(spark.range(0)).collect()
    with pytest.raises(ck.DataCheckError, match="no input rows"):
        checks.passed()
    split = sp.split_exact(spark.range(1000).withColumnRenamed("id", "k"), "k")
    wanted = {"train": 0.7, "dev": 0.1, "test": 0.2}
    checks = ck.shares("split", wanted, 0.01)
    checks.watch(split).collect()
    assert checks.passed()["n"] == 1000
    for goals, text in (({**wanted, "train": 0.75}, "share of train"), ({"train": 0.7, "dev": 0.1}, "rows in no split")):
        checks = ck.shares("split", goals, 0.01)
        checks.watch(split).collect()
        with pytest.raises(ck.DataCheckError, match=text):
            checks.passed()
    table = {r.split: r for r in ck.share_table(split, "split", {**wanted, "extra": 0.5}, 0.01).collect()}
    assert (table["train"].n, table["train"].within, table["extra"].n, table["extra"].within) == (700, True, 0, False)
