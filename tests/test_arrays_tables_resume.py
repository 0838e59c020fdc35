"""JSON arrays by many tasks, the packing table function, scoring that resumes."""

import json

import pytest
from pyspark.sql import functions as F

from riskloom.operators import packing_udtf as tf
from riskloom.sources import json_arrays as ja
from riskloom.streaming.resumable import score_resumably

DDL = "id BIGINT, text STRING, tags ARRAY<STRING>, inner STRUCT<x: INT>"
RECORDS = [{"id": i, "text": t, "tags": ["a]", "{"] * (i % 3), "inner": {"x": i} if i % 2 else None}
           for i, t in enumerate(["plain", "braces }{ ][ \"quoted\" \\", "line\nend", "", None, "ends with \\", "é ],[{", "\\\"", "tab\t"] * 200)]


def rows(df):
    return [(r.id, r.text, r.tags, r.inner.x if r.inner else None) for r in df.orderBy("id").collect()]


WANT = [(r["id"], r["text"], r["tags"], r["inner"]["x"] if r["inner"] else None) for r in RECORDS]


@pytest.mark.parametrize("form", ["indented", "compact", "record a line", "leading commas"])
def test_forms_of_one_array(spark, tmp_path, form):
    text = {"indented": json.dumps(RECORDS, indent=4, ensure_ascii=False), "compact": json.dumps(RECORDS), "record a line": "[" + ",\n".join(map(json.dumps, RECORDS)) + "]\n",
            "leading commas": "[\n" + "\n,".join(map(json.dumps, RECORDS)) + "\n]"}[form]
    (tmp_path / "a.json").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert form == "compact" or spark.read.text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 3  # one file, several tasks
        assert rows(ja.json_array(spark, str(tmp_path / "a.json"), DDL)) == WANT
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_several_files_and_an_empty_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RECORDS[:700], indent=1))
    (tmp_path / "b.json").write_text(json.dumps(RECORDS[700:], indent=1))
    (tmp_path / "c.json").write_text("[\n]\n")
    assert rows(ja.json_array(spark, str(tmp_path), DDL)) == WANT


@pytest.mark.parametrize("text", ['{"id": 1}', '[{"id": 1}', '[\n{"id": 1},\n{"id": 2}\n', '[{"id": 1}]\n[{"id": 2}]', '[{"id": 1}] x', '[{"id": 1,}]', '[{"id": "one"}]', '[{"text": "open\n}]', "[1, 2]", '{"id": 1}\n{"id": 2}'])
def test_bad_arrays_fail(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="JSON|VARIANT"):
        ja.json_array(spark, str(tmp_path / "a.json"), DDL).collect()


def test_written_parts_are_one_array(spark, tmp_path):
    df = spark.createDataFrame([(r["id"], r["text"], r["tags"], r["inner"]) for r in RECORDS], DDL).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several part files of few rows
    try:
        ja.write_json_array(df, str(tmp_path / "out"), ["id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert len(parts) > 1 and json.loads("".join(p.read_text() for p in parts)) == RECORDS
    assert rows(ja.json_array(spark, str(tmp_path / "out"), DDL, one_array=True)) == WANT
    ja.write_json_array(df.limit(0), str(tmp_path / "none"), ["id"])
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*")))) == []


def test_arrays_with_repeated_and_null_keys(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (k % 3), [], None) for k, i in enumerate([None, None, *range(40), *range(40), 7, 7])], DDL).repartition(5)
    ja.write_json_array(df, str(tmp_path / "out"), ["id"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert [r["id"] for r in json.loads(text)] == sorted([*range(40), *range(40), 7, 7, None, None], key=lambda x: (x is not None, x))
    assert ja.json_array(spark, str(tmp_path / "out"), DDL, one_array=True).exceptAll(df).count() == 0


def test_array_text_is_shuffled_once_to_write(spark):
    df = spark.createDataFrame([(r["id"], r["text"], r["tags"], r["inner"]) for r in RECORDS], DDL)
    plan = ja.array_lines(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(end" in plan and "hashpartitioning" not in plan and "Window" not in plan


def blocks(lists, block):
    ids = [x for one in lists for x in one]
    whole = [ids[at:at + block] for at in range(0, len(ids) - block + 1, block)]
    return whole or ([ids] if ids else [])


def test_table_function(spark):
    data = [(b, i, list(range(100 * i, 100 * i + n))) for b, sizes in ((0, [3, 4, 5]), (1, [1]), (2, [0, 0]), (3, [8]), (4, [7, 9, 1])) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(data, "b long, i long, input_ids array<int>")
    want = {b: blocks([x for c, _, x in data if c == b], 4) for b in range(5)}
    got = {}
    for r in tf.pack_batches(df, "b", "i", 4).orderBy("batch", "block_no").collect():
        got.setdefault(r.batch, []).append(r.input_ids)
    assert got == {b: w for b, w in want.items() if w}
    tf.register(spark)
    df.createOrReplaceTempView("samples_to_pack")
    said = spark.sql("SELECT * FROM pack_batch(TABLE(samples_to_pack) PARTITION BY (b) ORDER BY (i), 4)").collect()
    assert sorted(r.input_ids for r in said) == sorted(x for w in want.values() for x in w)
    with pytest.raises(Exception, match="positive constant"):
        spark.sql("SELECT * FROM pack_batch(TABLE(samples_to_pack) PARTITION BY (b) ORDER BY (i), 0)").collect()
    with pytest.raises(Exception, match="input_ids"):
        spark.sql("SELECT * FROM pack_batch(TABLE(SELECT b, i FROM samples_to_pack) PARTITION BY (b) ORDER BY (i), 4)").collect()


def test_a_lost_run_goes_on_where_it_stopped(spark, tmp_path):
    prompts = spark.range(600).select("id", F.concat(F.lit("prompt "), F.col("id").cast("string")).alias("prompt"))
    for i in range(6):  # six files, in this order
        prompts.where(F.col("id") % 6 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "prompts"))
    asked = spark.sparkContext.accumulator(0)

    def scorer(batch):
        asked.add(len(batch))
        return [p[-1] for p in batch]

    def run(on_batch=None):
        return score_resumably(spark, str(tmp_path / "prompts"), "id long, prompt string", str(tmp_path / "out"), str(tmp_path / "state"), "id", "prompt", scorer, files_per_batch=1, on_batch=on_batch)

    def lose(number):
        if number == 3:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(lose)
    assert asked.value == 300
    found = run()
    assert asked.value == 600  # the rest alone
    assert sorted((r.id, r.llm_response) for r in found.collect()) == [(i, str(i)[-1]) for i in range(600)]
    run()
    assert asked.value == 600
    prompts.where("id < 5").withColumn("id", F.col("id") + 1000).coalesce(1).write.mode("append").parquet(str(tmp_path / "prompts"))
    assert run().count() == 605 and asked.value == 605
