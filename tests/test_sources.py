"""Round trips for the readers/writers and the driver contract."""

import json
import os

import pytest

from riskloom.sources import readers as rd

from .conftest import SF001


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


def test_positional_csv_round_trip(spark, tmp):
    df = spark.createDataFrame([("A11", 6, 1), ("A14", 12, 2)], "c0 string, c1 int, c2 int")
    rd.write_csv(df.coalesce(1), f"{tmp}/g", header=False)
    back = rd.positional_csv(spark, f"{tmp}/g", "c0 STRING, c1 INT, c2 INT")
    assert sorted(back.collect()) == sorted(df.collect())
    rd.write_csv(df.coalesce(1).selectExpr("c0", "c1"), f"{tmp}/s", header=False)


def test_jsonl_and_parquet_round_trip(spark, tmp):
    df = spark.createDataFrame([(1, "q", ["good", "bad"])], "id long, normal_query string, choices array<string>")
    rd.write_jsonl(df, f"{tmp}/j")
    assert rd.jsonl(spark, f"{tmp}/j", "id LONG, normal_query STRING, choices ARRAY<STRING>").collect() == df.collect()
    rd.write_parquet(df, f"{tmp}/p")
    assert spark.read.parquet(f"{tmp}/p").collect() == df.collect()


def test_json_array_must_be_a_list(spark, tmp):
    good = os.path.join(tmp, "ok.json")
    with open(good, "w") as f:
        json.dump([{"doc_id": 1, "acc": "1.0"}, {"doc_id": 2, "acc": "0.0"}], f, indent=4)
    assert rd.json_array(spark, good, "doc_id LONG, acc STRING").count() == 2
    bad = os.path.join(tmp, "bad.json")
    with open(bad, "w") as f:
        f.write('{"doc_id": 1, "acc": "1.0"')
    with pytest.raises(Exception, match="JSON list"):
        rd.json_array(spark, bad, "doc_id LONG, acc STRING").collect()
    with open(bad, "w") as f:
        f.write('[{"doc_id": 1, "acc": "1.0"')
    with pytest.raises(Exception, match="JSON list"):
        rd.json_array(spark, bad, "doc_id LONG, acc STRING").collect()


def test_arff_union_in_file_order(spark, tmp):
    header = ["@relation r", "@attribute Attr1 numeric", "@attribute Attr2 numeric", "@attribute class {0,1}", "@data"]
    paths = []
    for i, rows in enumerate([["1.5,?,0", "2.0,3.0,1"], ["% comment", "", "4.0,5.0,0"]]):
        p = os.path.join(tmp, f"{i + 1}year.arff")
        with open(p, "w") as f:
            f.write("\n".join(header + rows) + "\n")
        paths.append(p)
    ddl = rd.arff_ddl(header)
    assert ddl == "`Attr1` DOUBLE, `Attr2` DOUBLE, `class` STRING"
    df = rd.arff(spark, paths, ddl)
    got = sorted((r.file_no, r.Attr1, r.Attr2, r["class"]) for r in df.collect())
    assert got == [(0, 1.5, None, "0"), (0, 2.0, 3.0, "1"), (1, 4.0, 5.0, "0")]


def test_project_reorder_missing_column_is_error(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert rd.project_reorder(df, ["b", "a"]).columns == ["b", "a"]
    with pytest.raises(ValueError):
        rd.project_reorder(df, ["b", "zz"])


def test_driver_contract(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() >= 0 and "mcc" in df.columns
    qs, sql = entry.queries(), entry.oracle_sql()
    assert len(qs) >= 90 and set(sql) <= set(qs)
    # every registered query builds on the smallest tables
    for key in ("prompt_assemble", "split_exact", "pack_blocks", "fairness_report"):
        assert qs[key](spark, SF001).count() >= 0


def test_checkpoint_dir_is_the_sessions(spark):
    from riskloom.session import checkpoint_dir
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir", None)


def test_named_csv_takes_types_by_header_name(spark, tmp):
    with open(os.path.join(tmp, "h.csv"), "w") as f:
        f.write("b,a,c\n1,x,2.5\n,y,\n")
    df = rd.named_csv(spark, f"{tmp}/h.csv", {"c": "DOUBLE", "b": "INT"})
    assert dict(df.dtypes) == {"b": "int", "a": "string", "c": "double"}
    assert sorted(map(tuple, df.collect()), key=str) == [(1, "x", 2.5), (None, "y", None)]
    with pytest.raises(ValueError):
        rd.named_csv(spark, f"{tmp}/h.csv", {"zz": "INT"})


def test_json_object_is_not_a_list(spark, tmp):
    p = os.path.join(tmp, "obj.json")
    with open(p, "w") as f:
        json.dump({"doc_id": 1, "acc": "1.0"}, f)
    with pytest.raises(Exception, match="JSON list"):
        rd.json_array(spark, p, "doc_id LONG, acc STRING").collect()


def test_train_and_validation_files(spark, tmp):
    ddl = "id LONG, text STRING"
    rd.write_jsonl(spark.createDataFrame([(i, f"t{i}") for i in range(10)], ddl), f"{tmp}/train")
    rd.write_jsonl(spark.createDataFrame([(90, "v")], ddl), f"{tmp}/valid")
    both = rd.train_validation(spark, f"{tmp}/train", f"{tmp}/valid", ddl)
    assert sorted((r.id, r.split) for r in both.collect()) == [(i, "train") for i in range(10)] + [(90, "valid")]
    cut = rd.train_validation(spark, f"{tmp}/train", None, ddl, valid_rows=3, order=["id"])
    assert sorted(r.id for r in cut.where("split = 'valid'").collect()) == [0, 1, 2] and cut.count() == 10
    with pytest.raises(ValueError):
        rd.train_validation(spark, f"{tmp}/train", None, ddl)


def test_ratios_are_checked(spark):
    from riskloom.operators import sampling as sp
    df = spark.range(10)
    for ratios, names in (((0.9, 0.2), ("a", "b", "c")), ((0.5,), ("a",)), ((-0.1, 0.5), ("a", "b", "c"))):
        with pytest.raises(ValueError):
            sp.split_exact(df, "id", ratios=ratios, names=names)
        with pytest.raises(ValueError):
            sp.split_hash(df, "id", ratios=ratios, names=names)
