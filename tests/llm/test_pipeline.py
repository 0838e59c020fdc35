import __spark_entry__
import corpus_pipeline
from riskloom.llm import near_dedup, queries, secrets, toxicity
from riskloom.llm.common import materialise, read

from .cases import SF, clashing, docs
from .test_packing import check


def test_stages_on_the_small_tables(spark):
    from tokenizers import Tokenizer

    kept, before = {}, read(spark, SF, "documents")
    columns = before.columns
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, before, SF), name)
        kept[name] = (before, after)
        before = after
        assert after.columns == columns or name == "packing"
    rows = lambda name, i: {r.doc_id: r for r in kept[name][i].collect()}
    toxic = {r.doc_id for r in read(spark, SF, "labels").collect() if r.toxic}
    gone = rows("toxicity", 0).keys() - rows("toxicity", 1).keys()
    clean = {r.doc_id for r in read(spark, SF, "labels").collect() if r.toxic == 0}
    assert len(gone & toxic) >= 0.5 * len(toxic) and not gone & clean
    classes = {r.doc_id: r.class_id for r in near_dedup.near_classes(kept["near_dedup"][0]).collect()}
    assert rows("near_dedup", 1).keys() == set(classes.values())
    old, new = rows("secrets", 0), rows("secrets", 1)
    assert old.keys() == new.keys()
    for i, r in new.items():
        assert r.text == secrets.blank(old[i].text or "", "[SECRET]") and r.n_chars == len(r.text) and not [s for s in secrets.scan(r.text) if s[0] == "hex"]
    assert rows("mix", 1).keys() <= new.keys()
    texts = {i: r.text for i, r in rows("mix", 1).items()}
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    assert check(kept["packing"][1].collect(), texts, tokenizer) == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == texts.keys()


def test_stages_take_awkward_rows(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    labels = pa.table({"doc_id": pa.array([1, 6, 7, 8, None], pa.int64()), "quality": pa.array([1, 1, None, 0, 1], pa.int32()), "toxic": pa.array([0, 1, None, 0, 1], pa.int32())})
    pq.write_table(labels, tmp_path / "labels.parquet")
    for rows in (clashing(docs(spark)), docs(spark, [])):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, rows, str(tmp_path))
            if name != "packing":
                assert after.columns == rows.columns
            assert after.count() <= max(1, rows.count()) or name == "packing"
            if name == "packing":
                assert (after.count() == 0) == (rows.count() == 0)


def test_entry_point_lists_the_queries():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert [s[0] for s in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mix", "packing"]
    assert toxicity.THRESHOLD == 0.7
