from pyspark.sql import functions as F

from riskloom.llm import mixing, queries

from .cases import SF, clashing, docs, duck, shown


def test_query_equals_sql(spark):
    assert shown(queries.op5_target_mix(spark, SF)) == duck(queries.ORACLE["op5_target_mix"], SF, "documents")


def marginal_shares(fit, m):
    return fit.groupby(m, dropna=False).weight.sum().to_dict()


def test_fitted_marginals_meet_the_targets(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("source", "lang", mixing.topic_of("text").alias("topic"), mixing.tokens_of("text").alias("tokens"))
    cells = rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    wanted = {"source": 0.9, "lang": {"en": 3, "fr": 1, "de": 1, "es": 1}, "topic": 1.0}
    shares = mixing.targets(cells, wanted)
    fit = mixing.rake(cells, shares, rounds=60, keep=0.05).toPandas()  # a small budget: no cell runs out
    for r in shares.collect():
        assert abs(marginal_shares(fit, r.marginal)[r.level] - r.share) < (1e-9 if r.marginal == "topic" else 0.02)


def test_no_cell_gives_more_than_it_has_and_others_make_up(spark):
    cells = spark.createDataFrame([("a", "en", "t", 900), ("b", "en", "t", 90), ("c", "en", "t", 10)], "source string, lang string, topic string, tokens long")
    shares = mixing.targets(cells, {"source": 0.0, "lang": 1.0, "topic": 1.0})  # a third of the budget each
    for keep in (0.03, 0.5, 0.9):
        fit = {r.source: r for r in mixing.probabilities(mixing.rake(cells, shares, rounds=60, keep=keep)).collect()}
        kept = {s: r.probability * r.tokens for s, r in fit.items()}
        assert all(r.probability <= 1 for r in fit.values())
        assert abs(sum(kept.values()) - 1000 * keep) < 1  # the budget is met
        assert abs(kept["c"] - 10) < 1e-6 and (keep < 0.4 or abs(kept["b"] - 90) < 1e-6)


def test_levels_that_are_not_given_keep_their_share(spark):
    rows = [(i, "one two three four", "en" if i < 50 else "it" if i < 70 else None, "s", 18) for i in range(75)] + [(90, None, "en", "s", 0), (91, " ", "it", "s", 1)]
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    assert {r.probability for r in got if r.lang in ("it", None) and r.tokens} == {mixing.KEEP}
    assert all(r.kept and r.probability == 1 for r in got if not r.tokens)
    kept = {r.doc_id for r in mixing.mixed(df).collect()}
    assert kept == {r.doc_id for r in got if r.kept} and {90, 91} <= kept


def test_joins_rake_like_one_task(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    one, far = (sorted(map(tuple, mixing.mix(d, rounds=2, max_cells=m).collect())) for m in (10_000, 1))
    assert [x[:5] + x[6:] for x in one] == [x[:5] + x[6:] for x in far]
    assert all(abs(x[5] - y[5]) < 1e-8 for x, y in zip(one, far, strict=True))


def test_awkward_rows(spark):
    every = {"source": 0.5, "lang": {"en": 1.0, "de": 1.0}, "topic": 0.5}
    got = mixing.mix(clashing(docs(spark)), every).collect()
    assert len(got) == docs(spark).count() and all(0 <= r.probability <= 1 for r in got)
    assert all(r.probability == 1 and r.kept for r in got if not r.tokens)
    assert len({(r.probability, r.kept) for r in got if r.doc_id == 5}) == 1
    kept = mixing.mixed(clashing(docs(spark)), every)
    assert kept.columns == clashing(docs(spark)).columns and kept.count() == sum(r.kept for r in got)
    assert mixing.mix(docs(spark, [])).count() == 0 == mixing.mixed(docs(spark, [])).count()
    blank = docs(spark, [(1, None, "en", "s", 0), (2, "", "en", "s", 0)])
    assert {r.probability for r in mixing.mix(blank).collect()} == {1.0}
