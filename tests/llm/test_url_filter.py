from pyspark.sql import functions as F

from riskloom.llm import queries, url_filter

from .cases import SF, duck, shown

RULES = [*queries.URL_RULES, ("block", "a.example.org/"), ("allow", "x.y/p/q"), ("block", "x.y/p/q"), ("block", "bare.host")]
URLS = [None, "", "nothing", "http://", "HTTP://WWW.Example.ORG/es/1?x#y", "http://example.org", "http://example.org/", "http://notexample.org/es/",
        "https://b.a.example.org/en/12", "http://x.y/p/qr", "http://x.y/p/", "ftp://q.bare.host", "http://q.bare.host/z", "http://a.com/fr/x/y", "x://a://b/c", "http://É.org/ß",
        "http://a..org//x", "http://example.org/en/1" + "/long" * 5000, "http://example.org/en/\n1"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fit = []
    for verdict, rule in RULES:
        h, p = url_filter.split_rule(rule)
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fit.append((h.count("."), len(p), verdict, rule))
    best = max(fit, default=None)
    return (host, path, best[3], best[2]) if best else (host, path, None, "allow")


def test_trie_and_join_equal_brute_force(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string")
    want = [brute(u) for u in URLS + URLS[:3]]
    own = df.select("page_id", url_filter.url_host(F.col("url")).alias("host"), url_filter.url_path(F.col("url")).alias("path"))
    got = own.withColumn("j", url_filter.judge(spark, F.col("host"), F.col("path"), RULES)).orderBy("page_id").select("host", "path", "j.rule", "j.verdict").collect()
    assert [tuple(r) for r in got] == want
    rules = spark.createDataFrame(RULES, "verdict string, rule string")
    clash = df.withColumns({"rule": F.lit("x"), "Verdict": F.lit("y"), "url_host": F.lit("z")})
    joined = url_filter.judge_by_join(clash, "url", rules).orderBy("page_id").collect()
    assert [(r[-2], r[-1]) for r in joined] == [(w[2], w[3]) for w in want]
    assert joined[0].asDict()["rule"] == "x"


def test_empty_table_and_bounds(spark):
    import pytest

    none = spark.createDataFrame([], "host string, path string")
    assert none.select(url_filter.judge(spark, F.col("host"), F.col("path"), RULES)).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge(spark, F.col("host"), F.col("path"), RULES, max_rules=2)
    with pytest.raises(ValueError):
        url_filter.build_trie([("maybe", "a.b/")])


def test_query_equals_sql(spark):
    assert shown(queries.op1_url_filter(spark, SF)) == duck(queries.SQL_URL, SF, "pages")
