import hashlib
import re

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import queries, secrets

from .cases import SF, clashing, docs

PARTS = ["token", "secret", "api_key", "ApiKey", "=", ": ", '"', "'", " ", "AKIA", "ABC123XY", "abcdef0123", "ß", "İ", "ſ", "0123456789abcdef", "PASSWORD", "passwd", "x", "\n", "ghp_", "日"]


def base(t):
    assign = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[1], secrets.ORDER[s[0]]))


@given(st.lists(st.sampled_from(PARTS), max_size=24).map("".join))
@settings(max_examples=600, deadline=None)
def test_base_spans_equal_whole_text_regexes(text):
    assert [s for s in secrets.scan(text) if s[0] in ("assign", "access", "hex")] == base(text)


def test_checksums_decide():
    body = "a1B2" * 7 + "Zz"
    good = body + secrets.checksum62(body)
    bad = body + secrets.checksum62(body)[:-1] + "_"
    assert ("github", 4, 4 + 40) in secrets.scan(f"key ghp_{good} end") and ("npm", 0, 40) in secrets.scan(f"npm_{good}")
    assert not [s for s in secrets.scan(f"ghp_{bad} npm_{body}000000") if s[0] in ("github", "npm")]
    assert [s[0] for s in secrets.scan("eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln")] == ["jwt"] and not secrets.scan("eyJub3RoaW5n.abc.def")


def test_long_runs_and_awkward_rows(spark):
    assert secrets.scan("g" + "a" * 3_000_000 + "g") == [("hex", 1, 3_000_001)]
    got = secrets.report(clashing(docs(spark))).collect()
    assert len(got) == docs(spark).count() and {r.spans for r in got if r.doc_id in (1, 2, 3, 4)} == {""}
    assert secrets.report(docs(spark, [])).count() == 0


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op7_secret_scan(spark, SF).collect():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in want) for k in ("assign", "access", "hex")]


def test_redaction(spark):
    text = 'é token = "0123456789abcdef0123" and 0123456789abcdef AKIA'
    assert secrets.blank(text, "[SECRET]") == 'é [SECRET]" and [SECRET] AKIA'
    df = spark.createDataFrame(pd.DataFrame({"text": [text, None, ""]})).select(secrets.redacted(F.col("text")).alias("t"))
    assert [r.t for r in df.collect()] == ['é [SECRET]" and [SECRET] AKIA', None, ""]


def test_runs_of_keywords_take_linear_time():
    import time

    def cost(n):
        t = time.perf_counter()
        for part in ("eyJ", "eyJ-", "eyJ.", "eyJa.b.", "password", "token=", "token: ", "AKIA", "a0", "ghp_"):
            secrets.scan(part * n)
        return time.perf_counter() - t

    cost(1000)
    assert cost(64_000) < 12 * cost(16_000) + 1  # in proportion would be 4


def test_a_token_after_a_run_that_is_none():
    good = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln"
    text = "eyJ" * 50 + " " + good + " eyJeyJ" + good
    assert [s for s in secrets.scan(text) if s[0] == "jwt"][0] == ("jwt", 151, 151 + len(good))
