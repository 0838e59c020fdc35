"""Secret scans: an Aho-Corasick keyword prefilter, regular expressions
anchored at its hits, and validation of embedded checksums.

One automaton walks the text once (A-Z lower-cased) and names the places where
a keyword stands; only there the kind's expression is tried, anchored.  Runs of
hexadecimal digits have no keyword: a run of 16 must cover a place whose number
is a multiple of 16, so only those places are looked at, and a hit is extended
to its run.  Kinds with an embedded checksum count only if it is right.

Kinds, in their order at equal starts: ``assign``, ``access``, ``hex`` (the base
kinds), then ``github`` and ``npm`` (30 letters or digits and the base-62 CRC-32
of those) and ``jwt`` (a header that decodes to a JSON object with ``alg``).
Within a kind matches are leftmost and do not overlap: a place inside an earlier
match of the kind, even one dropped for its length, starts no other.

Defined results: null texts are empty and have no span; very long texts are
scanned whole; repeated rows are scanned each by itself; an empty table gives an
empty result.  Places are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_DIGIT, HEX_RUN = frozenset("0123456789abcdef"), re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
JWT_RUN = re.compile(r"[A-Za-z0-9_-]*")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: str) -> str:
    """CRC-32 of the body as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = DIGITS[digit] + out
    return out


def _has_alg(header: str) -> bool:
    try:
        found = json.loads(base64.urlsafe_b64decode(header + "=" * (-len(header) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(found, dict) and "alg" in found


#: kind -> keywords (lower case), expression, what a match must pass
KINDS = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), ASSIGN, lambda m: len(m[2]) >= 12),
    "access": (("akia",), ACCESS, lambda m: len(m[0]) >= 18),
    "hex": ((), HEX_RUN, lambda m: len(m[0]) >= 16),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), GITHUB, lambda m: checksum62(m[1]) == m[2]),
    "npm": (("npm_",), NPM, lambda m: checksum62(m[1]) == m[2]),
    "jwt": (("eyj",), JWT, lambda m: _has_alg(m[1])),
}
ORDER = {kind: i for i, kind in enumerate(KINDS)}
_AUTOMATON: list = []


def _automaton():
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, (keywords, _, _) in KINDS.items():
            for k in keywords:
                a.add_word(k, (kind, len(k)))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans ``(kind, start, end)`` by start, then kind."""
    hits: list[tuple[int, str]] = []
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only, places stay
    for end, (kind, n) in _automaton().iter(lower):
        hits.append((end - n + 1, kind))
    done = 0
    for i in [16 * j for j, c in enumerate(text[::16]) if c in HEX_DIGIT]:
        if i >= done:
            while i and text[i - 1] in HEX_DIGIT:
                i -= 1
            done = HEX_RUN.match(text, i).end()
            hits.append((i, "hex"))
    hits.sort(key=lambda h: h[0])
    out, passed = [], dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < passed[kind]:
            continue
        _, expression, sound = KINDS[kind]
        m = expression.match(text, start)
        if m is None and kind == "jwt":  # no later start in this run can match either
            passed[kind] = JWT_RUN.match(text, start).end()
        if m:
            passed[kind] = m.end()
            if sound(m):
                out.append((kind, start, m.end()))
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


@pandas_udf(SPANS)
def spans_of(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] if t else [] for t in texts], dtype=object)


def blank(text: str, mask: str) -> str:
    """The text with the union of its spans replaced by ``mask``, span by span."""
    out, done = [], 0
    for _, start, end in scan(text):
        if start >= done:
            out += [text[done:start], mask]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redacted(text, mask: str = "[SECRET]") -> Column:
    """The text with its secrets replaced; a null text stays null."""

    @pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else blank(t, mask) for t in texts], dtype=object)

    return run(text)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Spans of every text with their counts and digests."""
    found = docs.select("doc_id", spans_of("text").alias("s"))
    n = lambda kind: F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("s", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
