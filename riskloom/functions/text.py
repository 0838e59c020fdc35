"""Column builders for text rendering with Python-compatible semantics.

All helpers are JVM-side Column expressions (whole-stage codegen, no Python
worker): white space follows Python's ``str.isspace``; number text follows
Python's ``repr(float)``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.isspace() accepts (str.strip(),
# str.split() use them).
PY_WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as one regex class usable by both Java regex and RE2.
PY_WS_CLASS = (
    "[\\t\\n\\x{0b}\\x{0c}\\r\\x{1c}-\\x{1f} \\x{85}\\x{a0}\\x{1680}"
    "\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
)
PY_STRIP_PATTERN = f"^{PY_WS_CLASS}+|{PY_WS_CLASS}+$"
# White space outside the ASCII ``\s`` class shared by Java and RE2
# ([ \t\n\f\r]); mapped to a blank before splitting on ``\s+``.
EXTRA_WS_CHARS = "".join(c for c in PY_WS_CHARS if c not in " \t\n\x0c\r")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: removes Unicode white space at both ends
    (``trim`` with an explicit character set: linear in the trimmed part)."""
    return F.btrim(col(c), F.lit(PY_WS_CHARS))


def py_strip_lower(c) -> Column:
    return F.lower(py_strip(c))


def ws_normalise(c) -> Column:
    """Map non-ASCII white space to a blank (character translation)."""
    return F.translate(col(c), EXTRA_WS_CHARS, " " * len(EXTRA_WS_CHARS))


def ws_tokens(c) -> Column:
    """White-space tokenisation with Python ``str.split()`` semantics."""
    return F.filter(F.split(ws_normalise(c), r"\s+"), lambda t: t != "")


def ws_token_count(c) -> Column:
    """Number of ``str.split()`` tokens, counted without building the array."""
    return F.regexp_count(ws_normalise(c), F.lit(r"\S+"))


def py_repr_str(c) -> Column:
    """Python ``repr(str)``: single quotes unless the text holds a single quote
    and no double quote; backslash, quote, control characters and the other
    characters up to U+00FF that Python does not print are escaped."""
    s = col(c)
    base = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for ch, esc in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        base = F.replace(base, F.lit(ch), F.lit(esc))
    plain = base
    for code in (*range(9), 11, 12, *range(14, 32), *range(127, 161), 173):
        base = F.replace(base, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    base = F.when(s.rlike("[\\x{00}-\\x{1f}\\x{7f}-\\x{a0}\\x{ad}]"), base).otherwise(plain)
    use_double = s.contains("'") & ~s.contains('"')
    single = F.concat(F.lit("'"), F.replace(base, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), base, F.lit('"'))
    return F.when(use_double, double).otherwise(single)


def py_tuple2(a, b) -> Column:
    """``str((a, b))`` for two strings, e.g. ``('good', 'bad')``."""
    return F.concat(F.lit("("), py_repr_str(a), F.lit(", "), py_repr_str(b), F.lit(")"))


def _relayout_scientific(s: Column) -> Column:
    """Java ``d.dddE<n>`` -> Python layout, as one linear chain of regex
    rewrites (each sub-expression appears once, so the whole projection stays
    in generated code): pad the fraction with zeros, move the decimal point
    for the exponents Python prints plainly (-4 and 7..15), then trim zeros
    and spell the remaining exponents ``e±XX``."""
    t = F.regexp_replace(s, "E", "0000000000000000E")
    for k in range(7, 16):
        t = F.regexp_replace(t, rf"^(-?)([0-9])\.([0-9]{{{k}}})([0-9]*)E{k}$", "$1$2$3.$4")
    t = F.regexp_replace(t, r"^(-?)([0-9])\.([0-9]*)E-4$", "$10.000$2$3")
    t = F.regexp_replace(t, r"^([^E]*\.[0-9]*?)0+$", "$1")
    t = F.regexp_replace(t, r"^([^E]*\.)$", "$10")
    t = F.regexp_replace(t, r"\.?0+E", "E")
    t = F.regexp_replace(t, r"E([0-9])$", "e+0$1")
    t = F.regexp_replace(t, r"E([0-9][0-9]+)$", "e+$1")
    t = F.regexp_replace(t, r"E-([0-9])$", "e-0$1")
    return F.regexp_replace(t, r"E-([0-9][0-9]+)$", "e-$1")


def _shortest_whole(x: Column) -> Column:
    """``repr`` of doubles in [1e16, 9.2e18): whole numbers, so the shortest of
    15, 16 or 17 digits that reads back as the value is found in integers."""
    size = F.abs(x).cast("long")
    out = None
    for digits in (17, 16, 15):
        unit = F.when(size < 10 ** 17, 10 ** (17 - digits)).when(size < 10 ** 18, 10 ** (18 - digits)).otherwise(10 ** (19 - digits)).cast("long")
        low = size - F.pmod(size, unit)
        near = low + F.when(F.pmod(size, unit) * 2 > unit, unit).otherwise(F.lit(0))
        fits = near.cast("double") == F.abs(x)
        out = near if out is None else F.when(fits, near).otherwise(out)
    text = out.cast("string")
    body = F.regexp_replace(F.concat(F.substring(text, 1, 1), F.lit("."), F.substring(text, 2, 20)), r"\.?0+$", "")
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), body, F.lit("e+"), (F.length(text) - 1).cast("string"))


def py_float_str(c) -> Column:
    """Python ``str(float)`` / ``repr(float)`` from Java's spelling.

    Both print the shortest round-trip digits; they differ in layout: Java
    switches to ``d.dddE<n>`` outside [1e-3, 1e7), Python to ``d.ddde±XX``
    outside [1e-4, 1e16).  Only Java's scientific spellings are rewritten; no
    Python worker is involved.  Java before 19 does not always print the shortest
    digits from 1e16 on: up to 9.2e18 they are found in integer arithmetic here,
    beyond that (and for subnormals) use ``py_float_str_exact``."""
    x = col(c).cast("double")
    s = x.cast("string")
    return (F.when(F.isnan(x), F.lit("nan"))
            .when(x == float("inf"), F.lit("inf"))
            .when(x == float("-inf"), F.lit("-inf"))
            .when((F.abs(x) >= 1e16) & (F.abs(x) < 9.2e18), _shortest_whole(x))
            .when(s.contains("E"), _relayout_scientific(s))
            .otherwise(s))


@F.pandas_udf(T.StringType())
def py_float_str_exact(s: pd.Series) -> pd.Series:
    """Python's own ``repr`` in an Arrow-batched UDF — for callers that need
    bit-exact parity on a JVM whose ``Double.toString`` is not shortest."""
    return s.map(lambda v: None if pd.isna(v) else repr(float(v)))


def py_fixed(c, n: int) -> Column:
    """Python ``'%.nf'``: rounds the exact binary value, ties to even.

    Java rounds the shortest decimal half up.  The two can differ only where that
    decimal has exactly ``n + 1`` places and ends in 5; there the double is
    compared exactly with the tie (its fraction times 2^62 is a whole number for
    values from 2^-10 on), and below the tie, or on it after an even digit, the
    last place is cut instead of rounded up.  All of it is decimal arithmetic in
    generated code, for the few values near a tie only."""
    x = col(c).cast("double")
    up = F.format_string(f"%.{n}f", x)
    size = F.abs(x)
    scaled = size * F.lit(float(10 ** n))
    near = (size >= 2.0 ** -10) & (size < 1e14) & (F.abs(scaled - F.floor(scaled) - 0.5) <= scaled * 1e-14 + 1e-9)
    shortest = size.cast(f"decimal(30,{n + 1})")  # rounds the shortest decimal, keeps it if it fits
    units = (shortest * F.lit(10 ** (n + 1)).cast(f"decimal({n + 2},0)")).cast("decimal(38,0)").cast("long")
    tie = (shortest.cast("double") == size) & (units % 10 == 5)
    fraction = ((size - F.floor(size)) * F.lit(float(1 << 62))).cast("long").cast("decimal(19,0)") * F.lit(10 ** (n + 1)).cast(f"decimal({n + 2},0)")
    half = (units % 10 ** (n + 1)).cast("decimal(9,0)") * F.lit(1 << 62).cast("decimal(19,0)")
    low = F.call_function("div", units - 5, F.lit(10))  # whole division
    cut = low.cast("decimal(19,0)") * F.lit(10.0 ** -n).cast(f"decimal({n + 1},{n})")
    signed = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), cut.cast("string"))
    down = tie & ((fraction < half) | ((fraction == half) & (low % 2 == 0)))
    return (F.when(F.isnan(x), F.lit("nan")).when(size == float("inf"), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
            .when(~near, up).when(down, signed).otherwise(up))


def py_str(c, kind: str) -> Column:
    """Render a value the way Python ``str()`` renders the spec-declared kind.

    kind: ``int`` | ``float`` | ``str`` | ``fixed<n>`` (``'%.nf'``) |
    ``short<k>_fixed<n>`` (keep ``str(x)`` when at most k characters, else
    ``'%.nf'``)."""
    x = col(c)
    if kind == "int":
        return x.cast("long").cast("string")
    if kind == "float":
        return py_float_str(x)
    if kind == "str":
        return x.cast("string")
    if kind.startswith("fixed"):
        return py_fixed(x, int(kind[5:]))
    if kind.startswith("short"):
        k, n = int(kind[5:].split("_fixed")[0]), int(kind.split("_fixed")[1])
        fixed = py_fixed(x, n)
        if k < 5:
            # every spelling where Java and Python differ (scientific forms,
            # 1e-4 <= |x| < 1e-3, |x| >= 1e7) is at least 5 characters long in
            # Python, so a short Java spelling without an exponent is Python's
            js = x.cast("double").cast("string")
            return F.when((F.length(js) <= k) & ~js.contains("E"), js).otherwise(fixed)
        s = py_float_str(x)
        return F.when(F.length(s) <= k, s).otherwise(fixed)
    raise ValueError(f"unknown render kind {kind!r}")


def null_text(c, text: str = "nan") -> Column:
    """Never let a NULL swallow a whole ``concat``: render it as Python would."""
    return F.coalesce(col(c), F.lit(text))
