"""Checks that count on the running plan: numbers are gathered while the rows
pass (Spark's observed metrics), so a report or a failed check costs no second
scan.

    checks = Checks(n=F.count(F.lit(1)), dropped=F.count_if(~kept))
    checks.rule("no rows", lambda m: m["n"] > 0)
    write(checks.watch(df).where(kept))      # the one pass
    checks.passed()                          # the numbers, or DataCheckError
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class DataCheckError(ValueError):
    """A rule that the data broke."""


class Checks:
    """Aggregates over a plan's rows, gathered by the action that runs it, and
    rules about them."""

    def __init__(self, **numbers: Column):
        self.numbers = numbers
        self.observation = Observation()
        self.rules: list[tuple[str, Callable[[dict], bool]]] = []

    def rule(self, text: str, holds: Callable[[dict], bool]) -> Checks:
        self.rules.append((text, holds))
        return self

    def watch(self, df: DataFrame) -> DataFrame:
        return df.observe(self.observation, *[c.alias(n) for n, c in self.numbers.items()])

    def passed(self) -> dict:
        """The numbers of the first action on the watched plan.  Waits for it."""
        found = self.observation.get
        broken = [text for text, holds in self.rules if not holds(found)]
        if broken:
            raise DataCheckError(f"{'; '.join(broken)}: {found}")
        return found


def dropping(kept: Column, most: float | None = None) -> Checks:
    """Counts rows (``n_in``) and those without ``kept`` (``n_dropped``); an empty
    input, or a larger share dropped than ``most``, is an error."""
    checks = Checks(n_in=F.count(F.lit(1)), n_dropped=F.count_if(~F.coalesce(kept, F.lit(False))))
    checks.rule("no input rows", lambda m: m["n_in"] > 0)
    if most is not None:
        checks.rule(f"more than {most} of the rows dropped", lambda m: m["n_dropped"] <= most * m["n_in"])
    return checks


def shares(split: str, wanted: dict[str, float], tolerance: float) -> Checks:
    """Counts the rows of each split; a share further than ``tolerance`` from the
    wanted one, a row in no wanted split, or no rows at all is an error."""
    names = {f"n_{i}": name for i, name in enumerate(wanted)}
    checks = Checks(n=F.count(F.lit(1)), **{k: F.count_if(F.col(split) == name) for k, name in names.items()})
    checks.rule("no input rows", lambda m: m["n"] > 0)
    checks.rule("rows in no split", lambda m: sum(m[k] for k in names) == m["n"])
    for k, name in names.items():
        checks.rule(f"share of {name} is not {wanted[name]} within {tolerance}", lambda m, k=k, name=name: not m["n"] or abs(m[k] / m["n"] - wanted[name]) <= tolerance + 1e-12)
    return checks


def share_table(df: DataFrame, split: str, wanted: dict[str, float], tolerance: float) -> DataFrame:
    """``split, n, share, wanted, within`` as a table (one row per split, wanted
    ones without rows too): the same check inside a plan."""
    spark = df.sparkSession
    goals = spark.createDataFrame(list(wanted.items()), "split string, wanted double")
    counts = df.groupBy(F.col(split).alias("split")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    table = goals.join(counts, "split", "full_outer").select("split", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "wanted")
    share = F.col("n") / total
    return table.select("split", "n", F.coalesce(share, F.lit(0.0)).alias("share"), "wanted", F.coalesce(F.abs(share - F.col("wanted")) <= tolerance + 1e-12, F.lit(False)).alias("within"))
