"""Leaderboard with evictions against the loop, step by step."""

import random

from riskloom.operators import leaderboard as lb


def loop(rows, k=3):
    """(step, entered, evicted) of one run, in step order; metrics may be missing."""
    best, out = [], []
    for step, m in sorted(rows):
        if m is None or m != m:
            out.append((step, False, None))
        elif len(best) < k:
            best.append((m, step))
            out.append((step, True, None))
        else:
            best.sort()
            if m > best[0][0]:
                out.append((step, True, best[0][1]))
                best[0] = (m, step)
            else:
                out.append((step, False, None))
    return out, sorted(s for _, s in best)


def both(spark, runs, k=3):
    rows = [(run, step, m) for run, steps in runs.items() for step, m in steps]
    df = spark.createDataFrame(rows, "run string, step long, metric double").repartition(5)
    got = lb.history(df, "metric", "step", ["run"], k).collect()
    kept = lb.board(df, "metric", "step", ["run"], k).collect()
    for run, steps in runs.items():
        history, last = loop(steps, k)
        assert sorted((r.step, r.entered, r.evicted_step) for r in got if r.run == run) == history
        assert sorted(r.step for r in kept if r.run == run) == last
    assert len(got) == len(rows)


def test_the_earliest_of_equal_worst_goes(spark):
    both(spark, {"a": [(1, 1.0), (2, 1.0), (3, 1.0), (4, 2.0)], "b": [(1, 1.0), (2, 1.0)], None: [(1, 3.0), (2, None), (3, float("nan")), (4, 1.0), (5, 2.0), (6, 2.0)]})


def test_random_runs_with_many_ties(spark):
    rng = random.Random(3)
    runs = {f"r{i}": [(s, float(rng.randrange(w))) for s in rng.sample(range(10_000), n)] for i, (n, w) in enumerate([(1, 2), (40, 2), (300, 6), (300, 1000)])}
    runs["rising"] = [(s, float(s // 2)) for s in range(3000)]  # every other step evicts
    both(spark, runs)
    both(spark, {k: runs[k] for k in ("r1", "r2")}, k=1)


def test_many_buckets(spark, monkeypatch):
    """Cuts between nearly all steps: the lists before a bucket carry everything."""
    from riskloom.functions import ordering

    monkeypatch.setattr(ordering, "SPACING", 1)
    rng = random.Random(8)
    both(spark, {"a": [(s, float(rng.randrange(5))) for s in range(60)], "b": [(s, None) for s in range(5)]})


def test_no_rows(spark):
    df = spark.createDataFrame([], "run string, step long, metric double")
    assert lb.history(df, "metric", "step", ["run"]).count() == 0
