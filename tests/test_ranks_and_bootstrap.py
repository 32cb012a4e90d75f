import hashlib
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import bootstrap, gold, metrics, ranks


def plain_bounds(pairs, resamples, seed, confidence=0.95):
    """Every resample drawn one by one."""
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % bootstrap.PRIME
    means = []
    for r in range(resamples):
        w = []
        for q, _ in pairs:
            u = (h(f"{seed}|{q}") * h(f"{seed}|times|{r}") + h(f"{seed}|plus|{r}")) % bootstrap.PRIME / bootstrap.PRIME
            w.append(sum(u >= x for x in bootstrap.thresholds()))
        if sum(w):
            means.append(sum(a * d for a, (_, d) in zip(w, pairs, strict=True)) / sum(w))
    return np.percentile(means, [50 * (1 - confidence), 100 - 50 * (1 - confidence)])


def test_bounds_against_plain_resamples(spark):
    rng = random.Random(2)
    rows = [(g, f"q{i}", rng.random(), rng.random()) for g in ("a", None, "b") for i in range({"a": 1, None: 30, "b": 7}[g])]
    df = spark.createDataFrame(rows, "arm string, question_id string, baseline double, treated double").repartition(6)
    got = {r.arm: r for r in bootstrap.paired_delta(df, "arm", resamples=300, seed=5).collect()}
    for g in ("a", None, "b"):
        mine = [(q, t - b) for a, q, b, t in rows if a == g]
        low, high = plain_bounds(mine, 300, 5)
        assert (got[g].n, got[g].lost) == (len(mine), sum(d < 0 for _, d in mine))
        assert (got[g].low, got[g].high, got[g].mean_delta) == pytest.approx((low, high, statistics.mean(d for _, d in mine)), abs=1e-9)


def test_one_result_whatever_the_partitions(spark):
    rows = [(i, (i * 7 % 13) / 13, (i * 5 % 11) / 11) for i in range(5000)]
    df = spark.createDataFrame(rows, "question_id int, baseline double, treated double")
    one, many = (bootstrap.paired_delta(df.repartition(n), resamples=500).first() for n in (1, 9))
    assert one == many
    deltas = np.array([t - b for _, b, t in rows])
    error = deltas.std() / len(rows) ** 0.5
    assert one.low == pytest.approx(deltas.mean() - 1.96 * error, abs=error / 2) and one.high == pytest.approx(deltas.mean() + 1.96 * error, abs=error / 2)


def test_weights_are_poisson():
    steps = bootstrap.thresholds()
    assert steps[-1] == pytest.approx(1, abs=1e-9)
    q = np.array([bootstrap.hashed(f"1|{i}") for i in range(400)])
    r = np.array([[bootstrap.hashed(f"1|times|{i}"), bootstrap.hashed(f"1|plus|{i}")] for i in range(400)])
    w = np.searchsorted(steps, (q[:, None] * r[:, 0] + r[:, 1]) % bootstrap.PRIME / bootstrap.PRIME, side="right")
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.03)
    assert abs(np.corrcoef(w)[np.triu_indices(400, 1)]).max() < 0.35  # questions are drawn apart


def test_pairs_of_two_tables(spark):
    one = spark.createDataFrame([("x", 1, 0.5), ("x", 2, 1.0)], "arm string, question_id int, value double")
    both = bootstrap.pair_up(one, one.withColumn("value", F.col("value") + 1), "arm")
    assert bootstrap.paired_delta(both, "arm").first().mean_delta == 1.0
    with pytest.raises(Exception, match="counterpart"):
        bootstrap.paired_delta(bootstrap.pair_up(one, one.where("question_id = 1"), "arm"), "arm").collect()
    assert bootstrap.paired_delta(both.limit(0), "arm").count() == 0
    assert bootstrap.paired_delta(both.limit(0)).first().n == 0
    with pytest.raises(ValueError):
        bootstrap.paired_delta(both, confidence=1.0)


def test_ranks_of_a_large_group(spark):
    rng = random.Random(3)
    rows = [("big" if i % 10 else rng.choice(["a", "b", None]), rng.randint(0, 50), i, "t" * (i % 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "kind string, size int, id int, part string").repartition(7)
    got = ranks.with_rank(df, "kind", "size", "id")
    assert got.columns == ["kind", "size", "id", "part", "rank", "n"]
    want = []
    for kind in ("big", "a", "b", None):
        mine = sorted((r for r in rows if r[0] == kind), key=lambda r: (r[1], r[2]))
        want += [(*r, i + 1, len(mine)) for i, r in enumerate(mine)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert ranks.with_rank(df.limit(0), "kind", "id").count() == 0


@pytest.mark.parametrize("few", [4096, 5])
def test_smallest_rows(spark, few, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", few)
    ids = [(f"{'big' if i % 9 else 'small'}", f"c{i}") for i in range(2000)] + [("big", "c7")] * 20 + [("none", "x"), (None, "y"), ("all", "z")]
    df = spark.createDataFrame(ids, "kind string, id string").repartition(5)
    takes = spark.createDataFrame([("big", 501), ("small", 1), ("all", 9), ("none", 0), ("unknown", 3)], "kind string, take int")
    got = ranks.smallest(df, takes, "kind", gold.by_hash(F.col("id"), 4), "id")
    want = []
    for kind, take in (("big", 501), ("small", 1), ("all", 9)):
        want += sorted((r for r in ids if r[0] == kind), key=lambda r: (hashlib.md5(f"4|{r[1]}".encode()).hexdigest(), r[1]))[:take]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_terciles_of_odd_and_small_groups(spark):
    rng = random.Random(6)
    rows = [(m, i, rng.randint(0, 9), i % 3 == 0) for m, n in (("a", 1), ("b", 2), ("c", 3), ("d", 11), ("e", 64)) for i in range(n)]
    got = {(r.model, r.tercile): r for r in metrics.length_terciles(spark.createDataFrame(rows, "model string, question_id int, chars int, hit boolean")).collect()}
    for m in "abcde":
        mine = sorted((c, q, h) for x, q, c, h in rows if x == m)
        third = len(mine) // 3
        parts = [mine[:third], mine[third : 2 * third], mine[2 * third :]] if third else [[], [], mine]
        for t, part in enumerate(parts):
            if part:
                r = got[m, t]
                assert (r.n, r.median_chars, r.mean_chars) == (len(part), statistics.median(c for c, _, _ in part), pytest.approx(statistics.mean(c for c, _, _ in part)))
