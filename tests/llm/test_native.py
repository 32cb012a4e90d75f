"""Operators of DataFrame functions alone: mixing, quality rules, sharding, chat formatting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, mix, queries, rules, shard

SPACED = r"[^\x20\x09-\x0D]+"


def naive_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted((x for x in sizes if x is not None), key=lambda x: [ord(c) for c in x]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        rate = left / sum(weight[s] for s in free)
        full = {s for s in free if rate * weight[s] > cap * sizes[s]}
        if not full:
            out |= {s: rate * weight[s] for s in free}
            break
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        free -= full
    return out


def test_targets_and_quotas(spark):
    rng = random.Random(2)
    for n in (1, 3, 7, 20):
        sizes = {("s%d" % i if i else None): rng.choice([0, 3, rng.randint(1, 9000)]) for i in range(n)}
        df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
        got = {r.source: r.target for r in mix.source_targets(df).collect()}
        want = naive_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in sizes)
        for seats in (0, 1, n, 57):
            votes = spark.createDataFrame([(i, float(rng.choice([0, 1, 10, 500])), seats) for i in range(n)], "i int, v double, seats long")
            rows = votes.collect()
            best = sorted(((-r.v / (2 * k - 1), r.i, k) for r in rows for k in range(1, seats + 1)))[:seats]
            won = Counter(i for _, i, _ in best) if sum(r.v for r in rows) else Counter()
            quota = mix.apportion(votes, group=[], votes="v", seats="seats", name="q", order=[F.col("i")])
            assert {r.i: r.q for r in quota.collect()} == {r.i: won[r.i] for r in rows}


def check_mix(rows, blocks):
    """rows: doc_id, source, size, source_size, target, taken."""
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    want = naive_targets({s: sum(r.size for r in x) for s, x in by.items()})
    for s, x in by.items():
        assert {r.source_size for r in x} == {sum(r.size for r in x)}
        assert abs(x[0].target - want[s]) < 1e-6 * (1 + want[s])
        assert abs(sum(r.taken for r in x) - want[s]) <= 2 * blocks + 0.01 * want[s]


def sainte_lague(parties, seats, limit=None):
    """Seats one at a time to the highest quotient of (order, votes) that has room."""
    held = [0] * len(parties)
    for _ in range(seats if sum(v for _, v in parties) else 0):
        open_ = [i for i in range(len(parties)) if limit is None or held[i] < limit[i]]
        if not open_:
            break
        held[min(open_, key=lambda i: (-parties[i][1] / (2 * held[i] + 1), parties[i][0]))] += 1
    return held


def naive_mix(spark, docs, *, rows_per_shard, block_words, shards_per_range, whole, seed=0):
    """doc_id -> taken, by plain loops; only the hashes are Spark's."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", "source", "text", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), text).alias("key")).withColumn("draw", F.xxhash64(F.lit(seed), F.lit("draw"), "key")).collect()
    size = [len(re.findall(SPACED, r.text or "")) for r in rows]
    by = defaultdict(list)
    for i, r in enumerate(rows):
        by[r.source].append(i)
    target = naive_targets({s: sum(size[i] for i in x) for s, x in by.items()})
    names = sorted(by, key=lambda s: (s is None, s or ""))
    won = dict(zip(names, sainte_lague([(n, target[s]) for n, s in enumerate(names)], round(sum(target.values()))), strict=True))
    half_up = lambda x: int(math.floor(x + 0.5))
    taken, wanted = {}, []
    for s in names:
        total = sum(size[i] for i in by[s])
        words = max(min(int(target[s] // 32), block_words), 1)
        quota = half_up(won[s] * max(half_up(total / words), 1) / total) if total else 0
        shards, held = max(-(-len(by[s]) // rows_per_shard), 1), defaultdict(list)
        for i in by[s]:
            held[((rows[i].key % (1 << 64)) >> 7) % shards].append(i)
        weight = {h: sum(size[i] for i in x) for h, x in held.items()}
        blocks = {h: max(half_up(w / words), 1) if w else 0 for h, w in weight.items()}
        ranges = defaultdict(list)
        for h in sorted(held):
            ranges[h // shards_per_range].append(h)
        order = sorted(ranges)
        seats = sainte_lague([(g, sum(weight[h] for h in ranges[g])) for g in order], quota, [sum(2 * blocks[h] for h in ranges[g]) for g in order])
        for g, n in zip(order, seats, strict=True):
            for h, got in zip(ranges[g], sainte_lague([(h, weight[h]) for h in ranges[g]], n, [2 * blocks[h] for h in ranges[g]]), strict=True):
                full, rest = divmod(got, blocks[h]) if blocks[h] else (0, 0)
                at = 0
                for i in sorted(held[h], key=lambda i: (rows[i].draw, rows[i].key) if whole else (rows[i].key, rows[i].doc_id, size[i])):
                    taken[i] = full * size[i]
                    if whole:
                        taken[i] += size[i] * (rest > 0 and (at + size[i] / 2) * blocks[h] < rest * weight[h])
                    elif rest:
                        wanted.append((i, "" if s is None else "=" + s, h, rest, blocks[h], weight[h], at))
                    at += size[i]
    keys = sorted({(s, h, n) for _, s, h, _, n, _, _ in wanted})
    drawn = defaultdict(list)
    if keys:
        table = spark.createDataFrame(keys, "s string, h long, n long").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        for r in table.select("s", "h", "b", F.xxhash64(F.lit(seed), "s", "h", "b").alias("x")).collect():
            drawn[r.s, r.h].append((r.x, r.b))
    for i, s, h, rest, n, total, at in wanted:
        for _, b in sorted(drawn[s, h])[:rest]:
            taken[i] += max(min((b + 1) * total // n, at + size[i]) - max(b * total // n, at), 0)
    return Counter((rows[i].doc_id, n) for i, n in taken.items())


@pytest.mark.parametrize("whole", [False, True])
def test_mix_against_plain_loops(spark, sf, whole):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(10**6, "a b c " * 9000, "tiny"), (10**6 + 1, "one", "z"), (10**6 + 2, None, None), (10**6 + 3, "w " * 77, None)], docs.schema)
    docs = docs.unionByName(odd).cache()
    for options in (dict(rows_per_shard=2000, block_words=64, shards_per_range=1000), dict(rows_per_shard=9, block_words=16, shards_per_range=3)):
        got = Counter((r.doc_id, r.taken) for r in mix.mix(docs, whole_documents=whole, **options).collect())
        assert got == naive_mix(spark, docs, whole=whole, **options)


def test_apportion_with_limits(spark):
    rng = random.Random(6)
    for _ in range(4):
        n = rng.randint(1, 9)
        rows = [(i, rng.choice([0, 1, 5, 90]), 30, rng.choice([0, 2, 6, 40])) for i in range(n)]
        got = {r.i: r.q for r in mix.apportion(spark.createDataFrame(rows, "i int, v long, seats long, most long"), group=[], votes="v", seats="seats", name="q", order=[F.col("i")], limit="most").collect()}
        assert all(got[i] <= most for i, _, _, most in rows)
        if sum(v for _, v, _, _ in rows):
            assert sum(got.values()) == min(30, sum(most for *_, most in rows))


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mix.mix(docs).collect()
    check_mix(rows, 64)
    sizes = {r.doc_id: len(re.findall(SPACED, r.text)) for r in docs.collect()}
    assert {r.doc_id: r.size for r in rows} == sizes
    assert Counter(rows) == Counter(mix.mix(docs.repartition(3)).collect())
    check_mix(mix.mix(docs, rows_per_shard=7, block_words=16).collect(), 16 * 40)


def test_mix_edges(spark):
    data = [(1, None, "a"), (1, "x y z", "a"), (None, "q " * 900, None), (3, "", "b"), (3, "w " * 40, "b"), (3, "w " * 40, "b")]
    df = spark.createDataFrame([(*x, 1.0, 2) for x in data], "doc_id long, text string, source string, target double, size int")
    rows = mix.mix(df, block_words=4).collect()
    assert len(rows) == len(data)
    check_mix(rows, 8)
    assert mix.mix(df.limit(0)).count() == 0
    assert [r.taken for r in mix.mix(df.where("text = ''")).collect()] == [0]


def test_mix_small_sources(spark):
    """Beside a large source, small ones get their targets, down to one word."""
    data = [(i, "w " * 400, "large") for i in range(20)]
    data += [(100 * n + i, "w " * part, f"s{n}") for n, parts in ((1, [1]), (3, [2, 1]), (10, [4, 6]), (15, [15]), (31, [20, 11]), (100, [60, 40]), (333, [300, 33])) for i, part in enumerate(parts)]
    by = defaultdict(list)
    for r in mix.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect():
        by[r.source].append(r)
    assert len(by) == 8
    for x in by.values():
        assert abs(sum(r.taken for r in x) - x[0].target) <= 1 + min(0.04 * x[0].target, 32)


def brute_rules(text):
    text = text or ""
    w = re.findall(SPACED, text)
    lines = [x for x in text.split("\n") if re.search(SPACED, x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
    n = len(w)
    return n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_rules_on_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_quality_rules(spark, sf).collect()
    assert {r.doc_id: tuple(r[c] for c in BASE) for r in rows} == {d: brute_rules(t) for d, t in texts.items()}
    assert not any(r.kept and r.base_failed for r in rows)
    clean = [r for r in rows if not r.base_failed and not r.n_symbols and r.n_repeat_words <= 5]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    noisy = [r for r in rows if not r.base_failed and r.n_symbols > 0.5 * r.n_words]
    assert noisy and not any(r.kept for r in noisy)


FLOOR = 0.01 * np.eye(5)


def logdet(fit):
    return np.linalg.slogdet(fit[1] + FLOOR)[1]


def far(x, m, c):
    return ((np.linalg.solve(np.linalg.cholesky(c + FLOOR), (x - m).T)) ** 2).sum(axis=0)


def weighed(x, w):
    m = (w[:, None] * x).sum(axis=0) / w.sum()
    return m.round(9), ((w[:, None] * x).T @ x / w.sum() - np.outer(m, m)).round(9)


def nearest(x, d2, inner=0.75):
    """The inner share of rows, those of the last step of distances in part."""
    step = np.floor(np.log(d2 + 1e-6) * 64)
    edge = np.sort(step)[math.ceil(inner * len(x)) - 1]
    part = (inner * len(x) - (step < edge).sum()) / (step == edge).sum()
    return weighed(x, np.where(step < edge, 1.0, np.where(step == edge, part, 0.0)))


def plain_determinants(spark, groups, starts=10, draw=50, nest=500, floor=0.01):
    """(mean, covariance) of each of groups, {name: rows}, and all fits to whole groups that were seen; only the hashes that draw rows are Spark's."""
    flat = [(g, i, *x) for g, rows in groups.items() for i, x in enumerate(rows.tolist())]
    table = spark.createDataFrame(flat, "g string, i int, z0 double, z1 double, z2 double, z3 double, z4 double").withColumn("k", F.xxhash64("z0", "z1", "z2", "z3", "z4"))
    hashed = table.select("g", "i", F.array(*(F.pmod(F.xxhash64(F.lit(0), F.lit(x), "k"), F.lit(1 << 30)) for x in ("nest", *range(1, starts)))).alias("d")).collect()
    draws = {(r.g, r.i): [x / (1 << 30) for x in r.d] for r in hashed}
    best, seen = {}, {}
    for g, x in groups.items():
        low, middle, high = ((np.sort(np.floor(x * 32), axis=0)[math.ceil(q * len(x)) - 1] + 0.5) / 32 for q in (0.25, 0.5, 0.75))
        centre = lambda y: nearest(y, ((y - middle) ** 2 / (((high - low) / 1.349) ** 2 + floor)).sum(axis=1))  # noqa: B023, E731
        d = np.array([draws[g, i] for i in range(len(x))])
        y, e, held = x[d[:, 0] < nest / len(x)], d[d[:, 0] < nest / len(x)], min(len(x), nest)
        if len(y):
            inside = [e[:, n] < min(draw, held / 2) / held for n in range(1, starts)]
            fits = [centre(y)] + [nearest(y, far(y, *weighed(y, w.astype(float)))) for w in inside if w.any()]
            fits = [nearest(y, far(y, *f)) for f in fits]
            seen[g] = [nearest(x, far(x, *min(fits, key=logdet)))]
        else:
            seen[g] = [centre(x)]
        while True:
            seen[g].append(nearest(x, far(x, *seen[g][-1])))
            if logdet(seen[g][-2]) - logdet(seen[g][-1]) < 1e-3:
                break
        best[g] = min(seen[g], key=logdet)
    return best, seen


def naive_verdicts(spark, rows, inner=0.75, prior=100, rate=1e-4):
    """kept and d2 of rows(doc_id, lang, source, statistics) by plain NumPy."""
    rows = [r for r in rows if not r["base_failed"]]
    # logarithms as Spark rounds their last bit, which the hashes that draw rows depend on
    logs = {r.n: r.l for r in spark.createDataFrame([(n,) for n in {r["n_words"] for r in rows}], "n long").select("n", F.ln(F.col("n") + 1.0).alias("l")).collect()}
    z = np.array([[logs[r["n_words"]], r["word_chars"] / r["n_words"], math.sqrt(r["n_symbols"] / r["n_words"]), math.sqrt(r["n_dup_lines"] / r["n_words"]), r["n_repeat_words"] / r["n_words"]] for r in rows])
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[r["lang"], r["source"]].append(i)
        groups[r["lang"],].append(i)
    named = {str(g): g for g in groups}
    best = {named[g]: fit for g, fit in plain_determinants(spark, {str(g): z[at] for g, at in groups.items()})[0].items()}
    q = lambda p, k: rules.chi_square_quantile(p, k)
    consistent = inner / rules.chi_square(q(inner, 5), 7)
    out = {}
    for (lang, *source), at in groups.items():
        if source:
            (m, c), (n, d), a = best[lang, source[0]], best[lang,], len(at) / (len(at) + prior)
            for i, x in zip(at, far(z[at], a * m + (1 - a) * n, consistent * (a * c + (1 - a) * d)), strict=True):
                out[rows[i]["doc_id"]] = (x <= q(1 - rate, 5), x)
    return out


def test_verdicts_against_plain_determinants(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()
    judged = rules.quality_rules(docs).join(docs.select("doc_id", "lang", "source"), "doc_id").collect()
    want = naive_verdicts(spark, judged)
    assert {r.doc_id: r.kept for r in judged} == {r.doc_id: bool(want.get(r.doc_id, (False,))[0]) for r in judged}
    assert all(abs(r.d2 - want[r.doc_id][1]) < 1e-5 * (1 + r.d2) for r in judged if r.d2 is not None)
    again = rules.quality_rules(docs.repartition(5)).select("doc_id", "kept", "d2").collect()
    assert sorted((r.doc_id, r.kept, r.d2) for r in judged if r.d2 is not None) == sorted(tuple(r) for r in again if r.d2 is not None)


def test_the_least_determinant_is_kept(spark):
    """Whatever a step does, the result is the least seen; and starts from other rows, exact in which rows they take, find none much below it."""
    rng = np.random.default_rng(3)
    mixed = lambda n, bad: np.vstack([rng.normal(size=(n - bad, 5)) * [1, 0.3, 0.1, 0.02, 0], rng.normal(size=(bad, 5)) * 0.4 + [4, 0, 2, 1, 1]])
    groups = {"one": mixed(1, 0), "few": mixed(4, 1), "small": mixed(60, 12), "middle": mixed(400, 90), "large": mixed(3000, 600), "equal": np.tile(rng.normal(size=(1, 5)), (900, 1)), "half": np.vstack([np.tile([[1.0, 2, 0, 0, 0]], (300, 1)), mixed(300, 40)])}
    table = spark.createDataFrame([(g, *x) for g, rows in groups.items() for x in rows.tolist()], "__group string, z0 double, z1 double, z2 double, z3 double, z4 double")
    got = {r["__group"]: r for r in rules.covariance_determinant(table.withColumn("__key", F.xxhash64(*(f"z{i}" for i in range(5))))).collect()}
    best, seen = plain_determinants(spark, groups)
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g].logdet <= min(map(logdet, seen[g])) + 1e-6
        assert np.allclose([got[g][f"m{i}"] for i in range(5)], best[g][0], atol=1e-6)
        found, h = [], max(math.ceil(0.75 * len(x)), 1)
        for _ in range(30):
            at = rng.choice(len(x), max(min(30, len(x) // 2), 1), replace=False)
            for _ in range(20):
                fit = weighed(x[at], np.ones(len(at)))
                at = np.argsort(far(x, *fit), kind="stable")[:h]
            found.append(logdet(weighed(x[at], np.ones(len(at)))))
        assert got[g].logdet <= min(found) + 0.05, g
    large = [r for r in [got["large"]]][0]
    assert abs(large.m0) < 0.1 and large.c00 < 1.2  # a fifth of rows elsewhere moves nothing


def test_chi_square():
    assert abs(rules.chi_square_quantile(0.95, 2) + 2 * math.log(0.05)) < 1e-9
    assert abs(rules.chi_square(3.0, 1) - math.erf(math.sqrt(1.5))) < 1e-12 and abs(rules.chi_square_quantile(0.999, 5) - 20.515) < 1e-3


def test_rules_edges(spark):
    rng = random.Random(1)
    texts = [None, "", "\n\n", "a b", "x y z x y z x y", "a a a a", "É𝄞 #*<>| \x1c b\x0bc", "l 1\nl 1\n \nl 1", "w " * 5000, " ".join(rng.choice("abc") for _ in range(400))]
    texts += [" ".join(str(rng.randint(0, 9999)) for _ in range(rng.randint(60, 90))) for _ in range(300)] + ["# " * 80 + " ".join(map(str, range(200)))]
    df = spark.createDataFrame([(i % 250 if i else None, t, rng.choice(["en", None]), "s", 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int, kept string")
    rows = rules.quality_rules(df).collect()
    assert Counter((r.doc_id, *(r[c] for c in BASE)) for r in rows) == Counter((i % 250 if i else None, *brute_rules(t)) for i, t in enumerate(texts))
    assert sum(r.kept for r in rows) >= 295
    assert not [r for r in rows if r.n_symbols == 80][0].kept
    assert rules.quality_rules(df.limit(0)).count() == 0


def test_shard(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op8_shard(spark, sf).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(text)
    for r in rows:
        data = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 24)
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def naive_shard(spark, keys, tree, seed=0):
    """Descend nested dicts one key and one node at a time; draws are made by Spark's hash of each key, level and label."""
    labels = {(level, x) for level, nodes in enumerate(levels(tree)) for node in nodes for x in node}
    hashes = keys.select("k", *(F.xxhash64("k", F.lit(seed), F.lit(level), F.lit(x).cast("long")).alias(f"{level}_{x}") for level, x in sorted(labels))).collect()
    total = lambda node: sum(map(total, node.values())) if isinstance(node, dict) else node
    out = {}
    for h in hashes:
        node, level = tree, 0
        while isinstance(node, dict):
            draws = {x: -math.log((((h[f"{level}_{x}"] % (1 << 64)) >> 12) + 0.5) / (1 << 52)) / total(child) for x, child in node.items()}
            label = min(draws, key=draws.get)
            node, level = node[label], level + 1
        out[h["k"]] = label
    return out


def levels(tree):
    nodes = [tree]
    while nodes and isinstance(nodes[0], dict):
        yield nodes
        nodes = [x for node in nodes for x in node.values()]


def test_shard_tree_against_naive_descent(spark):
    keys = spark.range(1500).select(F.xxhash64("id").alias("k")).cache()
    for tree in (shard.even_tree(24), shard.even_tree(1), {5: {7: {3: 2.0, 1: 0.5}}, 2: {9: {0: 4.0}, 8: {2: 1.0, 4: 3.0, 6: 0.1}}}, shard.grown_tree(shard.even_tree(13))):
        for seed in (0, 3):
            assert {r.k: r.s for r in shard.place(keys, F.col("k"), tree, "s", seed).collect()} == naive_shard(spark, keys, tree, seed)


def test_shard_tree_is_even_and_confines_movement(spark):
    keys = spark.range(40000).select(F.xxhash64("id").alias("k"))
    even = shard.even_tree(24)
    heavy = shard.even_tree(24)
    heavy[1][4][17] = 5.0
    placed = shard.place(keys, F.col("k"), even, "a")
    for name, tree in (("b", shard.grown_tree(even)), ("c", heavy), ("d", shard.grown_tree(shard.grown_tree(even)))):
        placed = shard.place(placed, F.col("k"), tree, name)
    rows = placed.select("a", "b", "c", "d").collect()
    count = Counter(r.a for r in rows)
    assert len(count) == 24 and max(count.values()) < 1.2 * min(count.values())
    # a shard more takes rows only into itself
    assert shard.grown_tree(even) == shard.even_tree(25)
    assert all(r.b in (r.a, 24) and r.d in (r.b, 25) for r in rows) and abs(sum(r.b == 24 for r in rows) / 40000 - 1 / 25) < 0.01
    # with a weight rows move into the subtrees that grew, and nowhere else: region 1, in it rack 4, in it shard 17
    region, rack = (lambda s: s // 12), (lambda s: s // 4)
    for r in rows:
        assert region(r.c) in (region(r.a), 1)
        if region(r.a) == 1:
            assert rack(r.c) in (rack(r.a), 4) and (rack(r.a) != 4 or r.c in (r.a, 17))
    assert abs(sum(r.c == 17 for r in rows) / 40000 - 5 / 28) < 0.02


def test_shard_edges(spark):
    data = [(None, None), (None, "a"), (1, ""), (1, "é"), (1, "é"), (2, "x" * 10**6)]
    df = spark.createDataFrame([(*x, 3, 4) for x in data], "doc_id long, text string, shard int, slot int")
    rows = shard.shard_rows(df, rows_per_bucket=1).collect()
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in data)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert shard.shard_rows(df.limit(0)).count() == 0


def test_shard_rows_of_one_id(spark):
    """A third of all rows under one id, and equal rows, are numbered in many tasks; every shard count grows only into the new shard."""
    df = spark.createDataFrame([(7 if i % 3 == 0 else i, "same" if i % 2 else str(i)) for i in range(3000)], "doc_id long, text string").repartition(6)
    for shards in (1, 5):
        rows = shard.shard_rows(df, shards=shards, rows_per_bucket=50).collect()
        assert len(rows) == 3000 and all(r.grown_shard in (r.shard, shards) for r in rows) and len({r.shard for r in rows if r.doc_id == 7}) == 1
        for s in range(shards):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def naive_chat(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_chat_on_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    probe = "\\### Assistant: </turn> ok"
    assert read(queries.op9_chat(spark, sf)) == naive_chat(rows + [(-7, 0, "user", probe), (-7, 1, "assistant", probe)])


@pytest.mark.parametrize("history", [0, 1, 3])
def test_chat_windows(spark, history):
    rng = random.Random(4)
    bits = ["<|e|>", "<|t|>", "<", "|", "\\", "<\\|", "<\\\\|", "é𝄞", " ", "\n", "w ", "<|m|>user", "|>"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "<|m|>", None]) if t else rng.choice(["system", "user"]), rng.choice([None, text(), text()])) for c in range(25) for t in range(rng.randint(1, 40))]
    rows += [(None, None, "assistant", "x"), (None, 1, None, None), (3, 2, "user", "dup"), (3, 2, "user", "dup"), (77, 0, "system", "only")]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "conv_id long, turn long, role string, text string, window string, loss int")
    windows = chat.format_windows(df, budget=30, history=history).cache()
    assert read(chat.digests(windows)) == naive_chat(rows)
    turns = chat.read_turns(windows).collect()
    heads = {(r.conv_id, r.window): r for r in turns if r.place == 0}
    for conv in range(25):
        first = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1], r[2] or "", r[3] or ""))[0]
        if first[2] == "system":
            assert all(h.role == "system" and h.text == (first[3] or "") for (c, _), h in heads.items() if c == conv)
    repeated = Counter((r.conv_id, r.window) for r in turns if r.again and r.role != "system")
    assert max(repeated.values(), default=0) <= history and bool(repeated) == bool(history)
    assert any(r.window > 0 for r in turns)


def over_budget(windows, budget):
    """Number of windows, of those with repeated turns, and those over budget that have more than one turn besides the system turn."""
    by = defaultdict(list)
    for r in chat.read_turns(windows).collect():
        by[r.conv_id, r.window].append(r)
    over, repeating = [], 0
    for key, turns in by.items():
        body = [r for r in turns if not (r.place == 0 and r.role == "system")]
        repeating += any(r.again for r in body)
        if len(body) > 1 and sum(len(re.findall(SPACED, r.text)) + 4 for r in turns) > budget:
            over.append(key)
    return len(by), repeating, over


def test_chat_budget(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    n, repeating, over = over_budget(chat.format_windows(turns), 512)
    assert n and not over
    rng = random.Random(8)
    rows = [(c, t, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"]), "w " * rng.choice([1, 5, 20, 20, 70, c])) for c in range(30) for t in range(rng.randint(1, 30))]
    windows = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=60, history=3).cache()
    n, repeating, over = over_budget(windows, 60)
    assert n > 60 and repeating > 20 and not over
    assert read(chat.digests(windows)) == naive_chat(rows)
    read_back = chat.read_turns(windows).collect()
    assert {(r.conv_id, r.window) for r in read_back if r.role != "system" and not r.again} | {(c, 0) for c in range(30)} == {(r.conv_id, r.window) for r in read_back}


def test_chat_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_windows(empty)).count() == 0
