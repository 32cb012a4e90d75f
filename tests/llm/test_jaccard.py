import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import queries
from quarry.llm.components import components, stars
from quarry.llm.jaccard import SignatureTree, near_duplicates


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def roots(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute(docs, k, percent):
    sets = [shingles(t, k) for _, t in docs]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    shared = defaultdict(int)
    for ids in by.values():
        for i, a in enumerate(ids):
            for b in ids[:i]:
                shared[b, a] += 1
    linked = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    root = roots(len(docs), linked)
    ids = defaultdict(list)
    for r, (d, _) in zip(root, docs, strict=True):
        ids[r].append(d)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return sorted(((d, len(s), least[r]) for (d, _), s, r in zip(docs, sets, root, strict=True)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_whole_table_against_brute_force(spark, scale):
    sf = f"/root/testdata/sf{scale}"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs, 4, 85)
    assert got(queries.op3_jaccard_join(spark, sf)) == want
    assert any(a != c for a, _, c in want)


@pytest.mark.parametrize(("percent", "per_task", "tokens", "flush"), [(80, 4000, 1 << 20, 1 << 20), (50, 5, 1 << 20, 40), (70, 2, 30, 40)])
def test_random_near_copies(spark, percent, per_task, tokens, flush):
    rng = random.Random(percent)
    word = lambda: rng.choice("abcdefghij") + rng.choice("0123456789")
    docs = []
    for _ in range(14):
        base = [word() for _ in range(rng.choice([1, 3, 6, 20, 60]))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = [word() if rng.random() < rng.choice([0, 0.01, 0.05]) else w for w in base]
            docs.append((rng.randint(0, 10**6), " ".join(copy if rng.random() < 0.9 else copy + [word()])))
    docs += [(None, docs[0][1].upper()), (5, None), (6, ""), (7, " \n"), (docs[3][0], docs[3][1]), (8, "A0 \t b1"), (9, "a0\nB1"), (None, "lone null words")]
    df = spark.createDataFrame([(*d, "x", 2) for d in docs], "doc_id long, text string, digest string, component long").repartition(3)
    assert got(near_duplicates(df, shingle=3, percent=percent, sets_per_task=per_task, tokens_per_task=tokens, flush=flush)) == brute(docs, 3, percent)


def test_different_words_never_meet(spark):
    """Words of Thue and Morse: a polynomial modulo a power of two hashes each like its complement."""
    docs = []
    for n in (3, 8, 11, 14):
        a, b = "a", "b"
        for _ in range(n):
            a, b = a + b, b + a
        docs += [(2 * n, a), (2 * n + 1, b), (100 + n, f"one two {a} three"), (200 + n, f"one two {b} three")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(near_duplicates(df, shingle=4, percent=50)) == brute(docs, 4, 50)


def test_tree_finds_what_links_join():
    rng = np.random.default_rng(1)
    base = [rng.choice(5000, 300, replace=False) for _ in range(5)]
    sets = [np.unique(np.where(rng.random(300) < rng.choice([0.02, 0.2]), rng.integers(0, 5000, 300), base[i % 5])).astype(np.uint64) for i in range(200)]
    every = []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            n = len(np.intersect1d(a, b))
            if 100 * n >= 80 * (len(a) + len(b) - n):
                every.append((j, i))
    links = list(SignatureTree(sets, [len(s) for s in sets], 80).links())
    assert len(links) < len(sets) and {tuple(sorted(x)) for x in links} <= set(every)
    a, b = roots(200, every), roots(200, links)
    assert len(set(a)) == len(set(b)) == len(set(zip(a, b, strict=True)))


def test_chains_across_parts(spark):
    """A group of one large cluster, a chain that only neighbours join, and a set that shares tokens but links to none."""
    base = [f"w{i}" for i in range(40)]
    copies = [(i, " ".join(base[:20] + [f"x{i}"] + base[21:])) for i in range(40)]
    chain = [(100 + i, " ".join([f"w{j}" for j in range(2 * i, 2 * i + 40)])) for i in range(30)]
    docs = copies + chain + [(500, " ".join(base[:22] + [f"y{i}" for i in range(18)]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute(docs, 2, 85)
    assert 1 < len({c for _, _, c in want}) < 10
    assert got(near_duplicates(df, shingle=2, percent=85, sets_per_task=6)) == want


def test_two_sided_tree():
    rng = np.random.default_rng(3)
    base = rng.choice(3000, 120, replace=False)
    sets = [np.unique(np.where(rng.random(120) < 0.08, rng.integers(0, 3000, 120), base)).astype(np.uint64) for _ in range(90)]
    side = [i % 3 == 0 for i in range(90)]
    sizes = [len(s) for s in sets]
    pairs = list(SignatureTree(sets, sizes, 80, side).links())
    assert pairs and all(side[i] != side[j] for i, j in pairs)
    every = [(i, j) for i in range(90) for j in range(90) if side[i] and not side[j] and 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (sizes[i] + sizes[j] - n)]
    assert len(set(roots(90, pairs))) == len(set(roots(90, every)))
    assert not list(SignatureTree(sets, sizes, 80, side, [0] * 90).links())
    assert not list(SignatureTree(sets, sizes, 80, [True] * 90).links())


def smallest(pairs):
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent if root(x) != x}


def test_stars():
    for seed in range(30):
        r = random.Random(seed)
        ids = [bytes([r.randrange(256), 0, i]) for i in range(r.randint(1, 40))]
        pairs = [(r.choice(ids), r.choice(ids)) for _ in range(r.randint(1, 50))]
        node, root = stars(*(pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)))
        assert len(set(node.to_pylist())) == len(node)
        assert dict(zip(node.to_pylist(), root.to_pylist(), strict=True)) == smallest(pairs)


@pytest.mark.parametrize("flush", [1, 7, 1 << 18])
def test_components_of_many_tasks(spark, flush):
    r = random.Random(flush)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    pairs = chain + [(f"x{r.randrange(80)}", f"x{r.randrange(80)}") for _ in range(60)] + [(f"h{i}", "h") for i in range(40)]
    r.shuffle(pairs)
    rows = spark.createDataFrame(pairs, "a string, b string").repartition(5)
    assert {(r["node"], r["component"]) for r in components(rows, "a", "b", flush=flush).collect()} == set(smallest(pairs).items())


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(200 + i, 200) for i in range(1, 40)]
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    root = roots(300, pairs)
    least = {}
    for i in range(300):
        least.setdefault(root[i], i)
    assert {r.node: r.component for r in components(df, "a", "b").collect()} == {i: least[root[i]] for i in range(300) if least[root[i]] != i}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_link_is_counted(spark):
    """Near copies, nearly all of which link to each other, in one part and in many, exact copies and null ids among them."""
    base = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(40)]
    docs += [(50 + i, " ".join(base)) for i in range(5)] + [(None, " ".join(base)), (7, docs[7][1].upper()), (60, ""), (61, None), (62, "alone here"), (63, "q r"), (64, "Q r")]
    sets = [shingles(t, 2) for _, t in docs]
    n = [sum(100 * len(s & t) >= 85 * len(s | t) for t in sets if t) - 1 if s else 0 for s in sets]
    want = sorted(((d, c) for (d, _), c in zip(docs, n, strict=True)), key=repr)
    assert sum(n) > 10 * len(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for per_task in (500, 7):
        rows = near_duplicates(df, shingle=2, percent=85, sets_per_task=per_task, count_links=True).collect()
        assert sorted(((r.doc_id, r.n_links) for r in rows), key=repr) == want
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr) == brute(docs, 2, 85)


def test_census_of_random_sets():
    rng = np.random.default_rng(5)
    base = [rng.choice(5000, 300, replace=False) for _ in range(3)]
    sets = [np.unique(np.where(rng.random(300) < rng.choice([0.02, 0.06]), rng.integers(0, 5000, 300), base[i % 3])).astype(np.uint64) for i in range(150)]
    sizes, weights = [len(s) for s in sets], rng.integers(1, 4, 150).tolist()
    link = lambda a, b: 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (sizes[a] + sizes[b] - n)
    for side in (None, [i % 4 == 0 for i in range(150)]):
        meet = [(i, j) for i in range(150) for j in range(i) if (side is None or side[i] != side[j]) and link(i, j)]
        want = [0] * 150
        for i, j in meet:
            want[i] += weights[j]
            want[j] += weights[i]
        pairs, total = SignatureTree(sets, sizes, 80, side).census(weights)
        assert total.tolist() == want and len(meet) > 2 * len(pairs)
        assert len(set(roots(150, pairs))) == len(set(roots(150, meet)))


def test_links_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = queries.op3_jaccard_links(spark, sf).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, rows)) == sorted(con.execute(queries.oracle_sql()["op3_jaccard_links"]).fetchall())
    assert any(r.n_links for r in rows)
