import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import divergence as D
from quarry.llm.divergence import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(docs, least):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    rows = [(lang or "", source or "", TERM.findall((text or "").translate(lower))) for text, lang, source in docs]
    out = []
    for lang in {r[0] for r in rows}:
        in_docs = Counter(t for name, _, terms in rows if name == lang for t in set(terms))
        kept = sorted(t for t, n in in_docs.items() if n >= least)
        count = {s: Counter() for name, s, _ in rows if name == lang}
        for name, s, terms in rows:
            if name == lang:
                count[s].update(t for t in terms if in_docs[t] >= least)
        every = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in count.items()}, share(every)
        for s in count:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in count if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t])[:50]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def made(n, seed, sources=7):
    rng = random.Random(seed)
    words = ["Aa", "bé", "日本", "c", "d_e", "Éa", "f1g", "h-i", "\x00j", "ß", "K" * 30, *(f"w{chr(97 + i)}" for i in range(26))]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
    docs = [(text(), rng.choice(["x", "x", "y", None, ""]), f"s{rng.randint(0, sources)}") for _ in range(n)]
    return [*docs, (None, "x", "only null"), ("", None, None), ("rare terms", "z", "one"), ("other words", "z", "two"), ("same", "z", "same"), ("same", "z", "same"), (docs[0][0], "x", None)]


@pytest.mark.parametrize("least", [1, 3, 30])
def test_small_tables(spark, least):
    docs = made(150, least)
    df = spark.createDataFrame([(*d, 1, "q") for d in docs], "text string, lang string, source string, n int, term string").repartition(5)
    assert got(divergence(df, least_docs=least)) == brute(docs, least)
    assert got(divergence(df, least_docs=least, flush=40)) == brute(docs, least)


def test_many_small_cells_and_blocks_of_sources(spark, monkeypatch):
    """Cells of a few entries, dealt by pairs of blocks of three sources."""
    docs = made(200, 5, sources=11)
    for name, value in (("_SIDE", 3), ("_CELL", 8)):
        monkeypatch.setattr(D, name, value)
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    side = D._SIDE

    def cell(frame):
        from quarry.llm import divergence as inside

        inside._SIDE = side
        return inside._cell(frame)

    monkeypatch.setattr(D, "_cell", cell)
    assert got(divergence(df, least_docs=2)) == brute(docs, 2)


def test_very_long_text_and_windows(spark):
    long = " ".join(f"ab{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(700_000)) + "Z" * 3_000_000
    docs = [(long, "x", "a"), (long[:50], "x", "b"), ("aba", "x", "b")]
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    assert got(divergence(df, least_docs=1)) == brute(docs, 1)


def test_empty_table(spark):
    assert divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_colliding_hashes_are_told_apart():
    data = b"one two one three twx onf one"
    start = np.array([0, 4, 8, 12, 18, 22, 26])
    end = np.array([3, 7, 11, 17, 21, 25, 29])
    for digest in (lambda _: 1, len, D.xxhash.xxh3_64_intdigest):
        code, terms = D.grouped(data, start, end, digest)
        assert [terms[c] for c in code.tolist()] == [data[a:b] for a, b in zip(start, end, strict=True)]
        assert len(set(terms)) == len(terms) == 5
