import hashlib
import random
import re
from collections import Counter

import pytest

from quarry.llm import substrings
from quarry.llm.queries import op10_remove_repeats
from quarry.llm.substrings import remove_repeats


def brute(docs, size=35):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    seen = Counter(tuple(w[i : i + size]) for _, w in split for i in range(len(w) - size + 1))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_whole_tables_against_brute_force(spark, scale):
    sf = f"/root/testdata/sf{scale}"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    assert got(op10_remove_repeats(spark, sf)) == want
    assert any(x[2] for x in want)


@pytest.mark.parametrize("flush", [1 << 20, 50])
def test_small_windows_many_flushes_and_saturated_sketch(spark, flush):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(n))
    shared = [text(20), text(9)]
    docs = [(i, text(rng.randint(0, 30)) + "\n" + rng.choice(["", *shared]) + "  " + text(5)) for i in range(80)]
    docs += [(None, docs[0][1]), (3, None), (3, ""), (3, docs[4][1]), (3, docs[4][1]), (99, (shared[0] + "\t") * 60), (100, text(20000)), (-(1 << 63), docs[0][1])]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, spans string, key string").repartition(3, "text")
    want = brute(docs, 8)
    assert got(remove_repeats(df, window=8, k=3, flush=flush)) == want
    assert got(remove_repeats(df, window=8, k=3, flush=flush, max_cell_bits=9)) == want


def thue_morse(steps, a="a", b="b"):
    """Words that every polynomial modulo a power of two hashes like their complements."""
    word = a
    for _ in range(steps):
        word += word.translate(str.maketrans(a + b, b + a))
    return word


def test_different_words_never_meet(spark):
    head = " ".join(f"w{i}" for i in range(40))
    docs = [(f"{i}/é", f"{head[:60]} {thue_morse(n, *s)} {head[60:]}") for i, (n, s) in enumerate((n, s) for n in (3, 8, 11, 14) for s in ("ab", "ba"))]
    docs += [("x", " ".join(thue_morse(6, "a", "b"))), ("y", " ".join(thue_morse(6, "b", "a")))]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    assert got(remove_repeats(df)) == brute(docs)
    assert got(remove_repeats(df, window=8, k=3)) == brute(docs, 8)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs():
    import numpy as np

    pos = np.array([3, 4, 5, 9, 0, 1, 7])
    assert substrings._unruns(substrings._runs(pos)).tolist() == pos.tolist()
