import hashlib
import random
import re

import pyarrow as pa
import pytest

from quarry.llm import decontaminate as decontaminate_module
from quarry.llm.decontaminate import decontaminate
from quarry.llm.queries import op4_decontaminate


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    lengths = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= {str(y) for y in windows[x] if y is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_whole_tables_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted(brute(docs, items), key=repr)
    assert got(op4_decontaminate(spark, sf)) == want
    assert any(x[5] for x in want)


def test_random_texts_and_several_blocks(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["a", "B", "é", "c9"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 12, 30]))) for i in range(12)] + [(None, text(11)), (3, text(14)), (50, None), (51, "?!")]
    long = [i[1] for i in items if i[1]]
    docs = [(i, rng.choice(["", text(rng.randint(0, 60)), text(5) + " " + rng.choice(long) + "-" + text(4)])) for i in range(60)]
    docs += [(None, long[-1]), (7, None), (7, long[-1]), (8, (text(3000) + " ") * 3)]
    schema = "doc_id long, text string, n_words string, items int, __text string"
    df = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], schema)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, items), key=repr)
    assert got(decontaminate(df, bench)) == want
    assert got(decontaminate(df, bench, block_bytes=60)) == want


def test_different_words_never_meet(spark):
    """Words of Thue and Morse, which polynomials modulo a power of two confuse, and a key under which two words have one hash."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    head = " ".join("abcdefghi")
    docs = [(1, f"{head} {a}"), (2, f"{head} {b}"), (3, a), (4, b)]
    items = [(1, f"{head} {a}"), (2, b)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(decontaminate(df, bench)) == sorted(brute(docs, items), key=repr)
    block = decontaminate_module._Block(["1"], ["a b c d e f g h i j"], 10, 5)
    words = block.split(pa.array(["a b c d e f g h i k"]))
    words.hash = block.hash
    with pytest.raises(RuntimeError):
        block.hits(words)


def test_unordered_input_and_several_blocks(spark):
    rows = [(i, " ".join(str(x) for x in range(i, i + 14))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame(rows[::3], "item_id long, text string")
    assert got(decontaminate(df, bench, block_bytes=60)) == sorted(brute(rows, rows[::3]), key=repr)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert got(decontaminate(docs, none)) == [(1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert decontaminate(docs.limit(0), none).count() == 0
