import math
import random
import re
from collections import Counter

import pytest

from quarry.functions import text
from quarry.operators import words

STOP = set(text.STOP_WORDS)


def tokens(said):
    return [t for t in re.findall(rf"(?:(?<![a-z0-9])(?:{text.IDENTIFIER})(?![a-z0-9])|[a-z0-9]+)", said.lower()) if t not in STOP]


def brute(queries, chunks, k, readable=None, k1=1.2, b=0.75, avg=None):
    held = {c: Counter(tokens(t or "")) for c, t in chunks.items()}
    size = {c: sum(x.values()) for c, x in held.items()}
    mean = avg or (sum(size.values()) / len(size) if any(size.values()) else 1.0)
    df = Counter(t for x in held.values() for t in x)
    out = []
    for q, said in queries:
        scores = Counter()
        for t in dict.fromkeys(tokens(said or "")):
            for c, x in held.items():
                if x[t] and (readable is None or c in readable):
                    scores[c] += math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5)) * x[t] * (k1 + 1) / (x[t] + k1 * (1 - b + b * size[c] / mean))
        best = sorted((-round(s, 9), c) for c, s in scores.items())[:k]
        out += [(q, i + 1, c) for i, (_, c) in enumerate(best)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r["rank"], r.chunk_id) for r in df.collect())


def said(rng, n):
    names = ["alpha", "beta", "t1055.001", "t1055", "cve-2024-1234", "the", "x1", *(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(n))]
    return " ".join(rng.choice(names) for _ in range(n))


@pytest.fixture
def corpus():
    rng = random.Random(8)
    chunks = {i: said(rng, rng.randint(0, 60)) for i in range(300)}
    chunks |= {300: None, 301: "", 302: chunks[5], 303: chunks[5], 304: "the and of"}
    queries = [(i, said(rng, rng.randint(1, 12))) for i in range(25)] + [(90, None), (91, "the of"), (92, "unknownword"), (93, "T1055.001 and CVE-2024-1234")]
    return chunks, queries


def frames(spark, chunks, queries):
    rows = spark.createDataFrame(list(chunks.items()), "chunk_id long, text string").repartition(3)
    return rows, spark.createDataFrame(queries, "query_id long, question string")


@pytest.mark.parametrize("small", [False, True])
def test_search_and_changes(spark, tmp_path, corpus, small, monkeypatch):
    """Equal to scoring every chunk, before and after upserts, deletes and compaction; blocks of any size."""
    if small:
        monkeypatch.setattr(words, "_BLOCK", 3)
        monkeypatch.setattr(words, "_SHARD", 40)
    chunks, queries = corpus
    rows, asked = frames(spark, chunks, queries)
    first = words.create(spark, str(tmp_path / "w"), rows)
    assert got(first.topk(asked, 4)) == brute(queries, chunks, 4)
    allowed = spark.range(0, 400, 3).withColumnRenamed("id", "chunk_id")
    assert got(first.topk(asked, 6, readable=allowed)) == brute(queries, chunks, 6, set(range(0, 400, 3)))

    changed = {7: "alpha alpha t1055", 500: "beta new words", 9: None}
    more = spark.createDataFrame([(7, "an older row of one id"), *changed.items()], "chunk_id long, text string").coalesce(1)
    second = first.upsert(more)
    after = chunks | changed
    assert got(second.topk(asked, 5)) == brute(queries, after, 5)
    third = second.delete(spark.createDataFrame([(i,) for i in (1, 2, 7, 302, 9999)], "chunk_id long"))
    left = {c: t for c, t in after.items() if c not in (1, 2, 7, 302)}
    assert got(third.topk(asked, 5)) == brute(queries, left, 5)
    again = third.upsert(spark.createDataFrame([(7, "back again beta")], "chunk_id long, text string"))
    left[7] = "back again beta"
    assert got(words.open_index(spark, str(tmp_path / "w")).topk(asked, 5)) == brute(queries, left, 5)
    # who opened an older version still reads it
    assert got(first.topk(asked, 4)) == brute(queries, chunks, 4)
    packed = again.compact(str(tmp_path / "packed"))
    assert got(packed.topk(asked, 5)) == brute(queries, left, 5)
    assert packed.dead.count() == 0 and packed.forward.count() == len(left)
    assert {r.term: r.df for r in packed.terms.collect()} == {r.term: r.df for r in again.terms.collect()}


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    """A rare term's few chunks decide: the blocks of a frequent one are not opened for candidates."""
    monkeypatch.setattr(words, "_BLOCK", 10)
    chunks = {i: "common " * (1 + i % 3) + " ".join(f"f{i}x{j}" for j in range(5)) for i in range(400)} | {1000 + i: "rare common" for i in range(5)}
    rows, asked = frames(spark, chunks, [(1, "rare common")])
    index = words.create(spark, str(tmp_path / "w"), rows)
    opened, whole = [], words.WordIndex._hits
    monkeypatch.setattr(words.WordIndex, "_hits", lambda self, blocks, readable: (opened.append(blocks.count()), whole(self, blocks, readable))[1])
    assert got(index.topk(asked, 3)) == brute([(1, "rare common")], chunks, 3)
    assert opened[1] < index.blocks.where("term in ('rare', 'common')").count() / 4


def test_fixed_mean_titles_and_text_ids(spark, tmp_path):
    rows = spark.createDataFrame([("a", "One", "t1055 x"), ("b", None, "x x x"), ("c", "x", None), (None, "x", "x")], "chunk_id string, title string, text string")
    asked = spark.createDataFrame([("q", "x t1055 one")], "query_id string, question string")
    index = words.create(spark, str(tmp_path / "w"), rows, avg_len=2.5, k1=0.9, b=0.4, with_title=True)
    chunks = {"a": "One\nt1055 x", "b": "x x x", "c": "x"}
    assert got(index.topk(asked, 5)) == brute([("q", "x t1055 one")], chunks, 5, k1=0.9, b=0.4, avg=2.5)
    none = words.create(spark, str(tmp_path / "none"), rows.limit(0))
    assert got(none.topk(asked, 5)) == []
    assert got(none.upsert(rows.where("chunk_id = 'a'")).topk(asked, 5)) == [("q", 1, "a")]
    assert got(index.topk(asked.limit(0), 5)) == []


def test_two_changes_to_one_version_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a1"), (2, "b1")], "chunk_id int, text string")
    index = words.create(spark, str(tmp_path / "w"), rows)
    index.delete(rows.where("chunk_id = 1"))
    with pytest.raises(FileExistsError):
        index.delete(rows.where("chunk_id = 2"))
    asked = spark.createDataFrame([(1, "a1 b1")], "query_id int, question string")
    assert got(words.open_index(spark, str(tmp_path / "w")).topk(asked, 5)) == [(1, 1, 2)]
    assert got(words.open_index(spark, str(tmp_path / "w"), 0).topk(asked, 5)) == [(1, 1, 1), (1, 2, 2)]
