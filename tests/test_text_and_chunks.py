import hashlib
import re
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text, vectors
from quarry.operators import chunking, search


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("said", "tokens"),
    [
        ("What is CVE-2024-3094?", ["cve-2024-3094"]), ("T1055.001 and T1055", ["t1055.001", "t1055"]), ("xt1055 T10555", ["xt1055", "t10555"]), ("CWE-426, TA0001; g0007", ["cwe-426", "ta0001", "g0007"]),
        ("which of the", []), ("", []), ("Straße naïve", ["stra", "e", "na", "ve"]),
    ],
)
def test_search_tokens(spark, said, tokens):
    assert one(spark, said, text.search_tokens) == tokens


def test_scalar_functions(spark):
    assert one(spark, "  a b\t\n", text.strip) == "a b"
    assert one(spark, "T1055 then t1001, T1055.001 T1055 T12345", text.technique_ids) == ["T1055", "T1055.001"]
    assert one(spark, "cve-2021-44228 CVE-2021-44228 CVE-1999-1", text.mentioned_cves) == ["CVE-2021-44228"]
    assert one(spark, "![a](http://x/y) [b](https://z?q=1) (http://no)", text.markdown_urls) == ["http://x/y", "https://z?q=1"]
    assert one(spark, "https://A.Example.org:80/x", text.host) == "a.example.org"
    assert one(spark, "doc#1:abc", text.point_id) == str(uuid.uuid5(uuid.NAMESPACE_URL, "doc#1:abc"))
    assert one(spark, " body ", lambda c: text.section("H", c)) == "## H\nbody\n\n" and one(spark, None, lambda c: text.section("H", c)) == ""
    assert one(spark, "T1127.003 JamPlus Loader with 2026 (technique)", lambda c: text.topic_terms(c, F.lit("T1127.003"))) == ["jamplus", "loader"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(vectors.norm(F.col("a")).alias("n"), vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.normalised(F.col("a")).alias("u"), vectors.normalised(F.col("b")).alias("z")).first()
    assert (r.n, r.c, r.u, r.z) == (5.0, 0.0, pytest.approx([0.6, 0.8]), [0.0, 0.0])
    h = spark.createDataFrame([(["a", "b", "a"],), ([],)], "t array<string>").select(vectors.hashed_embedding(F.col("t"), 16).alias("e")).collect()
    assert sum(x * x for x in h[0].e) == pytest.approx(1) and h[1].e == [0.0] * 16


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#", max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_recursive_pieces_lose_nothing_and_fit(said, size, overlap):
    pieces = chunking.recursive_pieces(said, size, overlap)
    assert all(0 < len(p) <= size for p in pieces)
    letters = lambda x: sorted(set(re.findall("[ab]+", x)))
    if overlap == 0 and max(map(len, said.split()), default=0) <= size:  # no word is cut
        assert set(letters(" ".join(pieces))) <= set(letters(said))
        assert sum(x.count("a") for x in pieces) == said.count("a")


def test_recursive_pieces_of_a_headed_text():
    said = "## Description\n" + "One sentence of some length. " * 60
    pieces = chunking.recursive_pieces(said, 512, 64)
    assert 3 < len(pieces) < 12 and all(len(p) <= 512 for p in pieces)
    assert pieces[0].startswith("## Description") and all(p.startswith(("One", "##")) for p in pieces)
    assert chunking.recursive_pieces("x" * 100, 40, 10) == ["x" * 40, "x" * 40, "x" * 40, "x" * 10]
    assert chunking.recursive_pieces("  short ", 40, 10) == ["short"] and chunking.recursive_pieces(" ", 4, 1) == []


def test_structural_pieces_keep_the_head():
    said = "# T1 name\n\n## Description\nshort\n\n## Detection\n" + "word " * 100
    pieces = chunking.structural_pieces(said, 120, 10)
    assert pieces[0] == "# T1 name\n\n## Description\nshort"
    assert all(p.startswith("# T1 name\n\n") for p in pieces) and len(pieces) > 3
    assert chunking.structural_pieces("no sections", 50, 5) == ["no sections"]


def test_chunks_are_addressed_by_content(spark):
    docs = spark.createDataFrame([("d", "a" * 600, "amber", 1), ("e", "   ", "red", 2)], "id string, text string, tlp string, trust_tier int")
    rows = chunking.chunk(docs, "fixed", 512, 64).orderBy("ordinal").collect()
    assert [(r.ordinal, len(r.text), r.tlp) for r in rows] == [(0, 512, "amber"), (1, 152, "amber")]
    assert rows[0].chunk_id == "d#0:" + hashlib.sha1(b"a" * 512).hexdigest()[:12]
    with pytest.raises(KeyError):
        chunking.chunk(docs, "none")


def test_passages():
    assert chunking.passages("aa bb  cc dddddd e", 5) == ["aa bb", "cc", "dddddd", "e"]
    with pytest.raises(ValueError):
        chunking.passages("a", 0)


def test_bm25_weight(spark):
    docs = spark.createDataFrame([(1, "alpha alpha beta gamma"), (2, "the of"), (3, None)], "chunk_id long, text string")
    got = {(r.chunk_id, r.term): r.weight for r in search.postings(docs, avg_len=4).collect()}
    assert got[1, "alpha"] == pytest.approx(2 * 2.2 / 3.2) and got[1, "beta"] == pytest.approx(1.0) and len(got) == 3


def test_empty_question_has_no_ranking_and_ties_go_by_id(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in (5, 3, 9)], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "same words"), (2, "which of the")], "query_id long, question string")
    rows = search.lexical_topk(asked, search.postings(docs), 3, 2).collect()
    assert [(r.query_id, r.rank, r.chunk_id) for r in sorted(rows, key=lambda r: r.rank)] == [(1, 1, 3), (1, 2, 5)]


def test_fusion_is_stable(spark):
    a = [(1, 1, "a"), (1, 2, "b"), (1, 3, "c")]
    b = [(1, 1, "b"), (1, 2, "a"), (1, 3, "d")]
    frame = lambda rows: spark.createDataFrame(rows, "query_id int, rank int, chunk_id string")
    want = ["a", "b", "c", "d"]
    for x, y in ((a, b), (b, a), (a[::-1], b[::-1])):
        assert [r.chunk_id for r in search.fuse([frame(x), frame(y)], 4).orderBy("rank").collect()] == want


def test_batches_of_passages(spark):
    """The array form equals the plain one, text by text."""
    import random

    import pyarrow as pa

    rng = random.Random(5)
    words = ["a", "bb", "ééé", "日本語テキスト", "x" * 30, "😀😀"]
    texts = ["", "one", *(" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(200)), "", "z" * 100]
    for size in (1, 7, 25, 600):
        assert chunking.pack(pa.array(texts), size).to_pylist() == [chunking.passages(t, size) for t in texts]
        assert chunking.pack(pa.array(texts).slice(5, 40), size).to_pylist() == [chunking.passages(t, size) for t in texts[5:45]]
    assert chunking.pack(pa.array([], pa.string()), 5).to_pylist() == []
    odd = [(1, " a\u3000b\x1cc\t\r\nd\x85 e\xa0"), (2, None), (3, "\u2003 "), (4, "long " * 20_000)]
    df = spark.createDataFrame(odd, "doc_id int, text string")
    got = sorted(map(tuple, chunking.passage_rows(df, 4).collect()))
    assert got == sorted((d, i, p) for d, t in odd for i, p in enumerate(chunking.passages(t or "", 4)))
    with pytest.raises(ValueError):
        chunking.passage_rows(df, 0)
