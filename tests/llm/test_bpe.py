import hashlib
import json
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe
from quarry.llm.queries import op13_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(PATH)


def digests(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_whole_table_against_the_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(digests(library, *r) for r in docs)
    assert sorted(tuple(r) for r in op13_bpe(spark, sf).collect()) == want
    assert all(hashlib.sha256((r.text or "").encode()).hexdigest() == w[3] for r, w in zip(sorted(docs), want, strict=True))


PARTS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "'S", " ", "  ", "\n", "\t", " \n", "a", "s", "re", "1", "23", "!", "?!", "é", "日本語", "😀", "\u3000", "\xa0", "\u200b",
         "<|endoftext|>", "<|endo", "ⅷ", "x'ss", "\r\n", "\x00", "\x1c", "\x85", "aaa", "aaaaaaa", "_"]


@pytest.mark.parametrize("window", [1 << 21, 64])
def test_strange_texts(spark, library, vocabulary, window, monkeypatch):
    rng = random.Random(window)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 300))) for _ in range(400)]
    texts += ["".join(rng.choice("abcdefghijklmnop") for _ in range(n)) for n in (255, 256, 257, 300, 5000)] + ["a" * 1000, "ab" * 2000, "日" * 3000, "<|endoftext|>" * 3]
    monkeypatch.setattr(bpe, "_WINDOW", window)
    encoder = bpe.Encoder(vocabulary, most_words=50)
    import pyarrow as pa

    got = [ids[i:j].tolist() for _, _, ids, at in encoder.rows(pa.array(texts)) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_character_class(library, vocabulary):
    import pyarrow as pa

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1 {chr(c)}! {chr(c)}{chr(c)}" for c in points[i : i + 400]) for i in range(0, len(points), 400)]
    got = [ids[i:j].tolist() for _, _, ids, at in bpe.Encoder(vocabulary).rows(pa.array(texts)) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_special_strings_as_plain_text(spark, vocabulary):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    docs = spark.createDataFrame([(1, "a<|endoftext|> b")], "doc_id int, text string")
    assert bpe.encode(docs, vocabulary, specials=False).first()["ids"] == library.encode("a<|endoftext|> b").ids


def test_edges(spark, library, vocabulary):
    """Nulls, empty and very long texts, repeated rows, clashing columns and an empty table."""
    long = " ".join(f"word{i}" for i in range(400_000)) + "x" * 50_000
    rows = [(None, "a b"), (1, None), (1, ""), (2, "same"), (2, "same"), (3, long)]
    docs = spark.createDataFrame([(*r, "q", 7) for r in rows], "doc_id long, text string, ids string, n_tokens int").repartition(2)
    every = tuple(bpe._KINDS)
    got = bpe.encode(docs, vocabulary, columns=every)
    assert got.columns == ["doc_id", *every]
    assert sorted(map(repr, (tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))) == sorted(repr(digests(library, *r)) for r in rows)
    again = bpe.decode(got, vocabulary)
    assert sorted(map(repr, map(tuple, again.collect()))) == sorted(repr((i, t or "")) for i, t in rows)
    assert bpe.encode(docs.limit(0), vocabulary).count() == 0
    blank = bpe.decode(spark.createDataFrame([(1, None), (2, [None, 64]), (3, [])], "doc_id int, ids array<int>"), vocabulary)
    assert sorted(map(tuple, blank.collect())) == [(1, ""), (2, "a"), (3, "")]
    with pytest.raises(ValueError):
        bpe.encode(docs, vocabulary, columns=("nothing",))


def test_files_that_are_refused():
    content = json.load(open(PATH))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"model": content["model"] | {"merges": content["model"]["merges"][::-1]}}):
        with pytest.raises(ValueError):
            bpe.Vocabulary(json.dumps(content | change).encode())
