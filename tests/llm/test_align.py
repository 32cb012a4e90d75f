import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import align, bpe
from quarry.llm.queries import op12_align

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def brute(docs, vocabulary):
    """Both libraries' tokens, compared place by place."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    piece = lambda i: bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    found, links = [], Counter()
    for doc, text in docs:
        data = (" " + (text or "")).encode()
        a = [(i, vocabulary.tokens[i]) for i in library.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, piece(i)) for i in model.encode(text)] if text else []
        if not text or b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
            found.append((doc, [], [], [], []))
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        shared = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, lo = [], 0
        for cut in shared:
            groups.append(tuple(",".join(str(i) for i, s, e in side if lo <= s and e <= cut) for side in spans))
            lo = cut
        pairs = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        links.update(pairs)
        found.append((doc, a, b, groups, pairs))
    best = {}
    for (_, j), n in links.items():
        best[j] = max(n, best.get(j, 0))
    out = []
    for doc, a, b, groups, pairs in found:
        text = ";".join("|".join(g) for g in groups)
        out.append((doc, len(a), len(b), len(groups), len(pairs), sum(links[p] == best[p[1]] for p in pairs), sum(links[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def test_whole_table_against_brute_force(spark, sf, vocabulary, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text is None or len(r.text) < 2500]
    whole = got(op12_align(spark, sf))
    assert len(whole) == spark.read.parquet(f"{sf}/documents.parquet").count()
    monkeypatch.setattr("quarry.llm.queries._table", lambda *_: spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert got(op12_align(spark, sf)) == brute(docs, vocabulary)
    same = {w[0]: (*w[:5], w[7]) for w in whole}
    assert all(same[b[0]] == (*b[:5], b[7]) for b in brute(docs, vocabulary))


def test_strange_texts(spark, vocabulary):
    """Nulls, empty and long texts, blanks, marks that read as blanks, special strings, repeated rows, clashing columns."""
    rng = random.Random(4)
    parts = ["a", " ", "  ", "\n", "\t", "é", "é", "日本", "😀", "▁", "<s>", "<0x41>", "<|endoftext|>", "\x00", "​", "ﬁ", "the", " of", ".", "　"]
    texts = [None, "", " ", "  ", "a ", "a  ", " a", "▁", "the the", "the the", "\n", "x" * 2000, "wörter " * 3000]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    docs = [(None if i % 50 == 7 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, chunk int, pairs string").repartition(3)
    model = open(MODEL, "rb").read()
    out = align.align(df, vocabulary, model, keep_groups=True)
    assert got(out) == brute(docs, vocabulary)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in out.where("n_a > 0").collect())
    assert align.align(df.limit(0), vocabulary, model).count() == 0


def test_stored_rows_are_small(spark, sf, vocabulary, monkeypatch):
    """However many texts a batch has, no stored row holds more than one of them, or one pair: a reader takes 4,096 rows at once."""
    held = []
    plain = align.written
    monkeypatch.setattr("quarry.llm.align.written", lambda df, tag: held.append(plain(df, tag)) or held[-1])
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").coalesce(1)
    assert align.align(docs, vocabulary, open(MODEL, "rb").read()).count() == docs.count()
    longest = docs.selectExpr("max(octet_length(text)) n").first().n
    for table in held:
        assert table.selectExpr("max(length(to_json(struct(*)))) n").first().n < 500 + 4 * longest


def test_ids_of_times(spark, vocabulary):
    """Times in a session's zone, and a batch without any token."""
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        df = spark.sql("SELECT timestamp_seconds(id) AS t, CASE id WHEN 1 THEN 'the cat' WHEN 2 THEN '' END AS text FROM range(5)").coalesce(1)
        for docs, n in ((df, 5), (df.where("coalesce(text, '') = ''"), 4)):
            out = align.align(docs, vocabulary, open(MODEL, "rb").read(), id_col="t").collect()
            assert sorted(r.t for r in out) == sorted(r.t for r in docs.collect()) and len(out) == n
            assert sum(r.n_a > 0 for r in out) == n - 4
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_whole_texts_and_stretches_agree(vocabulary):
    import numpy as np

    rng = random.Random(9)
    texts = ["".join(rng.choice(["word", " ", "  ", "\n", "é", "123", " the", "."]) for _ in range(60)) or "x" for _ in range(200)]
    raw = np.frombuffer("".join(" " + t for t in texts).encode(), np.uint8)
    rows = np.append(0, np.cumsum([len(t.encode()) + 1 for t in texts]))
    pieces = align.Pieces(open(MODEL, "rb").read(), most_known=100)
    assert pieces.parts
    ids, at = pieces.encode(raw, rows)
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == [pieces.model.encode(t) for t in texts]
    pieces.parts = False
    pieces._forget()
    whole, _ = pieces.encode(raw, rows)
    assert whole.tolist() == ids.tolist()
