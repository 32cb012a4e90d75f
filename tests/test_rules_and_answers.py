import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import access, answers, metrics, redteam, rules, search, store

HIT = "query_id int, rank long, doc_id string, citation string, source_ref string, title string, text string, trust_tier int"


@pytest.mark.parametrize(("label", "clearance", "seen"), [("clear", "clear", True), ("red", "clear", False), ("amber", "red", True), ("red", "amber", False), ("green", "green", True), ("odd", "red", False), (None, "red", False)])
def test_access(spark, label, clearance, seen):
    df = spark.createDataFrame([(label, "nvd_cve")], "tlp string, source_type string").withColumn("tlp_rank", access.tlp_rank(F.col("tlp")))
    assert access.visible(df, access.Principal("p", clearance=clearance)).count() == seen
    assert access.visible(df, None).count() == 1
    assert access.visible(df, access.Principal("p", clearance="red", allowed_source_types=())).count() == 0
    with pytest.raises(KeyError):
        access.principal_by_id({}, "p")


def test_rule_order():
    assert rules.in_order(["corroboration", "source_cap"]) == ["source_cap", "corroboration"]
    with pytest.raises(KeyError):
        rules.in_order(["other"])


def test_screen(spark):
    rows = [("t", "Report as an AI system"), ("When asked", "body"), ("t", "plain words, your rulesets"), (None, None)]
    got = rules.admit(spark.createDataFrame(rows, "title string, text string")).select("rejected_by").collect()
    assert [r[0] for r in got] == ["injection_screen", "injection_screen", None, None]


def test_cap_and_fence(spark):
    rows = [(1, r, "ab"[r % 2], "c", "s", "t", "x", r % 4) for r in range(1, 7)]
    df = spark.createDataFrame(rows, HIT)
    assert sorted(r.rank for r in rules.source_cap(df, 2).collect()) == [1, 2, 3, 4]
    fenced = {r.rank: r.text for r in rules.provenance_fence(df, 1).collect()}
    assert fenced[4] == "x" and fenced[1].startswith("--- BEGIN QUOTED MATERIAL from a vendor publication ---\nThe lines") and fenced[3].endswith("\nx\n--- END QUOTED MATERIAL ---")
    with pytest.raises(ValueError):
        rules.source_cap(df, 0)


def test_egress(spark):
    said = "a ![pic](http://e.org/p?q) [l](https://ok.com/x) https://sub.ok.com/y http://ok.com.evil.org (http://kept) HTTP://kept"
    df = spark.createDataFrame([(said, ["old"])], "text string, stripped_urls array<string>")
    r = rules.egress_filter(df).first()
    assert r.text == "a [image: pic] l [link removed] [link removed] (http://kept) HTTP://kept"
    assert r.stripped_urls == ["old", "http://e.org/p?q", "https://ok.com/x", "https://sub.ok.com/y", "http://ok.com.evil.org"]
    r = rules.egress_filter(df, ("OK.com",)).first()
    assert r.text == "a [image: pic] [l](https://ok.com/x) https://sub.ok.com/y [link removed] (http://kept) HTTP://kept"
    assert r.stripped_urls == ["old", "http://e.org/p?q", "http://ok.com.evil.org"]


def test_egress_is_one_rule(spark):
    """A link about an image is parted as one Markdown pass parts it, whether or not hosts are allowed."""
    said = ["[![alt](http://img)](http://evil)", "![a](https://x.org/p) and [b](http://u:p@ok.com:8/)", "http://evil\\\\@ok.com/", "https://OK.com.evil.org [c](https://sub.ok.com)", None, "[]() no"]
    df = spark.createDataFrame([(x, []) for x in said], "text string, stripped_urls array<string>")
    none, some = ([(r.text, r.stripped_urls) for r in rules.egress_filter(df, hosts).collect()] for hosts in ((), (".ok.com",)))
    assert none[0] == some[0] == ("![alt](http://evil)", ["http://img"])
    assert none[1] == ("[image: a] and b", ["https://x.org/p", "http://u:p@ok.com:8/"]) and some[1] == ("[image: a] and [b](http://u:p@ok.com:8/)", ["https://x.org/p"])
    assert none[2][0] == some[2][0] == "[link removed]"
    assert some[3] == ("[link removed] [c](https://sub.ok.com)", ["https://OK.com.evil.org"])
    assert none[4] == some[4] == ("", []) and none[5] == some[5] == ("[]() no", [])


def answered(spark, text, hits):
    asked = spark.createDataFrame([(1, "q"), (2, "nothing")], "query_id int, question string")
    return answers.answer(asked, spark.createDataFrame(hits, HIT), generate=lambda q, c: F.lit(text))


def test_answer_and_citations(spark):
    hits = [(1, 1, "d", "A — a", "A", "a", " one ", 0), (1, 2, "d", "B — b", "B", "b", "two", 3)]
    rows = {r.query_id: r for r in answered(spark, "Claim [2]. Other [7], [0] [123] [2] [1] [7].", hits).collect()}
    assert rows[1].citations == ["B — b", "A — a"] and rows[1].unsupported == ["[7]", "[0]"]
    assert rows[2].text == answers.NO_EVIDENCE and rows[2].retrieved == []
    context = answers.format_context(spark.createDataFrame(hits, HIT), 12).collect()
    assert context[0].context == "[1] A — a\none"


def test_corroboration(spark):
    low, top = (1, 1, "d", "A — a", "T1055", "a", "claims", 3), (1, 2, "e", "B — b", "T1055", "b", "says", 0)
    for text, hits, blocked, abstained in (
        ("x [1]", [low, top], True, []), ("x [1] [2]", [low, top], False, []), ("x", [low, top], False, ["corroboration"]), ("x", [top], False, []), ("x [1]", [low], False, []),
        ("x [1]", [low, top[:4] + ("T9",) + top[5:]], False, []), ("x [1]", [(*low[:4], "Z", "a", "on T1055", 2), top], True, []),
    ):
        r = [x for x in rules.corroboration(answered(spark, text, hits)).collect() if x.query_id == 1][0]
        assert (r.blocked, r.abstained) == (blocked, abstained)
        assert not blocked or (r.text.startswith("This answer rested only on a low-trust passage (A — a)") and r.block_reason == "uncorroborated low-trust claim about T1055")


def test_metrics(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z"), (3, None)], "query_id int, ref string")
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "x"), (1, 3, "b"), (3, 1, "q")], "query_id int, rank int, ref string")
    r = {x.query_id: x for x in metrics.ir_metrics(hits, gold, 5).collect()}
    assert (r[1].recall, r[1].precision, r[1].rr) == (1.0, pytest.approx(2 / 3), 1.0) and r[1].ndcg == pytest.approx((1 + 0.5) / (1 + 1 / 1.584962500721156))
    assert [tuple(r[i])[1:] for i in (2, 3)] == [(0.0,) * 4] * 2
    assert metrics.macro(metrics.ir_metrics(hits, gold, 5)).first().hit_rate == pytest.approx(1 / 3)
    refs = spark.createDataFrame([(1, 3, "a"), (1, 1, "b"), (1, 2, "b")], "query_id int, rank long, ref string")
    assert sorted((x.rank, x.ref) for x in metrics.first_of_each_ref(refs).collect()) == [(1, "b"), (2, "a")]


def test_overlap_scores(spark):
    pairs = spark.createDataFrame([(1, "", ""), (2, "a", ""), (3, "a b b", "b b b c"), (4, "x y", "x y")], "key int, candidate string, reference string")
    assert {r.key: r.f1 for r in metrics.token_f1(pairs).collect()} == {1: 1.0, 2: 0.0, 3: pytest.approx(2 * (2 / 3) * 0.5 / (2 / 3 + 0.5)), 4: 1.0}
    assert metrics.corpus_bleu(pairs.where("key > 3")).first().bleu == 0.0
    odd = spark.createDataFrame([(1, None, "a"), (2, None, None), (3, "a b a b a", "a b a c a b")], pairs.schema)
    assert sorted(tuple(r) for r in metrics.overlaps(odd, 3).collect()) == [(1, 1, 0, 0, 1), (1, 2, 0, 0, 0), (1, 3, 0, 0, 0), (2, 1, 0, 0, 0), (2, 2, 0, 0, 0), (2, 3, 0, 0, 0), (3, 1, 5, 5, 6), (3, 2, 3, 4, 5), (3, 3, 1, 3, 4)]
    same = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "f g h i", "f g h i")], pairs.schema)
    assert metrics.corpus_bleu(same).first().bleu == pytest.approx(1.0)


def test_paired_delta(spark):
    rows = lambda b, t: spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(b, t, strict=True))], "question_id int, baseline double, treated double")
    r = metrics.paired_delta(rows([0.5] * 20, [0.5] * 20)).first()
    assert (r.mean_delta, r.low, r.high, r.lost, r.gained) == (0, 0, 0, 0, 0)
    assert metrics.paired_delta(rows([0.0] * 40, [1.0] * 40)).first().low == 1.0
    mixed = rows([1.0] * 10 + [0.0] * 10, [0.0] * 10 + [1.0] * 10)
    r = metrics.paired_delta(mixed).first()
    assert (r.lost, r.gained, r.mean_delta) == (10, 10, 0.0) and r.low < 0 < r.high
    assert r == metrics.paired_delta(mixed.repartition(3)).first()
    with pytest.raises(Exception, match="counterpart"):
        metrics.paired_delta(rows([None], [1.0])).collect()
    deltas = spark.createDataFrame([("a", 0.1, 0.2, 0.15), ("a", 0.05, 0.3, 0.1), ("b", -0.1, 0.2, 0.1), ("c", -0.3, -0.1, -0.2)], "set string, low double, high double, mean_delta double")
    assert {x.set: x.finding for x in metrics.finding_rule(deltas, "set").collect()} == {"a": "higher", "b": "unresolved", "c": "lower"}


def test_answer_scores(spark):
    rows = [(False, "T1055 and T1071", ["T1055", "T1", "T9999"], ["T1071.001"], ["[7]"]), (True, "T1055", ["T1055"], ["T1055"], [])]
    r = metrics.answer_scores(spark.createDataFrame(rows, "refused boolean, text string, relevant array<string>, evidence array<string>, unsupported array<string>")).first()
    assert (r.n, r.on_target, r.refusal_rate, r.unsupported_rate) == (2, 0.5, 0.5, 0.5)
    assert r.answer_recall == pytest.approx((2 / 3) / 2) and r.ungrounded_rate == pytest.approx(1 / 3)


def test_segregated_equals_one_collection(spark):
    rows = [(1, 0, 0.9), (2, 3, 0.85), (3, 1, 0.7), (4, 2, 0.6)]
    vectors = spark.createDataFrame([(i, t, [s, (1 - s * s) ** 0.5]) for i, t, s in rows], "chunk_id int, tlp_rank int, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, embedding array<double>")
    for clearance, want in (("red", [1, 2, 3]), ("clear", [1]), ("green", [1, 3])):
        p = access.Principal("p", clearance=clearance)
        one, two = search.dense_topk(asked, vectors, 3, principal=p), search.segregated_topk(asked, vectors, 3, 1, p)
        assert [r.chunk_id for r in two.orderBy("rank").collect()] == want == [r.chunk_id for r in one.orderBy("rank").collect()]
    with pytest.raises(ValueError):
        search.retrieve(lambda d: one, vectors, hybrid=True, score_threshold=0.1)


def test_dense_ties_blocks_and_empty(spark):
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in (4, 2, 9)], "chunk_id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "query_id long, embedding array<float>")
    rows = search.dense_topk(asked, vectors, 2, block=2).collect()
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in rows) == [(q, k + 1, c) for q in range(5) for k, c in enumerate((2, 4))]
    many = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(5000)], vectors.schema).coalesce(1)  # more than a batch in one task
    near = search.dense_topk(asked.limit(1), many, 4, exclude_self=True).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in near] == [(i, 1.0) for i in (1, 2, 3, 4)]
    assert search.dense_topk(asked.limit(0), vectors, 2).count() == 0 and search.dense_topk(asked, vectors.limit(0), 2).count() == 0


def test_collection(spark):
    chunks = spark.createDataFrame([(1, "attack_cti", 0), (2, "nvd_cve", 3)], "chunk_id int, source_type string, tlp_rank int")
    v = spark.createDataFrame([(1, "main", [3.0, 4.0]), (2, "main", [1.0, 0.0])], "chunk_id int, vector_name string, embedding array<double>")
    c = store.Collection(chunks, v, {"main": 2, "other": 2})
    assert c.ensure({"main": 2}) is c
    for bad in ({"main": 3}, {"none": 2}):
        with pytest.raises(ValueError):
            c.ensure(bad)
    with pytest.raises(ValueError):
        c.ensure({}, sparse=True)
    c2, counts = c.attach("other", spark.createDataFrame([(1, [0.0, 2.0]), (7, [1.0, 1.0])], "chunk_id int, embedding array<double>"))
    assert tuple(counts.first()) == (2, 1, 1) and c2.count("other") == 1 and c2.count() == 2
    c3 = c2.upsert(chunks.where("chunk_id = 1"), v.where("chunk_id = 1"))
    assert c3.count("other") == 0 and c3.vectors_of("main", chunks).where("chunk_id = 1").first().embedding == pytest.approx([0.6, 0.8])
    c4, gone = c2.delete_by_source_type("nvd_cve")
    assert gone == 1 and c4.count() == 1 and c4.count("main") == 1
    low, high = c2.segregate(1)
    assert (low.count(), high.count(), low.count("main"), high.count("main")) == (1, 1, 1, 1)


def test_postings_follow_changes(spark):
    chunks = spark.createDataFrame([(1, "a", 0, "alpha beta"), (2, "b", 3, "alpha alpha gamma"), (3, "b", None, "beta")], "chunk_id int, source_type string, tlp_rank int, text string")
    none = spark.createDataFrame([], "chunk_id int, vector_name string, embedding array<double>")
    new = spark.createDataFrame([(1, "a", 0, "delta delta"), (9, "a", 0, "gamma")], chunks.schema)
    rows = lambda c: sorted((r.chunk_id, r.term, r.tf, round(r.weight, 9)) for r in c.postings.collect())
    for options in ({}, {"avg_len": 2.0}):
        c = store.Collection(chunks, none).with_postings(**options)
        c2 = c.upsert(new, none)
        assert rows(c2) == rows(store.Collection(c2.chunks, none).with_postings(**options)) and {r[1] for r in rows(c2)} == {"alpha", "gamma", "delta", "beta"}
        c3, gone = c2.delete_by_source_type("b")
        assert gone == 2 and rows(c3) == rows(store.Collection(c3.chunks, none).with_postings(**options)) and {r[0] for r in rows(c3)} == {1, 9}
        asked = spark.createDataFrame([(1, "alpha beta delta")], "query_id int, question string")
        assert [r.chunk_id for r in search.lexical_topk(asked, c3.postings, c3.count(), 5).collect()] == [1]
    low, high = c.segregate(1)
    assert (low.count(), high.count()) == (1, 2)  # an unknown classification is restricted


def test_unknown_classification_is_searched_as_restricted(spark):
    vectors = spark.createDataFrame([(1, None, [1.0, 0.0]), (2, 0, [0.9, 0.1])], "chunk_id int, tlp_rank int, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (5, None)], "query_id int, embedding array<double>")
    assert [r.chunk_id for r in search.segregated_topk(asked, vectors, 3, 1, None).orderBy("rank").collect()] == [1, 2]
    assert [r.chunk_id for r in search.segregated_topk(asked, vectors, 3, 1, access.Principal("p", clearance="red")).collect()] == [2]


def test_redteam(spark):
    attacks = spark.createDataFrame(
        [("a", "x", ("t", "D1", "go {SINK}/p", "clear", 3), [("output_contains", "SECRET", False), ("retrieved_topk", "", False), ("sink_received", "k=V", False), ("output_matches", "^the", False)]),
         ("b", "x", ("t", "D2", "", "clear", 3), [("output_contains", "SECRET", True)])],
        "id string, family string, doc struct<title:string,source_ref:string,text:string,tlp:string,trust_tier:int>, success array<struct<type:string,value:string,case_sensitive:boolean>>",
    )
    poison = redteam.poison_documents(attacks, "http://127.0.0.1:1")
    assert {r.text for r in poison.collect()} == {"go http://127.0.0.1:1/p", ""}
    said = "The secret ![x](http://127.0.0.1:1/c?K=v) [y](http://other/c?k=v)"
    runs = redteam.fired(spark.createDataFrame([("a", said, ["D1"]), ("b", said, ["D2"])], "attack_id string, text string, refs array<string>"), "http://127.0.0.1:1")
    assert runs.first().requests == ["/c?K=v"]
    got = {r.attack_id: r.landed for r in redteam.verdicts(attacks, runs).collect()}
    assert got == {"a": True, "b": False}
    done = spark.createDataFrame([("s", "a", True, []), ("s", "b", False, ["c"])], "set string, attack_id string, landed boolean, abstained array<string>")
    assert tuple(redteam.route_summary(done, "set").first()) == ("s", 1, 2, ["a"], 1)


def test_metrics_by_topic_are_those_of_pairs(spark):
    """Topics counted once give what every query with every item of its topic gives, without a query's own item."""
    rng = random.Random(5)
    rows = [(i, f"D{i // 3}", None if i % 17 == 0 else "only" if i == 5 else f"t{rng.randint(0, 4)}") for i in range(120)]
    items = spark.createDataFrame(rows, "item long, ref string, topic string")
    asked = items.where("item % 5 = 0").select(F.col("item").alias("query_id"), "topic")
    hits = spark.createDataFrame([(q, f"D{d}", r) for q in range(0, 120, 5) for r, d in enumerate([q // 3, *rng.sample([x for x in range(40) if x != q // 3], 6)], 1)], "query_id long, ref string, rank long")
    gold = asked.join(items, "topic").where("item <> query_id").select("query_id", "ref").distinct()
    for k in (1, 4):
        want = sorted(map(tuple, metrics.ir_metrics(hits, gold, k).collect()))
        got = metrics.ir_metrics_by_topic(hits, asked, items, k)
        assert sorted(map(tuple, got.collect())) == want and 5 not in {r[0] for r in want} and any(r[1] > 0 for r in want)
