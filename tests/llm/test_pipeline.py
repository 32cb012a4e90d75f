"""Each stage against plain Python on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline as pipeline
from quarry.llm import classify, stages
from quarry.llm._store import written
from test_decontaminate import brute as brute_decontaminate
from test_jaccard import brute as brute_jaccard
from test_native import naive_targets


def test_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, seen = docs, [name for name, _ in pipeline.STAGES]
    assert len(seen) == 5
    for name, stage in pipeline.STAGES[:-1]:
        after = written(stage(spark, before, sf), "test")
        assert after.schema == docs.schema
        rows, kept = {r.doc_id: r for r in before.collect()}, Counter(r for r in after.collect())
        assert set(kept) <= set(before.collect())
        ids = {r.doc_id for r in kept}
        if name == "quality classifier":
            scores = classify.score(before, classify.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
            assert ids == {r.doc_id for r in scores if r.predicted}
            good = [d for d in rows if labels.get(d) == 1]
            assert len([d for d in good if d in ids]) >= 0.97 * len(good)
            assert len([d for d in rows if labels.get(d) == 0 and d not in ids]) > 0
        elif name == "n-gram Jaccard join":
            assert sorted(ids) == sorted(d for d, _, c in brute_jaccard([(d, r.text) for d, r in rows.items()], 5, 80) if d == c)
        elif name == "benchmark decontamination":
            assert ids == {x[0] for x in brute_decontaminate([(d, r.text) for d, r in rows.items()], benchmark) if not x[5]}
            assert len(ids) < len(rows)
        else:
            size = {d: len(r.text.split()) for d, r in rows.items()}
            own, got = defaultdict(int), defaultdict(int)
            for d, r in rows.items():
                own[r.source] += size[d]
            for r, n in kept.items():
                got[r.source] += n * size[r.doc_id]
                assert n <= 2
            # a source of one shard misses its target by half a document and half a block at most
            want, largest = naive_targets(own), {s: max(size[d] for d, r in rows.items() if r.source == s) for s in own}
            assert all(abs(got[s] - want[s]) <= largest[s] / 2 + 64 for s in own)
        before = after
    last = pipeline.STAGES[-1][1](spark, before, sf).collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in before.collect())


def test_run_is_repeatable(spark, sf):
    rows = Counter(pipeline.run(spark, sf).select("doc_id", "size", "shard", "grown_shard").collect())
    assert rows and rows == Counter(pipeline.run(spark, sf).select("doc_id", "size", "shard", "grown_shard").collect())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_clashing_and_map_columns(spark):
    """Columns named as the stages' own, and ones that cannot be hashed as they stand, come through."""
    names = ["__row", "__nth", "__copies", "__said", "__s", "__h", "__key", "size", "target", "taken", "digest", "component_id", "cluster", "shard"]
    rows = [(i, f"{'ab'[i % 2]} one two three four five six {i // 4}", "en", "s", i, {"k": i}, [{"x": i}], *[str(i)] * len(names)) for i in range(8)]
    schema = SCHEMA + ", m map<string,int>, a array<map<string,int>>, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    key = lambda r: r.doc_id
    bench = spark.createDataFrame([(1, "nothing of it")], "item_id long, text string")
    for f in (stages.keep_one_of_each, stages.take_mix, lambda d: stages.drop_contaminated(d, bench), lambda d: stages.drop_low_quality(d, classify.train(["a one"], [1]))):
        out = f(docs)
        assert out.schema == docs.schema
        assert all(tuple(r) == rows[r.doc_id] for r in sorted(out.collect(), key=key))
    assert pipeline.sharding(spark, docs, "").count() == 8


def test_edges(spark, sf):
    a, b = "one two three four five six seven eight nine ten", "x y z " * 30
    data = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, a, "en", "s", 1), (None, b, "en", None, None), (None, None, None, None, 0), (4, "", None, "t", 0)]
    docs = spark.createDataFrame(data, SCHEMA)
    one = stages.keep_one_of_each(docs).collect()
    assert Counter(tuple(r) for r in one) == Counter([data[0], data[3], data[4], data[5]])
    mixed = stages.take_mix(docs, block_words=2)
    assert {tuple(r) for r in mixed.collect()} <= {data[0], data[1], data[3]}
    assert max(Counter(tuple(r) for r in mixed.collect()).values()) <= 4
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    assert Counter(tuple(r) for r in stages.drop_contaminated(docs, bench).collect()) == Counter(data[3:])
    model = classify.train(["good words here", "bad bad bad"], [1, 0])
    assert stages.drop_low_quality(docs, model).schema == docs.schema
    empty = docs.limit(0)
    for f in (stages.keep_one_of_each, stages.take_mix, lambda d: stages.drop_contaminated(d, bench), lambda d: stages.drop_low_quality(d, model)):
        assert f(empty).count() == 0
