"""A stored word index: postings in impact-ordered blocks, changed by segments, searched with max-score pruning."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry import versions
from quarry.functions import text
from quarry.scratch import written
from quarry.shipping import ship

_BLOCK = 128
_SHARD = 1 << 17
_SLACK = 1e-6
_FORWARD = "terms array<string>, tfs array<int>, len int"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, tokens) as (id, distinct terms, how often each occurs, number of tokens)."""
    for batch in batches:
        tokens = batch.column(1)
        size = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = tokens.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        wide = max(len(coded.dictionary), 1)
        pair, count = np.unique(np.repeat(np.arange(len(size)), size) * wide + code, return_counts=True)
        offsets = pa.array(np.searchsorted(pair, np.arange(len(size) + 1) * wide), pa.int32())
        terms = pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(pair % wide)))
        tfs = pa.ListArray.from_arrays(offsets, pa.array(count, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), terms, tfs, pa.array(size, pa.int32())], names=["chunk_id", "terms", "tfs", "len"])


def _packed(size: int):
    """Rows (term, shard, id, tf, len) in order as blocks of size rows of one term and shard; a block that a batch may cut waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        done, last = 0, None  # blocks that the held rows' term has sent already

        def blocks(rows: pa.RecordBatch, final: bool):
            nonlocal held, done, last
            term, shard = rows.column(0).dictionary_encode(), rows.column(1).to_numpy()
            code = term.indices.to_numpy()
            new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (shard[1:] != shard[:-1])))
            place = np.arange(len(code)) - np.repeat(new, np.diff(np.append(new, len(code))))
            first = np.flatnonzero(place % size == 0)
            number = place[first] // size
            same = (rows.column(0)[0].as_py(), int(shard[0])) == last
            number[: np.searchsorted(first, new[1] if len(new) > 1 else len(code))] += done if same else 0
            stop = len(first) if final else len(first) - 1
            last, done = (rows.column(0)[len(code) - 1].as_py(), int(shard[-1])), int(number[-1])
            held = None if final else rows.slice(int(first[-1]))
            if stop:
                ends = np.append(first, len(code))[: stop + 1]
                offsets = pa.array(ends, pa.int32())
                tf, size_of = rows.column(3).to_numpy()[: ends[-1]], rows.column(4).to_numpy()[: ends[-1]]
                at = pa.array(first[:stop])
                lists = [pa.ListArray.from_arrays(offsets, rows.column(i).slice(0, int(ends[-1]))) for i in (2, 3, 4)]
                columns = [rows.column(0).take(at), rows.column(1).take(at), pa.array(number[:stop], pa.int32()), pa.array(np.maximum.reduceat(tf, first[:stop])), pa.array(np.minimum.reduceat(size_of, first[:stop])), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "shard", "block", "most_tf", "least_len", "ids", "tfs", "lens"])

        for batch in batches:
            if batch.num_rows:
                yield from blocks(batch if held is None else pa.concat_batches([held, batch]), False)
        if held is not None:
            yield from blocks(held, True)

    return run


def _completed(k1: float, b: float):
    """Exact scores: rows (query, id, the query's terms, their idf, the chunk's terms, tfs, len, the query's mean length) as (query, id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            asked, held = batch.column(2), batch.column(4)
            sizes = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (asked, held)]
            coded = pa.concat_arrays([asked.flatten(), held.flatten()]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            wide = int(coded.max(initial=0)) + 1
            want = np.repeat(np.arange(n), sizes[0]) * wide + coded[: sizes[0].sum()]
            have = np.repeat(np.arange(n), sizes[1]) * wide + coded[sizes[0].sum() :]
            order = np.argsort(have)
            at = np.minimum(np.searchsorted(have, want, sorter=order), max(len(have) - 1, 0))
            found = have[order[at]] == want if len(have) else np.zeros(len(want), bool)
            tf = batch.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.float64)[order[at[found]]]
            row = want[found] // wide
            size = batch.column(6).to_numpy(zero_copy_only=False).astype(np.float64)[row]
            mean = batch.column(7).to_numpy(zero_copy_only=False)[row]
            weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))
            score = np.bincount(row, batch.column(3).flatten().to_numpy(zero_copy_only=False)[found] * weight, n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(score, 9))], names=["query_id", "chunk_id", "score"])

    return run


@dataclass(frozen=True)
class WordIndex:
    """A version of the index at a path: the segments that were listed when it was opened.

    forward(segment, chunk_id, terms, tfs, len) has a row a chunk, blocks the postings of a
    term and shard, 128 together by falling weight, with their largest tf and smallest
    length; terms(segment, term, df, most_tf, least_len) and lines are differences that each
    change adds; dead(segment, of, chunk_id) says which chunks of older segments a change
    took away. A change writes its files first and its manifest last, so readers see all of
    it or nothing, and versions opened before stay as they are. Of two changes to one
    version the second fails. kept: manifests are written here, not by an owner.
    """

    spark: SparkSession
    path: str
    lines: tuple[dict, ...]
    k1: float
    b: float
    avg_len: float | None
    with_title: bool
    kept: bool = True

    @property
    def segments(self) -> tuple[str, ...]:
        return tuple(x["segment"] for x in self.lines)

    @property
    def n(self) -> int:
        return sum(x["n"] for x in self.lines)

    @property
    def total_len(self) -> int:
        return sum(x["total_len"] for x in self.lines)

    def manifest(self) -> dict:
        """What opens this version again."""
        return {"lines": list(self.lines), "k1": self.k1, "b": self.b, "avg_len": self.avg_len, "with_title": self.with_title}

    def _read(self, part: str, kinds: str) -> DataFrame:
        """A part's rows of this version's segments."""
        if not self.segments:
            return self.spark.createDataFrame([], kinds)
        paths = [f"{self.path}/{part}/segment={s}" for s in self.segments]
        return self.spark.read.option("basePath", f"{self.path}/{part}").schema(kinds).parquet(*paths)

    def _kind(self) -> str:
        return self.spark.read.parquet(*[f"{self.path}/forward/segment={s}" for s in self.segments]).schema["chunk_id"].dataType.simpleString() if self.segments else "string"

    @property
    def forward(self) -> DataFrame:
        return self._read("forward", f"chunk_id {self._kind()}, terms array<string>, tfs array<int>, len int, segment string")

    @property
    def blocks(self) -> DataFrame:
        return self._read("blocks", f"term string, shard int, block int, most_tf int, least_len int, ids array<{self._kind()}>, tfs array<int>, lens array<int>, segment string")

    @property
    def terms(self) -> DataFrame:
        """term, df, and bounds that no posting of this version passes."""
        each = self._read("terms", "term string, df long, most_tf int, least_len int, segment string")
        return each.groupBy("term").agg(F.sum("df").alias("df"), F.max("most_tf").alias("most_tf"), F.min("least_len").alias("least_len")).where("df > 0")

    @property
    def dead(self) -> DataFrame:
        return self._read("dead", f"of string, chunk_id {self._kind()}, segment string").select(F.col("of").alias("segment"), "chunk_id")

    def alive(self) -> DataFrame:
        """The forward rows of chunks that this version holds."""
        return self.forward.join(self.dead, ["segment", "chunk_id"], "left_anti")

    def weight(self, tf: Column, size: Column) -> Column:
        """The weight of a posting, in rows with the mean length of chunks that their question sees."""
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * size / F.col("mean")))

    def _counted(self, chunks: DataFrame, kind: T.DataType) -> DataFrame:
        """chunks(chunk_id, text, title) as forward rows."""
        ship(self.spark)
        said = F.concat_ws("\n", "title", "text") if self.with_title else F.col("text")
        rows = chunks.select("chunk_id", text.search_tokens(F.coalesce(said, F.lit(""))).alias("tokens"))
        return rows.mapInArrow(_documents, T.StructType([T.StructField("chunk_id", kind), *T._parse_datatype_string(_FORWARD).fields]))

    # ---- changes

    def _change(self, new: DataFrame | None, ids: DataFrame | None, *, made: bool = False) -> WordIndex:
        """Add new chunks and take away ids' chunks of older segments, as one more segment; made: ids are forward rows to add. Without ids the new chunks' own go."""
        name = f"{len(self.segments):06d}-{uuid.uuid4().hex[:8]}"
        at = lambda part: f"{self.path}/{part}/segment={name}"
        kind = new.schema["chunk_id"].dataType if new is not None else ids.schema["chunk_id"].dataType
        empty = self.spark.createDataFrame([], T.StructType([T.StructField("chunk_id", kind), *T._parse_datatype_string(_FORWARD).fields]))
        if new is not None:
            rows = self._counted(new, kind)
        else:
            rows = ids if made else empty
        rows.write.parquet(at("forward"))
        forward = self.spark.read.schema(empty.schema).parquet(at("forward"))
        n, total = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        mean = self.avg_len or max((self.total_len + total) / max(self.n + n, 1), 1e-9)
        # a term's postings are ordered within shards of about 131,072 chunks, so a frequent term is no single task's
        shard = F.pmod(F.xxhash64(F.col("chunk_id").cast("string")), F.lit(max(1, -(-n // _SHARD)))).cast("int")
        posted = forward.select("chunk_id", "len", shard.alias("shard"), F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("chunk_id", "len", "shard", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
        impact = F.col("tf") / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("len") / mean))
        # ordered where they are dealt to, and packed as they pass: no task holds a term
        placed = posted.withColumn("impact", impact).repartition("term", "shard").sortWithinPartitions("term", "shard", F.desc("impact"), "chunk_id")
        kinds = T.StructType([*T._parse_datatype_string("term string, shard int, block int, most_tf int, least_len int").fields, T.StructField("ids", T.ArrayType(kind)), *T._parse_datatype_string("tfs array<int>, lens array<int>").fields])
        placed.select("term", "shard", "chunk_id", "tf", "len").mapInArrow(_packed(_BLOCK), kinds).write.parquet(at("blocks"))
        blocks = self.spark.read.parquet(at("blocks"))
        added = blocks.groupBy("term").agg(F.sum(F.size("ids")).alias("df"), F.max("most_tf").alias("most_tf"), F.min("least_len").alias("least_len"))
        gone_n = gone_len = 0
        if self.segments:
            ids = forward if ids is None else ids
            gone = written(self.alive().join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi"), "gone")
            gone.select(F.col("segment").alias("of"), "chunk_id").write.parquet(at("dead"))
            gone_n, gone_len = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
            less = gone.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
            added = added.unionByName(less, allowMissingColumns=True)
        else:
            self.spark.createDataFrame([], T.StructType([T.StructField("of", T.StringType()), T.StructField("chunk_id", kind)])).write.parquet(at("dead"))
        added.write.parquet(at("terms"))
        done = replace(self, lines=(*self.lines, {"segment": name, "n": n - gone_n, "total_len": total - gone_len}))
        if self.kept:
            versions.commit(self.spark, self.path, len(self.lines), done.manifest())
        return done

    def upsert(self, chunks: DataFrame) -> WordIndex:
        """Replace whole chunks by id; of rows of one id the last in reading order counts."""
        held = chunks.where("chunk_id is not null")
        twice = written(held.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id"), "repeated")
        if not twice.isEmpty():  # only their rows are shuffled
            last = Window.partitionBy("chunk_id").orderBy(F.desc("__n"))
            numbered = held.withColumn("__n", F.monotonically_increasing_id())
            again = numbered.join(twice, "chunk_id", "left_semi").withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
            held = numbered.join(twice, "chunk_id", "left_anti").unionByName(again).drop("__n")
        return self._change(held, None)

    def delete(self, ids: DataFrame) -> WordIndex:
        """Take chunks away by id; unknown ids change nothing."""
        return self._change(None, ids)

    def compact(self, path: str) -> WordIndex:
        """The same chunks at another path as one segment without dead rows; no text is tokenised again."""
        return replace(self, path=path, lines=(), kept=True)._change(None, self.alive().select("chunk_id", "terms", "tfs", "len"), made=True)

    # ---- search

    def topk(self, queries: DataFrame, k: int, *, readable: DataFrame | None = None, added: DataFrame | None = None) -> DataFrame:
        """BM25 over distinct question terms: query_id, rank, chunk_id, score; exact, ties go to the smaller id.

        queries(query_id, question). Frequencies count all chunks, whoever asks; readable
        (chunk_id) are those that may be hits. Scores are rounded to nine digits, so equal texts tie.

        added(query_id, chunk_id, text, title) are chunks that one question alone sees, as if
        they were in the index for it: they count in its number of chunks, its frequencies and
        its mean length, and may be hits, but for those whose column hidden, where there is
        one, is true. Their ids must be new. However many questions bring chunks along, the
        index is read as often as for one: only the few numbers of each question differ.

        First the best of each term's highest blocks, completed, give a score that k chunks
        reach at least.
        Terms whose largest possible weights together stay below it bring no new chunk in,
        nor do blocks whose own largest weight with those of the other terms does. Only the
        chunks of the remaining blocks are completed from their forward rows.
        """
        ship(self.spark)
        order = Window.partitionBy("query_id")
        asked = queries.where("query_id is not null").select("query_id", F.explode(F.array_distinct(text.search_tokens(F.coalesce("question", F.lit(""))))).alias("term"))
        n, size = F.lit(self.n), F.lit(self.total_len)
        asked = asked.withColumn("more_df", F.lit(0))
        if added is not None:
            own = self._own(added)
            seen = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("more"), F.sum("len").alias("more_len"))
            met = own.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("more_df"))
            asked = asked.drop("more_df").join(met, ["query_id", "term"], "left").join(seen, "query_id", "left").na.fill(0, ["more_df", "more", "more_len"])
            n, size = n + F.col("more"), size + F.col("more_len")
        mean = F.lit(float(self.avg_len)) if self.avg_len else F.when((n > 0) & (size > 0), size / n).otherwise(1.0)
        df = F.coalesce("df", F.lit(0)) + F.col("more_df")
        known = self.terms.join(asked.select("term").distinct(), "term", "left_semi")
        terms = asked.join(known, "term", "left").withColumn("mean", mean).withColumn("idf", F.log(1 + (n - df + 0.5) / (df + 0.5)))
        terms = terms.withColumn("most", F.when(F.col("df") > 0, F.col("idf") * self.weight(F.col("most_tf"), F.col("least_len"))).otherwise(0.0))
        up = order.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        terms = terms.where(df > 0).select("query_id", "term", "idf", "mean", "most")
        terms = written(terms.withColumn("every", F.sum("most").over(order)).withColumn("upto", F.sum("most").over(up)), "question-terms")
        weighed = self.blocks.join(terms, "term").withColumn("block_most", self.weight(F.col("most_tf"), F.col("least_len")))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        asking = terms.groupBy("query_id").agg(F.collect_list("term").alias("q_terms"), F.collect_list("idf").alias("q_idf"), F.first("mean").alias("mean"))
        first = self._hits(weighed.where("block = 0"), readable).groupBy("query_id", "segment", "chunk_id").agg(F.sum("part").alias("score"))
        first = first.withColumn("r", F.row_number().over(best)).where(F.col("r") <= 8 * k).select("query_id", "segment", "chunk_id")
        floor = self._complete(first, asking, queries).withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", (F.col("score") - _SLACK).alias("floor"))
        floor = written(floor, "floors")
        needed = weighed.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        needed = needed.where((F.col("upto") >= F.col("floor")) & (F.col("idf") * F.col("block_most") + F.col("every") - F.col("most") >= F.col("floor")))
        # two numbers a posting are shuffled, and rights are looked up only for chunks that can reach the floor
        seen = self._hits(needed, None).groupBy("query_id", "segment", "chunk_id").agg((F.sum(F.col("part") - F.col("most")) + F.max(F.col("every") - F.col("floor"))).alias("over"))
        wanted = _readable(seen.where("over >= 0").select("query_id", "segment", "chunk_id"), readable)
        scored = self._complete(wanted, asking, queries)
        if added is not None:
            near = own.where(~F.col("hidden")).join(asking, "query_id").where(F.arrays_overlap("terms", "q_terms"))
            # dealt anew, as a union of parts shuffled by question passes for shuffled itself
            scored = scored.unionByName(self._scored(near, scored.schema)).repartition("chunk_id")
        return scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")

    def _complete(self, wanted: DataFrame, asking: DataFrame, queries: DataFrame) -> DataFrame:
        """wanted(query_id, segment, chunk_id) with exact scores."""
        kinds = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), self.forward.schema["chunk_id"], T.StructField("score", T.DoubleType())])
        return self._scored(wanted.join(self.forward, ["segment", "chunk_id"]).join(asking, "query_id"), kinds)

    def _scored(self, rows: DataFrame, kinds: T.StructType) -> DataFrame:
        return rows.select("query_id", "chunk_id", "q_terms", "q_idf", "terms", "tfs", "len", "mean").mapInArrow(_completed(self.k1, self.b), kinds)

    def _own(self, added: DataFrame) -> DataFrame:
        """Chunks of single questions as forward rows, with query_id and hidden."""
        rows = added.where("query_id is not null and chunk_id is not null")
        hidden = F.coalesce(F.col("hidden"), F.lit(False)) if "hidden" in added.columns else F.lit(False)
        rows = rows.withColumn("chunk_id", F.struct("query_id", "chunk_id", hidden.alias("hidden")))
        return written(self._counted(rows, rows.schema["chunk_id"].dataType).select("chunk_id.*", "terms", "tfs", "len"), "added")

    def _hits(self, blocks: DataFrame, readable: DataFrame | None) -> DataFrame:
        """A row for each question and posting of these blocks that lives and may be read, with its part of the score."""
        each = blocks.withColumn("x", F.explode(F.arrays_zip("ids", "tfs", "lens"))).withColumn("chunk_id", F.col("x.ids"))
        each = each.withColumn("part", F.col("idf") * self.weight(F.col("x.tfs"), F.col("x.lens"))).drop("x", "ids", "tfs", "lens")
        if len(self.segments) > 1:
            each = each.join(self.dead, ["segment", "chunk_id"], "left_anti")
        else:  # one name for all, so it is no part of keys
            each = each.withColumn("segment", F.lit(self.segments[0] if self.segments else None).cast("string"))
        return _readable(each, readable)


def _readable(rows: DataFrame, readable: DataFrame | None) -> DataFrame:
    return rows if readable is None else rows.join(readable.select("chunk_id"), "chunk_id", "left_semi")


def create(
    spark: SparkSession, path: str, chunks: DataFrame, *, k1: float = 1.2, b: float = 0.75, avg_len: float | None = None, with_title: bool = False, kept: bool = True,
) -> WordIndex:
    """An index of chunks(chunk_id, text, title) at a new path; each text is tokenised once. avg_len defaults to the mean of all chunks at the time of a search."""
    return WordIndex(spark, path, (), float(k1), float(b), None if avg_len is None else float(avg_len), with_title, kept).upsert(chunks)


def open_index(spark: SparkSession, path: str, number: int | None = None, *, manifest: dict | None = None) -> WordIndex:
    """A version at a path, the newest by default; or the one that an owner's manifest names."""
    m = manifest or versions.read(spark, path, number)
    return WordIndex(spark, path, tuple(m["lines"]), m["k1"], m["b"], m["avg_len"], m["with_title"], manifest is None)
