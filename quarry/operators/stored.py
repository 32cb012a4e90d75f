"""A chunk collection on disk that its own changes are written back to: versions, deltas merged on reading, compaction."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import versions
from quarry.functions.vectors import normalised
from quarry.operators import search, words
from quarry.operators.access import Principal, visible
from quarry.operators.store import Collection, last_of
from quarry.scratch import written

_PARTS = ("chunks", "vectors", "gone", "gone_vectors")


@dataclass(frozen=True)
class Stored:
    """One version of a collection at a path.

    A change adds a segment: new chunks and vectors, and which ids lost what they had in
    older segments. Reading merges the segments: a row holds if nothing newer took it away.
    Files are never altered and the manifest comes last, so whoever opened an older version
    goes on reading it, and of two changes to one version the second fails whole.
    """

    spark: SparkSession
    path: str
    number: int
    segments: tuple[str, ...]
    declared: dict[str, int]
    kinds: dict[str, str]
    words: dict | None = None

    # ---- reading

    def _read(self, part: str) -> DataFrame:
        """Rows of a part with __at, the place of their segment."""
        schema = T.StructType.fromDDL(self.kinds[part])
        places = F.create_map(*(F.lit(x) for i, s in enumerate(self.segments) for x in (s, i)))
        held = self.spark.read.option("basePath", f"{self.path}/{part}").schema(T.StructType([*schema.fields, T.StructField("segment", T.StringType())]))
        rows = held.parquet(*[f"{self.path}/{part}/segment={s}" for s in self.segments])
        return rows.withColumn("__at", F.element_at(places, F.col("segment"))).drop("segment")

    def _living(self, rows: DataFrame) -> DataFrame:
        gone = self._read("gone").groupBy("chunk_id").agg(F.max("__at").alias("__gone"))
        return rows.join(gone, "chunk_id", "left").where(F.col("__gone").isNull() | (F.col("__gone") <= F.col("__at"))).drop("__gone")

    @property
    def chunks(self) -> DataFrame:
        return self._living(self._read("chunks")).drop("__at")

    @property
    def vectors(self) -> DataFrame:
        """chunk_id, vector_name, embedding."""
        gone = self._read("gone_vectors").groupBy("chunk_id", "vector_name").agg(F.max("__at").alias("__lost"))
        rows = self._living(self._read("vectors")).join(gone, ["chunk_id", "vector_name"], "left")
        return rows.where(F.col("__lost").isNull() | (F.col("__lost") <= F.col("__at"))).select("chunk_id", "vector_name", "embedding")

    def view(self) -> Collection:
        """This version as tables in memory, for all that only reads."""
        return Collection(self.chunks, self.vectors, self.declared)

    def count(self, with_vector: str | None = None) -> int:
        return self.view().count(with_vector)

    def word_index(self) -> words.WordIndex:
        if self.words is None:
            raise ValueError("the collection was made without a word index")
        return words.open_index(self.spark, f"{self.path}/words", manifest=self.words)

    def search(self, queries: DataFrame, name: str, k: int, *, principal: Principal | None = None, mode: str = "dense", prefetch: int = search.PREFETCH) -> DataFrame:
        """Top k of queries(query_id, embedding, question for hybrid search) among what the principal may read."""
        if mode == "hybrid":
            index = self.word_index()
        elif mode != "dense":
            raise ValueError(f"a collection is searched dense or hybrid, not {mode!r}")
        rights = self.chunks.select("chunk_id", "tlp_rank", "source_type")
        held = self.vectors.where(F.col("vector_name") == name).select("chunk_id", "embedding").join(rights, "chunk_id")
        depth = max(k, prefetch) if mode == "hybrid" else k
        dense = search.dense_topk(queries, held, depth, principal=principal)
        if mode == "dense":
            return dense
        return search.fuse([dense, index.topk(queries, depth, readable=None if principal is None else visible(rights, principal))], k)

    # ---- changes

    def _commit(self, parts: dict[str, DataFrame], *, fresh: bool = False, **changed) -> Stored:
        name = f"{self.number + 1:09d}-{uuid.uuid4().hex[:8]}"
        kinds = dict(self.kinds)
        for part in _PARTS:
            rows = parts.get(part)
            known = T.StructType.fromDDL(kinds[part])
            if rows is None:
                rows = self.spark.createDataFrame([], known)
            else:
                new = [f for f in rows.schema.fields if f.name not in known.names]
                kinds[part] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*known.fields, *new])
            rows.write.parquet(f"{self.path}/{part}/segment={name}")
        done = replace(self, number=self.number + 1, segments=(name,) if fresh else (*self.segments, name), kinds=kinds, **changed)
        versions.commit(self.spark, self.path, done.number, {"segments": list(done.segments), "declared": done.declared, "kinds": done.kinds, "words": done.words})
        return done

    def upsert(self, chunks: DataFrame, vectors: DataFrame) -> Stored:
        """Replace whole chunks by id, with vectors(chunk_id, vector_name, embedding); an id's other vectors go. Of rows of one id the last in reading order counts; rows without an id are left out."""
        once = last_of(chunks, "chunk_id")
        unit = last_of(vectors, "chunk_id", "vector_name").select("chunk_id", "vector_name", normalised(F.col("embedding")).alias("embedding"))
        once = written(once, "upsert")
        index = None if self.words is None else self.word_index().upsert(once).manifest()
        return self._commit({"chunks": once, "vectors": unit.join(once.select("chunk_id"), "chunk_id", "left_semi"), "gone": once.select("chunk_id")}, words=index)

    def attach(self, name: str, vectors: DataFrame) -> tuple[Stored, DataFrame]:
        """One more named vector for chunks that exist; also counts: seen, attached, skipped."""
        if name not in self.declared:
            raise KeyError(f"vector {name!r} is not declared")
        ids = self.chunks.select("chunk_id")
        once = last_of(vectors, "chunk_id")
        new = written(once.join(ids, "chunk_id", "left_semi").select("chunk_id", F.lit(name).alias("vector_name"), normalised(F.col("embedding")).alias("embedding")), "attach")
        marked = vectors.select("chunk_id").join(ids.withColumn("__has", F.lit(1)), "chunk_id", "left")
        counts = marked.agg(F.count(F.lit(1)).alias("seen"), F.count("__has").alias("attached"), (F.count(F.lit(1)) - F.count("__has")).alias("skipped"))
        return self._commit({"vectors": new, "gone_vectors": new.select("chunk_id", "vector_name")}), counts

    def delete(self, ids: DataFrame) -> Stored:
        """Take chunks away by id, with their vectors and postings."""
        gone = ids.select("chunk_id").where("chunk_id is not null").distinct()
        index = None if self.words is None else self.word_index().delete(gone).manifest()
        return self._commit({"gone": gone}, words=index)

    def delete_by_source_type(self, source_type: str) -> tuple[Stored, int]:
        gone = written(self.chunks.where(F.col("source_type") == source_type).select("chunk_id"), "gone")
        return self.delete(gone), gone.count()

    def compact(self) -> Stored:
        """A next version with the same rows in one segment; older versions stay readable until vacuum()."""
        return self._commit({"chunks": self.chunks, "vectors": self.vectors}, fresh=True)

    def vacuum(self) -> int:
        """Delete segments that this version does not read, and older manifests; returns how many segments went."""
        jvm, fs, _ = versions._system(self.spark, self.path)
        where, n = jvm.org.apache.hadoop.fs.Path, set()
        for number in versions.numbers(self.spark, self.path):
            if number < self.number:
                fs.delete(where(versions._name(self.path, number)), False)
        for part in _PARTS:
            for x in fs.listStatus(where(f"{self.path}/{part}")):
                name = x.getPath().getName().removeprefix("segment=")
                if name not in self.segments and int(name.split("-")[0]) <= self.number:
                    fs.delete(x.getPath(), True)
                    n.add(name)
        return len(n)

    def drop(self) -> bool:
        """Delete the collection with all its versions."""
        return versions.drop(self.spark, self.path)


def create(spark: SparkSession, path: str, chunks: DataFrame, vectors: DataFrame, declared: dict[str, int], *, hybrid: bool = False, unit: bool = False, **lexical) -> Stored:
    """A collection at a new path; hybrid adds a word index with the options lexical. unit: the vectors are normalised already and stay as they are."""
    once = written(last_of(chunks, "chunk_id"), "create")
    kind = once.schema["chunk_id"].dataType.simpleString()
    kinds = {"chunks": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in once.schema.fields), "vectors": f"chunk_id {kind}, vector_name string, embedding array<double>", "gone": f"chunk_id {kind}", "gone_vectors": f"chunk_id {kind}, vector_name string"}
    index = words.create(spark, f"{path}/words", once, kept=False, **lexical).manifest() if hybrid else None
    shaped = F.col("embedding").cast("array<double>") if unit else normalised(F.col("embedding"))
    units = last_of(vectors, "chunk_id", "vector_name").select("chunk_id", "vector_name", shaped.alias("embedding"))
    return Stored(spark, path, -1, (), dict(declared), kinds, index)._commit({"chunks": once, "vectors": units.join(once.select("chunk_id"), "chunk_id", "left_semi")})


def open_stored(spark: SparkSession, path: str, number: int | None = None) -> Stored:
    """A version of a collection, the newest by default."""
    if number is None:
        known = versions.numbers(spark, path)
        if not known:
            raise FileNotFoundError(f"{path} holds no collection")
        number = known[-1]
    m = versions.read(spark, path, number)
    return Stored(spark, path, number, tuple(m["segments"]), m["declared"], m["kinds"], m["words"])
