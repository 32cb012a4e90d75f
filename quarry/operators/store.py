"""A chunk collection as Parquet tables: chunks, named vectors and postings; every change returns new tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.vectors import normalised
from quarry.operators import search
from quarry.operators.access import Principal


def last_of(rows: DataFrame, *key: str) -> DataFrame:
    """The last of the rows of each key, in reading order; rows whose first key column is null are left out."""
    order = Window.partitionBy(*key).orderBy(F.desc("__n"))
    numbered = rows.where(F.col(key[0]).isNotNull()).withColumn("__n", F.monotonically_increasing_id())
    return numbered.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__n", "__r")


@dataclass(frozen=True)
class Collection:
    """chunks(chunk_id, doc_id, source_type, tlp_rank, ...); vectors(chunk_id, vector_name, embedding); postings or None."""

    chunks: DataFrame
    vectors: DataFrame
    declared: dict[str, int] = field(default_factory=dict)
    postings: DataFrame | None = None
    lexical: dict = field(default_factory=dict)

    def _with(self, chunks: DataFrame, vectors: DataFrame, gone: DataFrame | None = None, new: DataFrame | None = None) -> Collection:
        """This collection with other chunks and vectors; postings follow: those of gone ids leave, new chunks' come.

        With a fixed avg_len only new chunks are counted; else the mean moves with every
        change, and postings are made again.
        """
        index = self.postings
        if index is not None and (gone is not None or new is not None):
            if self.lexical.get("avg_len") is None:
                index = search.postings(chunks, **self.lexical)
            else:
                index = index if gone is None else index.join(gone, "chunk_id", "left_anti")
                index = index if new is None else index.unionByName(search.postings(new, **self.lexical))
        return Collection(chunks, vectors, self.declared, index, self.lexical)

    def ensure(self, wanted: dict[str, int], *, sparse: bool = False) -> Collection:
        """All named vectors must be declared with their dimensions; hybrid search needs postings."""
        if missing := {n: d for n, d in wanted.items() if self.declared.get(n) != d}:
            raise ValueError(f"vectors not declared with these dimensions: {missing}")
        if sparse and self.postings is None:
            raise ValueError("the collection has no postings")
        return self

    def upsert(self, chunks: DataFrame, vectors: DataFrame) -> Collection:
        """Replace whole chunks by id; an id's other named vectors go. Of rows of one id the last in reading order counts, as a store that takes them one by one would have it; rows without an id are left out."""
        chunks = last_of(chunks, "chunk_id")
        ids = chunks.select("chunk_id")
        kept = self.chunks.join(ids, "chunk_id", "left_anti").unionByName(chunks, allowMissingColumns=True)
        unit = last_of(vectors, "chunk_id", "vector_name").withColumn("embedding", normalised(F.col("embedding")))
        return self._with(kept, self.vectors.join(ids, "chunk_id", "left_anti").unionByName(unit), ids, chunks)

    def attach(self, name: str, vectors: DataFrame) -> tuple[Collection, DataFrame]:
        """One more named vector for chunks that exist; also counts: seen, attached, skipped."""
        if name not in self.declared:
            raise KeyError(f"vector {name!r} is not declared")
        held = vectors.join(self.chunks.select("chunk_id"), "chunk_id", "left_semi")
        new = held.select("chunk_id", F.lit(name).alias("vector_name"), normalised(F.col("embedding")).alias("embedding"))
        old = self.vectors.where(F.col("vector_name") != name).unionByName(self.vectors.where(F.col("vector_name") == name).join(new, "chunk_id", "left_anti"))
        marked = vectors.select("chunk_id").join(self.chunks.select("chunk_id", F.lit(1).alias("__has")), "chunk_id", "left")
        counts = marked.agg(F.count(F.lit(1)).alias("seen"), F.count("__has").alias("attached"), (F.count(F.lit(1)) - F.count("__has")).alias("skipped"))
        return self._with(self.chunks, old.unionByName(new)), counts

    def with_postings(self, **options) -> Collection:
        """A copy that can also be searched by words."""
        return Collection(self.chunks, self.vectors, self.declared, search.postings(self.chunks, **options), options)

    def scroll(self, source_type: str | None = None) -> DataFrame:
        return self.chunks if source_type is None else self.chunks.where(F.col("source_type") == source_type)

    def vectors_of(self, name: str, ids: DataFrame) -> DataFrame:
        """Stored vectors of ids; ids without one are missing from the result."""
        return self.vectors.where(F.col("vector_name") == name).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "embedding")

    def missing(self, name: str, ids: DataFrame) -> DataFrame:
        return ids.select("chunk_id").join(self.vectors_of(name, ids), "chunk_id", "left_anti")

    def count(self, with_vector: str | None = None) -> int:
        return self.chunks.count() if with_vector is None else self.vectors.where(F.col("vector_name") == with_vector).select("chunk_id").distinct().count()

    def delete_by_source_type(self, source_type: str) -> tuple[Collection, int]:
        gone = self.scroll(source_type)
        ids = gone.select("chunk_id")
        kept = self.chunks.where(~F.coalesce(F.col("source_type") == source_type, F.lit(False)))
        return self._with(kept, self.vectors.join(ids, "chunk_id", "left_anti"), ids), gone.count()

    def segregate(self, restrict_above: int) -> tuple[Collection, Collection]:
        """Open and restricted parts by classification, unknown ones restricted; vectors follow their chunks. Neither part is searched by words."""
        parts = []
        low = F.coalesce(F.col("tlp_rank") <= restrict_above, F.lit(False))
        for keep in (low, ~low):
            rows = self.chunks.where(keep)
            parts.append(Collection(rows, self.vectors.join(rows.select("chunk_id"), "chunk_id", "left_semi"), self.declared))
        return parts[0], parts[1]

    def search(self, queries: DataFrame, name: str, k: int, *, principal: Principal | None = None, mode: str = "dense", prefetch: int = search.PREFETCH) -> DataFrame:
        """Top k of queries(query_id, embedding, question for hybrid search). A collection with postings is searched as a hybrid one, and no other is."""
        if (mode == "hybrid") != (self.postings is not None):
            raise ValueError(f"a collection {'with' if self.postings is not None else 'without'} postings cannot be searched in mode {mode!r}")
        rights = self.chunks.select("chunk_id", "tlp_rank", "source_type")
        vectors = self.vectors.where(F.col("vector_name") == name).select("chunk_id", "embedding").join(rights, "chunk_id")
        if mode == "hybrid":
            return search.hybrid_topk(queries, self.chunks, vectors, self.postings, k, principal=principal, prefetch=prefetch)
        return search.dense_topk(queries, vectors, k, principal=principal)

    def write(self, path: str) -> None:
        self.chunks.write.mode("overwrite").partitionBy("source_type").parquet(f"{path}/chunks")
        self.vectors.write.mode("overwrite").partitionBy("vector_name").parquet(f"{path}/vectors")
        if self.postings is not None:
            self.postings.write.mode("overwrite").parquet(f"{path}/postings")


@dataclass(frozen=True)
class Segregated:
    """Two collections apart by classification, used as one; a chunk is in one of them only."""

    low: Collection
    high: Collection
    restrict_above: int

    @property
    def chunks(self) -> DataFrame:
        return self.scroll()

    def scroll(self, source_type: str | None = None) -> DataFrame:
        return self.low.scroll(source_type).unionByName(self.high.scroll(source_type), allowMissingColumns=True)

    def vectors_of(self, name: str, ids: DataFrame) -> DataFrame:
        return self.low.vectors_of(name, ids).unionByName(self.high.vectors_of(name, ids))

    def missing(self, name: str, ids: DataFrame) -> DataFrame:
        return ids.select("chunk_id").join(self.vectors_of(name, ids), "chunk_id", "left_anti")

    def count(self, with_vector: str | None = None) -> int:
        return self.low.count(with_vector) + self.high.count(with_vector)

    def upsert(self, chunks: DataFrame, vectors: DataFrame) -> Segregated:
        """Replace whole chunks by id; one whose classification changed leaves the part that it was in."""
        both = Collection(self.scroll(), self.low.vectors.unionByName(self.high.vectors), self.low.declared)
        return segregated(both.upsert(chunks, vectors), self.restrict_above)

    def attach(self, name: str, vectors: DataFrame) -> tuple[Segregated, DataFrame]:
        """All vectors are offered to both parts, which take those of chunks that they hold; the counts are of both."""
        (low, a), (high, b) = self.low.attach(name, vectors), self.high.attach(name, vectors)
        counts = a.unionByName(b).agg(F.max("seen").alias("seen"), F.sum("attached").alias("attached"), (F.max("seen") - F.sum("attached")).alias("skipped"))
        return Segregated(low, high, self.restrict_above), counts

    def delete_by_source_type(self, source_type: str) -> tuple[Segregated, int]:
        (low, a), (high, b) = self.low.delete_by_source_type(source_type), self.high.delete_by_source_type(source_type)
        return Segregated(low, high, self.restrict_above), a + b

    def search(self, queries: DataFrame, name: str, k: int, *, principal: Principal | None = None, mode: str = "dense", prefetch: int = search.PREFETCH) -> DataFrame:
        """Top k of both parts; the restricted one is not read for a principal who may read nothing in it."""
        found = self.low.search(queries, name, k, principal=principal, mode=mode)
        if principal is None or principal.rank > self.restrict_above:
            found = found.unionByName(self.high.search(queries, name, k, principal=principal, mode=mode))
        return search.ranked(found.drop("rank").repartition("chunk_id"), k)


def segregated(held: Collection, restrict_above: int) -> Segregated:
    return Segregated(*held.segregate(restrict_above), restrict_above)


def backfill(held: Collection | Segregated, name: str, embed: Callable[[Column], Column]) -> tuple[Collection | Segregated, DataFrame]:
    """Embed the texts of all chunks and attach the vectors; also counts: seen, attached, skipped."""
    return held.attach(name, held.scroll().select("chunk_id", embed(F.coalesce("text", F.lit(""))).alias("embedding")))


def open_collection(spark: SparkSession, path: str, declared: dict[str, int], *, hybrid: bool = False, **lexical) -> Collection:
    """A written collection; lexical: the options that its postings were made with."""
    postings = spark.read.parquet(f"{path}/postings") if hybrid else None
    return Collection(spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/vectors"), declared, postings, lexical)
