"""Dense, lexical and hybrid top-k for batches of questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.functions import text
from quarry.operators import cells
from quarry.operators.access import Principal, visible
from quarry.operators.cells import _matrix
from quarry.shipping import ship

#: Of reciprocal rank fusion (Cormack, Clarke and Buettcher, 2009).
RRF_K = 60
PREFETCH = 50


def dense_topk(
    queries: DataFrame, vectors: DataFrame, k: int, *, principal: Principal | None = None, exclude_self: bool = False, cosine: bool = False, block: int = 2048, index: cells.CellIndex | None = None,
) -> DataFrame:
    """The k vectors nearest each query: query_id, rank, chunk_id, score. Ties go to the smaller chunk id.

    queries(query_id, embedding); those without an embedding have no hits. Rows of vectors
    (chunk_id, embedding) that the principal may not read are filtered first. Up to block
    queries are sent to all executors: each task multiplies its batches of vectors with them
    and keeps the best k so far, so that vectors never move. More queries meet the vectors
    in cells (cells.topk), whatever their number; index is a stored index of the vectors,
    else one is made. exclude_self: a query's own id is no hit. cosine: vectors need not
    have unit length.
    """
    ship(vectors.sparkSession)
    asked = queries.where("embedding is not null").select("query_id", "embedding")
    few = asked.limit(block + 1).collect()
    if len(few) > block:
        held = index or cells.build(visible(vectors, principal).select("chunk_id", "embedding"), unit=cosine)
        return cells.topk(asked, held, k, principal=principal if index else None, exclude_self=exclude_self)
    pool = visible(vectors, principal).where("embedding is not null").select("chunk_id", "embedding")
    kinds = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", vectors.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())])
    if not few:
        return vectors.sparkSession.createDataFrame([], kinds).withColumn("rank", F.lit(1)).select("query_id", "rank", "chunk_id", "score")
    matrix = np.array([r[1] for r in few], np.float64)
    if cosine:
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    sent = vectors.sparkSession.sparkContext.broadcast(([r[0] for r in few], matrix))
    return ranked(pool.mapInArrow(_best(sent, k, exclude_self, cosine, kinds), kinds), k)


def _best(sent, k: int, exclude_self: bool, cosine: bool, kinds: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in kinds.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = sent.value
        who = {q: i for i, q in enumerate(ids)}
        best, held = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk = np.array(batch.column(0).to_pylist(), object)
            rows = _matrix(batch.column(1))
            if cosine:
                rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
            by_id = np.argsort(chunk, kind="stable")
            chunk, score = chunk[by_id], matrix @ rows[by_id].T
            if exclude_self:
                for j, c in enumerate(chunk.tolist()):
                    if c in who:
                        score[who[c], j] = -np.inf
            near = np.argsort(-score, axis=1, kind="stable")[:, :k]
            best = np.concatenate((best, np.take_along_axis(score, near, axis=1)), axis=1)
            held = np.concatenate((held, chunk[near]), axis=1)
            if best.shape[1] > k:
                # ties go to the smaller id
                place = np.unique(held, return_inverse=True)[1].reshape(held.shape)
                order = np.lexsort((place, -best), axis=1)[:, :k]
                best, held = np.take_along_axis(best, order, axis=1), np.take_along_axis(held, order, axis=1)
        at, nth = np.nonzero(np.isfinite(best))
        columns = [[ids[i] for i in at.tolist()], held[at, nth].tolist(), best[at, nth]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=kinds.names)

    return run


def ranked(scored: DataFrame, k: int | None = None, *, key: str = "query_id", tie: str = "chunk_id") -> DataFrame:
    """Rank 1 is the best score; k limits."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.asc(tie))).cast("long"))
    out = out if k is None else out.where(F.col("rank") <= k)
    return out.select(key, "rank", tie, "score")


def postings(chunks: DataFrame, *, k1: float = 1.2, b: float = 0.75, avg_len: float | None = None, with_title: bool = False) -> DataFrame:
    """chunk_id, term, tf, weight: the saturated term frequency of each chunk's tokens.

    weight = tf (k1 + 1) / (tf + k1 (1 - b + b len / avg_len)). avg_len defaults to the
    mean of all chunks, tokens of empty ones counting 0. A chunk's terms are counted where
    it stands, so nothing moves; a chunk id is one row.
    """
    said = F.concat_ws("\n", "title", "text") if with_title else F.col("text")
    rows = chunks.select("chunk_id", text.search_tokens(F.coalesce(said, F.lit(""))).alias("tokens"))
    mean = F.lit(float(avg_len)) if avg_len is not None else F.coalesce(F.nullif(rows.agg(F.avg(F.size("tokens"))).scalar(), F.lit(0.0)), F.lit(1.0))
    ship(chunks.sparkSession)
    kinds = T.StructType([T.StructField("chunk_id", chunks.schema["chunk_id"].dataType), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("len", T.LongType())])
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean))
    return rows.mapInArrow(_counted, kinds).select("chunk_id", "term", "tf", weight.alias("weight"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, tokens) as a row for each id and distinct token: how often it occurs, and how many tokens the id has."""
    for batch in batches:
        tokens = batch.column(1)
        size = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = tokens.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        wide = max(len(coded.dictionary), 1)
        pair, count = np.unique(np.repeat(np.arange(len(size)), size) * wide + code, return_counts=True)
        row = pair // wide
        columns = [batch.column(0).take(pa.array(row)), coded.dictionary.take(pa.array(pair % wide)), pa.array(count, pa.int64()), pa.array(size[row])]
        yield pa.RecordBatch.from_arrays(columns, names=["chunk_id", "term", "tf", "len"])


def idf(index: DataFrame, total: int) -> DataFrame:
    """term, df, idf over the whole collection, whoever asks."""
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def lexical_topk(queries: DataFrame, index: DataFrame, total: int, k: int, *, readable: DataFrame | None = None) -> DataFrame:
    """BM25 over distinct query terms: query_id, rank, chunk_id, score. A question without terms gets no ranking.

    queries(query_id, question). index: postings(). total: chunks in the collection.
    readable: chunk ids that may be seen, applied before ranking; frequencies still count all.
    Query terms prune the postings before they are weighed.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(text.search_tokens(F.col("question")))).alias("term"))
    used = index.join(asked.select("term").distinct(), "term", "left_semi")
    weights = idf(used, total).select("term", "idf")
    if readable is not None:
        used = used.join(readable.select("chunk_id").distinct(), "chunk_id", "left_semi")
    scored = used.join(asked.join(weights, "term"), "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("idf") * F.col("weight")), 9).alias("score"))  # equal texts tie, in whatever order terms were added
    return ranked(scored, k)


def fuse(rankings: list[DataFrame], k: int, *, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion; ties go to the smaller chunk id."""
    rows = rankings[0].select("query_id", "chunk_id", "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select("query_id", "chunk_id", "rank"))
    rows = rows.repartition("chunk_id")  # a union of parts shuffled by question passes for shuffled itself, and later joins zip unequal partitions
    return ranked(rows.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score")), k)


def hybrid_topk(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, index: DataFrame, k: int, *, principal: Principal | None = None, prefetch: int = PREFETCH) -> DataFrame:
    """Dense and lexical rankings of depth max(k, prefetch), both under the principal's rights, fused and cut to k."""
    depth, total = max(k, prefetch), chunks.count()
    readable = None if principal is None else visible(chunks, principal)
    return fuse([dense_topk(queries, vectors, depth, principal=principal), lexical_topk(queries, index, total, depth, readable=readable)], k)


def segregated_topk(queries: DataFrame, vectors: DataFrame, k: int, restrict_above: int, principal: Principal | None) -> DataFrame:
    """Top k over an open and a restricted table; the restricted one is read only by those cleared beyond restrict_above."""
    low = F.coalesce(F.col("tlp_rank") <= restrict_above, F.lit(False))
    high = ~low  # an unknown classification is restricted
    found = dense_topk(queries, vectors.where(low), k, principal=principal)
    if principal is None or principal.rank > restrict_above:
        found = found.unionByName(dense_topk(queries, vectors.where(high), k, principal=principal))
    return ranked(found.drop("rank").repartition("chunk_id"), k)


def retrieve(
    hits_at: Callable[[int], DataFrame], chunks: DataFrame, *, k: int | None = None, top_k: int = 5, overfetch: int = 1, score_threshold: float | None = None,
    hybrid: bool = False, principal: Principal | None = None, rules: tuple[Callable[[DataFrame], DataFrame], ...] = (),
) -> DataFrame:
    """Hits at depth k * overfetch, threshold, access check, rules in order, then the cut to k, ranks renumbered.

    k 0 or None falls back to top_k. A threshold has no meaning for fused scores.
    """
    if hybrid and score_threshold is not None:
        raise ValueError("a score threshold cannot be applied to fused ranks")
    wanted = k or top_k
    hits = hits_at(wanted * overfetch)
    if score_threshold is not None:
        hits = hits.where(F.col("score") >= score_threshold)
    hits = visible(hits.join(chunks, "chunk_id"), principal)
    for rule in rules:
        hits = rule(hits)
    order = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= wanted)
