"""What the operators decide, carried out on whole rows: these return the columns of their input."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.llm import _words as W
from quarry.llm import classify, decontaminate, jaccard, mix
from quarry.llm._store import written
from quarry.shipping import ship


def row_id(df: DataFrame, id_col: str) -> Column:
    """An orderable id for rows: null ids last, then the id, then a hash of all columns; equal only for equal rows. Maps are hashed as JSON, in the order of their entries."""
    hashed = [F.to_json(c.name) if "map<" in c.dataType.simpleString() else F.col(c.name) for c in df.schema.fields]
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(*hashed).alias("h"))


def _named(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def _readable(docs: DataFrame, text_col: str) -> tuple[DataFrame, int, list[str]]:
    """docs with the place of its text as strings, and what was added for that: nothing but where the text column is of another type."""
    if isinstance(docs.schema[text_col].dataType, T.StringType):
        return docs, docs.columns.index(text_col), []
    more = _named(docs, "__said")
    return docs.withColumn(more[0], F.col(text_col).cast("string")), len(docs.columns), more


def drop_low_quality(docs: DataFrame, model: classify.Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Rows that the classifier scores at threshold or more; nothing moves.

    Null texts are scored as empty ones, long ones whole, texts of other types by what they
    are as strings; equal rows share their fate, other columns may have any names and nulls,
    and an empty table stays empty.
    """
    ship(docs.sparkSession)
    said, place, more = _readable(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for a, b in W.chunks(batch.column(place)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(sent.value.score(part.column(place)) >= threshold))

    return said.mapInArrow(run, said.schema).drop(*more)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10,
    k: int = 5, block_bytes: int = 32 << 20,
) -> DataFrame:
    """Rows without a window of any benchmark item; each block of the benchmark is one more filter, and nothing moves.

    Null and empty texts stay, long ones are searched whole, texts of other types as strings;
    equal rows share their fate, items without words find nothing, and without items or
    documents the table stays as it is. Other columns may have any names and nulls.
    """
    ship(docs.sparkSession)
    said, place, more = _readable(docs, text_col)

    def clean(sent):
        def run(batches):
            for batch in batches:
                for a, b in W.chunks(batch.column(place)):
                    part = batch.slice(a, b - a)
                    _, _, rows, _ = sent.value.hits(sent.value.split(part.column(place)))
                    keep = [True] * part.num_rows
                    for r in set(rows.tolist()):
                        keep[r] = False
                    yield part.filter(pa.array(keep, pa.bool_()))

        return run

    out = said
    for block in decontaminate._blocks(benchmark, item_col, item_text_col, window, k, block_bytes):
        out = out.mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(block)), said.schema)
    return out.drop(*more)


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Of each component of near duplicates the row with the smallest id; texts without words have no duplicates.

    Rows equal in all columns count as one row, null ids come last, an empty table stays
    empty, and columns may have any names.
    """
    row, nth = _named(docs, "__row", "__nth")
    named = docs.withColumn(row, row_id(docs, id_col))
    groups = jaccard.near_duplicates(named.select(F.col(row).alias("__row"), F.col(text_col).alias("__said")), id_col="__row", text_col="__said", shingle=shingle, percent=percent)
    return _joined(named, groups.where("__row = component_id").select(F.col("__row").alias(row)).distinct(), row, nth).drop(row, nth)


def take_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **options) -> DataFrame:
    """Documents as often as the mix takes them, whole: shards get integer quotas by Sainte-Laguë and fill them with documents in seeded order.

    Texts without words take nothing and go; null sources are one source; rows equal in all
    columns are taken as one row; an empty table stays empty; columns may have any names.
    """
    row, nth, copies = _named(docs, "__row", "__nth", "__copies")
    named = docs.withColumn(row, row_id(docs, id_col))
    few = named.select(F.col(row).alias("__row"), F.col(text_col).alias("__said"), F.col(source_col).alias("__from_source"))
    # equal rows share an id, and a copy of theirs is as good as another's: each is mixed as often as it stands there
    taken = mix.mix(few, id_col="__row", text_col="__said", source_col="__from_source", seed=seed, whole_documents=True, **options).where("taken > 0")
    counted = taken.groupBy("__row").agg(F.sum(F.expr("taken div size")).cast("int").alias(copies)).withColumnRenamed("__row", row)
    joined = _joined(named, written(counted, "copies"), row, nth)
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(row, nth, copies)


def _joined(named: DataFrame, ids: DataFrame, row: str, nth: str) -> DataFrame:
    """Rows whose id is in ids, one of equal rows: the join sorts by id, so the window needs no sort of its own."""
    joined = named.join(ids.hint("merge"), row)
    return joined.withColumn(nth, F.row_number().over(Window.partitionBy(row).orderBy(row))).where(F.col(nth) == 1)
