"""Benchmark decontamination by winnowing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import _words as W
from quarry.llm._store import repeatable
from quarry.shipping import ship

_OUT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hit_spans")


class _Block:
    """Fingerprints of some benchmark items, small enough to be sent to every executor.

    Words are hashed under a key of the run. Whatever hashes find equal is compared byte
    by byte before it counts; should two different words have one hash, the task fails
    rather than report a hit that is none.
    """

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int, k: int):
        self.key = W.new_key()
        words = self.words = self.split(pa.array(texts, pa.string()))
        self.window, self.k, self.ids, self.hash = window, k, ids, words.hash
        self.row = np.repeat(np.arange(len(ids)), words.counts())
        self.first = np.repeat(words.row_start, words.counts())
        self.last = np.repeat(words.row_end, words.counts())
        g, _, _, kept = W.winnow(words, k, window)
        at = np.flatnonzero(kept)
        order = np.argsort(g[at], kind="stable")
        self.at = at[order]
        self.print, self.begin = np.unique(g[self.at], return_index=True)
        self.count = np.diff(np.append(self.begin, len(self.at)))
        self.short: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        n = words.counts()
        for size in np.unique(n[(n > 0) & (n < window)]).tolist():
            rows = np.flatnonzero(n == size)
            h = W.grams(self.hash, size)[words.row_start[rows]]
            order = np.argsort(h, kind="stable")
            values, begin = np.unique(h[order], return_index=True)
            rows = rows[order]
            lead = rows[begin][np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(rows))))]
            self._check(words, words.row_start[rows], words.row_start[lead], size)
            self.short[size] = values, np.split(rows, begin[1:])
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.print & W.U64(len(self.seen) - 1)).astype(np.int64)] = True

    def split(self, text: pa.Array) -> W.Words:
        return W.Words(text, W.ALNUM, W.LOWER, spans=True, key=self.key)

    def _check(self, words: W.Words, at: np.ndarray, there: np.ndarray, size: np.ndarray | int) -> None:
        """Runs of size words from these places must be those of the items from there."""
        size = np.broadcast_to(size, at.shape)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        if not words.agree(np.repeat(at, size) + step, self.words, np.repeat(there, size) + step):
            raise RuntimeError("two different words have one hash under the key of this run; run again, under another")

    def hits(self, words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Spans of hit words (start, end) and pairs (row, item)."""
        starts, ends, rows, items = [], [], [], []
        n = words.counts()
        row_of = np.repeat(np.arange(len(n)), n)
        if len(self.print):
            g, _, _, kept = W.winnow(words, self.k, self.window)
            at = np.flatnonzero(kept)
            at = at[self.seen[(g[at] & W.U64(len(self.seen) - 1)).astype(np.int64)]]
            place = np.minimum(np.searchsorted(self.print, g[at]), len(self.print) - 1)
            same = self.print[place] == g[at]
            at, place = at[same], place[same]
            p = np.repeat(at, self.count[place])
            ahead = np.arange(len(p)) - np.repeat(np.cumsum(self.count[place]) - self.count[place], self.count[place])
            q = self.at[np.repeat(self.begin[place], self.count[place]) + ahead]
            s, e, whole = self._extend(words, row_of, p, q)
            self._check(words, s[whole], (q - p + s)[whole], (e - s)[whole])
            starts.append(s[whole])
            ends.append(e[whole])
            rows.append(row_of[p[whole]])
            items.append(self.row[q[whole]])
        for size, (values, owners) in self.short.items():
            h = W.grams(words.hash, size)
            inside = np.arange(len(h)) + size <= words.row_end[row_of[: len(h)]]
            place = np.minimum(np.searchsorted(values, h), len(values) - 1)
            at = np.flatnonzero(inside & (values[place] == h))
            self._check(words, at, self.words.row_start[np.array([x[0] for x in owners])[place[at]]], size)
            starts.append(at)
            ends.append(at + size)
            for x in np.unique(place[at]).tolist():
                where = np.unique(row_of[at[place[at] == x]])
                rows.append(np.repeat(where, len(owners[x])))
                items.append(np.tile(owners[x], len(where)))
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return join(starts), join(ends), join(rows), join(items)

    def _extend(self, words, row_of, p, q):
        """The shared run around each pair of equal k-grams, as far as windows with that k-gram reach."""
        lo, hi = words.row_start[row_of[p]], words.row_end[row_of[p]]
        more, left, right = np.ones(len(p), bool), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        for t in range(self.k):  # two different k-grams could have one hash
            more &= words.hash[p + t] == self.hash[q + t]
        equal = more.copy()
        for t in range(1, self.window - self.k + 1):
            a, b = p - t, q - t
            more &= (a >= lo) & (b >= self.first[q])
            more &= words.hash[np.maximum(a, 0)] == self.hash[np.maximum(b, 0)]
            left += more
        more = equal.copy()
        for t in range(self.k, self.window):
            a, b = p + t, q + t
            more &= (a < hi) & (b < self.last[q])
            more &= words.hash[np.minimum(a, len(words.hash) - 1)] == self.hash[np.minimum(b, len(self.hash) - 1)]
            right += more
        return p - left, p + self.k + right, equal & (left + self.k + right >= self.window)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, k: int, block_bytes: int) -> Iterator[_Block]:
    ids, texts, size = [], [], 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator(prefetchPartitions=True):
        ids.append(item)
        texts.append(text)
        size += 4 * len(text or "")
        if size >= block_bytes:
            yield _Block(ids, texts, window, k)
            ids, texts, size = [], [], 0
    if ids:
        yield _Block(ids, texts, window, k)


def _rows(key: pa.Array, other: list, n, starts, ends, rows, items, names) -> list[pa.Array]:
    """names: the items' ids by number."""
    bounds = np.concatenate(([0], np.cumsum(n)))
    edge = np.zeros(bounds[-1] + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    hit = np.cumsum(edge[:-1]) > 0
    total = np.concatenate(([0], np.cumsum(hit)))
    n_hit = total[bounds[1:]] - total[bounds[:-1]]
    begin = hit & ~np.concatenate(([False], hit[:-1]))
    close = hit & ~np.concatenate((hit[1:], [False]))
    first = np.unique(bounds[:-1][n > 0])
    if len(first):  # a span ends with its row
        begin[first] = hit[first]
        last = bounds[1:][n > 0] - 1
        close[last] = hit[last]
    s, e = np.flatnonzero(begin), np.flatnonzero(close) + 1
    owner = np.searchsorted(bounds, s, "right") - 1
    found: list[set[str]] = [set() for _ in range(len(n))]
    for pair in np.unique(rows * (len(names) or 1) + items).tolist():
        row, item = divmod(pair, len(names))
        if names[item] is not None:
            found[row].add(names[item])
    lists = [sorted(x) for x in found]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owner, np.arange(len(n) + 1)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(s - bounds[owner], pa.int64()), pa.array(e - bounds[owner], pa.int64())], ["start", "end"]),
    )
    return [
        key, *other, pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in lists], pa.int64()),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]), pa.array(n_hit > 0), pa.array(lists, pa.list_(pa.string())), spans,
    ]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 10, k: int = 5, block_bytes: int = 32 << 20,
) -> DataFrame:
    """Words of each document that lie in a window of a benchmark item.

    Words are runs of ASCII digits, ASCII letters (lower-cased) and characters
    beyond ASCII. A window is window consecutive words of an item; an item with fewer
    is one window. Both sides keep the smallest k-gram hashes of each window
    (winnowing), so a shared window always has a kept k-gram in common; each pair of
    equal k-grams is extended word by word and counts if the shared run reaches
    window words. Items shorter than that are matched as whole k-grams.

    The benchmark is the query set: it is read in blocks of about block_bytes, each
    sent to all executors and held against all documents; spans and items of several
    blocks are united by document. Nothing else is broadcast, and no documents move.

    Returns id_col, n_words, n_hit, n_items, items_sha256, contaminated, items,
    hit_spans (word positions). Null and empty texts have no words, an empty
    benchmark hits nothing, null item ids hit but are not listed, repeated item ids
    count once, repeated documents get a row each. Other columns are ignored.
    """
    session = docs.sparkSession
    ship(session)
    key = T.StructField(id_col, docs.schema[id_col].dataType)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = dict(zip(_OUT, (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType(), T.ArrayType(T.StringType()), span), strict=True))
    out = T.StructType([key, *(T.StructField(c, t) for c, t in kinds.items())])
    table = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    found = []
    for number, block in enumerate(_blocks(benchmark, item_col, item_text_col, window, k, block_bytes)):
        if number == 1 and (known := repeatable(table, "input")) is not table:
            # rows are numbered by their order, which only files repeat
            table, found = known, [known.mapInArrow(_scan(sent, id_col), out)]
        sent = session.sparkContext.broadcast(block)
        found.append(table.mapInArrow(_scan(sent, id_col), out))
    if not found:
        found.append(table.mapInArrow(_scan(None, id_col), out))
    return found[0] if len(found) == 1 else _united(found, id_col)


def _scan(sent, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value if sent is not None else _Block([], [], 10, 5)
        for batch in batches:
            text = batch.column(1)
            for a, b in W.chunks(text):
                words = block.split(text.slice(a, b - a))
                columns = _rows(batch.column(0).slice(a, b - a), [], words.counts(), *block.hits(words), block.ids)
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *_OUT])

    return run


def _united(found: list[DataFrame], id_col: str) -> DataFrame:
    """Several blocks: each document's spans and items together, one row for each block."""
    # the same scan in the same order numbers the rows alike in every block
    parts = [x.withColumn("__row", F.monotonically_increasing_id()) for x in found]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    flat = rows.groupBy("__row").agg(
        F.first(id_col).alias(id_col),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("hit_spans"))).alias("__s"),
    )
    merged = F.expr(
        "aggregate(__s, cast(array() as array<struct<start:bigint,end:bigint>>), (acc, x) -> case"
        " when size(acc) = 0 or x.start > element_at(acc, -1).end then concat(acc, array(x))"
        " else concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))) end)"
    )
    flat = flat.withColumn("hit_spans", merged).withColumn("n_hit", F.expr("aggregate(hit_spans, 0L, (n, x) -> n + x.end - x.start)"))
    return flat.select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "hit_spans",
    )
