"""Removal of repeated passages: a count-min prefilter, then exact groups of the windows it leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import _words as W
from quarry.llm._store import repeatable, written
from quarry.shipping import ship

_DEPTH = 2
_SLICES = 64
_HASH = np.dtype([("a", "<u8"), ("b", "<u8")])


def _cells(anchor: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = W.U64((1 << bits) - 1)
    return [((W.mix(anchor ^ W.U64(7 * d + 1)) >> W.U64(5)) & mask).astype(np.int64) for d in range(_DEPTH)]


def _chunked(batches: Iterator[pa.RecordBatch], key: int, wide: bool = False):
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        for a, b in W.chunks(text):
            yield batch.slice(a, b - a), W.Words(text.slice(a, b - a), W.SPACED, key=key, wide=wide)


def _sketch(bits: int, window: int, k: int, flush: int, key: int):
    """One partition's sketch as sparse slices: cells, with a low bit for those met more than once."""
    low = bits - (_SLICES.bit_length() - 1)

    def out(anchors: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        all_anchors = np.concatenate(anchors)
        for d, cell in enumerate(_cells(all_anchors, bits)):
            cell, count = np.unique(cell, return_counts=True)
            packed = ((cell & ((1 << low) - 1)) << 1 | (count > 1)).astype("<u4")
            edge = np.searchsorted(cell >> low, np.arange(_SLICES + 1))
            blobs = [packed[edge[s] : edge[s + 1]].tobytes() for s in range(_SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SLICES) + d * _SLICES, pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "cells"])

    def run(batches):
        held, size = [], 0
        for _, words in _chunked(batches, key):
            g, _, _, kept = W.winnow(words, k, window)
            held.append(g[kept])
            size += len(held[-1])
            if size >= flush:
                yield from out(held)
                held, size = [], 0
        if size:
            yield from out(held)

    return run


def _merge(bits: int):
    """Slices of all partitions together: which cells were met twice or more."""
    low = bits - (_SLICES.bit_length() - 1)

    def run(batches):
        once, twice = {}, {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(blob.as_buffer(), "<u4")
                cell = x >> np.uint32(1)
                if s not in once:
                    once[s], twice[s] = np.zeros(1 << low, bool), np.zeros(1 << low, bool)
                twice[s][cell[(x & np.uint32(1)).astype(bool) | once[s][cell]]] = True
                once[s][cell] = True
        for s, x in twice.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())], names=["slice", "cells"])

    return run


def _repeated(planes: np.ndarray, anchor: np.ndarray, bits: int) -> np.ndarray:
    """Whether the merged sketch estimates two or more."""
    yes = np.ones(len(anchor), bool)
    for d, cell in enumerate(_cells(anchor, bits)):
        yes &= (planes[d][cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
    return yes


def _witnesses(sent, bits: int, window: int, k: int, flush: int, bucket_bits: int, key: int):
    """Of each flush of windows estimated repeated: one witness of each to its bucket, and an index row that tells the replies apart.

    Windows that repeat within the flush are settled here and sent without a place,
    so that a bucket gets a frequent window once from each flush.
    """

    buckets = 1 << bucket_bits

    def out(part: int, number: int, held) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate([x[0] for x in held])
        ids = pa.concat_arrays([x[1] for x in held])
        keys = pa.concat_arrays([x[2] for x in held])
        counts = np.concatenate([x[4] for x in held])
        pos = np.concatenate([x[3] for x in held])
        order = np.argsort(hashes["a"], kind="stable")
        a, b = hashes["a"][order], hashes["b"][order]
        if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
            order = np.lexsort((hashes["b"], hashes["a"]))
            a, b = hashes["a"][order], hashes["b"][order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        multi = np.zeros(len(a), bool)
        multi[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
        lead = np.zeros(len(a), bool)
        lead[order] = np.concatenate(([True], ~same))
        bucket = (hashes["a"] >> W.U64(64 - bucket_bits)).astype("<u4")
        name = f"{part}:{number}"
        one, many = np.flatnonzero(~multi), np.flatnonzero(multi & lead)
        one, many = one[np.argsort(bucket[one], kind="stable")], many[np.argsort(bucket[many], kind="stable")]
        edge1, edge2 = (np.searchsorted(bucket[x], np.arange(buckets + 1)) for x in (one, many))
        used = [x for x in range(buckets) if edge1[x] < edge1[x + 1] or edge2[x] < edge2[x + 1]]
        cut = lambda x, e, i: hashes[x[e[i] : e[i + 1]]].tobytes()
        n = len(used)
        yield _batch([str(x) for x in used], [name] * n, used, [cut(one, edge1, i) for i in used], [cut(many, edge2, i) for i in used], [None] * n, [None] * n, [None] * n, [None] * n)
        settled = np.packbits(multi).tobytes()
        yield _batch([name], [name], [-1], [bucket.tobytes()], [settled], [ids.to_numpy(zero_copy_only=False).astype("<i8").tobytes()], [keys.to_numpy().astype("<i8").tobytes()], [counts.astype("<i8").tobytes()], [_runs(pos)])

    def run(batches):
        from pyspark import TaskContext

        planes, part, number, held, size = sent.value, TaskContext.get().partitionId(), 0, [], 0
        for batch, words in _chunked(batches, key, wide=True):
            if not len(words.hash):
                continue
            _, least, whole, _ = W.winnow(words, k, window)
            at = np.flatnonzero(whole)
            at = at[_repeated(planes, least[at], bits)]
            if not len(at):
                continue
            hashes = np.empty(len(at), _HASH)
            hashes["a"] = W.grams(words.hash, window)[at]
            hashes["b"] = W.grams(words.hash2, window, 0xD6E8FEB86659FD93)[at]
            row = np.searchsorted(words.row_end, at, "right")
            rows, counts = np.unique(row, return_counts=True)
            take = pa.array(rows)
            held.append((hashes, batch.column(0).take(take), batch.column(1).take(take), at - words.row_start[row], counts))
            size += len(at)
            if size >= flush:
                yield from out(part, number, held)
                number, held, size = number + 1, [], 0
        if size:
            yield from out(part, number, held)

    return run


def _runs(pos: np.ndarray) -> bytes:
    """Places as runs of consecutive ones: first and length."""
    first = np.flatnonzero(np.concatenate(([True], np.diff(pos) != 1)))
    return np.stack([pos[first], np.diff(np.append(first, len(pos)))]).astype("<i8").tobytes()


def _unruns(blob: bytes) -> np.ndarray:
    first, size = np.frombuffer(blob, "<i8").reshape(2, -1)
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


_SENT = "target string, flush string, bucket int, one binary, many binary, ids binary, keys binary, counts binary, runs binary"


def _batch(*columns) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _SENT.split(", ")])


def _replies(batches):
    """Rows come by bucket; each bucket's witnesses are grouped exactly, and each flush is told which of its own repeat elsewhere."""
    held: list[tuple[str, bytes, bytes]] = []
    now = None

    def answer() -> Iterator[pa.RecordBatch]:
        one = [np.frombuffer(x[1], _HASH) for x in held]
        every = np.concatenate([*one, *(np.frombuffer(x[2], _HASH) for x in held)])
        order = np.lexsort((every["b"], every["a"]))
        s = every[order]
        same = (s["a"][1:] == s["a"][:-1]) & (s["b"][1:] == s["b"][:-1])
        hit = np.zeros(len(s), bool)
        hit[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
        at = 0
        n = len(held)
        bits = []
        for x in one:
            bits.append(np.packbits(hit[at : at + len(x)]).tobytes())
            at += len(x)
        yield _batch([x[0] for x in held], [x[0] for x in held], [now] * n, bits, [None] * n, [None] * n, [None] * n, [None] * n, [None] * n)

    for batch in batches:
        passed = [i for i, x in enumerate(batch.column(2).to_pylist()) if x < 0]
        if passed:
            yield batch.take(pa.array(passed))
        for x in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            if x["bucket"] < 0:
                continue
            if x["bucket"] != now and held:
                yield from answer()
                held = []
            now = x["bucket"]
            held.append((x["flush"], x["one"], x["many"]))
    if held:
        yield from answer()


def _spans(window: int):
    """Rows come by flush, its index first: the spans of words to remove from each of its documents."""

    def settle(index: dict, bits: dict[int, bytes]) -> pa.RecordBatch:
        bucket = np.frombuffer(index["one"], "<u4")
        hit = np.unpackbits(np.frombuffer(index["many"], np.uint8), count=len(bucket)).astype(bool)
        one = np.flatnonzero(~hit)
        one = one[np.argsort(bucket[one], kind="stable")]
        for b in np.unique(bucket[one]).tolist():
            if b not in bits:
                raise RuntimeError("a flush lacks replies: the input's rows changed their order while they were read; write it first")
            lo, hi = np.searchsorted(bucket[one], [b, b + 1])
            mine = one[lo:hi]
            hit[mine] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=len(mine)).astype(bool)
        counts = np.frombuffer(index["counts"], "<i8")
        row, pos = np.repeat(np.arange(len(counts)), counts)[hit], _unruns(index["runs"])[hit]
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (pos[1:] > pos[:-1] + window))) if len(row) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1 if len(first) else first
        rows, begin = np.unique(row[first], return_index=True)
        ends = np.append(begin[1:], len(first)) if len(begin) else begin
        flat = np.stack([pos[first], pos[last] + window], axis=1).astype("<i8") if len(first) else np.zeros((0, 2), "<i8")
        return pa.RecordBatch.from_arrays(
            [pa.array(np.frombuffer(index["ids"], "<i8")[rows]), pa.array(np.frombuffer(index["keys"], "<i8")[rows]), pa.array([flat[a:b].tobytes() for a, b in zip(begin, ends, strict=True)], pa.binary())],
            names=["id", "key", "spans"],
        )

    def run(batches):
        index, bits = None, {}
        for batch in batches:
            for x in batch.to_pylist():
                if x["bucket"] < 0:
                    if index is not None:
                        yield settle(index, bits)
                    index, bits = x, {}
                elif index is None or index["flush"] != x["flush"]:
                    raise RuntimeError("replies without their flush: the input's rows changed their order while they were read; write it first")
                else:
                    bits[x["bucket"]] = x["one"]
        if index is not None:
            yield settle(index, bits)

    return run


def _kept(id_col: str):
    def run(batches):
        for batch in batches:
            n_words, n_removed, digest, kept_text = [], [], [], []
            for text, lists in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                keep = words
                if lists.is_valid:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for blob in lists.as_py():
                        spans = np.frombuffer(blob, "<i8").reshape(-1, 2)
                        np.add.at(gone, spans[:, 0], 1)
                        np.add.at(gone, spans[:, 1], -1)
                    keep = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                joined = b" ".join(keep)
                n_words.append(len(words))
                n_removed.append(len(words) - len(keep))
                digest.append(hashlib.sha256(joined).hexdigest())
                kept_text.append(joined)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.binary()).cast(pa.string())],
                names=[id_col, "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, k: int = 8,
    max_cell_bits: int = 28, flush: int = 1 << 20,
) -> DataFrame:
    """Each document without the words of windows that also start elsewhere.

    Words are separated by blanks, tabs, line feeds, vertical tabs, form feeds and
    carriage returns and compared as they stand. A window is window consecutive words
    of one document; if its word sequence starts anywhere else, in that document or
    another, all its words go.

    First pass: each partition counts in a count-min sketch. The sketch does not count
    windows themselves but, for each window, the smallest k-gram hash within it (as by
    winnowing, about one in 14 places), and a cell says none, one or more; a window occurs
    at most as often as that k-gram is met, so the merged sketches never underestimate.
    Second pass: only windows estimated at two or more are grouped by 128 bits of two
    hashes that share no state, under a key of the run. The sketch has four cells for each
    expected k-gram and at most 2**max_cell_bits in each of its two rows (1 bit a cell,
    64 MB at the default); beyond that more windows reach the second pass, and none is
    lost. Each flush of windows settles its own repeats and sends every window to its
    bucket once, so a frequent window costs a bucket one entry for each flush.

    Returns id_col, n_words, n_removed, kept_sha256, kept_text (kept words joined by
    one blank). Null, empty and shorter texts lose nothing; repeated rows repeat one
    another; other columns are ignored. Ids may be of any type that has a string form.

    The input is read three times, in the same order each time: what is not a selection
    from files is written to the shared folder first. A row's spans find it by hashes of
    its id and text; rows equal in both have equal spans.
    """
    spark = docs.sparkSession
    ship(spark)
    docs, key = repeatable(docs.select(id_col, text_col), "input"), W.new_key()
    known = F.xxhash64(F.col(id_col).cast("string"))
    table = docs.select(known.alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))
    total = docs.select(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()["n"] or 0
    bits = min(max_cell_bits, max(16, int(total * 0.05).bit_length()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    bucket_bits = min(20, max(8, (total >> 26).bit_length()))
    sketch = table.select("text").mapInArrow(_sketch(bits, window, k, flush, key), "slice int, cells binary")
    merged = sketch.repartition(parts, "slice").mapInArrow(_merge(bits), "slice int, cells binary")
    planes = np.zeros((_DEPTH, 1 << (bits - 3)), np.uint8)
    size = (1 << (bits - 3)) // _SLICES
    for s, blob in merged.collect():
        d, s = divmod(s, _SLICES)
        planes[d, s * size : (s + 1) * size] = np.frombuffer(blob, np.uint8)
    sent = spark.sparkContext.broadcast(planes)
    spans = (
        table.mapInArrow(_witnesses(sent, bits, window, k, flush, bucket_bits, key), _SENT)
        .repartition(parts, "target").sortWithinPartitions("bucket", "flush").mapInArrow(_replies, _SENT)
        .repartition(parts, "flush").sortWithinPartitions("flush", "bucket").mapInArrow(_spans(window), "id long, key long, spans binary")
    )
    spans = written(spans.groupBy("id", "key").agg(F.collect_set("spans").alias("spans")), "spans")
    own = docs.select(F.col(id_col).alias("__id"), known.alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))
    joined = own.join(spans.hint("shuffle_hash"), ["id", "key"], "left").select("__id", "text", "spans")
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, t) for c, t in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType())))])
    return joined.mapInArrow(_kept(id_col), out)
