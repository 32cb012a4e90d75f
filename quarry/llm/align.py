"""Cross-tokenizer alignment: packed bitsets of token ends give shared cuts, token ranges and links."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm import _words as W
from quarry.llm._store import written
from quarry.llm.bpe import Vocabulary, encoder_of
from quarry.shipping import ship

_MARK = "▁"
_NAMES = ("n_a", "n_b", "n_groups", "n_links")


class Pieces:
    """A sentencepiece model: bytes of each piece, and texts encoded by their distinct stretches.

    If no piece holds a blank behind anything else than a blank, no piece runs over the
    place where a run of blanks begins. A text is then encoded stretch by stretch, each
    beginning with its blanks, and stretches met before are looked up; otherwise whole.
    """

    def __init__(self, model: bytes, most_known: int = 1 << 18, most_bytes: int = 1 << 24):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        n, names = self.model.get_piece_size(), self.model.id_to_piece
        text = lambda i: bytes([int(names(i)[3:-1], 16)]) if self.model.is_byte(i) else names(i).replace(_MARK, " ").encode()
        tokens = [text(i) for i in range(n)]
        self.size = n
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.parts = not any(b" " in t.lstrip(b" ") for t in tokens) and self.model.piece_to_id(_MARK) != self.model.unk_id()
        self.most_known, self.most_bytes = most_known, most_bytes
        self._forget()

    def _forget(self) -> None:
        self.known: defaultdict[bytes, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.ids, self.at, self.held = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def _encoded(self, stretch: bytes) -> list[int]:
        """Ids of a stretch that begins with a blank, which the model puts before every text but an empty one."""
        return self.model.encode(stretch[1:].decode(), num_threads=1) if len(stretch) > 1 else [self.model.piece_to_id(_MARK)]

    def encode(self, raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows' texts, each with a blank before it, and where each row's ids begin (and the last end)."""
        begins = np.zeros(len(raw) + 1, bool)
        begins[rows] = True
        start = np.flatnonzero(begins[:-1])
        if self.parts:
            blank = raw == 0x20
            start = np.flatnonzero((blank & ~np.append(False, blank[:-1])) | begins[:-1])
        data = raw.tobytes()
        stretches = [data[a:b] for a, b in pairwise([*start.tolist(), len(data)])]
        if len(self.known) > self.most_known or self.held > self.most_bytes:
            self._forget()
        had = len(self.known)
        code = np.fromiter(map(self.known.__getitem__, stretches), np.int64, len(stretches))
        if len(self.known) > had:
            fresh = np.flatnonzero(code >= had)
            new = [stretches[i] for i in fresh[np.unique(code[fresh], return_index=True)[1]].tolist()]
            found = [self._encoded(s) for s in new]
            self.ids = np.concatenate([self.ids, *(np.array(x, np.int32) for x in found)])
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum([len(x) for x in found])))
            self.held += sum(map(len, new))
        count = self.at[code + 1] - self.at[code]
        begin = np.cumsum(count) - count
        ids = self.ids[np.repeat(self.at[code] - begin, count) + np.arange(count.sum())]
        return ids, np.append(begin, len(ids))[np.searchsorted(start, rows)]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        return self.flat[np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class Bits:
    """A packed bitset over byte places with counts of the ones before each word of 64."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.append(0, np.cumsum(np.bitwise_count(words).astype(np.int64)))

    @classmethod
    def of(cls, places: np.ndarray, n: int) -> Bits:
        flags = np.zeros((n + 63) // 64 * 64, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many ones lie before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)

    def select(self) -> np.ndarray:
        """The places of all ones."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def aligned(a_ids, a_size, b_ids, b_size, row_end):
    """Groups and links of rows laid end to end: (cut places, A ends, B ends of groups, A token and B token of links).

    The tokens of both sides cover the same bytes. Ends of both sides' tokens are bits; AND
    leaves shared cuts, whose ranks are ends of token ranges; OR leaves the ends of all
    stretches that lie within one token of each side, one link each.
    """
    n = int(row_end[-1]) if len(row_end) else 0
    a, b = (Bits.of(np.cumsum(size) - 1, n) for size in (a_size, b_size))
    cuts = Bits(a.words & b.words).select()
    ends = Bits(a.words | b.words).select()
    return cuts, a.rank(cuts) + 1, b.rank(cuts) + 1, a.rank(ends), b.rank(ends), ends


class _Written:
    """Decimal ids with what follows them."""

    def __init__(self, n: int):
        self.table = np.array([[f"{i}{c}".encode() for i in range(n)] for c in (",", "|", ";", "")], object)

    def text(self, a_ids, b_ids, a_end, b_end) -> np.ndarray:
        """The groups' ids in order, A's before B's, each with its separator."""
        a_start, b_start = np.append(0, a_end[:-1]), np.append(0, b_end[:-1])
        a_group = np.repeat(np.arange(len(a_end)), a_end - a_start)
        b_group = np.repeat(np.arange(len(b_end)), b_end - b_start)
        out = np.empty(len(a_ids) + len(b_ids), object)
        kind = np.zeros(len(a_ids), np.int64)
        kind[a_end - 1] = 1
        out[np.arange(len(a_ids)) + b_start[a_group]] = self.table[kind, a_ids]
        kind = np.zeros(len(b_ids), np.int64)
        kind[b_end - 1] = 2
        out[np.arange(len(b_ids)) + a_end[b_group]] = self.table[kind, b_ids]
        return out


_pieces: dict[bytes, Pieces] = {}
_tables: dict[int, _Written] = {}


def _linked(sent, keep_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = sent.value
        encoder = encoder_of(vocabulary, False)
        digest = hashlib.sha256(model).digest()
        if digest not in _pieces:
            _pieces.clear()
            _pieces[digest] = Pieces(model)
        pieces = _pieces[digest]
        most = max(vocabulary.size, pieces.size)
        if most not in _tables:
            _tables[most] = _Written(most)
        table = _tables[most]
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            texts = batch.column(1)
            numbers, shas, groups, held = [], [], [], []
            for lo, hi, ids, at in encoder.rows(texts):
                column = texts.slice(lo, hi - lo)
                offsets = W._offsets(column)
                raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
                own, digests, written_groups, links = _range(vocabulary, pieces, table, raw, offsets - offsets[0], ids, at, keep_groups)
                row, pair, times = _cells(*links)
                held.append((row + sum(len(x) for x in numbers), pair, times))
                numbers.append(own)
                shas += digests
                groups += written_groups
            n = batch.num_rows
            stats = np.concatenate(numbers) if numbers else np.zeros((0, 4), np.int64)
            row, pair, times = (np.concatenate([x[k] for x in held]) if held else np.zeros(0, np.int64) for k in range(3))
            pairs, place = np.unique(pair, return_inverse=True)
            count = np.zeros(len(pairs), np.int64)
            np.add.at(count, place, times)
            width = np.min_scalar_type(max(len(pairs), int(times.max(initial=0)))).itemsize
            place, times, ptr = place.astype(f"<u{width}"), times.astype(f"<u{width}"), np.searchsorted(row, np.arange(n + 1)).tolist()
            fields = {
                "id": batch.column(0), **{c: pa.array(stats[:, k]) for k, c in enumerate(_NAMES)}, "groups_sha256": pa.array(shas, pa.string()), **({"groups": pa.array(groups, pa.string())} if keep_groups else {}),
                "width": pa.array(np.full(n, width, np.int32)), "cells": pa.array([place[i:j].tobytes() + times[i:j].tobytes() for i, j in pairwise(ptr)], pa.binary()),
            }
            chunk, names, none = part << 32 | number, ["chunk", *fields, "pair", "n"], lambda k: pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), *fields.values(), none(n), none(n)], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), chunk)), *(pa.nulls(len(pairs), x.type) for x in fields.values()), pa.array(pairs), pa.array(count)], names=names)

    return run


def _cells(row: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair and number of the links of each row and pair, in this order."""
    pairs, code = np.unique(pair, return_inverse=True)
    cell, times = np.unique(row * len(pairs) + code, return_counts=True)
    return cell // max(len(pairs), 1), pairs[cell % max(len(pairs), 1)], times


def _range(v: Vocabulary, pieces: Pieces, table: _Written, raw, rows, a_ids, a_at, keep_groups):
    """Numbers, digests and links (row, pair) of a range of rows; texts without tokens have none."""
    n = len(rows) - 1
    size = np.diff(rows)
    b_ids, b_at = pieces.encode(raw, rows) if len(raw) else (np.zeros(0, np.int32), np.zeros(n + 1, np.int64))
    a_row, b_row = np.repeat(np.arange(n), np.diff(a_at)), np.repeat(np.arange(n), np.diff(b_at))
    a_size, b_size = v.length[a_ids], pieces.length[b_ids]
    good = (np.bincount(a_row, a_size, n).astype(np.int64) == size) & (np.bincount(b_row, b_size, n).astype(np.int64) == size) & (size > 0)
    while True:
        keep_a, keep_b = good[a_row], good[b_row]
        ai, bi, al, bl = a_ids[keep_a], b_ids[keep_b], a_size[keep_a], b_size[keep_b]
        text = raw[np.repeat(good, size)]
        wrong = np.flatnonzero((v.bytes_of(ai) != text) | (pieces.bytes_of(bi) != text))
        end = np.cumsum(size[good])
        if not len(wrong):
            break
        good[np.flatnonzero(good)[np.searchsorted(end, wrong, "right")]] = False
    place = np.flatnonzero(good)
    stats = np.zeros((n, 4), np.int64)
    digests, groups = [""] * n, [""] * n
    if not len(place):
        return stats, digests, groups, (np.zeros(0, np.int64), np.zeros(0, np.int64))
    cuts, a_end, b_end, link_a, link_b, ends = aligned(ai, al, bi, bl, end)
    group_to, link_to = np.searchsorted(cuts, end), np.searchsorted(ends, end)
    a_to, b_to = np.append(0, a_end)[group_to], np.append(0, b_end)[group_to]
    for k, x in enumerate((a_to, b_to, group_to, link_to)):
        stats[place, k] = np.diff(np.append(0, x))
    written_ids = table.text(ai, bi, a_end, b_end).tolist()
    lo = 0
    for i, hi in zip(place.tolist(), (a_to + b_to).tolist(), strict=True):
        joined = b"".join(written_ids[lo:hi])[:-1]
        digests[i] = hashlib.sha256(joined).hexdigest()
        if keep_groups:
            groups[i] = joined.decode()
        lo = hi
    link_row = place[np.repeat(np.arange(len(place)), np.diff(np.append(0, link_to)))]
    return stats, digests, groups, (link_row, ai[link_a].astype(np.int64) * pieces.size + bi[link_b])


def _summed(docs: pa.Table, pairs: pa.Table, kind: pa.DataType) -> pa.Table:
    """The rows of a chunk with the sums over their links; pairs: all of the chunk, each once; kind: of the ids, whose times come in the session's zone."""
    pairs = pairs.sort_by("pair")
    total, best = (pairs[c].to_numpy().astype(np.int64) for c in ("total", "best"))
    sums = np.zeros((2, docs.num_rows), np.int64)
    for i, (width, cells) in enumerate(zip(docs["width"].to_pylist(), docs["cells"].to_pylist(), strict=True)):
        place, times = np.frombuffer(cells, f"<u{width}").reshape(2, -1)
        sums[:, i] = (times * best[place]).sum(), (times * total[place]).sum()
    docs = docs.drop_columns(["chunk", "width", "cells"])
    if docs["id"].type != kind:
        docs = docs.set_column(0, "id", docs["id"].cast(kind))
    return docs.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))


def align(
    docs: DataFrame, vocabulary: Vocabulary, model: bytes, *, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False,
) -> DataFrame:
    """How two tokenizers cut the same texts: vocabulary (A, byte-level BPE), model (B, a sentencepiece file's content).

    Both encode each text with a blank before it. Where tokens of both end, the bytes are
    cut into groups; a pair of an A and a B token whose bytes overlap is a link. Returns
    id_col, n_a, n_b, n_groups, n_links, groups_sha256, n_best (links whose pair of ids is
    the corpus's most frequent of its B id, ties included), count_sum (the corpus's number
    of links of each link's pair of ids, summed) and, with keep_groups, groups
    ("a1,a2|b1;a3|b2,b3").

    Null and empty texts, and those that either tokenizer does not give back byte by byte
    (B reads U+2581 as a blank), have no tokens: zeros and an empty groups_sha256. Special
    tokens' strings are plain text. Repeated rows count each; an empty table gives none;
    other columns are ignored, whatever their names; ids may be of any type and null.

    Every text is encoded once, in Arrow batches (8 MB of text, or one longer text). What a
    batch gives is stored in small rows: one a document, with its numbers and, as bytes, its
    distinct pairs by their places among the batch's and how often it has each; and one for
    each of the batch's pairs. So readers, sorts and shuffles hold as little as with texts.
    Pairs' rows are summed over the corpus, so a pair that is in every document costs a row
    a batch, and their counts come back to the batch by a cogroup. The best count of each B
    id is a table of at most the model's number of pieces.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((vocabulary, model))
    text = F.col(text_col).cast("string")
    table = docs.select(F.col(id_col).alias("id"), F.when(F.length(text) > 0, F.concat(F.lit(" "), text)).otherwise("").alias("text"))
    kind = docs.schema[id_col].dataType
    fields = [T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in _NAMES), T.StructField("groups_sha256", T.StringType()), *([T.StructField("groups", T.StringType())] if keep_groups else [])]
    long = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    stored = T.StructType([*long("chunk"), *fields, T.StructField("width", T.IntegerType()), T.StructField("cells", T.BinaryType()), *long("pair", "n")])
    both = written(table.mapInArrow(_linked(sent, keep_groups), stored), "links")
    rows, each = both.where("pair IS NULL").drop("pair", "n"), both.where("pair IS NOT NULL").select("chunk", "pair", "n")
    pieces = Pieces(model).size
    totals = written(each.groupBy("pair").agg(F.sum("n").alias("total")), "pairs")
    b = F.pmod(F.col("pair"), F.lit(pieces))
    highest = F.broadcast(totals.groupBy(b.alias("b")).agg(F.max("total").alias("highest")))  # one row a piece of the model at most
    judged = totals.join(highest, b == F.col("b")).select("pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    back = each.select(F.col("chunk").alias("of"), "pair").join(judged, "pair")
    ids = to_arrow_type(kind)
    out = T.StructType([*fields, *long("n_best", "count_sum")])
    return rows.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(lambda docs, pairs: _summed(docs, pairs, ids), out).withColumnRenamed("id", id_col)
