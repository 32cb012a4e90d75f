"""Source divergence audit: terms by a byte table, exact counts by Spark, distances of sources from sparse blocks."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import _words as W
from quarry.llm._store import written
from quarry.shipping import ship

#: Bytes of terms: ASCII letters and every byte of a character beyond ASCII.
TERM = np.ones(256, bool)
TERM[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False

_SCALE = 1_000_000_000
_PRIOR = 5
_WINDOW = 1 << 20
_SIDE = 512
_CELL = 4096
_BEST = 50
_PARTIAL = "lang string, source string, term string, n long, docs long"
_FOUND = "lang string, part string, i int, j int, term string, value long"


def grouped(data: bytes, start: np.ndarray, end: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """The number of each slice's group of equal slices, and a slice of each group.

    Slices are grouped by their hash, then compared byte by byte with the first of their
    group; should two differ, all are grouped by their bytes themselves.
    """
    slices = [data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    h = np.fromiter(map(digest, slices), np.uint64, len(slices))
    _, first, code = np.unique(h, return_index=True, return_inverse=True)
    size = end - start
    chief = first[code]
    same = bool((size == size[chief]).all())
    if same:
        eight = np.ndarray((len(data) + 1,), "<u8", np.frombuffer(data + b"\0" * 8, np.uint8), strides=(1,))
        live, at = np.flatnonzero(chief != np.arange(len(chief))), 0
        while same and len(live):
            mask = W.U64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(size[live] - at, 8)) * 8).astype(W.U64)
            same = not ((eight[start[live] + at] ^ eight[start[chief[live]] + at]) & mask).any()
            at += 8
            live = live[size[live] > at]
    if same:
        return code, [slices[i] for i in first.tolist()]
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    return np.fromiter(map(known.__getitem__, slices), np.int64, len(slices)), list(known)


def _counted(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]]:
    """(row, term number, terms, occurrences) of the terms of each row, for windows of rows; a long row comes at once."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _WINDOW, "right")) - 1)
        lo, hi = int(offsets[a]), int(offsets[b])
        if b > a + 1 or hi - lo <= 2 * _WINDOW:
            start, end = _bounds(raw[lo:hi], offsets[a : b + 1] - lo)
            if len(start):
                code, terms = grouped(W.LOWER[raw[lo:hi]].tobytes(), start, end)
                row = np.searchsorted(offsets[a : b + 1] - lo, start, "right") - 1
                key, count = np.unique(row * len(terms) + code, return_counts=True)
                yield key // len(terms) + a, key % len(terms), terms, count
        else:
            total: Counter[bytes] = Counter()
            while lo < hi:
                end = min(hi, lo + _WINDOW)
                while end < hi and TERM[raw[end]]:
                    end += 1
                part = raw[lo:end]
                s, e = _bounds(part, np.array([0, len(part)]))
                if len(s):
                    code, terms = grouped(W.LOWER[part].tobytes(), s, e)
                    total.update(dict(zip(terms, np.bincount(code, minlength=len(terms)).tolist(), strict=True)))
                lo = end
            if total:
                yield np.full(len(total), a), np.arange(len(total)), list(total), np.fromiter(total.values(), np.int64, len(total))
        a = b


def _bounds(raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms start and end; none runs from one row into the next."""
    inside = TERM[raw]
    begins = np.zeros(len(raw) + 1, bool)
    begins[rows] = True
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    return np.flatnonzero(inside & (~before | begins[:-1])), np.flatnonzero(inside & (~after | begins[1:])) + 1


def _partial(most: int):
    """Counts of a task's terms by group; sums are sent on when over most have gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        terms: defaultdict[bytes, int] = defaultdict()
        terms.default_factory = terms.__len__
        held: list[np.ndarray] = []

        def summed() -> np.ndarray:
            """key, n, docs in columns, one for each group and term."""
            rows = np.concatenate(held, axis=1)
            rows = rows[:, np.argsort(rows[0], kind="stable")]
            first = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
            return np.stack([rows[0, first], np.add.reduceat(rows[1], first), np.add.reduceat(rows[2], first)])

        def sent() -> Iterator[pa.RecordBatch]:
            key, n, docs = summed()
            names, words = list(groups), list(terms)
            for a in range(0, len(key), 1 << 14):
                group, term = key[a : a + (1 << 14)] >> 40, key[a : a + (1 << 14)] & ((1 << 40) - 1)
                pairs = [names[g] for g in group.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), pa.array([words[t] for t in term.tolist()], pa.binary()).cast(pa.string()),
                     pa.array(n[a : a + (1 << 14)]), pa.array(docs[a : a + (1 << 14)])], names=["lang", "source", "term", "n", "docs"],
                )
            groups.clear()
            terms.clear()
            held.clear()

        for batch in batches:
            mine = np.fromiter((groups.setdefault(g, len(groups)) for g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)), np.int64, batch.num_rows)
            if not len(mine):
                continue
            g, docs = np.unique(mine, return_counts=True)
            held.append(np.stack([(g << 40) + terms[b""], np.zeros(len(g), np.int64), docs]))
            texts = batch.column(0)
            offsets = W._offsets(texts)
            data = texts.buffers()[2]
            raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
            for row, code, words, count in _counted(raw, offsets - offsets[0]):
                number = np.fromiter(map(terms.__getitem__, words), np.int64, len(words))
                held.append(np.stack([(mine[row] << 40) + number[code], count, np.ones(len(row), np.int64)]))
                if sum(x.shape[1] for x in held) > most:
                    held[:] = [summed()]
            if held and sum(x.shape[1] for x in held) > most // 2:
                yield from sent()
        if held:
            yield from sent()

    return run


def _cell(frame: pd.DataFrame) -> pd.DataFrame:
    """What a block of a language's terms adds to the distances of two blocks of its sources, and each source's best terms.

    Rows without a term name the sources, with p of an absent term. The block is a sparse
    matrix of sources by terms; of each source, all entries of the others are compared
    with its own row at once, and their excess over absent terms is summed by row.
    """
    lang, a, b = frame["lang"].iat[0], int(frame["a"].iat[0]), int(frame["b"].iat[0])
    named = frame["term"].isna()
    sources = frame[named].sort_values("gid")
    ids, absent = sources["gid"].to_numpy(np.int64), sources["p"].to_numpy(np.int64)
    entries = frame[~named]
    column, terms = pd.factorize(entries["term"])
    row = np.searchsorted(ids, entries["gid"].to_numpy(np.int64))
    order = np.lexsort((column, row))
    row, column = row[order], column[order].astype(np.int64)
    p, q = entries["p"].to_numpy(np.int64)[order], entries["q"].to_numpy(np.int64)[order]
    bounds = np.searchsorted(row, np.arange(len(ids) + 1))
    filled = np.flatnonzero(np.diff(bounds))
    left = ids // _SIDE == a
    right = ids // _SIDE == b
    out_i, out_j, out_v = [], [], []
    baseline = absent[row]
    for i in np.flatnonzero(left).tolist():
        own_columns, own = column[bounds[i] : bounds[i + 1]], p[bounds[i] : bounds[i + 1]]
        dense = np.full(len(terms), absent[i], np.int64)
        dense[own_columns] = own
        excess = np.zeros(len(ids), np.int64)
        if len(filled):
            against = dense[column]
            excess[filled] = np.add.reduceat(np.abs(p - against) - np.abs(baseline - against), bounds[filled])
        # terms of this source alone, by its sorted values' prefix sums
        ranked = np.sort(own)
        prefix = np.append(0, np.cumsum(ranked))
        k = np.searchsorted(ranked, absent)
        excess += absent * k - prefix[k] + (prefix[-1] - prefix[k]) - absent * (len(own) - k) - len(own) * np.abs(absent - absent[i])
        others = np.flatnonzero(right & (ids > ids[i]))
        out_i.append(np.full(len(others), ids[i]))
        out_j.append(ids[others])
        out_v.append(excess[others])
    found = [pd.DataFrame({"part": "pair", "i": np.concatenate(out_i), "j": np.concatenate(out_j), "term": None, "value": np.concatenate(out_v)})] if out_i else []
    if a == b and len(p):
        more = np.flatnonzero(p > q)
        place = np.empty(len(terms), np.int64)
        place[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
        more = more[np.lexsort((place[column[more]], q[more] - p[more], row[more]))]
        first = np.searchsorted(row[more], row[more])
        more = more[np.arange(len(more)) - first < _BEST]
        found.append(pd.DataFrame({"part": "term", "i": ids[row[more]], "j": -1, "term": np.asarray(terms, object)[column[more]], "value": p[more] - q[more]}))
    out = pd.concat(found) if found else pd.DataFrame({"part": [], "i": [], "j": [], "term": [], "value": []})
    out.insert(0, "lang", lang)
    return out


def divergence(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, flush: int = 1 << 18,
) -> DataFrame:
    """How far apart the sources of each language are, and which terms set each source off.

    Terms are runs of ASCII letters and characters beyond ASCII, A to Z lower-cased; a
    language keeps those in at least least_docs of its documents. A source's share of a
    kept term is smoothed by five occurrences and scaled to whole numbers, so all values
    are exact. Returns lang, source, part, item, value, rank: part "pair" has the sum of
    differences to every other source of the language; part "term" has up to 50 terms
    whose share is above the language's, by their difference. Ranks go by value
    descending, then item by code point.

    Null text, language and source count as empty; a source without kept terms has pairs
    but no terms, and distances of 0 where its language keeps none; repeated rows count
    each; an empty table gives no rows; other columns are ignored, whatever their names.

    Each task sums its terms before they are shuffled, so a frequent term or a source of a
    third of all rows costs a row a task and group. Distances are computed in cells of about
    4,096 sparse entries, dealt by a hash of the term and by pairs of blocks of 512 sources;
    no task holds a language or a source.
    """
    spark = docs.sparkSession
    ship(spark)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    table = docs.select(empty(text_col).alias("__text"), empty(lang_col).alias("__lang"), empty(source_col).alias("__source"))
    partial = table.mapInArrow(_partial(flush), _PARTIAL)
    counts = written(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("in_docs")).where(F.col("in_docs") >= least_docs).drop("in_docs")
    entries = written(counts.where("term <> ''").drop("docs").join(kept, ["lang", "term"]), "entries")
    # totals of sources and languages: as many rows as there are sources, written so that Spark sees their size before it chooses a join
    terms = entries.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all_n"))
    by_source = entries.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count("*").alias("own_entries"))
    groups = counts.where("term = ''").select("lang", "source").join(by_source, ["lang", "source"], "left").join(terms, "lang", "left")
    in_lang = Window.partitionBy("lang")
    groups = groups.select(
        "lang", "source", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("own_n", "v", "all_n")), (F.row_number().over(in_lang.orderBy("source")) - 1).alias("gid"),
        F.ceil(F.count("*").over(in_lang) / _SIDE).cast("int").alias("sides"), F.sum(F.coalesce("own_entries", F.lit(0))).over(in_lang).alias("nnz"), F.count("*").over(in_lang).alias("s"),
    )
    # a cell has 4,096 entries or more than half as many as it has pairs of sources
    cell = F.greatest(F.lit(_CELL), F.pow(F.least(F.col("s"), F.lit(_SIDE)), F.lit(2)).cast("long")) * F.col("sides")
    groups = written(groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("nnz") / cell)).cast("int")), "sources")
    share = lambda n, own: F.expr(f"CASE WHEN v > 0 THEN 1 + (cast({_SCALE} AS decimal(18,0)) * cast({n} + {_PRIOR} AS decimal(19,0))) DIV ({own} + {_PRIOR} * v) ELSE 1 END")
    other = F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("o")
    sides = (F.least(F.col("side"), F.col("o")).alias("a"), F.greatest(F.col("side"), F.col("o")).alias("b"))
    side = F.floor(F.col("gid") / _SIDE).cast("int").alias("side")
    sparse = entries.join(groups, ["lang", "source"]).select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "gid", side, "term", share("n", "own_n").alias("p"), share("total", "all_n").alias("q"), other)
    marks = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("lang", "block", "gid", side, F.lit(None).cast("string").alias("term"), share("0", "own_n").alias("p"), F.lit(0).cast("long").alias("q"), other)
    cells = sparse.unionByName(marks).select("lang", "block", "gid", "term", "p", "q", *sides)
    found = written(cells.groupBy("lang", "block", "a", "b").applyInPandas(_cell, _FOUND), "distances")
    absent = groups.select("lang", F.col("gid"), "source", "v", share("0", "own_n").alias("p"))
    one, two = (absent.select("lang", F.col("gid").alias(k), F.col("source").alias(f"source_{k}"), F.col("p").alias(f"p_{k}"), *(["v"] if k == "i" else [])) for k in "ij")
    pairs = found.where("part = 'pair'").groupBy("lang", "i", "j").agg(F.sum("value").alias("value")).join(one, ["lang", "i"]).join(two, ["lang", "j"])
    pairs = pairs.select("lang", "source_i", "source_j", (F.col("value") + F.col("v") * F.abs(F.col("p_i") - F.col("p_j"))).alias("value"))
    both = F.explode(F.array(F.struct(F.col("source_i").alias("source"), F.col("source_j").alias("item")), F.struct(F.col("source_j").alias("source"), F.col("source_i").alias("item")))).alias("x")
    pairs = pairs.select("lang", both, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    best = found.where("part = 'term'").join(one, ["lang", "i"]).select("lang", F.col("source_i").alias("source"), "part", F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = lambda rows: rows.withColumn("rank", rank)
    return ranked(pairs).unionByName(ranked(best).where(F.col("rank") <= _BEST))
