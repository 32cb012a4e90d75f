"""Documents into content-addressed chunks."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.shipping import ship

# Where a text is parted, from coarse to fine.
SEPARATORS = ("\n## ", "\n\n", "\n", ". ", " ")
SECTION = re.compile(r"^(?=## )", re.MULTILINE)


def fixed_pieces(said: Column, size: int, overlap: int) -> Column:
    """Windows of size characters at a stride of size less overlap; native."""
    stride = size - min(overlap, size - 1)
    last = F.greatest(F.length(said) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda i: F.substring(said, i + 1, F.lit(size)))


def _runs(lengths: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges of units, each with what its joiner adds: as many from a range's start as fit size, one new one at least.

    Sums up to each unit are ascending, so where a range ends, and how far back from there
    the next one begins (whole units, as many as fit overlap), are two searches in them.
    """
    sums = [0, *itertools.accumulate(lengths)]
    start = end = 0
    while end < len(lengths):
        end = max(end + 1, bisect.bisect_right(sums, sums[start] + size) - 1)
        yield start, end
        start = max(start, min(end, bisect.bisect_left(sums, sums[end] - overlap)))


def _finer(piece: str, separator: str, size: int, overlap: int) -> list[str]:
    """A piece that is too long in ranges of its units, if separator parts it at all."""
    units = [u for u in piece.split(separator) if u.strip()]
    if len(piece) <= size or len(units) < 2:
        return [piece]
    joined = (separator.join(units[a:b]) for a, b in _runs([len(u) + len(separator) for u in units], size, overlap + len(separator)))
    return [x if len(x) <= size else x.strip() for x in joined]


def recursive_pieces(said: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most size characters: in one pass for each separator, coarse ones first, whatever is still too long is parted; windows at last."""
    pieces = [said.strip()]
    for separator in SEPARATORS:
        pieces = [x for piece in pieces for x in _finer(piece, separator, size, overlap)]
    stride = max(size - overlap, 1)
    windows = lambda x: [x] if len(x) <= size else [x[i : i + size] for i in range(0, len(x), stride)]
    return [x for piece in pieces if piece for x in windows(piece)]


def structural_pieces(said: str, size: int, overlap: int) -> list[str]:
    """A piece for each `## ` section, under what stands before the first; a section that is too long there is parted, each part under the same."""
    head, *sections = SECTION.split(said)
    if not sections:
        return recursive_pieces(said, size, overlap)
    lead = head.strip() and head.strip() + "\n\n"
    parted = lambda x: [x] if len(lead) + len(x) <= size else recursive_pieces(x, size, overlap)
    return [lead + piece for section in sections for piece in parted(section.strip())]


def passages(said: str, max_chars: int) -> list[str]:
    """Whole words packed greedily into passages of at most max_chars (a longer word stands alone)."""
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    words = said.split()
    return [" ".join(words[a:b]) for a, b in _runs([len(w) + 1 for w in words], max_chars + 1, 0)]


# White space as str.split() knows it.
WHITE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def pack(texts: pa.Array, max_chars: int) -> pa.ListArray:
    """passages() of a whole batch of texts whose words are one blank apart, in array operations only.

    Each word's next passage begins behind the last word that still fits, which is a search
    in the words' ends. Which words begin passages follows by jump tables: jumps of one
    passage, of two, of four and so on are joined until all have run out of their text.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    blank, full = np.flatnonzero(raw == 0x20), np.diff(offsets) > 0
    start, end = np.sort(np.concatenate((offsets[:-1][full], blank + 1))), np.sort(np.concatenate((offsets[1:][full], blank)))
    n = len(start)
    chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    row = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    after = np.maximum(np.searchsorted(chars[end], chars[start] + max_chars, "right"), np.arange(n) + 1)
    after = np.minimum(after, first[row + 1])
    jump = np.append(np.where(after < first[row + 1], after, n), n)
    begins = np.zeros(n + 1, bool)
    begins[first[:-1][full]] = True
    while (jump[:-1] < n).any():
        begins[jump[begins]] = True
        jump = jump[jump]
    piece = np.flatnonzero(begins[:n])
    stop = end[after[piece] - 1]
    keep = np.ones(len(raw), bool)
    keep[stop[stop < offsets[row[piece] + 1]]] = False  # the blanks between passages
    bounds = np.append(0, np.cumsum(stop - start[piece])).astype(np.int32)
    values = pa.StringArray.from_buffers(len(piece), pa.py_buffer(bounds), pa.py_buffer(raw[keep].tobytes()))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[piece], np.arange(len(texts) + 1)), pa.int32()), values)


def packed(said: Column, max_chars: int) -> Column:
    """passages() as a column: white space becomes blanks natively, batches are packed as arrays."""
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")

    @F.arrow_udf("array<string>")
    def pieces(texts: pa.Array) -> pa.Array:
        return pack(texts.cast(pa.string()), max_chars)

    return pieces(F.trim(F.regexp_replace(said, WHITE, " ")))


def _udf(split: Callable[..., list[str]], *options) -> Callable[[Column], Column]:
    @F.pandas_udf("array<string>")
    def pieces(said: pd.Series) -> pd.Series:
        return said.map(lambda x: split(x or "", *options))

    return pieces


STRATEGIES: dict[str, Callable[[Column, int, int], Column]] = {
    "structural": lambda c, size, overlap: _udf(structural_pieces, size, overlap)(c),
    "recursive": lambda c, size, overlap: _udf(recursive_pieces, size, overlap)(c),
    "fixed": fixed_pieces,
}


def chunk(docs: DataFrame, strategy: str = "structural", size: int = 512, overlap: int = 64, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """docs with chunk_id, doc_id, ordinal and the chunk's text; all other columns are carried along.

    Ordinals count pieces before blank ones are dropped. The id holds a digest of the
    text, so unchanged text keeps its id and changed text gets a new one.
    """
    if strategy not in STRATEGIES:
        raise KeyError(f"unknown chunking strategy {strategy!r}; have {sorted(STRATEGIES)}")
    ship(docs.sparkSession)
    pieces = STRATEGIES[strategy](F.coalesce(F.col(text_col), F.lit("")), size, overlap)
    rest = [c for c in docs.columns if c not in (text_col, id_col)]
    rows = docs.select(*rest, F.col(id_col).alias("doc_id"), F.posexplode(pieces).alias("ordinal", "__piece"))
    rows = rows.withColumn("text", text.strip(F.col("__piece"))).where("text <> ''").drop("__piece")
    return rows.withColumn("chunk_id", F.concat("doc_id", F.lit("#"), F.col("ordinal").cast("string"), F.lit(":"), F.substring(F.sha1("text"), 1, 12)))


def passage_rows(docs: DataFrame, max_chars: int = 600, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, passage and text: a row for each passage of a document."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), *keep, F.posexplode(packed(F.coalesce(F.col(text_col), F.lit("")), max_chars)).alias("passage", "text"))
