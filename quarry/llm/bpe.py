"""Byte-level BPE of whole text columns: NumPy splits texts, batched merge rounds encode their distinct words."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import _words as W
from quarry.shipping import ship

#: Endings that are words of their own after an apostrophe which begins a word.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_BLANK, _SPACE, _LETTER, _NUMBER, _OTHER = range(5)
_NEVER = np.iinfo(np.int64).max
_LONG = 256
_WINDOW = 1 << 21
_KINDS = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}
_SPARK = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded": T.StringType(), "decoded_sha256": T.StringType()}


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes: printable ones for themselves, the others in turn by those from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tables of a byte-level BPE: bytes of each token, sorted pair keys with rank and merged token, special tokens.

    Takes the content of a tokenizers file, so only the driver reads it. Files with a
    normalizer, another splitting than the byte-level one, or special tokens that take
    in blanks around them are refused, and so are merges whose parts come later than
    themselves or tokens that two pairs make: merging all places of a word's best pair
    at once is the same as one by one only without those.
    """

    def __init__(self, content: bytes):
        self.digest = hashlib.sha256(content).hexdigest()
        spec = json.loads(content)
        split, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not plain or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError("not a plain byte-level BPE")
        alphabet, ids = byte_alphabet(), model["vocab"]
        self.size = max([*ids.values(), *(x["id"] for x in spec["added_tokens"])]) + 1
        tokens = [b""] * self.size
        for token, i in ids.items():
            tokens[i] = bytes(alphabet[c] for c in token)
        self.special: dict[bytes, int] = {}
        for x in spec["added_tokens"]:
            if any(x[k] for k in ("single_word", "lstrip", "rstrip")):
                raise ValueError(f"special token {x['content']!r} takes in what is around it")
            self.special[x["content"].encode()] = x["id"]
            tokens[x["id"]] = x["content"].encode()
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.of_byte[b] = ids[c]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(merges):
            if max(made.get(a, -1), made.get(b, -1)) >= rank or a + b in made or any(len(x) > 1 and x not in made for x in (a, b)):
                raise ValueError(f"merge {rank} comes before its parts or makes a token again")
            made[a + b] = rank
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        self.byte_rank = self.ranks(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256)).reshape(256, 256)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, by binary search; pairs that never merge have the largest."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NEVER)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The tokens' bytes, one after another."""
        size = self.length[ids]
        return self.flat[np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def merge_words(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words in one flat array, and where each word's ids begin (and end, by one entry more).

    Each round finds every word's lowest-ranked pair and merges it wherever the word has
    it, from the left; words without one leave. A word beyond 256 bytes takes as many
    rounds as it has different merges, so those go through a heap instead.
    """
    n = len(words)
    out: list[np.ndarray | None] = [None] * n
    for i, word in enumerate(words):
        if len(word) > _LONG:
            out[i] = np.array(_merge_long(v, [int(v.of_byte[b]) for b in word]), np.int64)
    short = np.array([i for i in range(n) if out[i] is None], np.int64)
    size = np.array([len(words[i]) for i in short.tolist()], np.int64)
    short, size = short[size > 0], size[size > 0]
    raw = np.frombuffer(b"".join(words[i] for i in short.tolist()), np.uint8)
    flat, word = v.of_byte[raw], np.repeat(np.arange(len(short)), size)
    rank = np.append(v.byte_rank[raw[:-1], raw[1:]], _NEVER)[: len(flat)]
    rank[np.cumsum(size) - 1] = _NEVER
    done_ids, done_words = [], []
    while len(flat):
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        best = np.minimum.reduceat(rank, first)
        lowest = np.repeat(best, np.diff(np.append(first, len(flat))))
        ready = lowest == _NEVER
        done_ids.append(flat[ready])
        done_words.append(word[ready])
        at = np.flatnonzero((rank == lowest) & ~ready)
        if not len(at):
            break
        # of places that overlap, as in "aaa", every second one
        run, step = np.append(True, np.diff(at) != 1), np.arange(len(at))
        at = at[(step - np.maximum.accumulate(np.where(run, step, 0))) % 2 == 0]
        flat[at] = v.merged[rank[at]]
        keep = ~ready
        keep[at + 1] = False
        at = np.cumsum(keep)[at] - 1
        flat, word, rank = flat[keep], word[keep], rank[keep]
        # only pairs with a new token have another rank
        mark = np.zeros(len(flat), bool)
        mark[at] = mark[at[at > 0] - 1] = True
        rank[mark] = _NEVER
        near = np.flatnonzero(mark[:-1])
        near = near[word[near] == word[near + 1]]
        rank[near] = v.ranks(flat[near], flat[near + 1])
    ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
    owner = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    counts = np.zeros(n, np.int64)
    counts[short] = np.bincount(owner, minlength=len(short))
    if len(short) < n:
        parts = np.split(ids[order], np.cumsum(counts[short])[:-1]) if len(short) else []
        for i, x in zip(short.tolist(), parts, strict=True):
            out[i] = x
        counts = np.array([0 if x is None else len(x) for x in out], np.int64)
        ids = np.concatenate([x for x in out if x is not None] or [np.zeros(0, np.int64)])
    else:
        ids = ids[order]
    return ids, np.append(0, np.cumsum(counts))


def _merge_long(v: Vocabulary, ids: list[int]) -> list[int]:
    """One long word: lowest-ranked, leftmost pair first, by a heap over linked places."""
    n = len(ids)
    arr = np.array(ids, np.int64)
    rank = v.ranks(arr[:-1], arr[1:])
    heap = [(int(rank[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(rank != _NEVER).tolist()]
    heapq.heapify(heap)
    after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
    known: dict[tuple[int, int], int] = {}

    def push(i: int, j: int) -> None:
        pair = (ids[i], ids[j])
        r = known.get(pair)
        if r is None:
            r = known[pair] = int(v.ranks(np.array([pair[0]]), np.array([pair[1]]))[0])
        if r != _NEVER:
            heapq.heappush(heap, (r, i, *pair))

    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i] = int(v.merged[r])
        gone[j] = 1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            push(i, after[j])
        if before[i] >= 0:
            push(before[i], i)
    return [x for i, x in enumerate(ids) if not gone[i]]


_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """The class of each code point; made once a process."""
    if not _classes:
        points = [*range(0xD800), *range(0xE000, 0x110000)]
        every, number = "".join(map(chr, points)), np.array(points)
        table = np.full(0x110000, _OTHER, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                table[number[m.start() : m.end()]] = kind
        table[0x20] = _BLANK
        _classes.append(table)
    return _classes[0]


def word_starts(raw: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Byte places where words begin; pieces: where texts or parts of texts begin, the first at 0.

    A word is a run of letters, of numbers or of other characters, with one blank before
    it if there is one; a run of white space up to its last character, if more follows; or
    one of ENDINGS behind an apostrophe that begins a word. Every byte belongs to a word.
    """
    wide = np.flatnonzero(raw >= 0xC0)
    table = char_classes()
    kind = table[raw] if not len(wide) else None
    if kind is None:
        place = np.flatnonzero((raw & 0xC0) != 0x80)
        lead = raw[place]
        kind = table[lead]
        where = np.flatnonzero(lead >= 0xC0)
        at, first = place[where], lead[where].astype(np.int32)
        follow = lambda k: (raw[np.minimum(at + k, len(raw) - 1)] & 0x3F).astype(np.int32)
        two = (first & 0x1F) << 6 | follow(1)
        three = (first & 0x0F) << 12 | follow(1) << 6 | follow(2)
        four = (first & 0x07) << 18 | follow(1) << 12 | follow(2) << 6 | follow(3)
        kind[where] = table[np.where(first < 0xE0, two, np.where(first < 0xF0, three, np.minimum(four, 0x10FFFF)))]
        char = np.searchsorted(place, pieces)
    else:
        place, lead, char = None, raw, pieces
    n = len(kind)
    begins = np.zeros(n + 1, bool)
    begins[char] = True
    begins = begins[:n]
    run = np.maximum(kind, _SPACE)
    start = begins.copy()
    start[1:] |= run[1:] != run[:-1]
    # a run behind white space takes its last character, or parts from it
    behind = np.flatnonzero(start[1:] & ~begins[1:] & (run[1:] != _SPACE) & (run[:-1] == _SPACE)) + 1
    start[behind - 1] = True
    start[behind[kind[behind - 1] == _BLANK]] = False
    quote = np.flatnonzero((lead == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~begins[quote + 1]]
    for ending in ENDINGS:
        at = quote[quote + len(ending) < n]
        for k, c in enumerate(ending, 1):
            at = at[(lead[at + k] == ord(c)) & ~begins[at + k]]
        start[at + 1] = False
        after = at + len(ending) + 1
        start[after[after < n]] = True
    found = np.flatnonzero(start)
    return found if place is None else place[found]


class Encoder:
    """Encodes ranges of rows; keeps the ids of words met before, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, specials: bool = True, most_words: int = 1 << 18, most_bytes: int = 1 << 24):
        self.v, self.most_words, self.most_bytes = vocabulary, most_words, most_bytes
        self.special = vocabulary.special if specials else {}
        self._find = regex.compile(b"|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._forget()

    def _forget(self) -> None:
        self.known: defaultdict[bytes, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.ids, self.at, self.held = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def _codes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most_words or self.held > self.most_bytes:
            self._forget()
        had = len(self.known)
        code = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(self.known) > had:
            fresh = np.flatnonzero(code >= had)
            new = [words[i] for i in fresh[np.unique(code[fresh], return_index=True)[1]].tolist()]
            ids, at = merge_words(self.v, new)
            self.ids, self.at = np.concatenate((self.ids, ids.astype(np.int32))), np.concatenate((self.at, at[1:] + self.at[-1]))
            self.held += sum(map(len, new))
        return code

    def _window(self, raw: np.ndarray, pieces: np.ndarray, special: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a window, and where each token begins; special: the token at a piece's place."""
        start = word_starts(raw, pieces)
        if special:
            at = np.array(sorted(special), np.int64)
            end = at + self.v.length[[special[i] for i in at.tolist()]]
            k = np.searchsorted(at, start, "right") - 1
            start = start[(k < 0) | (start == at[k]) | (start >= end[k])]
        data = raw.tobytes()
        bounds = [*start.tolist(), len(data)]
        code = self._codes([data[a:b] for a, b in pairwise(bounds)])
        count = self.at[code + 1] - self.at[code]
        begin = np.cumsum(count) - count
        ids = self.ids[np.repeat(self.at[code] - begin, count) + np.arange(count.sum())]
        if special:
            where = np.searchsorted(start, at)
            keep = np.ones(len(ids), bool)
            for w, i in zip(where.tolist(), at.tolist(), strict=True):
                ids[begin[w]] = special[i]
                keep[begin[w] + 1 : begin[w] + count[w]] = False
            ids = ids[keep]
        size = self.v.length[ids]
        return ids, np.cumsum(size) - size

    def rows(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, where each row's ids begin and the last end) for ranges of rows."""
        offsets = W._offsets(column)
        data = column.buffers()[2] if len(column) else None
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        for a, b in W.chunks(column):
            own = offsets[a : b + 1] - offsets[a]
            text = raw[offsets[a] : offsets[b]]
            pieces, special = own[:-1][own[:-1] < len(text)], {}
            if self._find is not None and len(text):
                edges = []
                blob = text.tobytes()
                for m in self._find.finditer(blob):
                    k = int(np.searchsorted(own, m.start(), "right"))
                    if m.end() <= own[k]:  # not put together from two rows
                        special[m.start()] = self.special[m.group()]
                        edges += [m.start(), m.end()]
                pieces = np.unique(np.concatenate((pieces, np.array([x for x in edges if x < len(text)], np.int64))))
            ids, begin = [], []
            for lo, hi in self._cuts(text, pieces):
                inner = pieces[(pieces >= lo) & (pieces < hi)] - lo
                x, at = self._window(text[lo:hi], np.unique(np.append(0, inner)), {k - lo: t for k, t in special.items() if lo <= k < hi} if special else {})
                ids.append(x)
                begin.append(at + lo)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            begin = np.concatenate(begin) if begin else np.zeros(0, np.int64)
            yield a, b, flat, np.searchsorted(begin, own)

    @staticmethod
    def _cuts(text: np.ndarray, pieces: np.ndarray) -> Iterator[tuple[int, int]]:
        """Windows of about 2 MB; they part where a piece begins or a blank follows what is no white space."""
        lo, n = 0, len(text)
        while lo < n:
            hi = min(n, lo + _WINDOW)
            while hi < n:
                ahead = text[hi - 1 : hi + _WINDOW]
                solid = (ahead[:-1] > 0x20) & (ahead[:-1] < 0x80)
                at = np.flatnonzero((ahead[1:] == 0x20) & solid)
                k = int(np.searchsorted(pieces, hi))
                blank = hi + int(at[0]) if len(at) else n
                piece = int(pieces[k]) if k < len(pieces) else n
                if min(blank, piece) < n or hi + _WINDOW >= n:
                    # a blank inside a special token is none to part at: pieces hold both its ends
                    hi = min(blank, piece)
                    break
                hi += _WINDOW
            yield lo, hi
            lo = hi


_encoders: dict[tuple, Encoder] = {}


def encoder_of(vocabulary: Vocabulary, specials: bool) -> Encoder:
    """This worker's encoder: words that earlier tasks met stay known."""
    key = (vocabulary.digest, specials)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary, specials)
    return _encoders[key]


def _coded(vocabulary, columns: tuple[str, ...], kind, specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        encoder = encoder_of(v, specials)
        for batch in batches:
            texts = batch.column(1)
            out: dict[str, list] = {c: [] for c in columns}
            flats = []
            for a, b, ids, at in encoder.rows(texts):
                ids = ids.astype("<u4")
                bounds = at.tolist()
                if "ids" in out:
                    flats.append((ids, np.diff(at)))
                if "n_tokens" in out:
                    out["n_tokens"] += np.diff(at).tolist()
                if "ids_sha256" in out:
                    out["ids_sha256"] += [hashlib.sha256(ids[i:j]).hexdigest() for i, j in pairwise(bounds)]
                if "decoded" in out or "decoded_sha256" in out:
                    for text in _texts(v, ids, bounds):
                        if "decoded" in out:
                            out["decoded"].append(text)
                        if "decoded_sha256" in out:
                            out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
            if "ids" in out:
                counts = np.concatenate([c for _, c in flats]) if flats else np.zeros(0, np.int64)
                values = np.concatenate([x for x, _ in flats]) if flats else np.zeros(0, "<u4")
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values.astype(np.int32)))
            arrays = [x if isinstance(x := out[c], pa.Array) else pa.array(x, _KINDS[c]) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[kind, *columns])

    return run


def _texts(v: Vocabulary, ids: np.ndarray, bounds: list[int]) -> Iterator[str]:
    step = 1 << 18
    if len(bounds) == 2 and bounds[1] > step:  # one long text
        parts = [v.bytes_of(ids[i : i + step]).tobytes() for i in range(0, len(ids), step)]
        yield b"".join(parts).decode("utf-8", "replace")
        return
    blob = v.bytes_of(ids).tobytes()
    place = np.append(0, np.cumsum(v.length[ids]))[bounds].tolist()
    for i, j in pairwise(place):
        yield blob[i:j].decode("utf-8", "replace")


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(f.read())


def encode(
    docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text",
    columns: tuple[str, ...] = ("ids", "n_tokens"), specials: bool = True,
) -> DataFrame:
    """Token ids of every whole text, as the vocabulary's own library gives them without added special tokens.

    columns: any of ids (array<int>), n_tokens, ids_sha256 (of the ids as little-endian
    unsigned 32-bit integers), decoded and decoded_sha256 (the text made from the ids
    again, bytes that are no UTF-8 replaced). specials: whether special tokens' strings in
    a text are those tokens.

    Rows are worked on where they lie, without a shuffle; only the vocabulary, a few MB of
    tables whatever the corpus, is broadcast. Words met before are kept up to a bound, so
    a task's memory depends on its longest text only. A null text counts as empty and has
    no tokens; repeated rows give equal rows; an empty table gives none; other columns are
    ignored, whatever their names; ids may be of any type and null.
    """
    spark = docs.sparkSession
    ship(spark)
    unknown = [c for c in columns if c not in _KINDS]
    if unknown or not columns:
        raise ValueError(f"columns must be of {sorted(_KINDS)}")
    sent = spark.sparkContext.broadcast(vocabulary)
    table = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    inner = T.StructType([T.StructField("__id", docs.schema[id_col].dataType), *(T.StructField(c, _SPARK[c]) for c in columns)])
    return table.mapInArrow(_coded(sent, tuple(columns), "__id", specials), inner).withColumnRenamed("__id", id_col)


def _decoded(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            out = []
            for ids in batch.column(1):
                flat = np.array([] if ids.as_py() is None else [x for x in ids.as_py() if x is not None], np.int64)
                out.append("".join(_texts(v, flat, [0, len(flat)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["__id", "__text"])

    return run


def decode(tokens: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The text of each row's token ids, special tokens by their strings; null or no ids give an empty text, null ids are skipped."""
    spark = tokens.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(vocabulary)
    inner = T.StructType([T.StructField("__id", tokens.schema[id_col].dataType), T.StructField("__text", T.StringType())])
    table = tokens.select(F.col(id_col).alias("__id"), F.col(ids_col).cast("array<long>").alias("__ids"))
    return table.mapInArrow(_decoded(sent), inner).select(F.col("__id").alias(id_col), F.col("__text").alias(text_col))
