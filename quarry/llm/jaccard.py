"""Exact Jaccard self-join on word shingles by signature trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import _words as W
from quarry.llm._store import written
from quarry.llm.components import components
from quarry.shipping import ship

_LEAF = 32
_FAN = 4


def need(n: int, m: int, percent: int) -> int:
    """The least intersection with which sets of n and m link: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of a set of n with any set that it links to."""
    return -(-percent * n // 100)


def _sets(words: W.Words, k: int) -> Iterator[np.ndarray]:
    """Sorted shingle hashes of each row; a row of fewer than k words is one shingle."""
    g = W.grams(words.hash, k)
    for a, b in zip(words.row_start.tolist(), words.row_end.tolist(), strict=True):
        if b - a >= k:
            yield np.unique(g[a : b - k + 1])
        elif b > a:
            yield W.grams(words.hash[a:b], b - a)[:1]
        else:
            yield g[:0]


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _describe(id_name: str, k: int, key: int):
    def run(batches):
        for batch in batches:
            text = batch.column(1)
            for a, b in W.chunks(text):
                sets = list(_sets(W.Words(text.slice(a, b - a), W.SPACED, W.LOWER, key=key), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), pa.array([_digest(x) if len(x) else None for x in sets], pa.binary())],
                    names=[id_name, "n_shingles", "digest"],
                )

    return run


# Many sets travel as one row: for each bucket, sets' digests and sizes, how many tokens each has there, and the tokens.
_PACK = "bucket int, digests binary, sizes binary, counts binary, tokens binary, freqs binary"


def _pack(buckets, digests, sizes, counts, tokens, freqs=None) -> pa.RecordBatch:
    columns = [buckets, digests, sizes, counts, tokens, freqs or [None] * len(buckets)]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 0 else pa.binary()) for i, x in enumerate(columns)], names=[x.split()[0] for x in _PACK.split(", ")])


def _by_token(k: int, bits: int, flush: int, key: int):
    """Each distinct set of a flush once, dealt by the top bits of its tokens."""

    def out(held: dict[bytes, np.ndarray]) -> pa.RecordBatch:
        digests, sets = np.frombuffer(b"".join(held), "V16"), list(held.values())
        size = np.array([len(x) for x in sets], "<i8")
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        bucket = (tokens >> W.U64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        tokens, owner = tokens[order], owner[order]
        edge = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
        columns: list[list] = [[], [], [], [], []]
        for b in range(1 << bits):
            if edge[b] == edge[b + 1]:
                continue
            rows, count = np.unique(owner[edge[b] : edge[b + 1]], return_counts=True)
            # the bucket gives the top bits: of the rest seven bytes go along
            rest = (tokens[edge[b] : edge[b + 1]] << W.U64(bits)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :7]
            for c, x in zip(columns, (b, digests[rows].tobytes(), size[rows].astype("<u4").tobytes(), count.astype("<u4").tobytes(), rest.tobytes()), strict=True):
                c.append(x)
        return _pack(*columns)

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            text = batch.column(0)
            for a, b in W.chunks(text):
                for tokens in _sets(W.Words(text.slice(a, b - a), W.SPACED, W.LOWER, key=key), k):
                    if len(tokens) and (d := _digest(tokens)) not in held:
                        held[d] = tokens
                        size += len(tokens)
                if size >= flush:
                    yield out(held)
                    held, size = {}, 0
        if held:
            yield out(held)

    return run


def _tokens(blob: bytes, bucket: int, bits: int) -> np.ndarray:
    """Tokens of a bucket from the seven bytes after its bits; of 64 bits, at most the last two are lost."""
    raw = np.zeros((len(blob) // 7, 8), np.uint8)
    raw[:, :7] = np.frombuffer(blob, np.uint8).reshape(-1, 7)
    return raw.view(">u8").ravel().astype(W.U64) >> W.U64(bits) | W.U64(bucket << (64 - bits))


def _shared_tokens(bits: int, set_bits: int):
    """Rows come by bucket: tokens of two or more different sets, with their number of sets, dealt by set."""

    def out(bucket: int, held: list[dict]) -> Iterator[pa.RecordBatch]:
        digest = np.concatenate([np.frombuffer(x["digests"], "V16") for x in held])
        size = np.concatenate([np.frombuffer(x["sizes"], "<u4") for x in held])
        count = np.concatenate([np.frombuffer(x["counts"], "<u4") for x in held])
        tokens = np.concatenate([_tokens(x["tokens"], bucket, bits) for x in held])
        # equal sets of several flushes count once
        key = np.ascontiguousarray(digest).view("<u8").reshape(-1, 2)
        order = np.lexsort((key[:, 1], key[:, 0]))
        again = np.zeros(len(key), bool)
        again[order[1:]] = (key[order[1:]] == key[order[:-1]]).all(axis=1)
        keep = ~np.repeat(again, count)
        owner = np.repeat(np.arange(len(count), dtype=np.int32), count)[keep]
        tokens = tokens[keep]
        del keep
        order = np.argsort(tokens, kind="stable")
        s = tokens[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        runs = np.diff(np.append(first, len(s)))
        freq = np.empty(len(s), np.uint32)
        freq[order] = np.repeat(runs.astype(np.uint32), runs)
        del order, s, first, runs
        many = freq > 1
        if not many.any():
            return
        owner, tokens, freq = owner[many], tokens[many], freq[many]
        home = (key[:, 0] >> W.U64(64 - set_bits)).astype(np.int64)[owner]
        order = np.argsort(home, kind="stable")
        owner, tokens, freq, home = owner[order], tokens[order], freq[order], home[order]
        edge = np.searchsorted(home, np.arange((1 << set_bits) + 1))
        columns: list[list] = [[], [], [], [], [], []]
        for h in np.unique(home).tolist():
            part = slice(edge[h], edge[h + 1])
            rows, n = np.unique(owner[part], return_counts=True)
            for c, x in zip(columns, (h, digest[rows].tobytes(), size[rows].tobytes(), n.astype("<u4").tobytes(), tokens[part].tobytes(), freq[part].astype("<u4").tobytes()), strict=True):
                c.append(x)
        yield _pack(*columns)

    return _grouped(out)


def _grouped(out):
    """Rows sorted by bucket, handed on a bucket at a time."""

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                if held and held[0]["bucket"] != x["bucket"]:
                    yield from out(held[0]["bucket"], held)
                    held = []
                held.append(x)
        if held:
            yield from out(held[0]["bucket"], held)

    return run


_CANDIDATE = "digest binary, n long, tokens binary, prefix array<long>"


def _candidates(percent: int):
    """Rows come by set: sets with enough shared tokens to link at all, and the prefix that a partner must share.

    Tokens are in one order for all sets, those of fewest sets first. Of n tokens, n - o + 1
    (o: the least overlap with any partner) must hold one that the partner's prefix
    holds too. Tokens of this set alone come first and find nothing, so they only
    shorten the prefix.
    """

    def out(_bucket: int, held: list[dict]) -> Iterator[pa.RecordBatch]:
        digest = np.concatenate([np.frombuffer(x["digests"], "V16") for x in held])
        size = np.concatenate([np.frombuffer(x["sizes"], "<u4") for x in held]).astype(np.int64)
        count = np.concatenate([np.frombuffer(x["counts"], "<u4") for x in held]).astype(np.int64)
        tokens = np.concatenate([np.frombuffer(x["tokens"], "<u8") for x in held])
        freq = np.concatenate([np.frombuffer(x["freqs"], "<u4") for x in held])
        _, first, number = np.unique(digest.view("S16"), return_index=True, return_inverse=True)
        owner = np.repeat(number, count)
        order = np.lexsort((tokens, freq, owner))
        owner, tokens = owner[order], tokens[order]
        edge = np.searchsorted(owner, np.arange(len(first) + 1))
        columns: list[list] = [[], [], [], []]
        for i, at in enumerate(first.tolist()):
            n, mine = int(size[at]), tokens[edge[i] : edge[i + 1]]
            least = int(least_overlap(np.int64(n), percent))
            if len(mine) < least:
                continue
            prefix = mine[: n - least + 1 - (n - len(mine))]
            for c, x in zip(columns, (digest[at].tobytes(), n, np.sort(mine).tobytes(), prefix.astype("<i8")), strict=True):
                c.append(x)
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.list_(pa.int64()))], names=["digest", "n", "tokens", "prefix"])

    return _grouped(out)


class _Node:
    """A node of a signature tree: rows below it, OR of their bitmaps, range of sizes, most collisions."""

    __slots__ = ("rows", "children", "bits", "low", "high", "spare", "columns")

    def __init__(self, rows, children, bits, low, high, spare, columns=None):
        self.rows, self.children, self.bits, self.low, self.high, self.spare, self.columns = rows, children, bits, low, high, spare, columns


class SignatureTree:
    """Sets of one group, with a tree over them in order of size and smallest token.

    A bitmap has a bit for each hashed token. Of two nodes, no set can share more
    tokens than the bits that both have, plus the smaller of their collisions (tokens
    beyond a set's own bits); where that is below the least overlap that their sizes
    need, or the sizes are too far apart, the pair of nodes is pruned. links() also prunes
    a pair whose sets are all linked already, and reports only what joins components;
    census() prunes no such pair, and counts all links.

    sides: where given, sets of one side meet only those of the other, as two trees.
    known: where given, a component of each set that is known before.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int], percent: int, sides: list[bool] | None = None, known: list | None = None):
        self.percent = percent
        counts = np.array([len(x) for x in sets])
        flat = np.concatenate(sets) if sets else np.zeros(0, W.U64)
        vocabulary, local = np.unique(flat, return_inverse=True)
        self.vocabulary = len(vocabulary)
        edge = np.concatenate(([0], np.cumsum(counts)))
        self.sets = [np.sort(local[edge[i] : edge[i + 1]]) for i in range(len(sets))]
        self.sizes = np.array(sizes, np.int64)
        self.parent = list(range(len(sets)))
        if known is not None:
            first: dict = {}
            self.parent = [first.setdefault(c, i) for i, c in enumerate(known)]
        width = 64
        while width < 4 * max(counts.max(initial=1), 16) and width < 1 << 16:
            width *= 2
        place = (W.mix(vocabulary) & W.U64(width - 1)).astype(np.int64)
        smallest = np.array([int(x[0]) if len(x) else -1 for x in self.sets])
        order = np.lexsort((smallest, self.sizes))
        if sides is None:
            self.roots = [self._grown(order, place, width)] * 2
        else:
            side = np.array(sides, bool)[order]
            self.roots = [self._grown(order[side], place, width), self._grown(order[~side], place, width)]

    def _grown(self, order: np.ndarray, place: np.ndarray, width: int) -> _Node | None:
        level = [self._leaf(order[i : i + _LEAF], place, width) for i in range(0, len(order), _LEAF)]
        while len(level) > 1:
            level = [self._inner(level[i : i + _FAN]) for i in range(0, len(level), _FAN)]
        return level[0] if level else None

    def _leaf(self, rows: np.ndarray, place: np.ndarray, width: int) -> _Node:
        bits, spare = 0, 0
        for r in rows.tolist():
            own = np.zeros(width, np.uint8)
            own[place[self.sets[r]]] = 1
            spare = max(spare, len(self.sets[r]) - int(own.sum()))
            bits |= int.from_bytes(np.packbits(own).tobytes(), "big")
        n = self.sizes[rows]
        return _Node(rows, (), bits, int(n.min()), int(n.max()), spare, np.unique(np.concatenate([self.sets[r] for r in rows.tolist()])))

    @staticmethod
    def _inner(children: list[_Node]) -> _Node:
        bits = 0
        for c in children:
            bits |= c.bits
        return _Node(np.concatenate([c.rows for c in children]), tuple(children), bits, min(c.low for c in children), max(c.high for c in children), max(c.spare for c in children))

    def _find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _one(self, node: _Node) -> int:
        """The component that holds all rows of a node, or -1."""
        rows = node.rows
        first = self._find(int(rows[0]))
        for r in rows[1:]:
            if self._find(int(r)) != first:
                return -1
        return first

    def _apart(self, a: _Node, b: _Node) -> bool:
        if 100 * min(a.high, b.high) < self.percent * max(a.low, b.low):
            return True
        return (a.bits & b.bits).bit_count() + min(a.spare, b.spare) < need(a.low, b.low, self.percent)

    def _dense(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(columns)), np.float32)
        sets = [self.sets[r] for r in rows.tolist()]
        owner, flat = np.repeat(np.arange(len(rows)), [len(x) for x in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(columns, flat), len(columns) - 1)
        held = columns[at] == flat
        out[owner[held], at[held]] = 1
        return out

    def _linked(self, a: _Node, b: _Node) -> np.ndarray | None:
        """Which sets of two leaves link; of one leaf, those of a smaller place with those of a larger."""
        columns = a.columns if a is b else np.intersect1d(a.columns, b.columns, assume_unique=True)
        if not len(columns):
            return None
        left = self._dense(a.rows, columns)
        shared = (left @ (left if a is b else self._dense(b.rows, columns)).T).astype(np.int64)
        n, m = self.sizes[a.rows][:, None], self.sizes[b.rows][None, :]
        linked = 100 * shared >= self.percent * (n + m - shared)
        return np.triu(linked, 1) if a is b else linked

    def _joining(self, a: _Node, b: _Node, linked: np.ndarray) -> Iterator[tuple[int, int]]:
        for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
            x, y = int(a.rows[i]), int(b.rows[j])
            p, q = self._find(x), self._find(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                yield x, y

    def _joined(self, a: _Node, b: _Node) -> bool:
        one = self._one(a)
        return one >= 0 and (a is b or one == self._one(b))

    def _leaves(self, every: bool) -> Iterator[tuple[_Node, _Node]]:
        """Pairs of leaves with sets that may link; unless every, without those that are joined already."""
        if None in self.roots:
            return
        stack = [tuple(self.roots)]
        while stack:
            a, b = stack.pop()
            if a is not b and self._apart(a, b):
                continue
            if not every and self._joined(a, b):
                continue
            if not a.children and not b.children:
                yield a, b
            elif a is b:
                # a node's own pairs first: what they join prunes the pairs across
                stack += [(x, y) for i, x in enumerate(a.children) for y in a.children[:i]]
                stack += [(x, x) for x in a.children]
            else:
                stack += [(x, y) for x in (a.children or (a,)) for y in (b.children or (b,))]

    def links(self) -> Iterator[tuple[int, int]]:
        """Pairs of rows that link, enough of them to join all that links join."""
        for a, b in self._leaves(False):
            if (linked := self._linked(a, b)) is not None:
                yield from self._joining(a, b, linked)

    def census(self, weights: list[int]) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Links as links() has them, and for each row the weight of all rows that it links to."""
        pairs, weight, total = [], np.array(weights, np.int64), np.zeros(len(self.sets), np.int64)
        for a, b in self._leaves(True):
            if (linked := self._linked(a, b)) is None:
                continue
            total[a.rows] += linked @ weight[b.rows]
            total[b.rows] += weight[a.rows] @ linked
            if not self._joined(a, b):
                pairs += self._joining(a, b, linked)
        return pairs, total


def _join_group(percent: int):
    def run(table: pa.Table) -> pa.Table:
        digests = table.column("digest").to_pylist()
        sets = [np.frombuffer(x, "<u8") for x in table.column("tokens").to_pylist()]
        sides, known = (table.column(c).to_pylist() if c in table.column_names else None for c in ("side", "cluster"))
        tree = SignatureTree(sets, table.column("n").to_pylist(), percent, sides, known)
        pairs = list(tree.links())
        return pa.table({"a": pa.array([digests[i] for i, _ in pairs], pa.binary()), "b": pa.array([digests[j] for _, j in pairs], pa.binary())})

    return run


def _count_group(percent: int):
    """A group, or two parts of it: links enough to join what links join (a, b), and each set's weight of all links (a, k)."""

    def run(table: pa.Table) -> pa.Table:
        digests = table.column("digest").to_pylist()
        sets = [np.frombuffer(x, "<u8") for x in table.column("tokens").to_pylist()]
        sides = table.column("side").to_pylist() if table.column("i")[0].as_py() != table.column("j")[0].as_py() else None
        pairs, total = SignatureTree(sets, table.column("n").to_pylist(), percent, sides).census(table.column("copies").to_pylist())
        some = np.flatnonzero(total).tolist()
        a = [digests[i] for i, _ in pairs] + [digests[i] for i in some]
        b = [digests[j] for _, j in pairs] + [None] * len(some)
        k = [None] * len(pairs) + total[some].tolist()
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "k": pa.array(k, pa.int64())})

    return run


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
    tokens_per_bucket: int = 2 << 20, flush: int = 1 << 20, sets_per_task: int = 500, tokens_per_task: int = 1 << 20, count_links: bool = False,
) -> DataFrame:
    """Components of documents linked by Jaccard similarity of their word shingles, exactly.

    Words are separated by blank, tab, line feed, vertical tab, form feed and carriage
    return, with A-Z lower-cased. A document's set are its distinct runs of shingle words
    (fewer words: all of them as one). Two link when 100 * intersection >= percent *
    union. Equal sets are one node from the start.

    Tokens are counted by number of sets, in buckets by token; only tokens of two or
    more sets go on, to their set. A set that keeps too few to reach any partner is
    done. The others share a token of their prefixes (rarest first) with each
    partner, so components over prefix tokens hold all links; in each, a signature tree
    joined with itself finds links enough to join what links join.

    A component with more than sets_per_task sets or tokens_per_task tokens is first dealt
    into parts of that size by two hashes, each part joined with itself: most near copies
    of one text are one cluster after that, in work linear in their number. Only sets
    outside the component's largest cluster, in parts again, then meet the sets that
    they may still link to, so all links between clusters are found; that work grows with
    their number times the component's. Nothing is collected, and only what Spark knows to
    be small is broadcast.

    count_links: also return n_links, the number of other rows that a row links to, rows of
    an equal set among them. Every pair of sets that may link is then compared, whether
    joined already or not: a large component's parts meet each other, a pair a task, in
    work that grows with the square of its sets. Links are counted where they are found,
    and only sums leave a task.

    Tokens are 62 bits or more of hashes under a key of the run, so no text can be made to
    share tokens with another; sets are told apart by 128 bits of BLAKE2b over theirs.

    Returns id_col, n_shingles (set size), component_id (smallest id in the component,
    its own if alone), and n_links where asked for. Texts without words have no set and stand alone; null ids
    take part in links, and a component of null ids only has a null id; repeated rows
    have a row each; an empty table gives an empty result; other columns are ignored. Where
    id_col has the name of another column of the result, that one gets an underscore.
    """
    spark = docs.sparkSession
    ship(spark)
    name, id_col = id_col, "__id"
    parts, key = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), W.new_key()
    table = docs.select(F.col(name).alias(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = T.StructType([T.StructField(id_col, docs.schema[name].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType())])
    described = written(table.mapInArrow(_describe(id_col, shingle, key), kind), "sets")
    total = described.agg(F.sum("n_shingles")).first()[0] or 0
    bits = min(16, max(6, (total // tokens_per_bucket).bit_length()))
    packed = table.select("__text").mapInArrow(_by_token(shingle, bits, flush, key), _PACK)
    shared = packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared_tokens(bits, bits), _PACK)
    candidates = written(shared.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_candidates(percent), _CANDIDATE), "candidates")
    nodes = described.where("digest is not null").groupBy("digest").agg(F.min(id_col).alias("__least"), F.count(F.lit(1)).alias("__copies"))
    if count_links:
        nodes = written(nodes, "nodes")
        found = _all_links(candidates, nodes.select("digest", F.col("__copies").alias("copies")), percent, sets_per_task, tokens_per_task)
        links = found.where("b is not null")
    else:
        links = _tree_links(candidates, percent, sets_per_task, tokens_per_task)
    joined = components(links, "a", "b")
    rooted = nodes.join(joined, nodes["digest"] == joined["node"], "left").select("digest", "__least", F.coalesce("component", "digest").alias("__root"))
    label = written(rooted.groupBy("__root").agg(F.min("__least").alias("component_id")), "labels")
    known = rooted.join(label, "__root").select("digest", "component_id")
    own = F.when(F.col("digest").isNull(), F.col(id_col)).otherwise(F.col("component_id"))
    columns = [id_col, "n_shingles", own.alias("component_id")]
    if count_links:
        counts = found.where("k is not null").groupBy(F.col("a").alias("digest")).agg(F.sum("k").alias("k"))
        other = nodes.join(counts, "digest", "left").select("digest", (F.col("__copies") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"))
        known = known.join(other, "digest")
        columns.append(F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    out = described.join(known, "digest", "left").select(*columns)
    return out.toDF(name, *(c + "_" if c == name.lower() else c for c in out.columns[1:]))


_LINK = "a binary, b binary"


def _parts(sets_per_task: int, tokens_per_task: int):
    """Number of parts of members sets with so many tokens, of the columns members and tokens."""
    most = F.greatest(F.ceil(F.col("members") / sets_per_task), F.ceil(F.col("tokens") / tokens_per_task))
    return F.least(F.col("members"), most).cast("long")


def _sized(rows: DataFrame) -> DataFrame:
    return rows.groupBy("group").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens"))


def _groups(candidates: DataFrame, sets_per_task: int, tokens_per_task: int) -> DataFrame:
    """Sets of groups of two or more: digest, n, group, and the number of parts of the group."""
    token = candidates.select("digest", F.explode("prefix").alias("token"))
    # aggregates that hot rows meet are written first: a join with a file can be split or broadcast by its size
    head = written(token.groupBy("token").agg(F.min("digest").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("token", "head"), "heads")
    near = components(token.join(head, "token").select("digest", "head"), "digest", "head")
    narrow = candidates.select("digest", "n")
    grouped = narrow.join(near, F.col("digest") == F.col("node"), "left").select("digest", "n", F.coalesce("component", "digest").alias("group"))
    sizes = written(_sized(grouped).where("members > 1").select("group", _parts(sets_per_task, tokens_per_task).alias("parts")), "sizes")
    return written(grouped.join(sizes, "group"), "groups")


def _all_links(candidates: DataFrame, copies: DataFrame, percent: int, sets_per_task: int, tokens_per_task: int) -> DataFrame:
    """Links that join (a, b), and sums of all links of a set by task (a, k): each two parts of a group meet in one task."""
    grouped = _groups(candidates, sets_per_task, tokens_per_task).join(copies, "digest")
    part = grouped.withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")))
    met = part.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = met.select("group", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "digest", "n", "copies", (F.col("part") <= F.col("with")).alias("side"))
    return written(candidates.select("digest", "tokens").join(dealt, "digest").groupBy("group", "i", "j").applyInArrow(_count_group(percent), _LINK + ", k long"), "counted")


def _tree_links(candidates: DataFrame, percent: int, sets_per_task: int, tokens_per_task: int) -> DataFrame:
    sets, grouped = candidates.select("digest", "tokens"), _groups(candidates, sets_per_task, tokens_per_task)
    small = sets.join(grouped.where("parts = 1"), "digest").groupBy("group").applyInArrow(_join_group(percent), _LINK)
    small = written(small, "joined")
    large = grouped.where("parts > 1")
    if large.isEmpty():
        return small
    twice = large.withColumn("deal", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("part", F.pmod(F.xxhash64("digest", "deal"), F.col("parts")))
    within = written(sets.join(twice, "digest").groupBy("group", "deal", "part").applyInArrow(_join_group(percent), _LINK), "within")
    return small.unionByName(within).unionByName(_across(sets, large, within, percent, sets_per_task, tokens_per_task))


def _across(sets: DataFrame, large: DataFrame, within: DataFrame, percent: int, sets_per_task: int, tokens_per_task: int) -> DataFrame:
    """Links of sets outside their group's largest cluster, with those in it and with each other."""
    clusters = components(within, "a", "b")
    own = large.join(clusters, F.col("digest") == F.col("node"), "left").select("group", "digest", "n", "parts", F.coalesce("component", "digest").alias("cluster"))
    counts = own.groupBy("group", "cluster").agg(F.count(F.lit(1)).alias("k"))
    main = written(counts.groupBy("group").agg(F.max(F.struct("k", "cluster")).alias("m")).select("group", F.col("m.cluster").alias("main")), "main")
    own = written(own.join(main, "group").withColumn("rest", F.col("cluster") != F.col("main")).drop("main"), "clusters")
    rest = written(_sized(own.where("rest")).select("group", _parts(sets_per_task, tokens_per_task).alias("rests")), "rests")
    # tasks are pairs of a part of the rest and a part of the main cluster (0, 1, ...) or a later part of the rest (-1, -2, ...)
    zero, own = F.lit(0).cast("long"), own.join(rest, "group")
    part = F.pmod(F.xxhash64("digest"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("parts")))
    own = own.withColumn("part", part)
    later = F.transform(F.sequence(F.col("part"), F.col("rests") - 1), lambda p: -1 - p)
    left = own.where("rest").withColumn("j", F.explode(F.concat(F.sequence(zero, F.col("parts") - 1), later))).withColumn("i", F.col("part"))
    upto = F.when(F.col("rest"), F.col("part")).otherwise(F.col("rests") - 1)
    right = own.withColumn("i", F.explode(F.sequence(zero, upto))).withColumn("j", F.when(F.col("rest"), -1 - F.col("part")).otherwise(F.col("part")))
    names = ["group", "i", "j", "digest", "n", "cluster"]
    dealt = left.select(*names, F.lit(True).alias("side")).unionByName(right.select(*names, F.lit(False).alias("side")))
    return written(sets.join(dealt, "digest").groupBy("group", "i", "j").applyInArrow(_join_group(percent), _LINK), "across")
