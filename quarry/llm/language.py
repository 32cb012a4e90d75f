"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import _words as W
from quarry.llm._store import written
from quarry.llm.classify import held_out
from quarry.shipping import ship

_STEP = 64
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _lettered(text: str) -> list[str]:
    """The words of a text that have a letter: those that features() and chains are about."""
    return [w for w in _WORD.findall(text) if any(map(str.isalpha, w))]


def _letters(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalpha())


def features(words: list[str], bits: int, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' affixes, character n-grams and lexicon entries, and the word of each.

    Affixes and n-grams are of the lower-case letters; a word without a letter has none.
    lexicon: sorted whole-word hashes. All words are hashed at once.
    """
    code = np.frombuffer("\n".join([*words, ""]).lower().encode("utf-32-le", "replace"), "<u4")
    distinct, inverse = np.unique(code, return_inverse=True)
    good = np.array([chr(c).isalpha() or c == 10 for c in distinct.tolist()], bool)
    code = code[good[inverse]]
    end = np.flatnonzero(code == 10)
    size = np.diff(np.concatenate(([-1], end))) - 1
    live = np.flatnonzero(size)
    n = len(live)
    # live words only, each between two marks
    length = size[live] + 2
    first = np.cumsum(length) - length
    chars = np.zeros(int(length.sum()), W.U64)
    inner = np.ones(len(chars), bool)
    inner[first] = inner[first + length - 1] = False
    chars[inner] = code[code != 10]
    chars[first], chars[first + length - 1] = W.U64(94), W.U64(36)
    owner = np.repeat(np.arange(n), length)
    out, own = [], []
    hashed = chars
    for size_n in (1, 2, 3, 4):
        if size_n > 1:
            hashed = hashed[:-1] * W.U64(0x100000001B3) + chars[size_n - 1 :]
        if len(hashed) == 0:
            break
        h = W.mix(hashed ^ W.U64(size_n << 56))
        if size_n < 4:
            inside = owner[: len(h)] == owner[size_n - 1 :]
            if size_n == 1:
                inside = inside & inner
            out.append(h[inside])
            own.append(owner[: len(h)][inside])
        long = np.flatnonzero(length - 2 >= size_n)
        out += [W.mix(h[first[long] + 1] ^ W.U64(5)), W.mix(h[first[long] + length[long] - 1 - size_n] ^ W.U64(6))]
        own += [long, long]
    if n:
        power = W.powers(0x100000001B3, len(chars))
        total = np.concatenate(([W.U64(0)], np.cumsum(chars * power, dtype=W.U64)))
        inverse_power = W.powers(pow(0x100000001B3, -1, 1 << 64), len(chars))
        entry = W.mix((total[first + length] - total[first]) * inverse_power[first])
        if len(lexicon):
            at = np.minimum(np.searchsorted(lexicon, entry), len(lexicon) - 1)
            known = np.flatnonzero(lexicon[at] == entry)
            out.append(W.mix(entry[known] ^ W.U64(7)))
            own.append(known)
    else:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = W.U64((1 << bits) - 1)
    return (np.concatenate(out) & mask).astype(np.int64), live[np.concatenate(own)]


def entries(words: list[str]) -> np.ndarray:
    """Whole-word hashes of words of letters, as features() looks them up."""
    out = []
    for w in words:
        total, power = 0, 1
        for c in [94, *map(ord, w), 36]:
            total, power = (total + c * power) % (1 << 64), power * 0x100000001B3 % (1 << 64)
        out.append(total)
    return np.sort(W.mix(np.array(out, W.U64)))


class Model:
    """Labels, emission weights by bucket, transitions and the lexicon; caches the emissions of words met."""

    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray, start: np.ndarray, lexicon: np.ndarray, bits: int):
        self.labels, self.weights, self.transitions, self.start, self.lexicon, self.bits = labels, weights, transitions, start, lexicon, bits
        self.place: dict[int, int] = {}
        self.table = np.zeros((1024, len(labels) + 1), np.float32)

    def emissions(self, hashes: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores of words, by hash, and which of them have a letter; words(places) gives the texts of those met first."""
        values, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.place) > 1 << 19:
            self.place = {}
        get = self.place.get
        at = np.array([get(h, -1) for h in values.tolist()], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            begin = len(self.place)
            at[new] = np.arange(begin, begin + len(new))
            self.place.update(zip(values[new].tolist(), at[new].tolist(), strict=True))
            while begin + len(new) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[begin : begin + len(new)] = self.scores(words(first[new]))
        found = self.table[at][inverse]
        return found[:, :-1], found[:, -1] > 0

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: its scores, and the number of its features, 0 without a letter."""
        at, own = features(words, self.bits, self.lexicon)
        count = np.bincount(own, minlength=len(words))
        total = np.stack([np.bincount(own, weights=self.weights[at, j], minlength=len(words)) for j in range(len(self.labels))], axis=1) if self.labels else np.zeros((len(words), 0))
        return np.concatenate((total / np.sqrt(np.maximum(count, 1))[:, None], count[:, None]), axis=1)


def forward_backward(emission: np.ndarray, mask: np.ndarray, transitions: np.ndarray, start: np.ndarray):
    """Posteriors of labels at each step of many sequences (steps x sequences x labels), pair expectations and log norm.

    mask: which steps of a sequence hold a word; they are its first ones.
    """
    steps, many, k = emission.shape
    move = np.exp(transitions)
    alpha = np.empty_like(emission)
    high = emission.max(axis=2, keepdims=True)
    e = np.exp(emission - high)
    norm = np.ones((steps, many), emission.dtype)
    a = e[0] * np.exp(start)
    for t in range(steps):
        if t:
            a = np.where(mask[t][:, None], (a @ move) * e[t], a)
        total = a.sum(axis=1)
        a = a / total[:, None]
        norm[t] = total
        alpha[t] = a
    beta = np.ones((many, k), emission.dtype)
    post = np.empty_like(emission)
    pairs = np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        p = alpha[t] * beta
        post[t] = p / p.sum(axis=1, keepdims=True)
        if t:
            inner = e[t] * beta
            joint = alpha[t - 1][:, :, None] * move[None] * inner[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pairs += joint[mask[t]].sum(axis=0)
            b = inner @ move.T
            beta = np.where(mask[t][:, None], b / b.sum(axis=1, keepdims=True), beta)
    return post, pairs, float((np.log(norm) + high[:, :, 0])[mask].sum())


def posteriors(emission: np.ndarray, count: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posteriors of labels at each word (words x labels) of texts laid end to end, each of them one chain of count words.

    Exact forward-backward, in stretches of 64 words that are all worked on at once. The
    product of a stretch's steps is a matrix, labels by labels; by these, forward and
    backward messages pass from stretch to stretch of a text, so that each stretch begins
    with what the words before it say and ends with what those after it say.
    """
    k = emission.shape[1]
    parts = -(-count // _STEP)
    first = np.cumsum(parts) - parts
    total = int(parts.sum())
    if not total:
        return np.zeros_like(emission, dtype=np.float32)
    nth = np.arange(len(emission)) - np.repeat(np.cumsum(count) - count, count)
    place = np.repeat(first * _STEP, count) + nth
    filled = np.zeros((total * _STEP, k), np.float32)
    filled[place] = np.exp(emission - emission.max(axis=1, keepdims=True))
    e = np.ascontiguousarray(filled.reshape(total, _STEP, k).transpose(1, 0, 2))
    size = np.full(total, _STEP)
    some = count > 0
    last = (first + parts - 1)[some]
    size[last] = count[some] - (parts[some] - 1) * _STEP
    opens = np.zeros(total, bool)
    opens[first[some]] = True
    move = np.exp(transitions).astype(np.float32)
    before = np.broadcast_to(np.exp(start).astype(np.float32), (total, k)).copy()
    after = np.ones((total, k), np.float32)
    deep = int(parts.max())
    if deep > 1:
        # stretches of texts with more than one; only their last is not full, and its matrix serves the backward message alone
        long = np.repeat(parts > 1, parts)
        rows = np.flatnonzero(long)
        steps = np.tile(np.eye(k, dtype=np.float32), (len(rows), 1, 1))
        for t in range(_STEP):
            live = size[rows] > t
            moved = steps @ move if t else np.where(opens[rows][:, None, None], steps, steps @ move)
            moved = moved * e[t, rows][:, None, :]
            moved /= moved.max(axis=(1, 2), keepdims=True) + np.float32(1e-30)
            steps = np.where(live[:, None, None], moved, steps)
        at = np.full(total, -1)
        at[rows] = np.arange(len(rows))
        order = np.argsort(-parts, kind="stable")
        texts, depth = first[order], parts[order]
        for j in range(1, deep):
            now = texts[: np.searchsorted(-depth, -j, "left")] + j
            b = np.einsum("ni,nij->nj", before[now - 1], steps[at[now - 1]])
            before[now] = b / b.sum(axis=1, keepdims=True)
        for j in range(deep - 1, 0, -1):
            now = texts[: np.searchsorted(-depth, -j, "left")] + j
            a = np.einsum("nij,nj->ni", steps[at[now]], after[now])
            after[now - 1] = a / a.sum(axis=1, keepdims=True)
    post = np.empty_like(e)
    a = before
    for t in range(_STEP):
        a = (np.where(opens[:, None], a, a @ move) if t == 0 else a @ move) * e[t]
        a = a / np.maximum(a.sum(axis=1, keepdims=True), np.float32(1e-30))
        post[t] = a
    b = after
    for t in range(_STEP - 1, -1, -1):
        live = (size > t)[:, None]
        p = post[t] * b
        post[t] = p / np.maximum(p.sum(axis=1, keepdims=True), np.float32(1e-30))
        inner = (e[t] * b) @ move.T
        b = np.where(live, inner / np.maximum(inner.sum(axis=1, keepdims=True), np.float32(1e-30)), b)
    return post.transpose(1, 0, 2).reshape(-1, k)[place]


def train(texts: list[str], langs: list[str], *, bits: int = 18, rounds: int = 30, rate: float = 0.5, l2: float = 1e-3, lexicon_size: int = 400, seed: int = 3) -> Model:
    """Maximise the conditional likelihood by AdaGrad on the exact gradient over all training words.

    Every word of a text bears the text's label. For training texts are cut into stretches of
    64 words; every fourth stretch is half of one text and half of another, so that changes
    of language are seen and transitions are learned from both kinds.
    """
    labels = sorted(set(langs))
    number = {x: i for i, x in enumerate(labels)}
    k = len(labels)
    words: dict[str, int] = {}
    stretches: list[tuple[np.ndarray, int]] = []
    counts: dict[str, np.ndarray] = {}
    for text, lang in zip(texts, langs, strict=True):
        found = _lettered(text)
        for w in found:
            counts.setdefault(_letters(w), np.zeros(k))[number[lang]] += 1
        ids = np.array([words.setdefault(w, len(words)) for w in found], np.int64)
        stretches += [(ids[i : i + _STEP], number[lang]) for i in range(0, len(ids), _STEP)]
    if not stretches:
        return Model(labels, np.zeros((1 << bits, k), np.float32), np.zeros((k, k)), np.zeros(k), np.zeros(0, W.U64), bits)
    named: set[str] = set()
    for i in range(k):
        named |= {w for _, w in sorted((-c[i], w) for w, c in counts.items() if c[i] >= 3 and c[i] > 0.6 * c.sum())[:lexicon_size]}
    lexicon = entries(sorted(named))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(stretches))
    ids = np.zeros((_STEP, len(stretches)), np.int64)
    gold = np.zeros((_STEP, len(stretches)), np.int64)
    mask = np.zeros((_STEP, len(stretches)), bool)
    for s, at in enumerate(order.tolist()):
        first, label = stretches[at]
        if s % 4 == 3:  # switched: half of this stretch, then half of another
            second, other = stretches[int(order[s - 1])]
            first, second = first[: _STEP // 2], second[: _STEP // 2]
            seq, own = np.concatenate((first, second)), np.repeat([label, other], [len(first), len(second)])
        else:
            seq, own = first, np.full(len(first), label)
        ids[: len(seq), s], gold[: len(seq), s], mask[: len(seq), s] = seq, own, True
    flat, owner = features(list(words), bits, lexicon)
    size = np.bincount(owner, minlength=len(words))
    weight = 1 / np.sqrt(np.maximum(size, 1))[owner]
    used, local = np.unique(flat, return_inverse=True)
    w, g2 = np.zeros((len(used), k)), np.full((len(used), k), 1e-8)
    trans, t2 = np.zeros((k, k)), np.full((k, k), 1e-8)
    start, s2 = np.zeros(k), np.full(k, 1e-8)
    observed = np.zeros((len(words), k))
    np.add.at(observed, (ids[mask], gold[mask]), 1)
    both = mask[1:]
    seen_pairs = np.zeros((k, k))
    np.add.at(seen_pairs, (gold[:-1][both], gold[1:][both]), 1)
    seen_start = np.bincount(gold[0][mask[0]], minlength=k).astype(float)
    total = mask.sum()
    for _ in range(rounds):
        score = np.stack([np.bincount(owner, weights=w[local, j] * weight, minlength=len(words)) for j in range(k)], axis=1)
        post, pairs, _ = forward_backward(score[ids], mask, trans, start)
        expected = np.stack([np.bincount(ids[mask], weights=post[..., j][mask], minlength=len(words)) for j in range(k)], axis=1)
        gap = (observed - expected) / total
        grad = np.stack([np.bincount(local, weights=gap[owner, j] * weight, minlength=len(used)) for j in range(k)], axis=1) - l2 * w / total
        for x, g, sq in ((w, grad, g2), (trans, (seen_pairs - pairs) / total, t2), (start, (seen_start - post[0][mask[0]].sum(axis=0)) / total, s2)):
            sq += g * g
            x += rate * g / np.sqrt(sq)
    full = np.zeros((1 << bits, k), np.float32)
    full[used] = w
    return Model(labels, full, trans, start, lexicon, bits)


def _stretches(most: int):
    """Rows lang, h, text: of a text with more than most stretches of 64 lettered words that many, evenly spread; else all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = _lettered(batch.column(2)[i].as_py())
                n = -(-len(words) // _STEP)
                cut = [words[j * _STEP : (j + 1) * _STEP] for j in (range(n) if n <= most else (x * n // most for x in range(most)))]
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(i, 1) for j in range(2)), pa.array([" ".join(w for x in cut for w in x)])], names=["lang", "h", "text"])

    return run


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 120, stretches: int = 16, most_texts: int = 20_000, seed: int = 3) -> Model:
    """Train on per_language texts a language, of rows that are not held out.

    A language's texts are those with the smallest hashed ids, found below a bound that
    its number of rows gives, so the sample is even and needs no sort. Of a text with
    more than stretches runs of 64 words, that many runs are taken, evenly spread, so texts
    of any length train, and at most per_language * stretches * 64 words a language reach
    the driver. All languages are learned: where per_language would give more than
    most_texts in all, each has that many fewer, one at least. Null texts, ids and languages
    are left out.
    """
    lang, text = F.col(lang_col).cast("string"), F.col(text_col).cast("string")
    rows = docs.where(lang.isNotNull() & text.isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    rows = rows.select(lang.alias("lang"), text.alias("text"), F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), F.lit(1 << 30)).alias("h"))
    share = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    each = max(1, min(per_language, most_texts // max(share.count(), 1)))
    # that many are expected below the bound, and so many more that fewer than each of them are hardly ever there
    bound = share.select("lang", F.least(F.lit(1.0), F.lit(each + 6 * each**0.5 + 12) / F.col("n")).alias("p"))
    chosen = rows.join(bound, "lang").where(F.col("h") < F.col("p") * float(1 << 30)).select("lang", "h", "text")
    ship(docs.sparkSession)
    found: dict[str, list[tuple[int, str]]] = {}
    for r in chosen.mapInArrow(_stretches(stretches), "lang string, h long, text string").toLocalIterator():
        found.setdefault(r["lang"], []).append((r["h"], r["text"]))
    texts, langs = [], []
    for name in sorted(found):
        for _, t in sorted(found[name])[:each]:
            texts.append(t)
            langs.append(name)
    return train(texts, langs, seed=seed)


def label_batch(model: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean label posteriors of each row's words with a letter (rows x labels), their number, and posteriors by word.

    A row's words are one chain, whatever their number; words without a letter take no part.
    """
    words = W.Words(text, W.SPACED, spans=True)
    k = len(model.labels)
    n = words.counts()
    raw = words.raw.tobytes()
    say = lambda places: [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.start[places].tolist(), words.end[places].tolist(), strict=True)]
    emission, live = model.emissions(words.hash, say)
    row = np.repeat(np.arange(len(n)), n)[live]
    count = np.bincount(row, minlength=len(n))
    own = posteriors(emission[live], count, model.transitions, model.start) if k else np.zeros((len(row), 0), np.float32)
    mean = np.stack([np.bincount(row, weights=own[:, j], minlength=len(n)) for j in range(k)], axis=1) if k else np.zeros((len(n), 0))
    return mean / np.maximum(count, 1)[:, None], count, own


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred, score of every whole text.

    The label with the highest mean posterior over the words that have a letter, and
    that mean (ties: the first by name). Null texts and texts without a letter are `und`
    with score 0; so is everything if the model knows no label. Null ids are hashed as
    an empty string, repeated rows have a row each, other columns are ignored.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        names = np.array([*own.labels, "und"], object)
        for batch in batches:
            text = batch.column(1)
            for a, b in W.chunks(text, 1 << 20):
                part = text.slice(a, b - a)
                mean, count, _ = label_batch(own, part)
                known = (count > 0) & bool(own.labels)
                best = mean.argmax(axis=1) if own.labels else np.zeros(len(part), np.int64)
                score = np.where(known, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0) if own.labels else np.zeros(len(part))
                best = np.where(known, best, len(own.labels))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names[best], pa.string()), pa.array(score)], names=["__id", "lang_pred", "score"])

    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, out)
    return found.withColumnRenamed("__id", id_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
