"""Quality rules: base statistics, and robust multivariate outliers by minimum covariance determinant."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm._store import written

WORD = r"[^\x20\x09-\x0D]+"
_D = 5


def statistics(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines of a text column, and its words for repeat_words()."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return {
        "__words": F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)),
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "__lines": lines,
    }


def with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Windows of three words are hashed in 64 bits in one array; where all differ nothing
    repeats, else the sorted (hash, place) pairs give the places of repeated windows,
    and places up to two apart overlap.
    """
    df = docs.withColumns(statistics(F.col(text_col)))
    df = df.withColumn("n_words", F.size("__words").cast("long")).withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    at = lambda i: F.get("__words", i)
    hashes = F.transform(F.sequence(F.lit(0), F.size("__words") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    df = df.withColumn("__h", F.when(F.size("__words") > 2, hashes).otherwise(F.array().cast("array<bigint>")))
    # places are told apart only where a cheaper count shows that something repeats
    df = df.withColumn("__some", F.size(F.array_distinct("__h")) < F.size("__h"))
    pairs = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__p", F.when(F.col("__some"), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    before, after = F.expr("slice(__p, 1, size(__p) - 1)"), F.expr("slice(__p, 2, size(__p))")
    same = F.zip_with(before, after, lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    df = df.withColumn("__at", F.when(F.size("__p") > 1, places).otherwise(F.array().cast("array<int>")))
    gaps = F.zip_with(F.expr("slice(__at, 1, size(__at) - 1)"), F.expr("slice(__at, 2, size(__at))"), lambda x, y: F.least(y - x, F.lit(3)))
    repeated = F.when(F.size("__at") > 1, F.aggregate(gaps, F.lit(3), lambda n, x: n + x)).when(F.size("__at") == 1, F.lit(3)).otherwise(0)
    return df.withColumn("n_repeat_words", repeated.cast("long")).drop("__words", "__lines", "__h", "__some", "__p", "__at")


def chi_square(x: float, k: int) -> float:
    """Distribution function of the chi-square with k degrees of freedom, by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    term = total = 2 / k
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= x / 2 / (k / 2 + n)
        total += term
    return total * math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2))


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, k) < p else (low, middle)
    return high


def _factor(df: DataFrame, cov) -> tuple[DataFrame, list[str]]:
    """df with the inverse Cholesky factor (w00, ...) of the matrix cov(i, j), i >= j, of each row, and logdet of the matrix."""
    low: dict[tuple[int, int], str] = {}
    for i in range(_D):
        for j in range(i + 1):
            total = cov(i, j)
            for k in range(j):
                total = total - F.col(low[i, k]) * F.col(low[j, k])
            low[i, j] = f"__l{i}{j}"
            df = df.withColumn(low[i, j], F.sqrt(F.greatest(total, F.lit(1e-12))) if i == j else total / F.col(low[j, j]))
    for i in range(_D):
        for j in range(i + 1):
            value = F.lit(1.0) if i == j else F.lit(0.0)
            for k in range(j, i):
                value = value - F.col(low[i, k]) * F.col(f"w{k}{j}")
            df = df.withColumn(f"w{i}{j}", value / F.col(low[i, i]))
    df = df.withColumn("logdet", 2 * sum(F.ln(F.col(low[i, i])) for i in range(_D)))
    return df.drop(*low.values()), [f"w{i}{j}" for i in range(_D) for j in range(i + 1)]


_MEANS = [f"m{i}" for i in range(_D)]
_COVS = [f"c{i}{j}" for i in range(_D) for j in range(i + 1)]
_FACTORS = [f"w{i}{j}" for i in range(_D) for j in range(i + 1)]
_PACKED = [*_MEANS, *_COVS, *_FACTORS]


def _packed(fits: DataFrame) -> DataFrame:
    """fits, a row for each group and start, with its estimates in one column: many small files of one column stay small enough to be broadcast."""
    values = F.array(*(F.col(c) if c in fits.columns else F.lit(None).cast("double") for c in _PACKED))
    return fits.select("__group", "__start", (F.col("logdet") if "logdet" in fits.columns else F.lit(None).cast("double")).alias("logdet"), values.alias("__fit"))


def _unpacked(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col("__fit")[_PACKED.index(c)] for c in names}).drop("__fit")


def _distance() -> Column:
    """Squared Mahalanobis distance by the columns m0.. and w00.. of a row's group."""
    total = F.lit(0.0)
    for i in range(_D):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col(f"w{i}{j}") * (F.col(f"z{j}") - F.col(f"m{j}"))
        total = total + part * part
    return total


def _fit(rows: DataFrame, weight: Column, floor: float) -> DataFrame:
    """Weighted mean, covariance and its factors of rows, by group and start.

    Moments are rounded to nine digits after the point, so they do not depend on the order
    in which partial sums meet. floor is added to each variance before it is factored.
    """
    w = rows.withColumn("__w", weight.cast("double"))
    each = lambda *zs: F.sum(functools.reduce(operator.mul, map(F.col, zs), F.col("__w")))
    sums = w.groupBy("__group", "__start").agg(F.sum("__w").alias("w"), *(each(f"z{i}").alias(f"s{i}") for i in range(_D)), *(each(f"z{i}", f"z{j}").alias(f"s{i}{j}") for i in range(_D) for j in range(i + 1))).where("w > 0")
    mean = lambda i: F.col(f"s{i}") / F.col("w")
    means = [F.round(mean(i), 9).alias(f"m{i}") for i in range(_D)]
    covs = [F.round(F.col(f"s{i}{j}") / F.col("w") - mean(i) * mean(j), 9).alias(f"c{i}{j}") for i in range(_D) for j in range(i + 1)]
    fitted, factors = _factor(sums.select("__group", "__start", *means, *covs), lambda i, j: F.col(f"c{i}{j}") + (floor if i == j else 0.0))
    return fitted.select("__group", "__start", *_MEANS, *_COVS, *factors, "logdet")


def _concentrate(rows: DataFrame, fits: DataFrame, inner: float, floor: float) -> DataFrame:
    """One concentration step: packed fits to the inner share of each group's rows, those nearest by the packed fits before.

    Which rows these are is read from exact counts of distances by steps of 1.6 %. Rows of the
    step that the share ends in count in part, so that every fit is one of the same share
    and determinants can be compared; equal rows count alike.
    """
    step = F.floor(F.ln(_distance() + 1e-6) * 64).cast("int")
    near = _unpacked(rows.join(fits.select("__group", "__start", "__fit"), ["__group", "__start"]), *_MEANS, *_FACTORS).select("__group", "__start", *(f"z{i}" for i in range(_D)), step.alias("__step"))
    # written, so that windows meet a row a step: planned in one go, they would take in each task's partial counts of a hot group
    counts = written(near.groupBy("__group", "__start", "__step").agg(F.count(F.lit(1)).alias("n")), "counts")
    whole = Window.partitionBy("__group", "__start")
    upto = F.sum("n").over(whole.orderBy("__step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = counts.withColumn("upto", upto).withColumn("inside", inner * F.sum("n").over(whole)).where("upto >= inside and upto - n < inside")
    edge = written(ends.select("__group", "__start", F.col("__step").alias("__edge"), ((F.col("inside") - F.col("upto") + F.col("n")) / F.col("n")).alias("__part")), "edges")
    weight = F.when(F.col("__step") < F.col("__edge"), 1.0).when(F.col("__step") == F.col("__edge"), F.col("__part")).otherwise(0.0)
    return written(_packed(_fit(near.join(edge, ["__group", "__start"]), weight, floor)), "fit")


def _quartiles(rows: DataFrame, floor: float) -> DataFrame:
    """Start 0, of no covariances: medians of each group and axis, and quartile ranges, from exact counts by steps of 1/32."""
    axes = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col(f"z{i}") * 32).alias("step")) for i in range(_D)))).alias("a")
    counts = written(rows.select("__group", axes).groupBy("__group", F.col("a.i").alias("i"), F.col("a.step").alias("step")).agg(F.count(F.lit(1)).alias("n")), "counts")
    axis = Window.partitionBy("__group", "i")
    ranked = counts.withColumn("upto", F.sum("n").over(axis.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("all", F.sum("n").over(axis))
    at = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("step"))) + 0.5) / 32
    each = ranked.groupBy("__group", "i").agg(at(0.5).alias("m"), (1 / F.sqrt(((at(0.75) - at(0.25)) / 1.349) ** 2 + floor)).alias("w"))
    of = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    whole = each.groupBy("__group").agg(*(of("m", i).alias(f"m{i}") for i in range(_D)), *((of("w", i) if i == j else F.max(F.lit(0.0))).alias(f"w{i}{j}") for i in range(_D) for j in range(i + 1)))
    return whole.withColumn("__start", F.lit(0))


def covariance_determinant(rows: DataFrame, *, inner: float = 0.75, starts: int = 10, draw: int = 50, nest: int = 500, floor: float = 0.01, seed: int = 0) -> DataFrame:
    """Minimum covariance determinant of each group of rows(__group, __key, z0..): __group, m0.., c00.., logdet.

    Starts are tried on a seeded sample of about nest rows of each group, which is all of a
    smaller one: the medians of the whole group with its quartile ranges, and starts - 1 fits to about
    draw rows of the sample, or half of a smaller one (rows by their hashed __key). Each concentrates twice; the one with
    the least determinant goes on over all rows of its group until a step lowers the
    determinant's logarithm by less than 0.001, each group by itself, and the least that
    was seen there is the result. A step that raises it is never taken; falls end, as floor bounds the
    determinant from below. All steps are grouped aggregates with partial sums, joined back
    as a row a group; rows themselves never meet in a task. floor is a variance that each
    axis has in addition: axes without spread stay regular.
    """
    sizes = written(rows.groupBy("__group").agg(F.count(F.lit(1)).alias("__n")), "sizes")
    centre = written(_packed(_quartiles(rows, floor)), "fit")
    below = lambda what, limit: F.pmod(F.xxhash64(F.lit(seed), what, "__key"), F.lit(1 << 30)) < limit * float(1 << 30)
    nested = written(rows.join(sizes, "__group").where(below(F.lit("nest"), F.lit(float(nest)) / F.col("__n"))), "nested")
    every = nested.withColumn("__start", F.explode(F.array(*(F.lit(i) for i in range(starts)))))
    held = F.least(F.col("__n"), F.lit(float(nest)))
    drawn = _fit(every.where("__start > 0"), F.when(below(F.col("__start"), F.least(F.lit(float(draw)), held / 2) / held), 1).otherwise(0), floor)
    fits = written(_packed(drawn).unionByName(centre), "fit")
    for _ in range(2):
        fits = _concentrate(every, fits, inner, floor)
    # a sample by hashes can miss a small or uniform group: its medians go on then
    tried = fits.withColumn("__late", F.lit(0)).unionByName(centre.withColumn("__late", F.lit(1)))
    least = tried.groupBy("__group").agg(F.min_by("__fit", F.struct("__late", "logdet", "__start")).alias("__fit"))
    one = rows.withColumn("__start", F.lit(0))
    now = _concentrate(one, written(least.withColumn("__start", F.lit(0)), "best"), inner, floor)
    seen = now
    while not now.isEmpty():
        new = _concentrate(one, now, inner, floor)
        seen = seen.unionByName(new)
        before = now.select("__group", F.col("logdet").alias("__before"))
        now = written(new.join(before, "__group").where("__before - logdet >= 0.001").drop("__before"), "falling")
    best = seen.groupBy("__group").agg(F.min_by(F.struct("logdet", "__fit"), F.struct("logdet", "__fit")).alias("b"))
    return _unpacked(best.select("__group", "b.logdet", "b.__fit"), *_MEANS, *_COVS).select("__group", *_MEANS, *_COVS, "logdet")


def robust_outliers(
    rows: DataFrame, vector: list[Column], group: Column, fallback: Column, *, inner: float = 0.75, rate: float = 1e-4, floor: float = 0.01, prior: float = 100.0, seed: int = 0, **options,
) -> DataFrame:
    """rows with d2, the squared robust Mahalanobis distance, and outlier (beyond the chi-square quantile that a share of rate of normal rows passes).

    Estimates are minimum covariance determinants, see covariance_determinant(), made
    consistent for normal rows by the usual factor. A group's estimate is drawn towards that
    of its fallback group by n / (n + prior) of n rows, mean and covariance alike, so no
    number of rows switches between the two and a verdict changes only as smoothly as the
    estimates do. floor: the least variance that a difference on an axis is measured by.
    """
    z = [f"z{i}" for i in range(_D)]
    # zero has one sign: equal rows get equal hashes
    base = rows.withColumns({f"z{i}": x.cast("double") + 0.0 for i, x in enumerate(vector)}).withColumns({"__fine": group, "__coarse": fallback})
    both = base.select(F.explode(F.array("__fine", "__coarse")).alias("__group"), *z, F.xxhash64(*z).alias("__key"))
    fits = covariance_determinant(written(both, "vectors"), inner=inner, floor=floor, seed=seed, **options)
    consistent = inner / chi_square(chi_square_quantile(inner, _D), _D + 2)
    groups = base.groupBy("__fine").agg(F.min("__coarse").alias("__coarse"), F.count(F.lit(1)).alias("__n"))
    pick = lambda side: fits.select(F.col("__group").alias(f"__{side}"), *(F.col(c).alias(f"__{side}_{c}") for c in (*_MEANS, *_COVS)))
    pairs = groups.join(pick("fine"), "__fine").join(pick("coarse"), "__coarse").withColumn("__a", F.col("__n") / (F.col("__n") + prior))
    between = lambda c: F.col("__a") * F.col(f"__fine_{c}") + (1 - F.col("__a")) * F.col(f"__coarse_{c}")
    cov = lambda i, j: consistent * between(f"c{i}{j}") + (floor if i == j else 0.0)
    drawn, factors = _factor(pairs.withColumns({f"m{i}": between(f"m{i}") for i in range(_D)}), cov)
    drawn = written(drawn.select("__fine", *_MEANS, *factors), "estimates")
    out = base.join(drawn, "__fine").withColumn("d2", _distance())
    return out.withColumn("outlier", F.col("d2") > chi_square_quantile(1 - rate, _D)).drop("__fine", "__coarse", *z, *_MEANS, *factors)


def quality_rules(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    min_words: int = 50, rate: float = 1e-4,
) -> DataFrame:
    """Base statistics of each text, base rules, and the robust-outlier verdict per language and source.

    Words are runs of anything but blank, tab, line feed, vertical tab, form feed and
    carriage return. base_failed: fewer than min_words words, or more than half of the
    words in windows of three words that occur twice or more. Rows that pass are
    transformed (log of words, mean word length, roots of symbols and of duplicate lines a
    word, and the share of repeated words) and judged by robust_outliers() in their
    language and source; kept is false for outliers and for rows that failed. rate: the share
    of rows without fault that a normal distribution would have rejected.

    Null texts count as empty, so they fail; null languages and sources are groups of
    their own; repeated rows are judged alike, each in a row of its own; an empty table
    gives an empty result; other columns are ignored.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, d2 (null where the base rules failed).
    """
    named = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang"), F.col(source_col).cast("string").alias("__source"))
    rows = with_statistics(named, "__text").drop("__text")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = written(rows.withColumn("base_failed", failed), "statistics")
    share = lambda c: F.sqrt(F.col(c) / F.greatest(F.col("n_words"), F.lit(1)))
    vector = [F.ln(F.col("n_words") + 1.0), F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)), share("n_symbols"), share("n_dup_lines"), F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1))]
    key = lambda *cs: F.concat(*(F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in cs))
    lang, source = F.col("__lang"), F.col("__source")
    fine, coarse = F.concat(F.length(key(lang)).cast("string"), key(lang), key(source)), F.concat(F.lit("*"), key(lang))
    judged = robust_outliers(rows.where(~F.col("base_failed")), vector, fine, coarse, rate=rate)
    out = ["__id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = judged.select(*out, (~F.col("outlier")).alias("kept"), "d2")
    rest = rows.where("base_failed").select(*out, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("d2"))
    return passed.unionByName(rest).withColumnRenamed("__id", id_col)
