"""Quality rules: base counts of a text, and robust multivariate outliers.

Everything is a DataFrame or SQL expression. Statistics of a text are computed
inside its row; only short vectors of whole numbers are aggregated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import beside, filled, let, only, words
from marginalia.session import cut, scratch

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Share of a pool that the determinant is minimised over.
SUBSET = 0.75
#: Concentration steps from every start, after which the one with the least determinant goes on until its subset stays, and most steps in all.
TRIAL, STEPS = 2, 12
STARTS = 3
#: A language and source with fewer documents are judged by all of the language, then by the whole corpus.
MIN_POOL = 200
#: Names of the transformed statistics and the standard deviation each is given on top of its own: the estimate is a
#: regularised one, so that a statistic that is the same in almost all documents doesn't make the determinant vanish.
STATISTICS = {"word_length": 0.15, "symbols": 0.15, "capitals": 0.2, "stops": 0.2, "same_lines": 0.1}
#: Probability of the chi-square distribution beyond which a document is rejected.
TAIL = 1e-12
SCALE = 1000


def chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-square with k degrees of freedom (series of the incomplete gamma function)."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= z / (a + n)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_sf(x: float, k: int) -> float:
    """Upper tail by a continued fraction, exact far out as well."""
    if x < k + 1:
        return 1 - chi2_cdf(x, k)
    a, z = k / 2, x / 2
    b, c = z + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_at(tail: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_sf(mid, k) > tail else (low, mid)
    return high


def repeated_words(found: Column) -> Column:
    """Words in windows of eight that stand in the array twice or more.

    Windows are hashed (64 bits) and, only where two are equal, sorted with
    their places; the places of equal ones, in order, cover at most eight words
    each. n log n for n words, all inside the row.
    """
    pair = lambda h, k: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + k)))
    eights = let(let(pair(found, 1), lambda h: pair(h, 2)), lambda h: pair(h, 4))  # hashes of 2, 4, 8 words
    hashes = F.when(F.size(found) >= WINDOW, let(eights, lambda h: F.slice(h, F.lit(1), F.size(h) - WINDOW + 1))).otherwise(F.array().cast("array<bigint>"))

    def cover(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.coalesce(F.least(F.lit(WINDOW), F.get(at, k + 1) - p), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    def twice(pairs: Column) -> Column:
        def shared(x: Column, k: Column) -> Column:  # get() is null before the first and after the last
            return F.coalesce(F.get(pairs, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False))

        places = F.transform(F.filter(pairs, shared), lambda x: x["at"])
        return let(F.sort_array(places), cover)

    def both(h: Column) -> Column:
        sorted_pairs = F.sort_array(F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(sorted_pairs, twice)).otherwise(F.lit(0))

    return let(hashes, both)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_stops")


def measures(column: str = "text") -> list[Column]:
    """The counts of a text as columns; null text has no words."""
    text = filled(F.col(column))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    kept = lambda keep: F.length(F.regexp_replace(text, keep, "")).cast("long")
    return [
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        kept(r"[^#*$%&|<>]+").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        kept(r"\P{Lu}+").alias("n_capitals"),
        kept(r"[^.,;:!?]+").alias("n_stops"),
    ]


def _flat(prefix: str = "") -> list[Column]:
    inner = {"n_words": "w.", "word_chars": "w.", "n_repeat_words": "w.", "n_lines": "l.", "n_dup_lines": "l."}
    return [F.col(f"{prefix}{inner.get(c, '')}{c}").alias(c) for c in COUNTS]


BASE_FAILED = (f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


def counts(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every text."""
    measured = only(documents, "doc_id", "lang", "source", "text").select("doc_id", "lang", "source", *measures())
    return measured.select("doc_id", "lang", "source", *_flat()).withColumn("base_failed", F.expr(BASE_FAILED))


def vector(n: str = "n_words", chars: str = "word_chars") -> list[Column]:
    """The transformed statistics, as whole thousandths so that sums don't depend on their order.

    Rates are taken after a hundred ordinary words, which keeps those of short
    texts as steady as those of long ones; rare things count by log(1 + 100 x).
    """
    rate = lambda x, usual: F.log1p(100 * (F.col(x) + usual) / (F.col(chars) + 500))
    made = [
        (F.col(chars) + 500) / (F.col(n) + 100),
        rate("n_symbols", 0),
        rate("n_capitals", 8),
        rate("n_stops", 13),
        F.log1p(10 * F.col("n_dup_lines") / (F.col("n_lines") + 10)),
    ]
    return [F.round(SCALE * x).cast("long").alias(f"x{i}") for i, x in enumerate(made)]


P = len(STATISTICS)
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _total(terms: list[str]) -> str:
    return "(" + " + ".join(terms or ["0D"]) + ")"


def _shape(df: DataFrame) -> DataFrame:
    """pool, start, centre m0.., the inverse Cholesky factor k00, k10, .. of its (regularised) covariance, and det, the root of its determinant.

    Written as SQL text: a few hundred scalar terms would be slow to build one call at a time.
    """
    axes = range(P)
    x = [f"cast(x{i} as double)" for i in axes]
    sums = df.groupBy("pool", "start").agg(F.expr("count(1) as n"), *[F.expr(f"sum({x[i]}) as s{i}") for i in axes], *[F.expr(f"sum({x[i]} * {x[j]}) as s{i}{j}") for i, j in _PAIRS])
    floor = [SCALE * s for s in STATISTICS.values()]
    out = sums.selectExpr("pool", "start", *[f"s{i} / n as m{i}" for i in axes],
                          *[f"(s{i}{j} - s{i} * s{j} / n) / n + {floor[i] ** 2 if i == j else 0.0}D as c{i}{j}" for i, j in _PAIRS])
    for j in axes:
        out = out.selectExpr("*", f"sqrt(c{j}{j} - {_total([f'l{j}{k} * l{j}{k}' for k in range(j)])}) as l{j}{j}")
        out = out.selectExpr("*", *[f"(c{i}{j} - {_total([f'l{i}{k} * l{j}{k}' for k in range(j)])}) / l{j}{j} as l{i}{j}" for i in range(j + 1, P)])
    for d in axes:  # the inverse by diagonals
        out = out.selectExpr("*", *[f"1 / l{j}{j} as k{j}{j}" if d == 0 else f"-{_total([f'l{j + d}{k} * k{k}{j}' for k in range(j, j + d)])} / l{j + d}{j + d} as k{j + d}{j}" for j in range(P - d)])
    return out.select(*SHAPE[:-1], F.expr(" * ".join(f"l{j}{j}" for j in axes)).alias("det"))


#: Columns of an estimate.
SHAPE = ("pool", "start", *(f"m{i}" for i in range(P)), *(f"k{i}{j}" for i, j in _PAIRS), "det")


def _distance() -> Column:
    ys = [_total([f"k{i}{j} * (x{j} - m{j})" for j in range(i + 1)]) for i in range(P)]
    return F.expr(_total([f"{y} * {y}" for y in ys]))


def _concentrated(rated: DataFrame, shape: DataFrame, subset: float = SUBSET) -> DataFrame:
    """One step for every pool and start: the estimate from the rows up to the bin of d2 in which the ``subset`` quantile lies.

    The quantile is read off counts of 1/64 octaves of d2: at most a few
    thousand bins a pool, whatever its rows. Estimates and bins are broadcast
    if there are few pools, so the vectors stay where they are.
    """
    salt = F.struct(*[f"x{i}" for i in range(P)])
    far = beside(rated, shape, [("pool", "__pool")], salt, limit=BROADCAST_POOLS).select(
        "pool", "start", *[f"x{i}" for i in range(P)], F.floor(64 * F.log2(_distance() + 1e-9)).cast("int").alias("bin"))
    run = Window.partitionBy("pool", "start").orderBy("bin")
    cuts = (
        far.groupBy("pool", "start", "bin").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy("pool", "start")))
        .where(F.col("upto") >= F.ceil(subset * F.col("all"))).groupBy("pool", "start").agg(F.min("bin").alias("last")))
    cuts = cut(cuts.select(F.col("pool").alias("__pool"), F.col("start").alias("__start"), "last"))
    near = beside(far, cuts, [("pool", "__pool"), ("start", "__start")], salt, limit=BROADCAST_POOLS).where("bin <= last")
    return cut(_shape(near))


def pools(docs: DataFrame, min_pool: int = MIN_POOL) -> DataFrame:
    """lang, source, pool, feeds: the pool that judges a language and source, and all pools their documents are part of.

    Language and source, or, of those with too few documents, the whole language,
    or the whole corpus, large sources included. A wider pool is only made where
    some pair is judged by it.
    """
    sizes = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).withColumn("in_lang", F.sum("n").over(Window.partitionBy("lang")))
    own = F.to_json(F.struct(F.lit(0).alias("level"), "lang", "source"))
    by_lang = F.to_json(F.struct(F.lit(1).alias("level"), "lang"))
    every = F.lit('{"level":2}')
    named = sizes.select("lang", "source", own.alias("own"), by_lang.alias("by_lang"), every.alias("every"),
                         F.when(F.col("n") >= min_pool, own).when(F.col("in_lang") >= min_pool, by_lang).otherwise(every).alias("pool"))
    used = named.agg(F.collect_set(F.when(F.col("pool") != F.col("own"), F.col("pool"))).alias("used"))  # one a language at most
    feeds = F.filter(F.array("own", "by_lang", "every"), lambda x: (x == F.col("pool")) | F.array_contains("used", x))
    return named.crossJoin(F.broadcast(used)).select("lang", "source", "pool", feeds.alias("feeds"))


#: Up to so many pools, or pairs of language and source, their estimates (20 numbers each) are broadcast; beyond, joined in salted parts.
BROADCAST_POOLS = 30_000


def _starts(rated: DataFrame) -> DataFrame:
    """Estimates to start from: medians with the least deviations, medians with quartile deviations, and mean and covariance of all."""
    floor = [SCALE * s for s in STATISTICS.values()]
    found = cut(rated.groupBy("pool").agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i in range(P)]))
    made = cut(_shape(rated.withColumn("start", F.lit(2))))
    for start in (1, 0):
        wide = [f"{floor[i]}D" if start == 0 else f"greatest({floor[i]}D, (q{i}[2] - q{i}[0]) / 1.349D)" for i in range(P)]
        made = made.unionByName(found.select(
            "pool", F.lit(start).alias("start"), *[F.expr(f"cast(q{i}[1] as double) as m{i}") for i in range(P)],
            *[F.expr(f"{f'1D / {wide[i]}' if i == j else '0D'} as k{i}{j}") for i, j in _PAIRS], F.lit(0.0).alias("det")))
    return cut(made)


def estimates(docs: DataFrame, *, subset: float = SUBSET, steps: int = STEPS, min_pool: int = MIN_POOL) -> DataFrame:
    """l, s (language, source) and the centre and inverse Cholesky factor of their pool.

    ``docs`` has lang, source, base_failed and x0, x1, ... A pool's estimate
    concentrates from several starts: centre and covariance of the ``subset``
    nearest documents, distances from those, and so on; a step can only lower
    the determinant, but for what the bins add to the subset. After a few steps
    the start with the least determinant goes on until no pool's estimate
    changes, for ``steps`` at most. Pools of fewer than ``min_pool`` documents
    have no estimate.
    """
    fine = docs.where(~F.col("base_failed"))
    named = cut(pools(fine, min_pool).select(F.col("lang").alias("l"), F.col("source").alias("s"), "pool", "feeds"))
    salt = F.struct(*[f"x{i}" for i in range(P)])
    joined = beside(fine.select("lang", "source", *[f"x{i}" for i in range(P)]), named.select("l", "s", "feeds"), [("lang", "l"), ("source", "s")], salt, limit=BROADCAST_POOLS)
    rated = cut(joined.select(F.explode("feeds").alias("pool"), *[f"x{i}" for i in range(P)]))
    keyed = lambda shape: shape.withColumnRenamed("pool", "__pool")
    shape = _starts(rated)
    for _ in range(TRIAL):
        shape = _concentrated(rated, keyed(shape), subset)
    shape = cut(shape.groupBy("pool").agg(F.min_by(F.struct(*SHAPE), F.struct("det", "start")).alias("x")).select("x.*"))
    for _ in range(TRIAL, steps):
        before, shape = shape, _concentrated(rated, keyed(shape), subset)
        if shape.join(before, list(SHAPE), "left_anti").isEmpty():
            break
    enough = rated.groupBy("pool").count().where(F.col("count") >= min_pool).select("pool")
    return cut(named.drop("feeds").join(shape.join(enough, "pool", "left_semi"), "pool").drop("pool", "start", "det"))


def _rated(docs: DataFrame, shape: DataFrame, salt: Column, subset: float = SUBSET) -> DataFrame:
    """With d2, scaled to be chi-square for ordinary documents (consistency factor of the subset); null where the base or the pool has none."""
    consistent = subset / chi2_cdf(chi2_at(1 - subset, P), P + 2)
    joined = beside(docs, shape, [("lang", "l"), ("source", "s")], salt, limit=BROADCAST_POOLS, how="left")
    return joined.withColumn("d2", F.when(~F.col("base_failed"), _distance() / consistent))


def verdicts(documents: DataFrame, *, subset: float = SUBSET, steps: int = STEPS, min_pool: int = MIN_POOL, tail: float = TAIL) -> DataFrame:
    """Counts, base_failed, kept and d2 (robust squared Mahalanobis distance) of every document.

    Statistic vectors are pooled by language and source; documents that fail
    the base rules take no part. A document beyond the chi-square ``tail`` is
    rejected. A pair with fewer than ``min_pool`` documents is judged by all of
    its language, where that has fewer by the whole corpus; only a corpus that
    has fewer than ``min_pool`` gives no estimate, and none is rejected.

    Nulls: null text has no words and fails the base rules; null language or
    source are values of their own. Ties in distance stay together. Repeated
    rows are documents of their own; an empty table gives no rows.
    """
    docs = cut(counts(documents).select("*", *vector()))
    out = _rated(docs, estimates(docs, subset=subset, steps=steps, min_pool=min_pool), F.struct(*[f"x{i}" for i in range(P)]), subset)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= chi2_at(tail, P))).alias("kept"), "lang", "source", "d2")


def keep_good(documents: DataFrame, tail: float = TAIL) -> DataFrame:
    """The rows that are kept, all columns.

    Every text is measured once: the rows are written to the shared folder with
    their vectors beside them (once the input's size), estimates come from the
    vectors, and the written rows are filtered where they lie, so no text is
    shuffled. The copy stays until ``session.sweep``: the result reads it.
    """
    spark = documents.sparkSession
    folder = scratch(spark, "quality")
    own = [documents[c].alias(f"c{i}") for i, c in enumerate(documents.columns)]  # names of any kind
    measured = documents.select(F.struct(*own).alias("row"), documents["lang"].alias("lang"), documents["source"].alias("source"), F.struct(*measures()).alias("__q"))
    vectors = measured.select("row", "lang", "source", *_flat("__q.")).select("row", "lang", "source", F.expr(BASE_FAILED).alias("base_failed"), *vector())
    vectors.write.option("compression", "zstd").parquet(folder)
    held = spark.read.schema(vectors.schema).parquet(folder)
    shape = estimates(held.drop("row"))
    good = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= chi2_at(tail, P))
    return _rated(held, shape, F.struct(*[f"x{i}" for i in range(P)])).where(good).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(documents.columns)])
