"""Quality rules with robust multivariate outliers (minimum covariance determinant); DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import discard, n_words, written

#: Standard deviations that a transformed statistic has at least: below, differences don't matter.
FLOORS = {"x0": 0.10, "x1": 0.15, "x2": 0.10, "x3": 0.15}
#: Share of a group that the determinant is minimised over; a fall of its logarithm that counts as none.
SHARE, SETTLED = 0.75, 1e-3
#: Rows expected in a drawn start, and steps of all starts before the best one goes on alone.
DRAWN, TRIALS = 20, 2
#: Rows that a parent's estimate is worth beside a group's own: its weight is n / (n + PRIOR).
PRIOR = 40
#: Estimates are broadcast up to this many rows (about 300 bytes each); beyond, they are joined by SALTS parts of each group.
ESTIMATES, SALTS = 50_000, 32
#: Quantiles of the chi-square distribution with four degrees of freedom: its median, and what one in a thousand exceeds.
MEDIAN, CUTOFF = 3.3567, 18.467
XS = list(FLOORS)


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice, first ones included.

    Windows are compared by 64-bit hashes. Only where some repeat are they sorted with their places; equal neighbours repeat.
    """
    n = F.size(words) - 2
    windows = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), F.greatest(n, F.lit(0)))
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def hits(s: Column) -> Column:
        twin = F.transform(s, lambda x, j: F.when((x.h == F.get(s, j + 1)["h"]) | (x.h == F.get(s, j - 1)["h"]), x.i))
        at = F.filter(twin, lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    count = F.get(F.transform(F.array(ordered), hits), F.lit(0))
    return F.when(n < 2, 0).when(F.size(F.array_distinct(windows)) == n, 0).otherwise(count).cast("long")


def statistics(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); null text: all 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), "lang", "source", text.alias("text")).withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    once = F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0))
    return rows.select(
        "doc_id", "lang", "source", n_words(F.col("text")).alias("n_words"), F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), once.cast("long").alias("n_dup_lines"), repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def meet(rows: DataFrame, fits: DataFrame, by: list[str], n_fits: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with one row of ``fits`` a group, ``n_fits`` in all. No group meets in one task.

    Few fits are broadcast; many are repeated SALTS times, and each part of a group meets its own copy.
    """
    if n_fits <= ESTIMATES:
        return rows.join(F.broadcast(fits), by, how)
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))
    copies = fits.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return rows.withColumn("_part", part).join(copies, [*by, "_part"], how).drop("_part")


def moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, mean, cov): each group's means and the lower triangle of its covariance, variances widened by the floors."""
    d = range(len(XS))
    means = [F.avg(x) for x in XS]
    covs = [F.covar_pop(XS[i], XS[j]) + (FLOORS[XS[i]] ** 2 if i == j else 0.0) for i in d for j in range(i + 1)]
    return rows.groupBy(*by).agg(F.array(*means).alias("mean"), F.array(*covs).alias("cov"))


def with_factor(fits: DataFrame) -> DataFrame:
    """With chol, the lower triangle of the Cholesky factor of cov, and logdet, the logarithm of its determinant."""
    d, names = len(XS), []
    for i in range(d):
        for j in range(i + 1):
            rest = F.col("cov")[len(names)]
            for k in range(j):
                rest = rest - F.col(f"c{i}{k}") * F.col(f"c{j}{k}")
            fits = fits.withColumn(f"c{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"c{j}{j}"))
            names.append(f"c{i}{j}")
    logdet = sum((2 * F.log(f"c{i}{i}") for i in range(1, d)), 2 * F.log("c00"))
    return fits.withColumns({"chol": F.array(*names), "logdet": logdet}).drop(*names)


def with_distance(rows: DataFrame) -> DataFrame:
    """With d2, the squared Mahalanobis distance, in place of mean and chol."""
    for i, x in enumerate(XS):
        z = F.col(x) - F.col("mean")[i]
        for j in range(i):
            z = z - F.col("chol")[i * (i + 1) // 2 + j] * F.col(f"y{j}")
        rows = rows.withColumn(f"y{i}", z / F.col("chol")[i * (i + 1) // 2 + i])
    total = sum(F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, len(XS))) + F.col("y0") * F.col("y0")
    return rows.withColumn("d2", total).drop("mean", "chol", *[f"y{i}" for i in range(len(XS))])


def least_determinant(rows: DataFrame) -> DataFrame:
    """(g, n, mean, cov, logdet) of each group ``g`` of ``rows`` (g, x0 to x3): the subset with the least determinant found.

    Four starts: the SHARE nearest to the medians in units of the floors, and of the median deviations; and two drawn by
    hash, of about DRAWN rows. Concentration steps follow: the SHARE of rows nearest by an estimate give the next one,
    whose determinant is no larger. After TRIALS steps the best start of a group goes on until its determinant settles.
    All statistics are partial aggregates. Repeated rows count each; no rows: no groups.
    """
    medians = lambda names, to: [F.percentile_approx(e, 0.5, 10000).alias(x + to) for x, e in names]
    middle = written(rows.groupBy("g").agg(F.count("*").alias("n"), *medians([(x, F.col(x)) for x in XS], "m")), "middle")
    groups = middle.count()
    off = meet(rows, middle, ["g"], groups)
    spread = off.groupBy("g").agg(*medians([(x, F.abs(F.col(x) - F.col(x + "m"))) for x in XS], "s"))
    first = written(middle.join(spread, "g"), "middle")
    far = lambda unit: sum(((F.col(x) - F.col(x + "m")) / unit(x)) ** 2 for x in XS[1:]) + ((F.col(XS[0]) - F.col(XS[0] + "m")) / unit(XS[0])) ** 2
    drawn = lambda seed: F.when(F.pmod(F.xxhash64(F.lit(seed), *XS), F.lit(1 << 20)) * F.col("n") < DRAWN * (1 << 20), 0.0)
    starts = [far(lambda x: F.lit(FLOORS[x])), far(lambda x: F.greatest(1.4826 * F.col(x + "s"), F.lit(FLOORS[x]))), drawn(1), drawn(2)]
    tried = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), d.alias("d2")) for i, d in enumerate(starts)]))
    near = meet(rows, first, ["g"], groups).select("g", *XS, tried.alias("t")).select("g", *XS, "t.s", "t.d2").where("d2 is not null")

    def closest(near: DataFrame, size: int) -> DataFrame:
        cut = near.groupBy("g", "s").agg(F.percentile_approx("d2", SHARE, 10000).alias("cut"))
        return written(with_factor(moments(meet(near, cut, ["g", "s"], size).where("d2 <= cut"), ["g", "s"])), "fit")

    def step(fits: DataFrame, size: int) -> DataFrame:
        return closest(with_distance(meet(rows, fits.select("g", "s", "mean", "chol"), ["g"], size)), size)

    fits = closest(near, groups * len(starts))
    for _ in range(TRIALS):
        last, fits = fits, step(fits, groups * len(starts))
        discard(last)
    best = fits.groupBy("g").agg(F.min_by(F.struct("s", "mean", "cov", "chol", "logdet"), F.struct("logdet", "s")).alias("f"))
    last, fits = fits, written(best.select("g", "f.*", F.lit(True).alias("moving")), "fit")
    discard(last)
    while moving := fits.where("moving").count():
        found = step(fits.where("moving"), moving)
        new = found.select("g", F.struct("mean", "cov", "chol", "logdet").alias("new"))
        old, gain = F.struct("mean", "cov", "chol", "logdet"), F.col("logdet") - F.col("new.logdet")
        both = fits.join(new, "g", "left").select("g", "s", F.when(gain > 0, F.col("new")).otherwise(old).alias("f"), F.coalesce(gain > SETTLED, F.lit(False)).alias("moving"))
        last, fits = fits, written(both.select("g", "s", "f.*", "moving"), "fit")
        discard(last, found)
    middle_distance = with_distance(meet(rows, fits.select("g", "mean", "chol"), ["g"], groups)).groupBy("g").agg((F.percentile_approx("d2", 0.5, 10000) / MEDIAN).alias("scale"))
    wide = F.greatest("scale", F.lit(1.0))
    out = fits.join(middle_distance, "g").join(first.select("g", "n"), "g").select("g", "n", "mean", F.transform("cov", lambda c: c * wide).alias("cov"), "logdet")
    result = written(out, "fit")
    discard(fits, first, middle)
    return result


def mixture(own: DataFrame, parent: DataFrame, by: list[str]) -> DataFrame:
    """(own's columns) with mean and cov of the mixture of own's rows, n of them, and PRIOR rows of the parent (by, pmean, pcov)."""
    w, d = F.col("n") / (F.col("n") + PRIOR), range(len(XS))
    gap = lambda i: F.col("mean")[i] - F.col("pmean")[i]
    means = [w * F.col("mean")[i] + (1 - w) * F.col("pmean")[i] for i in d]
    at = [(i, j) for i in d for j in range(i + 1)]
    covs = [w * F.col("cov")[k] + (1 - w) * F.col("pcov")[k] + w * (1 - w) * gap(i) * gap(j) for k, (i, j) in enumerate(at)]
    both = own.join(parent, by) if by else own.join(F.broadcast(parent), how="cross")
    rest = [c for c in own.columns if c not in ("mean", "cov")]
    return both.select(*rest, F.array(*means).alias("mean"), F.array(*covs).alias("cov"))


def judge(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2).

    Base rules first: fewer than 50 words, or more than half of them in repeated windows. All others are judged within
    their language and source by transformed statistics: log of word length, roots of symbol, line and window repetition
    rates. Mean and covariance are those of ``least_determinant``, scaled so that the median distance is at least that of
    the chi-square; a group's estimate is mixed with that of its language as if with PRIOR rows of it, and that with the
    one of all rows, so that small groups and large ones are treated alike. A row is rejected if its squared distance is
    beyond CUTOFF.

    Null lang or source: a group of its own. Null and empty texts fail the base rules. Repeated rows count each;
    empty table: no rows. Other columns are not read. All group statistics are partial aggregates; no group meets in one task.
    """
    base = statistics(docs, doc_id)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    base = base.withColumns({
        "base_failed": failed,
        "x0": F.log((1 + F.col("word_chars")) / n), "x1": F.sqrt(F.col("n_symbols") / n), "x2": F.sqrt(F.col("n_dup_lines") / n), "x3": F.sqrt(F.col("n_repeat_words") / n),
        "k1": F.coalesce(F.concat(F.lit("1:"), "lang"), F.lit("1")), "source": F.coalesce(F.concat(F.lit(":"), "source"), F.lit("")),
    })
    base = base.withColumn("k2", F.concat(F.lit("2:"), F.length("k1"), F.lit(":"), "k1", "source"))
    base = written(base.drop("lang", "source"), "statistics")
    rest = base.where("not base_failed")
    rows = written(rest.select(F.explode(F.array(F.lit("0"), "k1", "k2")).alias("g"), *XS), "outliers")
    fits = least_determinant(rows)
    discard(rows)
    parent = lambda t, *keys: t.select(*keys, F.col("mean").alias("pmean"), F.col("cov").alias("pcov"))
    langs = mixture(fits.where("g like '1%'"), parent(fits.where("g = '0'")), [])
    keys = rest.select("k1", F.col("k2").alias("g")).distinct()
    groups = mixture(fits.where("g like '2%'").join(keys, "g"), parent(langs, F.col("g").alias("k1")), ["k1"])
    final = written(with_factor(groups).select(F.col("g").alias("k2"), "mean", "chol"), "fit")
    judged = with_distance(meet(base, final, ["k2"], final.count(), "left")).withColumn("d2", F.when(~F.col("base_failed"), F.col("d2")))
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "d2")
