"""Quality rules (operator 10): robust multivariate outliers, in DataFrame functions only.

Every text gives counts, and a vector of four transformed statistics. For each
(lang, source) a location and a scatter are estimated by minimum covariance
determinant. Several starts compete: medians with median deviations, medians with
rank-like (tanh) scores, the half of rows nearest to the median, and mean with full
covariance. From each, concentration steps keep the share ``H`` of rows nearest in
Mahalanobis distance and estimate anew; the start whose scatter has the least
determinant after two steps goes on until its determinant falls no more. A row is
rejected when its squared distance exceeds the cutoff, the chi-square quantile that
a normal vector passes with probability ``TAIL``. Groups with fewer than ``least``
rows use their language's estimate, languages with fewer the overall one.

The statistics of clean text are often constant (no symbols, no repeats), which
would make the scatter singular. So each variance gets a small constant, the square
of the smallest deviation worth noticing (a regularised determinant; concentration
steps lower it all the same). A step counts only if it lowers the determinant by a
thousandth or more, so they end.

Ties: rows at the distance that closes the share ``H`` are all kept. Of starts with
equal determinants the one listed first is taken.

There is no oracle SQL: the estimate is a loop. Tests hold counts and the estimate
against plain computations.

Cases: null or empty text has no words, fails the base rule and is not kept. Null
lang or source is a group of its own. Repeated rows count as often as they occur.
An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfmatch.llm.common import BLANKS, let, materialize, pick, words_of

SYMBOLS = "#*$%&|<>"
STATS = ("x_word", "x_symbol", "x_line", "x_repeat")
#: The smallest standard deviations used, in the units of STATS.
FLOORS = (0.08, 0.06, 0.1, 0.1)
#: Share of rows that a concentration step keeps.
H = 0.75
#: Share of a normal vector's draws beyond the cutoff: fewer than one clean row in a million goes.
TAIL = 3e-7
#: Steps of every start before the best is chosen, and the least fall of the log determinant that counts.
TRIAL_STEPS, LEAST_FALL = 2, 1e-3


def chi_square_tail(x: float, degrees: int) -> float:
    """Probability that a chi-square variable of an even number of degrees exceeds x."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def chi_square_quantile(tail: float, degrees: int) -> float:
    """The value exceeded with probability tail."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_tail(mid, degrees) > tail else (low, mid)
    return high


#: Makes the scatter of the nearest share H consistent for a normal vector.
CONSISTENCY = H / (1 - chi_square_tail(chi_square_quantile(1 - H, len(STATS)), len(STATS) + 2))
#: Squared distance beyond which a row is an outlier.
CUTOFF = chi_square_quantile(TAIL, len(STATS))
WINDOW = 5


def repeated_words(words: Column) -> Column:
    """Words that lie in windows of five words which the text holds twice or more."""

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(WINDOW)]))
        return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(let(hashes, of_hashes))

    def of_hashes(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, of_sorted))

    def of_sorted(s: Column) -> Column:
        # get() gives null past either end, and null is not equal to anything
        twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        cover = F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")),
        )
        return cover["n"]

    return let(words, of_words)


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the kept columns and the counts of every text; one row per input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return pick(docs, "doc_id", "text", *keep).select(
        "doc_id",
        *keep,
        F.size(words_of(F.col("text"))).cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
        repeated_words(words_of(F.col("text"))).cast("long").alias("n_repeat_words"),
    )


def transformed(stats: DataFrame) -> DataFrame:
    """The vector of a text: mean word length and shares, shrunk towards clean text where words are few."""
    n = F.col("n_words")
    return stats.withColumns(
        {
            "x_word": F.round(F.log((F.col("word_chars") + 250.0) / (n + 50.0)), 4),
            "x_symbol": F.round(F.sqrt(F.col("n_symbols") / (n + 20.0)), 4),
            "x_line": F.round(F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5.0)), 4),
            "x_repeat": F.round(F.sqrt(F.col("n_repeat_words") / (n + 20.0)), 4),
        }
    )


def distance(x: list[Column], mean: list[Column], chol: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor."""
    y: list[Column] = []
    for i in range(len(x)):
        y.append((x[i] - mean[i] - sum((chol[i, j] * y[j] for j in range(i)), F.lit(0.0))) / chol[i, i])
    return sum((v * v for v in y[1:]), y[0] * y[0])


def with_cholesky(params: DataFrame, *by: str) -> DataFrame:
    """Location m_i, lower factor l_ij of the scatter c_ij and its log determinant; pivots are never below a part of their floors."""
    p = len(STATS)
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"c_{i}{j}") - sum((F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}") for k in range(j)), F.lit(0.0))
            value = F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 100))) if i == j else rest / F.col(f"l_{j}{j}")
            params = params.withColumn(f"l_{i}{j}", value)
    det = sum((F.log(f"l_{i}{i}") for i in range(1, p)), F.log("l_00")) * 2
    return params.select(*by, *[f"m_{i}" for i in range(p)], *[f"l_{i}{j}" for i in range(p) for j in range(i + 1)], det.alias("log_det"))


def joined(rows: DataFrame, params: DataFrame, by: tuple[str, ...] = ("g",), how: str = "left", broadcast_rows: int = 20_000) -> DataFrame:
    """rows with their group's parameters; broadcast only where the count of groups is known to be small."""
    few = params.limit(broadcast_rows + 1).count() <= broadcast_rows
    return rows.join(F.broadcast(params) if few else params, list(by), how)


def square_distance() -> Column:
    p = len(STATS)
    return F.round(distance([F.col(s) for s in STATS], [F.col(f"m_{i}") for i in range(p)], {(i, j): F.col(f"l_{i}{j}") for i in range(p) for j in range(i + 1)}), 2)


def measured(rows: DataFrame, params: DataFrame) -> DataFrame:
    return joined(rows, params).select(*rows.columns, square_distance().alias("d2"))


def moments(rows: DataFrame, by: tuple[str, ...], scale: float = 1.0) -> DataFrame:
    """Means and covariances of STATS in each group, with the regularising constants, ready for distances."""
    p = len(STATS)
    found = rows.groupBy(*by).agg(
        *[F.avg(s).alias(f"m_{i}") for i, s in enumerate(STATS)],
        *[F.covar_pop(STATS[i], STATS[j]).alias(f"v_{i}{j}") for i in range(p) for j in range(i + 1)],
    )
    scatter = found.select(
        *by,
        *[f"m_{i}" for i in range(p)],
        *[(F.col(f"v_{i}{j}") * scale + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c_{i}{j}") for i in range(p) for j in range(i + 1)],
    )
    return materialize(with_cholesky(scatter, *by), "mcd")


def concentrated(rows: DataFrame, params: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One concentration step: the moments of the share H of rows nearest by params(by, ...)."""
    near = joined(rows, params, by[:1], "inner").select(*by, *STATS, F.least(square_distance(), F.lit(1000.0)).alias("d2"))
    limit = materialize(near.groupBy(*by).agg(F.percentile("d2", F.lit(H)).alias("most")), "mcd")
    return moments(joined(near, limit, by, "inner").filter("d2 <= most"), by, CONSISTENCY)


def starts_of(rows: DataFrame) -> DataFrame:
    """The competing first estimates of each g: location and factor by start."""
    p = len(STATS)
    medians = materialize(rows.groupBy("g").agg(*[F.percentile(s, F.lit(0.5)).alias(f"med_{i}") for i, s in enumerate(STATS)]), "mcd")
    apart = lambda i: F.round(F.abs(F.col(STATS[i]) - F.col(f"med_{i}")), 4)
    spread = joined(rows, medians).groupBy("g").agg(
        *[F.first(f"med_{i}").alias(f"med_{i}") for i in range(p)], *[F.percentile(apart(i), F.lit(0.5)).alias(f"dev_{i}") for i in range(p)]
    )
    # deviations that are no less than the smallest worth noticing
    spread = materialize(spread.select("g", *[f"med_{i}" for i in range(p)], *[F.greatest(1.4826 * F.col(f"dev_{i}"), F.lit(FLOORS[i])).alias(f"dev_{i}") for i in range(p)]), "mcd")
    square = lambda z: sum((F.pow(x, 2) for x in z[1:]), F.pow(z[0], 2))
    z = [(F.col(s) - F.col(f"med_{i}")) / F.col(f"dev_{i}") for i, s in enumerate(STATS)]
    scored = joined(rows, spread).select("g", *STATS, *[f"med_{i}" for i in range(p)], *[f"dev_{i}" for i in range(p)], F.round(square(z), 2).alias("far"), *[F.tanh(x).alias(f"t_{i}") for i, x in enumerate(z)])
    scored = materialize(scored, "mcd")
    half = materialize(scored.groupBy("g").agg(F.percentile("far", F.lit(0.5)).alias("most")), "mcd")
    central = moments(joined(scored, half).filter("far <= most"), ("g",))
    full = moments(scored, ("g",))
    diagonal = with_cholesky(
        spread.select("g", *[F.col(f"med_{i}").alias(f"m_{i}") for i in range(p)], *[(F.pow(f"dev_{i}", 2) if i == j else F.lit(0.0)).alias(f"c_{i}{j}") for i in range(p) for j in range(i + 1)]), "g"
    )
    bent = scored.groupBy("g").agg(
        *[F.first(f"med_{i}").alias(f"m_{i}") for i in range(p)],
        *[
            ((F.covar_pop(f"t_{i}", f"t_{j}") + (0.05 if i == j else 0.0)) * F.first(f"dev_{i}") * F.first(f"dev_{j}")).alias(f"c_{i}{j}")
            for i in range(p) for j in range(i + 1)
        ],
    )
    out = None
    for k, x in enumerate((diagonal, with_cholesky(bent, "g"), central, full)):
        out = x.withColumn("start", F.lit(k)) if out is None else out.unionByName(x.withColumn("start", F.lit(k)))
    return materialize(out, "mcd")


def estimate(rows: DataFrame) -> DataFrame:
    """Location and Cholesky factor of the scatter of least determinant found, for each g of rows(g, STATS)."""
    params = starts_of(rows)
    for _ in range(TRIAL_STEPS):
        params = concentrated(rows, params, ("g", "start"))
    own = [c for c in params.columns if c not in ("g", "start")]
    best = params.groupBy("g").agg(F.min_by(F.struct(*own), F.struct("log_det", "start")).alias("best")).select("g", "best.*")
    params = materialize(best.withColumn("moved", F.lit(True)), "mcd")
    while not (open_ := params.where("moved")).isEmpty():
        new = concentrated(rows, open_, ("g",))
        lower = F.col("new.log_det") < F.col("old.log_det") - LEAST_FALL
        stepped = params.alias("old").join(new.alias("new"), "g", "left")
        chosen = [F.when(lower, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in own]
        params = materialize(stepped.select("g", *chosen, F.coalesce(lower, F.lit(False)).alias("moved")), "mcd")
    return params.drop("moved", "log_det")


def judge_quality(docs: DataFrame, least: int = 50, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, counts, base_failed, squared distance and kept; one row per input row."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    stats = materialize(transformed(text_statistics(docs, "lang", "source")).withColumns({"by_lang": named("lang"), "by_source": F.concat_ws("\0", named("lang"), named("source"))}), "stats")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    sizes = materialize(stats.groupBy("by_lang", "by_source").count(), "sizes")
    langs = sizes.groupBy("by_lang").agg(F.sum("count").alias("in_lang"))
    chosen = sizes.join(langs, "by_lang").select(
        F.col("by_source").alias("g"),
        F.when(F.col("count") >= least, F.col("by_source")).when(F.col("in_lang") >= least, F.col("by_lang")).otherwise(F.lit("all")).alias("use"),
    )
    chosen = materialize(chosen, "chosen")
    # every level that some group needs, estimated on all rows of that level
    needed = materialize(chosen.select(F.col("use").alias("g")).distinct(), "needed")
    rows = stats.select(F.explode(F.array("by_source", "by_lang", F.lit("all"))).alias("g"), *STATS)
    few = needed.limit(20_001).count() <= 20_000
    rows = rows.join(F.broadcast(needed) if few else needed, "g", "left_semi")
    params = estimate(rows)
    ready = chosen.join(params.withColumnRenamed("g", "use"), "use").drop("use")
    out = measured(stats.withColumnRenamed("by_source", "g"), ready)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & (F.col("d2") <= cutoff)).alias("kept"), F.col("d2").alias("distance"),
    )
