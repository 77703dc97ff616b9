"""The library's shapes, read out of the test tables; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surfmatch.functions.reuse import reused
from surfmatch.operators import folds, pairs, signals, tallies

#: Same-source pairs are shifted by this much, since the embeddings carry no source signal.
SHIFT = 0.3


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def marks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("mark"), F.col("label").alias("source"), F.col("embedding").alias("signature"))


def scored_pairs(spark: SparkSession, sf: str, digits: int = 3) -> DataFrame:
    """mark_a, mark_b, source_a, source_b, label, score of all unordered pairs of marks."""
    m = marks(spark, sf)
    finish = lambda v, a, b: tallies.rounded_scores(v, a, b, SHIFT, digits)
    return pairs.labelled(pairs.score_blocks(tallies.sourced(m), pairs.dot_product, along=("source",), finish=finish), m)


def scored_counts(spark: SparkSession, sf: str, digits: int = 3, by: tuple[str, ...] = (), code: tuple | None = None, kept: DataFrame | None = None) -> DataFrame:
    """by (of source_a, source_b), label, score and n of scored_pairs, counted where pairs are scored; kept(mark): of pairs of these marks only."""
    m = marks(spark, sf)
    m = m if kept is None else m.join(kept, "mark", "left_semi")
    return reused(tallies.score_counts(m, pairs.dot_product, by, SHIFT, digits, code))


def hard_pairs(spark: SparkSession, sf: str, most: int, wanted=None) -> DataFrame:
    """Those of scored_pairs that may be among the ``most`` hardest of any sources and label, of the pairs wanted."""
    return reused(tallies.hardest_in_blocks(marks(spark, sf), pairs.dot_product, most, SHIFT, wanted=wanted))


def sampled(spark: SparkSession, sf: str, most: int = 500, digits: int = 3) -> DataFrame:
    """Pairs alike or unlike in mark % 3, all same-source ones and ``most`` others of either, chosen first and then scored as scored_pairs are."""
    m = marks(spark, sf).withColumn("kind", F.col("mark") % 3)
    chosen = pairs.sampled_pairs(m.select("mark", "source", "kind"), "kind", most)
    found = pairs.score_pairs(chosen, m.select("mark", "signature"), signals.plain_product, "score double")
    return found.withColumn("score", F.round(F.col("score") + SHIFT * F.col("label"), digits)).drop("error")


def with_lr(df: DataFrame) -> DataFrame:
    """A frozen calibration: log10 LR linear in the score, bounded at 2."""
    value = 6 * (F.col("score") - 0.15)
    return df.withColumns({"lr": F.pow(F.lit(10.0), F.least(F.greatest(value, F.lit(-2.0)), F.lit(2.0))), "bound_hit": F.abs(value) > 2})


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Compared doubles, rounded, with no negative zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def hash_folds(df: DataFrame) -> DataFrame:
    return folds.held_out(df, rng="hash")


def votes(spark: SparkSession, sf: str) -> DataFrame:
    """A vote for each line item of an order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("pair_id"), F.row_number().over(order).alias("region_id"),
        F.col("l_quantity").alias("t1"), F.round(100 * F.col("l_discount")).alias("t2"), F.round(1 - 5 * F.col("l_tax"), 3).alias("corr"),
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """pair_id, i, j, ccf, lag: every order against the same customer's next one, line items as lands."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(order).alias("b")).where("b is not null")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lands = table(spark, sf, "lineitem").select("l_orderkey", (F.row_number().over(place) - 1).alias("at"), F.col("l_extendedprice").alias("price"), F.col("l_partkey").alias("part"))
    a, b = lands.toDF("a", "i", "pa", "qa"), lands.toDF("b", "j", "pb", "qb")
    rows = orders.join(a, "a").join(b, "b")
    return rows.select(F.col("a").alias("pair_id"), "i", "j", (((F.col("pa") * F.col("pb")) % 997) / 997).alias("ccf"), ((F.col("qa") - F.col("qb")) % 50).cast("double").alias("lag"))


SQL_MARKS = "m AS (SELECT vec_id AS mark, label AS source, embedding::DOUBLE[] AS sig FROM embeddings)"


def sql_pairs(digits: int = 3) -> str:
    return f"""{SQL_MARKS}, pairs AS (
  SELECT a.mark AS mark_a, b.mark AS mark_b, a.source AS source_a, b.source AS source_b, (a.source = b.source)::INT AS label,
         round(list_dot_product(a.sig, b.sig) + {SHIFT} * (a.source = b.source)::INT, {digits}) AS score
  FROM m a JOIN m b ON a.mark < b.mark)"""


SQL_LR = """l AS (SELECT *, pow(10.0, least(greatest(6 * (score - 0.15), -2.0), 2.0)) AS lr, abs(6 * (score - 0.15)) > 2 AS bound_hit FROM pairs)"""

SQL_FOLDS = """sources AS (SELECT DISTINCT s::VARCHAR AS source FROM (SELECT source_a AS s FROM pairs UNION ALL SELECT source_b FROM pairs)),
held AS (SELECT fold, source FROM (
  SELECT f.fold, source, row_number() OVER (PARTITION BY f.fold ORDER BY sha256('0|' || f.fold || '|' || source)) AS k, count(*) OVER (PARTITION BY f.fold) AS n
  FROM sources, (SELECT unnest(range(10))::INT AS fold) f) WHERE k <= greatest(2, round_even(n * 0.4, 0))),
members AS (
  SELECT p.*, f.fold, CASE WHEN a.source IS NOT NULL AND b.source IS NOT NULL THEN 'test' WHEN a.source IS NULL AND b.source IS NULL THEN 'train' END AS side
  FROM pairs p CROSS JOIN (SELECT unnest(range(10))::INT AS fold) f
  LEFT JOIN held a ON a.fold = f.fold AND a.source = p.source_a::VARCHAR LEFT JOIN held b ON b.fold = f.fold AND b.source = p.source_b::VARCHAR),
kept AS (SELECT fold FROM members GROUP BY fold HAVING sum(CASE WHEN side = 'train' THEN label ELSE 0 END) >= 3 AND sum(CASE WHEN side = 'test' THEN label ELSE 0 END) >= 1),
frozen AS (SELECT * FROM members WHERE side IS NOT NULL AND fold IN (SELECT fold FROM kept))"""

SQL_VOTES = """votes AS (SELECT l_orderkey AS pair_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS region_id,
  l_quantity AS t1, round(100 * l_discount) AS t2, round(1 - 5 * l_tax, 3) AS corr FROM lineitem)"""

SQL_CELLS = """ord AS (SELECT * FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE b IS NOT NULL),
lands AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS k, l_extendedprice AS price, l_partkey AS part FROM lineitem),
cells AS (SELECT o.a AS pair_id, x.k AS i, y.k AS j, ((x.price * y.price) % 997) / 997 AS ccf, ((x.part - y.part) % 50)::DOUBLE AS lag
  FROM ord o JOIN lands x ON x.l_orderkey = o.a JOIN lands y ON y.l_orderkey = o.b)"""


def sql_auc(rows: str, by: str = "") -> str:
    """auc of rows(score, label), for each value of by."""
    k, p = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    return f"""(SELECT {k}sum(p * (below + q / 2.0)) / nullif(sum(p) * sum(q), 0) AS auc FROM (
      SELECT {k}p, q, coalesce(sum(q) OVER ({p}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT {k}score, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS q FROM {rows} GROUP BY {k}score)) {group})"""


def sql_cllr_min(rows: str, by: str = "") -> str:
    """cllr_min of rows(score, label) by the max-min formula of isotonic regression."""
    k, p = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    same = f"AND a.{by} = b.{by}" if by else ""
    ak, group = (f"a.{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""(SELECT {k}0.5 * (sum(p * log2(1 + odds / (f / (1 - f)))) / any_value(n1) + sum((n - p) * log2(1 + (f / (1 - f)) / odds)) / any_value(n0)) AS cllr_min FROM (
      SELECT {k}p, n, least(greatest(fit, 1e-4), 1 - 1e-4) AS f, n1, n0, n1 / n0 AS odds FROM (
        SELECT {k}b AS at, any_value(pb) AS p, any_value(nb) AS n, max(least_mean) AS fit, any_value(n1) AS n1, any_value(n0) AS n0 FROM (
          SELECT {k}a, b, pb, nb, n1, n0, min(mean) OVER (PARTITION BY {k}a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS least_mean FROM (
            SELECT {ak}a.i AS a, b.i AS b, b.p AS pb, b.n AS nb, b.n1, b.n0, (b.cp - a.cp + a.p) / (b.cn - a.cn + a.n) AS mean FROM
              (SELECT * FROM k_{by or 'all'}) a JOIN (SELECT * FROM k_{by or 'all'}) b ON a.i <= b.i {same})) GROUP BY {k}b)) WHERE n1 > 0 AND n0 > 0 {group})"""


def sql_levels(rows: str, by: str = "") -> str:
    """The running counts that sql_cllr_min reads."""
    k, p = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"""k_{by or 'all'} AS (SELECT *, row_number() OVER ({p}ORDER BY score) AS i, sum(p) OVER ({p}ORDER BY score) AS cp, sum(n) OVER ({p}ORDER BY score) AS cn,
      sum(p) OVER ({p}) AS n1, sum(n - p) OVER ({p}) AS n0 FROM (SELECT {k}score, sum(label)::DOUBLE AS p, count(*)::DOUBLE AS n FROM {rows} GROUP BY {k}score))"""


def sql_newton(counts: str, by: str = "", steps: int = 18) -> str:
    """CTEs n0 .. n<steps> that fit label on score by Newton's method over counts(by, score, label, n), classes balanced."""
    k = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"USING ({by})" if by else "ON true"
    out = [f"""w AS (SELECT {k}score AS x, label AS y, n * (CASE WHEN label = 1 THEN t / (2 * t1) ELSE t / (2 * t0) END) AS n FROM
      (SELECT *, sum(n) OVER (q)::DOUBLE AS t, sum(CASE WHEN label = 1 THEN n ELSE 0 END) OVER (q)::DOUBLE AS t1, sum(CASE WHEN label = 0 THEN n ELSE 0 END) OVER (q)::DOUBLE AS t0
       FROM {counts} WINDOW q AS ({f'PARTITION BY {by}' if by else ''})))""",
      f"n0 AS (SELECT {k}0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM w {group or 'LIMIT 1'})"]
    for i in range(steps):
        out.append(f"""n{i + 1} AS (SELECT {k}a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS a, b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS b FROM (
          SELECT {k}any_value(a) AS a, any_value(b) AS b, sum(n * (p - y) * x) + 1e-6 * any_value(a) AS g1, sum(n * (p - y)) AS g2,
                 sum(n * p * (1 - p) * x * x) + 1e-6 AS h11, sum(n * p * (1 - p) * x) AS h12, sum(n * p * (1 - p)) AS h22
          FROM (SELECT w.*, a, b, 1 / (1 + exp(-(a * x + b))) AS p FROM w JOIN n{i} {join}) {group}))""")
    return ",\n".join(out)
