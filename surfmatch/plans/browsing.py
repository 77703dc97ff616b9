"""Registered queries that look through a catalog, of training pairs and of references side by side, each with the SQL that must give the same rows.

Line items stand for scans here: orders for bullets, customers for firearms, suppliers for instruments.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from surfmatch.operators import browsing, folds, matrices, metrics, pairs, reports
from surfmatch.plans import views as V
from surfmatch.plans.queries import CLLR, PAIRS, PAIRS_LR, SOURCES, SQL_DIAGONAL, lr_counts, query
from surfmatch.plans.views import rounded, table

SQL_SCANS = """scans AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS instrument_id, l_returnflag || '-' || l_linestatus || '.x3p' AS file_name, l_quantity, l_extendedprice,
CASE WHEN l_linenumber % 3 = 0 THEN l_orderkey END AS land_id, CASE WHEN l_linenumber % 3 = 1 THEN l_partkey END AS case_id FROM lineitem)"""


def scans(spark, sf):
    own = lambda k, c: F.when(F.col("l_linenumber") % 3 == k, F.col(c))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("instrument_id"), F.concat("l_returnflag", F.lit("-"), "l_linestatus", F.lit(".x3p")).alias("file_name"), "l_quantity", "l_extendedprice",
        own(0, "l_orderkey").alias("land_id"), own(1, "l_partkey").alias("case_id"),
    )


def instruments(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("instrument_id"), F.concat(F.lit("device "), (F.col("s_nationkey") % 5).cast("string")).alias("instrument"))


@query(
    "browsed_scans",
    f"""WITH {SQL_SCANS} SELECT l_orderkey, l_linenumber, l_partkey, file_name, 'land' AS mark_class, 'device ' || s_nationkey % 5 AS instrument
    FROM scans JOIN supplier ON instrument_id = s_suppkey WHERE file_name ILIKE '%n-o%' AND land_id IS NOT NULL AND s_nationkey % 5 = 2""",
)
def browsed_scans(spark, sf):
    found = browsing.browse(scans(spark, sf), {"land": "land_id", "case": "case_id"}, "n-O", "land", instruments(spark, sf), "device 2")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "file_name", "mark_class", "instrument")


@query(
    "scan_classes",
    f"""WITH {SQL_SCANS}, c AS (SELECT CASE WHEN land_id IS NOT NULL THEN 'land' WHEN case_id IS NOT NULL THEN 'case' END AS mark_class, 'device ' || s_nationkey % 5 AS instrument FROM scans LEFT JOIN supplier ON instrument_id = s_suppkey)
    SELECT mark_class, instrument, count(*) AS n FROM c GROUP BY 1, 2""",
)
def scan_classes(spark, sf):
    found = browsing.browse(scans(spark, sf), {"land": "land_id", "case": "case_id"}, instruments=instruments(spark, sf))
    return found.groupBy("mark_class", "instrument").agg(F.count("*").alias("n"))


@query("used_instruments", "SELECT DISTINCT 'device ' || s_nationkey % 5 AS instrument FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.09)")
def used_instruments(spark, sf):
    own = table(spark, sf, "lineitem").where("l_quantity >= 50 and l_discount >= 0.09").select(F.col("l_suppkey").alias("instrument_id"))
    return browsing.used_instruments(own, instruments(spark, sf))


@query(
    "firearm_facets",
    f"""WITH {SQL_SCANS} SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM scans JOIN orders ON land_id = o_orderkey JOIN customer ON o_custkey = c_custkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' AND c_acctbal BETWEEN 0 AND 5000 AND l_quantity BETWEEN 10 AND 40""",
)
def firearm_facets(spark, sf):
    above = [("land_id", table(spark, sf, "orders"), "o_orderkey"), ("o_custkey", table(spark, sf, "customer"), "c_custkey")]
    wanted, ranges = {"c_mktsegment": "BUILDING", "o_orderstatus": "F", "c_name": None}, {"c_acctbal": (0, 5000), "l_quantity": (10, 40)}
    return browsing.faceted(scans(spark, sf), wanted, above, ranges).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    "first_scans",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) AS l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM r WHERE k = 1""",
)
def first_scans(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rounded(browsing.first_of_parent(rows, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), 2)


@query("owning_customers", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def owning_customers(spark, sf):
    late = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return browsing.owners(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", late, "o_custkey")


@query(
    "published_splits",
    """WITH d AS (SELECT o_orderpriority AS split, count(*) AS n_pairs FROM orders GROUP BY 1), p AS (SELECT o_orderpriority AS split, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority < '3' GROUP BY 1)
    SELECT split, n_pairs, coalesce(n, 0) AS n_loaded, coalesce(n, 0) = n_pairs AS published FROM d LEFT JOIN p USING (split)""",
)
def published_splits(spark, sf):
    """What is loaded is a part of the table that declares the splits: the tables hold no such pair."""
    orders = table(spark, sf, "orders").withColumn("split", F.col("o_orderpriority"))
    return browsing.complete(orders.where("o_orderstatus <> 'P' or o_orderpriority < '3'"), orders.groupBy("split").agg(F.count("*").alias("n_pairs")))


SQL_HARD = "row_number() OVER (PARTITION BY source_a % 3, label ORDER BY CASE WHEN label = 1 THEN {0} ELSE -{0} END, mark_a, mark_b)"


@query(
    "merged_hardest_pairs",
    f"""{PAIRS}, o AS (SELECT source_a % 3 AS study, label, mark_a, mark_b, score, {SQL_HARD.format('score')} AS rank FROM pairs WHERE mark_b % 5 <> 0),
    n AS (SELECT source_a % 3 AS study, label, mark_a, mark_b, round(score / 2, 6) AS score, {SQL_HARD.format('score')} AS rank FROM pairs WHERE mark_b % 5 <> 1)
    SELECT study::BIGINT AS study, label, mark_a, mark_b, round(score, 6) + 0.0 AS score, rank::INT AS rank FROM (
      SELECT * FROM o WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM n WHERE n.rank <= 10 AND n.mark_a = o.mark_a AND n.mark_b = o.mark_b) UNION ALL SELECT * FROM n WHERE rank <= 10)""",
)
def merged_hardest_pairs(spark, sf):
    """The hardest pairs of one run stored, those of the next run in place of equal ones."""
    study = F.expr("cast(source_a % 3 as long)")
    first, second = (V.hard_pairs(spark, sf, 10, lambda a, b, k=k: b % 5 != k).withColumn("study", study) for k in (0, 1))
    named = ("study", "label", "mark_a", "mark_b", "score", "rank")
    old = pairs.hardest(first, ("study",), 10).select(*named)
    new = pairs.hardest(second, ("study",), 10).withColumn("score", F.round(F.col("score") / 2, 6)).select(*named)
    return rounded(browsing.merged(old, new, ("mark_a", "mark_b")))


@query(
    "training_pairs",
    f"""{SQL_DIAGONAL}, good AS (SELECT pair_id, i, j, ccf, lag, 1 AS label FROM d JOIN best USING (pair_id) WHERE k = best AND pair_id % 4 = 0),
    other AS (SELECT pair_id, i, j, ccf, lag, 0 AS label, row_number() OVER (ORDER BY sha256('9|' || pair_id || '|' || i || '|' || j)) AS r FROM cells WHERE pair_id % 4 <> 0)
    SELECT pair_id, i, j, round(ccf, 6) + 0.0 AS ccf, round(lag, 6) + 0.0 AS lag, label FROM good UNION ALL
    SELECT pair_id, i, j, round(ccf, 6) + 0.0, round(lag, 6) + 0.0, label FROM other WHERE r <= floor(1.5 * (SELECT count(*) FROM good))""",
)
def training_pairs(spark, sf):
    cells = V.cells(spark, sf)
    known = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pair_id"), F.expr("cast(o_orderkey % 4 = 0 as int)").alias("label"))
    return rounded(matrices.training_pairs(cells, known, 1.5, 9))


# ---------------------------------------------------------------- references and scorers side by side


@query(
    "cross_modality_table",
    f"""{PAIRS_LR}, h AS (SELECT (source_a % 2) || ':' || (source_b % 2) AS g, lr, label, lr AS score FROM l), {V.sql_levels('h', 'g')},
    per AS (SELECT * FROM (SELECT g, {CLLR} AS cllr FROM h GROUP BY g HAVING min(label) = 0 AND max(label) = 1) JOIN {V.sql_cllr_min('h', 'g')} USING (g) JOIN {V.sql_auc('h', 'g')} USING (g))
    SELECT split_part(g, ':', 1) AS ref_id, count(*) AS n_folds, round(avg(cllr), 6) AS cllr, round(stddev_pop(cllr), 6) + 0.0 AS cllr_std, round(avg(cllr_min), 6) AS cllr_min, round(stddev_pop(cllr_min), 6) + 0.0 AS cllr_min_std,
      round(avg(auc), 6) AS auc, round(stddev_pop(auc), 6) + 0.0 AS auc_std, round(avg(cllr) - avg(cllr_min), 6) + 0.0 AS calibration_loss, true AS one_config FROM per GROUP BY 1""",
)
def cross_modality_table(spark, sf):
    """Sources with even and odd numbers stand for references of two kinds of marks, their partners' parity for folds."""
    held = lr_counts(spark, sf, SOURCES).select((F.col("source_a") % 2).cast("string").alias("ref_id"), (F.col("source_b") % 2).cast("string").alias("fold"), "lr", "label", "n")
    references = held.select("ref_id").distinct().withColumn("config_hash", F.lit(reports.config_hash({"bound": 2})))
    return rounded(reports.modality_table(references, held))


@query(
    "scorers_by_fold",
    f"""{PAIRS}, {V.SQL_FOLDS}, x AS (SELECT 'score:' || fold AS g, label, score FROM frozen WHERE side = 'test' UNION ALL SELECT 'plain:' || fold, label, round(score - 0.3 * label, 3) FROM frozen WHERE side = 'test'),
    per AS (SELECT split_part(g, ':', 1) AS lever, split_part(g, ':', 2)::INT AS fold, auc FROM {V.sql_auc('x', 'g')})
    SELECT a.lever, a.fold, round(a.auc, 6) AS auc, round(b.auc, 6) AS baseline_auc, round(a.auc - b.auc, 6) + 0.0 AS auc_gain FROM per a JOIN per b ON a.fold = b.fold WHERE a.lever <> 'plain' AND b.lever = 'plain'""",
)
def scorers_by_fold(spark, sf):
    rows = V.scored_pairs(spark, sf).withColumn("plain", F.round(F.col("score") - V.SHIFT * F.col("label"), 3))
    found = folds.beside(folds.lever_table(rows, V.hash_folds(rows), ("score", "plain")), "plain", ("auc",))
    return rounded(found)


@query(
    "score_markers",
    f"""{PAIRS}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM pairs), q AS (SELECT event_id AS query_id, round(value / 100 - 0.5, 4) AS score FROM events)
    SELECT query_id, round(score, 6) + 0.0 AS score, least(greatest(floor((score - lo) / (hi - lo) * 24), 0), 23)::INT AS bin, score BETWEEN lo AND hi AS inside FROM q, e""",
)
def score_markers(spark, sf):
    asked = table(spark, sf, "events").select(F.col("event_id").alias("query_id"), F.round(F.col("value") / 100 - 0.5, 4).alias("score"))
    return rounded(metrics.histogram_markers(V.scored_pairs(spark, sf), asked))
