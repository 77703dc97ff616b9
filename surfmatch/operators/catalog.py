"""Catalog work: lineage, facets, membership, resumable intake, upserts, pinning, pages of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surfmatch.functions.reuse import reused


def lineage(scans: DataFrame, paths: list[tuple[str, list[tuple[DataFrame, str, str]]]]) -> DataFrame:
    """scans with the source and study they descend from, over exclusive paths.

    A path is the scan's parent column and the joins upwards, each (table, its id
    column, the column that points further up). Rows without a path's parent never
    enter its joins, so nulls are no join key. Parents are small beside scans.
    """
    out = None
    for parent, steps in paths:
        rows = scans.where(F.col(parent).isNotNull()).withColumn("up", F.col(parent))
        above = []
        for table, key, up in steps:
            rows = rows.join(table.select(F.col(key).alias("up"), F.col(up).alias("next")), "up", "left").drop("up").withColumnRenamed("next", "up")
            above.append(up)
            rows = rows.withColumn(f"_{len(above)}", F.col("up"))
        source = f"_{len(above) - 1}" if len(above) > 1 else parent
        own = rows.select(*scans.columns, F.col(source).alias("lineage_source"), F.col("up").alias("lineage_study"))
        out = own if out is None else out.union(own)
    return out


def members_of(scans: DataFrame, sets: list[tuple[str, DataFrame]]) -> DataFrame:
    """scans whose key lies in one of several id sets: an OR of memberships as one semi-join a key, each scan once."""
    flagged = scans
    for i, (key, ids) in enumerate(sets):
        flagged = flagged.join(ids.select(F.col(ids.columns[0]).alias("_id")).distinct().withColumn(f"_in{i}", F.lit(True)), F.col(key) == F.col("_id"), "left").drop("_id")
    any_of = F.lit(False)
    for i in range(len(sets)):
        any_of = any_of | F.coalesce(F.col(f"_in{i}"), F.lit(False))
    return flagged.where(any_of).select(*scans.columns)


def facets(scans: DataFrame, equal: dict[str, object] = {}, ranges: dict[str, tuple[float | None, float | None]] = {}) -> DataFrame:  # noqa: B006
    """scans that meet all facets given: equalities, and ranges with both ends included."""
    for column, value in equal.items():
        if value is not None:
            scans = scans.where(F.col(column) == F.lit(value))
    for column, (lo, hi) in ranges.items():
        if lo is not None:
            scans = scans.where(F.col(column) >= lo)
        if hi is not None:
            scans = scans.where(F.col(column) <= hi)
    return scans


def intake_status(files: DataFrame, existing: DataFrame, parsed: Column, key: str = "source_ref") -> DataFrame:
    """files with status: unparsed, present, or ingest. existing is told apart by key and never read beyond it."""
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    status = F.when(parsed.isNull(), F.lit("unparsed")).when(F.col("_known"), F.lit("present")).otherwise(F.lit("ingest"))
    return files.join(known, key, "left").withColumn("status", status).drop("_known")


def upsert_keys(existing: DataFrame, incoming: DataFrame, key: tuple[str, ...], id_column: str = "id") -> DataFrame:
    """existing rows and new ones with ids of their own: natural keys not seen before, numbered on from the largest id.

    Numbering is by key within range partitions plus the partitions' counts, not by
    one window over all rows.
    """
    new = incoming.select(*key).dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti")
    top = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("top")).first()["top"]
    # the ranges are sampled, so they are drawn once for numbers and sizes
    parts = reused(new.repartitionByRange(*key).withColumn("_part", F.spark_partition_id()))
    parts = parts.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*key)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "before")
    numbered = parts.join(F.broadcast(before), "_part").select((F.lit(top) + F.col("before") + F.col("_rank")).cast("long").alias(id_column), *key)
    return existing.select(id_column, *key).union(numbered)


def availability(scans: DataFrame, stored: DataFrame, key: str = "content_hash") -> DataFrame:
    """scans with blob_available."""
    have = stored.select(key).distinct().withColumn("_have", F.lit(True))
    return scans.join(have, key, "left").withColumn("blob_available", F.coalesce("_have", F.lit(False))).drop("_have")


def pinned(manifest: DataFrame, scans: DataFrame) -> DataFrame:
    """manifest(dataset, url, pinned_hash) resolved: by its own hash, by the scan of that url, or pending."""
    first = scans.groupBy("source_ref").agg(F.min("content_hash").alias("scan_hash"))
    rows = manifest.join(first, manifest["url"] == first["source_ref"], "left")
    resolution = F.when(F.col("pinned_hash").isNotNull(), F.lit("manifest")).when(F.col("scan_hash").isNotNull(), F.lit("catalog")).otherwise(F.lit("pending"))
    return rows.select("dataset", "url", F.coalesce("pinned_hash", "scan_hash").alias("content_hash"), resolution.alias("resolution"))


def page(df: DataFrame, order: str, number: int, size: int) -> DataFrame:
    """Rows of one page with total and page count; for deep pages filter on order > last instead."""
    total = df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    return df.orderBy(order).offset((number - 1) * size).limit(size).join(F.broadcast(total))


def page_after(df: DataFrame, key: str, last: object | None, size: int) -> DataFrame:
    """The next ``size`` rows by a unique key after the last one seen (None: the first page); its cost does not grow with depth."""
    rows = df if last is None else df.where(F.col(key) > F.lit(last))
    return rows.orderBy(key).limit(size)


def children_in_order(children: DataFrame, parent: str, *order: str) -> DataFrame:
    """children with their place, from 1, among those of their parent; rows without a parent are left out."""
    place = F.row_number().over(Window.partitionBy(parent).orderBy(*order))
    return children.where(F.col(parent).isNotNull()).withColumn("place", place)


#: Rules of exclusion, in the order they are tried.
RULES = ("unparseable", "unattributable", "duplicate", "scope_refusal")


def screened(records: DataFrame) -> DataFrame:
    """records(seq, name, source, content_hash, parse_ok, scope_ok, signature_ok) with the first rule that excludes each, null if kept.

    A hash under several sources is attributable to none; all records with a source
    count for that. A hash counts as seen once it passed the second rule, refused or
    not. A failed signature is booked as unparseable.
    """
    sources = records.where(F.col("source").isNotNull()).groupBy("content_hash").agg(F.count_distinct("source").alias("n_sources"))
    rows = records.join(sources, "content_hash", "left")
    eligible = F.col("parse_ok") & F.col("source").isNotNull() & (F.coalesce("n_sources", F.lit(0)) == 1)
    first = rows.where(eligible).groupBy("content_hash").agg(F.min("seq").alias("first_seq"))
    rows = rows.join(first, "content_hash", "left")
    rule = (
        F.when(~F.col("parse_ok"), F.lit(RULES[0]))
        .when(~eligible, F.lit(RULES[1]))
        .when(F.col("seq") != F.col("first_seq"), F.lit(RULES[2]))
        .when(~F.col("scope_ok"), F.lit(RULES[3]))
        .when(~F.col("signature_ok"), F.lit(RULES[0]))
    )
    return rows.select(*records.columns, rule.alias("rule"))


def exclusion_report(rows: DataFrame) -> DataFrame:
    """Counts of every rule, those that never applied too."""
    spark = rows.sparkSession
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    counts = rows.where(F.col("rule").isNotNull()).groupBy("rule").agg(F.count("*").alias("n"))
    return rules.join(counts, "rule", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def append_missing(source: DataFrame, target: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows of source that target lacks: what an idempotent copy appends."""
    return source.join(target.select(*key), list(key), "left_anti")


def replaced(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """existing with all rows of incoming's keys replaced by incoming's rows."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)
