"""Catalog tables and content stores on disk, filled by runs that may be repeated: what is there is skipped, and every run tells its figures."""

from __future__ import annotations

from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from surfmatch.functions.reuse import exists

FIGURES = "seq int, `table` string, n_source long, n_present long, n_inserted long, n_orphans long"
BLOBS = "key string, content binary"


def copy_order(links: dict[str, dict[str, str]]) -> list[str]:
    """Tables with those they refer to before them, by name where free; links names, for each table, the parent of each of its columns."""
    sorter = TopologicalSorter({t: sorted(set(parents.values()) - {t}) for t, parents in sorted(links.items())})
    sorter.prepare()
    order = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        order += ready
        sorter.done(*ready)
    return order


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows at path, none where nothing was stored yet."""
    if not exists(spark, path):
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(path)


def copy_catalog(sources: dict[str, DataFrame], links: dict[str, dict[str, str]], keys: dict[str, str], base: str) -> DataFrame:
    """Append to the tables under base what they lack of sources, parents before children and keys as they are; one row of figures a table, in the order of copying.

    A row whose parent the target does not have by then is left out and counted as an
    orphan; a null reference is none. Rows with a key that is there are skipped, so a run
    that was lost is simply repeated; of rows with one key the first by their other columns counts.
    """
    spark = next(iter(sources.values())).sparkSession
    figures = []
    for seq, table in enumerate(copy_order(links)):
        rows, key, path = sources[table], keys[table], f"{base.rstrip('/')}/{table}"
        have = stored(spark, path, rows)
        new = rows.where(F.col(key).isNotNull()).join(have.select(key), key, "left_anti")
        new = new.groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("_row")).select(key, "_row.*").select(*rows.columns) if len(rows.columns) > 1 else new.distinct()
        orphan = F.lit(False)
        for column, parent in sorted(links[table].items()):
            if parent != table:
                own = stored(spark, f"{base.rstrip('/')}/{parent}", sources[parent]).select(F.col(keys[parent]).alias(column)).distinct().withColumn(f"_{column}", F.lit(True))
                new = new.join(own, column, "left")
                orphan = orphan | (F.col(column).isNotNull() & F.col(f"_{column}").isNull())
        tally = Observation(f"copy of {table}")
        n_source, n_present = rows.select(F.count_distinct(key)).first()[0], have.count()
        marked = new.withColumn("_orphan", orphan).observe(tally, F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_orphan"), 1)).alias("orphans"))
        marked.where("not _orphan").select(*rows.columns).write.mode("append").parquet(path)
        counts = tally.get
        figures.append((seq, table, n_source, n_present, counts["n"] - counts["orphans"], counts["orphans"]))
    return spark.createDataFrame(figures, FIGURES)


def sync_blobs(blobs: DataFrame, path: str) -> dict[str, int]:
    """Bring blobs(key, content) into the store at path: figures total, already_present, uploaded, verified.

    A key must be the digest of its bytes, at the source and when what was written is read
    again; the first break of that rule stops the run before, or reports it after, the append.
    Present keys are skipped, so contents are read only where they are needed.
    """
    spark = blobs.sparkSession
    blobs = blobs.select("key", "content")
    have = stored(spark, path, blobs).select("key").distinct()
    total = blobs.select("key").distinct()
    figures = {"total": total.count(), "already_present": total.join(have, "key", "left_semi").count()}
    new = blobs.join(have, "key", "left_anti").dropDuplicates(["key"])
    false = new.where(F.sha2("content", 256) != F.col("key")).select("key").take(1)
    if false:
        raise ValueError(f"the bytes of {false[0][0]} have another digest")
    new.write.mode("append").parquet(path)
    again = stored(spark, path, blobs).join(have, "key", "left_anti")
    good, n = again.agg(F.count(F.when(F.sha2("content", 256) == F.col("key"), 1)), F.count(F.lit(1))).first()
    if good != n:
        raise RuntimeError(f"{n - good} blobs read back with another digest")
    return figures | {"uploaded": n, "verified": good}
