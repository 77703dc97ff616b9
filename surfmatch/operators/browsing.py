"""Looking through a catalog: browse filters, facets of what stands above a scan, first scans, owners, completeness, merged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfmatch.operators import catalog


def mark_class(parents: dict[str, str]) -> Column:
    """The class of a scan: the first of parents (class: column) that it has, else null."""
    return F.coalesce(*[F.when(F.col(column).isNotNull(), F.lit(name)) for name, column in parents.items()])


def browse(scans: DataFrame, parents: dict[str, str], name: str | None = None, kind: str | None = None, instruments: DataFrame | None = None, instrument: str | None = None, name_column: str = "file_name") -> DataFrame:
    """scans with mark_class, filtered as asked: part of the file name in either case, class, and instrument.

    With instruments(instrument_id, instrument) scans get its name, and those without one
    are left out only if one is asked for. Signs like % in a name stand for themselves.
    """
    found = scans.withColumn("mark_class", mark_class(parents))
    if name is not None:
        found = found.where(F.contains(F.lower(name_column), F.lit(name.lower())))
    if kind is not None:
        found = found.where(F.col(parents[kind]).isNotNull() & (F.col("mark_class") == kind))
    if instruments is not None:
        named = instruments.select("instrument_id", "instrument")
        if instrument is None:
            found = found.join(named, "instrument_id", "left")
        else:
            found = found.join(named.where(F.col("instrument") == instrument), "instrument_id")
    return found


def used_instruments(scans: DataFrame, instruments: DataFrame) -> DataFrame:
    """The names of instruments that some scan was made with, each once."""
    return instruments.join(scans.select("instrument_id"), "instrument_id", "left_semi").select("instrument").distinct()


def faceted(scans: DataFrame, wanted: dict[str, object], above: list[tuple[str, DataFrame, str]], ranges: dict[str, tuple[float | None, float | None]] = {}) -> DataFrame:  # noqa: B006
    """scans that meet facets of their own and of what stands above them.

    above lists the steps upwards: the column that points up, the table there and its
    id. Only the steps that a facet needs are joined, and such a facet leaves out scans
    without that parent: a facet of firearms keeps scans of bullet lands only.
    """
    asked = {k: v for k, v in wanted.items() if v is not None} | {k: r for k, r in ranges.items() if r != (None, None)}
    part = lambda columns, source: {k: v for k, v in source.items() if k in columns}
    unknown = set(asked) - set(scans.columns) - {c for _, t, _ in above for c in t.columns}
    if unknown:
        raise ValueError(f"no such facet: {sorted(unknown)}")
    found = catalog.facets(scans, part(scans.columns, wanted), part(scans.columns, ranges))
    open_ = set(asked) - set(scans.columns)
    if not open_:
        return found
    steps = []
    for step in above:
        steps.append(step)
        open_ -= set(step[1].columns)
        if not open_:
            break
    # from the top down: each table shrinks to the ids that the ones above leave
    kept = None
    for i in range(len(steps) - 1, -1, -1):
        _, rows, key = steps[i]
        rows = catalog.facets(rows, part(set(rows.columns) - set(scans.columns), wanted), part(set(rows.columns) - set(scans.columns), ranges))
        if kept is not None:
            rows = rows.join(kept, rows[steps[i + 1][0]] == kept["_id"], "left_semi")
        kept = rows.select(F.col(key).alias("_id"))
    return found.join(kept, found[steps[0][0]] == kept["_id"], "left_semi")


def first_of_parent(children: DataFrame, parent: str, *order: str) -> DataFrame:
    """The first child of each parent in an order that tells children apart (nulls first).

    It is a smallest value, so it is combined before the shuffle: a parent with many children costs no more.
    """
    row = F.struct(*children.columns)
    return children.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_parent")).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def owners(parents: DataFrame, key: str, children: DataFrame, up: str) -> DataFrame:
    """parents that own at least one child."""
    return parents.join(children.select(F.col(up).alias("_up")), parents[key] == F.col("_up"), "left_semi")


def complete(loaded: DataFrame, declared: DataFrame, split: str = "split") -> DataFrame:
    """declared(split, n_pairs) with the pairs loaded, and published where they are all there; a split without any counts 0."""
    counts = loaded.groupBy(split).agg(F.count("*").alias("n_loaded"))
    found = declared.select(split, "n_pairs").join(counts, split, "left").withColumn("n_loaded", F.coalesce("n_loaded", F.lit(0)))
    return found.withColumn("published", F.coalesce(F.col("n_loaded") == F.col("n_pairs"), F.lit(False)))


def merged(stored: DataFrame, incoming: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """stored with the rows of incoming in place of those of equal key (nulls are equal); columns are those of stored, by name, null where incoming lacks one."""
    named = incoming.select(*[F.col(k).alias(f"_new_{k}") for k in key])
    kept = stored.join(named, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in key], "left_anti")
    return kept.unionByName(incoming.select(*[c for c in stored.columns if c in incoming.columns]), allowMissingColumns=True)


def first_by_digest(rows: DataFrame, order: Column, most: int) -> DataFrame:
    """The ``most`` rows that come first by a digest in hex, exactly, without sorting them all.

    Rows are counted by the digest's first four signs; whole buckets below the cut are
    taken, and only the bucket at the cut is ranked, a 65536th part of the rows.
    """
    rows = rows.withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, 4))
    at, before = "", 0
    for bucket, n in sorted((r["_bucket"], r["n"]) for r in rows.groupBy("_bucket").agg(F.count("*").alias("n")).collect()):  # 65536 at most
        at = bucket
        if before + n >= most:
            break
        before += n
    if most <= 0:
        return rows.limit(0).drop("_order", "_bucket")
    whole = rows.where(F.col("_bucket") < at)
    edge = rows.where(F.col("_bucket") == at).orderBy("_order").limit(most - before)
    return whole.union(edge).drop("_order", "_bucket")
