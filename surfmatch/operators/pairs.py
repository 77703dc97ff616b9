"""Pairs of marks: enumeration in blocks, scoring inside blocks, sampling and de-duplication."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from surfmatch.functions.reuse import reused


#: Groups whose counts may be broadcast; more are joined by shuffle.
FEW_GROUPS = 50_000
#: Most tasks that pairs of blocks are dealt to.
MOST_TASKS = 2000


def grouped_counts(marks: DataFrame, within: str | None) -> DataFrame:
    """n of every group of marks, or of all marks in one row."""
    return marks.groupBy(*([within] if within else [])).agg(F.count("*").alias("n"))


def block_pairs(marks: DataFrame, block_rows: int, within: str | None = None) -> DataFrame:
    """marks sent to the tasks (bi, bj), bi <= bj, that pair their block with another; side tells which of both a row is.

    A group (all marks, or those alike in ``within``) has as many blocks as its own count
    asks for, of ``block_rows`` marks about, so a group with most of the marks spreads over
    many tasks and a small one makes one. Each task gets two blocks: arrays are copied once
    a block, not once a pair.
    """
    keys = [within] if within else []
    spark = marks.sparkSession
    counts = grouped_counts(marks, within)
    total, groups = counts.agg(F.sum("n"), F.count("*")).first()
    least = blocks_for(total or 0, block_rows, spark.sparkContext.defaultParallelism)
    size = -(-(total or 0) // least)  # marks a block, so that all cores have work
    counts = counts.select(*keys, F.greatest(F.ceil(F.col("n") / F.lit(max(size, 1))), F.lit(1)).cast("int").alias("blocks"))
    counts = F.broadcast(counts) if groups <= FEW_GROUPS else counts
    rows = marks.where(F.col(within).isNotNull()).join(counts, within) if within else marks.join(counts)
    own = F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int")
    to = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("bi"), F.greatest(F.col("own"), o).alias("bj"), (F.col("own") > o).cast("int").alias("side")))
    rows = rows.withColumn("own", own).withColumn("to", F.explode(to))
    rows = rows.select(*keys, "to.bi", "to.bj", "to.side", *[c for c in marks.columns if c not in keys])
    # tasks are long for the little that they read: a task for each pair of blocks, whatever the bytes
    return rows if within else rows.repartition(min(least * (least + 1) // 2, MOST_TASKS), "bi", "bj")


def blocks_for(n: int, block_rows: int, cores: int = 1, least_rows: int = 64) -> int:
    """Blocks of at most ``block_rows`` marks, and enough of them for four pairs of blocks a core, unless they would get tiny."""
    busy = math.isqrt(8 * cores) + 1
    return max(1, -(-n // block_rows), min(busy, n // least_rows))


def paired(marks: DataFrame, within: str | None = None, block_rows: int = 2000) -> DataFrame:
    """All unordered pairs of marks(mark, ...), of one group each if ``within`` is given: every other column once for either side.

    Blocks meet by an equi-join on their numbers, so no key holds more than two blocks.
    """
    placed = block_pairs(marks, block_rows, within)
    keys = [*([within] if within else []), "bi", "bj"]
    rest = [c for c in marks.columns if c != within]
    a, b = (placed.select(*keys, F.col("side").alias(f"side_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in rest]) for s in "ab")
    # inside a block every two rows meet both ways round, between blocks once
    met = a.join(b, keys).where(F.when(F.col("bi") == F.col("bj"), F.col("mark_a") < F.col("mark_b")).otherwise((F.col("side_a") == 0) & (F.col("side_b") == 1)))
    swap = F.col("mark_b") < F.col("mark_a")
    out = [x for c in rest for x in (F.when(swap, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{c}_a"), F.when(swap, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_b"))]
    return met.select(*([within] if within else []), *out)


def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of either side of a task's two blocks, and whether they are the same block."""
    side = table.column("side").to_numpy()
    same = table.column("bi")[0].as_py() == table.column("bj")[0].as_py()
    return (np.arange(len(side)),) * 2 + (True,) if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1), False)


def score_blocks(
    marks: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], block_rows: int = 8000, within: str | None = None, along: tuple[str, ...] = (), tile: int = 1 << 20,
    finish: Callable[..., np.ndarray] | None = None,
) -> DataFrame:
    """mark_a < mark_b and their score, for all unordered pairs of marks(mark, signature), of one group each if ``within`` is given; score works on two matrices at once.

    Signatures of a block have one length. A pair whose signature is missing scores null. Columns named in
    ``along`` come with either side, which spares a join of all pairs; ``finish`` makes of the scores, and of those columns of a and b, the scores to hand on.
    A task hands on about ``tile`` pairs at once.
    """
    keys = [within] if within else []
    placed = block_pairs(marks.select("mark", "signature", *along, *keys), block_rows, within)
    kinds = dict(marks.dtypes)
    sided = [f"{c}_{s}" for c in along for s in "ab"]
    order = [*keys, "mark_a", "mark_b", *sided, "score"]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"mark_a {kinds['mark']}, mark_b {kinds['mark']}", *(f"{c} {kinds[c[:-2]]}" for c in sided), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        mark, matrix = table.column("mark").to_numpy(), matrix_of(table.column("signature"))
        left, right, same = sides(table)
        left, right = (x[np.argsort(mark[x], kind="stable")] for x in (left, right))
        high = max(1, min(len(left), tile // max(len(right), 1)) or 1)
        for at in range(0, len(left), high):
            own = left[at : at + high]
            for to in range(at if same else 0, len(right), max(1, tile // len(own))):  # of one block, pairs below the diagonal are those above it
                other = right[to : to + max(1, tile // len(own))]
                values = score(matrix[own], matrix[other])
                i, j = np.meshgrid(own, other, indexing="ij")
                keep = mark[i] < mark[j] if same else np.ones(i.shape, bool)
                i, j, v = i[keep], j[keep], values[keep]
                swap = mark[j] < mark[i]
                i, j = pa.array(np.where(swap, j, i)), pa.array(np.where(swap, i, j))
                columns = {k: pa.repeat(table.column(k)[0], len(v)) for k in keys}
                columns |= {f"{c}_{s}": table.column(c).chunk(0).take(rows) for c in ("mark", *along) for s, rows in (("a", i), ("b", j))}
                columns["score"] = pa.array(finish(v, *(columns[c] for c in sided)) if finish else v, from_pandas=True)
                yield pa.RecordBatch.from_arrays([columns[c] for c in order], order)

    return placed.groupBy(*keys, "bi", "bj").applyInArrow(run, schema)


def matrix_of(signatures: pa.ChunkedArray) -> np.ndarray:
    """Signatures of one length as rows, not numbers where one is missing."""
    kept = signatures.is_valid().to_numpy()
    flat = signatures.combine_chunks()
    width = len(flat[int(np.flatnonzero(kept)[0])]) if kept.any() else 0
    matrix = np.full((len(kept), width), np.nan)
    if kept.any():
        matrix[kept] = flat.flatten().to_numpy().astype(np.float64).reshape(-1, width)
    return matrix


def sampled_pairs(marks: DataFrame, kind: str, most: int, seed: int = 0, block_rows: int = 2000) -> DataFrame:
    """mark_a < mark_b, source_a, source_b, label, within, of marks(mark, source, <kind>): all same-source pairs, and at most ``most``
    different-source ones of those alike in kind (within) and of those that differ, in seeded order; nothing is scored.

    Each task looks through the pairs of its two blocks and hands on the ``most`` first of
    either stratum, so different-source pairs are never listed. Null kinds are alike.
    """
    names = ["mark", "source", kind]
    placed = block_pairs(marks.select(*names), block_rows)

    def firsts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The places of the ``most`` least digests of pairs, and the digests."""
        digests = [hashlib.sha256(f"{seed}|{x}|{y}".encode()).digest() for x, y in zip(a.tolist(), b.tolist())]
        if len(digests) <= most:
            return np.arange(len(digests)), digests
        head = np.frombuffer(b"".join(digests), ">u8")[::4]
        near = np.flatnonzero(head <= np.partition(head, most - 1)[most - 1])
        near = np.array(sorted(near.tolist(), key=lambda i: digests[i])[:most])
        return near, [digests[i] for i in near]

    def run(table: pa.Table) -> pa.Table:
        mark = table.column("mark").to_numpy()
        source, alike = (pa.chunked_array([c]).combine_chunks() if isinstance(c, pa.Array) else c.combine_chunks() for c in (table.column("source"), table.column(kind)))
        source_code, kind_code = (c.dictionary_encode("encode").indices.to_numpy() for c in (source, alike))
        left, right, same = sides(table)
        found = []
        for at in range(0, len(left), 256):  # a stretch of rows at a time bounds what is held
            i, j = (x.ravel() for x in np.meshgrid(left[at : at + 256], right, indexing="ij"))
            if same:
                i, j = i[mark[i] < mark[j]], j[mark[i] < mark[j]]
            swap = mark[j] < mark[i]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            label, within = source_code[i] == source_code[j], kind_code[i] == kind_code[j]
            found.append((i[label], j[label], np.ones(label.sum(), int), within[label], [None] * int(label.sum())))
            for stratum in (True, False):
                own = np.flatnonzero(~label & (within == stratum))
                near, digests = firsts(mark[i[own]], mark[j[own]])
                found.append((i[own][near], j[own][near], np.zeros(len(near), int), np.full(len(near), stratum), digests))
        i, j, label, within = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in range(4))
        digest = pa.array([d for f in found for d in f[4]], pa.binary())
        rows = pa.table({"mark_a": mark[i], "mark_b": mark[j], "source_a": source.take(pa.array(i)), "source_b": source.take(pa.array(j)), "label": pa.array(label, pa.int32()), "within": pa.array(within.astype(bool)), "order": digest})
        keep = [rows.filter(pa.compute.equal(rows.column("label"), 1))]
        for stratum in (True, False):
            part = rows.filter(pa.compute.and_(pa.compute.equal(rows.column("label"), 0), pa.compute.equal(rows.column("within"), stratum)))
            keep.append(part.take(pa.array(sorted(range(len(part)), key=part.column("order").to_pylist().__getitem__)[:most], pa.int64())))
        return pa.concat_tables(keep)

    kinds = dict(marks.dtypes)
    schema = f"mark_a {kinds['mark']}, mark_b {kinds['mark']}, source_a {kinds['source']}, source_b {kinds['source']}, label int, within boolean, order binary"
    rows = reused(placed.groupBy("bi", "bj").applyInArrow(run, schema))
    rank = F.row_number().over(Window.partitionBy("within").orderBy("order"))
    few = rows.where("label = 0").withColumn("rank", rank).where(F.col("rank") <= most)
    return rows.where("label = 1").drop("order").union(few.drop("order", "rank"))


def score_pairs(pairs: DataFrame, marks: DataFrame, one: Callable[..., list[tuple]], fields: str, block_rows: int = 2000) -> DataFrame:
    """pairs(mark_a, mark_b, ...) with the fields that ``one(a, b)`` gives for the rows of their marks, a row for each tuple of its list, and error.

    A pair that cannot be scored is set apart instead of failing its task: one row of null
    fields with the error; a missing mark is one, too, and what ``one`` raises. No pair is
    tried again in another way. Marks travel to the pairs of blocks that ask for them, once
    each, not once a pair.
    """
    blocks = max(1, -(-marks.count() // block_rows))
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    keyed = pairs.withColumns({"bi": F.least(own("mark_a"), own("mark_b")), "bj": F.greatest(own("mark_a"), own("mark_b"))})
    asked = keyed.select(F.col("bi").alias("ti"), F.col("bj").alias("tj"), F.explode(F.array("mark_a", "mark_b")).alias("mark")).distinct()
    sent = asked.join(marks, "mark")
    names = [f.split()[0] for f in fields.split(", ")]
    kept = pairs.columns

    def run(rows: pa.Table, held: pa.Table) -> pa.Table:
        rows = rows.sort_by([("mark_b", "ascending"), ("mark_a", "ascending")])  # so that what one prepares for b serves all its pairs
        known = {m: r for m, r in zip(held.column("mark").to_pylist(), held.to_pylist())}
        taken, out = [], []
        for at, (a, b) in enumerate(zip(rows.column("mark_a").to_pylist(), rows.column("mark_b").to_pylist())):
            try:
                missing = [m for m in (a, b) if m not in known]
                if missing:
                    raise LookupError(f"no mark {missing[0]}")
                found = [(*values, None) for values in one(known[a], known[b])]
            except Exception as e:  # noqa: BLE001  a bad pair is a row of its own
                found = [(*[None] * len(names), f"{type(e).__name__}: {e}"[:200])]
            taken += [at] * len(found)
            out += found
        given = rows.select(kept).take(pa.array(taken, pa.int64()))
        columns = {n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip([*names, "error"], types))}
        return pa.table({**{c: given.column(c) for c in kept}, **columns})

    kinds = [f"{c} {t}" for c, t in pairs.dtypes]
    types = to_arrow_schema(StructType.fromDDL(f"{fields}, error string")).types
    return keyed.groupBy("bi", "bj").cogroup(sent.groupBy("ti", "tj")).applyInArrow(run, ", ".join([*kinds, fields, "error string"]))


def failures(scored: DataFrame) -> DataFrame:
    """Pairs set apart by score_pairs, with the kind of their error; to be counted beside the result."""
    return scored.where("error is not null").select("mark_a", "mark_b", F.lit("pair_crash").alias("rule"), F.regexp_extract("error", "^([A-Za-z]+)", 1).alias("kind"), "error")


def dot_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products: cosines of rows of unit norm."""
    return a @ b.T


def labelled(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """pairs with the source of either mark, where they did not bring it along, and label 1 where they agree; marks(mark, source) without their arrays."""
    if {"source_a", "source_b"} <= set(pairs.columns):
        out = pairs
    else:
        sources = marks.select("mark", "source")
        out = pairs.join(sources.toDF("mark_a", "source_a"), "mark_a").join(sources.toDF("mark_b", "source_b"), "mark_b")
    return out.withColumn("label", (F.col("source_a") == F.col("source_b")).cast("int"))


def sampling_order(seed: int, *key: Column) -> Column:
    """A seeded order that does not depend on partitioning: the digest of seed and key."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]), 256)


def stratified(pairs: DataFrame, strata: tuple[str, ...], most: int, seed: int = 0) -> DataFrame:
    """All same-source pairs, and of different-source pairs at most ``most`` a stratum, in seeded order.

    The cut is made by digest rank within (stratum, salt) first, so no task ranks a
    whole stratum: of each of 16 salts the first ``most`` suffice.
    """
    order = sampling_order(seed, F.col("mark_a"), F.col("mark_b"))
    rows = pairs.where("label = 0").withColumns({"order": order, "salt": F.pmod(F.xxhash64("mark_a", "mark_b"), F.lit(16))})
    for part in ((*strata, "salt"), strata):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy("order"))).where(F.col("rank") <= most)
    return pairs.where("label = 1").select(*pairs.columns).union(rows.select(*pairs.columns))


def first_of(df: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of each key in a stated order; aggregated before it is shuffled."""
    rest = [c for c in df.columns if c not in key]
    lead = [c for c in order if c not in key]
    best = df.groupBy(*key).agg(F.min(F.struct(*lead, *[c for c in rest if c not in lead])).alias("first"))
    return best.select(*[c if c in key else F.col(f"first.{c}").alias(c) for c in df.columns])


def hardest(pairs: DataFrame, by: tuple[str, ...], most: int) -> DataFrame:
    """The ``most`` lowest-scoring same-source and highest-scoring different-source pairs of each group, with their rank."""
    order = F.when(F.col("label") == 1, F.col("score")).otherwise(-F.col("score"))
    rank = F.row_number().over(Window.partitionBy(*by, "label").orderBy(order, "mark_a", "mark_b"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most)


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both scorers' values of the same unordered pair, where both are numbers; a and b hold mark_a, mark_b, score."""

    def keyed(df: DataFrame, name: str) -> DataFrame:
        value = F.col("score").try_cast("double")
        ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
        return df.where(ok).select(F.least("mark_a", "mark_b").alias("mark_a"), F.greatest("mark_a", "mark_b").alias("mark_b"), value.alias(name))

    return keyed(a, "score_1").join(keyed(b, "score_2"), ["mark_a", "mark_b"])


def balanced_sample(marks: DataFrame, want: int, same_source: bool, seed: int = 0, tries: int = 60) -> DataFrame:
    """mark_a < mark_b: up to ``want`` distinct pairs of marks(mark, source, study), by drawing a study, then its source or sources, then their marks.

    So a large source or study gives no more pairs than a small one. Each of want * tries draws looks its marks up by
    their numbers; no list of candidate pairs is made. Of equal pairs the first draw counts.
    """
    marks = marks.where("study is not null and source is not null and mark is not null").select("study", "source", "mark").distinct()
    per = Window.partitionBy("study", "source")
    numbered = reused(marks.withColumns({"place": F.row_number().over(per.orderBy("mark")) - 1, "n_marks": F.count("*").over(per)}))
    sources = numbered.where("place = 0").select("study", "source", "n_marks")
    own = Window.partitionBy("study")
    sources = reused(sources.withColumns({"at": F.row_number().over(own.orderBy("source")) - 1, "n_sources": F.count("*").over(own)}))
    studies = sources.where("at = 0").select("study").agg(F.array_sort(F.collect_list("study")).alias("studies"))

    def number(slot: int, below: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(str(int(same_source))), F.col("draw").cast("string"), F.lit(str(slot))), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), below)

    draws = marks.sparkSession.range(want * tries).withColumnRenamed("id", "draw").join(F.broadcast(studies)).where(F.size("studies") > 0)
    draws = draws.select("draw", F.get("studies", number(0, F.size("studies"))).alias("study"))
    draws = draws.join(sources.where("at = 0").select("study", "n_sources"), "study").withColumn("sa", number(1, F.col("n_sources")))
    a = sources.select("study", F.col("at").alias("sa"), F.col("source").alias("source_a"), F.col("n_marks").alias("na"))
    draws = draws.join(a, ["study", "sa"])
    if same_source:
        draws = draws.where("na > 1").withColumns({"source_b": F.col("source_a"), "pa": number(2, F.col("na"))})
        draws = draws.withColumn("pb", F.pmod(F.col("pa") + 1 + number(3, F.col("na") - 1), F.col("na")))
    else:
        draws = draws.where("n_sources > 1").withColumn("sb", F.pmod(F.col("sa") + 1 + number(4, F.col("n_sources") - 1), F.col("n_sources")))
        b = sources.select("study", F.col("at").alias("sb"), F.col("source").alias("source_b"), F.col("n_marks").alias("nb"))
        draws = draws.join(b, ["study", "sb"]).withColumns({"pa": number(2, F.col("na")), "pb": number(3, F.col("nb"))})
    for s in "ab":
        draws = draws.join(numbered.select("study", F.col("source").alias(f"source_{s}"), F.col("place").alias(f"p{s}"), F.col("mark").alias(f"m{s}")), ["study", f"source_{s}", f"p{s}"])
    found = draws.groupBy(F.least("ma", "mb").alias("mark_a"), F.greatest("ma", "mb").alias("mark_b")).agg(F.min("draw").alias("draw"))
    return found.orderBy("draw").limit(want).select("mark_a", "mark_b")
