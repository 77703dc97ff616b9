"""Suffix-array dedup (operator 3): exact removal of long repeats, by a logarithmic family of suffix arrays.

Every ``length``-byte window belongs to one sampled suffix (windows.py), which is
known by the hash of its first k bytes (key) and of all that its windows cover
(body). A batch of texts gets its suffix array: the sorted table of its (key, body)
with their counts. The family keeps arrays in levels of 1, 2, 4 ... batches; a new
array is merge-scanned with the level of its size and takes its place one level up,
until no level of that size stands. So a text is merged log(batches) times.

Windows of a suffix are repeated

* all, if its body occurs twice anywhere;
* none, if its key occurs once;
* else perhaps some: the suffix's windows are cut into blocks of ``step`` neighbours,
  told apart by the bytes that a block shares, and what is still open after that
  into single windows. One occurrence of each repeated body with the same key is
  cut along, so that a match with it is seen.

Each step is a join on hashes of 64 bits, aggregated before it is shuffled. Texts
are never shuffled but by the last joins, and there only where the lists they meet
are too long to broadcast.

Cases: null text is empty and keeps nothing and removes nothing, as do texts
shorter than ``length``. Repeated rows repeat each other's windows, so long ones go
entirely. Rows that agree in doc_id and text share their spans; a null doc_id is
like any other. Memory follows the longest single text. An empty table gives an
empty result. Ties: every one of equal strings is removed, wherever it stands, so
there is none to choose. No SQL: 200-byte strings at every place of every text are
as many rows as bytes; tests hold the operator against brute force.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfmatch.llm.bytehash import batches_of_bytes, prefix
from surfmatch.llm.common import drop_table, materialize, pick, small_batches
from surfmatch.llm.windows import blocks, window_anchors

LENGTH, K, STEP = 200, 64, 8
ENTRY = "key long, body long, ref long, lo int, n int, ahead int"


def referred(docs: DataFrame) -> DataFrame:
    """ref, text: a row is known by the hash of its id and text."""
    return docs.select(F.xxhash64("doc_id", "text").alias("ref"), "text")


def entry_batch(found, ref: np.ndarray) -> pa.RecordBatch:
    i32 = lambda x: pa.array(x.astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(found.key.view(np.int64)), pa.array(found.body.view(np.int64)), pa.array(ref), i32(found.lo), i32(found.n), i32(found.ahead)],
        ["key", "body", "ref", "lo", "n", "ahead"],
    )


def suffixes(texts: DataFrame, length: int, k: int) -> DataFrame:
    """The sampled suffixes of texts(ref, text)."""
    small_batches(texts.sparkSession)

    def run(batches):
        for batch in batches:
            ref = batch.column(0).to_numpy()
            for i, _, data, offsets in batches_of_bytes(batch.column(1)):
                found = window_anchors(data, offsets, length, k)
                yield entry_batch(found, ref[i + found.row])

    return texts.mapInArrow(run, ENTRY)


def finer(texts: DataFrame, length: int, step: int) -> DataFrame:
    """The open suffixes of texts(ref, text, open) cut into blocks of step windows."""
    small_batches(texts.sparkSession)

    def run(batches):
        for batch in batches:
            ref, lists = batch.column(0).to_numpy(), batch.column(2)
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = lists[i].values
                lo, n, ahead = (own.field(c).to_numpy().astype(np.int64) for c in ("lo", "n", "ahead"))
                found = blocks(prefix(np.frombuffer(text.encode(), np.uint8)), lo, n, ahead, length, step)
                yield entry_batch(found, np.full(len(found.key), ref[i]))

    return texts.mapInArrow(run, ENTRY)


class SuffixFamily:
    """Suffix arrays in levels; levels[i] holds 2**i batches or nothing."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[DataFrame | None] = []

    def add(self, entries: DataFrame) -> None:
        """Add a batch: its array, merged with the levels of equal size on the way up."""
        array = entries.groupBy("key", "body").agg(F.count("*").alias("c"))
        new = materialize(array.repartition("key").sortWithinPartitions("key", "body"), "suffixes")
        i = 0
        while i < len(self.levels) and (old := self.levels[i]) is not None:
            both = old.union(new).repartition("key").groupBy("key", "body").agg(F.sum("c").alias("c"))
            merged = materialize(both.sortWithinPartitions("key", "body"), "suffixes")
            drop_table(old)
            drop_table(new)
            self.levels[i], new, i = None, merged, i + 1
        self.levels[i : i + 1] = [new]

    def counts(self) -> DataFrame:
        """key, body, c over all levels."""
        held = [x for x in self.levels if x is not None]
        out = held[0]
        for x in held[1:]:
            out = out.union(x)
        return out if len(held) == 1 else out.groupBy("key", "body").agg(F.sum("c").alias("c"))

    def drop(self) -> None:
        for x in self.levels:
            if x is not None:
                drop_table(x)


def repeated(counts: DataFrame) -> DataFrame:
    """Of counts(key, body, c), those whose key occurs twice or more, and whether the body does."""
    keys = counts.groupBy("key").agg(F.sum("c").alias("k")).where("k > 1").select("key")
    return counts.join(keys, "key", "left_semi").select("key", "body", (F.col("c") > 1).alias("whole"))


def resolved(entries: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """key, body, ref, lo, n, ahead, whole of the entries whose key is repeated."""
    known = materialize(repeated(counts), "repeated")
    found = materialize(entries.join(known, ["key", "body"]).select("key", "body", "ref", "lo", "n", "ahead", "whole"), name)
    drop_table(known)
    return found


def still_open(found: DataFrame) -> DataFrame:
    """ref and its runs to look into: those not wholly repeated, and of each repeated body beside them one occurrence."""
    place = F.struct("lo", "n", "ahead")
    unsure = found.where("not whole")
    beside_them = found.where("whole").join(unsure.select("key").distinct(), "key", "left_semi")
    one = beside_them.groupBy("key", "body").agg(F.min(F.struct("ref", "lo", "n", "ahead")).alias("p")).select("p.*")
    runs = unsure.select("ref", "lo", "n", "ahead").union(one)
    return runs.groupBy("ref").agg(F.collect_set(place).alias("open"))


def beside(docs: DataFrame, lists: DataFrame, how: str, most_rows: int, most_items: int) -> DataFrame:
    """docs(ref, ...) joined with lists(ref, arrays): broadcast where rows and items are counted to be few."""
    arrays = [c for c, kind in lists.dtypes if kind.startswith("array")]
    size = sum((F.coalesce(F.size(c), F.lit(0)) for c in arrays[1:]), F.coalesce(F.size(arrays[0]), F.lit(0)))
    rows, items = lists.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return docs.join(F.broadcast(lists) if rows <= most_rows and items <= most_items else lists, "ref", how)


def merged_intervals(items):
    """Sorted, disjoint intervals of an array of (s, e)."""
    none = F.array().cast("array<struct<s:int,e:int>>")

    def step(a, x):
        last = F.element_at(a, -1)
        grown = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["e"] >= x["s"]), grown).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(F.array_sort(items), none, step)


def repeated_spans(docs: DataFrame, length: int, k: int, step: int, batches: int, most_rows: int, most_items: int) -> DataFrame:
    """ref and the byte spans to remove, of docs(doc_id, text); texts without any are left out."""
    spark = docs.sparkSession
    texts = referred(docs)
    family = SuffixFamily(spark)
    for b in range(batches):
        family.add(suffixes(texts.where(F.pmod(F.xxhash64("ref"), F.lit(batches)) == b), length, k))
    found = [resolved(suffixes(texts, length, k), family.counts(), "windows")]
    family.drop()
    for size in (step, 1):
        open_ = materialize(still_open(found[-1]), "open")
        cut = finer(beside(texts, open_, "inner", most_rows, most_items).select("ref", "text", "open"), length, size)
        cut = materialize(cut, "blocks")
        found.append(resolved(cut, cut.groupBy("key", "body").agg(F.count("*").alias("c")), "windows"))
    spans = None
    for f in found:
        own = f.where("whole").select("ref", F.struct(F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1 + length).alias("e")).alias("span"))
        spans = own if spans is None else spans.union(own)
    return spans.groupBy("ref").agg(merged_intervals(F.collect_set("span")).alias("spans"))


def cut_texts(docs: DataFrame, spans: DataFrame, most_rows: int, most_items: int, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the bytes left as text (broken characters replaced)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.xxhash64("doc_id", "text").alias("ref"), "doc_id", "text")
    joined = beside(rows, spans, "left", most_rows, most_items).select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")}
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, at, kept = (text or "").encode(), 0, []
                for x in own or ():
                    kept.append(data[at : x["s"]])
                    at = x["e"]
                left = b"".join([*kept, data[at:]])
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(left))
                out["n_spans"].append(len(own or ()))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["kept_text"].append(left.decode(errors="replace") if keep_text else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.string() if c[0] == "k" else pa.int64()) for c, v in out.items())], ["doc_id", *out])

    result = joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return result if keep_text else result.drop("kept_text")


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, k: int = K, step: int = STEP, batches: int = 2, keep_text: bool = False, most_rows: int = 200_000, most_items: int = 1_000_000
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; see the module's docstring."""
    docs = pick(docs, "doc_id", "text")
    spans = materialize(repeated_spans(docs, length, k, step, batches, most_rows, most_items), "spans")
    return cut_texts(docs, spans, most_rows, most_items, keep_text)
