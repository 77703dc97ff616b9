"""Substring dedup (operator 5): near-duplicate paragraphs by MinHash banding.

A paragraph is a line of at least ``min_words`` words. Equal paragraphs (same words,
A-Z in lower case) are one class. Classes are sketched (minhash_dedup.sketch) on
their distinct word shingles of five and banded for high recall: with the default 13
bands of two coordinates a pair of similarity 0.8 shares no bucket with probability
2e-6. Buckets are searched and pairs verified as in operator 4, by
exact Jaccard similarity on the words themselves. Of each component
the occurrence with the smallest (doc_id, place) stays, all others are removed.

Passages that repeat without being a paragraph are cut too, wherever they lie, over line
ends as well: a word goes if it is in a run of ``passage`` words (A-Z in lower case) that
also stands where it is kept: at its first place by (doc_id, word), places in removed
lines last. Runs that reach into a removed line are cut no further. Runs of one text count if they do not overlap the first. Each text is sampled
at content-defined places: of every ``passage // 2 + 1`` neighbouring windows of
``passage - passage // 2`` words the one of least hash is kept, so two texts that share
a run of ``passage`` words share a window. All runs around such windows are then
compared by 64-bit hashes. Passages that differ in a word are found only where they
share such a run.

Cases: null and empty texts have no paragraphs. Rows that agree in doc_id and text
are one document: they keep and lose the same places. Lines shorter than
``min_words`` are never removed. A null doc_id sorts last. An empty table gives an
empty result. Ties: of equal copies the one of the smallest doc_id, then of the
first place, stays. No SQL: sketches, sampled windows and components have none that
runs on whole tables; tests hold the operator against brute force.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfmatch.llm.bytehash import BASE, INVERSE, LOWER, U, batches_of_bytes, mix, powers, prefix, shingles, span, words
from surfmatch.llm.common import drop_table, materialize, pick, short_shuffles, small_batches
from surfmatch.llm.minhash_dedup import band_keys, components_of, sketch, star_pairs
from surfmatch.llm.suffix_dedup import beside
from surfmatch.llm.windows import sliding_least

SHINGLE, BANDS, ROWS, PASSAGE = 5, 13, 2, 50
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def line_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets that cut the texts into lines, and the text and place of each line."""
    breaks = np.flatnonzero(data == 10) + 1
    cut = np.concatenate([offsets[:-1], breaks])
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks - 1, "right") - 1])
    # a break at a text's end begins an empty line, which starts where the next text does
    order = np.lexsort((cut, row))
    cut, row = cut[order], row[order]
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    return np.append(cut, offsets[-1]), row, np.arange(len(row)) - first[row]


def paragraph_rows(docs: DataFrame, min_words: int, k: int, bands: int, rows: int) -> DataFrame:
    """ref, idx, digest, n_shingles and bucket keys of every paragraph of docs(ref, text)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ref = batch.column(0).to_numpy()
            for i, _, data, offsets in batches_of_bytes(batch.column(1)):
                lines, row, place = line_offsets(data, offsets)
                low = LOWER[data]
                start, end, line = words(low, lines)
                count = np.bincount(line, minlength=len(row))
                long = np.flatnonzero(count >= min_words)
                if not len(long):
                    continue
                word = mix(span(prefix(low), start, end) + (end - start).astype(U))
                order = mix(word + np.arange(len(word)).astype(U) - np.concatenate([[0], np.cumsum(count)])[:-1][line].astype(U))
                first = np.concatenate([[0], np.cumsum(count)])[:-1][long]
                sums = np.concatenate([[U(0)], np.cumsum(order)])
                digest = mix(sums[first + count[long]] - sums[first] + count[long].astype(U))
                keep = np.zeros(len(row), bool)
                keep[long] = True
                own, hashes = shingles(data, lines, k)
                inside = keep[own]
                number = np.cumsum(keep) - 1
                own, hashes = number[own[inside]], hashes[inside]
                keys = band_keys(sketch(own, hashes, len(long), bands * rows), bands, rows).view(np.int64)
                ends = (np.arange(len(long) + 1) * bands).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ref[i + row[long]]),
                        pa.array(place[long].astype(np.int32)),
                        pa.array(digest.view(np.int64)),
                        pa.array(np.bincount(own, minlength=len(long)).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel())),
                    ],
                    ["ref", "idx", "digest", "n_shingles", "keys"],
                )

    return docs.select("ref", "text").mapInArrow(run, "ref long, idx int, digest long, n_shingles int, keys array<long>")


def repeated_paragraphs(docs: DataFrame, min_words: int, k: int, percent: int, bands: int, rows: int, most_rows: int, most_items: int) -> DataFrame:
    """ref and its repeated paragraphs: place, component, doc_id that keeps the component's copy, and whether it is this place; of docs(ref, doc_id, text)."""
    keyed = materialize(paragraph_rows(docs, min_words, k, bands, rows), "paragraphs")
    first = F.min(F.struct("ref", "idx")).alias("at")
    banded = materialize(keyed.groupBy("digest").agg(first, F.count("*").alias("c"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "classes")
    # bucket keys are most of these tables and are needed only here
    found = materialize(keyed.select("ref", "idx", "digest"), "places")
    drop_table(keyed)
    placed = banded.select(F.col("digest").alias("mid"), F.col("n").alias("n_shingles"), F.col("c").alias("copies"), F.explode("keys").alias("key"))
    # keys are counted first, so that the shuffle of the counts is gone when the rows are moved; one kind of join at every size
    several = materialize(placed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "several")
    placed = materialize(placed.join(several.hint("merge"), "key"), "buckets")
    classes = materialize(banded.select("digest", "at", "c"), "classes")
    for used in (several, banded):
        drop_table(used)
    star = star_pairs(placed)
    drop_table(placed)
    wanted = star.select(F.col("mid").alias("digest")).union(star.select("hub")).distinct().join(classes, "digest").groupBy("at.ref").agg(F.collect_list(F.struct("at.idx", "digest")).alias("items"))
    wanted = materialize(wanted, "wanted")
    read = beside(docs.select("ref", "text"), wanted, "inner", most_rows, most_items).select(F.split("text", "\n").alias("lines"), F.explode("items").alias("x"))
    texts = materialize(read.select(F.col("x.digest").alias("mid"), F.element_at("lines", F.col("x.idx") + 1).alias("text")).dropDuplicates(["mid"]), "texts")
    labels = components_of(star, texts, k, percent)
    for used in (texts, star):
        drop_table(used)
    of_class = classes.select("digest", "c").join(labels.toDF("digest", "component"), "digest", "left")
    # classes that occur once and are linked with nothing keep their paragraph
    of_class = of_class.where((F.col("c") > 1) | F.col("component").isNotNull()).select("digest", F.coalesce("component", "digest").alias("component"))
    marked = materialize(found.select("ref", "idx", "digest").join(of_class, "digest").select("ref", "idx", "component"), "marked")
    ids = docs.select("ref", F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("by"))
    placed_ids = materialize(marked.join(ids.dropDuplicates(["ref"]), "ref"), "placed")
    for used in (found, classes, wanted, labels, marked):
        drop_table(used)
    # a table of its own: a join with a large component can then be split
    stays = materialize(placed_ids.groupBy("component").agg(F.min(F.struct("by", "idx", "ref")).alias("stays")), "stays")
    item = F.struct("idx", "component", F.nullif(F.col("stays.by"), F.lit((1 << 63) - 1)).alias("stays_in"), ((F.col("ref") == F.col("stays.ref")) & (F.col("idx") == F.col("stays.idx"))).alias("stays"))
    out = materialize(placed_ids.join(stays, "component").groupBy("ref").agg(F.array_sort(F.collect_set(item)).alias("repeated")), "repeated")
    for used in (placed_ids, stays):
        drop_table(used)
    return out


def sampled(value: np.ndarray, row: np.ndarray, w: int) -> np.ndarray:
    """Whether each value is the least of some w neighbours of one text."""
    n = len(value)
    if n < w:
        return np.zeros(n, bool)
    least = sliding_least(value, w)
    least = np.where(row[: n - w + 1] == row[w - 1 :], least, U(0))
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return ~sliding_least(~padded, w) == value


def runs_of_words(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word (in its text) and hash of every run of n words, whatever lines they stand in."""
    low = LOWER[data]
    start, end, row = words(low, offsets)
    at = np.arange(max(0, len(start) - n + 1))
    at = at[row[at] == row[at + n - 1]]
    word = mix(span(prefix(low), start, end) + (end - start).astype(U))
    sums = np.concatenate([[U(0)], np.cumsum(word * powers(BASE, len(word))[: len(word)])])
    value = mix((sums[at + n] - sums[at]) * powers(INVERSE, len(word))[at]) | U(1)
    return row[at], at - np.searchsorted(row, row[at]), value


def items_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The list and the value of every item of lists of integers; null lists have none."""
    n = lists.value_lengths().fill_null(0).to_numpy(False)
    return np.repeat(np.arange(len(lists)), n), lists.flatten().to_numpy(False).astype(np.int64)


def lost_words(data: np.ndarray, offsets: np.ndarray, removed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many words of removed lines stand before each of its words (one text after the other), and where its words begin."""
    cut, line_row, _ = line_offsets(data, offsets)
    _, _, line = words(data, cut)
    begin = np.searchsorted(line_row[line], np.arange(len(offsets)))
    first, items = np.searchsorted(line_row, np.arange(len(offsets) - 1)), items_of(removed)
    gone = np.zeros(len(line_row), bool)
    gone[first[items[0]] + items[1]] = True
    return np.concatenate([[0], np.cumsum(gone[line])]), begin


def sampled_runs(texts: DataFrame, n: int, w: int) -> DataFrame:
    """ref, word and hash of the runs of n words of texts(ref, text, removed) that are the least of some w neighbours, and whether they reach into a removed line."""
    small_batches(texts.sparkSession)

    def run(batches):
        for batch in batches:
            ref = batch.column(0).to_numpy()
            for i, j, data, offsets in batches_of_bytes(batch.column(1)):
                row, word, value = runs_of_words(data, offsets, n)
                keep = sampled(value, row, w)
                row, word, value = row[keep], word[keep], value[keep]
                before, begin = lost_words(data, offsets, batch.column(2)[i:j])
                at = begin[row] + word
                lost = before[at + n] > before[at]
                yield pa.RecordBatch.from_arrays([pa.array(ref[i + row]), pa.array(word.astype(np.int32)), pa.array(value.view(np.int64)), pa.array(lost)], ["ref", "word", "hash", "lost"])

    return texts.select("ref", "text", "removed").mapInArrow(run, "ref long, word int, hash long, lost boolean")


def runs_around(texts: DataFrame, n: int, inner: int) -> DataFrame:
    """by, ref, word and hash of the runs of n words of texts(ref, text, by, starts, removed) that hold a run of ``inner`` words begun at
    one of starts and reach into no line whose place is in removed."""
    small_batches(texts.sparkSession)

    def run(batches):
        for batch in batches:
            ref, by, starts = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            for i, j, data, offsets in batches_of_bytes(batch.column(1)):
                row, word, value = runs_of_words(data, offsets, n)
                before, at = lost_words(data, offsets, batch.column(4)[i:j])
                text, start = items_of(starts[i:j])
                known = np.sort((text << 32) + start)
                place = (row << 32) + word
                near = np.searchsorted(known, place) < np.searchsorted(known, place + (n - inner), "right")
                word_at = at[row] + word
                keep = near & (before[word_at + n] == before[word_at])
                row, word, value = i + row[keep], word[keep], value[keep]
                yield pa.RecordBatch.from_arrays([pa.array(by[row]), pa.array(ref[row]), pa.array(word.astype(np.int32)), pa.array(value.view(np.int64))], ["by", "ref", "word", "hash"])

    return texts.select("ref", "text", "by", "starts", "removed").mapInArrow(run, "by long, ref long, word int, hash long")


def shared_windows(known: DataFrame, gone: DataFrame, passage: int, most_rows: int, most_items: int) -> DataFrame:
    """Of the sampled windows of ``passage - passage // 2`` words of known(ref, text), by ref: across, the first words of those that also stand in
    another document, and starts, of those that stand twice or more outside the removed lines."""
    texts = beside(known.select("ref", "text"), gone, "left", most_rows, most_items)
    found = materialize(sampled_runs(texts, passage - passage // 2, passage // 2 + 1), "sampled")
    # plain numbers, which Spark aggregates by hashing; a struct's least would be found by sorting
    left = {c: F.when(~F.col("lost"), F.col(c)) for c in ("ref", "word")}
    ends = [f(x).alias(f"{c}_{e}") for c, x in left.items() for f, e in ((F.min, "lo"), (F.max, "hi"))]
    hashes = found.groupBy("hash").agg(F.min("ref").alias("lo"), F.max("ref").alias("hi"), *ends)
    twice = F.coalesce((F.col("ref_lo") != F.col("ref_hi")) | (F.col("word_lo") != F.col("word_hi")), F.lit(False))
    several = hashes.select("hash", (F.col("lo") != F.col("hi")).alias("across"), twice.alias("twice")).where("across or twice")
    several = materialize(several, "several")
    chosen = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("word"))))
    out = found.join(several, "hash").groupBy("ref").agg(chosen(F.col("across")).alias("across"), chosen(F.col("twice") & ~F.col("lost")).alias("starts"))
    out = materialize(out, "shared")
    drop_table(found)
    drop_table(several)
    return out


def repeated_passages(known: DataFrame, gone: DataFrame, shared: DataFrame, passage: int, most_rows: int, most_items: int) -> DataFrame:
    """ref and runs (stretches of words: first and end) to cut, of known(ref, doc_id, text): outside the removed lines, all but the first place of
    each run of ``passage`` words by (doc_id, word)."""
    lists = materialize(shared.where(F.size("starts") > 0).select("ref", "starts").join(gone, "ref", "left"), "lists")
    lines = beside(known.select("ref", "text", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("by")), lists, "inner", most_rows, most_items)
    every = materialize(runs_around(lines, passage, passage - passage // 2), "every")
    place = F.struct("by", "ref", "word")
    first = every.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("hash", "first")
    first = materialize(first, "first")
    # a run beside the first place is a repeat only if it does not overlap it
    apart = (F.col("ref") != F.col("first.ref")) | (F.col("word") >= F.col("first.word") + passage)
    again = every.join(first, "hash").where(apart).groupBy("ref").agg(F.array_sort(F.collect_set("word")).alias("w"))
    begins = F.filter("w", lambda x, i: F.coalesce(x > F.get("w", i - 1) + passage, F.lit(True)))
    ends = F.transform(F.filter("w", lambda x, i: F.coalesce(F.get("w", i + 1) > x + passage, F.lit(True))), lambda x: x + passage)
    runs = materialize(again.select("ref", F.arrays_zip(begins.alias("first"), ends.alias("end")).alias("runs")), "runs")
    for used in (lists, every, first):
        drop_table(used)
    return runs


def stretches(covered: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


def cut_passages(lines: list[str], runs: list) -> tuple[list[str], list[tuple[int, int, int]]]:
    """The lines without the words of the runs, and what was cut: line, first word, number of words."""
    spans = [[m.span() for m in WORD.finditer(x)] for x in lines]
    begin = np.cumsum([0, *map(len, spans)])
    own = np.zeros(begin[-1], bool)
    for first, end in runs:
        own[first:end] = True
    lines, cut = list(lines), []
    for place in np.unique(np.searchsorted(begin, np.flatnonzero(own), "right") - 1):
        text, out, at = lines[place], [], 0
        for a, b in stretches(own[begin[place] : begin[place + 1]]):
            out.append(text[at : spans[place][a][0]])
            at = spans[place][b][0] if b < len(spans[place]) else spans[place][-1][1]
            cut.append((int(place), a, b - a))
        lines[place] = "".join([*out, text[at:]])
    return lines, cut


def remove_paragraphs(
    docs: DataFrame, min_words: int = 10, k: int = SHINGLE, percent: int = 80, bands: int = BANDS, rows: int = ROWS, most_rows: int = 200_000, most_items: int = 1_000_000, passage: int = PASSAGE
) -> DataFrame:
    """doc_id, n_shared (stretches of the text that also stand in another document, kept copies included: any repeated run of ``passage`` words gives one,
    none comes from less than half as many), n_paragraphs (lines), n_removed, removed (places), repeated (paragraphs with their component and
    the doc_id that keeps it), n_passages, passages (line, first word, words cut), kept_text and kept_sha256; one row per input row."""
    docs = pick(docs, "doc_id", "text")
    known = docs.withColumn("ref", F.xxhash64("doc_id", "text"))
    with short_shuffles(docs.sparkSession):
        repeated = repeated_paragraphs(known, min_words, k, percent, bands, rows, most_rows, most_items)
        places = F.transform(F.filter("repeated", lambda x: ~x["stays"]), lambda x: x["idx"])
        gone = materialize(repeated.select("ref", places.alias("removed")).where(F.size("removed") > 0), "gone")
        shared = shared_windows(known, gone, passage, most_rows, most_items)
        runs = repeated_passages(known, gone, shared, passage, most_rows, most_items)
        inner = passage - passage // 2
        begun = F.filter("across", lambda x, i: F.coalesce(x > F.get("across", i - 1) + inner, F.lit(True)))
        # all lists of a text in one row, so that texts are moved once at most
        lists = shared.select("ref", F.size(begun).alias("n_shared")).join(repeated, "ref", "full").join(runs, "ref", "full")
        lists = materialize(lists.select("ref", F.struct("n_shared", "repeated", "runs").alias("found")), "lists")
        for used in (repeated, gone, shared, runs):
            drop_table(used)
    # nearly every text has some, so all are moved, whatever their number
    joined = known.join(lists.hint("merge"), "ref", "left").select("doc_id", "text", "found.*").withColumn("removed", places)
    split = F.split(F.col("text"), "\n")

    @F.udf("struct<lines: array<string>, cut: array<struct<line: int, first: int, words: int>>>")
    def cut(lines, runs):
        return runs and cut_passages(lines, runs)

    # only texts with passages are sent to Python
    joined = joined.withColumn("cut", cut(F.when(F.col("runs").isNotNull(), split), "runs"))
    lines = F.coalesce("cut.lines", split)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains("removed", i), F.lit(False))), "\n")
    kept = F.coalesce(left, F.lit(""))
    return joined.select(
        "doc_id",
        F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"),
        F.coalesce(F.size(F.filter(split, lambda x: x != "")), F.lit(0)).cast("long").alias("n_paragraphs"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.col("removed"), F.array().cast("array<int>")).alias("removed"),
        F.coalesce("repeated", F.array().cast("array<struct<idx: int, component: long, stays_in: long, stays: boolean>>")).alias("repeated"),
        F.coalesce(F.size("cut.cut"), F.lit(0)).cast("long").alias("n_passages"),
        F.coalesce(F.col("cut.cut"), F.array().cast("array<struct<line: int, first: int, words: int>>")).alias("passages"),
        kept.alias("kept_text"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )
