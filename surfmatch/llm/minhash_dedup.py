"""MinHash near-dedup (operator 4) by fast similarity sketching.

A document's set is its distinct word shingles. Sketching works in rounds: round i
hashes every element to one of ``t`` coordinates with a value led by i, and each
coordinate keeps its least value; when all are filled, sketching ends, and from
round t on, round t + j puts its values into coordinate j only, so that after 2t
rounds nothing is empty. Coordinates agree with probability the Jaccard similarity,
and concentrate as independent ones do.

Bands of ``rows`` coordinates make buckets. Similarity is then verified exactly, on
the words themselves:

1. In every bucket each member meets the bucket's hub only (a star), so a group of
   thousands of copies costs thousands of pairs. Links give components.
2. Members of one hub that are still in different components meet if they differ
   from the hub alike (difference_pairs, an exact filter), and are verified too.

So within a bucket no link is lost, and no pair of it needs to be written out. With
the default 42 bands of 6 a pair of similarity 0.8 shares no bucket with
probability 3e-6.

Cases: null text and text without words have an empty set, link with nothing and
are their own component. Repeated rows are copies of each other; a null doc_id
takes part, and a component's id is its smallest doc_id that is not null. An empty
table gives an empty result. Ties: a similarity of exactly the threshold links, and
of equal smallest ids all are the component's. No SQL: exact similarity of all pairs
is a cross join; tests hold the operator against brute force.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surfmatch.llm.bytehash import U, batches_of_bytes, mix, shingles
from surfmatch.llm.common import drop_table, let, lower_ascii, materialize, pick, small_batches, words_of
from surfmatch.llm.components import connected_components

GOLD = U(0x9E3779B97F4A7C15)


def sketch(rows: np.ndarray, hashes: np.ndarray, n: int, t: int) -> np.ndarray:
    """(n, t) sketches of n sets given as sorted (row, hash); empty sets keep the largest value."""
    out = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    active = np.zeros(n, bool)
    active[rows] = True
    for i in range(2 * t):
        v = mix(hashes + GOLD * U(i + 1))
        place = (v >> U(32)) * U(t) >> U(32) if i < t else np.full(len(v), i - t, np.uint64)
        np.minimum.at(out, rows * t + place.astype(np.int64), (U(i) << U(32)) | (v & U(0xFFFFFFFF)))
        open_ = (out.reshape(n, t) == np.iinfo(np.uint64).max).any(1) & active
        if not open_.any():
            break
        if not open_.all():
            keep = open_[rows]
            rows, hashes = rows[keep], hashes[keep]
        active = open_
    return out.reshape(n, t)


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) bucket keys; the band's number is part of the key."""
    cut = sketches.reshape(len(sketches), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + U(1), cut.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * U(37) + cut[:, :, j])
    return key


def sketched(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """mid (a number for the row), doc_id, digest of the text, n_shingles, and bucket keys; one row per row of docs(doc_id, text)."""
    t = bands * rows
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            size, keys = [], []
            for i, j, data, offsets in batches_of_bytes(batch.column(1)):
                r, h = shingles(data, offsets, k)
                size.append(np.bincount(r, minlength=j - i))
                keys.append(band_keys(sketch(r, h, j - i, t), bands, rows).view(np.int64))
            if not batch.num_rows:
                continue
            n = np.concatenate(size)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
            flat = np.concatenate(keys)[n > 0].ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["doc_id", "digest", "n_shingles", "keys"],
            )

    rows_ = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    return rows_.mapInArrow(run, "doc_id long, digest string, n_shingles long, keys array<long>").select(
        F.monotonically_increasing_id().alias("mid"), "*"
    )


def shingle_strings(text: Column, k: int) -> Column:
    """The distinct shingles of a text as strings."""
    words = words_of(lower_ascii(text))

    def of_words(w: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.concat_ws(" ", F.slice(w, i, k)))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < k, F.array(F.concat_ws(" ", w))).otherwise(F.array_distinct(whole))

    return let(words, of_words)


def linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    texts = texts.select("mid", "text")  # shingles take several times the room, so they are made after the joins
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    both = both.select("a", "b", shingle_strings(F.col("ta"), k).alias("sa"), shingle_strings(F.col("tb"), k).alias("sb"))
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def star_pairs(placed: DataFrame) -> DataFrame:
    """hub, mid and their sizes for every bucket of placed(key, mid, n_shingles, copies) that holds several.

    A bucket's hub is its member with the most exact copies, of equals the one that shares
    most buckets with most others: of a text and its edited copies, the text, with which
    the copies agree more than with each other.
    """
    counts = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(placed.join(counts, "key"), "members")
    known = members.groupBy("mid").agg(F.sum("n").alias("met"))
    members_met = members.join(known, "mid")
    hubs = members_met.groupBy("key").agg(F.max(F.struct("copies", "met", (-F.col("mid")).alias("order"), "mid", "n_shingles")).alias("hub")).select("key", F.col("hub.mid").alias("hub"), F.col("hub.n_shingles").alias("hub_size"))
    star = materialize(members.join(hubs, "key").where("mid <> hub").select("hub", "mid", "hub_size", "n_shingles").distinct(), "star")
    drop_table(members)
    return star


def near_sizes(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def difference_pairs(star: DataFrame, labels: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a hub and may be similar.

    Let A(x) be the shingles of x that the hub lacks, R(x) those of the hub that x
    lacks, D(x) both. The difference of x and y is that of D(x) and D(y), so if x is not
    similar to the hub, x and y can only be similar if D(x) and D(y) overlap in all but
    (1 - s) / s of x's size: in any order of shingles they share one of the first
    (1 - s) / s |x| + 1 of D(x), and the same holds for y. Here added shingles come
    before removed ones, rarest first. If the first that x and y share is a removed
    one, A(x) and A(y) have nothing in common; then x and y share |hub| less the union
    of R(x) and R(y), which bounds from below how much of R(x) and R(y) must be the
    same. Copies edited apart meet neither condition.
    """
    component = labels.toDF("mid", "component")
    tagged = star.join(component, "mid", "left").withColumn("component", F.coalesce("component", "mid"))
    of_hub = component.toDF("hub", "hub_component")
    tagged = tagged.join(of_hub, "hub", "left").withColumn("hub_component", F.coalesce("hub_component", "hub"))
    tagged = materialize(tagged.select("hub", "mid", "hub_size", "n_shingles", "component", "hub_component"), "tagged")
    # a hub with one member apart has no pair to test
    apart = tagged.groupBy("hub").agg(F.max((F.col("component") != F.col("hub_component")).cast("int")).alias("apart"), F.count("*").alias("n")).where("apart = 1 and n > 1").select("hub")
    todo = tagged.join(apart, "hub", "left_semi").select("hub", "mid", "hub_size", "n_shingles", "component")
    own = ["hub", "mid", "hub_size", "n_shingles", "component"]
    texts = texts.select("mid", "text")
    both = todo.join(texts.toDF("mid", "tx"), "mid").join(texts.toDF("hub", "th"), "hub")
    both = both.select(*own, shingle_strings(F.col("tx"), k).alias("sx"), shingle_strings(F.col("th"), k).alias("sh"))
    tokens = lambda x, y, removed: F.transform(F.array_except(x, y), lambda t: F.struct(F.lit(removed).alias("removed"), F.xxhash64(t).alias("token")))
    differing = both.select(*own, tokens("sx", "sh", False).alias("more"), tokens("sh", "sx", True).alias("less"))
    differing = differing.select(*own, F.size("more").alias("n_added"), F.size("less").alias("n_removed"), F.explode(F.concat("more", "less")).alias("d"))
    differing = materialize(differing.select(*own, "n_added", "n_removed", "d.*"), "differing")
    key = ["hub", "removed", "token"]
    shared = differing.groupBy(*key).agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("df > 1")
    seen = differing.join(shared, key)
    of = Window.partitionBy("hub", "mid", "removed")
    seen = seen.withColumns({"n_seen": F.count("*").over(of), "rank": F.row_number().over(of.orderBy("df", "token"))})
    # shingles that no other member shares stand first among their kind
    place = F.when(F.col("removed"), F.col("n_added") + F.col("n_removed") - F.col("n_seen") + F.col("rank")).otherwise(F.col("n_added") - F.col("n_seen") + F.col("rank"))
    room = F.floor(F.col("n_shingles") * ((100 - percent) / percent) + 1e-9) + 1
    first = materialize(seen.where((place <= room) & (F.col("lo") != F.col("hi"))).select(*own, "n_added", "n_removed", "removed", "token", place.alias("place")), "first")
    drop_table(differing)
    a, b = (first.select(*key, *[F.col(c).alias(f"{c}_{x}") for c in ("mid", "hub_size", "component", "n_shingles", "n_added", "n_removed", "place")]) for x in "ab")
    total = F.col("n_shingles_a") + F.col("n_shingles_b")
    differ_a, differ_b = (F.col(f"n_added_{x}") + F.col(f"n_removed_{x}") for x in "ab")
    # twice the overlap that D(x) and D(y) must have, against what can follow if this is the first they share (for one of their tokens it is),
    # and the overlap of R(x) and R(y) if the added ones are disjoint
    rest = F.least(differ_a - F.col("place_a"), differ_b - F.col("place_b")) + 1
    enough = (100 + percent) * (differ_a + differ_b) - (100 - percent) * total <= 2 * (100 + percent) * rest
    fits = (100 + percent) * (F.col("n_removed_a") + F.col("n_removed_b") - F.col("hub_size_a")) + percent * total <= (100 + percent) * F.least("n_removed_a", "n_removed_b")
    met = a.join(b, key).where((F.col("component_a") < F.col("component_b")) & near_sizes("n_shingles_a", "n_shingles_b", percent) & enough & (~F.col("removed") | fits))
    return met.select(F.col("mid_a").alias("a"), F.col("mid_b").alias("b")).distinct()


def components_of(star: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """node, component of the rows that some verified link holds."""
    tested = star.where(near_sizes("hub_size", "n_shingles", percent)).select(F.col("hub").alias("a"), F.col("mid").alias("b"))
    links = materialize(linked(tested, texts, k, percent), "links")
    labels = materialize(connected_components(links), "labels")
    more = materialize(difference_pairs(star, labels, texts, k, percent), "pairs")
    if more.isEmpty():
        return labels
    links = links.union(materialize(linked(more, texts, k, percent), "links"))
    return materialize(connected_components(links), "labels")


def cluster(docs: DataFrame, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """mid, doc_id, digest, n_shingles and component (smallest mid of the component) of every row of docs(doc_id, text)."""
    table = materialize(sketched(docs, k, bands, rows), "sketch")
    # copies of a text are one class, which its first row stands for
    classes = materialize(table.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("mid", "doc_id")).alias("first"), F.count("*").alias("copies")).select("digest", F.col("first.mid").alias("rep"), F.col("first.doc_id").alias("rep_id"), "copies"), "classes")
    reps = table.join(classes.select(F.col("rep").alias("mid"), "copies"), "mid")
    placed = reps.select("mid", "n_shingles", "copies", F.explode("keys").alias("key"))
    star = star_pairs(placed)
    # the texts of all rows that share a bucket, one row for each class
    wanted = star.select(F.col("mid").alias("rep")).union(star.select("hub")).distinct().join(classes, "rep")
    hashed = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    matched = hashed.join(wanted.select("rep", "rep_id", F.col("digest").alias("d")), (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
    texts = materialize(matched.select(F.col("rep").alias("mid"), "text").dropDuplicates(["mid"]), "texts")
    labels = components_of(star, texts, k, percent)
    for used in (texts, star):
        drop_table(used)
    of_class = classes.join(labels.toDF("rep", "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = table.select("mid", "doc_id", "digest", "n_shingles").join(of_class, "digest", "left")
    return out.withColumn("component", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), "mid"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 42, rows: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component) and kept; one row per input row."""
    found = materialize(cluster(pick(docs, "doc_id", "text"), k, percent, bands, rows), "found")
    # tables of their own, here and below: Spark can then split what a large component or a hub of many brings
    ids = materialize(found.groupBy("component").agg(F.min("doc_id").alias("component_id")), "ids")
    out = found.join(ids, "component").select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_each(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 42, rows: int = 6) -> DataFrame:
    """The documents that stay: of each component the row of smallest doc_id, first in the table where ids repeat."""
    docs = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    found = materialize(cluster(docs, k, percent, bands, rows), "found")
    best = materialize(found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mid")).alias("best")), "best")
    stays = materialize(found.join(best, "component").where("mid = best.mid").select("doc_id", "digest"), "stays")
    digest = F.md5(F.coalesce("text", F.lit("")))
    left, right = docs.withColumn("digest", digest), stays.select(F.col("doc_id").alias("i"), F.col("digest").alias("d")).distinct()
    kept = left.join(right, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_semi")
    # rows that repeat id and text are copies; one of each stays, as do all rows with an empty set that differ
    return kept.dropDuplicates(["doc_id", "digest"]).drop("digest")
