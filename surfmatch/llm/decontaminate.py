"""Benchmark decontamination (operator 8): greedy string tiling by running Karp-Rabin.

Benchmark items are indexed by the rolling hashes of their strings of ``least``
words (an item of fewer words by its whole self). A document's strings of that
length meet the index by binary search; items that share one are candidates. For a
candidate whose shared strings could cover enough of it, strings of unmarked words are
hashed again in both for one length after the other, the longest first, and those whose
words agree are marked, so that tiles never overlap on either side. An item whose words are covered to ``percent`` or more has leaked, in whatever
order its pieces stand. Hashes choose candidates only; tiles compare the words.

The index is sent to the executors in blocks of bounded size, one after the other,
each against all documents; no document is shuffled. Words are the texts' words,
A-Z in lower case.

Cases: null and empty texts and items match nothing. Repeated items each count; a
null item_id is reported as null. An empty benchmark flags nothing, an empty
documents table gives an empty result. Long texts are read whole. Memory follows the
text and the item, not how often their words repeat; of tiles of one length the one
first in the item, then in the text, is marked first.

There is no oracle SQL: tiling is a loop whose every step depends on the one before.
Tests hold it against a plain tiling of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfmatch.llm.bytehash import BASE, LOWER, U, batches_of_bytes, mix, powers, prefix, span, words
from surfmatch.llm.common import pick, small_batches

LEAST = 5
PERCENT = 80
HIT = "array<struct<item_id:long,coverage:double>>"


def word_hashes(column: pa.Array):
    """(first row, word hashes, offsets by row) of runs of rows."""
    for i, j, data, offsets in batches_of_bytes(column):
        data = LOWER[data]
        start, end, row = words(data, offsets)
        word = mix(span(prefix(data), start, end) + (end - start).astype(U))
        yield i, word, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))])


def rolling(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n words that follow each other."""
    out = word[: max(0, len(word) - n + 1)].copy()
    for j in range(1, n):
        out = mix(out * U(31) + word[j : len(word) - n + 1 + j])
    return out


class Texts:
    """Texts of a column from some row on, made strings only where one is asked for."""

    def __init__(self, column: pa.Array, first: int):
        self.column, self.first = column, first

    def __getitem__(self, i: int) -> str | None:
        return self.column[self.first + i].as_py()


class ItemIndex:
    """Words of the items of one block, and the sorted hashes of their strings, by string length."""

    def __init__(self, ids: list[int | None], texts: list[str | None], least: int):
        self.ids, self.texts, self.items = ids, texts, []
        for _, word, at in word_hashes(pa.array(texts, pa.string())):
            self.items += [word[a:b] for a, b in zip(at, at[1:])]
        self.seeds = {}
        for n in range(1, least + 1):
            own = [i for i, w in enumerate(self.items) if len(w) and min(least, len(w)) == n]
            if own:
                parts = [rolling(self.items[i], n) for i in own]
                seed = np.concatenate(parts)
                item = np.repeat(own, [len(p) for p in parts])
                place = np.concatenate([np.arange(len(p)) for p in parts])
                order = np.argsort(seed, kind="stable")
                self.seeds[n] = (seed[order], item[order], place[order])

    def meetings(self, word: np.ndarray, at: np.ndarray):
        """(row, item, string length, places in the item) of the items that share strings with a row, however often the row holds them."""
        for n, (seed, item, place) in self.seeds.items():
            own = rolling(word, n)
            lo = np.searchsorted(seed, own, "left")
            hit = np.flatnonzero(seed[np.minimum(lo, len(seed) - 1)] == own)
            row = np.searchsorted(at, hit, "right") - 1
            whole = hit + n <= at[row + 1]
            hit, row = hit[whole], row[whole]
            for r in np.unique(row):
                s, e = np.searchsorted(row, [r, r + 1])
                first = np.unique(lo[hit[s:e]])  # a string once, though the row repeats it
                count = np.searchsorted(seed, seed[first], "right") - first
                post = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                post = post[np.argsort(item[post], kind="stable")]
                new = np.flatnonzero(np.diff(item[post], prepend=-1))
                for x, y in zip(new, np.append(new[1:], len(post))):
                    yield int(r), int(item[post[x]]), n, place[post[x:y]]


def numbered(text: str, item: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of a text and of an item as numbers, equal for equal words only; words that the item lacks are -1."""
    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
    return np.array([number.get(w, -1) for w in plain_words(text)]), np.array([number[w] for w in item])


def plain_words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case: bytes.lower() changes nothing else."""
    return (text or "").encode().lower().split()


class Unmarked:
    """Words of a sequence as numbers, those that no tile has marked yet, and rolling hashes of the strings of these."""

    def __init__(self, words: np.ndarray, free: np.ndarray):
        self.words, self.free = words, free
        self.sums = np.zeros(len(words) + 1, U)
        np.cumsum(mix(words.astype(U) + U(1)) * powers(BASE, len(words))[: len(words)], out=self.sums[1:])

    def strings(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the strings of n unmarked words."""
        marked = np.concatenate([[0], np.cumsum(~self.free)])
        place = np.flatnonzero(marked[n:] == marked[:-n])
        return place, span(self.sums, place, place + n)

    def is_free(self, place: int, n: int) -> bool:
        """Whether a string free at first still is: tiles marked since are as long, so they reach one of its ends."""
        return self.free[place] and self.free[place + n - 1]

    def mark(self, place: int, n: int) -> None:
        self.free[place : place + n] = False


def shared_strings(text: Unmarked, item: Unmarked, n: int):
    """(place, hash) of the unmarked strings of n words of a text whose hash the item has, in order of hash and place, and all of the item's."""
    own, key = item.strings(n)
    place, hashed = text.strings(n)
    if not len(own) or not len(place):
        return place[:0], hashed[:0], own, key
    known = np.sort(key)
    hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, hashed), len(known) - 1)] == hashed)
    place, hashed = place[hit], hashed[hit]
    order = np.argsort(hashed, kind="stable")
    return place[order], hashed[order], own, key


def narrowed(text: Unmarked, item: Unmarked, n: int) -> Unmarked:
    """The text without the words that no tile can take any more; one marked word stands for each gap."""
    place = shared_strings(text, item, n)[0]
    edge = np.zeros(len(text.words) + 1, int)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + n, -1)
    live = np.cumsum(edge)[:-1] > 0
    kept = np.flatnonzero(live | np.concatenate([[False], live[:-1]]))
    return Unmarked(text.words[kept], text.free[kept] & live[kept])


def tiles_cover(text: np.ndarray, item: np.ndarray, n: int) -> int:
    """Words of an item that tiles of n words or more cover: the longest first, of equals the one first in the item, then in the text.

    Each round hashes the unmarked strings of one length anew in both sequences, marks the
    tiles of that length whose words agree, and goes on with the next shorter length that
    still has a common string (found by halving: a common string holds shorter ones). A
    round takes time in proportion to the text, and there are as many as tile lengths.
    """
    text_left, item_left = Unmarked(text, text >= 0), Unmarked(item, np.ones(len(item), bool))
    longest = len(item)
    while longest >= n:
        text_left = narrowed(text_left, item_left, n)
        low, high = n - 1, min(longest, len(text_left.words))
        while low < high:
            middle = (low + high + 1) // 2
            if len(shared_strings(text_left, item_left, middle)[0]):
                low = middle
            else:
                high = middle - 1
        if (longest := low) < n:
            break
        place, hashed, own, key = shared_strings(text_left, item_left, longest)
        upto: dict[int, int] = {}  # by first place of a hash: those before are marked
        for p, lo, hi in zip(own.tolist(), np.searchsorted(hashed, key, "left").tolist(), np.searchsorted(hashed, key, "right").tolist()):
            if lo == hi or not item_left.is_free(p, longest):
                continue
            k = upto.get(lo, lo)
            while k < hi and not text_left.is_free(place[k], longest):
                k += 1
            upto[lo] = k
            wanted = item_left.words[p : p + longest]
            for d in place[k:hi]:
                if text_left.is_free(d, longest) and np.array_equal(text_left.words[d : d + longest], wanted):
                    text_left.mark(d, longest)
                    item_left.mark(p, longest)
                    break
        longest -= 1
    return int((~item_left.free).sum())


def leaks(index: ItemIndex, texts: Texts, word: np.ndarray, at: np.ndarray, percent: int) -> dict[int, list[tuple[int | None, float]]]:
    """Items that leaked into each row, with their coverage; hashes only choose what to look at, words decide."""
    out: dict[int, list[tuple[int | None, float]]] = {}
    for row, item, n, places in index.meetings(word, at):
        size = len(index.items[item])
        reach = np.zeros(size + 1, int)  # more than tiles can cover
        reach[places] += 1
        np.subtract.at(reach, np.minimum(places + n, size), 1)
        if 100 * (np.cumsum(reach[:size]) > 0).sum() < percent * size:
            continue
        covered = tiles_cover(*numbered(texts[row], plain_words(index.texts[item])), n)
        if 100 * covered >= percent * size:
            out.setdefault(row, []).append((index.ids[item], covered / size))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, percent: int = PERCENT, block_chars: int = 4_000_000) -> DataFrame:
    """docs with a column leaked: the items that each text holds, with their coverage; docs has doc_id, text and any other columns."""
    spark = docs.sparkSession
    small_batches(spark)
    items = pick(benchmark, "item_id", "text")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-chars // block_chars)
    out, parts = docs, []
    text_at, fields = docs.columns.index("text"), ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        index = spark.sparkContext.broadcast(ItemIndex(own.column("item_id").to_pylist(), own.column("text").to_pylist(), least))
        names = [*docs.columns, *(f"leaked_{i}" for i in range(b + 1))]

        def run(batches, index=index, names=names):
            for batch in batches:
                found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                for i, word, at in word_hashes(batch.column(text_at)):
                    texts = Texts(batch.column(text_at), i)
                    for row, hits in leaks(index.value, texts, word, at, percent).items():
                        found[i + row] = [{"item_id": x, "coverage": c} for x, c in hits]
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names)

        parts.append(f"leaked_{b}")
        out = out.mapInArrow(run, ", ".join([fields, *(f"{p} {HIT}" for p in parts)]))
    leaked = F.flatten(F.array(*parts)) if parts else F.array().cast(HIT)
    return out.select(*docs.columns, F.array_sort(leaked).alias("leaked"))


def contamination(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """doc_id, contaminated, n_items, items and the highest coverage; one row per input row."""
    found = find_leaks(pick(docs, "doc_id", "text"), benchmark, least, percent)
    return found.select(
        "doc_id",
        (F.size("leaked") > 0).alias("contaminated"),
        F.size("leaked").cast("long").alias("n_items"),
        F.transform("leaked", lambda x: x["item_id"]).alias("items"),
        F.coalesce(F.array_max(F.transform("leaked", lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """The documents that hold no benchmark item, unchanged."""
    docs = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    return find_leaks(docs, benchmark, least, percent).where(F.size("leaked") == 0).drop("leaked")
