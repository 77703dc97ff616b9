"""BPE encoding and decoding (operator 13): content-defined chunks, encoded once and joined exactly.

A rolling hash of 32 bytes cuts every text where its top bits are nought, so equal
passages are cut alike wherever they stand. Chunks are counted over all documents by
a 128-bit digest. Those that occur again go into a dictionary and are encoded once,
for all documents; what lies between them is encoded with its document.

A text's ids are then joined from left to right. At each join the ids next to it may
be wrong, as a cut may fall inside a word: a window from a blank before the join to a
blank after it is encoded anew, and must give, for its first and last words, the ids
that the parts have there. Where it does not, the window is doubled, up to the whole
text; so the result is always that of encoding the text whole. A blank must end a
token (vocabularies that drop white space); the check of the window's edges would
catch one where it does not.

Documents without a repeated chunk never move: they are told by a Bloom filter of the
repeated digests, of fixed size (``filter_bits``, 8 MB). A filter that is too small for the
data sends more documents through the exchange, with the same result. The dictionary
is joined by shuffle, never broadcast; texts that hold repeated chunks move once.

Cases: null text is empty and gives no ids; repeated rows are encoded each for itself,
from shared chunks; an empty table gives no rows; one text of any length is cut like
any other; a text without blanks or without cuts is one window or one chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfmatch.llm.bytehash import BLANK, U, batches_of_bytes
from surfmatch.llm.common import materialize, pick, small_batches
from surfmatch.llm.packing import pieces_for, token_bytes

#: Bytes that the rolling hash sees, top bits of it that must be nought, and least length of a chunk.
WINDOW, CUT_BITS, LEAST = 32, 10, 256
FILTER_BITS = 26
#: Words on either side of a join that its window holds at first.
MARGIN = 2

CODED = "doc_id long, ids binary"
CHUNKS = "array<struct<start:long,size:long,high:long,low:long>>"


#: A random number for each byte; the hash of a window adds them up, shifted by their age.
GEAR = np.random.default_rng(20240911).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray, stretch: int = 1 << 15) -> np.ndarray:
    """Where the rolling hash allows a cut, never inside a character; looked at by stretches that a processor's cache holds."""
    found = []
    for start in range(0, len(data) - WINDOW, stretch):
        value, age = GEAR[data[start : start + stretch + WINDOW - 1]], 1
        while age < WINDOW:  # from windows of age bytes to those of twice as many
            value = value[age:] + (value[:-age] << np.uint32(age))
            age *= 2
        found.append(np.flatnonzero(value < 1 << (32 - CUT_BITS)) + (start + WINDOW))
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


def chunks_of(column: pa.Array) -> Iterator[tuple[int, bytes, list[int], np.ndarray]]:
    """Row, bytes, chunk bounds (from 0 to the length) and chunk digests (two longs each) of every text."""
    for i, j, data, offsets in batches_of_bytes(column):
        found, whole = cuts(data), data.tobytes()
        for r in range(j - i):
            lo, hi = int(offsets[r]), int(offsets[r + 1])
            bounds = [lo]
            for at in found[np.searchsorted(found, lo + LEAST) : np.searchsorted(found, hi)].tolist():
                if at - bounds[-1] >= LEAST and at - lo >= WINDOW:
                    bounds.append(at)
            bounds.append(hi)
            digests = b"".join(hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(bounds, bounds[1:]))
            yield i + r, whole[lo:hi], [b - lo for b in bounds], np.frombuffer(digests, np.int64).reshape(-1, 2)


def digest_counts(texts: DataFrame) -> DataFrame:
    """high, low and n of the chunk digests of texts(text)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [digests for _, text, _, digests in chunks_of(batch.column(0)) if text]
            if found:
                keys, n = np.unique(np.concatenate(found), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n)], ["high", "low", "n"])

    return texts.mapInArrow(run, "high long, low long, n long").groupBy("high", "low").agg(F.sum("n").alias("n"))


def repeated_filter(counts: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter, of 2**bits bits, of the digests that occur again: four places for each."""
    halves = [F.col("high"), F.shiftrightunsigned("high", 32), F.col("low"), F.shiftrightunsigned("low", 32)]
    places = F.explode(F.array(*(h.bitwiseAND(F.lit((1 << bits) - 1).cast("long")) for h in halves)))
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = counts.where("n > 1").select(places.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    found = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def among(words: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Which digests the filter holds."""
    places = digests.view(np.uint32).astype(np.uint64) & U(len(words) * 64 - 1)
    return ((words[places >> U(6)] >> (places & U(63))) & U(1)).all(axis=1)


def spliced(data: bytes, parts: list[tuple[int, bytes | None]], encode: Callable[[bytes], bytes]) -> bytes:
    """Ids of data from parts (end, ids of the bytes since the last part, None where they are still to be found)."""
    blank = BLANK[np.frombuffer(data, np.uint8)]
    breaks = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    out, start = bytearray(), 0
    for end, ids in parts:
        ids = encode(data[start:end]) if ids is None else ids
        margin, near = MARGIN, np.searchsorted(breaks, start)
        after = np.searchsorted(breaks, start, "right")
        while start:
            a = int(breaks[near - margin]) if near >= margin else 0
            b = int(breaks[after + margin - 1]) if after + margin - 1 < len(breaks) else end
            b = min(b, end)
            left, right, window = encode(data[a:start]), encode(data[start:b]), encode(data[a:b])
            whole = a == 0 and b == end
            if not whole:
                first = encode(data[a : int(breaks[near - margin + 1])]) if a and margin > 1 else b""
                last = encode(data[int(breaks[after + margin - 2]) : b]) if b < end and margin > 1 else b""
                agreed = out.endswith(left) and ids.startswith(right) and window.startswith(first) and left.startswith(first) and window.endswith(last) and right.endswith(last)
            if whole or agreed:
                del out[len(out) - len(left) :]
                if a == 0:  # nothing before the window
                    out.clear()
                out += window
                ids = ids[len(right) :] if b < end else b""
                break
            margin *= 2
        out += ids
        start = end
    return bytes(out)


def encoder(path: str) -> Callable[[bytes], bytes]:
    """Ids of UTF-8 bytes, little-endian and 32 bits each, by the vocabulary of path."""
    known = pieces_for(path)
    return lambda data: token_bytes(data.decode(), known)[:-4]


def coded(names: pa.Array, ids: Iterator[bytes], path: str, with_text: bool, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """doc_id and ids, and what they decode to if asked for, in batches of some bytes."""
    held, texts, size, start = [], [], 0, 0
    tokenizer = pieces_for(path).tokenizer

    def batch() -> pa.RecordBatch:
        columns = [names.slice(start, len(held)), pa.array(held, pa.binary())] + ([pa.array(texts, pa.string())] if with_text else [])
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"][: len(columns)])

    for one in ids:
        held.append(one)
        if with_text:
            texts.append(tokenizer.decode(np.frombuffer(one, "<u4").tolist(), skip_special_tokens=False))
        size += len(one)
        if size >= most:
            yield batch()
            start += len(held)
            held, texts, size = [], [], 0
    yield batch()


def encode(docs: DataFrame, path: str, filter_bits: int = FILTER_BITS, with_text: bool = False) -> DataFrame:
    """doc_id and ids (binary: 32 bits each, little-endian) of every row of docs(doc_id, text); with_text adds the text that the ids decode to, found by the same worker."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = pick(docs, "doc_id", "text")
    repeated = spark.sparkContext.broadcast(repeated_filter(digest_counts(docs.select("text")), filter_bits))

    def alone(batches: Iterator[pa.RecordBatch]):
        of = encoder(path)
        for batch in batches:
            rows, texts = [], []
            for row, text, _, digests in chunks_of(batch.column(1)):
                if not (text and among(repeated.value, digests).any()):
                    rows.append(row)
                    texts.append(text)
            yield from coded(batch.column(0).take(pa.array(rows, pa.int64())), map(of, texts), path, with_text)

    def sharing(batches: Iterator[pa.RecordBatch]):
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "size", "high", "low")]))
        for batch in batches:
            rows, chunks = [], []
            for row, text, bounds, digests in chunks_of(batch.column(1)):
                hit = np.flatnonzero(among(repeated.value, digests)) if text else ()
                if len(hit):
                    rows.append(row)
                    chunks.append([{"start": bounds[k], "size": bounds[k + 1] - bounds[k], "high": int(digests[k, 0]), "low": int(digests[k, 1])} for k in hit])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(chunks, kind)], ["doc_id", "text", "chunks"])

    mixed = docs.mapInArrow(sharing, f"doc_id long, text string, chunks {CHUNKS}")
    mixed = materialize(mixed.withColumn("mid", F.monotonically_increasing_id()), "sharing")
    return docs.mapInArrow(alone, CODED + ", text string" * with_text).union(from_dictionary(mixed, path, with_text))


def dictionary(mixed: DataFrame, path: str) -> DataFrame:
    """high, low and ids of every chunk named in mixed(text, chunks), each encoded once."""

    def run(batches: Iterator[pa.RecordBatch]):
        of = encoder(path)
        for batch in batches:
            ids = pa.array([of(t) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], ["high", "low", "ids"])

    data = F.col("text").cast("binary")
    own = F.transform("chunks", lambda c: F.struct(c["high"].alias("high"), c["low"].alias("low"), F.substr(data, (c["start"] + 1).cast("int"), c["size"].cast("int")).alias("chunk")))
    return mixed.select(F.inline(own)).groupBy("high", "low").agg(F.first("chunk").alias("chunk")).mapInArrow(run, "high long, low long, ids binary")


def from_dictionary(mixed: DataFrame, path: str, with_text: bool) -> DataFrame:
    """doc_id and ids of mixed(mid, doc_id, text, chunks)."""

    def run(batches: Iterator[pa.RecordBatch]):
        of = encoder(path)

        def ids(text: str, shared: list[dict]) -> bytes:
            data, parts, at = text.encode(), [], 0
            for c in shared:
                if c["start"] > at:
                    parts.append((c["start"], None))
                at = c["start"] + c["size"]
                parts.append((at, c["ids"]))
            if at < len(data):
                parts.append((len(data), None))
            return spliced(data, parts, of)

        for batch in batches:
            yield from coded(batch.column(0), (ids(batch.column(1)[i].as_py(), batch.column(2)[i].as_py()) for i in range(batch.num_rows)), path, with_text)

    refs = mixed.select("mid", F.inline("chunks")).join(materialize(dictionary(mixed, path), "dictionary"), ["high", "low"])
    found = refs.groupBy("mid").agg(F.array_sort(F.collect_list(F.struct("start", "size", "ids"))).alias("shared"))
    return mixed.select("mid", "doc_id", "text").join(found, "mid").select("doc_id", "text", "shared").mapInArrow(run, CODED + ", text string" * with_text)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with text, what the vocabulary reads in its ids, in their place."""
    others = [f for f in encoded.schema.fields if f.name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]):
        tokenizer = pieces_for(path).tokenizer
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").tolist() for x in batch.column("ids").to_pylist()]
            text = pa.array(tokenizer.decode_batch(ids, skip_special_tokens=False), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), text], [*(f.name for f in others), "text"])

    return encoded.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in others), "text string"]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    n = (F.octet_length("ids") / 4).cast("long")
    return encode(docs, path, with_text=True).select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
