"""Best-fit packing (operator 6): hierarchical residual packing.

Documents become token ids and a closing id; longer ones are cut into pieces of the
capacity. Full pieces are sequences of their own. The rest is packed in rounds:

* every partition packs its items by best fit, longest first, and emits the bins
  that are nearly full;
* underfull bins become items of the next round, whole, in fewer partitions
  (a tree whose tasks hold ``most`` items at most), until one round's items fit one
  partition, or a round no longer merges anything.

A task thus sees a bounded number of items, and only underfull bins move up.

Tokens are found piece by piece: the vocabulary's word pieces never span a blank,
so a text's ids are those of its pieces in order, and each worker keeps the ids of
pieces it has met. Chunks with characters beyond Latin-1 go through the tokenizer
itself. ``array("I")`` is little-endian on the machines Spark runs on here.

Cases: null text is empty and gives the closing id alone. Repeated rows are packed
each for itself. An empty table gives an empty result. A text of any length is cut
into pieces, none dropped. Ties: equal lengths are packed in the order in which a
partition holds them. No SQL: tokens and best fit have none; tests check every
token, place and length, and how full sequences are.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfmatch.llm.common import materialize, pick, small_batches

CAPACITY = 2048
CLOSE_ID = 0
#: Word pieces a worker remembers; when full it starts anew.
CACHE = 500_000
GAPS = str.maketrans({"\n": " ", "\t": " ", "\r": " "})
#: Text outside this range goes through the tokenizer whole, blank by blank.
UNSAFE = re.compile(r"[^\t\n\x0b\x0c\r\x20-\x7eÀ-ÖØ-öø-ÿ]|<\|")
#: The vocabulary's own rule for pieces, on lower-case text of that range. Fixed value.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces(dict):
    """Little-endian 32-bit ids of lower-case word pieces, found by the vocabulary's model on first use."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.model = tokenizer.model
        self.letters = byte_letters()

    def __missing__(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(self) >= CACHE:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


_pieces: dict[str, Pieces] = {}


def pieces_for(path: str) -> Pieces:
    """One cache for each worker and vocabulary file."""
    if path not in _pieces:
        from tokenizers import Tokenizer

        _pieces[path] = Pieces(Tokenizer.from_file(path))
    return _pieces[path]


def token_bytes(text: str | None, known: Pieces) -> bytes:
    """Ids of a text and the closing id."""
    text = text or ""
    if not UNSAFE.search(text):
        return b"".join(map(known.__getitem__, PIECE.findall(text.lower()))) + CLOSE_ID.to_bytes(4, "little")
    out = []
    for chunk in text.translate(GAPS).split(" "):
        if UNSAFE.search(chunk):
            out.append(array("I", known.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes())
        else:
            out += map(known.__getitem__, PIECE.findall(chunk.lower()))
    return b"".join(out) + CLOSE_ID.to_bytes(4, "little")


def pieces(docs: DataFrame, path: str, capacity: int, forget: bool = False) -> DataFrame:
    """pid (a number for the piece), doc_id, piece, start, length, ids_crc32 of every piece of docs(doc_id, text); forget: workers keep no word pieces beyond a task."""
    small_batches(docs.sparkSession)

    def run(batches):
        known = pieces_for(path)
        width = 4 * capacity
        for batch in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = token_bytes(text, known)
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    owner.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        if forget:
            known.clear()

    found = docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return found.select(F.monotonically_increasing_id().alias("pid"), "*")


class Bins:
    """Open bins by room left; the fullest bin that fits is found by one look at a bit set."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.members: list[list[int]] = []
        self.room: list[int] = []

    def add(self, item: int, length: int) -> None:
        fits = self.bits >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            bin_ = self.by_room[room].pop()
            if not self.by_room[room]:
                self.bits ^= 1 << room
        else:
            room, bin_ = self.capacity, len(self.members)
            self.members.append([])
            self.room.append(room)
        self.members[bin_].append(item)
        room -= length
        self.room[bin_] = room
        if room:
            if not self.by_room[room]:
                self.bits |= 1 << room
            self.by_room[room].append(bin_)


def best_fit(lengths: np.ndarray, capacity: int) -> Bins:
    """Best fit, longest first; equal lengths in the order given."""
    bins = Bins(capacity)
    for item in np.argsort(-lengths, kind="stable").tolist():
        bins.add(item, int(lengths[item]))
    return bins


BIN = "done boolean, bin long, length long, n_items long, items array<struct<pid:long,length:long>>"


def pack_round(items: DataFrame, level: int, capacity: int, slack: int, last: bool) -> DataFrame:
    """One round over items(length, items): bins, done where nearly full or where this round is the last."""

    def run(batches: Iterator[pa.RecordBatch]):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        lengths = table.column("length").to_numpy()
        parts = table.column("items").combine_chunks()
        at = parts.offsets.to_numpy()
        flat = parts.flatten()
        pid, own = flat.field("pid").to_numpy(), flat.field("length").to_numpy()
        bins = best_fit(lengths, capacity)
        base = (level << 56) | (TaskContext.get().partitionId() << 32)
        for lo in range(0, len(bins.members), 20_000):
            members = bins.members[lo : lo + 20_000]
            room = np.array(bins.room[lo : lo + 20_000], np.int64)
            order = [np.concatenate([np.arange(at[m], at[m + 1]) for m in ms]) - at[0] for ms in members]
            take = np.concatenate(order)
            ends = np.concatenate([[0], np.cumsum([len(o) for o in order])]).astype(np.int32)
            struct = pa.StructArray.from_arrays([pa.array(pid[take]), pa.array(own[take])], ["pid", "length"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((room <= slack) | last),
                    pa.array(base + lo + np.arange(len(members), dtype=np.int64)),
                    pa.array(capacity - room),
                    pa.array(np.array([len(m) for m in members], np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), struct),
                ],
                ["done", "bin", "length", "n_items", "items"],
            )

    return items.select("length", "items").mapInArrow(run, BIN)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, slack: int = 8, most: int = 200_000, fan_in: int = 8, forget: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = materialize(pieces(pick(docs, "doc_id", "text"), path, capacity, forget), "pieces")
    items = cut.where(F.col("length") < capacity).select("length", F.array(F.struct("pid", "length")).alias("items"))
    n = items.count()
    parts = max(1, -(-n // most))
    # the first round packs what each partition of the scan holds, as long as that is bounded
    items = items if items.rdd.getNumPartitions() >= parts else items.repartition(parts)
    parts = items.rdd.getNumPartitions()
    done, level = [], 1
    while True:
        last = parts == 1
        bins = materialize(pack_round(items, level, capacity, slack, last), "bins")
        done.append(bins.where("done").select("bin", "items"))
        if last:
            break
        left = bins.where("not done")
        now, before = left.count(), n
        if now == 0:
            break
        room_for = max(1, -(-now // most), -(-parts // fan_in))
        if now > 0.98 * before and room_for >= parts:  # more rounds would merge nothing
            done.append(left.select("bin", "items"))
            break
        n, parts, level = now, room_for, level + 1
        items = left.select("length", "items")
        items = items.coalesce(1) if parts == 1 else items.repartition(parts)
    bins = done[0]
    for d in done[1:]:
        bins = bins.union(d)
    placed = bins.select("bin", F.explode(with_offsets("items")).alias("p")).select(F.col("p.pid").alias("pid"), F.col("bin").alias("sequence_id"), F.col("p.offset").alias("offset"))
    full = cut.where(F.col("length") == capacity).select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = cut.join(placed.union(full), "pid")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def with_offsets(items: str):
    """Members of a bin with the place where each begins."""
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<pid:long,offset:long>>").alias("out"))
    return F.aggregate(
        items,
        empty,
        lambda a, x: F.struct((a["at"] + x["length"]).alias("at"), F.concat(a["out"], F.array(F.struct(x["pid"].alias("pid"), a["at"].alias("offset")))).alias("out")),
        lambda a: a["out"],
    )
