"""Pairs scored and counted in one task: what leaves it are counts of scores, not pairs.

Two blocks of marks meet as in ``pairs.score_blocks``. Their scores are made in tiles that
fit a core's cache, rounded as Spark rounds, and added to counts of each score, label
and group. Work is that of all pairs; what is held and moved is not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfmatch.operators import pairs

#: Pairs of a tile, pairs counted at once, marks of a block, and counts that a task holds in one array; beyond them it counts tile by tile.
TILE, HELD, BLOCK_ROWS, DENSE = 1 << 17, 1 << 20, 16_384, 4_000_000
#: Whole numbers that no rounded score has: they stand for a missing one and for those that are not finite.
MISSING, LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max


def half_up(values: np.ndarray, digits: int) -> np.ndarray:
    """values times 10 ** digits as whole numbers, rounded as Spark rounds doubles: by their shortest decimal text, halves away from zero. Values are finite."""
    scale = 10.0**digits
    rest = values * scale
    near = np.rint(rest)
    most = float(max(near.max(initial=0.0), -near.min(initial=0.0)))
    if most >= 2.0**62:
        raise OverflowError(f"scores up to {most / scale:g} cannot be counted at {digits} digits")
    whole = near.astype(np.int64)
    rest -= near
    np.abs(rest, out=rest)
    # where no half is near, the nearest whole number is it
    half = 0.5 - 1e-9 - most * 1e-15
    if rest.max(initial=0.0) > half or most >= 2.0**52:
        exact = np.ones(rest.shape, bool) if most >= 2.0**52 else rest > half
        asked, at = np.unique(values[exact], return_inverse=True)
        unit = Decimal(1).scaleb(-digits)
        whole[exact] = np.array([int(Decimal(repr(x)).quantize(unit, ROUND_HALF_UP).scaleb(digits)) for x in asked.tolist()], np.int64)[at]
    return whole


def rounded_scores(values: np.ndarray, source_a: pa.Array, source_b: pa.Array, shift: float, digits: int) -> np.ndarray:
    """Scores of listed pairs as score_counts has them: shifted where sources are the same, rounded, not a number where a source is null."""
    values = values + shift * pa.compute.equal(source_a, source_b).cast(pa.float64()).to_numpy(zero_copy_only=False)
    fine = np.isfinite(values)
    values[fine] = half_up(values[fine], digits) / 10.0**digits
    return values


class Tally:
    """How often each (group, place) occurs, group from 0 to ``groups`` - 1 and place any whole number."""

    def __init__(self, groups: int):
        self.groups, self.low, self.width = groups, 0, 0
        self.dense = np.zeros((groups, 0), np.int64)
        self.first = np.zeros(groups, np.int64)  # where place 0 of a group would lie in the array
        self.codes, self.filled = np.empty(HELD, np.int64), 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, group: np.ndarray, place: np.ndarray) -> None:
        if not place.size:
            return
        low, high = int(place.min()), int(place.max())
        if self.width:
            low, high = min(low, self.low), max(high, self.low + self.width - 1)
        if self.groups * (high - low + 1) > DENSE:
            self.sparse(group, place)
            return
        if low < self.low or high >= self.low + self.width:
            self.flush()
            wider = np.zeros((self.groups, high - low + 1), np.int64)
            wider[:, self.low - low : self.low - low + self.width] = self.dense
            self.dense, self.low, self.width = wider, low, high - low + 1
            self.first = np.arange(self.groups) * self.width - low
        if self.filled + place.size > HELD:
            self.flush()
        code = self.first[group]
        code += place
        if place.size > HELD:
            self.count(code.ravel())
        else:
            self.codes[self.filled : self.filled + place.size] = code.ravel()
            self.filled += place.size

    def flush(self) -> None:
        if self.filled:
            self.count(self.codes[: self.filled])
            self.filled = 0

    def count(self, codes: np.ndarray) -> None:
        self.dense += np.bincount(codes, minlength=self.dense.size).reshape(self.dense.shape)

    def sparse(self, group: np.ndarray, place: np.ndarray) -> None:
        places, at = np.unique(place, return_inverse=True)
        code, n = np.unique(group.ravel() * np.int64(len(places)) + at.ravel(), return_counts=True)
        self.parts.append((code // len(places), places[code % len(places)], n))

    def taken(self, last: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """group, place, n of what is not kept in the array, and of that too at last; a pair of group and place may come in several parts."""
        yield from self.parts
        self.parts.clear()
        if last:
            self.flush()
            group, at = np.nonzero(self.dense)
            yield group, at + self.low, self.dense[group, at]


def sourced(marks: DataFrame, *more: str) -> DataFrame:
    """mark, signature and source of every mark, as ``pairs.labelled`` joins them: rows of a repeated mark meet all its sources."""
    return marks.select("mark", "signature", *more).join(marks.select("mark", "source"), "mark")


class Block:
    """The pairs of a task's two blocks, scored tile by tile; sources are codes of ``names``, ``at`` the rows of the tile at hand."""

    def __init__(self, table: pa.Table, score: Callable[[np.ndarray, np.ndarray], np.ndarray], shift: float):
        self.score, self.shift = score, shift
        self.mark, self.matrix = table.column("mark").to_numpy(), pairs.matrix_of(table.column("signature"))
        found = table.column("source").combine_chunks().dictionary_encode("encode")
        self.own, self.names = found.indices.to_numpy().astype(np.int64), found.dictionary
        left, right, self.same = pairs.sides(table)
        self.left, self.right = (x[np.argsort(self.mark[x], kind="stable")] for x in (left, right))

    def tiles(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Marks and source codes of either side as a column and a row, labels (2 where a source is null), scores (not a number where one is missing), and which pairs count, None for all."""
        mark, unknown = self.mark, self.names.is_null().to_numpy(zero_copy_only=False)
        high = max(256, TILE // max(len(self.right), 1))
        for at in range(0, len(self.left), high):
            i = self.left[at : at + high]
            wide = max(1, TILE // len(i))
            for to in range(at if self.same else 0, len(self.right), wide):  # of one block, pairs below the diagonal are those above it
                j = self.right[to : to + wide]
                a, b, x, y = mark[i][:, None], mark[j][None, :], self.own[i][:, None], self.own[j][None, :]
                values, label = self.score(self.matrix[i], self.matrix[j]), (x == y).astype(np.int64)
                values += self.shift * label
                if unknown.any():
                    none = unknown[x] | unknown[y]
                    label[none], values[none] = 2, np.nan
                self.at = i, j
                yield a, b, x, y, label, values, a < b if self.same and not mark[i[-1]] < mark[j[0]] else None


def score_counts(
    marks: DataFrame,
    score: Callable[[np.ndarray, np.ndarray], np.ndarray],
    by: tuple[str, ...] = (),
    shift: float = 0.0,
    digits: int = 3,
    code: tuple[str, Callable[[np.ndarray, np.ndarray], np.ndarray], int] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """by (of source_a, source_b), label, score and n: how many unordered pairs of marks(mark, source, signature) have each score,
    which is that of score_blocks, plus ``shift`` for one source, rounded to ``digits``.

    source_a is the lesser mark's. Label is null where a source is, score where label or a signature is. ``code``: the name
    of a further whole number of a pair, from the marks of either side, and how many values from 0 on it has.
    """
    placed = pairs.block_pairs(sourced(marks).select("mark", "source", "signature"), block_rows)
    kinds = dict(marks.dtypes)
    schema = ", ".join([*(f"{c} {kinds['source']}" for c in by), *([f"{code[0]} int"] if code else []), "label int, score double, n long"])
    order = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(pa.Table.from_batches(list(batches)), score, shift)
        names, size = block.names, len(block.names)
        # a group is a code, the sources in by, and one of the labels 0, 1 and none
        widths = [size if c in by else 1 for c in ("source_a", "source_b")]
        tally = Tally((code[2] if code else 1) * widths[0] * widths[1] * 3)

        def counted(part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            group, place, n = part
            label, rest = group % 3, group // 3
            columns = {"label": pa.array(label.astype(np.int32), mask=label == 2)}
            for c, width in zip(("source_a", "source_b"), widths):
                columns[c] = names.take(pa.array(rest % width))
                rest = rest // width
            value = place / 10.0**digits
            value[place == MOST], value[place == LEAST] = np.inf, -np.inf
            columns |= {"score": pa.array(value, mask=place == MISSING), "n": pa.array(n)} | ({code[0]: pa.array(rest.astype(np.int32))} if code else {})
            return pa.RecordBatch.from_arrays([columns[c] for c in order], order)

        for a, b, x, y, label, values, keep in block.tiles():
            group = label
            if by:
                swap = b < a
                for c, first, second, step in (("source_a", x, y, 3), ("source_b", y, x, 3 * widths[0])):
                    if c in by:
                        group = group + step * (np.where(swap, second, first) if swap.any() else first)
            if code:
                group = group + 3 * widths[0] * widths[1] * code[1](a, b)
            if keep is not None:
                group, values = group[keep], values[keep]
            fine = np.isfinite(values)
            if fine.all():
                tally.add(group, half_up(values, digits))
            else:
                tally.add(group[fine], half_up(values[fine], digits))
                odd = values[~fine]
                tally.sparse(group[~fine], np.where(np.isnan(odd), MISSING, np.where(odd > 0, MOST, LEAST)))
            yield from map(counted, tally.taken())
        yield from map(counted, tally.taken(True))

    found = placed.groupBy("bi", "bj").applyInArrow(run, schema)
    return found.groupBy(*[c for c in found.columns if c != "n"]).agg(F.sum("n").alias("n"))


def hardest_in_blocks(
    marks: DataFrame,
    score: Callable[[np.ndarray, np.ndarray], np.ndarray],
    most: int,
    shift: float = 0.0,
    digits: int = 3,
    wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """mark_a, mark_b, source_a, source_b, label, score, as score_counts has them: of every two blocks the pairs that ``pairs.hardest``
    may ask for, the first ``most`` of each source_a and label, of pairs that are ``wanted`` by the lesser and the larger mark."""
    placed = pairs.block_pairs(sourced(marks).select("mark", "source", "signature"), block_rows)
    kinds = dict(marks.dtypes)
    schema = f"mark_a {kinds['mark']}, mark_b {kinds['mark']}, source_a {kinds['source']}, source_b {kinds['source']}, label int, score double"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(pa.Table.from_batches(list(batches)), score, shift)
        # columns: group (source_a and label), place in the order of scores (missing ones first), marks, sources
        held = np.zeros((6, 0), np.int64)
        last = np.full(3 * len(block.names), MOST)  # the place of each group's last one, once it has ``most``
        for a, b, x, y, label, values, keep in block.tiles():
            group = 3 * np.where(b < a, y, x) + label
            missing = np.isnan(values)
            place = half_up(np.where(missing, 0.0, values) if missing.any() else values, digits)
            np.negative(place, out=place, where=label != 1)
            if missing.any():
                place[missing] = MISSING
            may = place <= last[group]
            if keep is not None:
                may &= keep
            if wanted:
                may &= wanted(np.minimum(a, b), np.maximum(a, b))
            group, place, at = group[may], place[may], np.nonzero(may)
            i, j = (rows[k] for rows, k in zip(block.at, at))
            swap = block.mark[j] < block.mark[i]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            held = np.concatenate([held, np.stack([group, place, block.mark[i], block.mark[j], i, j])], 1)
            held = held[:, np.lexsort(held[3::-1])]
            start = np.flatnonzero(np.diff(held[0], prepend=-1))
            rank = np.arange(held.shape[1]) - np.repeat(start, np.diff(start, append=held.shape[1]))
            held = held[:, rank < most]
            full = held[:, rank[rank < most] == most - 1]
            last[full[0]] = full[1]
        group, place, a, b, i, j = held
        label, value = group % 3, np.where(group % 3 == 1, place, -place) / 10.0**digits
        sources = [block.names.take(pa.array(block.own[k])) for k in (i, j)]
        columns = [pa.array(a), pa.array(b), *sources, pa.array(label.astype(np.int32), mask=label == 2), pa.array(value, mask=place == MISSING)]
        yield pa.RecordBatch.from_arrays(columns, names)

    return placed.groupBy("bi", "bj").applyInArrow(run, schema)
