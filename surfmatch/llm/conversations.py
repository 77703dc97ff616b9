"""Conversation structure repair (operator 12): iterative-deepening A* over edits of turns.

Rows are sorted once by conversation and turn over all tasks and cut into blocks of
neighbours. Inside a block every conversation's stretch is searched depth first, edits
in ASCII order (Delete, Insert, Keep, Rerole), under a cost bound that rises to the
least value that was cut off; states that failed are remembered with the cost they had
left, so none is searched twice for less. The estimate of what is still to be paid
comes from a smaller pattern, with all states merged that wait for a user's turn. The first path that is accepted is the cheapest and, of those,
the ASCII-least.

A stretch at a block's edge may go on next door: it is searched from every state of
the role pattern to every other, and stretches are joined in order, first those of one
task's rows, then those of a conversation. Equal costs of one stretch never leave one
audit a prefix of another, so joining keeps the ASCII-least. No task holds more than
a block's rows; texts move twice, for the sort and for the streamed result.

``repair`` gives a report of each conversation and ``repaired_turns`` the mended rows,
in order; ``damage`` is the fixed damage that the query mends.

Cases: nulls of role and text count as one space, null conv_id is a conversation of
its own, null turns come first. Ties in turn go by role, then text. Repeated rows are
duplicates. A role without characters has no initial and cannot be kept. A text is read whole. An empty
table gives no rows; a conversation without rows costs nothing and has an empty audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfmatch.llm.common import materialize, pick, small_batches

#: Rows that one search sees at most.
BLOCK = 64
#: Bits of a sorted row's number that lie within one partition (Spark's own division).
WITHIN = 33
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of the role pattern: nothing yet, after the system turn, after a user's, after an assistant's.
STATES = "-sua"
#: Where the pattern allows a role's initial: state and initial to state.
STEPS = {("-", "s"): "s", ("-", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
#: The role that is missing in a state.
DUE = {"-": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
#: Where a conversation may end.
ENDS = "-a"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32(conv_id:turn) modulo 20 chooses for each row."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = pick(conversations, "conv_id", "turn", "role", "text").withColumn("kind", F.crc32(key) % 20)
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = rows.where("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def ordered(turns: DataFrame) -> DataFrame:
    """turns sorted by conversation and turn over all tasks, with place (a number that rises in that order)."""
    rows = pick(turns, "conv_id", "turn", "role", "text")
    rows = rows.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    rows = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return materialize(rows.withColumn("place", F.monotonically_increasing_id()), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, place, initial, fault (b, d, t or empty) of ordered rows; only digests of texts move."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    plain = rows.select("conv_id", "place", F.substring("role", 1, 1).alias("initial"), F.when(blank, "b").when(cut, "t").otherwise("").alias("fault"), same.alias("same"))
    first = plain.groupBy("conv_id", "same").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = F.when(F.col("fault") == "b", "b").when(F.col("first").isNull(), "d").otherwise(F.col("fault"))
    return plain.join(first, "place", "left").select("conv_id", "place", "initial", fault.alias("fault"))


@lru_cache(4096)
def moves(initial: str, fault: str) -> dict[str, tuple[tuple[int, str, int, str], ...]]:
    """What may be done in each state before a row: cost, edit, rows used and next state, in ASCII order."""
    out = {}
    for state in STATES:
        found = [(DELETE, "D", 1, state), (INSERT, "I", 0, DUE[state])]
        if fault not in ("b", "d"):
            more = TRUNCATED if fault else 0
            if (state, initial) in STEPS:
                found.append((KEEP + more, "K", 1, STEPS[state, initial]))
            found.append((REROLE + more, "R", 1, DUE[state]))
        out[state] = tuple(found)
    return out


#: What may be done after the last row.
AFTER = {state: ((INSERT, "I", 0, DUE[state]),) for state in STATES}
NEVER = 1 << 60


def estimates(rows: list[tuple[str, str]], ends: str) -> list[dict[str, int]]:
    """Before each row and after the last, what must be paid at least from each state to one of ends.

    Ends after a turn are looked for in a smaller pattern, with all states merged that
    wait for a user's turn. Before any turn, or after the system's alone, all else must go.
    """
    if ends in ("-", "s"):
        rest, system = 0, False
        out = [{"-": 0, "s": NEVER, "u": NEVER, "a": NEVER} if ends == "-" else {"-": NEVER, "s": 0, "u": NEVER, "a": NEVER}]
        for initial, fault in reversed(rows):
            rest, system = rest + DELETE, system or initial == "s" and fault not in ("b", "d")
            out.append({**out[0], "-": rest} if ends == "-" else {**out[0], "-": rest - DELETE if system else NEVER, "s": rest})
        return out[::-1]
    waiting, talking = (INSERT, 0) if ends == "u" else (0, INSERT)
    out = [(waiting, talking)]
    for initial, fault in reversed(rows):
        low = [DELETE + waiting, DELETE + talking]
        if fault not in ("b", "d"):
            more = TRUNCATED if fault else 0
            low[0] = min(low[0], more + talking + (KEEP if initial == "u" else REROLE), more + waiting + KEEP if initial == "s" else NEVER)
            low[1] = min(low[1], more + waiting + (KEEP if initial == "a" else REROLE))
        waiting, talking = min(low[0], INSERT + low[1]), min(low[1], INSERT + low[0])
        out.append((waiting, talking))
    return [{"-": w, "s": w, "a": w, "u": t} for w, t in reversed(out)]


def search(rows: list[tuple[str, str]], start: str, ends: str, least: list[dict[str, int]] | None = None) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits of rows (initial, fault) from a state to one of ends; None where there are none."""
    least, n = least or estimates(rows, ends), len(rows)
    bound = least[0][start]
    if bound >= NEVER:
        return None
    ways = [moves(i, f) for i, f in rows] + [AFTER]
    while True:
        failed: dict[tuple[int, str], int] = {}  # the most cost left with which a state failed
        over = []  # totals that were cut off
        path, stack = [], [(0, start, bound, iter(ways[0][start]))]
        while stack:
            at, state, left, rest_of_ways = stack[-1]
            for cost, edit, used, then in rest_of_ways:
                to, rest = at + used, left - cost
                need = least[to][then]
                if rest < need:
                    over.append(bound + need - rest)
                elif failed.get((to, then), -1) < rest:
                    path.append(edit)
                    if to == n and then in ends:
                        return bound - rest, "".join(path)
                    stack.append((to, then, rest, iter(ways[to][then])))
                    break
            else:
                stack.pop()
                failed[at, state] = left
                if path:
                    path.pop()
        bound = min(over)


RUN = "conv_id long, place long, whole boolean, first string, last string, blank long, duplicate long, truncated long, illegal long, ways array<struct<start:string,end:string,cost:long,audit:string>>"

RUN_COLUMNS = ("conv_id", "place", "whole", "first", "last", "blank", "duplicate", "truncated", "illegal")

def broken(before: str, after: str) -> int:
    return before + after not in ("su", "ua", "au")


def run_of(conv_id, place: int, whole: bool, rows: list[tuple[str, str]]) -> dict:
    """One conversation's stretch of a block: its counts, and its cheapest edits between every two states, or to its end."""
    marks = [f for _, f in rows]
    ways = []
    for end in [ENDS] if whole else STATES:
        least = estimates(rows, end)
        for start in "-" if whole else STATES:
            found = search(rows, start, end, least)
            if found:
                ways.append({"start": start, "end": end, "cost": found[0], "audit": found[1]})
    counts = {name: marks.count(name[0]) for name in ("blank", "duplicate", "truncated")}
    illegal = sum(broken(a[0], b[0]) for a, b in zip(rows, rows[1:]))
    return {"conv_id": conv_id, "place": place, "whole": whole, "first": rows[0][0], "last": rows[-1][0], **counts, "illegal": illegal, "ways": ways}


def run_schema() -> pa.Schema:
    way = pa.struct([("start", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), *[pa.int64()] * 4]
    return pa.schema([*zip(RUN_COLUMNS, kinds), ("ways", pa.list_(way))])


def runs(flagged: DataFrame, block: int) -> DataFrame:
    """The stretches of every block of neighbours in faults(); whole where both neighbours belong to other conversations."""
    number = F.expr(f"(place >> {WITHIN}) << {WITHIN}") + F.expr(f"(place & {(1 << WITHIN) - 1}) div {block} * {block}")
    held = flagged.groupBy(number.alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "conv_id", "initial", "fault"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for rows in batch.column(1).to_pylist():
                at = [0, *(i for i in range(1, len(rows)) if rows[i]["conv_id"] != rows[i - 1]["conv_id"]), len(rows)]
                for lo, hi in zip(at, at[1:]):
                    whole = 0 < lo and hi < len(rows)
                    out.append(run_of(rows[lo]["conv_id"], rows[lo]["place"], whole, [(r["initial"], r["fault"]) for r in rows[lo:hi]]))
            yield pa.RecordBatch.from_pylist(out, run_schema())

    return held.mapInArrow(run, RUN)


def one_run(rows: list[dict]) -> dict:
    """Neighbouring stretches of one conversation, in order, as one."""
    if len(rows) == 1:
        return rows[0]
    best: dict[tuple[str, str], tuple[int, str]] = {(s, s): (0, "") for s in STATES}
    for row in rows:
        found: dict[tuple[str, str], tuple[int, str]] = {}
        for (start, mid), (cost, audit) in best.items():
            for way in row["ways"]:
                if way["start"] == mid:
                    total = (cost + way["cost"], audit + way["audit"])
                    if (start, way["end"]) not in found or total < found[start, way["end"]]:
                        found[start, way["end"]] = total
        best = found
    ways = [{"start": s, "end": e, "cost": c, "audit": a} for (s, e), (c, a) in best.items()]
    counts = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
    counts["illegal"] += sum(broken(a["last"], b["first"]) for a, b in zip(rows, rows[1:]))
    return {**rows[0], **counts, "last": rows[-1]["last"], "ways": ways}


def joined(edge: DataFrame, *key) -> DataFrame:
    """Stretches alike in key, which are neighbours, as one."""
    columns = ["place", *(c for c in (*RUN_COLUMNS, "ways") if c != "place")]
    held = edge.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows")).select("rows")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one_run(rows) for rows in batch.column(0).to_pylist()], run_schema())

    return held.mapInArrow(run, RUN)


def cheapest() -> Column:
    """cost and audit of the cheapest way from the first state to an end."""
    ends = F.filter("ways", lambda w: (w["start"] == "-") & w["end"].isin("-", "a", ENDS))
    return F.array_min(F.transform(ends, lambda w: F.struct(w["cost"].alias("cost"), w["audit"].alias("audit"))))


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation of ordered rows."""
    small_batches(rows.sparkSession)
    found = materialize(runs(faults(rows), block), "stretches")
    edge = joined(found.where("not whole"), "conv_id", F.shiftright("place", WITHIN))
    mended = found.where("whole").union(joined(edge, "conv_id")).withColumn("best", cheapest())
    wide = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.countDistinct("turn")
    gaps = rows.groupBy("conv_id").agg(F.coalesce(wide, F.lit(0)).cast("long").alias("gaps"))
    counts = ("blank", "duplicate", "truncated", "illegal", "cost", "audit")
    own = mended.select("conv_id", F.lit(None).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))
    none = [F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in counts]
    return own.union(gaps.select("conv_id", "gaps", *none)).groupBy("conv_id").agg(*(F.max(c).alias(c) for c in ("gaps", *counts)))


def repaired_turns(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """conv_id, role, text of the mended conversations: partitioned by conversation, each in order and unbroken."""
    sheet = reports.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    both = rows.select("conv_id", "place", "role", "text").union(sheet).repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def run(batches: Iterator[pa.RecordBatch]):
        audit, at, state = "", 0, "-"
        for batch in batches:
            ids, roles, texts = [], [], []

            def emit(conv_id, role: str, text: str) -> None:
                ids.append(conv_id)
                roles.append(role)
                texts.append(text)

            def insert(conv_id) -> None:
                nonlocal at, state
                while audit[at : at + 1] == "I":
                    at, state = at + 1, DUE[state]
                    emit(conv_id, ROLES[state], "")

            for conv_id, place, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if place < 0:
                    audit, at, state = text, 0, "-"
                else:
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        state = STEPS[state, role[0]]
                        emit(conv_id, role, text)
                    elif edit == "R":
                        state = DUE[state]
                        emit(conv_id, ROLES[state], text)
                insert(conv_id)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], ["conv_id", "role", "text"])

    return both.mapInArrow(run, "conv_id long, role string, text string")


def text_digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``role:text`` lines, streamed; turns as repaired_turns gives them."""

    def run(batches: Iterator[pa.RecordBatch]):
        whose, digest = None, None
        for batch in batches:
            ids, found = [], []
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if digest is None or conv_id != whose:
                    if digest is not None:
                        ids.append(whose)
                        found.append(digest.hexdigest())
                    whose, digest = conv_id, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([whose], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return turns.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """The report and the digest of every conversation after the fixed damage; those that lose all rows included."""
    rows = ordered(damage(conversations))
    reports = materialize(repair(rows), "reports")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    parts = reports.withColumn("repaired_sha256", F.lit(None).cast("string"))
    digests = text_digests(repaired_turns(rows, reports))
    parts = parts.unionByName(digests, allowMissingColumns=True).unionByName(pick(conversations, "conv_id").distinct(), allowMissingColumns=True)
    parts = parts.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in (*counts, "repaired_sha256")))
    blank = {**{c: F.lit(0).cast("long") for c in counts[:-1]}, "audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return parts.select("conv_id", *(F.coalesce(c, v).alias(c) for c, v in blank.items()))
