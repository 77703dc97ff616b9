"""Operators 11, 12 and 13 against brute force, on awkward cases."""

import hashlib
import random
import re
import zlib
from array import array

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from surfmatch.llm import bpe, conversations, merkle
from surfmatch.llm.common import pick
from surfmatch.llm.queries import vocabulary
from tests.llm import cases

CLASHING = ("TEXT", "name", "tree", "version", "digest", "at", "place", "kind", "copies", "initial", "fault", "same", "ids", "mid", "chunks", "high")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def crowded(df):
    """df with columns whose names operators use themselves."""
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING if c not in df.columns))


# ---------------------------------------------------------------- 11


def node(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def folded(nodes):
    """Root, and for each leaf its siblings as (on the left, digest), None where it has none."""
    sets, paths = [[i] for i in range(len(nodes))], [[] for _ in nodes]
    while len(nodes) > 1:
        for i in range(0, len(nodes), 2):
            run = nodes[i : i + 2]
            for j in range(len(run)):
                for leaf in sets[i + j]:
                    paths[leaf].append((j == 1, run[1 - j]) if len(run) == 2 else (False, ""))
        sets = [sum(sets[i : i + 2], []) for i in range(0, len(nodes), 2)]
        nodes = [node(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def manifest_of(rows):
    """Brute force of rows (doc_id, source, lang, n_chars, text)."""

    def leaf_of(*row):
        return node(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r))) for lang in order}
    inner = {lang: folded([leaf_of(*r) for r in trees[lang]]) for lang in order}
    root, upper = folded([inner[lang][0] for lang in order])
    out = []
    for lang, above in zip(order, upper):
        for r, path in zip(trees[lang], inner[lang][1]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            digest = leaf_of(*r[:3], r[3] + 1, r[4]) if tampered else leaf_of(*r)
            for left, other in path + above:
                digest = node(other, digest) if left else node(digest, other)
            out.append((r[0], leaf_of(*r), inner[lang][0], root, node(*(other for _, other in path + above)), digest, digest == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_manifest_matches_brute_force(spark, bits):
    docs = cases.frame(spark, cases.documents())
    want = manifest_of([tuple(r) for r in pick(docs, "doc_id", "source", "lang", "n_chars", "text").collect()])
    assert rows_of(merkle.manifest_proofs(crowded(docs), bits)) == want
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_one_row_none_and_extremes(spark):
    one = [(7, "é", None, 2**63 - 1, None)]
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    for rows in (one, [(None, None, None, None, None)] * 3, [(i, "s", f"l{i:02}", i, "") for i in range(35)]):
        assert rows_of(merkle.manifest_proofs(spark.createDataFrame(rows, kind), 2)) == manifest_of(rows)
    assert merkle.manifest_proofs(cases.empty(spark)).count() == 0


def test_versions_copy_only_ancestors(spark):
    docs = spark.createDataFrame([(i, "s", "xx", i, f"t{i}") for i in range(100)], "doc_id long, source string, lang string, n_chars long, text string")
    proved = merkle.prove(merkle.build(merkle.leaves(docs, F.col("doc_id").isin(3, 64)), 3)).cache()
    base = {r.leaf for r in proved.collect()} | {r.root for r in proved.collect()}
    copied = merkle.copied_nodes(proved).collect()
    assert {r.version for r in copied} == {3, 64}
    for v in (3, 64):
        nodes = [r.digest for r in sorted(copied, key=lambda r: r.level) if r.version == v]
        assert len(nodes) == 1 + 7  # the leaf and one node for each level over 100 leaves
        assert not base & set(nodes) and nodes[-1] == next(r.folded_root for r in proved.collect() if r.name == v)


# ---------------------------------------------------------------- 12


def mended(rows):
    """Brute force over rows (conv_id, turn, role, text): the least cost and text of every state, row by row."""
    plain = lambda v: " " if v is None else v
    convs = {}
    for c, turn, role, text in rows:
        kept, kind = convs.setdefault(c, []), zlib.crc32(f"{plain(c)}:{plain(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", plain(text)) if kind == 2 else plain(text)
        kept += [(turn, "user" if kind == 4 else plain(role), text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def least(ways):
        best = {}
        for state, cost, audit, lines in ways:
            best[state] = min(best.get(state, (cost, audit, lines)), (cost, audit, lines))
        return best

    def filled(best):
        for _ in range(3):
            ways = [(s, *b) for s, b in best.items()]
            best = least(ways + [(t, b[0] + 3, b[1] + "I", b[2] + [names[i] + ":"]) for s, b in best.items() for i, t in after[s].items() if i != "s"])
        return best

    out = []
    for c, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marks, best = set(), [], {"": (0, "", [])}
        for _, role, text in turns:
            core = text.strip(" \t\n\x0b\x0c\r")
            mark = "b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            marks.append(mark)
            ways, more = [], 3 if mark == "t" else 0
            for s, (cost, audit, lines) in filled(best).items():
                ways.append((s, cost + 4, audit + "D", lines))
                if mark not in ("b", "d"):
                    ways += [(t, cost + more, audit + "K", lines + [f"{role}:{text}"]) for i, t in after[s].items() if i == role[:1]]
                    ways += [(t, cost + more + 3, audit + "R", lines + [f"{names[i]}:{text}"]) for i, t in after[s].items() if i != "s"]
            best = least(ways)
        cost, audit, lines = min(b for s, b in filled(best).items() if s in ("", "a"))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        starts = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:]))
        out.append((c, gaps, *(marks.count(m) for m in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


KIND = "conv_id long, turn long, role string, text string"
REPORT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def talks(seed, long):
    """Conversations with nulls in every column, ties, repeats, gaps, odd roles, and some of many turns."""
    rng, rows = random.Random(seed), []
    for c in [None, *range(60)]:
        for t in range(long if c in (None, 7) else rng.choice([1, 2, 5, 9])):
            rows.append((c, rng.choice([t, t, None, rng.randint(-3, 9)]), rng.choice(["user", "assistant", "system", "tool", None, "", "user"]), rng.choice(["a.", "b!", "c", "", None, " \n", "d? \n", " e", "f ", f"{t}."])))
    return rows


@pytest.mark.parametrize("block", [2, 64])
def test_repair_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(conversations.repair, "__defaults__", (block,))
    for seed, long in ((1, 40), (2, 300)):
        rows = talks(seed, long)
        got = conversations.repaired_conversations(crowded(spark.createDataFrame(rows, KIND).repartition(3)))
        assert rows_of(got, *REPORT) == mended(rows)


def test_repair_of_nothing_and_of_extremes(spark):
    assert conversations.repaired_conversations(spark.createDataFrame([], KIND)).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "x."), (None, None, None, None), (2, -(2**62), "user", "y " * 300_000 + "."), (2, 2**61, "assistant", "z.")]
    assert rows_of(conversations.repaired_conversations(spark.createDataFrame(rows, KIND)), *REPORT) == mended(rows)


def test_repaired_turns_are_what_the_audit_says(spark):
    rows = conversations.ordered(spark.createDataFrame([(1, 0, "assistant", "a."), (1, 1, "user", "b."), (1, 1, "user", "b."), (2, 5, "system", "s."), (2, 6, "user", "q?")], KIND))
    reports = conversations.repair(rows)
    assert {r.conv_id: (r.cost, r.audit) for r in reports.collect()} == {1: (10, "IKKDI"), 2: (3, "KKI")}
    got = {}
    for r in conversations.repaired_turns(rows, reports).collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {1: [("user", ""), ("assistant", "a."), ("user", "b."), ("assistant", "")], 2: [("system", "s."), ("user", "q?"), ("assistant", "")]}


# ---------------------------------------------------------------- 13

#: Stretches that tokenizers find hard: contractions, special tokens, combining and wide characters, long words.
BITS = ["the ", "house's ", "<|endoftext|>", " <|startoftext|>x ", "don't", "é", "é ", "日本", "12 3", "...,", "\n\n", "\t", "ÀÉ ", "i̇ß ", "'s ", "a" * 40, " ", "  ", "ﬁ", "Σς ", "नमस्ते ", "　", " x"]


def scrambled(rng, n):
    return "".join(rng.choice(BITS) for _ in range(n))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary())


def ids_of(tokenizer, text):
    return array("I", tokenizer.encode(text or "", add_special_tokens=False).ids).tobytes()


def test_parts_cut_anywhere_are_joined_exactly(tokenizer):
    rng, encode = random.Random(5), bpe.encoder(vocabulary())
    for _ in range(1500):
        text = scrambled(rng, rng.randint(0, 40))
        data, want = text.encode(), ids_of(tokenizer, text)
        assert encode(data) == want
        ends = sorted({len(text[: rng.randint(0, len(text))].encode()) for _ in range(rng.randint(0, 6))} - {0, len(data)}) + ([len(data)] if data else [])
        parts = [(e, encode(data[a:e]) if rng.random() < 0.6 else None) for a, e in zip([0, *ends], ends)]
        assert bpe.spliced(data, parts, encode) == want


def test_cuts_are_made_by_content():
    rng = random.Random(2)
    shared = scrambled(rng, 4000)
    found = []
    for before in ("", "one two ", "日本語 " * 50):
        text = (before + shared).encode()
        import pyarrow as pa

        (_, _, bounds, digests), *_ = bpe.chunks_of(pa.array([text.decode()]))
        assert bounds[0] == 0 and bounds[-1] == len(text) and all(b > a for a, b in zip(bounds, bounds[1:]))
        found.append({bytes(d) for d in digests})
    assert len(found[0] & found[1]) > 0.7 * len(found[0]) and len(found[0] & found[2]) > 0.7 * len(found[0])


@pytest.mark.parametrize("filter_bits", [6, 20])
def test_round_trip_matches_the_library(spark, tokenizer, filter_bits):
    rng = random.Random(3)
    shared = [scrambled(rng, 900), "日本" * 800, "x" * 3000, scrambled(rng, 300)]
    rows = [(i, scrambled(rng, rng.randint(0, 80)) + rng.choice(shared) + scrambled(rng, rng.randint(0, 50)) + rng.choice(shared)) for i in range(40)]
    rows += [(None, None), (70, ""), (71, None), (72, shared[0]), (72, shared[0]), (None, shared[3]), (73, scrambled(rng, 60_000))]
    docs = crowded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = [(r.doc_id, bytes(r.ids)) for r in bpe.encode(docs, vocabulary(), filter_bits).collect()]
    assert sorted(got, key=str) == sorted(((i, ids_of(tokenizer, t)) for i, t in rows), key=str)
    texts = [tokenizer.decode(tokenizer.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, t in rows]
    want = [(i, len(ids_of(tokenizer, t)) // 4, hashlib.sha256(ids_of(tokenizer, t)).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for (i, t), d in zip(rows, texts)]
    assert rows_of(bpe.round_trip(docs, vocabulary())) == sorted(want, key=str)


def test_repeated_chunks_are_encoded_once(spark):
    rng = random.Random(9)
    shared = scrambled(rng, 3000)
    docs = spark.createDataFrame([(i, f"{i} {shared} {i}") for i in range(12)], "doc_id long, text string")
    counts = bpe.digest_counts(docs.select("text")).where("n > 1")
    assert {r.n for r in counts.collect()} == {12}


def test_decoding_keeps_other_columns(spark, tokenizer):
    docs = spark.createDataFrame([(1, "It's one."), (2, None)], "doc_id long, text string")
    got = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary())
    assert got.columns == ["doc_id", "text"]
    assert {r.doc_id: r.text for r in got.collect()} == {1: tokenizer.decode(tokenizer.encode("It's one.", add_special_tokens=False).ids, skip_special_tokens=False), 2: ""}


def test_round_trip_of_nothing(spark):
    assert bpe.round_trip(cases.empty(spark), vocabulary()).count() == 0
