"""Operators over the whole table: 3, 4, 5, 6, and the pipeline, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from surfmatch.llm import minhash_dedup, packing, paragraph_dedup, suffix_dedup
from surfmatch.llm.common import pick
from surfmatch.llm.components import connected_components
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def similar(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 80 * (len(a) + len(b) - both)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(200, 260)] + [(7, 1000 + i) for i in range(50)] + [(3, 3), (5, 4), (5, 4)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    want = roots(nodes, edges_without_loops := [e for e in edges if e[0] != e[1]])
    least = defaultdict(lambda: 10**9)
    for n, r in want.items():
        least[r] = min(least[r], n)
    assert got == {n: least[r] for n, r in want.items()} and edges_without_loops
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_match_brute_force(spark):
    rows = cases.documents(n=25)
    rng = random.Random(9)
    base = cases.prose(rng, 60)
    rows += [(600 + i, cases.edited(rng, base, 0.02 * i), "xx", "s") for i in range(10)]
    got = minhash_dedup.near_duplicates(cases.frame(spark, rows), k=2).collect()
    sets = [shingles(words(t), 2) for _, t, _, _ in rows]
    n = len(rows)
    root = roots(range(n), [(i, j) for i in range(n) for j in range(i) if similar(sets[i], sets[j])])
    ids = defaultdict(list)
    for i in range(n):
        if rows[i][0] is not None:
            ids[root[i]].append(rows[i][0])
    want = Counter((rows[i][0], len(sets[i]), min(ids[root[i]], default=None), rows[i][0] == min(ids[root[i]], default=None)) for i in range(n))
    assert Counter(tuple(r) for r in got) == want
    assert minhash_dedup.near_duplicates(cases.empty(spark)).count() == 0


def test_keep_one_of_each_group(spark):
    rows = cases.documents(n=10)
    kept = [r.doc_id for r in minhash_dedup.keep_one_each(cases.frame(spark, rows)).collect()]
    sets = [shingles(words(t), 5) for _, t, _, _ in rows]
    n = len(rows)
    root = roots(range(n), [(i, j) for i in range(n) for j in range(i) if similar(sets[i], sets[j])])
    groups = defaultdict(list)
    for i in range(n):
        groups[root[i]].append(rows[i][0])
    want = Counter(min((x for x in g if x is not None), default=None) for g in groups.values())
    assert Counter(kept) == want


def test_sketch_fills_and_agrees_with_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    rows = np.repeat([0, 1, 2], [400, 400, 1])
    s = minhash_dedup.sketch(rows, np.concatenate([a, b, a[:1]]), 3, 252)
    assert (s < np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.12


def brute_repeats(rows, length):
    data = [(t or "").encode() for _, t, _, _ in rows]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (doc, *_), b in zip(rows, data):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((doc, len(b), len(b) - len(left), int((np.diff(gone.astype(int)) == 1).sum() + gone[0]), hashlib.sha256(left).hexdigest()))
    return Counter(out)


def test_long_repeats_match_brute_force(spark):
    rows = cases.documents(n=25)
    rng = random.Random(11)
    passage = cases.prose(rng, 60)
    rows += [(700 + i, cases.prose(rng, 30) + passage[i : 320 - 3 * i] + cases.prose(rng, 10), "xx", "s") for i in range(12)]
    rows += [(720, passage[:199], "xx", "s"), (721, passage[:200], "xx", "s"), (722, "ab" * 180, "xx", "s")]
    want = brute_repeats(rows, 200)
    for batches in (1, 5):
        got = suffix_dedup.remove_repeats(cases.frame(spark, rows), batches=batches).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    got = suffix_dedup.remove_repeats(cases.frame(spark, rows), most_rows=0).collect()  # lists too long to broadcast
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert suffix_dedup.remove_repeats(cases.empty(spark)).count() == 0


def test_repeated_passages_inside_lines_match_brute_force(spark):
    rng = random.Random(17)
    line = lambda n: " ".join(rng.choice(cases.WORDS) for _ in range(n))
    shared = line(60)
    rows = [(i, line(12) + "\n" + line(30 + i) + " " + (shared.upper() if i % 2 else shared) + "  " + line(30 - i), "xx", "s") for i in range(8)]
    rows += [(20, shared[: len(shared) // 2] + " " + line(70), None, None), (21, line(5) + " " + "ka " * 140, None, None), (22, line(20) + " " + shared, None, None)]
    seen, want = set(), {}
    for d, t, _, _ in rows:
        for i, x in enumerate(t.split("\n")):
            w, first = words(x), {}
            for j in range(len(w) - 49):
                run = tuple(w[j : j + 50])
                if run in seen or j >= first.setdefault(run, j) + 50:
                    want.setdefault((d, i), set()).update(range(j, j + 50))
            seen |= set(first)
    got = {r.doc_id: r for r in paragraph_dedup.remove_paragraphs(cases.frame(spark, rows + rows[3:4])).collect()}
    assert set(want) == {*((i, 1) for i in range(1, 8)), (21, 0), (22, 0)} and min(map(len, want.values())) >= 60
    assert not any(r.removed for r in got.values())
    cut: dict = {}
    for d, r in got.items():
        for x in r.passages:
            cut.setdefault((d, x.line), set()).update(range(x.first, x.first + x.words))
    assert cut == want
    for d, t, _, _ in rows:
        left = [" ".join(y for j, y in enumerate(words(x)) if j not in want.get((d, i), ())) for i, x in enumerate(t.split("\n"))]
        assert [" ".join(words(x)) for x in got[d].kept_text.split("\n")] == left


def test_passages_over_line_ends_match_brute_force(spark):
    rng = random.Random(23)
    line = lambda n: " ".join(rng.choice(cases.WORDS) for _ in range(n))
    shared = line(58).split(" ")
    rows = []
    for i in range(8):  # the same words, broken into lines of their own way
        cuts = sorted(rng.sample(range(1, 58), 5))
        body = "\n".join(" ".join(shared[a:b]) for a, b in zip([0, *cuts], [*cuts, 58]))
        rows.append((i, line(20) + "\n" + body + "\n" + line(15), "xx", "s"))
    rows += [(20, " ".join(shared[:49]) + "\n" + line(30), None, None), (21, None, None, None), (22, "\n\n", None, None), (23, line(200), None, None)]
    got = {r.doc_id: r for r in paragraph_dedup.remove_paragraphs(cases.frame(spark, rows), min_words=60).collect()}
    runs = defaultdict(list)
    for d, t, _, _ in rows:
        w = words(t)
        for j in range(len(w) - 49):
            runs[tuple(w[j : j + 50])].append((d, j))
    for d, t, _, _ in rows:
        w = words(t)
        gone = {k for at in runs.values() for x, j in at[1:] if x == d for k in range(j, j + 50)}  # the first stays
        assert words(got[d].kept_text) == [x for k, x in enumerate(w) if k not in gone]
        assert (got[d].n_shared > 0) == (d < 8) or d == 20  # of which 49 words stand elsewhere
        assert (got[d].n_passages > 0) == bool(gone) == (0 < d < 8)


def test_paragraphs_tell_where_their_copy_stays(spark):
    rng = random.Random(29)
    line = " ".join(rng.choice(cases.WORDS) for _ in range(30))
    rows = [(5, line + "\nown", "xx", "s"), (3, "x\n" + line.upper(), "xx", "s"), (None, line, "xx", "s"), (7, "another", None, None)]
    got = {r.doc_id: r for r in paragraph_dedup.remove_paragraphs(cases.frame(spark, rows)).collect()}
    assert {d: [(x.idx, x.stays_in, x.stays) for x in r.repeated] for d, r in got.items()} == {3: [(1, 3, True)], 5: [(0, 3, False)], None: [(0, 3, False)], 7: []}
    assert len({x.component for r in got.values() for x in r.repeated}) == 1


def test_paragraph_bands_lose_no_borderline_pair():
    rng = np.random.default_rng(19)
    n, common, own = 4000, 80, 10  # sets of 90 of which 80 are shared: similarity 0.8
    sets = rng.integers(1, 2**63, (n, common + 2 * own), dtype=np.uint64)
    rows = np.repeat(np.arange(n), common + own)
    b, r = paragraph_dedup.BANDS, paragraph_dedup.ROWS
    sides = [minhash_dedup.band_keys(minhash_dedup.sketch(rows, s.ravel(), n, b * r), b, r) for s in (sets[:, : common + own], np.delete(sets, np.s_[common : common + own], 1))]
    assert (sides[0] == sides[1]).any(1).all()


def test_repeated_paragraphs_match_brute_force(spark):
    rng = random.Random(13)
    line = lambda n: " ".join(rng.choice(cases.WORDS) for _ in range(n))
    shared = line(60)
    lines = [line(rng.randint(3, 50)) for _ in range(40)]
    rows = [(i, "\n".join([line(12), *rng.sample(lines, 3), cases.edited(rng, shared, 0.01), ""]), "xx", "s") for i in range(20)]
    rows += [(50, None, None, None), (51, "", None, None), (52, "short line", None, None), (53, "short line\n\n" + shared.upper(), None, None)]
    got = {r.doc_id: r for r in paragraph_dedup.remove_paragraphs(cases.frame(spark, rows)).collect()}
    places = [(d, i, words(x)) for d, t, _, _ in rows for i, x in enumerate((t or "").split("\n")) if len(words(x)) >= 10]
    sets = [shingles(w, 5) for _, _, w in places]
    n = len(places)
    root = roots(range(n), [(i, j) for i in range(n) for j in range(i) if similar(sets[i], sets[j])])
    groups = defaultdict(list)
    for i in range(n):
        groups[root[i]].append(places[i][:2])
    gone = {p for g in groups.values() for p in sorted(g)[1:]}
    assert {(d, i) for d, r in got.items() for i in r.removed} == gone
    for d, t, _, _ in rows:
        left = "\n".join(x for i, x in enumerate((t or "").split("\n")) if (d, i) not in gone)
        assert got[d].kept_text == left and got[d].kept_sha256 == hashlib.sha256(left.encode()).hexdigest()
    assert paragraph_dedup.remove_paragraphs(cases.empty(spark)).count() == 0


def test_paragraphs_leave_no_tables_or_shuffles_of_their_steps(spark):
    import glob
    import os

    rng = random.Random(23)
    lines = [cases.prose(rng, 60) for _ in range(30)]
    docs = cases.frame(spark, [(i, "\n".join([*rng.sample(lines, 3), cases.prose(rng, 120)]), "xx", "s") for i in range(60)])
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    local = spark.sparkContext.getConf().get("spark.local.dir")
    shuffles = lambda: {f for f in glob.glob(f"{local}/**/shuffle_*.data", recursive=True) if os.path.getsize(f)}
    tables, files, setting = set(os.listdir(base)), shuffles(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    out = paragraph_dedup.remove_paragraphs(docs)
    left = {x.split("-")[0] for x in set(os.listdir(base)) - tables}
    assert "lists" in left and not left & {"paragraphs", "classes", "places", "buckets", "several", "members", "wanted", "marked", "placed", "stays", "gone", "repeated", "sampled", "shared", "every", "runs"}
    assert len(shuffles() - files) < 20
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert out.count() == 60 and out.where("n_removed > 0").count() > 50


def vocabulary():
    from surfmatch.llm.queries import vocabulary as path

    return path()


def test_packing_is_exact_and_dense(spark):
    from tokenizers import Tokenizer

    rows = cases.documents(n=40) + [(800, "It's a b_c <|endoftext|> İ \x1c x y " * 3, "xx", "s")]
    t = Tokenizer.from_file(vocabulary())
    for most, capacity in ((200_000, 2048), (20, 64)):
        got = packing.pack(cases.frame(spark, rows), vocabulary(), capacity=capacity, most=most, slack=2).collect()
        want = Counter()
        for d, text, _, _ in rows:
            ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
            for k, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                want[(d, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        total = sum(r.length for r in got)
        assert len(bins) <= 1.1 * total / capacity + 1
    assert packing.pack(cases.empty(spark), vocabulary()).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(17)
    rows = [(i, cases.prose(rng, rng.randint(30, 90)), "xx", "s0") for i in range(60)]
    item = " ".join(rng.choice(cases.WORDS) for _ in range(25))
    rows += [(100, rows[4][1], "xx", "s0"), (101, "before " + item + " after " + cases.prose(rng, 20), "xx", "s0"), (102, cases.prose(rng, 40) + ' password = "hunter2222"', "xx", "s0"), (103, None, "xx", "s0")]
    sf = f"file://{tmp_path}"
    pick(cases.frame(spark, rows), "doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
        if name == "secret_scan":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(texts) == {i for i in range(60)} | {102}
    assert "hunter" not in texts[102] and texts[5] == rows[5][1]
    assert {r.doc_id for r in docs.collect()} == set(texts)


def test_pipeline_language_stage_is_calibrated_on_all_training_documents(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from surfmatch.llm import langid

    rows = [(i, ("ab cab " if i % 2 else "xy zyx ") * 3, "pq"[i % 2], "s") for i in range(32_000)]
    docs = pick(cases.frame(spark, rows), "doc_id", "text", "lang", "source", "n_chars")
    read, inner = [], langid.cross_entropies

    def counted(docs, model, *keep):
        read.append(docs.count())
        return inner(docs, model, *keep)

    monkeypatch.setattr(langid, "cross_entropies", counted)
    out = corpus_pipeline.language_stage(spark, docs, f"file://{tmp_path}")
    assert read == [sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(32_000)), 32_000]
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_language_stage_learns_from_all_labelled_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    text = lambda letters, n: " ".join("".join(rng.choices(letters, k=5)) for _ in range(n))
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2][:40]
    rows = [(i, text("abcdef", 30), "p", "s") for i in range(1000, 1200)]
    # two languages of documents that operator 9 does not learn from: ids it holds out, and no id
    rows += [(i, text("бвгджз", 30), "q", "s") for i in ids] + [(None, text("αβγδεζ", 30), "r", "s") for _ in range(40)]
    rows += [(2000, text("бвгджз", 200), None, "s"), (2001, text("αβγδεζ", 200), None, "s"), (2002, text("अआइईउऊ", 200), None, "s")]
    docs = pick(cases.frame(spark, rows), "doc_id", "text", "lang", "source", "n_chars")
    out = corpus_pipeline.language_stage(spark, docs, f"file://{tmp_path}").collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((i, t) for i, t, _, _ in rows if i != 2002)


def test_pipeline_language_thresholds_come_from_short_documents_too(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(22)
    even = lambda n: "".join(rng.choices("qrstuvwxyz", k=n))
    # a language of little surprise, and one of much surprise without any labelled text of 100 symbols
    rows = [(i, "ab " * 50, "p", "s") for i in range(900)] + [(i, even(40), "q", "s") for i in range(1000, 1300)]
    rows += [(2000, even(3000), None, "s"), (2001, "жшч" * 1000, None, "s")]
    docs = pick(cases.frame(spark, rows), "doc_id", "text", "lang", "source", "n_chars")
    out = corpus_pipeline.language_stage(spark, docs, f"file://{tmp_path}").collect()
    assert sorted(r.doc_id for r in out) == [i for i, _, _, _ in rows if i != 2001]


def test_pipeline_language_thresholds_are_weighted_sums_of_all_texts(spark):
    from surfmatch.llm import langid

    rows = [("p", 4, 5, [2.0, 9.0]), ("p", 90, 100, [4.0, 9.0]), ("p", 800, 900, [3.0, 9.0]), ("p", 0, 1, [50.0, 9.0])]
    got = langid.thresholds(spark.createDataFrame(rows, "lang string, n_letters long, n_symbols long, bits array<double>"), ["p", "q"])
    w = np.array([5 / 105, 100 / 200, 900 / 1000])
    x = np.array([2.0, 4.0, 3.0])
    mean = (w * x).sum() / w.sum()
    assert np.allclose(got["mean"], [mean, mean]) and np.allclose(got["sd"], [((w * (x - mean) ** 2).sum() / w.sum()) ** 0.5, 0.25])


def test_pipeline_packing_stage_leaves_no_word_pieces_in_workers(spark, tmp_path):
    import corpus_pipeline

    docs = pick(cases.frame(spark, [(i, f"words like these and w{i}", "p", "s") for i in range(50)]), "doc_id", "text", "lang", "source", "n_chars")
    assert corpus_pipeline.packing_stage(spark, docs, f"file://{tmp_path}").count() == 50

    def held(batches):
        from surfmatch.llm import packing

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, packing._pieces.values()))] * batch.num_rows)], ["n"])

    assert {r.n for r in spark.range(64).repartition(16).mapInArrow(held, "n long").collect()} == {0}
