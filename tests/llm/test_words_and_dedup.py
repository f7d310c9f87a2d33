import hashlib
import itertools
import random

import numpy as np
import pytest
from fixtures import ALNUM_WORD, SPACE_WORD, UP, WORDS, clashing, documents, prose, spark_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixspark.llm import components, decontaminate, line_dedup, minhash_dedup, textcore


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), min_size=1, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    raw = next(textcore.text_groups(texts))
    data, _, starts, ends, first = textcore.group_words(raw, lower=True)
    hashes = textcore.word_hashes(data, starts, ends)
    seen = {}
    for i, text in enumerate(texts):
        words = SPACE_WORD.findall(text.translate(UP))
        own = hashes[first[i] : first[i + 1]]
        assert len(words) == len(own)
        for w, h in zip(words, own.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def regular_words(n):
    """A word of two letters without a period, and the same with its letters swapped."""
    swap, word = bytes.maketrans(b"ab", b"ba"), b"a"
    while len(word) < n:
        word += word.translate(swap)
    return word, word.translate(swap)


@pytest.mark.parametrize("n", [8, 64, 256, 512, 1024, 4096])
def test_hashes_of_long_regular_words(n):
    one, other = regular_words(n)
    data = np.frombuffer(b" ".join([one, other, b"x" * 900, one, b"alpha", b"x" * 901, b"alpha"]), dtype=np.uint8)
    hashes = textcore.word_hashes(data, *textcore.word_limits(data)).tolist()
    assert len(set(hashes)) == 5 and hashes[0] == hashes[3] and hashes[4] == hashes[6]


def test_regular_words_are_not_linked(spark):
    one, other = (x.decode() for x in regular_words(1024))
    found = minhash_dedup.near_duplicates(spark_docs(spark, [(1, one, "en", "s", 0), (2, other, "en", "s", 0)]), words=2).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (2, 2)}


def test_one_row_of_each_group_stays(spark):
    text, other = "a b c d e f g", "h i j k l m n o"
    rows = [(1, text, "en", "s", 0), (1, text, "de", "s", 0), (1, text, "en", "s", 0), (None, other, "en", "s", 0), (None, other, "fr", "s", 0), (4, text + " ", "en", "s", 0), (4, None, "en", "s", 0), (4, None, "en", "s", 0)]
    kept = minhash_dedup.drop_near_duplicates(spark_docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "").strip()) for r in kept) == [(0, other), (1, text), (4, ""), (4, "")]


# Near duplicates


def sets_of(rows, width):
    out = []
    for r in rows:
        words = SPACE_WORD.findall((r[1] or "").translate(UP))
        k = min(width, len(words))
        out.append(frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else frozenset())
    return out


def expected_components(rows, width):
    sets = sets_of(rows, width)
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
            up[top(i)] = top(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append(r[0])
    return [(r[0], len(s), min((x for x in groups[top(i)] if x is not None), default=None) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_like_brute_force(spark, width):
    rows = documents()
    found = minhash_dedup.near_duplicates(clashing(spark_docs(spark)), words=width).collect()
    ours = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=repr)
    assert ours == sorted(expected_components(rows, width), key=repr)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_of_copies_of_copies(spark):
    """A hub that isn't the lowest id, copies too far from each other, and a chain of links."""
    rng = random.Random(5)
    base = prose(rng, 150)
    texts = []
    for _ in range(60):
        own = list(base)
        for k in rng.sample(range(150), rng.randrange(4, 16)):
            own[k] = rng.choice(WORDS) + str(rng.random())
        texts.append(" ".join(own))
    texts.append(" ".join(base))
    chain = list(base)
    for k in range(40):
        chain[k * 3] = f"chain{k}"
        texts.append(" ".join(chain))
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    found = minhash_dedup.near_duplicates(spark_docs(spark, rows), words=2, slice_rows=7).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted(expected_components(rows, 2))


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    docs = clashing(spark_docs(spark))
    kept = minhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    keep = {c for _, _, c in expected_components(documents(), 5)}
    assert {r["doc_id"] for r in rows} == keep
    assert minhash_dedup.drop_near_duplicates(spark_docs(spark, [])).count() == 0


def test_sketches_agree_as_often_as_sets():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for size in (4, 40, 1000):
        a = np.unique(pool[:size])
        b = np.unique(np.concatenate((pool[: size * 3 // 4], pool[2000 : 2000 + size // 4])))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = np.mean([np.mean(minhash_dedup.sketch(np.sort(textcore.mix(a + np.uint64(s))), 240) == minhash_dedup.sketch(np.sort(textcore.mix(b + np.uint64(s))), 240)) for s in range(40)])
        assert abs(same - j) < 0.06


def test_components(spark):
    links = spark.createDataFrame([(5, 9), (9, 7), (1, 2), (3, 3), (2, 8)] + [(k, k + 1) for k in range(100, 160)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    assert found == {5: 5, 9: 5, 7: 5, 1: 1, 2: 1, 8: 1} | {k: 100 for k in range(100, 161)}
    assert components.connected_components(links.where("false")).count() == 0


# Decontamination


def windows_of(benchmark, n):
    out = {}
    for item, text in benchmark:
        words = ALNUM_WORD.findall((text or "").translate(UP))
        size = min(n, len(words))
        if item is not None and size:
            for s in range(len(words) - size + 1):
                out.setdefault(tuple(words[s : s + size]), set()).add(str(item))
    return out


def expected_hits(text, windows):
    words = ALNUM_WORD.findall((text or "").translate(UP))
    hit, items = set(), set()
    for size in {len(w) for w in windows}:
        for s in range(len(words) - size + 1):
            if tuple(words[s : s + size]) in windows:
                hit.update(range(s, s + size))
                items |= windows[tuple(words[s : s + size])]
    return len(words), len(hit), sorted(items)


def benchmark_and_docs():
    rng = random.Random(8)
    items = [(k, " ".join(prose(rng, rng.randrange(1, 40)))) for k in range(20)]
    items += [(20, items[3][1]), (20, items[4][1]), (21, "lone"), (22, None), (23, ""), (None, items[5][1]), (24, "Re-re, re! re re re re re re re re re re re")]
    rows = [(0, None), (1, ""), (2, "nothing"), (3, "lone"), (4, "re " * 30), (5, items[3][1].upper().replace(" ", ",  "))]
    for k in range(6, 60):
        words = prose(rng, rng.randrange(5, 80))
        for _ in range(rng.randrange(3)):
            w = items[rng.randrange(20)][1].split()
            a = rng.randrange(len(w))
            at = rng.randrange(len(words))
            words[at:at] = w[a : a + rng.randrange(1, 25)]
        rows.append((k, " ".join(words)))
    return items, rows + [rows[7], (None, rows[8][1])]


@pytest.mark.parametrize("most", [20_000, 150])
def test_contamination_like_brute_force(spark, most):
    items, rows = benchmark_and_docs()
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), windows_per_pass=most)
    ours = sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in found.collect())
    windows = windows_of(items, 13)
    assert ours == sorted((repr(d), *expected_hits(t, windows)) for d, t in rows)


def test_decontaminated_documents_and_spans(spark):
    items, rows = benchmark_and_docs()
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = windows_of(items, 13)
    hits = {d: expected_hits(t, windows) for d, t in rows}
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted((repr(r["doc_id"]) for r in kept.collect())) == sorted(repr(d) for d, _ in rows if not (hits[d][1] and 20 * hits[d][1] >= hits[d][0]))
    cleaned = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, benchmark, remove="spans").collect()}
    for d, t in rows:
        if t is not None:
            assert len(ALNUM_WORD.findall(cleaned[d].translate(UP))) == hits[d][0] - hits[d][1]
    assert decontaminate.contamination(docs.where("false"), benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.where("false")).where("n_hit > 0").count() == 0


# Line dedup


def test_lines(spark):
    long = "this passage of many words repeats across several documents and goes"
    near = [f"request {k} took {k * 7} ms on host alpha beta gamma" for k in range(12)]
    vary = [f"the known user {name} logged in from the office today as usual" for name in ("ann", "bob", "cid", "dan", "eve", "fay", "gus", "hal", "ida", "jon", "kim", "lee")]
    rows = [(0, f"first\n{long}\nend"), (1, f"{long}\nother\n\n  \n{long}"), (2, "end\nfirst"), (3, None), (4, ""), (5, f"own line\nown line\n{long} "), (1, f"{long}\nother\n\n  \n{long}")]
    rows += [(100 + k, f"head {k} unique{'x' * k}\n{near[k]}\n{vary[k]}") for k in range(12)] + [(None, long)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], set()).add(r["text"])
    assert got[0] == {f"first\n{long}\nend"} and got[1] == {"other\n\n  "} and got[2] == {"end\nfirst"}
    assert got[3] == {None} and got[4] == {""} and got[5] == {"own line\nown line"} and got[None] == {""}
    assert got[100] == {f"head 0 unique\n{near[0]}\n{vary[0]}"}
    assert all(got[100 + k] == {f"head {k} unique{'x' * k}"} for k in range(1, 12))
    counts = {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs, counts=True).collect()}
    assert {(1, 5, 2), (3, 0, 0), (4, 1, 0), (101, 3, 2)} <= counts
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def test_every_family_of_a_leaf_is_merged(spark):
    """Families that share word count and leading words, behind a more frequent exact line; and lines like no other."""
    exact = "the known user may read the office rules in full"
    families = ["the known user {} logged out of room this morning", "the known user {} has sent us another letter today", "the known user called {} never came back from lunch"]
    names = [a + b for a in "abcd" for b in "xyz"]
    rows = [(k, exact) for k in range(30)]
    rows += [(100 * (f + 1) + k, f"own{'x' * k}\n{line.format(name)}") for f, line in enumerate(families) for k, name in enumerate(names)]
    rows += [(900 + k, "the known user " + " ".join(f"{name}{c}" for c in "abcdefg")) for k, name in enumerate(names)]
    assert {len(t.split("\n")[-1].split()) for _, t in rows} == {10}
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for f, line in enumerate(families):
        assert out[100 * (f + 1)] == f"own\n{line.format(names[0])}"
        assert all(out[100 * (f + 1) + k] == f"own{'x' * k}" for k in range(1, 12))
    assert out[0] == exact and out[1] == "" and all(out[900 + k] == dict(rows)[900 + k] for k in range(12))


def test_sha_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_general_templates_are_those_of_the_fixed_blocks(spark):
    rng, rules = random.Random(6), line_dedup.LineRules()
    lines = sorted({" ".join(["x", "y", "z", *(rng.choice("ab") for _ in range(n - 3))]) for n in (5, 8, 10, 11, 14, 27) for _ in range(9)})
    rows = line_dedup._with_blocks(spark.createDataFrame([(x, len(x.split())) for x in lines], "masked string, n int"), rules)
    names = {hashlib.md5(x.encode()).digest(): x for x in lines}
    got: dict = {}
    for r in line_dedup._general(rows.withColumn("line", F.col("key")), rules).collect():
        got.setdefault((r["high"], r["low"]), []).append(names[bytes(r["line"])])
    want: dict = {}
    for x in lines:
        words = x.split()[3:]
        m = len(words)
        b = min(m, 10)
        blocks = [tuple(words[k * m // b : (k + 1) * m // b]) for k in range(b)]
        for i, j in ((i, j) for i in range(b) for j in range(i, b) if (i == j) == (m + 3 < 10)):
            want.setdefault((m, i, j, tuple(y for k, y in enumerate(blocks) if k not in (i, j))), []).append(x)
    assert sorted(sorted(x) for x in got.values()) == sorted(sorted(x) for x in want.values())


def test_words_of_lines_with_letters_of_several_bytes(spark):
    lines = ["", "ä", "ä öü 中文", "a   b", "€ €"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", line_dedup._n_words(F.col("line")).alias("n")).collect()
    assert {r["line"]: r["n"] for r in rows} == {x: len(x.split(" ")) if x else 0 for x in lines}
