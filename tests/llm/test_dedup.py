import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cubespark.llm import _bloom, ngram_jaccard
from cubespark.llm._words import shingles, words
from cubespark.llm.exact_dedup import exact_dedup
from cubespark.llm.line_dedup import dedup_lines

SPACES = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_exact_groups(spark):
    rng = random.Random(1)
    texts = [rng.choice(["Abc", "aBC", "É", "é", "", None, "x\n", "x"]) if rng.random() < 0.6 else f"t{rng.random()}" for _ in range(400)]
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[(t or "").translate(LOW)].append(i)
    got = {r["doc_id"]: r for r in exact_dedup(frame(spark, texts)).collect()}
    for low, ids in groups.items():
        for i in ids:
            assert got[i][1:] == (max(ids), len(ids), i == max(ids), hashlib.sha256(low.encode()).hexdigest())


def test_saturated_filter_gives_the_same(spark):
    docs = frame(spark, [f"t{i // 2}" for i in range(300)])
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(exact_dedup(docs)) == key(exact_dedup(docs, most_bits=_bloom.CHUNK))


def test_filters_by_parts_of_the_hashes(spark):
    docs = frame(spark, [f"t{i if i % 7 else i // 14}" for i in range(12_000)])
    key = lambda df: sorted(map(tuple, df.collect()))
    assert 12_000 * _bloom.BITS_A_ROW > 2 * _bloom.CHUNK
    assert key(exact_dedup(docs)) == key(exact_dedup(docs, most_bits=_bloom.CHUNK))


def test_bloom_has_no_false_negatives(spark):
    values = spark.range(0, 3000).selectExpr("xxhash64(id) AS h")
    bloom = _bloom.build(values, "h", _bloom.bits_for(3000))
    inside = np.array([r["h"] for r in values.collect()])
    assert _bloom.passes(bloom, inside).all()
    assert _bloom.passes(bloom, np.arange(10_000)).mean() < 0.02


def brute_lines(texts, least_chars, least_docs):
    keys = [[line.strip(SPACES).translate(LOW) for line in (t or "").split("\n")] for t in texts]
    held = defaultdict(set)
    for i, ks in enumerate(keys):
        for k in ks:
            held[k].add(i)
    out = {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        drop = [len(k) >= least_chars and len(held[k]) >= least_docs and i != max(held[k]) for k in keys[i]]
        out[i] = ("\n".join(x for x, d in zip(lines, drop, strict=True) if not d), len(lines), sum(drop))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(2)
    pool = [f"line number {i} with text long enough to count " + "z" * rng.randint(0, 9) for i in range(12)] + ["short", "", "  "]
    texts = []
    for _ in range(200):
        picked = [rng.choice(pool) for _ in range(rng.randint(0, 9))]
        texts.append("\n".join(rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", " \r"]) for x in picked))
    texts[5] = None
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in dedup_lines(frame(spark, texts), 40, 5).collect()}
    assert got == brute_lines(texts, 40, 5)


def test_keep_runs_are_the_bitmap(spark):
    line = "the same line in all of these documents, long enough"
    rows = {r["doc_id"]: r for r in dedup_lines(frame(spark, [f"a\n{line}\nb\n{line}"] * 6), 40, 5).collect()}
    assert [tuple(x) for x in rows[0]["keep_runs"]] == [(0, 1), (2, 1)]
    assert [tuple(x) for x in rows[5]["keep_runs"]] == [(0, 4)]


def test_rows_of_lines_are_known_by_id_and_text(spark):
    """Rows of one id with other texts, and one text under several ids, lose their own lines alone."""
    line = "a line of this test that is certainly long enough"
    rows = [(i // 2, f"{line}\nown {i % 2}" if i % 2 else f"x {i}\n{line}") for i in range(12)] + [(9, line), (9, line), (None, line)]
    got = sorted((str(r["doc_id"]), r["text"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 40, 5).collect())
    want = [(str(i // 2), f"own {i % 2}" if i % 2 else f"x {i}") for i in range(12)] + [("9", line), ("9", line), ("None", "")]
    assert got == sorted(want)


def brute_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(texts, percent=80):
    sets, parent = brute_sets(texts), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


def near_copies(rng, n_groups=25):
    texts = []
    for _ in range(n_groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 5, 8, 14, 30, 60, 120, 300]))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"v{rng.randint(0, 99)}"
            texts.append(" ".join(w))
            base = w if rng.random() < 0.3 else base  # chains
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(40)]
    return texts + ["", None, "one", "ONE", "one two three four", "one two three four five"] * 2


@pytest.mark.parametrize("block", [1024, 4])
def test_jaccard_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    monkeypatch.setattr(ngram_jaccard, "FLUSH", 500 if block == 4 else ngram_jaccard.FLUSH)
    texts = near_copies(random.Random(block))
    component, size = brute_components(texts)
    got = {r["doc_id"]: r for r in ngram_jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == component
    assert [got[i]["n_shingles"] for i in range(len(texts))] == size


def test_all_links_are_counted(spark):
    texts = near_copies(random.Random(6))
    sets, (component, _) = [frozenset(x) for x in brute_sets(texts)], brute_components(texts)
    classes = {x for x in sets if x}
    want = [sum(x != y and 100 * len(x & y) >= 80 * len(x | y) for y in classes) if x else 0 for x in sets]
    got = {r["doc_id"]: r for r in ngram_jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert [got[i]["n_links"] for i in range(len(texts))] == want and max(want) > 2
    assert [got[i]["component_id"] for i in range(len(texts))] == component


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        n = int(rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 19, 20, 31, 52, 83, 84, 150, 400, 900]))
        common = rng.integers(0, 2**64, n, dtype=np.uint64)
        spare = n * 20 // 80 if rng.random() < 0.5 else int(rng.integers(0, n * 20 // 80 + 1))
        left = int(rng.integers(0, spare + 1)) if rng.random() < 0.7 else 0
        a = np.unique(np.concatenate((common, rng.integers(0, 2**64, left, dtype=np.uint64))))
        b = np.unique(np.concatenate((common, rng.integers(0, 2**64, spare - left, dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert len(np.intersect1d(ngram_jaccard.signatures(a, 80), ngram_jaccard.signatures(b, 80))), (len(a), len(b), both)


def test_sketch_is_a_lower_bound():
    rng = np.random.default_rng(4)
    for _ in range(50):
        both = rng.integers(0, 2**64, 900, dtype=np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 2**64, n, dtype=np.uint64)))) for n in (40, 400))
        x, y = ngram_jaccard.sketch(a), ngram_jaccard.sketch(b)
        for size in (64, min(len(x), len(y))):
            bound = np.bitwise_count(ngram_jaccard.folded(x, size) ^ ngram_jaccard.folded(y, size)).sum()
            assert 100 < bound <= len(np.setxor1d(a, b)) or size == 64


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(10, 60)], "a long, b long")
    assert {r["component"] for r in ngram_jaccard.components(links).collect()} == {10}


def test_words_split_like_bytes():
    texts = ["Ab  cd\tE\x0bf", None, "", " ", "é ü x", "x" * 9_000_000 + " y"]
    hashes, counts = words(pa.array(texts))
    split = [(t or "").encode().lower().split() for t in texts]
    assert counts.tolist() == [len(s) for s in split]
    flat = [w for s in split for w in s]
    seen = {}
    for w, h in zip(flat, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert [len(s) for s in shingles(hashes, counts)] == [1 if 0 < len(s) < 5 else max(0, len(s) - 4) for s in split]


def test_counts_are_whole(spark):
    texts = ["same text of more than five words here"] * 50 + ["other text of more than five words here"] * 3
    got = ngram_jaccard.jaccard_components(frame(spark, texts)).collect()
    assert Counter(r["component_id"] for r in got) == {0: 50, 50: 3}


def test_rows_that_share_an_id(spark):
    """Documents under one id are documents of their own, and repeated rows are copies of each other."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(7, a), (7, b), (7, b), (3, a + " tail"), (8, b + " tail"), (9, c), (9, c), (9, c), (10, None), (10, None), (None, a), (11, "")]
    docs = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, r string, stays long")
    got = sorted((str(r["doc_id"]), r["n_links"], str(r["component_id"])) for r in ngram_jaccard.jaccard_components(docs).collect())
    want = [("7", 1, "3"), ("7", 1, "7"), ("7", 1, "7"), ("3", 1, "3"), ("8", 1, "7")] + [("9", 0, "9")] * 3 + [("10", 0, "10")] * 2 + [("None", 0, "None"), ("11", 0, "11")]
    assert got == sorted(want)
    left = ngram_jaccard.one_of_each(docs)
    assert left.columns == docs.columns
    kept = left.collect()
    assert sorted((str(r["doc_id"]), str(r["text"])[-6:]) for r in kept) == sorted([("3", "9 tail"), ("7", b[-6:]), ("9", c[-6:]), ("10", "None"), ("10", "None"), ("None", a[-6:]), ("11", "")])
    assert len({r["stays"] for r in kept}) == len(kept) and ngram_jaccard.one_of_each(docs.limit(0)).count() == 0
