import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cubespark.llm.mixing import mix, repeated
from cubespark.llm.sharding import communication_matrix, hypergeometric, shard


def corpus(spark, seed=0, n=600):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a"] * 12 + ["b"] * 4 + ["c", "d"])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def shares(rows):
    t = Counter()
    for r in rows:
        t[r["source"]] += r["n_tokens"]
    total = sum(t.values())
    return {s: v / total for s, v in t.items()}, t, total


def test_exponent_is_the_smallest_that_fits(spark):
    rows = mix(corpus(spark), repetition=1.6).collect()
    p, _, _ = shares(rows)
    most = lambda a: max(q ** (a - 1) for q in p.values()) / sum(q**a for q in p.values())
    a = rows[0]["exponent"]
    assert most(a) <= 1.6 + 1e-9 and most(a - 1e-6) > 1.6
    for r in rows:
        assert r["weight"] == pytest.approx(p[r["source"]] ** a / sum(q**a for q in p.values()))


def test_entropy_target(spark):
    rows = mix(corpus(spark), repetition=100.0, entropy=1.2).collect()
    weights = {r["source"]: r["weight"] for r in rows}
    assert -sum(w * math.log(w) for w in weights.values()) == pytest.approx(1.2, abs=1e-5)


@pytest.mark.parametrize("budget", [None, 3_000, 60_000])
def test_budget_and_even_copies(spark, budget):
    rows = mix(corpus(spark), repetition=50.0, budget_tokens=budget).collect()
    _, t, total = shares(rows)
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    for s, rs in by.items():
        want = rs[0]["weight"] * (budget or total)
        taken = sum(r["copies"] * r["n_tokens"] for r in rs)
        assert want - 60 <= taken <= want + 1e-6
        copies = {r["copies"] for r in rs if r["n_tokens"]}
        assert max(copies) - min(copies) <= 1
    assert all(r["copies"] == 1 for r in rows if not r["n_tokens"])


def test_cover_takes_every_document(spark):
    rows = mix(corpus(spark), repetition=2.0, cover=True).collect()
    assert min(r["copies"] for r in rows) == 1
    assert max(r["copies"] for r in rows) == 2


def test_mix_does_not_depend_on_partitions(spark):
    docs = corpus(spark)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(mix(docs)) == key(mix(docs.repartition(7)))


def test_rows_are_repeated_as_taken(spark):
    docs = corpus(spark).withColumnsRenamed({"text": "text"}).selectExpr("*", "'x' AS copies", "doc_id AS _id", "1 AS n_tokens", "2 AS d")
    docs = docs.unionAll(docs.limit(3)).unionAll(docs.filter("doc_id = 5").selectExpr("doc_id", "concat(text, ' w')", "source", "copies", "_id", "n_tokens", "d"))
    taken = mix(docs, repetition=2.0)
    want = Counter()
    for r in taken.collect():
        want[(r["doc_id"], r["source"], r["n_tokens"])] += r["copies"]
    out = repeated(docs, taken)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in out.collect())
    assert got == Counter({k: v for k, v in want.items() if v}) and 0 in want.values()
    assert repeated(docs.limit(0), mix(docs.limit(0))).count() == 0


def odd(spark):
    """A corpus with null and empty texts, a null source, other letters and repeated rows."""
    more = [(900, None, "a"), (901, "", "b"), (902, "ü €\x0b€ 𝄞", None), (902, "ü €\x0b€ 𝄞", None), (None, "w w", "c"), (5, "w " * 80, "a")]
    docs = corpus(spark, seed=3).unionAll(spark.createDataFrame(more, "doc_id long, text string, source string"))
    return docs.unionAll(docs.filter("doc_id % 50 = 0"))


@pytest.mark.parametrize(
    "limits",
    [{"repetition": 1.25}, {"repetition": 1.0}, {"repetition": 100.0, "entropy": 1.2}, {"repetition": 50.0, "budget_tokens": 3_000}, {"repetition": 3.0, "budget_tokens": 60_000}, {"repetition": 2.0, "cover": True}],
    ids=str,
)
def test_mix_against_brute_force(spark, limits):
    """Plain halving for the exponent, then each source in its random order, token by token."""
    docs, words = odd(spark), re.compile(r"[^\x20\t-\r]+")
    rows = [(r["doc_id"], r["source"] or "", len(words.findall(r["text"] or ""))) for r in docs.collect()]
    out = mix(docs, **limits).withColumn("h", F.xxhash64(F.lit(9), "source", "doc_id", "n_tokens")).collect()
    assert Counter((r["doc_id"], r["source"], r["n_tokens"]) for r in out) == Counter(rows)

    tokens, count = Counter(), Counter(s for _, s, _ in rows)
    for _, s, n in rows:
        tokens[s] += n
    total = sum(tokens.values())

    def at(a):
        z = sum((t / total) ** a for t in tokens.values())
        weight = {s: (t / total) ** a / z for s, t in tokens.items()}
        budget = max(t / weight[s] for s, t in tokens.items()) if limits.get("cover") else limits.get("budget_tokens", total)
        most = max(w * budget / tokens[s] for s, w in weight.items())
        spread = -sum(w * math.log(w) for w in weight.values())
        return weight, budget, most <= limits["repetition"] * (1 + 1e-12) and spread <= limits.get("entropy", 99)

    low, high = (0.0, 0.0) if at(0.0)[2] else (0.0, 1.0)
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (low, middle) if at(middle)[2] else (middle, high)
    assert [r["exponent"] for r in out] == pytest.approx([high] * len(out), abs=1e-6)

    weight, budget, _ = at(out[0]["exponent"])
    by = defaultdict(lambda: defaultdict(list))
    for r in out:
        assert r["weight"] == pytest.approx(weight[r["source"]])
        block = ((r["h"] % 2**64) >> 33) * max(64, -(-count[r["source"]] // 50_000)) // 2**31
        assert r["block"] == block
        by[r["source"]][(block, r["h"])].append(r)
    for s, order in by.items():
        want = weight[s] * budget
        passes = math.floor(want / tokens[s] + 1e-9)
        left = want - passes * tokens[s]
        for _, equal in sorted(order.items()):
            left -= sum(r["n_tokens"] for r in equal)
            assert {r["copies"] for r in equal} == {passes + (left >= 0) if equal[0]["n_tokens"] else 1}


def test_shard_against_brute_force(spark):
    """Each lane in its random order, cut by its row of the matrix; each shard in its random order."""
    docs, key = odd(spark), ["doc_id", "text_crc32", "size"]
    out = shard(docs, shards=7, seed=20)
    hashes = [F.xxhash64(F.lit(20), *key).alias("a"), F.xxhash64(F.lit(21), *key).alias("b"), F.xxhash64(F.lit(22), *key, "shard").alias("c")]
    rows = out.select(*key, "shard", "slot", *hashes).collect()
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    assert Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in rows) == Counter((i, zlib.crc32(t), len(t) + 16) for i, t in texts)

    lanes = defaultdict(list)
    for r in rows:
        lanes[r["a"] % 65_536 % 64].append((r["b"], *(r[k] for k in key)))
    n = len(rows)
    matrix = communication_matrix([len(lanes[i]) for i in range(64)], [n // 7 + (s < n % 7) for s in range(7)], 20)
    want = Counter()
    for lane, counts in enumerate(matrix):
        ends = [s for s, c in enumerate(counts) for _ in range(c)]
        want.update((*row[1:], s) for row, s in zip(sorted(lanes[lane], key=lambda x: x[0]), ends, strict=True))
    assert Counter((*(r[k] for k in key), r["shard"]) for r in rows) == want
    for s in range(7):
        order = sorted((r for r in rows if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in order] == list(range(n // 7 + (s < n % 7)))
        places = [(((r["c"] % 2**64) >> 33) * 8 // 2**31, r["c"]) for r in order]
        assert places == sorted(places)


def test_hypergeometric_law():
    rng, good, bad, draws, n = random.Random(5), 30, 50, 20, 20_000
    seen = Counter(hypergeometric(rng, good, bad, draws) for _ in range(n))
    law = {k: math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) for k in range(draws + 1)}
    chi2 = sum((seen[k] - n * p) ** 2 / (n * p) for k, p in law.items() if n * p >= 5)
    assert chi2 < 40  # about 12 classes


def test_matrix_has_its_margins():
    lanes, shards = [5, 0, 100, 33, 2], [28, 28, 28, 28, 28]
    m = communication_matrix(lanes, shards, 1)
    assert [sum(r) for r in m] == lanes and [sum(c) for c in zip(*m, strict=True)] == shards
    assert hypergeometric(random.Random(1), 10**10, 3 * 10**10, 10**9) == pytest.approx(2.5e8, rel=1e-3)


@pytest.mark.parametrize("n", [0, 7, 40, 1003])
def test_shards_are_exact_and_gapless(spark, n):
    docs = corpus(spark, n=n) if n else corpus(spark).limit(0)
    rows = shard(docs, shards=40).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert sum(map(len, by.values())) == n
    counts = [len(by[s]) for s in range(40)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert set(by) <= set(range(40))


def test_shards_are_uniform(spark):
    """Over seeds, where a document goes has no pattern: its shard and the half of it are spread evenly."""
    docs, seeds = corpus(spark, n=40).cache(), 12
    seen = Counter()
    for seed in range(seeds):
        for r in shard(docs, shards=2, seed=seed * 10, least_lanes=5).collect():
            seen[(r["doc_id"], r["shard"], r["slot"] // 10)] += 1
    chi2 = sum((seen[(d, s, h)] - seeds / 4) ** 2 / (seeds / 4) for d in range(40) for s in range(2) for h in range(2))
    assert chi2 < 120 + 5 * math.sqrt(240)


def test_shards_do_not_depend_on_partitions(spark):
    docs = corpus(spark)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(shard(docs)) == key(shard(docs.repartition(9)))
