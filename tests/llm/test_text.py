"""Toxicity, decontamination, secrets, pseudonyms and quotations."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cubespark.llm import decontamination as leaks
from cubespark.llm import pii, secrets, toxicity
from cubespark.llm.quotations import link
from cubespark.llm.registry import ORACLE_SQL


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ta", "ri", "no", "mel", "su", "ko"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(1500):
        w = [word() for _ in range(rng.randint(5, 80))]
        bad = i % 6 == 0
        for _ in range(rng.randint(1, 4) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vile!", "Scoundrel", "rot" + word()]))
        rows.append((i, " ".join(w), rng.choice(["xx", "yy"])))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, known).collect()}
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(i for i, r in out.items() if r["held_out"]) == held
    assert sum(out[i]["predicted"] == labels[i][2] for i in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    # The score is of the text alone.
    moved = docs.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.col("doc_id") + 10_000)
    model, limits = toxicity.train(docs, known)
    a = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, limits).collect()}
    b = {r["doc_id"] - 10_000: r["score"] for r in toxicity.score(moved, model, limits).collect()}
    assert a == b == {i: r["score"] for i, r in out.items()}
    kept = {r["doc_id"] for r in toxicity.accepted(docs, model).collect()}
    assert kept == {i for i, s in a.items() if s < 0.5}


def test_thresholds_come_from_all_labelled_rows(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        w = [rng.choice(["aa", "bb", "cc"]) for _ in range(30 if i % 9 else 4000)]  # long texts are in "zz" alone
        rows.append((i, " ".join(w) + (" poison" if i % 2 else ""), "en" if i % 9 else "zz", i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model, limits = toxicity.train(docs, docs.select("doc_id", "toxic"), per_class=150)
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, limits).collect()}
    usable = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    for bad in (0, 1):
        assert sum(r[2] == "zz" and r[3] == bad for r in usable) >= 20
    counts = [("zz", r[3], min(int(out[r[0]] * toxicity.BINS), toxicity.BINS - 1), 1) for r in usable if r[2] == "zz"]
    assert limits["zz"] == toxicity.thresholds(counts)["zz"] != 0.5


def test_long_texts_are_scored_whole(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc"]) for _ in range(30)) + (" poison" if i % 3 == 0 else ""), "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, limits = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")))
    monkeypatch.setattr(toxicity, "SPAN", 64)
    import numpy as np
    import pyarrow as pa

    texts = ["aa bb " * 500 + "poison", "aa bb " * 500, "", "poison " + "cc " * 200]
    h, n = toxicity.words(pa.array(texts), toxicity.PUNCTUATION, toxicity.PREFIXES)
    x = model.scale * toxicity.logits(model, toxicity.word_rows(h), n) + model.shift
    assert (np.array(x) > 0).tolist() == [True, False, False, True]


def test_scores_do_not_depend_on_neighbours(spark):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(["ta", "ri", "no", "mel"]) for _ in range(rng.integers(1, 4)))
    texts = [" ".join(word() for _ in range(rng.integers(0, 60))) for _ in range(200)] + ["", None, "aa", "aa bb", "aa bb " * 20_000]
    rows = [toxicity.word_rows(toxicity.words(pa.array([t]), toxicity.PUNCTUATION, toxicity.PREFIXES)[0]) for t in texts[:100]]
    labels = np.array([int("melmel" in t) for t in texts[:100]], dtype=np.float32)
    model = toxicity.fit([r.reshape(-1, toxicity.TABLES) for r in rows], labels, np.ones(100, np.float32), epochs=2)
    alone = [toxicity.scores(model, pa.array([t], pa.string()))[0] for t in texts]
    for _ in range(6):
        order = rng.permutation(len(texts))
        for part in np.array_split(order, rng.integers(1, 40)):
            assert toxicity.scores(model, pa.array([texts[i] for i in part], pa.string())).tolist() == [alone[i] for i in part]
    assert alone[200] == alone[201]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for n in (1, 7):
        assert {r["doc_id"]: r["score"] for r in toxicity.score(docs.repartition(n), model, {}).collect()} == dict(enumerate(alone))


def edit_distance_within(item, text):
    """Least distance of item to any part of text, row by row."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_against_dynamic_programming():
    rng = random.Random(3)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 150)))
        if rng.random() < 0.5:
            at = rng.randint(0, len(text))
            text = text[:at] + "".join(c if rng.random() > 0.05 else rng.choice("abc") for c in item) + text[at:]
        got = leaks.best_match(leaks.pattern_masks(item), len(item), text, len(item))
        assert (got[0] if got else len(item)) == edit_distance_within(item, text)


def test_edited_items_are_found(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 40)))) for i in range(25)]
    docs, want = [], {}
    for d in range(120):
        w = [word() for _ in range(rng.randint(0, 300))]
        if d % 3:
            i, t = rng.choice(items)
            edits, chars = rng.randint(0, int(len(t) * 0.09)), list(t)
            for _ in range(edits):
                at = rng.randrange(len(chars))
                chars[at : at + rng.choice([0, 1])] = rng.choice(["", "k", "zz"[:1]])
            w.insert(rng.randint(0, len(w)), "".join(chars).upper())
        docs.append((d, "  ".join(w)))
    for d, t in docs:
        for i, item in items:
            dist = edit_distance_within(leaks.normal(item), leaks.normal(t))
            if dist <= int(len(leaks.normal(item)) * 0.05):
                want[(d, i)] = dist
    out = leaks.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in out.collect()} == want
    assert len(want) > 40


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 80)
    items = spark.createDataFrame([(i, f"item number {i} with text of enough characters") for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before item number {i} with text of enough characters after") for i in range(9)] + [(99, "clean")], "doc_id long, text string")
    out = leaks.contamination(docs, items).filter("distance = 0").collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in out) == [(i, i) for i in range(9)]
    assert [r["doc_id"] for r in leaks.uncontaminated(docs, items).collect()] == [99]


def test_short_items_are_searched(spark):
    items = spark.createDataFrame([(1, "E = mc²"), (2, "What is the capital of Peru?"), (3, " "), (4, "漢字")], "item_id long, text string")
    texts = ["so e =\tMC² it is", "x what is the capitol of peru? y", "e = mc", "前漢字後", "clean", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = sorted((r["doc_id"], r["item_id"], r["distance"], r["match_end"]) for r in leaks.contamination(docs, items).collect())
    assert out == [(0, 1, 0, 10), (1, 2, 1, 30), (3, 4, 0, 3)]
    assert sorted(r["doc_id"] for r in leaks.uncontaminated(docs, items).collect()) == [2, 4, 5]


def brute_scan(text):
    kinds = {
        "assign": re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
        "access": re.compile("AKIA[A-Z0-9]+"),
        "hex": re.compile("[0-9a-f]+"),
    }
    least = {"assign": 6, "access": 20, "hex": 24}
    base = []
    for order, (kind, rx) in enumerate(kinds.items()):
        for m in rx.finditer(text):
            if len(m[1] if kind == "assign" else m[0]) >= least[kind]:
                base.append((m.start(), order, m.end(), kind))
    base.sort()
    more = []
    plain = text
    for w in secrets.ALLOWED_WORDS:
        plain = re.sub(f"(?i){w}", " " * len(w), plain, flags=re.ASCII)
    for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", plain):
        c = m[0]
        if any(re.search(p, c) for p in secrets.ALLOWED):
            continue
        limit = secrets.most_sum(secrets.LIMITS["hex" if re.fullmatch("[0-9a-fA-F]+", c) else "base64" if re.search("[0-9]", c) else "letters"])
        hot = [i for i in range(len(c) - 19) if sum(secrets.XLOGX[c[i : i + 20].count(x)] for x in set(c[i : i + 20])) <= limit]
        if hot:
            s, e = m.start() + hot[0], m.start() + hot[-1] + 20
            if not any(b[0] <= s and b[2] >= e for b in base):
                more.append((s, 3, e, "entropy"))
    join = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    return [sum(b[3] == k for b in base) for k in kinds], hashlib.sha256(join(base).encode()).hexdigest(), join(sorted(base + more))


def test_secrets_against_brute_force(spark):
    rng = random.Random(5)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    parts = [
        lambda: "Token: short", lambda: "secret: token = abcdefgh", lambda: 'API_KEY="' + key(30, b64) + '"', lambda: "apikey:=x", lambda: "passwd= 'abc.def'",
        lambda: "AKIA" + key(rng.choice([3, 15, 16, 30]), "ABCDEFGH0123"), lambda: key(rng.choice([10, 23, 24, 40]), "0123456789abcdef"), lambda: key(40, b64), lambda: key(64, "0123456789ABCDEF"),
        lambda: "é漢\U0001f600", lambda: "plain words here", lambda: "550e8400-e29b-41d4-a716-446655440000", lambda: "example" + key(30, b64), lambda: "1" * 30, lambda: "aa1" * 12, lambda: "token=token=abcdef",
        lambda: key(40, b64[:52]), lambda: "/usr/share/doc/long-names-of/Folders/without/digits", lambda: key(25, b64) + "/Sample/" + key(25, b64), lambda: "x" * 9 + "-" * 30,
    ]
    texts = [rng.choice([" ", "", "\n", ","]).join(rng.choice(parts)() for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    n_entropy = 0
    for i, t in enumerate(texts):
        counts, base, spans = brute_scan(t or "")
        r = got[i]
        assert ([r["n_assign"], r["n_access"], r["n_hex"]], r["base_sha256"], r["spans"]) == (counts, base, spans), t
        n_entropy += spans.count("entropy")
    assert n_entropy > 30
    duck = duckdb.connect().register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    by_sql = duck.execute(ORACLE_SQL["op6_secret_scan"])
    columns = [c[0] for c in by_sql.description]
    assert sorted(by_sql.fetchall()) == sorted(tuple(r[c] for c in columns) for r in got.values())


def test_texts_with_very_many_matches(spark):
    log = "\n".join(f"token=abcdef{i:06d} {i:032x} plain" for i in range(40_000))
    out = secrets.scan(spark.createDataFrame([(1, log)], "doc_id long, text string")).collect()[0]
    counts, base, spans = brute_scan(log)
    assert ([out["n_assign"], out["n_access"], out["n_hex"]], out["base_sha256"]) == (counts, base) and counts == [40_000, 0, 40_000]
    assert out["spans"] == spans


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_pseudonyms(spark):
    text = (
        "card 4111 1111 1111 1111, 4111111111111111 not 4111111111111112; ip 10.0.0.255 not 10.0.0.256; mail Jo.n7@mail.example.com, "
        "phone +1 (974) 555-3436; born 1999-02-28 not 1999-02-30, 31/12/2001, 12/31/2001, 01.02.1980; ssn 123-45-6789. x"
    )
    docs = spark.createDataFrame([(1, text), (2, text), (3, "nothing 12 here"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs, "secret").collect()}
    r = got[1]
    assert [r[f"n_{k}"] for k in pii.KINDS] == [1, 1, 2, 1, 1, 4]
    assert r["text"] == got[2]["text"] and r["links"] == got[2]["links"]
    assert (got[3]["text"], got[4]["text"], got[5]["text"]) == ("nothing 12 here", None, "")
    values = dict(x.split(":", 1) for x in r["links"])
    cards = [x[5:] for x in r["links"] if x.startswith("card:")]
    assert luhn(cards[0]) and cards[0] != "4111111111111111" and cards[0] == cards[1]
    written = re.findall(r"\d{4} \d{4} \d{4} \d{4}", r["text"]) + re.findall(r"(?<= )\d{16}(?= not)", r["text"])
    assert [w.replace(" ", "") for w in written] == cards
    assert re.fullmatch(r"[a-z]{2}\.[a-z]\d@mail\.example\.com", values["email"]) and values["email"] in r["text"].lower()
    assert re.fullmatch(r"\+1\d{10}", values["phone"]) and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", r["text"])
    assert all(int(o) < 256 for o in values["ip"].split("."))
    assert "not 4111111111111112;" in r["text"] and "not 10.0.0.256;" in r["text"] and "not 1999-02-30," in r["text"]
    mask = lambda t: re.sub(r"[A-Za-z]", "a", re.sub(r"\d+", "0", t))
    assert mask(r["text"]) == mask(text)


@pytest.mark.parametrize("kind, tokens", [("card", ["4111111111111111", "5500005555555559"]), ("date", ["1999-02-28", "1800-01-01", "2199-12-31"]), ("ip", ["0.0.0.0", "255.1.2.3"]), ("email", ["a@b.cd", "Long.Name99@x.org"]), ("phone", ["+1 (974) 555-3436"])])
def test_pseudonyms_can_be_undone(spark, kind, tokens):
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    there = df.withColumn("p", pii.pseudonym(F.col("t"), F.lit(kind), "k"))
    back = there.withColumn("b", pii.pseudonym(F.col("p"), F.lit(kind), "k", undo=True)).collect()
    assert [r["b"] for r in back] == tokens
    assert all(r["p"] != r["t"] for r in back)


def plain_feistel(values, radices, tweak, key):
    """The permutation in plain Python."""
    half = len(values) // 2
    a, b = list(values[:half]), list(values[half:])
    for r in range(pii.ROUNDS):
        mine, other, radix = (a, b, radices[:half]) if r % 2 == 0 else (b, a, radices[half:])
        said = hashlib.sha256("|".join([key, tweak, str(r), ",".join(map(str, other))]).encode()).hexdigest()
        draws = [int(hashlib.sha256(f"{said}|{i}".encode()).hexdigest()[:12], 16) for i in range(len(mine))]
        moved = [(x + d) % m for x, d, m in zip(mine, draws, radix, strict=True)]
        a, b = (moved, b) if r % 2 == 0 else (a, moved)
    return a + b


def test_feistel_against_plain_python(spark):
    rng = random.Random(8)
    rows = [([rng.randrange(m) for m in ms], ms) for ms in ([10] * 15, [26, 10], [7], [256] * 4, [4800, 12], [26, 10, 26, 26, 10]) for _ in range(20)]
    df = spark.createDataFrame(rows, "v array<long>, m array<int>")
    out = df.select("v", "m", pii.feistel(F.col("v"), F.col("m"), F.lit("tweak"), "key").alias("w")).collect()
    assert [r["w"] for r in out] == [plain_feistel(r["v"], r["m"], "tweak", "key") for r in out]


def test_days_are_numbered_one_by_one(spark):
    days = spark.range(146_097).select(F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int")).alias("d"))
    out = days.select("d", (F.dayofmonth("d") > 12).alias("late"), pii.day_numbers(F.col("d")).alias("n"))
    out = out.withColumn("back", pii.numbered_day(F.col("n"), F.col("late")))
    early, late = (out.filter(f"late = {x}").agg(F.count("*"), F.count_distinct("n"), F.min("n"), F.max(F.col("n")[0]), F.max(F.col("n")[1])).first() for x in ("false", "true"))
    assert tuple(early) == (57_600, 57_600, [0, 0], 4799, 11) and tuple(late) == (88_497, 88_497, [0, 0], 8, 9832)
    assert out.filter("back != d").isEmpty()


def test_dates_in_every_format(spark):
    """Days in all four formats: other days, in the same reading, each once, the same in all formats, and back."""
    days = spark.range(0, 146_097, 23).select(F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int")).alias("d"))
    formats = list(pii.DATES)
    reads = lambda c: F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("date")
    for f in formats:
        some = days.withColumn("t", F.date_format("d", f)).filter(reads(F.col("t")) == F.col("d"))  # read as that day
        out = some.withColumn("p", pii.pseudonym(F.col("t"), F.lit("date"), "k")).withColumn("there", reads(F.col("p")))
        out = out.withColumn("b", pii.pseudonym(F.col("p"), F.lit("date"), "k", undo=True)).withColumn("iso", pii.pseudonym(F.date_format("d", formats[0]), F.lit("date"), "k"))
        out = out.cache()
        n = some.count()
        r = out.agg(F.count("*"), F.count_distinct("there"), F.count_if(F.col("b") != F.col("t")), F.count_if(F.date_format("there", formats[0]) != F.col("iso")), F.count_if(pii.kind_of(F.col("p")) == "date")).first()
        assert tuple(r) == (n, n, 0, 0, n) and n > 4000, f


@pytest.mark.parametrize("spellings", [("4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"), ("(974) 555-3436", "974-555-3436", "974.555 3436"), ("Ann.B7@x.org", "ann.b7@x.org"), ("2001-12-14", "14/12/2001", "12/14/2001", "14.12.2001"), ("2001-05-04", "04/05/2001", "04.05.2001")])
def test_spellings_are_linked(spark, spellings):
    docs = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(spellings)], "doc_id long, text string")
    out = pii.pseudonymise(docs, "k").collect()
    links = {tuple(r["links"]) for r in out}
    assert len(links) == 1 and len(links.pop()) == 1


def test_feistel_is_a_permutation(spark):
    df = spark.range(189 * 7).select(F.array(F.floor(F.col("id") / 7), F.col("id") % 7).alias("v"))
    out = df.select(pii.feistel(F.col("v"), F.array(F.lit(189), F.lit(7)), F.lit("t"), "key").alias("w")).distinct()
    assert out.count() == 189 * 7


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there, this is the first message.\nIt has two lines of words."),
        (1, 1, "assistant", "On Monday, user wrote:\n> Hello there, this is the first message.\n> It has two  LINES of words.\n\nI reply to it with this sentence."),
        (1, 2, "user", "> > Hello there, this is the first message.\n> I reply to it with this sentence.\nThird message text here."),
        (1, 3, "user", "an unrelated statement"),
        (1, 4, "user", "> it has two lines of words.\nok got that one"),
        (2, 0, "user", "> Hello there, this is the first message.\nquoted from elsewhere"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in link(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    parents = {k: r["parent_turn"] for k, r in got.items()}
    assert parents == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): None, (1, 4): 0, (2, 0): None}
    assert {k: (r["thread_turn"], r["depth"]) for k, r in got.items() if k[0] == 1} == {(1, 0): (0, 0), (1, 1): (0, 1), (1, 2): (0, 2), (1, 3): (3, 0), (1, 4): (0, 1)}
    assert got[(1, 1)]["text"] == "I reply to it with this sentence."
    assert got[(1, 2)]["text"] == "Third message text here." and got[(1, 2)]["deepest_level"] == 2 and got[(1, 2)]["n_linked"] == 2
    order = [t for _, t in sorted((r["order_key"], r["turn"]) for k, r in got.items() if k[0] == 1)]
    assert order == [0, 1, 4, 2, 3]


def brute_links(rows):
    """n_quoted, n_linked, parent, level, thread and depth of each (conv_id, turn, text), message by message."""
    parsed, said = {}, {}
    for conv, turn, text in rows:
        runs, before = [], None
        lines = []
        for line in text.split("\n"):
            mark = re.match(r"(?:[ \t]*>)+", line)
            body = re.sub(r"[\x20\x09-\x0D]+", " ", line[len(mark[0]) if mark else 0 :].lower()).strip()
            level = mark[0].count(">") if mark else 0
            lines.append((level, body))
            if body and before == level:
                runs[-1][1].append(body)
            elif body:
                runs.append((level, [body]))
            before = level if body else None
        parsed[conv, turn] = runs
        own = [" ".join(p) for level, p in runs if level == 0]
        keys = set(own) | {" ".join(own)} | {b for level, b in lines if level == 0 and len(b) >= 8}
        for k in keys - {""}:
            said[conv, k] = min(turn, said.get((conv, k), turn))
    out, up = {}, {}
    for (conv, turn), runs in parsed.items():
        origins = []
        for level, parts in runs:
            if level:
                tries = [said.get((conv, b), turn) for b in [" ".join(parts), *[p for p in parts if len(p) >= 8]]]
                found = tries[0] if tries[0] < turn else max([t for t in tries[1:] if t < turn], default=None)
                origins.append((level, found))
        up[conv, turn] = max([o for level, o in origins if level == 1 and o is not None], default=None)
        out[conv, turn] = [len(origins), sum(o is not None for _, o in origins), up[conv, turn], max([level for level, _ in origins], default=0)]
    for (conv, turn), row in out.items():
        top, depth = turn, 0
        while up[conv, top] is not None:
            top, depth = up[conv, top], depth + 1
        row += [top, depth]
    return out


def test_quotations_against_brute_force(spark):
    rng, rows = random.Random(9), []
    for conv in range(40):
        said = []
        for turn in range(rng.randint(1, 15)):
            out = []
            for _ in range(rng.randint(0, 3)):
                if said and rng.random() < 0.7:
                    quoted = rng.choice(said).split("\n")
                    low = rng.randrange(len(quoted))
                    quoted = quoted[low : low + rng.randint(1, 4)]
                    out += [rng.choice(["> ", ">", " > "]) + (q.upper() if rng.random() < 0.2 else q) for q in quoted]
                elif rng.random() < 0.3:
                    out.append("> never said " + str(rng.random()))
                out += [rng.choice(["", "ok", "Yes, do", f"line {rng.randint(0, 30)} of  some length"]) for _ in range(rng.randint(0, 3))]
            said.append("\n".join(out))
            rows.append((conv, turn, said[-1]))
    want = brute_links(rows)
    got = link(spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn int, role string, text string")).collect()
    have = {(r["conv_id"], r["turn"]): [r["n_quoted"], r["n_linked"], r["parent_turn"], r["deepest_level"], r["thread_turn"], r["depth"]] for r in got}
    assert have == want
    duck = duckdb.connect().register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "text"]).assign(role="u"))
    by_sql = duck.execute(ORACLE_SQL["op7_quotation_linking"]).df()
    both = [pd.DataFrame([r.asDict() for r in got])[list(by_sql.columns)], by_sql]
    a, b = (x.astype({"parent_turn": float}).sort_values(["conv_id", "turn"]).astype(str).values.tolist() for x in both)
    assert a == b
    assert sum(w[1] for w in want.values()) > 100 and max(w[5] for w in want.values()) > 2 and max(w[3] for w in want.values()) > 2


def test_messages_of_very_many_lines(spark):
    n = 30_000
    first = "\n".join(f"line {i} of the first message" + "\n" * (i % 3 == 0) for i in range(n))
    reply = "\n".join("> " + x if x else "" for x in first.split("\n")) + "\nread"
    rows = [(1, 0, "u", first), (1, 1, "a", reply), (1, 0, "u", first)]
    out = {(r["turn"]): r for r in link(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert (out[1]["parent_turn"], out[1]["n_quoted"], out[1]["n_linked"], out[1]["text"]) == (0, n // 3 + 1, n // 3 + 1, "read")


def test_short_passages_are_linked(spark):
    rows = [(1, 0, "u", "Thanks!"), (1, 1, "a", "a longer text\nno\nand its end"), (1, 2, "u", "> thanks!\nwelcome"), (1, 3, "a", "> welcome\n> \n> ok"), (1, 4, "u", "> no\nwhy")]
    got = {r["turn"]: r for r in link(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert {t: r["parent_turn"] for t, r in got.items()} == {0: None, 1: None, 2: 0, 3: 2, 4: None}
    assert (got[3]["thread_turn"], got[3]["depth"], got[3]["n_quoted"], got[3]["n_linked"]) == (0, 2, 2, 1)


def test_one_text_said_and_quoted_by_many(spark):
    n = 300
    rows = [(1, t, "u", "the same words again and again" if t < n else "> the same words again and again\nyes") for t in range(2 * n)]
    out = link(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    assert out.filter("parent_turn = 0").count() == n and out.count() == 2 * n


def test_entropy_table():
    assert secrets.XLOGX[8] == round(24 * secrets.MICRO)
    assert secrets.most_sum(math.log2(20)) == 0
