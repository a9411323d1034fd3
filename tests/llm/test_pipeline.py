"""The pipeline, stage by stage, on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_dedup import brute_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["ba", "do", "mi", "ser", "lun"]) for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)]
    rows, labels = [], []
    for i in range(600):
        w = [word() for _ in range(rng.randint(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "scoundrel")
        if i % 50 == 1:
            w[3:3] = rng.choice(items)[1].split()
        text = rows[i - 2][1] + (" tail" if i % 2 else "") if i % 7 == 6 and i > 2 else " ".join(w)
        rows.append((i, text, "en", rng.choice(["s0"] * 5 + ["s1", "s2"]), len(text)))
        labels.append((i, 1, int("scoundrel" in text)))
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, {r[0]: r for r in rows}, items


def test_stages(spark, corpus, tmp_path):
    d, rows, items = corpus
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = docs
        if name != "sharding":
            assert docs.columns == COLUMNS
            assert all(tuple(r) == rows[r["doc_id"]] for r in docs.collect())
    ids = {name: sorted(r["doc_id"] for r in df.collect()) for name, df in out.items()}
    clean = [i for i, r in rows.items() if "scoundrel" not in r[1]]
    assert len(set(ids["toxicity"]) ^ set(clean)) <= 3
    kept = ids["toxicity"]
    component, _ = brute_components([rows[i][1] for i in kept])
    assert ids["near_copies"] == [kept[i] for i in sorted(set(component))]
    assert ids["decontamination"] == [i for i in ids["near_copies"] if not any(t in rows[i][1] for _, t in items)]
    assert set(ids["mixing"]) == set(ids["decontamination"]) and len(ids["mixing"]) > len(ids["decontamination"])
    assert ids["sharding"] == ids["mixing"]


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.count() > 300 and "shard" in out.columns


def test_thresholds_of_languages_decide(spark, corpus, monkeypatch):
    d, _, _ = corpus
    docs, toxic = spark.read.parquet(f"{d}/documents.parquet"), corpus_pipeline.toxic
    model, _ = toxic.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxic.score(docs, model, {}).collect()}
    low = sorted(scores.values())[100]
    monkeypatch.setattr(toxic, "train", lambda *_: (model, {"en": low}))
    kept = {r["doc_id"] for r in corpus_pipeline.toxicity(spark, docs, d).collect()}
    assert kept == {i for i, x in scores.items() if x < low} and len(kept) < sum(x < 0.5 for x in scores.values())


EDGE = [
    (1, "a text of some words that is as clean as any other text here", "en", "s1", 3),
    (1, "a text of some words that is as clean as any other text here", "en", "s1", 3),
    (1, "another text under the same id, which is no copy of the first one", "en", "s2", 3),
    (2, "A text of SOME words that is as clean as any other text here", None, None, None),
    (3, None, "en", "s1", 0),
    (4, "", None, "s1", 0),
    (5, " \n\t", "de", "", 3),
    (None, "a text without an id, and of some words", "en", "s1", 3),
    (6, "lala " * 300_000, "fr", "s1", 3),
    (7, "漢字 é \U0001f600", "xx", "s2", 3),
]


@pytest.fixture(scope="module")
def edges(spark, corpus, tmp_path_factory):
    """Labels and test items as in the corpus, with nulls, repeated and empty rows."""
    d = str(tmp_path_factory.mktemp("edges"))
    spark.read.parquet(f"{corpus[0]}/labels.parquet").unionAll(spark.createDataFrame([(None, 1, 1), (1, 1, None), (1, 0, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "a text without"), (3, "no such words anywhere at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_edges_of_stages(spark, edges, name, stage):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, docs, edges)
    rows = sorted(map(str, out.collect()))
    if name in ("toxicity", "decontamination"):
        assert rows == sorted(map(str, docs.collect()))  # nothing there to reject
    elif name == "near_copies":  # the rows of the first text are copies of each other, the one below another id too
        assert rows == sorted(str(r) for i, r in enumerate(docs.collect()) if i not in (1, 3))
    elif name == "mixing":
        assert set(rows) == set(map(str, docs.collect())) and len(rows) >= len(EDGE)
    else:
        assert len(rows) == len(EDGE) and sorted({r["shard"] for r in out.collect()}) == list(range(len(EDGE)))
    assert stage(spark, docs.limit(0), edges).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_clashing_columns_of_stages(spark, edges, name, stage):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long")
    clashes = ["d", "r", "s", "k", "n", "fp", "copies", "_copies", "_copy", "component", "component_id", "stays", "_toxic", "n_tokens", "shard", "slot", "score", "x"]
    more = docs.selectExpr("*", *[f"'{c}' AS {c}" for c in clashes])
    out = stage(spark, more, edges)
    if name != "sharding":
        assert out.columns == more.columns and out.select([c for c in clashes if c != "x"]).distinct().count() <= 1
    assert sorted(map(str, out.select(docs.columns if name != "sharding" else out.columns).collect())) == sorted(map(str, stage(spark, docs, edges).collect()))
