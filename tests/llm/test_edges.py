"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from cubespark.llm.decontamination import contamination, uncontaminated
from cubespark.llm.exact_dedup import exact_dedup
from cubespark.llm.line_dedup import dedup_lines
from cubespark.llm.mixing import mix
from cubespark.llm.ngram_jaccard import jaccard_components
from cubespark.llm.pii import pseudonymise
from cubespark.llm.quotations import link
from cubespark.llm.secrets import scan
from cubespark.llm.sharding import shard
from cubespark.llm.toxicity import toxicity

LONG = "word another third " * 60_000 + "\n" + "x" * 300_000
ROWS = [
    (1, "a line of some forty characters or rather more\nb", "en", "s1"),
    (2, "A LINE of some forty characters or rather more\nb", "en", "s1"),
    (3, None, None, None),
    (4, "", "de", "s2"),
    (5, "   \n\t ", "de", ""),
    (6, LONG, "fr", "s1"),
    (7, "tie", "en", "s1"),
    (7, "tie", "en", "s1"),
    (7, "another text under the same id as a tie", "en", "s1"),
    (None, "no id but 4111 1111 1111 1111 and token = \"abcdef0123\"", "en", "s3"),
    (8, "é ü 漢字 \U0001f600 mixed", None, "s1"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHES = ["n", "score", "shard", "slot", "copies", "component_id", "_row", "_t", "_r", "fp", "sha", "k", "h", "block", "weight", "keep_id", "id", "spans"]


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (6, 0, 1), (9, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, "A line of SOME forty   characters or rather more"), (2, None), (3, ""), (None, "a line of some forty characters or rather more")], "item_id long, text string")


OPERATORS = {
    "toxicity": lambda s, d: toxicity(d, labels(s)),
    "jaccard": lambda s, d: jaccard_components(d),
    "exact": lambda s, d: exact_dedup(d),
    "pii": lambda s, d: pseudonymise(d, "key"),
    "secrets": lambda s, d: scan(d),
    "sharding": lambda s, d: shard(d, shards=3),
    "mixing": lambda s, d: mix(d),
    "lines": lambda s, d: dedup_lines(d, least_docs=2),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(spark, docs, name):
    out = OPERATORS[name](spark, docs).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_change_nothing(spark, docs, name):
    more = docs.withColumns({c: F.lit("x") for c in CLASHES})
    key = lambda df: sorted(map(str, df.collect()))
    assert key(OPERATORS[name](spark, more)) == key(OPERATORS[name](spark, docs))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, docs, name):
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


def test_contamination(spark, docs):
    out = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in contamination(docs, items(spark)).collect())
    assert out == [(1, 1, 0), (2, 1, 0)]
    assert contamination(docs.limit(0), items(spark)).count() == 0
    assert contamination(docs, items(spark).limit(0)).count() == 0
    kept = uncontaminated(docs.withColumns({c: F.lit("x") for c in CLASHES}), items(spark))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in ROWS if r[0] not in (1, 2))


def test_conversations(spark):
    schema = "conv_id long, turn int, role string, text string, h string, depth string, origin string"
    rows = [(1, 0, "u", None, "x", "x", "x"), (1, 0, "u", "a longer text of the first turn", "x", "x", "x"), (None, None, None, "> a\nb", "x", "x", "x"), (1, 1, None, "> a longer text of the first turn", "x", "x", "x")]
    out = link(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 4
    assert [r["parent_turn"] for r in out if r["turn"] == 1] == [0]
    assert link(spark.createDataFrame([], schema)).count() == 0
