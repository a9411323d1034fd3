"""The queries of this subpackage over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from ._shared import table
from .decontamination import contamination
from .exact_dedup import exact_dedup
from .line_dedup import dedup_lines
from .mixing import mix
from .ngram_jaccard import jaccard_components
from .pii import pseudonymise
from .quotations import link
from .secrets import ALLOWED_WORDS, BASE, LIMITS, WINDOW, XLOGX, most_sum, scan
from .sharding import shard
from .toxicity import toxicity

#: The key of the query's pseudonyms. Users of pseudonymise() pass their own, which they keep secret.
DEMO_KEY = "demo key of the registered query"


def op1_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_jaccard(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), width=5, percent=80)


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_pii_pseudonyms(spark, sf_dir):
    return pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)


def op5_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def op7_quotation_linking(spark, sf_dir):
    return link(table(spark, sf_dir, "conversations"))


def op8_sharding(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"), shards=40)


def op9_mixing(spark, sf_dir):
    """Exponents are sought for a repetition of 1.25 at most; the budget is the number of tokens there are."""
    return mix(table(spark, sf_dir, "documents"), repetition=1.25)


def op10_line_dedup(spark, sf_dir):
    found = dedup_lines(table(spark, sf_dir, "documents"), least_chars=40, least_docs=5)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_ngram_jaccard,
        op3_exact_dedup,
        op4_pii_pseudonyms,
        op5_decontamination,
        op6_secret_scan,
        op7_quotation_linking,
        op8_sharding,
        op9_mixing,
        op10_line_dedup,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _secrets_sql() -> str:
    """SQL of op6_secret_scan: every window's characters are counted anew, where the operator changes counts step by step."""
    blank = "text"
    for word in ALLOWED_WORDS:
        blank = f"regexp_replace({blank}, '(?i){word}', '{' ' * len(word)}', 'g')"
    kinds = [(name, pattern.replace("'", "''"), group, least, "text") for name, pattern, group, least in BASE]
    kinds.append(("entropy", "[A-Za-z0-9+/_=-]{20,}", 0, WINDOW, blank))
    found = " UNION ALL ".join(
        f"""SELECT id, {i} AS kind_order, '{name}' AS kind, {least} AS least, regexp_extract_all(x, '{pattern}') AS ms,
                   regexp_extract_all(x, '{pattern}', {group}) AS vs, string_split_regex(x, '{pattern}') AS ps FROM (SELECT id, {text} AS x FROM t)"""
        for i, (name, pattern, group, least, text) in enumerate(kinds)
    )
    return f"""
        WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
        f AS ({found}),
        u AS (SELECT id, kind_order, kind, least, unnest(ms) AS m, unnest(vs) AS v, unnest(ps[:len(ms)]) AS p, generate_subscripts(ms, 1) AS i FROM f WHERE len(ms) > 0),
        s AS MATERIALIZED (SELECT *, (sum(length(p) + length(m)) OVER (PARTITION BY id, kind_order ORDER BY i) - length(m))::BIGINT AS first FROM u),
        b AS (SELECT id, kind_order, kind, first, first + length(m) AS last FROM s WHERE kind <> 'entropy' AND length(v) >= least),
        c AS (SELECT id, i, first, m, CASE WHEN regexp_full_match(m, '[0-9a-fA-F]+') THEN {most_sum(LIMITS["hex"])} WHEN regexp_matches(m, '[0-9]') THEN {most_sum(LIMITS["base64"])}
                                      ELSE {most_sum(LIMITS["letters"])} END AS most
              FROM s WHERE kind = 'entropy' AND NOT regexp_full_match(m, '[0-9]+') AND replace(m, m[1], '') <> ''
                       AND NOT regexp_full_match(m, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}')),
        w AS (SELECT id, i, first, most, k, unnest(string_split(substr(m, k + 1, {WINDOW}), '')) AS ch FROM (SELECT *, unnest(range(length(m) - {WINDOW - 1})) AS k FROM c)),
        n AS (SELECT id, i, first, most, k, ch, count(*) AS n FROM w GROUP BY ALL),
        h AS (SELECT id, i, first, k FROM n GROUP BY id, i, first, k, most HAVING sum({XLOGX}[n + 1]) <= most),
        e AS (SELECT id, {len(BASE)} AS kind_order, 'entropy' AS kind, first + min(k) AS first, first + max(k) + {WINDOW} AS last FROM h GROUP BY id, i, h.first),
        a AS (SELECT *, kind || ':' || first || ':' || last AS span FROM (SELECT * FROM b UNION ALL SELECT e.* FROM e WHERE NOT EXISTS (FROM b WHERE b.id = e.id AND b.first <= e.first AND b.last >= e.last)))
        SELECT any_value(t.doc_id) AS doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k[0]}') AS n_{k[0]}" for k in kinds)},
               sha256(coalesce(string_agg(span, ',' ORDER BY first, kind_order) FILTER (WHERE kind <> 'entropy'), '')) AS base_sha256,
               coalesce(string_agg(span, ',' ORDER BY first, kind_order), '') AS spans
        FROM t LEFT JOIN a USING (id) GROUP BY id"""


ORACLE_SQL = {
    "op2_ngram_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS n_words
                             FROM (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
        five AS (SELECT doc_id, pos, n_words, word || coalesce(' ' || lead(word, 1) OVER p, '') || coalesce(' ' || lead(word, 2) OVER p, '')
                        || coalesce(' ' || lead(word, 3) OVER p, '') || coalesce(' ' || lead(word, 4) OVER p, '') AS shingle
                 FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
        s AS (SELECT DISTINCT doc_id, shingle FROM five WHERE pos <= greatest(n_words - 4, 1)),
        d AS (SELECT doc_id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS same FROM s GROUP BY doc_id),
        c AS MATERIALIZED (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY same) AS class_id FROM d),
        m AS MATERIALIZED (SELECT s.doc_id, s.shingle, c.n FROM s JOIN c USING (doc_id) WHERE c.doc_id = c.class_id),
        l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM m a JOIN m b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
              WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        r AS (SELECT a AS node, a AS origin FROM l UNION SELECT l.b, r.origin FROM r JOIN l ON l.a = r.node WHERE r.origin < l.b),
        g AS (SELECT node AS class_id, min(origin) AS component_id FROM r GROUP BY node),
        k AS (SELECT a AS class_id, count(*) AS n_links FROM l GROUP BY a)
        SELECT x.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(g.component_id, c.class_id, x.doc_id) AS component_id,
               coalesce(c.class_id, x.doc_id) AS class_id, coalesce(k.n_links, 0) AS n_links
        FROM documents x LEFT JOIN c USING (doc_id) LEFT JOIN g USING (class_id) LEFT JOIN k USING (class_id)""",
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op6_secret_scan": _secrets_sql(),
    "op7_quotation_linking": """
        WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn::BIGINT AS turn, role, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations),
        raw AS (SELECT id, conv_id, turn, unnest(lines) AS raw, generate_subscripts(lines, 1) AS pos FROM m),
        cut AS (SELECT *, regexp_extract(raw, '^(?:[ \\t]*>)+') AS marks FROM raw),
        v AS (SELECT id, conv_id, turn, pos, raw, (length(marks) - length(replace(marks, '>', '')))::INT AS level,
                     trim(regexp_replace(lower(substr(raw, length(marks) + 1)), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS body FROM cut),
        b AS (SELECT *, coalesce(lead(level) OVER w, 0) AS next_level,
                     CASE WHEN body <> '' AND coalesce(lag(body) OVER w = '' OR lag(level) OVER w <> level, true) THEN 1 ELSE 0 END AS starts
              FROM v WINDOW w AS (PARTITION BY id ORDER BY pos)),
        r AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY pos) AS run FROM b),
        p AS MATERIALIZED (SELECT id, conv_id, turn, run, min(level) AS level, string_agg(body, ' ' ORDER BY pos) AS body FROM r WHERE body <> '' GROUP BY ALL),
        said AS (SELECT conv_id, turn, body FROM p WHERE level = 0
                 UNION ALL SELECT conv_id, turn, string_agg(body, ' ' ORDER BY run) FROM p WHERE level = 0 GROUP BY id, conv_id, turn
                 UNION ALL SELECT conv_id, turn, body FROM r WHERE level = 0 AND length(body) >= 8),
        firsts AS MATERIALIZED (SELECT conv_id, body, min(turn) AS origin FROM said GROUP BY conv_id, body),
        tries AS (SELECT conv_id, turn, run, level, body, 1 AS whole FROM p WHERE level > 0
                  UNION ALL SELECT r.conv_id, r.turn, r.run, r.level, r.body, 0 FROM r WHERE level > 0 AND length(body) >= 8),
        best AS (SELECT t.conv_id, t.turn, t.run, t.level, coalesce(max(f.origin) FILTER (WHERE whole = 1), max(f.origin)) AS origin
                 FROM tries t JOIN firsts f ON t.conv_id = f.conv_id AND t.body = f.body AND f.origin < t.turn GROUP BY t.conv_id, t.turn, t.run, t.level),
        links AS MATERIALIZED (SELECT conv_id, turn, count(*) AS n_linked, max(origin) FILTER (WHERE level = 1) AS parent_turn FROM best GROUP BY conv_id, turn),
        up AS (SELECT conv_id, turn, parent_turn AS top, 1::BIGINT AS depth FROM links WHERE parent_turn IS NOT NULL
               UNION ALL SELECT up.conv_id, up.turn, x.parent_turn, up.depth + 1 FROM up JOIN links x ON x.conv_id = up.conv_id AND x.turn = up.top WHERE x.parent_turn IS NOT NULL),
        threads AS (SELECT conv_id, turn, min(top) AS top, max(depth) AS depth FROM up GROUP BY conv_id, turn),
        quoted AS (SELECT id, count(*) AS n_quoted, max(level) AS deepest_level FROM p WHERE level > 0 GROUP BY id),
        own AS (SELECT id, trim(string_agg(raw, chr(10) ORDER BY pos), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM r
                WHERE level = 0 AND NOT (next_level > 0 AND regexp_matches(raw, '^\\s*(?:On\\b.*\\bwrote|.*\\b(?:schrieb|a écrit)\\b.*|.*\\bescribió(?:[^\\pL\\pN_].*)?)\\s*:\\s*$')) GROUP BY id)
        SELECT m.conv_id, m.turn, m.role, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked, parent_turn, coalesce(deepest_level, 0) AS deepest_level,
               coalesce(top, m.turn) AS thread_turn, coalesce(depth, 0) AS depth,
               CASE WHEN m.turn IS NULL THEN '~' ELSE printf('%019d.%019d.%019d', coalesce(top, m.turn), coalesce(depth, 0), m.turn) END AS order_key,
               coalesce(own.text, '') AS text
        FROM m LEFT JOIN links USING (conv_id, turn) LEFT JOIN threads USING (conv_id, turn) LEFT JOIN quoted USING (id) LEFT JOIN own USING (id)""",
    "op10_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
        c AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key),
        m AS (SELECT k.doc_id, k.pos, k.line, coalesce(c.n >= 5 AND k.doc_id <> c.keep, false) AS dropped FROM k LEFT JOIN c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
}
