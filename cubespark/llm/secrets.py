"""Secret scans: fixed patterns, and Shannon entropy in sliding windows over candidate strings [native].

Spans come from the texts by splitting at a pattern and adding up the lengths of pieces and matches. For each candidate a
fold moves a window over its characters: the counts of the characters in the window and the sum of c * log2(c) over them
change by the character that enters and the one that leaves, nothing is counted anew. The sums are whole numbers (a
millionth of a bit), so every engine finds the same windows. What a window must reach depends on the candidate's
character class. Windows that touch a word of the allow-list are suppressed, and candidates that are as a whole of an
allowed form. All work on a text grows with its length, or at most with the root of the number of matches as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import let, sums_before

#: The base patterns and the length that a match (for assign: its value) must have.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
#: The same spans, since a run of hex digits or of an access key's characters is taken whole or not at all; but found
#: without making a row of each short run.
LONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Bits a character that a window must reach, by what the candidate holds: of 20 random characters, hex has about 3.4, base64
#: about 4.0. Long words and paths without a digit have up to 3.8, so those need 17 different characters of 20.
LIMITS = {"hex": 3.0, "letters": 4.0, "base64": 3.75}
#: In a candidate, these in any case end it like a space does.
ALLOWED_WORDS = ("example", "sample", "dummy", "placeholder", "xxxx")
ALLOWED = (
    r"^[0-9]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^(.)\1+$",
)

MICRO = 1_000_000
XLOGX = [0] + [round(c * math.log2(c) * MICRO) for c in range(1, WINDOW + 2)]


def most_sum(bits: float) -> int:
    """The largest sum of c * log2(c) with which a window has so many bits a character."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * MICRO)


def _placed(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches in order: start, end (code points), whole match and the value of `group`."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("p"), whole.alias("m"), value.alias("v"))
    kind = "array<struct<start:int,end:int,m:string,v:string>>"

    def span(x: Column, before: Column) -> Column:
        start = before + F.length(x["p"])
        return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("m"), x["v"].alias("v"))

    found = let(rows, lambda r: F.zip_with(r, sums_before(F.transform(r, lambda x: F.length(x["p"]) + F.length(x["m"]))), span))
    return F.when(text.rlike(pattern), found.cast(kind)).otherwise(F.array().cast(kind))


def hot_part(text: Column, limit: Column) -> Column:
    """(first, last) window starts whose sum of c * log2(c) is at most `limit`; -1 if there is none.

    The counts of the window's characters are one string, a letter a character of the alphabet: A for 0, B for 1.
    """
    table = F.array(*map(F.lit, XLOGX)).cast("array<bigint>")
    kind = "struct<n:string,s:bigint,i:int,first:int,last:int>"
    zero = F.struct(F.lit("A" * len(ALPHABET)).alias("n"), F.lit(0).alias("s"), F.lit(0).alias("i"), F.lit(-1).alias("first"), F.lit(-1).alias("last")).cast(kind)
    places = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    move = lambda new, old: F.struct(new.alias("new"), old.alias("old"))
    moves = let(places, lambda p: F.zip_with(p, F.slice(F.concat(F.array_repeat(F.lit(0), WINDOW), p), 1, F.size(p)), move))
    held = lambda n, at: F.ascii(F.substring(n, at, F.lit(1))) - 65
    put = lambda n, at, count: F.overlay(n, F.char(count + 65), at, 1)

    def step(state: Column, m: Column) -> Column:
        # The entering character first: c -> c + 1. Then the leaving one, whose count may be the one just raised.
        c = held(state["n"], m["new"])
        raised = put(state["n"], m["new"], c + 1)
        added = state["s"] + F.element_at(table, c + 2) - F.element_at(table, c + 1)
        o = held(raised, m["old"])
        s = F.when(m["old"] > 0, added + F.element_at(table, o) - F.element_at(table, o + 1)).otherwise(added)
        n = F.when(m["old"] > 0, put(raised, m["old"], o - 1)).otherwise(raised)
        hot = (state["i"] >= WINDOW - 1) & (s <= limit)
        at = state["i"] - (WINDOW - 1)
        first = F.when((state["first"] < 0) & hot, at).otherwise(state["first"])
        return F.struct(n.alias("n"), s.alias("s"), (state["i"] + 1).alias("i"), first.alias("first"), F.when(hot, at).otherwise(state["last"]).alias("last")).cast(kind)

    return F.aggregate(moves, zero, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def blanked(text: Column, words: tuple[str, ...]) -> Column:
    """The text with as many spaces instead of each of the words, in any case."""
    out = text
    for w in words:
        out = F.regexp_replace(out, f"(?i){w}", " " * len(w))
    return F.when(text.rlike("(?i)" + "|".join(words)), out).otherwise(text) if words else text


def _named(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame, words: tuple[str, ...] = ALLOWED_WORDS, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Spans of secrets in whole texts.

    Returns doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256 and spans. A span is kind:start:end in code points,
    the end exclusive; spans are ordered by start, then assign, access, hex, entropy, and joined by commas. base_sha256 is
    the lower-case hex SHA-256 of the spans of the first three kinds, joined likewise. `assign` is the whole assignment.

    An entropy span runs from the first to the last window over its limit in one candidate: a run of 20 or more letters,
    digits and +/_=-, which a word of `words` ends as well. Candidates that match a pattern of `allowed` are left out, and
    spans that a base span covers. Base spans always stay.

    A null text counts as empty and has no spans. Rows are scanned on their own: repeated rows and ids stay, null ids too.
    Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    for name, pattern, group, least in BASE:
        found = F.filter(_placed(F.col("_t"), LONG.get(name, pattern), group), _at_least(least))
        rows = rows.withColumn(f"_{name}", found)
    tried = F.filter(_placed(blanked(F.col("_t"), words), CANDIDATE), lambda x: ~_any(x["m"], allowed))
    most = {k: F.lit(most_sum(v)).cast("bigint") for k, v in LIMITS.items()}
    limit = lambda m: F.when(m.rlike("^[0-9a-fA-F]+$"), most["hex"]).when(m.rlike("[0-9]"), most["base64"]).otherwise(most["letters"])
    rows = rows.withColumn("_hot", F.transform(tried, lambda x: F.struct(x["start"].alias("at"), hot_part(x["m"], limit(x["m"])).alias("w"))))
    hot = F.transform(F.filter("_hot", lambda x: x["w"]["first"] >= 0), lambda x: F.struct((x["at"] + x["w"]["first"]).alias("start"), (x["at"] + x["w"]["last"] + WINDOW).alias("end")))
    base = F.array_sort(F.concat(*[_named(F.col(f"_{name}"), name, i) for i, (name, *_) in enumerate(BASE)]))
    rows = rows.withColumn("_base", base).withColumn("_more", hot)
    rows = rows.withColumn("_more", F.filter("_more", lambda x: ~F.exists("_base", lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"]))))
    every = F.array_sort(F.concat("_base", _named(F.col("_more"), "entropy", len(BASE))))
    return rows.select(
        "doc_id",
        *[F.size(f"_{name}").cast("long").alias(f"n_{name}") for name, *_ in BASE],
        F.sha2(_joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.size("_more").cast("long").alias("n_entropy"),
    )


def _at_least(n: int):
    return lambda x: F.length(x["v"]) >= n


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out
