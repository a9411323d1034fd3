"""Quotation linking: from quoted passages to reply-ordered conversations without quotes [native].

Each message is parsed on its own into passages: runs of lines with one quote level. Passages and lines at level 0 are
what the message says itself; their hashes make an index of first occurrences, one row a passage and conversation, so a
join with it gives one origin at most to a quoted passage, however often the passage occurs. The latest origin of the
directly quoted passages is the message that is replied to. Roots and depths of threads come from pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACES, checkpoint, let

PREFIX = r"^(?:[ \t]*>)+"
#: A line that announces a quote and goes with it.
ATTRIBUTION = r"^\s*(?:On\b.*\bwrote|.*\b(?:schrieb|a écrit|escribió)\b.*)\s*:\s*$"


def parsed(text: Column) -> Column:
    """The lines of a text: level (number of > in front), raw (as it stands) and body (normalised, without the quote marks)."""

    def line(x: Column) -> Column:
        prefix = F.regexp_extract(x, PREFIX, 0)
        body = F.trim(F.regexp_replace(F.lower(F.substring(x, F.length(prefix) + 1, F.length(x))), r"[\x20\x09-\x0D]+", " "), F.lit(SPACES))
        return F.struct((F.length(prefix) - F.length(F.replace(prefix, F.lit(">"), F.lit("")))).alias("level"), x.alias("raw"), body.alias("body"))

    return F.transform(F.split(text, "\n", -1), line)


def passages(lines: Column) -> Column:
    """Runs of lines with one level, in order: level, body and its lines as parts; an empty line ends a run."""

    def begins(x: Column, y: Column, i: Column) -> Column:
        before = F.get(x, i - 1)
        return (y["body"] != "") & F.coalesce((before["body"] == "") | (before["level"] != y["level"]), F.lit(True))

    def run(x: Column, starts: Column, s: Column, k: Column) -> Column:
        own = F.filter(F.slice(x, s + 1, F.coalesce(F.get(starts, k + 1), F.size(x)) - s), lambda y: y["body"] != "")
        return let(F.transform(own, lambda y: y["body"]), lambda b: F.struct(F.get(x, s)["level"].alias("level"), F.array_join(b, " ").alias("body"), b.alias("parts")))

    def all_runs(x: Column) -> Column:
        starts = F.filter(F.transform(x, lambda y, i: F.when(begins(x, y, i), i)), lambda s: s.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda s, k: run(x, at, s, k)))

    return let(lines, all_runs)


def unquoted(lines: Column) -> Column:
    """The text at level 0, without lines that announce a quote, and without empty lines at its ends."""
    with_next = let(lines, lambda a: F.transform(a, lambda x, i: F.struct(x.alias("x"), F.coalesce(F.get(a, i + 1)["level"], F.lit(0)).alias("next"))))
    own = F.filter(with_next, lambda y: (y["x"]["level"] == 0) & ~((y["next"] > 0) & y["x"]["raw"].rlike(ATTRIBUTION)))
    return F.trim(F.array_join(F.transform(own, lambda y: y["x"]["raw"]), "\n"), F.lit(SPACES))


def _hash(body: Column) -> Column:
    return F.struct(F.xxhash64(body).alias("h"), F.xxhash64(F.lit(31), body).alias("g"))


def link(messages: DataFrame, least_chars: int = 8) -> DataFrame:
    """Link quoted passages to the messages of the same conversation that first said them, and order replies.

    Takes conv_id, turn, role and text. A quoted passage, or else its lines, is linked to the first earlier turn that has
    the same passage, line or whole text at level 0, compared in lower case and with single spaces. A
    passage of any length is linked to an equal passage or whole text; lines shorter than least_chars are neither linked
    nor linked to on their own. Returns conv_id, turn, role, n_quoted (passages), n_linked, parent_turn (the latest turn that a
    level-1 passage is linked to, or null), deepest_level, thread_turn (the first turn of the thread), depth, order_key
    and text without quotes. Ordering a conversation by order_key puts each thread together and each reply after what it
    replies to; without quotes it is the order of turns.

    A null or empty text has no passages. Messages with the same conv_id and turn count as one message when linked, and
    all stay. With a null conv_id or turn a message is not linked and orders last. Other columns are ignored, whatever
    their names. An empty table gives no rows.
    """
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    rows = rows.withColumn("_lines", parsed(F.col("_t"))).withColumn("_found", passages(F.col("_lines")))
    rows = rows.withColumn("_said", F.filter("_found", lambda p: p["level"] == 0)).withColumn("_quoted", F.filter("_found", lambda p: p["level"] > 0))
    known = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL")

    bodies = lambda a: F.transform(a, lambda p: p["body"])
    own_lines = F.transform(F.filter("_lines", lambda x: x["level"] == 0), lambda x: x["body"])
    whole = F.array(F.array_join(bodies(F.col("_said")), " "))
    long_enough = lambda b: F.length(b) >= least_chars
    sayings = F.array_distinct(F.concat(F.filter(F.concat(bodies(F.col("_said")), whole), lambda b: b != ""), F.filter(own_lines, long_enough)))
    said = known.select("conv_id", "turn", F.explode(F.transform(sayings, _hash)).alias("k"))
    index = said.groupBy("conv_id", F.col("k.h").alias("h"), F.col("k.g").alias("g")).agg(F.min("turn").alias("origin"))

    asked = known.filter(F.size("_quoted") > 0).select("conv_id", "turn", F.posexplode("_quoted").alias("at", "p"))
    tries = F.array_distinct(F.concat(F.array(F.col("p.body")), F.filter(F.col("p.parts"), long_enough)))
    asked = asked.select("conv_id", "turn", "at", F.col("p.level").alias("level"), F.posexplode(F.transform(tries, _hash)).alias("rank", "k"))
    asked = asked.select("conv_id", "turn", "at", "level", "rank", F.col("k.h").alias("h"), F.col("k.g").alias("g"))
    hits = asked.join(index, ["conv_id", "h", "g"]).filter("origin < turn")
    # Of each passage: the origin of the whole passage if there is one, else of its line with the latest origin.
    best = hits.groupBy("conv_id", "turn", "at", "level").agg(F.max(F.struct((F.col("rank") == 0).alias("whole"), "origin")).alias("b"))
    linked = best.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("b.origin"))).alias("parent_turn"))
    linked = checkpoint(linked)

    above = checkpoint(linked.filter("parent_turn IS NOT NULL").select("conv_id", "turn", F.col("parent_turn").alias("top"), F.lit(1).cast("long").alias("depth")))
    while True:
        upper = above.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("_top"), F.col("depth").alias("_more"))
        if above.join(upper, ["conv_id", "top"], "left_semi").isEmpty():
            break
        above = above.join(upper, ["conv_id", "top"], "left")
        above = checkpoint(above.select("conv_id", "turn", F.coalesce("_top", "top").alias("top"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")))

    out = rows.join(linked.join(above, ["conv_id", "turn"], "left"), ["conv_id", "turn"], "left")
    thread = F.coalesce("top", "turn")
    key = lambda c: F.format_string("%019d", c)
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.size("_quoted").cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent_turn",
        F.coalesce(F.array_max(F.transform("_quoted", lambda p: p["level"])), F.lit(0)).alias("deepest_level"),
        thread.alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.when(F.col("turn").isNull(), "~").otherwise(F.concat_ws(".", key(thread), key(F.coalesce("depth", F.lit(0)).cast("long")), key(F.col("turn")))).alias("order_key"),
        unquoted(F.col("_lines")).alias("text"),
    )
