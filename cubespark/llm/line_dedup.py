"""Line deduplication by range-partitioned hashes [native].

Lines that are long enough become slim rows (hash, document, position). These are range-partitioned by hash with
document and position as secondary sort keys, so equal lines stream past next to each other, the largest document
first, and a line that fills several ranges is shared among them. The runs are summed up per range, the sums of a line
that several ranges hold are merged, and what comes back to the documents is a run-length bitmap of the lines to keep.
The text itself is never sorted and moves once, to meet its bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACES, ascii_lower, checkpoint


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def keep_runs(drops: Column, n_lines: Column) -> Column:
    """The keep bitmap of a document as runs (start, length) of kept lines, from the sorted positions of dropped ones."""
    ends = F.concat(drops, F.array(n_lines))
    starts = F.concat(F.array(F.lit(0)), F.transform(drops, lambda p: p + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """Rows (doc_id, _r, _s, _drops): sorted positions of the lines that `docs` loses. Documents that lose none have no row.

    `docs` must have two numbers _r and _s that with doc_id tell its rows apart.
    """
    row = ["doc_id", "_r", "_s"]
    key = F.trim(F.col("_line"), F.lit(SPACES))
    slim = (
        docs.select(*row, F.posexplode(lines(F.col("text"))).alias("_pos", "_line"))
        .filter(F.length(F.col("_line")) >= least_chars)
        .withColumn("_key", key)
        .filter(F.length("_key") >= least_chars)
        .select(*row, "_pos", ascii_lower(F.col("_key")).alias("_key"))
        # Two hashes with different seeds: 128 bits, so that no collision is to be expected at 10^13 lines.
        .select(*row, "_pos", F.xxhash64("_key").alias("_h"), F.xxhash64(F.lit(977), "_key").alias("_g"))
    )
    slim = checkpoint(slim)
    ranges = [F.col("_h"), F.col("_g"), *map(F.desc, row)]
    ranged = slim.repartitionByRange(*ranges).sortWithinPartitions(*ranges, "_pos")
    # The ranges hold all of (line, document), so the first occurrences need no exchange. Then one row a line leaves each
    # range that it fills, and runs that cross a border meet.
    first = ranged.groupBy("_h", "_g", *row).agg(F.min("_pos").alias("_first"))
    held = first.groupBy("_h", "_g").agg(F.max(F.struct(*row)).alias("_keep"), F.count("*").alias("_docs"))
    held = checkpoint(held.filter(F.col("_docs") >= least_docs).select("_h", "_g", "_keep"))
    lost = slim.join(held, ["_h", "_g"]).filter(~F.struct(*row).eqNullSafe(F.col("_keep")))
    return lost.groupBy(*row).agg(F.sort_array(F.collect_set("_pos")).alias("_drops"))


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """Drop lines that many documents share, except in the last document holding them.

    A text is split at \\n; a line's key is the line without white space (space, U+0009 to U+000D) at both ends and with
    A-Z in lower case. Keys of at least `least_chars` code points that at least `least_docs` rows hold lose all their
    lines but those of the row with the largest doc_id. The columns of `docs` are replaced by doc_id, text (what stays),
    n_lines (before), n_dropped and keep_runs, the run-length bitmap of kept lines.

    A null or empty text is one empty line. Rows with equal doc_id count as documents of their own; among them the one
    with the larger hashes of its text stays, and fully equal rows lose their lines together or keep them together. A
    null doc_id is below all others. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).withColumns({"_r": F.xxhash64("text"), "_s": F.xxhash64(F.lit(977), "text")})
    lost = bitmaps(base, least_chars, least_docs).withColumnsRenamed({"doc_id": "_id", "_r": "_r2", "_s": "_s2"})
    # Rows of the slim side are few against the text; a shuffled hash join spares the sort of the texts.
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_r") == F.col("_r2")) & (F.col("_s") == F.col("_s2"))
    joined = base.join(lost.hint("shuffle_hash"), same, "left")
    split = joined.withColumn("_lines", lines(F.col("text"))).withColumn("n_lines", F.size("_lines").cast("long"))
    drops = F.coalesce("_drops", F.array().cast("array<int>"))
    runs = keep_runs(drops, F.size("_lines"))
    kept = F.array_join(F.flatten(F.transform(runs, lambda r: F.slice("_lines", r["start"] + 1, r["length"]))), "\n")
    changed = F.size(drops) > 0
    return split.select(
        "doc_id",
        F.when(changed, kept).otherwise(F.col("text")).alias("text"),
        "n_lines",
        F.size(drops).cast("long").alias("n_dropped"),
        runs.alias("keep_runs"),
    )
