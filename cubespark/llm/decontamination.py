"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with at most e edits still has one of its e + 1 pieces unchanged. So all pieces of all
items go into one Aho-Corasick automaton, each text is run through it once, and around each piece hit the item is
verified with Myers' bit-parallel edit distance, in which Python's long integers hold a whole column. Texts never move.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches

if TYPE_CHECKING:
    import ahocorasick

#: Items go into one automaton until they have so many characters; more items make further passes over the texts.
BLOCK_CHARS = 8_000_000


def normal(text: str | None) -> str:
    """Lower case, and one space for each run of white space."""
    return " ".join((text or "").lower().split())


def cut(item: str, edits: int) -> list[tuple[int, str]]:
    """The item in edits + 1 pieces of nearly equal length, with their positions."""
    n = edits + 1
    ends = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def pattern_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_match(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of the pattern anywhere in `text`, the first of equals; None beyond `most`."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (most + 1, -1)
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | x
        up, down = minus | (~(d | plus) & full), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full  # a match may begin anywhere: the upper row is all zeros
        plus, minus = down | (~(d | up) & full), up & d
        if score < best[0]:
            best = (score, i + 1)
    return best if best[1] >= 0 else None


def compiled(items: list[tuple[int, str]], rate: float) -> tuple[ahocorasick.Automaton, list]:
    import ahocorasick

    held, automaton, places = [], ahocorasick.Automaton(), {}
    for k, (item_id, text) in enumerate(items):
        edits = int(len(text) * rate)
        held.append((item_id, text, edits, pattern_masks(text)))
        for at, piece in cut(text, edits):
            places.setdefault(piece, []).append((k, at))
    for piece, where in places.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    return automaton, held


_BUILT: dict[str, tuple[ahocorasick.Automaton, list]] = {}


def built(key: str, items: list[tuple[int, str]], rate: float) -> tuple[ahocorasick.Automaton, list]:
    """compiled(), once for all tasks that a worker process runs on a block; it holds one block."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = compiled(items, rate)
    return _BUILT[key]


def search(automaton: ahocorasick.Automaton, held: list, text: str) -> dict[int, tuple[int, int]]:
    """Of each item that occurs in a normalised text: the least distance and where that occurrence ends."""
    found: dict[int, tuple[int, int]] = {}
    tried: set[tuple[int, int]] = set()
    for end, (size, where) in automaton.iter(text):
        for k, at in where:
            item_id, item, edits, masks = held[k]
            start = end + 1 - size - at
            if (k, start) in tried or found.get(item_id, (1, 0))[0] == 0:
                continue
            tried.add((k, start))
            low, high = max(0, start - edits), min(len(text), start + len(item) + edits)
            if text.startswith(item, start) if start >= 0 else False:
                match = (0, start + len(item))
            elif match := best_match(masks, len(item), text[low:high], edits):
                match = (match[0], low + match[1])
            if match and match < found.get(item_id, (edits + 1, 0)):
                found[item_id] = match
    return found


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, normalised, in blocks of at most BLOCK_CHARS characters (or one longer item)."""
    block, held = [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        if block and held + len(text) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((row["item_id"], text))
        held += len(text)
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, rate: float = 0.05) -> DataFrame:
    """Pairs of a document and a test item that occurs in it with at most rate * (its length) edits.

    Both are compared in lower case and with one space for each run of white space. An edit inserts, removes or replaces
    one character. Returns doc_id, item_id, distance (the least), match_end (where the first such occurrence ends in the
    normalised text) and item_chars. Clean documents have no row.

    Items of any length are searched; those of fewer than 1 / rate characters occur exactly or not at all, inside words
    too, so very short ones meet many texts by chance. Null and empty texts match nothing. Repeated rows of documents give repeated pairs; items with equal item_id count as one,
    with the best of their matches. Null ids of items are left out, null doc_ids stay. Other columns are ignored. Empty
    tables give no rows.

    Items are read in blocks of bounded size; each block is broadcast and makes one pass over the documents.
    """
    small_batches(docs)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = slim.select("doc_id").schema
    for name, kind in (("item_id", "long"), ("distance", "integer"), ("match_end", "long"), ("item_chars", "integer")):
        schema = schema.add(name, kind)
    out = None
    for block in blocks(items):
        shared, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def each(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            automaton, held = built(key, shared.value, rate)
            size = {item_id: len(item) for item_id, item, _, _ in held}
            for batch in batches:
                rows = []
                for i, text in enumerate(batch.column(1)):
                    if text.is_valid:
                        rows += [(i, k, d, e) for k, (d, e) in search(automaton, held, normal(text.as_py())).items()]
                if rows:
                    i, k, d, e = zip(*rows, strict=True)
                    yield pa.record_batch([batch.column(0).take(pa.array(i)), pa.array(k, pa.int64()), pa.array(d, pa.int32()), pa.array(e, pa.int64()), pa.array([size[x] for x in k], pa.int32())], names=schema.names)

        part = slim.mapInArrow(each, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def uncontaminated(docs: DataFrame, items: DataFrame, rate: float = 0.05) -> DataFrame:
    """The rows of `docs`, whole and in the same columns, in which no item occurs as contamination() has it."""
    small_batches(docs)
    at = docs.columns.index("text")
    for block in blocks(items):
        shared, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def each(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            automaton, held = built(key, shared.value, rate)
            for batch in batches:
                texts = (normal(t.as_py()) for t in batch.column(at))
                yield batch.filter(pa.array([not (t and search(automaton, held, t)) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(each, docs.schema)
    return docs
