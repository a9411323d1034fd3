"""Exact Jaccard join of word-shingle sets by PartEnum signatures.

Two sets of a and b shingles with Jaccard similarity t or more differ in at most d = (1 - t) / (1 + t) * (a + b) shingles.
The domain of shingles is cut into partitions of three cells each, and each two of a partition's cells make a signature:
the hash of a set's content there. A partition is lost only if the sets differ in two of its cells, so with more than
d / 2 partitions a similar pair shares a signature. As d depends on the sizes, sets are put into size bands; a set takes
the scheme of its own band and of each lower band that may hold a partner.

Only cells with content make signatures. A set in which d differences could fall on all that has content also gives the
shingles of its prefix (the first in hash order; sets that are similar enough share one of those). So no link is lost.

Rows of equal signature form a bucket. What one task sees of a bucket leaves it as one row (the rest go round the
shuffle), so a bucket is never larger in one place than the number of tasks. Buckets with the same members are one.
No pair ever leaves a task. First, sizes and parity sketches of a bucket's members are compared block by block; what a
task passes on is which of them hang together by pairs that may be similar, a row a member at most. Those groups hold
all links, and texts that only share a passage are in none. Then the sets of a group's members meet, again block by
block, their intersections are counted by matrix products, and the result is again a row a member: the least member that
it reaches by links, and its number of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bloom import bits_for, build, passes
from ._shared import checkpoint, small_batches
from ._words import U, mix64, pieces, shingles, words

FLUSH = 1_000_000  # signatures that a task holds before it passes them on
RANGE = 1_500_000  # signatures, about, that meet in one place at once
BLOCK = 512  # members of a group that are compared with as many others at once
BLOCK_SHINGLES = 500_000  # and so many shingles in all of them, about
COLUMNS = 4096  # shingles by which sets are multiplied at once
SKETCH_WORDS = 8
GROWTH = 1.6  # of the size bands
LOW = U((1 << 48) - 1)


def most_apart(a: int, b: int, percent: int) -> int:
    """The largest number of shingles in one of two sets of sizes a and b alone."""
    return (100 - percent) * (a + b) // (100 + percent)


@lru_cache(maxsize=None)
def band(i: int) -> tuple[int, int]:
    """Sizes [low, high) of the i-th band."""
    low = 1 if i == 0 else band(i - 1)[1]
    return low, max(low + 1, int(np.ceil(low * GROWTH)))


@lru_cache(maxsize=None)
def scheme(i: int, percent: int) -> tuple[int, int, int, np.ndarray]:
    """Of band i: first-level partitions, cells in each, cells left out, and the subsets as columns of 0 and 1."""
    top = band(i)[1] - 1
    apart = most_apart(top, 100 * top // percent, percent)
    cells, out = (3, 1) if apart >= 2 else (1, 0)
    parts = apart // (out + 1) + 1
    parts += (parts * 3 + 99) // 100 + 1 if apart else 0
    subsets = np.zeros((cells, len(list(combinations(range(cells), cells - out)))), dtype=U)
    for column, chosen in enumerate(combinations(range(cells), cells - out)):
        subsets[list(chosen), column] = 1
    return parts, cells, out, subsets


@lru_cache(maxsize=100_000)
def schemes(size: int, percent: int) -> tuple[int, ...]:
    """Bands whose sets a set of this size may be similar to as the larger one, its own included."""
    own = 0
    while band(own)[1] <= size:
        own += 1
    return tuple(i for i in range(own, -1, -1) if percent * size <= 100 * (band(i)[1] - 1))


def signatures(x: np.ndarray, percent: int) -> np.ndarray:
    """All signatures of a set, given as sorted distinct 64-bit hashes."""
    out, size = [], len(x)
    for i in schemes(size, percent):
        parts, cells, left_out, subsets = scheme(i, percent)
        cell = ((x >> U(32)) * U(parts * cells)) >> U(32)  # rises with x: a cell is a run
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        at = cell[starts].astype(np.int64)
        content = np.zeros(parts * cells, dtype=U)
        content[at] = mix64(np.add.reduceat(x, starts) + U((i + 1) * 0xD1B54A32D192ED03 % 2**64) + cell[starts])
        content = content.reshape(parts, cells)
        filled = (content != 0).astype(U)
        own = content @ subsets if cells > 1 else content
        label = U(1) + np.arange(own.size, dtype=U).reshape(own.shape)
        some = (filled @ subsets if cells > 1 else filled) > 0
        out.append(mix64(own + label * U(0x8CB92BA72F3D8DD7))[some])
        high = band(i)[1] - 1
        apart = most_apart(size, 100 * size // percent if size <= high else high, percent)
        # A partition with k filled cells is lost by min(k, left_out + 1) differences and no fewer.
        if int(np.minimum(filled.sum(axis=1), U(left_out + 1)).sum()) <= apart:
            prefix = size - -(-percent * size // 100) + 1
            out.append(mix64(x[:prefix] ^ U((i + 1) * 0xA24BAED4963EE407 % 2**64)))
    return np.concatenate(out)


def fingerprint(x: np.ndarray) -> int:
    """64 bits of the whole set. Among N sets, N^2 / 2^65 wrongly equal ones are to be expected."""
    return int(mix64(np.array([mix64(x).sum(dtype=U)], dtype=U) + U(len(x))).view(np.int64)[0])


def sketch(x: np.ndarray) -> np.ndarray:
    """For each of some classes of shingles, whether the set has an odd number: sets differ at least as much as these do.

    There are as many classes as shingles, rounded up to a power of two, and 512 at least; the class is the low bits.
    """
    bits = max(64 * SKETCH_WORDS, 1 << (len(x) - 1).bit_length())
    return np.packbits(np.bincount((x & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1)


def folded(sk: np.ndarray, size: int = 8 * SKETCH_WORDS) -> np.ndarray:
    """The same sketch with fewer classes, in `size` bytes."""
    return np.bitwise_xor.reduce(sk.reshape(-1, size), axis=0)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for low, high in pieces(batch.column(1)):
        yield low, shingles(*words(batch.column(1).slice(low, high - low)), width)


def _features(docs: DataFrame, width: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp, wide = [], [], []
            for _, sets in _sets(batch, width):
                n += [len(x) for x in sets]
                fp += [fingerprint(x) if len(x) else None for x in sets]
                wide += [sketch(x).tobytes() if len(x) else None for x in sets]
            made = {"n": pa.array(n, pa.int64()), "fp": pa.array(fp, pa.int64()), "wide": pa.array(wide, pa.binary())}
            yield pa.record_batch({"doc_id": batch.column(0), "r": batch.column(2), "s": batch.column(3), **made})

    return docs.mapInArrow(each, "doc_id long, r long, s long, n long, fp long, wide binary")


def _buckets(docs: DataFrame, width: int, percent: int, bits: int) -> DataFrame:
    """(sig, fp) of all signatures that two different sets have at least; a row may come more than once.

    Signatures meet by their first `bits` bits. A task packs those that go one way into one row: 6 bytes each, behind
    the first bits, and the set's fingerprint once for all its signatures that go there. (48 bits after the first ones
    are enough: signatures that are equal by chance make needless comparisons, not wrong links.)
    """
    shift = U(64 - bits)
    kept = U((((1 << bits) - 1) << (64 - bits)) | int(LOW))

    def passed_on(sigs: list[np.ndarray], fps: list[int]) -> Iterator[pa.RecordBatch]:
        sig, own = np.concatenate(sigs) & kept, np.repeat(np.arange(len(sigs)), [len(s) for s in sigs])
        fp = np.array(fps, dtype=np.int64)
        order = np.argsort(sig, kind="stable")
        same = sig[order[1:]] == sig[order[:-1]]
        later = np.concatenate(([False], same))
        # Of a bucket that this task knows to have members, one goes to meet others, and all are members already.
        shared = order[later | np.concatenate((same, [False]))]
        rows: list[tuple[int, bytes, bytes, bytes]] = []
        for low in range(0, len(shared), 1 << 16):
            some = shared[low : low + (1 << 16)]
            rows.append((-1 - int(fp[own[some[0]]] & 0xFFFFFF), sig[some].tobytes(), fp[own[some]].tobytes(), b""))
        first = np.sort(order[~later])  # by set again
        way = (sig[first] >> shift).astype(np.int32)
        first = first[np.argsort(way, kind="stable")]
        way = (sig[first] >> shift).astype(np.int32)
        for some in np.split(first, np.flatnonzero(np.diff(way)) + 1):
            s, sets = sig[some], own[some]
            heads = np.flatnonzero(np.concatenate(([True], sets[1:] != sets[:-1])))
            counts = np.diff(np.concatenate((heads, [len(sets)]))).astype(np.uint32)
            packed = (s & U(0xFFFFFFFF)).astype(np.uint32).tobytes() + ((s >> U(32)) & U(0xFFFF)).astype(np.uint16).tobytes()
            rows.append((int(s[0] >> shift), packed, fp[sets[heads]].tobytes(), counts.tobytes()))
        for low in range(0, len(rows), 64):
            way, *rest = zip(*rows[low : low + 64], strict=True)
            yield pa.record_batch([pa.array(way, pa.int32()), *(pa.array(c, pa.binary()) for c in rest)], names=["way", "sigs", "fps", "counts"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, fps, held = [], [], 0
        for batch in batches:
            for _, sets in _sets(batch, width):
                for x in sets:
                    if not len(x) or (fp := fingerprint(x)) in seen:
                        continue
                    seen.add(fp)
                    sigs.append(signatures(x, percent))
                    fps.append(fp)
                    held += len(sigs[-1])
                    if held >= FLUSH:
                        yield from passed_on(sigs, fps)
                        sigs, fps, held = [], [], 0
        if held:
            yield from passed_on(sigs, fps)

    def met(way: int, held: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        sigs, fps = [], []
        for packed, fp, counts in held:
            n = len(packed) // 6
            low, high = np.frombuffer(packed, dtype=np.uint32, count=n), np.frombuffer(packed, dtype=np.uint16, offset=4 * n)
            sigs.append(low.astype(U) | high.astype(U) << U(32))
            fps.append(np.repeat(np.frombuffer(fp, dtype=np.int64), np.frombuffer(counts, dtype=np.uint32)))
        sig, fp = np.concatenate(sigs), np.concatenate(fps)
        order = np.argsort(sig, kind="stable")
        sig, fp = sig[order], fp[order]
        same = sig[1:] == sig[:-1]
        shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        sig, fp = sig[shared], fp[shared]
        order = np.lexsort((fp, sig))
        sig, fp = sig[order], fp[order]
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])))[: len(sig)]
        sig, fp = sig[new], fp[new]
        same = sig[1:] == sig[:-1]
        shared = (np.concatenate(([False], same)) | np.concatenate((same, [False])))[: len(sig)]
        whole = sig[shared] | U(way) << shift
        return pa.record_batch({"sig": pa.array(whole.view(np.int64)), "fp": pa.array(fp[shared])})

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way, held = None, []
        for batch in batches:
            for w, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if w < 0:
                    yield pa.record_batch({"sig": pa.array(np.frombuffer(packed[0], dtype=np.int64)), "fp": pa.array(np.frombuffer(packed[1], dtype=np.int64))})
                    continue
                if w != way and held:
                    yield met(way, held)
                    held = []
                way = w
                held.append(packed)
        if held:
            yield met(way, held)

    packed = docs.mapInArrow(each, "way int, sigs binary, fps binary, counts binary")
    return packed.repartition("way").sortWithinPartitions("way").mapInArrow(runs, "sig long, fp long")


def components(links: DataFrame, rows_per_task: int = 50_000) -> DataFrame:
    """(id, component): the smallest id that a node reaches over links (a, b). By alternating large and small stars.

    A round is as many tasks as the links need, not as many as the session has shuffle partitions: rounds are several,
    and each leaves files behind for each task.
    """
    edges = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    tasks = max(8, -(-edges.count() // rows_per_task))
    kept = lambda df: checkpoint(df.coalesce(tasks))
    edges = kept(edges)
    while True:
        # Done when each node has one edge, to a node that has none: all are stars.
        n, ends = edges.agg(F.count("*"), F.count_distinct("u")).first()
        if n == ends and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        both = edges.union(edges.select("v", "u")).coalesce(tasks)
        least = kept(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        large = kept(large.distinct())
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v"))
        edges = kept(small.filter("u != v").distinct())


def _blocks() -> Column:
    """Into how many blocks a group's rows (with their numbers of shingles, n) are dealt."""
    return F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("_blocks")


def _dealt(members: DataFrame, payload: str) -> DataFrame:
    """Rows (key, _blocks, fp, n, payload) to each pair of blocks of their group, sorted by it."""
    dealt = members.withColumn("_own", F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select("key", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "fp", "n", payload)
    return dealt.repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j")


def _pairs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """For each pair of blocks: fingerprints in order, n, payloads, and which of them are to be compared with which."""

    def done(held: list[list]) -> tuple:
        own, fps, n = (np.array(c, dtype=np.int64) for c in held[:3])
        fps, at = np.unique(fps, return_index=True)  # repeated rows of documents repeat sets
        own = own[at]
        left = np.flatnonzero(own == own.min())
        right = left if own.min() == own.max() else np.flatnonzero(own == own.max())
        return fps, n[at], [held[3][i] for i in at], left, right

    key, held = None, [[], [], [], []]
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        rows = [batch.column(i).to_pylist() for i in range(3, 7)]
        cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        for low, high in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            if keys[low] != key and held[0]:
                yield done(held)
                held = [[], [], [], []]
            key = keys[low]
            for c, more in zip(held, rows, strict=True):
                c += more[low:high]
    if held[0]:
        yield done(held)


def _joined(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels, each the smallest place that is reached, after the places p and q are linked one by one."""
    while True:
        a, b = label[p], label[q]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]


def _sizes_fit(n: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    a, b = n[left][:, None], n[right][None, :]
    return (np.abs(a - b) <= (100 - percent) * (a + b) // (100 + percent)) & (left[:, None] != right[None, :])


def _hang_together(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the members of a bucket as those pairs do that sizes and sketches do not rule out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps, n, wide, left, right in _pairs_of_blocks(batches):
            size = min(map(len, wide))
            sk = np.stack([folded(np.frombuffer(w, dtype=np.uint8), size) for w in wide]).view(U)
            label, step = np.arange(len(fps)), max(1, (1 << 21) // sk.shape[1])
            for low in range(0, len(left), 64):
                rows = left[low : low + 64]
                x, y = np.nonzero(_sizes_fit(n, rows, right, percent) & (label[rows][:, None] != label[right][None, :]))
                for s in range(0, len(x), step):
                    p, q = rows[x[s : s + step]], right[y[s : s + step]]
                    near = np.bitwise_count(sk[p] ^ sk[q]).sum(axis=1, dtype=np.int64) <= (100 - percent) * (n[p] + n[q]) // (100 + percent)
                    label = _joined(label, p[near], q[near])
            hang = np.flatnonzero(label != np.arange(len(fps)))
            if len(hang):
                yield pa.record_batch({"a": pa.array(fps[hang]), "b": pa.array(fps[label[hang]])})

    return _dealt(members, "wide").mapInArrow(each, "a long, b long")


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at `left` with those at `right`, by products of 0-1 matrices."""
    sizes = [len(x) for x in sets]
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, some = np.repeat(np.arange(len(sets)), sizes), times > 1
    column = np.where(some, np.cumsum(some) - 1, -1)[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    for low in range(0, int(some.sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        has[row[a:b], column[a:b] - low] = 1
        out += has[left] @ has[right].T
    return out.astype(np.int64)


def _tested(docs: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """Exact links inside groups (fp, id, n, key, _blocks): rows (a, b) connect what is linked, rows (a, links) count.

    Only the sets of members are sent, each to the blocks of its group.
    """
    bloom = docs.sparkSession.sparkContext.broadcast(build(groups, "id", bits_for(groups.count())))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            batch = batch.filter(pa.array(passes(bloom.value, batch.column(0).to_numpy())))
            ids = batch.column(0).to_numpy()
            for low, sets in _sets(batch, width):
                kept = [(int(ids[low + i]), fingerprint(x), x) for i, x in enumerate(sets) if len(x)]
                kept = [k for k in kept if k[:2] not in seen and not seen.add(k[:2])]
                if kept:
                    i, fp, x = zip(*kept, strict=True)
                    yield pa.record_batch({"id": pa.array(i, pa.int64()), "fp": pa.array(fp, pa.int64()), "x": pa.array([k.tobytes() for k in x], pa.binary())})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps, n, xs, left, right in _pairs_of_blocks(batches):
            common = _common([np.frombuffer(x, dtype=U) for x in xs], left, right)
            linked = (100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)) & (left[:, None] != right[None, :])
            x, y = np.nonzero(linked)
            label = _joined(np.arange(len(fps)), left[x], right[y])
            hang = np.flatnonzero(label != np.arange(len(fps)))
            counts = np.zeros(len(fps), dtype=np.int64)
            counts[left] = linked.sum(axis=1)
            if left is not right:
                counts[right] = linked.sum(axis=0)
            some = np.flatnonzero(counts)
            a, b = np.concatenate((fps[hang], fps[some])), np.concatenate((fps[label[hang]], fps[some]))
            if len(a):
                yield pa.record_batch({"a": pa.array(a), "b": pa.array(b), "links": pa.array(np.concatenate((np.zeros(len(hang), dtype=np.int64), counts[some])))})

    sets = docs.mapInArrow(wanted, "id long, fp long, x binary").join(groups, ["id", "fp"])
    return _dealt(sets, "x").mapInArrow(each, "a long, b long, links long")


def _keyed(text: Column) -> list[Column]:
    """Two hashes that with doc_id stand for a row."""
    return [F.xxhash64(text).alias("r"), F.xxhash64(F.lit(31), text).alias("s")]


def _solved(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, r, s, n, fp), and the classes (fp, class_id, component, component_id, n_links)."""
    small_batches(docs)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *_keyed(text))
    feats = checkpoint(_features(docs, width))
    named = feats.filter("n > 0 AND doc_id IS NOT NULL")
    classes = checkpoint(named.groupBy("fp").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.first("wide").alias("wide")))
    known = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    total = classes.agg(F.sum("n")).first()[0] or 0  # there are about three signatures for each four shingles
    bits = max(3, (total * 3 // (4 * RANGE)).bit_length())
    buckets = checkpoint(_buckets(known, width, percent, bits).distinct())

    # Of buckets with the same members (by two hashes of the whole), one stays.
    whole = [F.bit_xor(F.xxhash64(F.lit(seed), "fp")).alias(f"_{seed}") for seed in (1, 2)]
    sized = buckets.join(classes.select("fp", "n"), "fp")
    alike = sized.groupBy("sig").agg(F.count("*").alias("_n"), *whole, _blocks())
    chosen = checkpoint(alike.groupBy("_n", "_1", "_2").agg(F.min("sig").alias("sig"), F.first("_blocks").alias("_blocks")).select("sig", "_blocks"))
    members = buckets.join(chosen, "sig").select(F.col("sig").alias("key"), "_blocks", "fp")
    groups = components(_hang_together(members.join(classes.select("fp", "n", "wide"), "fp"), percent))

    groups = groups.select(F.col("id").alias("fp"), F.col("component").alias("key")).join(classes.select("fp", "id", "n"), "fp")
    sizes = groups.groupBy("key").agg(_blocks())
    tested = checkpoint(_tested(known, checkpoint(groups.join(sizes, "key")), width, percent))
    found = components(tested.filter("links = 0").select("a", "b"))
    counts = tested.groupBy(F.col("a").alias("fp")).agg(F.sum("links").alias("n_links"))

    found = found.select(F.col("id").alias("fp"), "component").join(classes.select("fp", "id"), "fp").join(counts, "fp", "left")
    found = checkpoint(found.select("fp", "id", "component", "n_links"))
    found = found.join(found.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("fp", "component", "component_id", "n_links")
    of_class = classes.select("fp", F.col("id").alias("class_id")).join(found, "fp", "left")
    of_class = of_class.select("fp", "class_id", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return feats, checkpoint(of_class)


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Connected components of documents whose word-shingle sets have a Jaccard similarity of percent / 100 or more.

    Words are runs without space and U+0009 to U+000D, with A-Z in lower case. A set has the distinct shingles of `width`
    words; fewer words are one shingle together. Returns doc_id, n_shingles (size of the set), component_id (the smallest
    doc_id that the row reaches by links, itself included), class_id (the smallest doc_id with exactly the same set) and
    n_links (to how many other classes the row's class is linked).

    A null or empty text and one without words has an empty set and is linked with nothing. A null doc_id is linked with
    nothing and has null ids. Rows with equal doc_id are documents of their own that share the id; equal rows are in one
    class. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    feats, of_class = _solved(docs, width, percent)
    linked = feats.filter("n > 0 AND doc_id IS NOT NULL").join(of_class, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id", "n_links")
    alone = feats.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, whole and in the same columns, without all but one of each component of jaccard_components().

    The row with the smallest doc_id stays, of several the one with the smaller hashes of its text, and of equal rows
    one. Rows without words and rows with a null doc_id all stay.

    Rows that go are known by doc_id and two hashes of the text. A Bloom filter of those lets the rows that surely stay
    pass where they lie; only the others shuffle.
    """
    feats, of_class = _solved(docs, width, percent)
    key = ["doc_id", "r", "s"]
    rows = feats.filter("n > 0 AND doc_id IS NOT NULL").select(*key, "fp").join(of_class.select("fp", "component"), "fp").select(*key, "component")
    groups = rows.groupBy("component").agg(F.count("*").alias("_n"), F.min(F.struct(*key)).alias("_first")).filter("_n > 1")
    marked = rows.join(groups, "component").groupBy(*key).agg(F.count("*").alias("_n"), F.bool_or(F.struct(*key) == F.col("_first")).alias("stays"))
    marked = checkpoint(marked.filter("NOT stays OR _n > 1").select(*key, "stays", F.xxhash64(*key).alias("k")))
    bloom = docs.sparkSession.sparkContext.broadcast(build(marked, "k", bits_for(marked.count())))

    whole = docs.select(F.struct("*").alias("d"), F.col("doc_id").cast("long").alias("doc_id"), *_keyed(F.col("text").cast("string")))
    whole = whole.withColumn("k", F.xxhash64(*key))

    def split(maybe: bool) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(passes(bloom.value, batch.column(4).to_numpy()) == maybe))

        return whole.mapInArrow(each, whole.schema)

    met = split(True).join(marked.drop("k").hint("shuffle_hash"), key, "left")
    once = met.filter("stays").dropDuplicates(key)
    return split(False).select("d.*").unionAll(met.filter("stays IS NULL").select("d.*")).unionAll(once.select("d.*"))
