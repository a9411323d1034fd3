"""Toxicity by a convolutional text classifier.

Words (runs of letters and digits, A-Z in lower case) and their prefixes of several lengths are hashed into tables of
embeddings; the vectors side by side stand for the word. So inflected forms of one stem are near each other, and a word
is mistaken for another only where whole word and prefixes collide alike. Filters over one, two and three words slide
over the whole text, each keeps its largest response, and a logistic layer makes the score. Training is plain numpy with
Adam: through max pooling the gradient reaches only one window a filter and text.

The labelled rows for training are bounded by parameters; scoring covers every word of every text. Scores never see the
language. Thresholds do: for each language one is calibrated on labelled rows kept from the fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bloom import bits_for, build, passes
from ._shared import checkpoint, small_batches
from ._words import PUNCTUATION, U, mix64, pieces, words

BUCKETS = 1 << 16  # rows of each embedding table; row 0 is the padding between texts
PREFIXES = (4, 5, 6, 8)  # bytes
TABLES = 1 + len(PREFIXES)
DEPTH = 6  # of one table
WIDTHS = (1, 2, 3)
FILTERS = 8  # of each width
BINS = 1 << 14  # of scores, for thresholds
SPAN = 1 << 14  # words that are convolved at once


@dataclass
class Model:
    tables: list[np.ndarray]
    filters: list[np.ndarray]  # for each width: (width, TABLES * DEPTH, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0

    def kernel(self) -> np.ndarray:
        """All filters side by side: a word's vector times this gives its part in each window that it may be in."""
        return np.concatenate([w for ws in self.filters for w in ws], axis=1)


def word_rows(hashes: np.ndarray) -> np.ndarray:
    """For each word its row in each table."""
    return (hashes % U(BUCKETS - 1) + U(1)).astype(np.int32)


def vectors(tables: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    return np.concatenate([t[ids[..., k]] for k, t in enumerate(tables)], axis=-1)


def padded(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with padding after each text, for windows that reach over its end; and where each text begins."""
    pad = max(WIDTHS) - 1
    begins = np.concatenate(([0], np.cumsum(counts + pad)[:-1]))
    at = np.arange(len(rows)) + np.repeat(np.arange(len(counts)) * pad, counts)
    out = np.zeros((len(rows) + pad * len(counts), TABLES), dtype=np.int32)
    out[at] = rows
    return out, begins


def pooled(parts: Callable[[np.ndarray], np.ndarray], rows: np.ndarray, begins: np.ndarray, counts: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Largest response of each filter in each text (not yet biased), and with `where` its position.

    A window starts at a word, so none sees another text: behind the last word there is padding for the widest. A text
    without words has the response to padding, 0. `parts` gives the words' parts in windows.
    """
    pad, ends = max(WIDTHS) - 1, begins + counts
    best = np.where(counts[:, None] > 0, -np.inf, 0).astype(np.float32).repeat(FILTERS * len(WIDTHS), axis=1)
    place = np.repeat(begins[:, None], best.shape[1], axis=1) if where else None
    for low in range(0, len(rows) - pad, SPAN):
        high = min(low + SPAN, len(rows) - pad)
        z = parts(rows[low : high + pad])
        response = np.full((high - low + 1, best.shape[1]), -np.inf, dtype=np.float32)  # a row more, since slices end there
        column = 0
        for k, width in enumerate(WIDTHS):
            r = z[: high - low, column : column + FILTERS]
            for j in range(1, width):
                r = r + z[j : j + high - low, column + j * FILTERS : column + (j + 1) * FILTERS]
            response[:-1, k * FILTERS : (k + 1) * FILTERS] = r
            column += width * FILTERS
        here = np.flatnonzero((np.maximum(begins, low) < np.minimum(ends, high)))
        if not len(here):
            continue
        cuts = np.stack((np.maximum(begins[here], low) - low, np.minimum(ends[here], high) - low), axis=1)
        most = np.maximum.reduceat(response, cuts.ravel(), axis=0)[::2]
        if where:
            for i, (a, b) in zip(here, cuts, strict=True):
                arg = response[a:b].argmax(axis=0)
                better = response[a:b].max(axis=0) > best[i]
                place[i] = np.where(better, low + a + arg, place[i])
        best[here] = np.maximum(best[here], most)
    return best, place


def projected(model: Model) -> list[np.ndarray]:
    """Each table times its rows of the kernel: a word's part in windows is then a sum of a row from each."""
    kernel = model.kernel()
    return [t @ kernel[k * DEPTH : (k + 1) * DEPTH] for k, t in enumerate(model.tables)]


def logits(model: Model, rows: np.ndarray, counts: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
    """`tables`: what projected() gives. With it all sums are taken place by place in one order, so that a text's logit is
    the same to the last bit whatever texts are beside it. Without, matrix products spare the memory of those tables."""

    def parts(ids: np.ndarray) -> np.ndarray:
        if tables is None:
            return vectors(model.tables, ids) @ model.kernel()
        z = tables[0][ids[:, 0]]
        for k in range(1, TABLES):
            z += tables[k][ids[:, k]]
        return z

    rows, begins = padded(rows, counts)
    hidden = np.maximum(pooled(parts, rows, begins, counts)[0] + model.bias, 0).astype(np.float64)
    out = np.full(len(counts), model.offset)
    for k, weight in enumerate(model.out.tolist()):
        out += hidden[:, k] * weight
    return out


def scores(model: Model, texts: pa.Array, tables: list[np.ndarray] | None = None) -> np.ndarray:
    """Scores from 0 to 1 of whole texts."""
    tables, out = tables or projected(model), np.zeros(len(texts))
    for low, high in pieces(texts):
        h, counts = words(texts.slice(low, high - low), PUNCTUATION, PREFIXES)
        x = logits(model, word_rows(h), counts, tables)
        out[low:high] = 1 / (1 + np.exp(-np.clip(model.scale * x + model.shift, -30, 30)))
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = 12, rate: float = 0.01, batch: int = 64, decay: float = 1e-4, drop: float = 0.3, seed: int = 1) -> Model:
    """Train on texts of a word at least, given as word rows. `drop`: the share of words left out at random, so that no single word is relied on."""
    rng = np.random.default_rng(seed)
    deep, wide = TABLES * DEPTH, FILTERS * len(WIDTHS)
    tables = [(rng.standard_normal((BUCKETS, DEPTH)) * 0.02).astype(np.float32) for _ in range(TABLES)]
    for t in tables:
        t[0] = 0
    model = Model(tables, [(rng.standard_normal((w, deep, FILTERS)) / np.sqrt(w * deep)).astype(np.float32) for w in WIDTHS], np.zeros(wide, np.float32), (np.abs(rng.standard_normal(wide)) * np.resize([0.3, -0.3], wide)).astype(np.float32), 0.0)
    dense = [*model.filters, model.bias, model.out, np.zeros(1, np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in dense]
    sparse = [(np.zeros_like(t), np.zeros_like(t)) for t in tables]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for low in range(0, len(order), batch):
            step += 1
            chosen = order[low : low + batch]
            counts = np.array([len(rows[i]) for i in chosen])
            ids, begins = padded(np.concatenate([rows[i] for i in chosen]), counts)
            ids[rng.random(len(ids)) < drop] = 0
            kernel = model.kernel()
            best, place = pooled(lambda i, kernel=kernel: vectors(tables, i) @ kernel, ids, begins, counts, where=True)
            hidden = np.maximum(best + model.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + dense[-1][0], -30, 30)))
            g = ((p - labels[chosen]) * weights[chosen] / len(chosen)).astype(np.float32)
            grad_out, grad_offset = hidden.T @ g + decay * model.out, np.array([g.sum()], np.float32)
            at = g[:, None] * model.out[None, :] * (hidden > 0)
            grads, touched, pulls = [], [], []
            for k, width in enumerate(WIDTHS):
                columns = slice(k * FILTERS, (k + 1) * FILTERS)
                grad = np.zeros_like(model.filters[k])
                for j in range(width):
                    id2 = ids[place[:, columns] + j]  # (texts, filters, TABLES)
                    grad[j] = np.einsum("tf,tfd->df", at[:, columns], vectors(tables, id2))
                    touched.append(id2.reshape(-1, TABLES))
                    pulls.append((at[:, columns, None] * model.filters[k][j].T[None]).reshape(-1, deep))
                grads.append(grad + decay * model.filters[k])
            grads += [at.sum(axis=0), grad_out, grad_offset]
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for value, grad, (m, v) in zip(dense, grads, moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= rate * fix * m / (np.sqrt(v) + 1e-8)
            touched, pulls = np.concatenate(touched), np.concatenate(pulls)
            for side in range(TABLES):
                order_here = np.argsort(touched[:, side], kind="stable")
                ids_here, starts = np.unique(touched[order_here, side], return_index=True)
                grad = np.add.reduceat(pulls[order_here, side * DEPTH : (side + 1) * DEPTH], starts, axis=0)
                m, v = sparse[side]
                m[ids_here] += 0.1 * (grad - m[ids_here])
                v[ids_here] += 0.001 * (grad * grad - v[ids_here])
                tables[side][ids_here] -= rate * fix * m[ids_here] / (np.sqrt(v[ids_here]) + 1e-8)
                tables[side][0] = 0
    model.offset = float(dense[-1][0])
    return model


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
    """Fit scale and shift of the score (Platt), on rows that the fit did not see, at the true share of toxic rows."""
    scale, shift = 1.0, 0.0
    target = np.where(y > 0, 1 - 1e-3, 1e-3)
    for _ in range(50):  # Newton with damping
        p = 1 / (1 + np.exp(-np.clip(scale * x + shift, -30, 30)))
        r, h = w * (p - target), w * p * (1 - p) + 1e-9
        grad = np.array([(r * x).sum() + 1e-3 * (scale - 1), r.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
        scale, shift = max(0.05, scale - move[0]), shift - move[1]
    model.scale, model.shift = float(scale), float(shift)


def thresholds(counts: list[tuple[str, int, int, int]], least: int = 20) -> dict[str, float]:
    """For each language the middle of the cut with the best F1; 0.5 where a class has fewer than `least` scored rows.

    `counts`: language, toxic, score in BINS steps (-1: a row of the fit, which is not scored) and number of rows. The
    scored rows of a language and class stand for those of the fit as well.
    """
    by_lang: dict[str, np.ndarray] = {}
    for lang, toxic, at, n in counts:
        by_lang.setdefault(lang, np.zeros((2, BINS + 1)))[toxic, at] += n  # -1 is the last
    out = {}
    for lang, rows in sorted(by_lang.items()):
        scored = rows[:, :BINS].sum(axis=1)
        if scored.min() < least:
            out[lang] = 0.5
            continue
        some = np.flatnonzero(rows[:, :BINS].sum(axis=0))[::-1]
        weighted = rows[:, some] * (rows.sum(axis=1) / scored)[:, None]
        hit = np.cumsum(weighted[1])
        i = int(np.argmax(2 * hit / (np.cumsum(weighted.sum(axis=0)) + hit[-1])))
        below = (some[i + 1] + 1) / BINS if i + 1 < len(some) else 0.0
        out[lang] = float((some[i] / BINS + below) / 2)
    return out


def usable(doc_id: Column, folds: int = 5) -> Column:
    """Rows whose labels may be learnt: crc32 of doc_id as text is not divisible by `folds`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds != 0


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, class_chars: int = 8_000_000, seed: int = 1) -> tuple[Model, dict[str, float]]:
    """The model, from at most per_class labelled rows of each class in the usable fold, and the thresholds by language.

    The rows of the fit are the first by a hash of doc_id, whole texts of any length, as long as those of a class have at most
    class_chars characters together (a longer text alone is passed over). So the sample is the same wherever the rows lie,
    and what reaches the driver, as word hashes, is bounded. A doc_id with several labels is toxic if one says so. A fifth of the sample, by another hash, is kept to calibrate the
    score. Thresholds come from all usable labelled rows but those of the fit, whole texts of any length: each is scored
    where it lies, and only counts by language, class and step of the score reach the driver.
    """
    small_batches(docs)
    known = checkpoint(labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & usable(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic")))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("_n")).filter(F.col("_n") > 0).groupBy("doc_id").agg(F.sum("_n").alias("_n"))
    pool = checkpoint(known.join(sized, "doc_id"))
    share = {r["_toxic"]: r["n"] for r in pool.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    if len(share) < 2:
        return None, {}
    order, sample = F.xxhash64(F.lit(seed), "doc_id"), []
    for toxic in (0, 1):
        room = class_chars
        for r in pool.filter(F.col("_toxic") == toxic).orderBy(order, "doc_id").limit(per_class).collect():
            if r["_n"] <= room:
                room -= r["_n"]
                sample.append((r["doc_id"], toxic))
    if len({toxic for _, toxic in sample}) < 2:
        return None, {}
    sample = docs.sparkSession.createDataFrame(sample, "doc_id long, _toxic int")  # 2 * per_class rows at most, which bounds the broadcast below
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    text = text.filter(F.length("text") > 0).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "lang", "_toxic")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, counts = words(batch.column(1), PUNCTUATION, PREFIXES)
            parts = [p.tobytes() for p in np.split(word_rows(h), np.cumsum(counts)[:-1])] if batch.num_rows else []
            yield pa.record_batch({"doc_id": batch.column(0), "rows": pa.array(parts, pa.binary()), "lang": batch.column(2), "toxic": batch.column(3)})

    found = sorted(text.mapInArrow(hashed, "doc_id long, rows binary, lang string, toxic int").collect(), key=lambda r: (r["doc_id"], r["rows"]))
    found = [r for i, r in enumerate(found) if r["rows"] and (not i or r["doc_id"] != found[i - 1]["doc_id"])]  # a text without words teaches nothing
    if len({r["toxic"] for r in found}) < 2:
        return None, {}
    rows = [np.frombuffer(r["rows"], dtype=np.int32).reshape(-1, TABLES) for r in found]
    y = np.array([r["toxic"] for r in found], dtype=np.float32)
    kept = (mix64(np.array([r["doc_id"] for r in found], dtype=np.int64).view(U)) % U(5)) == 0
    prior = np.where(y > 0, share[1] / max(1, (y > 0).sum()), share[0] / max(1, (y == 0).sum())) / (share[0] + share[1]) * len(y)
    fitted = np.flatnonzero(~kept) if kept.any() and len(set(y[~kept])) == 2 else np.arange(len(y))
    held = np.flatnonzero(kept) if len(fitted) < len(y) else fitted
    t = y[fitted]
    balanced = np.where(t > 0, len(t) / 2 / t.sum(), len(t) / 2 / (1 - t).sum()).astype(np.float32)
    model = fit([rows[i] for i in fitted], t, balanced, seed=seed)
    x = logits(model, np.concatenate([rows[i] for i in held]), np.array([len(rows[i]) for i in held]))
    calibrate(model, x, y[held], prior[held])
    ids = np.array([r["doc_id"] for r in found], dtype=np.int64)
    return model, thresholds(_score_counts(docs, known, model, ids[fitted] if len(fitted) < len(y) else ids[:0]))


def _score_counts(docs: DataFrame, known: DataFrame, model: Model, fitted: np.ndarray) -> list[tuple[str, int, int, int]]:
    """Rows of `docs` with a label in `known` (doc_id, _toxic), counted by language, label and step of the score; -1 for ids in `fitted`."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    context = docs.sparkSession.sparkContext
    shared, bloom = context.broadcast((model, fitted)), context.broadcast(build(known, "doc_id", bits_for(known.count())))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = shared.value
        tables = projected(m)
        for batch in batches:
            batch = batch.filter(pa.array(passes(bloom.value, batch.column(0).to_numpy())))
            at = np.minimum(BINS * scores(m, batch.column(2), tables), BINS - 1).astype(np.int32)
            at[np.isin(batch.column(0).to_numpy(), seen)] = -1
            yield pa.record_batch({"doc_id": batch.column(0), "lang": batch.column(1), "at": pa.array(at)})

    scored = slim.mapInArrow(each, "doc_id long, lang string, at int").join(known, "doc_id")
    return [tuple(r) for r in scored.groupBy("lang", "_toxic", "at").agg(F.count("*")).collect()]


def score(docs: DataFrame, model: Model | None, limits: dict[str, float], columns: list[str] | None = None) -> DataFrame:
    """Score whole texts. Returns doc_id and `columns`, then score, lang_threshold and flagged (score at or above it).

    The score, from 0 to 1, depends on the text alone. A null, empty or wordless text has the score of a text without
    any known word. A language without a threshold has 0.5. With no model (no usable labels of both classes) all scores
    are 0. Rows are scored on their own: repeated rows and equal doc_ids stay. An empty table gives no rows.
    """
    small_batches(docs)
    columns = [c for c in (columns or []) if c not in ("doc_id", "score", "lang_threshold", "flagged")]
    spark, slim = docs.sparkSession, docs.select("doc_id", *columns, F.col("text").cast("string").alias("_text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang"))
    shared = spark.sparkContext.broadcast(model)
    n = 1 + len(columns)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tables = projected(m) if m else None
        for batch in batches:
            out = scores(m, batch.column(n), tables) if m else np.zeros(batch.num_rows)
            limit = np.array([limits.get(x, 0.5) for x in batch.column(n + 1).to_pylist()], dtype=np.float64)
            yield pa.record_batch([*batch.columns[:n], pa.array(out), pa.array(limit), pa.array(out >= limit)], names=["doc_id", *columns, "score", "lang_threshold", "flagged"])

    schema = slim.select("doc_id", *columns).schema.add("score", "double").add("lang_threshold", "double").add("flagged", "boolean")
    return slim.mapInArrow(each, schema)


def toxicity(docs: DataFrame, labels: DataFrame, **sample: int) -> DataFrame:
    """Train on the usable fold of `labels` and score all of `docs`.

    Returns doc_id, held_out (the labels of this row were not usable), score, predicted (1 if score >= 0.5), lang_threshold
    and flagged. See train() for the bounds of the sample and score() for nulls, empty texts and ties.
    """
    model, limits = train(docs, labels, **sample)
    out = score(docs, model, limits)
    held = F.coalesce(~usable(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "lang_threshold", "flagged")


def accepted(docs: DataFrame, model: Model | None, limits: dict[str, float] | None = None, limit: float = 0.5) -> DataFrame:
    """The rows of `docs`, whole and in the same columns, whose score is below the threshold of their language in
    `limits`, or below `limit` if it has none there. With no model all rows stay."""
    if model is None:
        return docs
    small_batches(docs)
    shared, at, lang = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), docs.columns.index("lang") if limits else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = projected(shared.value)
        for batch in batches:
            most = np.full(batch.num_rows, limit)
            if limits:
                most = np.array([limits.get(x or "", limit) for x in batch.column(lang).to_pylist()], dtype=np.float64)
            yield batch.filter(pa.array(scores(shared.value, batch.column(at), tables) < most))

    return docs.mapInArrow(each, docs.schema)
