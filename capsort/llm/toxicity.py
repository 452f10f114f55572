"""Toxicity by a convolutional text classifier, trained and run in numpy.

Words (lower-cased letters and digits of any script) are hashed into ``BUCKETS`` embeddings. Filters of several
widths slide over whole texts, each keeps its maximum, and a logistic layer makes the score. For scoring, embedding
and filter are multiplied once: each filter position becomes a table of one row a bucket, so a text is scored by
row look-ups, sums and a running maximum. Texts are scored in chunks of documents, in one narrow scan.

The training sample is bounded: at most ``POSITIVE`` and ``NEGATIVE`` labelled rows of the training fold, lowest id hashes
first. A fifth of it is kept for thresholds: one per language, where the language is told from the text's own
function words. Scores are shifted so that each language's threshold becomes ``CUT``.

Defined cases: null and empty texts are scored by the empty text's features (the filters' floor). Labels that are
null do not take part; an id labelled twice counts as toxic if any label says so. No labels, or one class only: the
score is the (smoothed) share of toxic labels, everywhere. Each row gives a row. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsort.llm.common import bounded_texts, crc_mod
from capsort.llm.decontam import Hasher, normal

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 12, (1, 2, 3)
#: Bounds of the training sample, in rows and in bytes.
POSITIVE, NEGATIVE, SAMPLE_BYTES = 3000, 6000, 48_000_000
EPOCHS, RATE, DECAY, BATCH = 10, 0.02, 1e-5, 32
CHUNK = 1_000_000
CUT = 0.3
#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on with as be at by this are from or an",
    "fr": "le la les de des du et en un une que qui dans pour par sur est au ne pas",
    "de": "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch",
    "es": "el la los las de que y en un una por con para se del es no al lo su",
}
LANGS = [*FUNCTION_WORDS]


def buckets(texts: list[str | None], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of all texts, two pads after each text, and where each text starts."""
    pad = max(WIDTHS) - 1
    data = b" \x01 ".join(map(normal, texts)) + b" \x01 "
    starts, ends, h = hasher.words(data)
    raw = np.frombuffer(data, np.uint8)
    fence = (ends - starts == 1) & (raw[starts] == 1)
    ids = (h >> np.uint64(49)).astype(np.int32)
    ids[fence] = BUCKETS
    repeat = np.where(fence, pad, 1)
    ids = np.repeat(ids, repeat)
    stop = np.cumsum(repeat)[fence]
    return ids, np.concatenate(([0], stop[:-1])).astype(np.int64)


def language_table() -> np.ndarray:
    """Bucket -> one count per language."""
    table = np.zeros((BUCKETS + 1, len(LANGS)), np.float32)
    for k, words in enumerate(FUNCTION_WORDS.values()):
        for w in words.split():
            table[int(Hasher().words(normal(w))[2][0] >> np.uint64(49)), k] += 1
    return table


def languages(ids: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index of the language with most function words; the number of languages if there is none."""
    known = np.flatnonzero(table.any(1)[ids])
    doc = np.searchsorted(starts, known, "right") - 1
    counts = np.zeros((len(starts), len(LANGS)))
    np.add.at(counts, doc, table[ids[known]])
    return np.where(counts.any(1), counts.argmax(1), len(LANGS))


def pooled(ids: np.ndarray, starts: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per text and filter the maximum of the filter's sums, before bias and rectifier."""
    out = []
    at = 0
    for width in WIDTHS:
        total = tables[at][ids]
        for j in range(1, width):
            total[:-j] += tables[at + j][ids[j:]]
        total[ids == BUCKETS] = 0  # a window that starts after a text must not see the next one
        out.append(np.maximum.reduceat(total, starts, axis=0))
        at += width
    return np.hstack(out)


def tables_of(model: dict) -> list[np.ndarray]:
    return [model["embedding"] @ model["filters"][w][j] for w in WIDTHS for j in range(w)]


def logits(ids: np.ndarray, starts: np.ndarray, model: dict, tables: list[np.ndarray]) -> np.ndarray:
    hidden = np.maximum(pooled(ids, starts, tables) + model["bias"], 0)
    return hidden @ model["out"] + model["out_bias"]


def fit(texts: list[str], toxic: list[int], seed: int = 3) -> dict:
    """Train on four fifths, choose thresholds on the rest (all, if there are few)."""
    rng = np.random.default_rng(seed)
    y = np.array(toxic, np.float32)
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(toxic)) < 2:
        return {"constant": float(share)}
    hasher = Hasher()
    docs = [buckets([t], hasher)[0] for t in texts]
    docs = [np.concatenate((d, np.full(1, BUCKETS, np.int32))) for d in docs]
    embedding = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
    embedding[BUCKETS] = 0
    filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
    out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
    model = {"embedding": embedding, "filters": filters, "bias": bias, "out": out, "out_bias": np.float32(0)}
    square = {"embedding": np.zeros_like(embedding), "bias": np.zeros_like(bias), "out": np.zeros_like(out), "out_bias": np.float32(0)} | {w: np.zeros_like(filters[w]) for w in WIDTHS}

    def step(name, value: np.ndarray, grad: np.ndarray) -> None:
        square[name] += grad * grad
        value -= RATE * grad / (np.sqrt(square[name]) + 1e-6)

    held = rng.permutation(len(y))[: len(y) // 5] if len(y) >= 500 else np.zeros(0, np.int64)
    train = np.setdiff1d(np.arange(len(y)), held)
    positive, negative = train[y[train] == 1], train[y[train] == 0]
    for _ in range(EPOCHS if len(train) > 1000 else 3 * EPOCHS):
        order = np.concatenate((rng.permutation(negative), rng.choice(positive, max(len(positive), len(negative) // 2))))
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            ids = np.concatenate([docs[i] for i in batch])
            starts = np.concatenate(([0], np.cumsum([len(docs[i]) for i in batch])[:-1]))
            x = embedding[ids]
            where, tops = [], []
            for w in WIDTHS:
                total = x @ filters[w][0]
                for j in range(1, w):
                    total[:-j] += (x @ filters[w][j])[j:]
                total[ids == BUCKETS] = 0
                top = np.maximum.reduceat(total, starts, axis=0)
                doc = np.repeat(np.arange(len(batch)), np.diff(np.append(starts, len(ids))))
                # first place of each maximum
                rows, cols = np.nonzero(total == top[doc])
                place = np.zeros(top.shape, np.int64)
                place[doc[rows[::-1]], cols[::-1]] = rows[::-1]
                where.append(place)
                tops.append(top)
            raw = np.hstack(tops) + bias
            hidden = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-(hidden @ out + model["out_bias"])))
            g = ((p - y[batch]) / len(batch)).astype(np.float32)
            d_hidden = (g[:, None] * out) * (raw > 0)
            d_embedding: dict = {}
            touched, grads = [], []
            for k, w in enumerate(WIDTHS):
                d = d_hidden[:, k * FILTERS : (k + 1) * FILTERS] * (ids[where[k]] != BUCKETS)
                d_filter = np.zeros_like(filters[w])
                for j in range(w):
                    place = np.minimum(where[k] + j, len(ids) - 1)
                    d_filter[j] = np.einsum("bfd,bf->df", x[place], d)
                    touched.append(ids[place].ravel())
                    grads.append((d[:, :, None] * filters[w][j].T[None]).reshape(-1, DIM))
                step(w, filters[w], d_filter + DECAY * filters[w])
            touched, grads = np.concatenate(touched), np.concatenate(grads)
            used, at_ = np.unique(touched, return_inverse=True)
            total = np.zeros((len(used), DIM), np.float32)
            np.add.at(total, at_, grads)
            total[used == BUCKETS] = 0
            square["embedding"][used] += total * total
            embedding[used] -= RATE * 4 * total / (np.sqrt(square["embedding"][used]) + 1e-6)
            step("bias", bias, d_hidden.sum(0))
            step("out", out, hidden.T @ g + DECAY * out)
            square["out_bias"] += g.sum() ** 2
            model["out_bias"] -= np.float32(RATE * g.sum() / (np.sqrt(square["out_bias"]) + 1e-6))
    # Thresholds by language: the logit with the best F1, between neighbours; shifted to CUT.
    use = held if len(held) and 0 < y[held].sum() < len(held) else train
    parts = [buckets([texts[i]], hasher) for i in use]
    tables, table = tables_of(model), language_table()
    z = np.array([logits(*p, model, tables)[0] for p in parts])
    lang = np.array([languages(*p, table)[0] for p in parts])
    best = lambda z, y: best_threshold(z, y)
    general = best(z, y[use])
    model["shift"] = np.array([best(z[lang == k], y[use][lang == k]) if 5 <= y[use][lang == k].sum() < (lang == k).sum() else general for k in range(len(LANGS) + 1)])
    model["scale"] = 1.0 / max(0.25, float(np.std(z)) / 2)
    return model


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The logit that separates with the best F1: midway between the two values around it."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    tops = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = int(tops[len(tops) // 2])
    low = z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1
    return float((z[order[k]] + low) / 2)


def score(texts: list[str | None], model: dict, ready: tuple, hasher: Hasher) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    tables, table = ready
    out, part, size = [], [], 0
    for i, t in enumerate(texts):
        part.append(t)
        size += len(t or "")
        if size >= CHUNK or i == len(texts) - 1:
            ids, starts = buckets(part, hasher)
            z = logits(ids, starts, model, tables)
            shift = model["shift"][languages(ids, starts, table)]
            out.append(1 / (1 + np.exp(-np.clip((z - shift) * model["scale"] + np.log(CUT / (1 - CUT)), -40, 40))))
            part, size = [], 0
    return np.concatenate(out) if out else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> dict:
    """Learn from labelled rows whose crc32(id) mod ``folds`` is not ``held``."""
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held))
    by_id = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.xxhash64(F.lit("toxic"), F.col("doc_id"))
    chosen: dict[int, int] = {}
    for value, most in ((1, POSITIVE), (0, NEGATIVE)):
        rows = by_id.filter(F.col("toxic") == value).orderBy(place, "doc_id").limit(most).select("doc_id")
        chosen |= {r[0]: value for r in rows.collect()}
    if not chosen:
        return fit([], [])
    known = docs.filter(F.col("doc_id").isin([*chosen]) & F.col("text").isNotNull()).select(place.alias("place"), F.col("doc_id").cast("long").alias("label"), "text")
    rows = bounded_texts(known, 2 * (POSITIVE + NEGATIVE), SAMPLE_BYTES)
    return fit([t for _, _, t in rows], [chosen[i] for _, i, _ in rows])


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 where score >= CUT)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hasher = shared.value, Hasher()
        ready = () if "constant" in model else (tables_of(model), language_table())
        for batch in batches:
            p = score(batch.column(2).to_pylist(), model, ready, hasher)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
