"""Language identification with a blended-spectrum string kernel.

A text is the set of its character n-grams (n = 1..4 of the lower-cased text, hashed to ``DIM`` cells).
The kernel of two texts is the size of the common set over the root of the product of both sizes.
``LANDMARKS`` training texts make the Nystroem map K(x, Z) K(Z, Z)^-1/2; one-versus-rest kernel ridge
regression is solved on it; scoring is two matrix products per batch.

The model is fitted on a bounded sample of labelled rows (``SAMPLE`` rows and ``SAMPLE_BYTES``, lowest hashes of id and text per language)
and its size (DIM x LANDMARKS) does not depend on the corpus. Scoring reads whole texts, in one narrow scan.

Defined cases: a null text, an empty one or one without a letter gives ``und`` with score 0. No labelled
rows at all: every text with a letter is ``und`` too. Ties go to the language that sorts first. Each row
gives a row. Columns other than the named ones are kept by ``predict`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsort.llm.common import bounded_sample, crc_mod, hand_back, lean

DIM = 8192
LANDMARKS = 160
#: Bounds of the training sample, in rows and in bytes.
SAMPLE, SAMPLE_BYTES = 1600, 48_000_000
RIDGE = 1e-2
BATCH = 128
#: One model is one matrix of this many columns at most; more languages than this are an error.
MAX_LANGS = 1000
SALTS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)
LETTER = regex.compile(r"\p{L}")


def presence(text: str) -> np.ndarray:
    """Sorted distinct cells of the text's n-grams, n = 1..4."""
    flags = np.zeros(DIM, dtype=bool)
    mark(text, flags)
    return flags


def mark(text: str, flags: np.ndarray) -> None:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return
    gram = codes * SALTS[0]
    flags[(gram >> np.uint32(16)) % np.uint32(DIM)] = True
    for n in range(1, 4):
        if len(codes) <= n:
            break
        gram = (gram[:-1] ^ (gram[:-1] >> np.uint32(15))) * SALTS[n] + codes[n:] * SALTS[0]
        flags[(gram >> np.uint32(16)) % np.uint32(DIM)] = True


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised common-gram counts of 0/1 rows with 0/1 landmark rows."""
    size = np.maximum(rows.sum(1, keepdims=True), 1)
    return rows @ landmarks.T / np.sqrt(size * np.maximum(landmarks.sum(1), 1))


def fit(texts: list[str], langs: list[str]) -> dict:
    """The model: languages, landmark rows, and the matrix from landmark kernels to scores."""
    names = sorted(set(langs))
    if len(names) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not names:
        return {"langs": [], "landmarks": np.zeros((0, DIM), bool), "weights": np.zeros((0, 0), np.float32)}
    rows = np.stack([presence(t) for t in texts]).astype(np.float32)
    target = np.array([[1.0 if x == n else -1.0 for n in names] for x in langs])
    place = {n: [i for i, x in enumerate(langs) if x == n] for n in names}
    share = max(1, LANDMARKS // len(names))
    chosen = [i for n in names for i in place[n][:share]]
    z = rows[chosen]
    values, vectors = np.linalg.eigh(kernel(z, z).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel(rows, z).astype(np.float64) @ root
    phi = np.hstack([phi, np.ones((len(phi), 1))])
    weight = np.array([len(langs) / (len(names) * len(place[x])) for x in langs])[:, None]
    solved = np.linalg.solve(phi.T @ (weight * phi) + RIDGE * np.eye(phi.shape[1]), phi.T @ (weight * target))
    return {"langs": names, "landmarks": z > 0, "weights": np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32)}


def score(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray]:
    """Predicted language and score of each text; ``und`` for no text or no letter."""
    langs, z = ["und"] * len(texts), model["landmarks"].astype(np.float32)
    scores = np.zeros(len(texts))
    use = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model["langs"] else []
    for at in range(0, len(use), BATCH):
        part = use[at : at + BATCH]
        flags = np.zeros((len(part), DIM), bool)
        for row, i in enumerate(part):
            mark(texts[i], flags[row])
        k = kernel(flags.astype(np.float32), z)
        margin = (k @ model["weights"][:-1] + model["weights"][-1]).astype(np.float64)
        odds = np.exp(2 * (margin - margin.max(1, keepdims=True)))
        best = margin.argmax(1)
        for row, i in enumerate(part):
            langs[i] = model["langs"][best[row]]
            scores[i] = odds[row, best[row]] / odds[row].sum()
    return langs, np.clip(scores, 0.0, 1.0)


def train(docs: DataFrame, folds: int = 5, held: int = 0) -> dict:
    """Learn from rows whose crc32(id) mod ``folds`` is not ``held`` and whose language is known."""
    out = F.coalesce(crc_mod(F.col("doc_id"), folds) == held, F.lit(False))
    labelled = docs.filter(~out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = bounded_sample(labelled, "lang", SAMPLE, MAX_LANGS, SAMPLE_BYTES)
    rows = [(text, lang) for text, lang in rows if LETTER.search(text)]
    return fit([t for t, _ in rows], [x for _, x in rows])


def predict(docs: DataFrame, model: dict, lang: str = "lang_pred", prob: str = "score") -> DataFrame:
    """``docs`` with two more columns, predicted language and score. The model is bounded (see module)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            names, odds = [], []
            for at in range(0, len(batch), 8 * BATCH):  # a part of the batch at a time: bounded memory
                found, p = score(batch.slice(at, 8 * BATCH).to_pylist(), shared.value)
                names += found
                odds.append(p)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(odds) if odds else [], pa.float64())], ["lang", "p"])
            hand_back()

    udf = F.arrow_udf(lean(run), "lang string, p double")
    return docs.withColumn("__capsort_lang", udf(F.col("text"))).withColumns({lang: F.col("__capsort_lang.lang"), prob: F.col("__capsort_lang.p")}).drop("__capsort_lang")


def identify(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    model = train(docs, folds, held)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
