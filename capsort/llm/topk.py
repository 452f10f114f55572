"""Exact top-k inner-product search by pivot-table elimination.

Vectors are the integer parts floor(256 x). For integers, q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2, so a lower bound of the
distance bounds the product from above. A table holds every vector's distances to many pivots. They fix its place in the
space that the pivots span and how far it is from that space, so the greatest lower bound that all pivots
together allow is d(q, x)^2 >= |c_q - c_x|^2 + (r_q - r_x)^2, c being these places and r these distances. It is never less than
the largest of |d(q, p) - d(x, p)|, which eliminates next to nothing where distances are much alike. For each query
candidates are evaluated in the order of their bounds, in steps, until the next bound is under the k-th best score
found so far in the task. The bound is rounded up, so the result is exact.

Queries are a stated set: blocks of them (``BLOCK_BYTES``, one at a time on the driver and in a task) go against all rows.
A task returns k rows a query; the lists are merged by a window over the query. No pair beyond these is made.

Defined cases: vectors that are null or hold a null, NaN or infinite component, or one that 256 times is beyond a double, take
no part. Vectors are compared with those of their own length only. Ties go to the smaller id; rows that repeat an id
are candidates each, but never for their own id. Fewer candidates than k: all of them. Components so large that products could
pass 2^53 are evaluated in unbounded integers and ranked by these; the column score is the nearest long.
Null ids take no part. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capsort.llm.common import cut

#: Pivots, as a share of the vectors' length, and at most.
PIVOT_SHARE, PIVOTS = 0.75, 256
#: Bytes of one block of queries, products of bounds held at once, and candidates evaluated at once.
BLOCK_BYTES, CELLS, STEP = 32_000_000, 4_000_000, 64
SCALE = 256.0
LOW, HIGH = -(2**63), 2**63 - 1
SCHEMA = "query_id long, vec_id long, score long, beyond string"


def whole(rows: list, scale: float = SCALE) -> np.ndarray:
    return np.floor(np.array(rows, np.float64) * scale)


def exact(q: np.ndarray, x: np.ndarray, small: bool) -> np.ndarray:
    """Inner products of one integer-valued row with several, exact; ``small``: they and their sums are under 2^53."""
    if small:
        return (x @ q).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(q.tolist(), r, strict=True)) for r in x.tolist()], object)


class Pivots:
    """The space that pivots span: from a table of distances to places in it and distances from it."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.norms = (pivots * pivots).sum(1)
        values, vectors = np.linalg.eigh(pivots @ pivots.T) if len(pivots) and np.isfinite(self.norms).all() else (np.zeros(0), np.zeros((len(pivots), 0)))
        keep = values > 1e-6 * values.max(initial=0.0)
        self.base = vectors[:, keep] / np.sqrt(values[keep])
        self.rounding = 1e-14 * max(1, len(pivots)) * float(np.sqrt((self.base * self.base).sum()))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """The table: distances of rows to the pivots."""
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + self.norms[None] - 2 * x @ self.pivots.T, 0))

    def places(self, x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, distances from the space (at most so small), and how far rounding may have moved a place."""
        norms = (x * x).sum(1)
        inner = (norms[:, None] + self.norms[None] - table * table) / 2
        place = inner @ self.base
        moved = self.rounding * (norms + self.norms.max(initial=0.0))
        return place, np.sqrt(np.maximum(norms - (place * place).sum(1), 0) + (2 * np.sqrt(norms) + moved) * moved), moved

    def bounds(self, q: tuple, x: tuple, norms_q: np.ndarray, norms_x: np.ndarray) -> np.ndarray:
        """Upper bounds of all products of two sets of rows, from their places."""
        size = np.sqrt(norms_q)[:, None] * np.sqrt(norms_x)[None]
        moved = np.sqrt(norms_q)[:, None] * x[2][None] + q[2][:, None] * (np.sqrt(norms_x) + x[2])[None]
        most = q[0] @ x[0].T + q[1][:, None] * x[1][None] + moved + 1.0 + 1e-6 * size
        return np.nan_to_num(np.minimum(most, size * (1 + 1e-9) + 1.0), nan=np.inf, posinf=np.inf, neginf=np.inf)


def best_of(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, pivots: np.ndarray, known: list | None = None) -> tuple[list, int]:
    """Per query its k best as (score, id), best first, and how many products were evaluated.

    ``known`` holds each query's best so far: what its last one already rules out is not evaluated.
    """
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    small = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1]) < 2**53
    out, evaluated = [], 0
    with np.errstate(over="ignore", invalid="ignore"):
        space = Pivots(pivots)
        norms_x, norms_q = (x * x).sum(1), (q * q).sum(1)
        at_x, at_q = space.places(x, space.distances(x)), space.places(q, space.distances(q))
        rows = max(1, CELLS // max(1, len(x)))
        for start in range(0, len(q), rows):
            own = slice(start, start + rows)
            bounds = space.bounds(tuple(c[own] for c in at_q), at_x, norms_q[own], norms_x)
            for i, bound in enumerate(bounds, start):
                best = list(known[i]) if known else []
                done = np.zeros(len(x), bool)
                near = np.argpartition(-bound, STEP)[:STEP] if len(x) > STEP else np.arange(len(x))
                while len(near):
                    part = np.sort(near[:STEP])  # by id: ties
                    done[near[:STEP]] = True
                    part = part[ids[part] != query_ids[i]]
                    if len(best) >= k:
                        part = part[bound[part] >= best[k - 1][0]]
                    evaluated += len(part)
                    scores = exact(q[i], x[part], small)
                    top = np.argsort(-scores, kind="stable")[:k] if small else sorted(range(len(part)), key=lambda j: -scores[j])[:k]
                    best = sorted(best + [(int(scores[j]), int(ids[part[j]])) for j in top], key=lambda t: (-t[0], t[1]))[:k]
                    open_ = ~done if len(best) < k else ~done & (bound >= best[k - 1][0])
                    near = np.flatnonzero(open_)
                    near = near[np.argsort(-bound[near], kind="stable")]
                out.append(best)
    return out, evaluated


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and double vector of the rows that take part."""
    vector = F.col(vec_col).cast("array<double>")
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * SCALE) != float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))


def _beyond(score: int) -> str | None:
    """A text that sorts as the score does, for scores at or beyond the ends of a long."""
    if LOW < score < HIGH:
        return None
    digits = str(abs(score))
    return f"1{len(digits):04d}{digits}" if score > 0 else f"0{9999 - len(digits):04d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def _against_all(vectors: DataFrame, asked: list, marks: list, k: int) -> DataFrame:
    """The k best of each query of one block, per task."""
    shared = vectors.sparkSession.sparkContext.broadcast((asked, marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, marks = shared.value
        by_size: dict[int, tuple] = {}
        for d in {len(v) for _, v in asked}:
            own = [(i, v) for i, v in asked if len(v) == d]
            pivots = [v for v in marks if len(v) == d][: max(1, int(PIVOT_SHARE * d))]
            by_size[d] = np.array([i for i, _ in own], np.int64), whole([v for _, v in own]).reshape(-1, d), whole(pivots).reshape(-1, d)
        best = {d: [[] for _ in own[0]] for d, own in by_size.items()}
        for batch in batches:
            ids, vs = batch.column(0).to_numpy(), batch.column(1)
            lengths = vs.value_lengths().to_numpy()
            for d, (q_ids, q, pivots) in by_size.items():
                rows = np.flatnonzero(lengths == d)
                if len(rows):
                    x = np.floor(vs.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), d) * SCALE)
                    best[d], _ = best_of(q_ids, q, ids[rows], x, k, pivots, best[d])
        rows = [(int(i), v, s) for d, own in best.items() for i, mine in zip(by_size[d][0], own, strict=True) for s, v in mine]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([max(LOW, min(HIGH, r[2])) for r in rows], pa.int64()), pa.array([_beyond(r[2]) for r in rows], pa.string())], ["query_id", "vec_id", "score", "beyond"])

    return vectors.mapInArrow(run, SCHEMA)


def top_k(rows: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by ``every``, the k best others."""
    vectors = usable(rows, id_col, vec_col)
    queries = vectors.filter(F.col("id") % every == 0)
    size = queries.agg(F.sum(8 * F.size("v") + 64)).first()[0] or 0
    blocks = int(size // BLOCK_BYTES) + 1
    marks = [list(r[0]) for r in vectors.orderBy(F.xxhash64("id"), "v").limit(PIVOTS).select("v").collect()]
    parts = []
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)) == b).collect()
        # a query row that repeats another gives the same list; one of them is enough
        part = _against_all(vectors, sorted({(r[0], tuple(r[1])) for r in own}), marks, k)
        parts.append(cut(part) if blocks > 1 else part)  # one block after the other: the driver and a task hold one
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    ranked = reduce(DataFrame.unionAll, parts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
