"""Sampling simulator: chains of photos, what a reconstruction would keep, and thinning."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capsort.functions import columns as C


def site(spark: SparkSession, sizes: list[int], p: float, seed: int) -> DataFrame:
    """(component, position, valid): a photo is valid with probability ``p``, by hash of seed and place."""
    parts = spark.createDataFrame(list(enumerate(sizes)), "component int, n int")
    rows = parts.select("component", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("position"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "component", "position"), F.lit(1_000_000)) / 1e6
    return rows.withColumn("valid", draw < p)


def fragments(chosen: DataFrame, k: int) -> DataFrame:
    """(component, fragment, n, first, last): runs of valid positions with gaps of at most ``k``."""
    order = Window.partitionBy("component").orderBy("position")
    gap = F.col("position") - F.lag("position").over(order)
    marked = chosen.filter("valid").withColumn("starts", F.when(gap <= k, 0).otherwise(1))
    named = marked.withColumn("fragment", F.sum("starts").over(order))
    return named.groupBy("component", "fragment").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"), F.max("position").alias("last"))


def outcome(chosen: DataFrame, k: int, q: float, least: int, mode: str) -> DataFrame:
    """The fragment that comes out, if the rule (count, absolute or relative) lets it; else no row."""
    found = fragments(chosen, k)
    # Each task keeps two rows: no window over all fragments.
    first = lambda rows: found.orderBy(F.desc("n"), "component", "fragment").limit(rows)
    best = first(1).select("component", "fragment", "n", "first", "last")
    second = first(2).agg(F.when(F.count(F.lit(1)) > 1, F.min("n")).otherwise(0).alias("second"))
    size = chosen.agg(F.count(F.lit(1)).alias("size"))
    rule = {"count": F.lit(True), "absolute": F.col("n") >= q * F.col("size"), "relative": F.col("n") >= 2 * F.col("second")}[mode]
    return best.join(F.broadcast(second)).join(F.broadcast(size)).filter((F.col("n") >= least) & rule).drop("second", "size")


def component_sizes(spec: str | None, n: int) -> tuple[int, ...]:
    """Sizes of components: listed ones (``600,400``, which must add up to ``n``), or ``n`` dealt to so many, the rest to the first."""
    if spec is None:
        return (n,)
    if "," in spec:
        sizes = tuple(int(x) for x in spec.split(",") if x.strip())
        if sum(sizes) != n:
            raise ValueError(f"sizes add up to {sum(sizes)}, not {n}")
        return sizes
    k = int(spec)
    return (n // k + n % k, *[n // k] * (k - 1))


def chunks(photos: DataFrame, size: int) -> DataFrame:
    order = Window.partitionBy("component").orderBy("position")
    return photos.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / size))


def thin(positions: list[int], k: int, most: int) -> list[int]:
    """Fewest positions, from the first, each within ``k`` of the one before; at most ``most``."""
    out: list[int] = []
    xs = sorted(positions)
    at = 0
    while at < len(xs) and len(out) < most:
        out.append(xs[at])
        ahead = at + 1
        while ahead + 1 < len(xs) and xs[ahead + 1] - xs[at] <= k:
            ahead += 1
        at = ahead
    return out


def thinned(posed: DataFrame, k: int, most: int) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept = thin(rows["position"].tolist(), k, most)
        return pd.DataFrame({"component": rows["component"].iloc[0], "position": kept})

    return posed.groupBy("component").applyInPandas(run, "component int, position int")


def sample_without_replacement(rows: DataFrame, n: int, seed: int, weight: str | None = None) -> DataFrame:
    """``n`` rows by exponential race on a hash of the row; uniform without a weight."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *rows.columns), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    key = -F.log(u) / (F.col(weight) if weight else F.lit(1.0))
    return rows.orderBy(key, *rows.columns).limit(n)


def density_table(spark: SparkSession, sizes: list[int], ks: list[int], q: float) -> DataFrame:
    grid = spark.createDataFrame([(n, k) for n in sizes for k in ks], "n int, k int")
    return grid.withColumn("f_star", F.round(C.critical_density(F.col("n"), F.col("k"), q), 6))


def trial_means(trials: DataFrame, *keys: str) -> DataFrame:
    """Success rate, and mean posed count of the successes."""
    return trials.groupBy(*keys).agg(F.avg(F.col("ok").cast("double")).alias("rate"), F.avg(F.when(F.col("ok"), F.col("posed"))).alias("mean_posed"))


@dataclass(frozen=True)
class Model:
    """What a reconstruction does with a batch: gaps up to ``k`` hold, the largest fragment needs ``least`` photos and the rule."""

    sizes: tuple[int, ...]
    batch: int
    p: float = 0.95
    k: int = 4
    q: float = 0.5
    least: int = 20
    mode: str = "absolute"


class Site:
    """One random site. Photos are numbers in (component, position) order; places of two components are never within k."""

    def __init__(self, model: Model, rng: np.random.Generator) -> None:
        stride = max(model.sizes) + model.k + 1
        self.model, self.rng = model, rng
        self.place = np.concatenate([np.arange(n) + c * stride for c, n in enumerate(model.sizes)])
        self.valid = rng.random(len(self.place)) < model.p
        self.runs = self.fed = self.failures = 0

    def draw(self, among: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
        """``n`` of the photos, without replacement; by exponential race where weights are given."""
        n = min(n, len(among))
        if weight is None:
            return self.rng.choice(among, n, replace=False)
        return among[np.argsort(self.rng.exponential(size=len(among)) / np.maximum(weight[among], 1e-9), kind="stable")[:n]]

    def reconstruct(self, chosen: np.ndarray) -> np.ndarray:
        """The photos that get a pose; none if the rule fails."""
        self.runs, self.fed = self.runs + 1, self.fed + len(chosen)
        own = np.sort(chosen[self.valid[chosen]])
        parts = sorted(np.split(own, np.flatnonzero(np.diff(self.place[own]) > self.model.k) + 1), key=len, reverse=True)
        first, second = len(parts[0]), len(parts[1]) if len(parts) > 1 else 0
        holds = {"count": True, "absolute": first >= self.model.q * len(chosen), "relative": first >= 2 * second}[self.model.mode]
        if first and first >= self.model.least and holds:
            return parts[0]
        self.failures += 1
        return np.zeros(0, np.int64)

    def anchor(self, posed: np.ndarray, batch: int) -> np.ndarray:
        """Posed photos thinned as far as they stay connected, refilled to the share that a batch needs."""
        posed = np.sort(posed)
        kept = posed[np.isin(self.place[posed], thin(self.place[posed].tolist(), self.model.k, len(posed)))]
        lacking = min(len(posed), math.ceil(self.model.q * batch) + 1) - len(kept)
        return np.concatenate((kept, self.draw(np.setdiff1d(posed, kept), lacking))) if lacking > 0 else kept


def policy(model: Model, rng: np.random.Generator, most_runs: int = 80, retries: int = 3, stalls: int = 2, compress: bool = True, decay: float = 1.0) -> dict:
    """Discover a component, complete it from anchors and draws, peel it off, until nothing new comes out."""
    at = Site(model, rng)
    pool = np.arange(len(at.place))
    done: list[np.ndarray] = []
    active, exhausted, missed, stalled = np.zeros(0, np.int64), False, 0, 0
    weight = np.ones(len(pool))
    while len(pool) and at.runs < most_runs and not exhausted:
        batch = min(model.batch, len(pool))
        if not len(active):
            active = at.reconstruct(at.draw(pool, batch))
            missed = 0 if len(active) else missed + 1
            exhausted = missed > (1 if done else retries)
            stalled, weight = 0, np.ones(len(at.place))
            continue
        anchor = at.anchor(active, batch) if compress else active
        drawn = at.draw(np.setdiff1d(pool, active), max(0, batch - len(anchor)), weight if decay < 1 else None)
        found = at.reconstruct(np.concatenate((anchor, drawn)))
        grown = np.union1d(active, found) if np.isin(found, anchor).any() else active
        weight[np.setdiff1d(drawn, found)] *= decay
        stalled = 0 if len(grown) > len(active) else stalled + 1
        active = grown
        if stalled >= stalls or not len(drawn):
            done.append(active)
            pool, active, stalled = np.setdiff1d(pool, active), np.zeros(0, np.int64), 0
    if len(active):
        done.append(active)
        pool = np.setdiff1d(pool, active)
    for i, model_photos in enumerate(done):  # what is left is tried once with each model
        batch = min(model.batch, len(model_photos) + len(pool))
        anchor = at.anchor(model_photos, batch)
        drawn = at.draw(pool, batch - len(anchor)) if len(pool) and batch > len(anchor) else pool[:0]
        if len(drawn):
            found = at.reconstruct(np.concatenate((anchor, drawn)))
            if np.isin(found, anchor).any():
                done[i] = np.union1d(model_photos, found)
                pool = np.setdiff1d(pool, found)
    posed = sum(map(len, done))
    return {"runs": at.runs, "fed": at.fed, "failures": at.failures, "models": len(done), "posed": posed, "coverage": posed / max(1, int(at.valid.sum())), "residue": len(pool), "exhausted": exhausted, "stuck": not done}


def cold_start(model: Model, rng: np.random.Generator) -> dict:
    """Whether one uniform draw comes out, and how many photos it poses."""
    at = Site(model, rng)
    posed = at.reconstruct(at.draw(np.arange(len(at.place)), model.batch))
    return {"ok": len(posed) > 0, "posed": len(posed)}


def proposal(model: Model, rng: np.random.Generator, noise: float = 0.0) -> dict:
    """Share of valid photos posed if batches follow the order of places, with a share ``noise`` of the photos permuted."""
    at = Site(model, rng)
    order = np.arange(len(at.place))
    moved = np.flatnonzero(rng.random(len(order)) < noise)
    order[moved] = rng.permutation(order[moved])
    posed = [at.reconstruct(order[a : a + model.batch]) for a in range(0, len(order), model.batch)]
    return {"coverage": len(np.unique(np.concatenate(posed))) / max(1, int(at.valid.sum())), "good_runs": float(sum(len(x) > 0 for x in posed))}


def sweep(spark: SparkSession, cases: list[tuple[str, Callable[[np.random.Generator], dict]]], trials: int, schema: str, seed: int = 1) -> DataFrame:
    """Each named case ``trials`` times, trials dealt over tasks; a trial's numbers depend on seed, case and trial only."""
    names = [n for n, _ in cases]
    grid = spark.range(len(cases) * trials).repartition(min(len(cases) * trials, spark.sparkContext.defaultParallelism), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].tolist()
            yield pd.DataFrame([{"name": names[i // trials], "trial": i % trials} | cases[i // trials][1](np.random.default_rng([seed, i // trials, i % trials])) for i in ids])

    return grid.mapInPandas(run, f"name string, trial long, {schema}")
