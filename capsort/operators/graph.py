"""Graph stages: components, bisection of large groups, absorption of small ones, links."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capsort.config import GroupingSettings
from capsort.operators.stats import otsu, percentile

#: Units of a fixed-point strength; sums of whole numbers do not depend on their order.
UNIT = 1 << 30


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder the cluster names; one of its own only where none is set and all runs in one process.

    Not ``DataFrame.checkpoint``: that keeps the plan's estimated size, a product of those of all joins before. In a loop its digits
    multiply with each round and fill the driver's memory.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="capsort-checkpoint-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    path = f"{folder}/capsort-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``checkpointed`` that no later plan reads."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's edges (u, v) an edge from the least node of each of their components to each other node of it."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    for at in range(0, len(nodes), 1 << 16):
        some = [(find(x), x) for x in nodes[at : at + (1 << 16)]]
        some = [x for x in some if x[0] != x[1]]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in some], pa.int64()) for k in (0, 1)], ["u", "v"])


def components(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """(idx, root): root is the smallest index reachable by edges with score >= threshold.

    Each task first turns the edges of blocks of nodes into stars, so what rounds read grows with the nodes. Then min-label propagation
    with pointer jumping, so long chains take few rounds; each round is a table in the shared folder.
    """
    strong = edges.filter(F.col("score") >= threshold).select(F.col("i").cast("long").alias("u"), F.col("j").cast("long").alias("v"))
    fewer = checkpointed(strong.repartition(F.shiftright("u", 12)).mapInArrow(_stars, "u long, v long"))
    both = checkpointed(fewer.unionAll(fewer.select("v", "u")).distinct())
    dropped(fewer)
    labels = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")))
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("near"))
        best = labels.join(near, F.col("node") == F.col("u"), "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        after = checkpointed(best.join(jump, F.col("root") == F.col("n2"), "left").select("node", F.least("root", "r2").alias("root"), "old"))
        dropped(labels)
        labels = after.select("node", "root")
        if after.filter("root <> old").isEmpty():
            dropped(both)
            return nodes.select("idx").join(labels, F.col("idx") == F.col("node"), "left").select("idx", F.coalesce("root", "idx").alias("root"))


def score_threshold(edges: DataFrame) -> float:
    """Otsu within [0.15, 0.8] if the scores separate, else the 20th percentile, at least 0.15; 0 without scores."""
    low = percentile(edges, "score", 0.2).first()[0]
    if low is None:
        return 0.0
    found = otsu(edges, "score").first()
    if found is not None and found.separability >= 0.5:
        return min(0.8, max(0.15, found.threshold))
    return max(0.15, low)


def _weakest_cut(weights: np.ndarray, least: int, same: int, near: int) -> int | None:
    """Position after which a sequence is cut: the lightest crossing, ties (within ``same``) to the middle, in scan order.

    ``weights`` are those after each position but the last. Only places within ``near`` of the lightest are scanned.
    """
    n = len(weights) + 1
    margin = max(1, min(least, n // 4))
    low, high = margin - 1, n - margin - 1
    if low > high:
        return None
    middle = (n - 1) / 2
    own = weights[low : high + 1]
    places = np.flatnonzero(own <= own.min() + near)
    best, light = low, float("inf")
    for p, w in zip((places + low).tolist(), own[places].tolist(), strict=True):
        if w < light - same or (abs(w - light) <= same and abs(p - middle) < abs(best - middle)):
            best, light = p, w
    return best


def cut_places(n: int, a: np.ndarray, b: np.ndarray, score: np.ndarray, most: int, least: int) -> list[int]:
    """Where parts of ``n`` places start, each of at most ``most``, cut where the fewest scores of edges (a, b), a < b, cross.

    Weights are kept for all places in whole units. A cut takes off the edges that cross it, which are found from its smaller side, so
    an edge is met a logarithmic number of times, however uneven the cuts are.
    """
    unit = 1 << min(40, 62 - max(1, len(a)).bit_length())
    w = np.rint(score * unit).astype(np.int64)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, a, w)
    np.subtract.at(change, b, w)
    weights = np.cumsum(change)[: max(0, n - 1)]
    ends = np.concatenate([a, b]).astype(np.int32)
    order = np.argsort(ends, kind="stable").astype(np.int32 if 2 * len(a) < 1 << 31 else np.int64)
    first = np.searchsorted(ends[order], np.arange(n + 1))
    same, near = unit * 1e-9, unit * 1e-6
    starts, todo = [], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        at = _weakest_cut(weights[lo : hi - 1], least, same, near) if hi - lo > most else None
        if at is None:
            starts.append(lo)
            continue
        c = lo + at + 1
        side = order[first[lo] : first[c]] if c - lo <= hi - c else order[first[c] : first[hi]]
        edge = np.where(side >= len(a), side - len(a), side)
        edge = edge[(a[edge] >= lo) & (a[edge] < c) & (b[edge] >= c) & (b[edge] < hi)]
        if len(edge):
            x, y, z = a[edge], b[edge], w[edge]
            low, high = int(x.min()), int(y.max())
            left, right = np.zeros(c - low, np.int64), np.zeros(high - c + 1, np.int64)
            np.add.at(left, x - low, z)
            np.add.at(right, high - y, z)
            weights[low : c - 1] -= np.cumsum(left)[:-1]
            weights[c:high] -= np.cumsum(right)[:-1][::-1]
        todo += [(c, hi), (lo, c)]
    return starts


def _placed(members: np.ndarray, i: np.ndarray, j: np.ndarray, score: np.ndarray, most: int, least: int) -> list[int]:
    a, b = np.searchsorted(members, np.minimum(i, j)), np.searchsorted(members, np.maximum(i, j))
    real = a < b
    return cut_places(len(members), a[real], b[real], score[real], most, least)


def bisect(members: list[int], edges: list[tuple[int, int, float]], most: int, least: int) -> list[list[int]]:
    """Contiguous parts of at most ``most`` of the sorted members, cut where the fewest scores cross."""
    i, j = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    starts = _placed(np.array(members, np.int64), i, j, np.array([e[2] for e in edges], float), most, least)
    return [members[x:y] for x, y in zip(starts, [*starts[1:], len(members)], strict=True)]


def split_components(rooted: DataFrame, edges: DataFrame, settings: GroupingSettings) -> DataFrame:
    """(idx, part): components cut to size; a part is named by its first index. One component that needs a cut per task."""
    most = max(2, settings.max_per_group)
    least = max(1, min(settings.min_per_group, settings.max_per_group // 3))
    rooted = checkpointed(rooted)
    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    sized = checkpointed(rooted.join(sizes, "root").select("idx", "root", (F.col("n") > most).alias("large")))
    dropped(rooted)
    large = sized.filter("large").select("idx", "root")
    ends = large.select(F.col("idx").alias("j"), F.col("root").alias("root_j"))
    inside = edges.join(large.withColumnRenamed("idx", "i"), "i").join(ends, "j").filter("root = root_j").select(F.col("root_j").alias("of"), "i", "j", F.col("score").cast("double").alias("score"))

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        members = np.sort(own["idx"].to_numpy())
        starts = _placed(members, *(found[c].to_numpy() for c in ("i", "j", "score")), most, least)
        return pa.table({"idx": members, "part": np.repeat(members[starts], np.diff([*starts, len(members)]))})

    parts = large.groupBy("root").cogroup(inside.groupBy("of")).applyInArrow(run, "idx long, part long")
    return sized.filter("not large").select("idx", F.col("root").alias("part")).unionAll(parts)


def _absorbed(size: list[int], a: np.ndarray, b: np.ndarray, strength: np.ndarray, settings: GroupingSettings) -> list[int]:
    """``absorb`` on arrays; -1: unassigned. Ties of a part are added up when it is its turn, from those of the parts it took."""
    n = len(size)
    size, goes, took = list(size), list(range(n)), {}
    order = np.argsort(np.concatenate([a, b]), kind="stable")
    start = np.searchsorted(np.concatenate([a, b])[order], np.arange(n + 1)).tolist()
    other = np.concatenate([b, a])[order]
    tied = np.tile(np.rint(strength * UNIT).astype(np.int64), 2)[order]

    def end(k: int) -> int:
        while goes[k] != k:
            if goes[k] < 0:
                return -1
            if goes[goes[k]] >= 0:
                goes[k] = goes[goes[k]]
            else:
                return -1
            k = goes[k]
        return k

    left = n
    for small in range(n):
        # Parts before are large enough or gone, and none ever shrinks.
        if left <= 1:
            break
        if goes[small] != small or size[small] >= settings.min_per_group:
            continue
        sums: dict[int, int] = {}
        for m in took.get(small, [small]):
            x, y = start[m], start[m + 1]
            for k, s in zip(other[x:y].tolist(), tied[x:y].tolist(), strict=True):
                if (k := end(k)) >= 0 and k != small:
                    sums[k] = sums.get(k, 0) + s
        open_ = [(s, -k) for k, s in sums.items() if size[k] + size[small] <= settings.max_per_group]
        left -= 1
        if not open_:
            goes[small] = -1
            continue
        target = -max(open_)[1]
        goes[small] = target
        size[target] += size[small]
        took.setdefault(target, [target]).extend(took.pop(small, [small]))
    return [end(k) for k in range(n)]


def absorb(sizes: list[int], firsts: list[int], strength: dict[tuple[int, int], float], settings: GroupingSettings) -> list[int | None]:
    """For each part the part it ends in (itself, another, or None: unassigned), on group-level data.

    Round by round the first part under the minimum goes to the part with room it is tied to most.
    """
    a, b = (np.array([x[k] for x in strength], np.int64) for k in (0, 1))
    return [k if k >= 0 else None for k in _absorbed(sizes, a, b, np.array(list(strength.values()), float), settings)]


def group_strength(parts: DataFrame, edges: DataFrame, name: str = "part") -> DataFrame:
    """(a, b, strength): summed scores between different groups, a < b."""
    left = parts.select(F.col("idx").alias("i"), F.col(name).alias("ga"))
    right = parts.select(F.col("idx").alias("j"), F.col(name).alias("gb"))
    between = edges.join(left, "i").join(right, "j").filter("ga <> gb")
    return between.groupBy(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.sum("score").alias("strength"))


def final_groups(parts: DataFrame, edges: DataFrame, settings: GroupingSettings) -> DataFrame:
    """(idx, group_id, position): groups after absorption, by first member; null group: unassigned.

    Sizes and strengths of parts (not photos) meet in one task as arrays; none reach the driver.
    """
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("one"), "part", "n")
    ties = group_strength(parts, edges).select(F.lit(0).alias("one"), "a", "b", "strength")

    def run(own: pa.Table, tied: pa.Table) -> pa.Table:
        own = own.sort_by("part")
        names = own["part"].to_numpy()
        a, b = (np.searchsorted(names, tied[c].to_numpy()) for c in "ab")
        ends = np.array(_absorbed(own["n"].to_pylist(), a, b, tied["strength"].to_numpy(), settings), np.int64)
        # Names rise, so the first place of an end is that of its first member.
        kept, first = np.unique(ends[ends >= 0], return_index=True)
        position = np.full(len(names), -1)
        position[kept[np.argsort(first)]] = np.arange(len(kept))
        return pa.table({"part_": names, "position": pa.array(position[ends], pa.int32(), mask=ends < 0)})

    table = sizes.groupBy("one").cogroup(ties.groupBy("one")).applyInArrow(run, "part_ long, position int")
    named = parts.join(table, F.col("part") == F.col("part_"))
    return named.select("idx", F.when(F.col("position").isNotNull(), F.format_string("group-%02d", F.col("position") + 1)).alias("group_id"), "position")


def links(groups: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """(a, b, confidence, n): pairs of groups by position, the mean of their best scores, and their candidates."""
    return ranked_links(link_candidates(groups, edges), top)


def ranked_links(ranked: DataFrame, top: int = 5) -> DataFrame:
    """``links`` of candidates that are ranked."""
    best = F.when(F.col("rank") <= top, F.col("score"))
    return ranked.groupBy("a", "b").agg(F.avg(best).alias("confidence"), F.count(F.lit(1)).alias("n"))


def link_candidates(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, i, j, score, rank): edges between groups, i in a, best first. Edges under the threshold are included."""
    left = groups.filter("position IS NOT NULL").select(F.col("idx").alias("i"), F.col("position").alias("ga"))
    right = groups.filter("position IS NOT NULL").select(F.col("idx").alias("j"), F.col("position").alias("gb"))
    both = edges.join(left, "i").join(right, "j").filter("ga <> gb")
    turn = F.col("ga") > F.col("gb")
    pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    oriented = both.select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b"), pick("i", "j").alias("i"), pick("j", "i").alias("j"), "score")
    return oriented.withColumn("rank", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("score"), "i", "j")))


def _surest(rows: Iterable[tuple[int, int, float]], most: int, used: dict[int, int]) -> Iterator[tuple[int, int, float]]:
    for a, b, c in rows:
        if used.get(a, 0) < most and used.get(b, 0) < most:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            yield a, b, c


def capped(all_links: list[tuple[int, int, float]], most: int) -> list[tuple[int, int, float]]:
    """Links from the most to the least sure, no group in more than ``most``; by (a, b)."""
    return sorted(_surest(sorted(all_links, key=lambda x: (-x[2], x[0], x[1])), most, {}))


def capped_of(found: DataFrame, most: int) -> list[tuple[int, int, float]]:
    """``capped`` of a table of links (a, b, confidence): sorted and thinned in one task, so only links that are kept reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: dict[int, int] = {}
        for batch in batches:
            kept = list(_surest(zip(*(c.to_pylist() for c in batch.columns), strict=True), most, used))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], ["a", "b", "confidence"])

    rows = found.select(F.col("a").cast("int"), F.col("b").cast("int"), "confidence").repartition(1).sortWithinPartitions(F.desc("confidence"), "a", "b")
    return sorted((r.a, r.b, r.confidence) for r in rows.mapInArrow(run, "a int, b int, confidence double").collect())


def islands(positions: list[int], pairs: list[tuple[int, int]]) -> int:
    """Number of connected sets of groups."""
    root = {p: p for p in positions}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        if a in root and b in root:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return len({find(p) for p in positions})


Progress = Callable[[float], None]
