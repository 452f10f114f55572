"""The whole sort: quality, grouping, shared photos, diagnostics and the manifest."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capsort.config import PlannerSettings, SortRequest
from capsort.functions import columns as C
from capsort.operators import graph, pairs, quality
from capsort.operators.stats import histogram

HARDWARE_LIMIT = 1000
SPREAD_REFERENCE = 0.35


@dataclass
class Sorted:
    outcome: DataFrame
    photos: DataFrame
    edges: DataFrame
    groups: DataFrame
    links: list[tuple[int, int, float]]
    shared: DataFrame
    threshold: float
    used: set[str]
    coverage: dict[str, float]
    histogram: list[int]


def select_shared(candidates: pd.DataFrame, settings: PlannerSettings) -> list[int]:
    """Indices shared by one link: first mutually distinct views in candidate order, then whatever comes next.

    ``candidates``: i, j and, per side, latitude, longitude, heading, fingerprint (suffix _i, _j), best first.
    """
    if settings.overlap <= 0:
        return []
    views: dict[int, tuple] = {}
    order: list[int] = []
    for r in candidates.to_dict("records"):
        for side in "ij":
            order.append(r[side])
            views[r[side]] = (r[f"latitude_{side}"], r[f"longitude_{side}"], r[f"heading_{side}"], r[f"fingerprint_{side}"])
    known = lambda *xs: all(x is not None and not pd.isna(x) for x in xs)

    def distinct(a: tuple, b: tuple) -> bool:
        gaps = []
        if known(a[0], b[0]):
            gaps.append(_metres(a, b) >= settings.diversity_meters)
        if known(a[2], b[2]):
            d = abs(a[2] - b[2]) % 360
            gaps.append(min(d, 360 - d) >= settings.diversity_heading)
        if known(a[3], b[3]):
            gaps.append((int(a[3]) ^ int(b[3])).bit_count() >= settings.diversity_distance if (int(a[3]) ^ int(b[3])) >= 0 else ((int(a[3]) ^ int(b[3])) & (1 << 64) - 1).bit_count() >= settings.diversity_distance)
        return any(gaps) or not gaps

    chosen: list[int] = []
    for strict in (True, False):
        for x in order:
            if len(chosen) >= settings.overlap:
                return chosen
            if x not in chosen and not (strict and any(not distinct(views[c], views[x]) for c in chosen)):
                chosen.append(x)
    return chosen


def _metres(a: tuple, b: tuple) -> float:
    from math import atan2, cos, radians, sin, sqrt

    h = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 2 * C.EARTH * atan2(sqrt(h), sqrt(max(0.0, 1 - h)))


def shared_photos(photos: DataFrame, candidates: DataFrame, settings: PlannerSettings) -> DataFrame:
    """(a, b, place, idx): photos shared by each link, in the order chosen. One link per task."""
    view = ["latitude", "longitude", "heading", "fingerprint"]
    side = lambda s: photos.select(F.col("idx").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in view])
    full = candidates.join(side("i"), "i").join(side("j"), "j")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        picked = select_shared(rows.sort_values("rank"), settings)
        return pd.DataFrame({"a": key[0], "b": key[1], "place": range(len(picked)), "idx": picked})

    # Hashes as text keep 64 bits through pandas where some are null.
    typed = full.withColumns({f"fingerprint_{s}": F.col(f"fingerprint_{s}").cast("string") for s in "ij"})
    return typed.groupBy("a", "b").applyInPandas(run, "a int, b int, place int, idx long")


def viewpoint_spread(selected: DataFrame, photos: DataFrame, *keys: str) -> DataFrame:
    """(keys, spread): the larger of mean hash distance over 0.35 and widest angle over 90, each at most 1.

    Over all pairs of a group without making one: bits that differ are counted bit by bit (photos with the bit times those
    without), and a heading's widest angle is the one to its nearest neighbour of the opposite direction. Only distinct
    headings of a group meet in a window.
    """
    own = selected.select(*keys, "idx").join(photos.select("idx", "heading", "fingerprint"), "idx")
    bit = lambda k: F.count_if(F.shiftright("fingerprint", k).bitwiseAND(F.lit(1)) == 1)
    counts = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.count("fingerprint").alias("m"), F.array(*[bit(k) for k in range(64)]).alias("ones"))
    unequal = F.aggregate("ones", F.lit(0).cast("long"), lambda n, c: n + c * (F.col("m") - c))
    mean = F.when(F.col("m") > 1, unequal / (F.col("m") * (F.col("m") - 1) / 2) / 64.0 / SPREAD_REFERENCE)

    turned = own.filter("heading IS NOT NULL").select(*keys, (F.pmod(F.col("heading"), F.lit(360.0))).alias("at"))
    known = turned.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    points = turned.distinct()
    marks = points.select(*keys, "at", F.col("at").alias("own")).unionAll(points.select(*keys, F.pmod(F.col("at") + 180.0, F.lit(360.0)).alias("at"), F.lit(None).cast("double").alias("own")))
    order = Window.partitionBy(*keys).orderBy("at")
    # Equal places are peers of a range frame, so a heading that is exactly opposite is seen.
    near = marks.select(*keys, "at", "own", F.last("own", True).over(order.rangeBetween(Window.unboundedPreceding, 0)).alias("below"), F.first("own", True).over(order.rangeBetween(0, Window.unboundedFollowing)).alias("above")).filter("own IS NULL")
    facing = near.join(known.withColumnsRenamed({k: f"{k}_" for k in keys}), [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    gap = F.least(*[C.angle(F.coalesce(F.col(x), F.col(y)), F.col("at")) for x, y in (("below", "last"), ("above", "first"))])
    widest = facing.groupBy(*keys).agg(F.max(F.when(F.col("n") > 1, 180 - gap) / 90).alias("widest")).withColumnsRenamed({k: f"{k}_" for k in keys})
    # least and greatest skip nulls, so each side is capped only where it is known.
    cap = lambda c: F.when(c.isNotNull(), F.least(F.lit(1.0), c))
    both = counts.filter("members > 1").join(widest, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], "left")
    return both.select(*keys, F.greatest(cap(mean), cap(F.col("widest"))).alias("spread"))


def group_photos(photos: DataFrame, request: SortRequest) -> tuple:
    """Edges, groups and what was decided on the way."""
    settings = request.grouping
    seen = pairs.coverage(photos, settings).first().asDict()
    used = pairs.usable(seen, settings)
    edges = graph.checkpointed(pairs.scored(pairs.candidates(photos, settings, "visual" in used), photos, settings, used))
    if photos.limit(2).count() < 2:
        return edges, photos.select("idx", F.lit("group-01").alias("group_id"), F.lit(0).alias("position")), 0.0, used, seen
    threshold = settings.threshold if settings.threshold is not None else graph.score_threshold(edges)
    rooted = graph.components(photos, edges, threshold)
    parts = graph.checkpointed(graph.split_components(rooted, edges, settings))
    return edges, graph.checkpointed(graph.final_groups(parts, edges, settings)), threshold, used, seen


def sort_photos(photos: DataFrame, request: SortRequest, hash_col: str = "near_hash", unreadable: DataFrame | None = None) -> Sorted:
    """Everything but the sink: lazy tables plus group-level facts. Files of ``unreadable`` (relative_path) are excluded with score 0."""
    request.validate()
    photos = graph.checkpointed(photos)
    outcome = quality.quality_outcome(photos, request.quality, hash_col)
    if unreadable is not None:
        outcome = outcome.unionByName(unreadable.select("relative_path", F.lit("unreadable").alias("reason"), F.lit(0.0).alias("score")), allowMissingColumns=True)
    outcome = graph.checkpointed(outcome)
    from capsort.sources.photos import capture_order

    kept = graph.checkpointed(capture_order(outcome.filter("reason IS NULL").drop("idx", "reason", "score")))
    edges, groups, threshold, used, seen = group_photos(kept, request)
    ranked = graph.checkpointed(graph.link_candidates(groups, edges))
    sure = graph.capped_of(graph.ranked_links(ranked), request.grouping.max_links_per_group)
    spark = photos.sparkSession
    table = spark.createDataFrame([(a, b) for a, b, _ in sure], "a int, b int")
    shared = graph.checkpointed(shared_photos(kept, ranked.join(F.broadcast(table), ["a", "b"]), request.planner))
    graph.dropped(ranked)
    bars = [r.n for r in histogram(edges, "score", 20, 0.0, 1.0).orderBy("bin").collect()]
    return Sorted(outcome, kept, edges, groups, sure, shared, threshold, used, seen, bars)


def plan_rows(s: Sorted) -> DataFrame:
    """(group_id, idx, shared): own photos of each group and those it takes over from its links."""
    own = s.groups.filter("position IS NOT NULL").select("position", "group_id", "idx", F.lit(False).alias("shared"))
    ends = s.shared.select(F.col("a").alias("position"), "idx").unionAll(s.shared.select("b", "idx")).distinct()
    extra = ends.join(own.select("position", "idx"), ["position", "idx"], "left_anti").join(own.select("position", "group_id").distinct(), "position")
    return own.select("group_id", "idx", "shared").unionByName(extra.select("group_id", "idx", F.lit(True).alias("shared")))


def capture_ranges(s: Sorted) -> DataFrame:
    own = s.groups.filter("position IS NOT NULL").join(s.photos.select("idx", "t"), "idx")
    return own.groupBy("group_id").agg(F.min("t").alias("capture_start"), F.max("t").alias("capture_end"), F.count(F.lit(1)).alias("n"))


def diagnose(s: Sorted, request: SortRequest) -> list[tuple[str, str, str]]:
    """(severity, code, message) in rule order, from group-level facts."""
    out: list[tuple[str, str, str]] = []
    say = lambda severity, code, text: out.append((severity, code, text))
    sizes = {r.group_id: r.n for r in plan_rows(s).groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [("error", "noGroups", "no group could be formed")]
    say("info", "summary", f"{len(sizes)} groups, {sum(sizes.values())} placements")
    say("info", "nextStep", "reconstruct each group, then merge along its links")
    if len(sizes) == 1:
        say("info", "singleGroup", "all photos form one group")
    most = min(HARDWARE_LIMIT, request.max_per_group)
    for name, n in sorted(sizes.items()):
        if n > most:
            say("warning", "groupTooLarge", f"{name}: {n} photos")
        elif n < request.min_per_group:
            say("warning", "groupTooSmall", f"{name}: {n} photos")
    counts = {(r.a, r.b): r.n for r in s.shared.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    spreads = {(r.a, r.b): r.spread for r in viewpoint_spread(s.shared, s.photos, "a", "b").collect()}
    for a, b, _ in s.links:
        if counts.get((a, b), 0) < 10:
            say("warning", "sharedPhotosTooFew", f"{a + 1}-{b + 1}: {counts.get((a, b), 0)} photos")
        if spreads.get((a, b)) is not None and spreads[a, b] < 0.15:
            say("warning", "viewpointDegenerate", f"{a + 1}-{b + 1}: {spreads[a, b]:.2f}")
    linked = {x for a, b, _ in s.links for x in (a, b)}
    if len(sizes) > 1:
        for p in range(len(sizes)):
            if p not in linked:
                say("warning", "isolatedGroup", f"group-{p + 1:02d} has no link")
    parts = graph.islands(list(range(len(sizes))), [(a, b) for a, b, _ in s.links])
    if parts > 1:
        say("error", "disconnected", f"{parts} separate sets of groups")
    reasons = {r.reason: r.n for r in s.outcome.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    if reasons:
        say("info", "excludedBreakdown", ", ".join(f"{quality.REASONS[k]}: {reasons[k]}" for k in quality.REASONS if k in reasons))
    if quality.blur_threshold(s.outcome.filter("reason IS NULL OR reason IN ('blur', 'duplicate')"), request.quality)[2]:
        say("warning", "blurFilterSuppressed", "the blur threshold would have dropped too many photos")
    say("info", "evidenceUsed", ", ".join(k for k in request.grouping.weights if k in s.used))
    if "time" not in s.used:
        say("warning", "noCaptureTime", "capture times are missing")
    if "gps" not in s.used and s.coverage["gps"] < 0.5:
        say("info", "noUsableLocation", "locations are missing or inexact")
    n, focal, lenses, cameras = s.photos.agg(F.count(F.lit(1)), F.count("focal_length"), F.count_distinct(F.round("focal_length")), F.count_distinct("camera_model")).first()
    if lenses > 1 and focal >= n // 2:
        say("warning", "mixedFocalLength", f"{lenses} focal lengths")
    if cameras > 1:
        say("info", "mixedCamera", f"{cameras} cameras")
    lost = s.groups.filter("position IS NULL").count()
    if lost:
        say("warning", "unassigned", f"{lost} photos")
    return out


def placement_total(s: Sorted) -> int:
    """Files that will be placed: photos of all groups, shared ones in each, excluded and unassigned ones."""
    return plan_rows(s).count() + s.outcome.filter("reason IS NOT NULL").count() + s.groups.filter("position IS NULL").count()


def manifest_facts(s: Sorted, request: SortRequest, source: str, generated_at: str) -> dict:
    """What the manifest says about groups as wholes: no list of photos but those that links share (``overlap`` a link)."""
    survivors = s.outcome.filter("reason IS NULL OR reason IN ('blur', 'duplicate')")
    sharp, median, _ = quality.blur_threshold(survivors, request.quality)
    reasons = {r.reason: r["n"] for r in s.outcome.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = s.photos.select("idx", "relative_path")
    spreads = {(r.a, r.b): r.spread for r in viewpoint_spread(s.shared, s.photos, "a", "b").collect()}
    between = {(r.a, r.b): list(r.paths) for r in s.shared.join(names, "idx").groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "relative_path"))), lambda x: x["relative_path"]).alias("paths")).collect()}
    n_in, n_kept = s.outcome.count(), s.outcome.filter("reason IS NULL").count()
    return {
        "version": 1, "generatedAt": generated_at, "source": source,
        "settings": {
            "overlap": request.overlap, "maxPerGroup": request.max_per_group, "minPerGroup": request.min_per_group, "timeGap": request.time_gap, "groupThreshold": s.threshold,
            "groupThresholdWasAutomatic": request.group_threshold is None, "sharpnessThreshold": sharp, "duplicateDistance": request.duplicate_distance, "link": request.link,
        },
        "evidence": {"used": [k for k in request.grouping.weights if k in s.used], "coverage": s.coverage},
        "statistics": {"inputCount": n_in, "keptCount": n_kept, "groupCount": s.groups.filter("position IS NOT NULL").select("position").distinct().count(), "excludedByReason": reasons, "scoreHistogram": s.histogram, "sharpnessMedian": median},
        "adjacency": [{"a": f"group-{a + 1:02d}", "b": f"group-{b + 1:02d}", "confidence": c, "sharedPhotos": between.get((a, b), []), "viewpointSpread": spreads.get((a, b))} for a, b, c in s.links],
        "diagnostics": [{"severity": a, "code": b, "message": c} for a, b, c in diagnose(s, request)],
    }


def manifest_rows(s: Sorted) -> DataFrame:
    """(section, name, body): one row a group, excluded photo and unassigned photo, body as JSON; write it anywhere, of any size."""
    names = s.photos.select("idx", "relative_path")
    paths = plan_rows(s).join(names, "idx").groupBy("group_id").agg(F.array_sort(F.collect_list("relative_path")).alias("photos"), F.array_sort(F.collect_list(F.when(F.col("shared"), F.col("relative_path")))).alias("shared"))
    when = lambda c: F.date_format(F.timestamp_seconds(F.floor(c)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    times = capture_ranges(s).select("group_id", when(F.col("capture_start")).alias("captureStart"), when(F.col("capture_end")).alias("captureEnd"))
    groups = paths.join(times, "group_id", "left").withColumn("evidence", F.array(*[F.lit(k) for k in sorted(s.used)]).cast("array<string>"))
    group = F.struct(F.col("group_id").alias("id"), "photos", "shared", "evidence", "captureStart", "captureEnd")
    excluded = F.struct(F.col("relative_path").alias("photo"), "reason", "score")
    return (
        groups.select(F.lit("groups").alias("section"), F.col("group_id").alias("name"), F.to_json(group).alias("body"))
        .unionAll(s.outcome.filter("reason IS NOT NULL").select(F.lit("excluded"), "relative_path", F.to_json(excluded)))
        .unionAll(s.groups.filter("position IS NULL").join(names, "idx").select(F.lit("unassigned"), "relative_path", F.to_json(F.struct("relative_path"))))
    )


def manifest(s: Sorted, request: SortRequest, source: str, generated_at: str) -> str:
    """One JSON document with sorted keys. It holds every path once or more, so only for sets whose list one file can hold; else ``manifest_rows``."""
    body: dict = manifest_facts(s, request, source, generated_at) | {"groups": [], "excluded": [], "unassigned": []}
    for r in manifest_rows(s).orderBy("section", "name").toLocalIterator():
        own = json.loads(r.body)
        body[r.section].append(own["relative_path"] if r.section == "unassigned" else own)
    return json.dumps(body, sort_keys=True, indent=2, ensure_ascii=False)


def read_manifest(spark: SparkSession, text: str) -> tuple[dict, DataFrame]:
    """A manifest read back: its facts, and (group_id, relative_path, shared) of its groups. Other versions are an error."""
    body = json.loads(text)
    if body.get("version") != 1:
        raise ValueError(f"manifest version {body.get('version')!r} is not known")
    rows = [(g["id"], p, p in set(g["shared"])) for g in body["groups"] for p in g["photos"]]
    return {k: v for k, v in body.items() if k not in ("groups", "excluded", "unassigned")}, spark.createDataFrame(rows, "group_id string, relative_path string, shared boolean")


def placements(s: Sorted) -> DataFrame:
    """(bucket, relative_path, file_name): where each photo goes; write it with ``partitionBy('bucket')``."""
    flat = C.flat_name(F.col("relative_path"))
    names = s.photos.select("idx", "relative_path")
    grouped = plan_rows(s).join(names, "idx").select(F.col("group_id").alias("bucket"), "relative_path", flat.alias("file_name"))
    dropped = s.outcome.filter("reason IS NOT NULL").select(F.concat(F.lit("_excluded/"), F.col("reason")).alias("bucket"), "relative_path", flat.alias("file_name"))
    lost = s.groups.filter("position IS NULL").join(names, "idx").select(F.lit("_unassigned").alias("bucket"), "relative_path", flat.alias("file_name"))
    return grouped.unionByName(dropped).unionByName(lost)
