"""Scenarios of the capture-set model, and the catalogue against an independent engine."""

import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from capsort import catalogue, command
from capsort.config import GroupingSettings, QualitySettings, SortRequest
from capsort.functions import columns as C
from capsort.functions import texts
from capsort.operators import graph, pairs, quality, raster, simulate, stats
from capsort.plans import sorting
from capsort.sources import feed, images, pointcloud, staging
from capsort.streaming import events

DATA = "/root/testdata/sf0.001"

#: A small feed: five releases, of which three are channels.
FEED = """[{"tag_name":"dev-zoo","prerelease":true,"target_commitish":"0123456789abcdef","body":"branch=feature/zoo\\ncommit=89abcdef0123","assets":[{"name":"other.zip","browser_download_url":"u0"},{"name":"app.zip","browser_download_url":"u1"}]},
{"tag_name":"stable","name":"Stable","prerelease":false,"target_commitish":"fedcba9876543210","body":"built=2024-05-01","assets":[{"name":"app.zip","browser_download_url":"u2"}]},
{"tag_name":"v1.0","prerelease":false,"body":"","assets":[{"name":"app.zip","browser_download_url":"u3"}]},
{"tag_name":"dev-none","prerelease":true,"assets":[]},
{"tag_name":"dev-ant","prerelease":true,"target_commitish":"aaaabbbbcccc","assets":[{"name":"app.zip","browser_download_url":"u4"}]}]"""


def photo(spark, rows):
    """Synthetic photos: (offset s, hash, heading, sharpness)."""
    schema = """relative_path string, source_folder string, t double, heading double, exposure_value double, sharpness double, fingerprint long, near_hash long, pixel_width int, pixel_height int,
    highlights double, shadows double, latitude double, longitude double, altitude double, accuracy double, fix_t double, focal_length double, camera_model string, sequence_number int, idx long"""
    return spark.createDataFrame([(f"IMG_{k:04d}.HEIC", "", 1.7e9 + t, h, None, s, f, f, 4032, 3024, 0.0, 0.0, None, None, None, None, None, None, None, k, k) for k, (t, f, h, s) in enumerate(rows)], schema)


def thermometer(seed, k):
    v = seed ^ ((1 << min(k, 63)) - 1)
    return v - (1 << 64) if v >= 1 << 63 else v


def sequence(start, n, seed, base=0.0):
    return [(start + 3 * k, thermometer(seed, k), base + 4.0 * k, 100.0 + k % 5) for k in range(n)]


def test_two_rooms(spark):
    p = photo(spark, sequence(0, 30, 0) + sequence(700, 30, 0xFFFFFFFF00000000))
    s = sorting.sort_photos(p, SortRequest(duplicate_distance=0))
    sizes = sorted(r["count"] for r in s.groups.groupBy("group_id").count().collect())
    assert sizes == [30, 30]
    assert {"time", "visual"} <= s.used and "sequence" not in s.used
    assert [(a, b) for a, b, _ in s.links] == [(0, 1)]
    plan = sorting.plan_rows(s)
    assert plan.filter("shared").count() == 15
    names = [c for _, c, _ in sorting.diagnose(s, SortRequest())]
    assert names[:2] == ["summary", "nextStep"] and "disconnected" not in names
    assert '"version": 1' in sorting.manifest(s, SortRequest(), "x", "2024-01-01T00:00:00Z")


def test_long_run_is_split_into_contiguous_parts():
    edges = [(i, j, math.exp(-(j - i) / 10)) for i in range(100) for j in range(i + 1, min(100, i + 20))]
    parts = graph.bisect(list(range(100)), edges, 30, 10)
    assert sum(map(len, parts)) == 100 and all(len(p) <= 30 and p == list(range(p[0], p[-1] + 1)) for p in parts)


def test_absorb():
    s = GroupingSettings(min_per_group=8, max_per_group=20)
    assert graph.absorb([12, 3, 12], [0, 12, 15], {(0, 1): 1.0, (1, 2): 2.0}, s) == [0, 2, 2]
    assert graph.absorb([13, 2], [0, 13], {(0, 1): 1.0}, GroupingSettings(min_per_group=8, max_per_group=13)) == [0, None]
    assert graph.absorb([3], [0], {}, s) == [0]


@pytest.mark.parametrize("sharp, dropped, suppressed", [([5.0] * 3 + [100.0] * 12, 3, False), ([100 + 4.0 * (k % 5) for k in range(20)], 0, False), ([1.0] * 9 + [10.0] * 9, 0, True)])
def test_blur(spark, sharp, dropped, suppressed):
    p = photo(spark, [(k, k, 0.0, s) for k, s in enumerate(sharp)])
    threshold, _, off = quality.blur_threshold(p, QualitySettings())
    assert off is suppressed
    assert (p.filter(F.col("sharpness") < threshold).count() if threshold is not None else 0) == dropped


def test_burst_keeps_the_sharpest_and_null_breaks(spark):
    p = photo(spark, [(0, 0xFF00, 0.0, 80.0), (1, 0xFF00, 0.0, 120.0), (2, 0xFF00, 0.0, 90.0), (3, 0x00FF, 0.0, 1.0), (4, None, 0.0, 1.0), (5, 0x00FF, 0.0, 1.0)])
    assert sorted(r.idx for r in quality.duplicate_losers(p, 4).collect()) == [0, 2]


def test_drift_compares_with_the_head(spark):
    p = photo(spark, [(k, thermometer(0, k), 0.0, 1.0) for k in range(12)])
    runs = {r.idx: r.run for r in quality.run_heads(p, 4).collect()}
    assert [runs[k] for k in range(12)] == [0] * 5 + [5] * 5 + [10] * 2


def test_otsu_and_histogram(spark):
    two = spark.createDataFrame([(10.0,)] * 30 + [(100.0,)] * 70, "v double")
    r = stats.otsu(two, "v").first()
    assert 10 < r.threshold < 100 and r.separability > 0.9 and abs(r.lower_fraction - 0.3) < 1e-9
    assert stats.otsu(two.limit(1), "v").first() is None and stats.otsu(two.filter("v < 50"), "v").first() is None
    bars = [r.n for r in stats.histogram(spark.createDataFrame([(-5.0,), (42.0,)], "v double"), "v", 4, 0.0, 1.0).orderBy("bin").collect()]
    assert bars == [1, 0, 0, 1]


def test_scalars(spark):
    rows = spark.createDataFrame([("a/IMG_0123.HEIC",), ("DSC01234.jpg",), ("photo.png",), ("20260802134512999.jpg",), ("IMG_0123 (1).jpg",)], "p string")
    assert [r[0] for r in rows.select(C.sequence_number(F.col("p"))).collect()] == [123, 1234, None, None, 1]
    one = spark.range(1)
    lit = lambda x: F.lit(x).cast("double")
    r = one.select(C.haversine(lit(35), lit(139), lit(35.001), lit(139)).alias("m"), C.angle(lit(10), lit(350)).alias("a"), C.zone_offset(F.lit("+09:00")).alias("z"), C.exposure_value(lit(8), lit(1), lit(100), F.lit(None).cast("double")).alias("e"), C.size_text(F.lit(1_500_000)).alias("s")).first()
    assert abs(r.m - 111) < 2 and r.a == 20 and r.z == 32400 and r.e == 6 and r.s == "1.5 MB"
    assert one.select(C.capture_time(F.lit("2024:01:01 09:00:00"), F.lit("+09:00"), F.lit("25")).alias("t")).first().t == 1704067200.25


def test_raster():
    assert raster.box_downsample(np.repeat(np.repeat(np.array([[100, 200], [0, 50]], np.uint8), 2, 0), 2, 1), 2, 2).tolist() == [[100, 200], [0, 50]]
    half = np.zeros((8, 8), np.uint8)
    half[:4] = 255
    assert raster.luminance(half)[1:] == (0.5, 0.5)
    board = (np.indices((16, 16)).sum(0) % 2 * 255).astype(np.uint8)
    assert raster.laplacian_variance(board) > 1e5 and raster.laplacian_variance(np.full((9, 9), 7, np.uint8)) == 0
    ramp = np.tile(np.arange(90, 0, -1, dtype=np.uint8), (80, 1))
    assert raster.difference_hash(ramp) == -1 == raster.difference_hash((ramp * 0.4).astype(np.uint8))


def test_point_cloud(spark, tmp_path):
    points = spark.createDataFrame([(1.0, -2.0, 0.0, 10, 20, 30, 40)] * 3, "x float, y float, z float, r short, g short, b short, a short")
    path = str(tmp_path / "sub" / "c.ply")
    assert pointcloud.write(points, path) == 3
    data = open(path, "rb").read()
    assert data[-16:].hex() == "0000803f000000c0000000000a141e28" and len(pointcloud.read(data)) == 3 and b"element vertex 3\n" in data


def test_events(spark):
    lines = spark.createDataFrame([(k, 1, v) for k, v in enumerate(["progress=0.1", "stage=nope", "note=a\tb", "ok", "x", "eta=3.6", "progress=abc", ""])], "seq int, run_id int, value string")
    found = events.decode(lines)
    assert [r.kind for r in found.orderBy("seq").collect()] == ["progress", "note", "finished", "eta"]
    assert [r[0] for r in found.orderBy("seq").select(events.encode()).collect()] == ["progress=0.100", "note=a\tb", "ok", "eta=4"]
    assert events.run_states(found).first().state == "ok"


def test_stream_decodes_files(spark, tmp_path):
    (tmp_path / "in" / "run=7").mkdir(parents=True)
    (tmp_path / "in" / "run=7" / "log.txt").write_text("progress=0.5\nnoise\nprogress=0.2\nok")
    q = events.stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("decoded").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.kind for r in spark.sql("SELECT kind FROM decoded").collect()) == ["finished", "progress", "progress"]


def test_feed_and_scan(spark):
    found = feed.channels(spark.createDataFrame([(FEED,)], "json string"), "app.zip").orderBy("place", "branch")
    assert [r.tag for r in found.collect()] == ["stable", "dev-ant", "dev-zoo"]
    files = spark.createDataFrame([("/in/a/x.JPG",), ("/in/group-01/y.jpg",), ("/in/.z.jpg",), ("/in/out/q.png",), ("/in/n.txt",)], "plain string").withColumn("path", F.col("plain"))
    assert [r.relative_path for r in images.select_images(files, "/in", "/in/out").collect()] == ["a/x.JPG"]


def test_simulator(spark):
    table = {(r.n, r.k): r.f_star for r in simulate.density_table(spark, [1000], [2, 4, 6, 10, 20], 0.5).collect()}
    assert [round(table[1000, k], 3) for k in (2, 4, 6, 10, 20)] == [0.955, 0.789, 0.645, 0.463, 0.267]
    assert simulate.thin([0, 1, 2, 5, 6, 9], 4, 10) == [0, 2, 6, 9]
    assert simulate.site(spark, [10, 5], 1.0, 1).filter("valid").count() == 15


def test_policies(spark):
    rng = np.random.default_rng
    whole = [simulate.cold_start(simulate.Model((1000,), 1000), rng(k))["ok"] for k in range(20)]
    thin = [simulate.cold_start(simulate.Model((500, 500, 500), 1000), rng(k))["ok"] for k in range(20)]
    assert all(whole) and not any(thin)
    found = [simulate.policy(simulate.Model((700, 200, 100), 1000), rng(k)) for k in range(5)]
    assert all(f["coverage"] == 1.0 and f["models"] == 3 and f["runs"] == 14 for f in found)
    assert all(simulate.policy(simulate.Model((1000,), 1000), rng(k))["runs"] == 6 for k in range(5))
    assert simulate.policy(simulate.Model((500, 300, 200), 1000), rng(1))["stuck"]
    even = [np.mean([simulate.proposal(simulate.Model((2000, 1000), 500), rng(k), noise)["coverage"] for k in range(5)]) for noise in (0.0, 0.3, 1.0)]
    assert even[0] > 0.95 and even[0] > even[1] > even[2]
    rows = simulate.sweep(spark, [("a", lambda r: {"ok": True, "posed": int(r.integers(9))}), ("b", lambda r: {"ok": False, "posed": 0})], 3, "ok boolean, posed long")
    assert [(r.name, r.rate) for r in simulate.trial_means(rows, "name").orderBy("name").collect()] == [("a", 1.0), ("b", 0.0)]


def test_texts(spark):
    one, lit = spark.range(1), lambda x: F.lit(x)
    say = lambda *cs: list(one.select(*cs).first())
    assert say(*[texts.remaining_text(lit(s)) for s in (-5.0, 59.9, 60.0, 1800.0, 3600.0, 5400.0)]) == ["残り 1 分未満", "残り 1 分未満", "残り約 1 分", "残り約 30 分", "残り約 1 時間", "残り約 1 時間 30 分"]
    none = F.lit(None)
    assert say(texts.progress_text(none.cast("string"), none.cast("double")), texts.progress_text(lit("meshGeneration"), none.cast("double"))) == [None, "メッシュの生成中"]
    assert say(texts.signal_name(lit(9)), texts.signal_name(lit(99)), texts.progress_phrase(none.cast("double"))) == ["シグナル 9: SIGKILL — メモリ不足などで OS に強制終了された可能性", "シグナル 99", ""]
    notes = say(texts.folder_notes(lit(0), lit(1000), lit(2), lit(True)))[0]
    assert len(notes) == 3 and notes[0].startswith("入力画像: 0 枚") and ".icloud" in notes[2]
    assert say(texts.fix_time(lit("2024:01:01"), lit("00:00:12.75")), texts.fix_time(lit("2024:01:01"), none.cast("string")), texts.signed_altitude(lit(3.0), lit(1))) == [1704067212.0, None, -3.0]
    assert say(texts.is_cloud_path(lit("/Volumes/GoogleDrive/x")), texts.is_compilation_failure(lit("x ANECCompile() FAILED"))) == [True, True]
    try:
        raise ValueError("outer") from OSError(5, "inner")
    except ValueError as e:
        assert texts.error_chain(e).splitlines() == ["outer", "  domain=ValueError code=0", "  underlying:", "    domain=OSError code=5"]


def test_staging(spark, tmp_path):
    folder, root = tmp_path / "in", tmp_path / "root"
    folder.mkdir()
    for n in ("b.JPG", "a.png", ".hid.jpg", "n.txt"):
        (folder / n).write_bytes(b"12345")
    with staging.staged_input(str(folder), str(root), wanted=True) as copy:
        assert sorted(p.name for p in type(tmp_path)(copy).iterdir()) == ["a.png", "b.JPG"]
    assert list(root.iterdir()) == []
    with pytest.raises(InterruptedError):
        staging.stage(str(folder), str(root), lambda: True)
    assert list(root.iterdir()) == [] and staging.stage(str(tmp_path / "none"), str(root)) is None
    old = root / "old"
    old.mkdir()
    assert staging.purge_stale(str(root), old.stat().st_mtime + 24 * 3600) == 0 and staging.purge_stale(str(root), old.stat().st_mtime + 24 * 3600 + 1) == 1
    places = spark.createDataFrame([("group-01", "a.png", "a.png"), ("_unassigned", "b.JPG", "b.JPG"), ("x", "lost.png", "lost.png")], "bucket string, relative_path string, file_name string")
    for link in ("hardlink", "copy", "symlink"):
        staging.place_all(places, str(folder), str(tmp_path / "out"), link)
        assert (tmp_path / "out/group-01/a.png").read_bytes() == b"12345" and (tmp_path / "out/group-01/a.png").is_symlink() == (link == "symlink")
    assert not (tmp_path / "out/x").exists() and staging.needs_staging("/Volumes/GoogleDrive") and staging.staged_name("/", "u") == "input-u"


def test_commands():
    made = command.from_arguments(["sort", "/in", "--overlap", "7", "/out", "--dry-run", "--no-recursive", "--time-gap", "12.5"])
    assert made == command.Command("/in", "/out", SortRequest(overlap=7, dry_run=True, recursive=False, time_gap=12.5))
    again = command.from_arguments(command.to_arguments(made))
    assert again.request.time_gap == 13 and again.request.overlap == 7 and not again.request.recursive
    url = "capsort://sort?input=%2Fin+1&output=/out&dryRun=YES&groupThreshold=0.4&link=copy&zzz=1"
    assert command.from_url(url) == command.Command("/in+1", "/out", SortRequest(dry_run=True, group_threshold=0.4, link="copy"))
    for bad in (["sort", "/in"], ["sort", "/a", "/b", "--overlap"], ["sort", "/a", "/b", "--overlap", "1.5"], ["sort", "/a", "/b", "--time-gap", "nan"], ["sort", "/a", "/b", "--zzz"], ["sort", "/a", "/b", "--link", "x"], ["/in"]):
        with pytest.raises(command.CommandError):
            command.from_arguments(bad)
    for bad in ("capsort://other?input=a&output=b", "x://sort?input=a&output=b", "capsort://sort?input=a&output=", "capsort://sort?input=a&output=b&recursive=maybe"):
        with pytest.raises(command.CommandError):
            command.from_url(bad)


def test_request_rules():
    assert SortRequest(max_per_group=150, overlap=15).grouping.max_per_group == 120
    assert SortRequest(max_per_group=40, min_per_group=20, overlap=15).grouping.max_per_group == 40
    for bad in ({"overlap": -1}, {"max_per_group": 9}, {"duplicate_distance": 65}, {"group_threshold": 1.5}, {"link": "x"}):
        with pytest.raises(ValueError):
            SortRequest(**bad).validate()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
@pytest.mark.parametrize("name", ["pair_score_histogram", "near_duplicate_runs", "blur_threshold", "knn_pairs", "release_feed", "progress_throttle", "join_as_of", "event_line_decode", "group_links", "shown_texts", "shown_names"])
def test_catalogue_matches_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    tidy = lambda v: round(v, 5) if isinstance(v, float) else v
    found = con.sql(catalogue.ORACLES[name])
    want = sorted([repr([tidy(r[found.columns.index(c)]) for c in cols]) for r in found.fetchall()])
    assert sorted(repr([tidy(r[c]) for c in cols]) for r in df.collect()) == want


def test_thermometer_levels(spark):
    rows = [(float(x),) for x in (-1, 0, 1, 62, 63, 64, 100, 1e30)] + [(62.9,), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(C.thermometer(F.col("x"))).collect()]
    assert got[:9] == [0, 0, 1, 2**62 - 1, 2**63 - 1, 2**63 - 1, 2**63 - 1, 2**63 - 1, 2**62 - 1]


def bmp(path, seed, w=900, h=820):
    """A 24-bit bitmap of random blocks."""
    import struct

    rng = np.random.default_rng(seed)
    rows = np.kron(rng.integers(0, 256, (h // 20, w // 20, 3), np.uint8), np.ones((20, 20, 1), np.uint8))
    body = b"".join(r.tobytes() + b"\0" * (-w * 3 % 4) for r in rows[::-1])
    with open(path, "wb") as f:
        f.write(b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body)
    return rows


def tagged(date, lat):
    """The head of a file with an EXIF block: date, offset, a position and a sub-second."""
    import struct

    texts = {0x9003: date, 0x9011: "+09:00", 0x9291: "25"}
    body, extra = b"", b""
    entries = [(0x0112, 3, 1, struct.pack("<HH", 6, 0)), (0x8769, 4, 1, None), (0x8825, 4, 1, None)]
    base = 8 + 2 + 12 * len(entries) + 4
    exif, gps = [], []
    at = base + 2 + 12 * len(texts) + 4
    for tag, text in sorted(texts.items()):
        raw = text.encode() + b"\0"
        exif.append(struct.pack("<HHI", tag, 2, len(raw)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(extra))))
        extra += raw if len(raw) > 4 else b""
    first = struct.pack("<H", len(exif)) + b"".join(exif) + b"\0" * 4 + extra
    gps_at = base + len(first)
    data = gps_at + 2 + 12 * 4 + 4
    degrees = struct.pack("<IIIIII", lat, 1, 30, 1, 0, 1)
    gps = [struct.pack("<HHI", 1, 2, 2) + b"S\0\0\0", struct.pack("<HHII", 2, 5, 3, data), struct.pack("<HHI", 3, 2, 2) + b"E\0\0\0", struct.pack("<HHII", 4, 5, 3, data)]
    second = struct.pack("<H", 4) + b"".join(gps) + b"\0" * 4 + degrees
    main = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 3)
    for tag, kind, n, raw in entries:
        main += struct.pack("<HHI", tag, kind, n) + (raw or struct.pack("<I", base if tag == 0x8769 else gps_at))
    return b"\xff\xd8\xff\xe1\0\0Exif\0\0" + main + b"\0" * 4 + first + second + body


def test_read_and_sort_a_folder(spark, tmp_path):
    from capsort import __main__ as cli
    from capsort.sources import reader

    folder = tmp_path / "in"
    (folder / "a").mkdir(parents=True)
    for k in range(12):
        bmp(folder / "a" / f"IMG_{k:04d}.BMP", k)
    (folder / "b.jpg").write_bytes(tagged("2024:05:01 12:00:00", 35))
    (folder / "empty.png").write_bytes(b"")
    (folder / "text.heic").write_bytes(b"no image")
    (folder / ".hidden.jpg").write_bytes(b"")
    photos, lost = reader.read_photos(spark, str(folder))
    rows = {r.relative_path: r for r in photos.collect()}
    assert sorted(r.relative_path for r in lost.collect()) == ["empty.png", "text.heic"] and len(rows) == 13
    one = rows["b.jpg"]
    assert one.t == 1714532400.25 and one.latitude == -35.5 and one.longitude == 35.5 and one.sharpness is None and one.fix_t is None and one.idx == 0
    pixels = rows["a/IMG_0003.BMP"]
    want = bmp(tmp_path / "x.bmp", 3)
    gray = reader.gray_image(np.ascontiguousarray(want).tobytes(), 820, 900, 3)
    assert (pixels.pixel_width, pixels.pixel_height, pixels.sequence_number, pixels.source_folder) == (900, 820, 3, "a")
    assert pixels.sharpness == raster.laplacian_variance(gray) and pixels.fingerprint == raster.difference_hash(gray)
    said = []
    out = tmp_path / "out"
    args = ["sort", str(folder), str(out), "--link", "copy", "--min-per-group", "1"]
    total = cli.sort(spark, command.from_arguments(args), said.append)
    files = [p for p in out.rglob("*") if p.is_file() and p.name != "manifest.json"]
    assert total == len(files) >= 15 and sorted(p.name for p in (out / "_excluded" / "unreadable").iterdir()) == ["empty.png", "text.heic"]
    facts, groups = sorting.read_manifest(spark, (out / "manifest.json").read_text())
    assert facts["statistics"]["inputCount"] == 15 and facts["statistics"]["excludedByReason"]["unreadable"] == 2 and facts["settings"]["groupThresholdWasAutomatic"]
    assert groups.count() == sum(p.parent.name.startswith("group-") for p in files)
    assert cli.main([]) == 2 and cli.main(["--help"]) == 0 and cli.main(["sort", "x"]) == 2 and cli.main(["sort", str(tmp_path / "none"), str(out)], spark) == 1


def test_requests_and_specs(spark, tmp_path):
    from capsort.config import ReconstructionRequest

    assert simulate.component_sizes(None, 7) == (7,) and simulate.component_sizes("3", 10) == (4, 3, 3) and simulate.component_sizes("6,4", 10) == (6, 4)
    with pytest.raises(ValueError):
        simulate.component_sizes("6,5", 10)
    here = str(tmp_path)
    ReconstructionRequest(here, "a.USDZ", "b.ply").validate()
    for bad in (ReconstructionRequest(here), ReconstructionRequest(here + "/no", "a.usdz"), ReconstructionRequest(here, "a.obj"), ReconstructionRequest(here, None, "a.xyz")):
        with pytest.raises(ValueError):
            bad.validate()
    found = feed.channels(spark.createDataFrame([('[{"tag_name":"dev-a","assets":[{"name":"x","browser_download_url":"u"}]}]',)], "json string"), "x")
    assert feed.channel("a", found).count() == 1 and feed.channel("b", found).count() == 0


def test_viewpoint_spread_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(6):
        for k in range((1, 2, 3, 12, 30, 5)[g]):
            rows.append((g, len(rows), None if rng.random() < 0.2 else float(rng.choice([0, 90, 180, 270, rng.integers(0, 3600) / 10])), None if rng.random() < 0.2 else int(rng.integers(-(2**63), 2**63))))
    p = spark.createDataFrame(rows, "g int, idx long, heading double, fingerprint long")
    got = {r.g: r.spread for r in sorting.viewpoint_spread(p.select("g", "idx"), p, "g").collect()}
    want = {}
    for g in range(6):
        own = [r for r in rows if r[0] == g]
        both = [(a, b) for i, a in enumerate(own) for b in own[:i]]
        if both:
            bits = [((a[3] ^ b[3]) & (1 << 64) - 1).bit_count() / 64 for a, b in both if a[3] is not None and b[3] is not None]
            turns = [min(abs(a[2] - b[2]) % 360, 360 - abs(a[2] - b[2]) % 360) for a, b in both if a[2] is not None and b[2] is not None]
            parts = ([min(1, sum(bits) / len(bits) / 0.35)] if bits else []) + ([min(1, max(turns) / 90)] if turns else [])
            want[g] = max(parts) if parts else None
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_pixels_are_rounded_as_single_precision(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, [-1e-8 if (i + k) % 3 else 0.01 * i for i in range(64)]) for k in range(3)]
    rows += [(3, [math.nan, math.inf, -math.inf] + [0.03 * i for i in range(61)])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("raster_statistics", "luminance_profile"):
        df = catalogue.QUERIES[name](spark, str(tmp_path))
        found = con.sql(catalogue.ORACLES[name])
        assert sorted(map(tuple, df.select(found.columns).collect())) == sorted(found.fetchall())


def plain_bisect(members, edges, most, least):
    """The rule of bisection as written down: all weights anew for each part, the lightest place in scan order."""
    if len(members) <= most:
        return [members]
    n, margin = len(members), max(1, min(least, len(members) // 4))
    place = {m: p for p, m in enumerate(members)}
    weights = [sum(s for i, j, s in edges if place[i] <= p < place[j]) for p in range(n - 1)]
    middle, best, light = (n - 1) / 2, margin - 1, float("inf")
    for p in range(margin - 1, n - margin):
        if weights[p] < light - 1e-9 or (abs(weights[p] - light) <= 1e-9 and abs(p - middle) < abs(best - middle)):
            best, light = p, weights[p]
    halves = [members[: best + 1], members[best + 1 :]]
    return [part for h in halves for part in plain_bisect(h, [e for e in edges if e[0] in set(h) and e[1] in set(h)], most, least)]


def plain_absorb(sizes, strength, settings):
    """The rule of absorption as written down: ties between all groups are added up anew in each round."""
    groups, gone = {k: [k] for k in range(len(sizes))}, set()
    total = lambda k: sum(sizes[m] for m in groups[k])
    while len(groups) > 1 and (small := next((k for k in sorted(groups) if total(k) < settings.min_per_group), None)) is not None:
        tie = lambda k: sum(s for (a, b), s in strength.items() if (a in groups[k] and b in groups[small]) or (b in groups[k] and a in groups[small]))
        room = [(tie(k), -k) for k in groups if k != small and total(k) + total(small) <= settings.max_per_group and tie(k) > 0]
        own = groups.pop(small)
        if room:
            groups[-max(room)[1]] += own
        else:
            gone |= set(own)
    return [None if m in gone else next(k for k in groups if m in groups[k]) for m in range(len(sizes))]


def test_bisection_and_absorption_follow_the_rules():
    rng = np.random.default_rng(5)
    for trial in range(60):
        n = int(rng.integers(2, 90))
        members = np.sort(rng.choice(500, n, replace=False)).tolist()
        pairs_ = {tuple(sorted(map(int, rng.choice(members, 2, replace=False)))) for _ in range(int(rng.integers(0, 5 * n)))}
        edges = [(i, j, float(rng.choice([0.25, 0.5, rng.random()]))) for i, j in sorted(pairs_)]
        most, least = int(rng.integers(2, 20)), int(rng.integers(1, 8))
        assert graph.bisect(members, edges, most, least) == plain_bisect(members, edges, most, least)
        sizes = rng.integers(1, 9, n).tolist()
        strength = {(members.index(i), members.index(j)): s for i, j, s in edges}
        s = GroupingSettings(min_per_group=int(rng.integers(1, 12)), max_per_group=int(rng.integers(8, 25)))
        assert graph.absorb(sizes, list(range(n)), strength, s) == plain_absorb(sizes, strength, s)


def test_uneven_cuts_and_many_small_parts_take_little_time():
    n = 20_000
    i = np.repeat(np.arange(n), 30)
    j = i + np.tile(np.arange(1, 31), n)
    edges = list(zip(i[j < n].tolist(), j[j < n].tolist(), (0.2 + 0.5 * i[j < n] / n).tolist(), strict=True))
    began = time.time()
    parts = graph.bisect(list(range(n)), edges, 150, 20)  # lighter towards the start: every cut takes the least part off
    assert max(map(len, parts)) <= 150 and sum(parts, []) == list(range(n))
    ends = graph.absorb([1] * 100_000, list(range(100_000)), {(k, k + 1): 1.0 for k in range(0, 99_999, 2)}, GroupingSettings())
    assert ends == [None] * 99_998 + [99_999] * 2  # the last group stays
    assert time.time() - began < 20


def test_tables_in_a_loop_keep_no_plan_estimates(spark):
    df = spark.range(100).withColumnRenamed("id", "a")
    for _ in range(4):
        other = df.withColumnRenamed("a", "b")
        df = graph.checkpointed(df.join(other, F.col("a") == F.col("b")).select("a"))
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1_000_000


def test_components_of_chains_and_blocks(spark):
    edges = [(k, k + 7, 1.0) for k in range(0, 30_000) if k % 10_007] + [(29_000, 50_000, 0.4), (60_000, 29_999, 1.0)]
    found = {r.idx: r.root for r in graph.components(spark.range(60_001).withColumnRenamed("id", "idx"), spark.createDataFrame(edges, "i long, j long, score double"), 0.5).collect()}
    root = list(range(60_001))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b, s in edges:
        if s >= 0.5:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    assert found == {k: top(k) for k in range(60_001)}


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_nearest_hashes_are_those_of_brute_force(spark, monkeypatch, block):
    for name, value in (("BLOCK", block), ("CHUNK", 16), ("QUERIES", 4), ("ROWS", 50)):
        monkeypatch.setattr(pairs, name, value)
    rng = np.random.default_rng(3)
    few = rng.integers(-(1 << 63), (1 << 63) - 1, 40)
    rows = [(k, int(few[rng.integers(0, 40)]) if k % 3 else int(rng.integers(-3, 3)) if k % 2 else None) for k in range(150)]
    got = sorted(map(tuple, pairs.nearest(spark.createDataFrame(rows, "idx long, fingerprint long"), 5).select("i", "j", "distance", "rank").collect()))
    want = []
    for i, h in rows:
        near = sorted((((h ^ g) & (1 << 64) - 1).bit_count(), j) for j, g in rows if j != i and g is not None)[:5] if h is not None else []
        want += [(i, j, d, r + 1) for r, (d, j) in enumerate(near)]
    assert got == sorted(want)


def test_runs_compare_all_64_bits(spark):
    rows = [(0, -1), (1, -2), (2, (1 << 63) - 1), (3, None), (4, 5), (5, 4), (6, -(1 << 63) + 4)]
    got = sorted(map(tuple, quality.run_heads(spark.createDataFrame(rows, "idx long, near_hash long"), 4).collect()))
    assert got == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 4), (6, 4)]
