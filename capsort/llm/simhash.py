"""SimHash near-duplicates by multi-index hashing.

Fingerprint: 64 bits, one XXH64 per word shingle, a bit set where over half of the hashes have it. Pairs
within ``bits`` differing bits are found exactly: the 64 bits are cut into ``SEGMENTS`` segments, so a pair
differs by at most ``bits // SEGMENTS`` in one of them. Each distinct fingerprint enumerates the Hamming
ball of that radius in each segment, fetches the table's matches by an equi-join, and the complete distance
is verified inside the join. A pair is reported by its first agreeing segment only, so no distinct is needed.

Copies share a fingerprint and are joined once as one vertex: a group of copies costs one vertex, whatever
its size. Components come from min-label propagation with pointer jumping over the distinct
fingerprints that have a link; each round is a table in the shared folder. Nothing is collected.

``keep_representatives`` keeps the pairs among these whose word shingles are similar (five words, 0.8 or more): pairs within
``bits`` by the same search over fingerprints of such shingles, then an exact check on whole sets. In many pairs that similar 15 %
of the bits differ, which no fingerprint tells exactly, so an exact search for the others follows. Each distinct set of shingles is one vertex. All
shingles have one total order; two sets as similar as asked share one of the first shingles of both (prefix
filter), so an equi-join on these meets every such pair, whatever else the corpus holds. Each pair met is
verified on its whole sets before components are built. Shingles that a sample shows to be frequent come last in the
order: the sample sets the cost, never the result.

Defined cases: a null text has no words; no words give fingerprint zero, linked like any other; fewer words
than a shingle give one shingle, the whole sequence. Rows with equal ids each get their row. A null id never
names a component unless all ids of it are null. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsort.llm.common import cut, drop_tables, hand_back, lean, perhaps_in

WORDS, BITS, SEED = 4, 4, 42
#: Bit ranges (start, width) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Word shingles and similarity of ``keep_representatives``.
SHINGLE, SIMILARITY = 5, 0.8
#: Texts sampled for frequent shingles, share of them that makes one frequent, and most of these kept.
SAMPLED, FREQUENT, MOST = 20_000, 0.0005, 50_000
#: Sets that a task remembers to send their shingles once: sets the cost, never the result.
REMEMBERED = 1_000_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; none for a text without words."""
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and exactly space and \t \n \v \f \r.
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    whole = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)] if parts else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(parts) - words + 1
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number of the bits that over half of ``hashes`` have; 0 for no hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255  # 255 rows are added without leaving bytes
        ones += bits[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[full:].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, mark (a hash of the text) and fp (the fingerprint's bits as a signed long), one row a document, one narrow scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["doc_id", "mark", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(run, "doc_id long, mark long, fp long")


def _segment(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def _ball(value: Column, width: int, radius: int) -> list[Column]:
    flips = [0]
    for _ in range(radius):
        flips = sorted({f ^ (1 << b) for f in flips for b in range(width)} | set(flips))
    return [value.bitwiseXOR(F.lit(f).cast("long")) for f in flips]


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """All pairs a < b of the column fp of ``distinct`` (distinct values) within ``bits`` differing bits."""
    radius = bits // len(SEGMENTS)
    fp = F.col("fp")
    tag = [F.lit(s << 32).cast("long") for s in range(len(SEGMENTS))]
    table = distinct.select(fp.alias("b"), F.explode(F.array(*[tag[s] + _segment(fp, *x) for s, x in enumerate(SEGMENTS)])).alias("key"))
    balls = F.concat(*[F.array(*[tag[s] + v for v in _ball(_segment(fp, *x), x[1], radius)]) for s, x in enumerate(SEGMENTS)])
    probes = distinct.select(fp.alias("a"), F.explode(balls).alias("key"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    earlier = F.lit(True)
    for s, x in enumerate(SEGMENTS[:-1]):  # an earlier segment would have reported the pair
        earlier = earlier & ((F.shiftright(F.col("key"), 32) <= s) | (F.bit_count(_segment(differ, *x)) > radius))
    fits = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= bits) & earlier
    keyed = table.withColumnRenamed("key", "key_b")
    return probes.join(keyed, (F.col("key") == F.col("key_b")) & fits).select("a", "b")


def thinned(pairs: DataFrame) -> DataFrame:
    """Fewer pairs a < b with the same components: each b's smaller neighbours are tied to the least of them.

    A clique becomes a star, so what later rounds read grows with the nodes of a dense group, not its pairs.
    """
    tied = pairs.withColumn("least", F.min("a").over(Window.partitionBy("b")))
    return tied.select(F.col("least").alias("a"), F.col("a").alias("b")).filter("a < b").unionAll(tied.select("least", "b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of the undirected ``pairs`` (a, b).

    Each round takes the least label of the neighbours and then jumps to that label's label, so chains
    shorten by about half a round. Ends when no label changes.
    """
    pairs = cut(thinned(cut(thinned(cut(pairs)))))
    edges = cut(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(pairs.select("b", "a")))
    labels = cut(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")))
    while True:
        near = edges.join(labels, edges.v == labels.node).groupBy("u").agg(F.min("root").alias("near"))
        best = labels.join(near, labels.node == near.u).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("up"), F.col("root").alias("jump"))
        jumped = best.join(up, best.root == up.up, "left").select("node", F.least("root", "jump").alias("root"), "old")
        after = cut(jumped)
        changed = after.filter(F.col("root") != F.col("old")).limit(1).count()
        drop_tables(labels.sparkSession, [labels])
        labels = after.select("node", "root")
        if not changed:
            drop_tables(labels.sparkSession, [edges])
            return labels


def _head() -> Column:
    """The least row of a group: null ids last, then id and text hash."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("head")


def _classes(prints: DataFrame, bits: int) -> DataFrame:
    nodes = prints.groupBy("fp").agg(_head())
    return cut(_rooted(nodes, links(nodes.select("fp"), bits)).withColumnRenamed("fp", "fp_"))


def _rooted(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``nodes`` with the column root, the component by ``pairs``; itself if it has no pair."""
    roots = components(pairs)
    return nodes.join(roots, nodes.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, words))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches: what a task holds at once is bounded by them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _least_common(size: int, share: float) -> int:
    return math.ceil(size * share - 1e-9)


def _sampled(docs: DataFrame) -> DataFrame:
    """About ``SAMPLED`` of the texts, chosen by their hash."""
    rate = min(1.0, SAMPLED / max(1, docs.count()))
    return docs.select("text").filter(F.pmod(F.xxhash64(F.lit("frequent"), "text"), F.lit(1_000_000)) < F.lit(int(rate * 1_000_000)))


def frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Hashes of the shingles that many sampled texts hold, the most frequent last."""
    sample = _sampled(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words).view(np.int64))], ["key"])

    counts = sample.mapInArrow(lean(run), "key long").groupBy("key").count()
    least = max(3, int(FREQUENT * SAMPLED))
    rows = counts.filter(F.col("count") >= least).orderBy(F.desc("count"), "key").limit(MOST).collect()
    return np.array([r.key for r in reversed(rows)], np.int64).view(np.uint64)


def parities(own: np.ndarray) -> np.ndarray:
    """Bits, as many as the least power of two that is no less than the set: whether it has an odd number of hashes there.

    Two sets differ in at least as many hashes as bits.
    """
    bits = max(64, 1 << (max(1, len(own)) - 1).bit_length())
    odd = np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _differing(x: Column, y: Column) -> Column:
    """Bits in which parities differ; the longer ones are folded once if they are twice as long, else 0 (nothing is known)."""
    count = lambda u, v: F.aggregate(F.zip_with(u, v, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)
    half = lambda u: F.zip_with(F.slice(u, F.lit(1), (F.size(u) / 2).cast("int")), F.slice(u, (F.size(u) / 2).cast("int") + 1, (F.size(u) / 2).cast("int")), lambda a, b: a.bitwiseXOR(b))
    twice = lambda u, v: F.size(u) == 2 * F.size(v)
    return F.when(F.size(x) == F.size(y), count(x, y)).when(twice(x, y), count(half(x), y)).when(twice(y, x), count(x, half(y))).otherwise(0)


def sets(docs: DataFrame, words: int, similarity: float, last: np.ndarray) -> DataFrame:
    """doc_id, mark, fp (a hash of the set of shingles), print (SimHash fingerprint), size (of the set), odd (its parities) and keys, its first shingles in the order.

    The order is that of the hashes, with those of ``last`` after all others in the order given. A set that a task has met
    before gets null keys.
    """
    place = np.argsort(last)
    known = last[place]

    def first(own: np.ndarray) -> np.ndarray:
        n = len(own) - _least_common(len(own), similarity) + 1 if len(own) else 0
        rank = np.zeros(len(own), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            rank = np.where(known[at] == own, place[at] + 1, 0)
        return own[np.argsort(rank, kind="stable")[:n]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in _slices(batches):
            names, prints, sizes, odd, keys = [], [], [], [], []
            for t in batch.column(2).to_pylist():
                hashes = shingle_hashes(t, words)
                own = np.unique(hashes)
                name = xxhash.xxh64_intdigest(own.tobytes(), SEED) if len(own) else 0
                names.append(name)
                prints.append(majority(hashes))
                sizes.append(len(own))
                odd.append(parities(own))
                keys.append(None if name in met else first(own).view(np.int64))
                if len(met) < REMEMBERED:
                    met.add(name)
            bits = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (names, prints)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *bits, pa.array(sizes, pa.int32()), pa.array(odd, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "mark", "fp", "print", "size", "odd", "keys"])
            del names, prints, sizes, odd, keys, bits
            hand_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, mark long, fp long, print long, size int, odd array<long>, keys array<long>")


def whole_sets(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node and own (its whole set) of the nodes of ``pairs``; the text of one row of each is read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            own = pa.array([shingle_set(t, words).view(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), own], ["node", "own"])
            del own
            hand_back()

    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = cut(named.join(nodes, F.col("node") == F.col("fp")).select("node", F.col("head.mark").alias("mark_"), F.col("head.doc_id").alias("id_")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    hit = perhaps_in(wanted, "mark_")
    # A table of its own: the bitmap's test and the sets in one task would need two workers a core.
    texts = cut((rows.filter(hit("mark")) if hit else rows).join(wanted, (F.col("mark") == F.col("mark_")) & F.col("doc_id").eqNullSafe(F.col("id_"))).select("node", "text"))
    own = cut(texts.mapInArrow(lean(run), "node long, own array<long>").dropDuplicates(["node"]))
    drop_tables(docs.sparkSession, [wanted, texts])
    return own


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of sets those whose whole sets have this Jaccard similarity or more.

    Two sets that similar differ in a bounded number of hashes, so in no more parities: most pairs go by that alone
    and only the sets of the others are fetched.
    """
    first, second = (nodes.select(F.col("fp").alias(f"fp_{x}"), F.col("size").alias(f"size_{x}"), F.col("odd").alias(f"odd_{x}")) for x in "ab")
    most = (F.col("size_a") + F.col("size_b")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)
    left = pairs.join(first, F.col("a") == F.col("fp_a")).select("a", "b", "size_a", "odd_a")
    close = cut(left.join(second, (F.col("b") == F.col("fp_b")) & (_differing(F.col("odd_a"), F.col("odd_b")) <= most)).select("a", "b"))
    own = whole_sets(close, nodes, docs, words)
    left, right = (own.select(F.col("node").alias(f"node_{x}"), F.col("own").alias(f"own_{x}")) for x in "ab")
    common = F.size(F.array_intersect("own_a", "own_b"))
    alike = common / (F.size("own_a") + F.size("own_b") - common) >= F.lit(similarity)
    found = cut(close.join(left, F.col("a") == F.col("node_a")).join(right, (F.col("b") == F.col("node_b")) & alike).select("a", "b"))
    drop_tables(docs.sparkSession, [close, own])
    return found


def _ordered(met: DataFrame) -> DataFrame:
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shared_places(prints: DataFrame, similarity: float) -> DataFrame:
    """fp, size, short, at (place in the order) and key: the first shingles of sets that another set has among its first."""
    # One exchange of three longs a shingle: size and place go in one.
    rows = prints.select("fp", "size", F.posexplode("keys").alias("at", "key")).select("key", "fp", (F.shiftleft(F.col("size").cast("long"), 32) + F.col("at")).alias("where"))
    near = Window.partitionBy("key")
    common = rows.withColumns({"low": F.min("fp").over(near), "high": F.max("fp").over(near)}).filter("low != high").dropDuplicates(["key", "fp"])
    size = F.shiftright("where", 32).cast("int")
    short = size - F.ceil(size * F.lit(2 * similarity / (1 + similarity)) - F.lit(1e-9)) + 1
    return common.select("fp", size.alias("size"), short.cast("int").alias("short"), F.col("where").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at"), "key")


def hashed_pairs(nodes: DataFrame, bits: int) -> DataFrame:
    """Pairs (a, b) of fp of ``nodes`` (fp, print) that SimHash ties: those of one fingerprint to the least of them, and these leads by multi-index hashing.

    Neighbours of a fingerprint are tied to the least of them, so a dense group is linear in its size.
    """
    leads = cut(nodes.groupBy("print").agg(F.min("fp").alias("lead")))
    same = nodes.join(leads.withColumnRenamed("print", "print_"), F.col("print") == F.col("print_")).filter("fp <> lead").select(F.col("lead").alias("a"), F.col("fp").alias("b"))
    close = cut(thinned(cut(links(leads.select(F.col("print").alias("fp")), bits))))
    first, second = (leads.select(F.col("print").alias(f"print_{x}"), F.col("lead").alias(f"lead_{x}")) for x in "ab")
    tied = close.join(first, F.col("a") == F.col("print_a")).join(second, F.col("b") == F.col("print_b")).select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))
    return same.unionAll(tied)


def similar_links(places: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: float, bits: int = BITS) -> DataFrame:
    """Pairs a < b of fp of ``nodes`` (fp, head, print, size, odd; fp distinct) with the components of all pairs that are similar.

    Pairs that SimHash finds and pairs of common shingles are verified alike. Of two sets the larger sends its first shingles to those of the smaller, which needs fewer. Shingles of one set
    go first. Then each set is held against the tip of each of its shingles, the set with the fewest rarer shingles there, which
    of copies is the one with the fewest changes: a dense group becomes few stars, linear in its size. Last, pairs
    of different stars are met: pairs within a star's component would change no component.
    """
    share = 2 * similarity / (1 + similarity)

    def fits(x: str, y: str) -> Column:
        """At the first shingle that both sets hold, what is left of them can still make up the similarity."""
        total = F.col(f"size_{x}") + F.col(f"size_{y}")
        left = F.least(F.col(f"size_{x}") - F.col(f"at_{x}"), F.col(f"size_{y}") - F.col(f"at_{y}"))
        return left >= F.lit(share / 2) * total - F.lit(1e-6)

    def side(table: DataFrame, x: str, *more: str) -> DataFrame:
        return table.select(F.col("fp").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("size", "at", "key", *more)])

    tips = places.groupBy("key").agg(F.min(F.struct("at", "size", "fp")).alias("tip")).select("key", "tip.*")
    led = side(tips, "a").join(side(places, "b"), (F.col("key_a") == F.col("key_b")) & (F.col("a") != F.col("b")) & fits("a", "b"))
    tried = cut(_ordered(hashed_pairs(nodes, bits).unionAll(led.select("a", "b"))))
    stars = verified(tried, nodes, docs, words, similarity)

    roots = _rooted(nodes.select("fp"), stars).withColumnRenamed("fp", "fp_")
    rooted = cut(places.join(roots, F.col("fp") == F.col("fp_")).drop("fp_"))
    mixed = rooted.groupBy(F.col("key").alias("key_")).agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key_")
    apart = cut(rooted.join(mixed, F.col("key") == F.col("key_")).drop("key_"))
    drop_tables(docs.sparkSession, [rooted])
    later = (F.col("size_a") > F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") > F.col("b")))
    table = side(apart, "b", "short", "root").filter("at_b < short_b")
    met = side(apart, "a", "root").join(table, (F.col("key_a") == F.col("key_b")) & (F.col("root_a") != F.col("root_b")) & later & fits("a", "b"))
    last = cut(_ordered(met).join(tried, ["a", "b"], "left_anti"))
    drop_tables(docs.sparkSession, [apart, tried])
    return stars.unionAll(verified(last, nodes, docs, words, similarity))


def _similar_classes(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, mark, fp) and the classes (fp_, head, root) of their sets of shingles."""
    prints = cut(sets(docs, words, similarity, frequent(docs, words)))
    nodes = cut(prints.groupBy("fp").agg(_head(), F.min("print").alias("print"), F.min("size").alias("size"), F.first("odd").alias("odd")))
    rows = cut(prints.select("doc_id", "mark", "fp"))
    places = cut(shared_places(prints, similarity))
    drop_tables(docs.sparkSession, [prints])
    found = similar_links(places, nodes, docs, words, similarity)
    drop_tables(docs.sparkSession, [places])
    return rows, cut(_rooted(nodes.select("fp", "head"), found).withColumnRenamed("fp", "fp_"))


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """Per document: doc_id, fp (long), fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = cut(fingerprints(docs, words))
    named = _classes(prints, bits)
    ids = named.groupBy("root").agg(F.min("head")["doc_id"].alias("component_id"))
    by_print = named.join(ids, "root").select("fp_", "component_id")
    return prints.join(by_print, prints.fp == by_print.fp_).select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id, null ids last, ties by the text's hash.

    Groups are the components of all pairs that share ``similarity`` or more of their distinct word shingles: those that SimHash and
    multi-index hashing find, checked on whole sets, and those that only the search over common shingles finds.

    The row is told by id and text, so rows of one id (or of none) in different groups are all kept; rows that repeat
    both count as one.
    """
    rows, named = _similar_classes(docs, words, similarity)
    heads = named.groupBy(F.col("root").alias("root_")).agg(F.min("head").alias("first"))
    classes = named.join(heads, F.col("root") == F.col("root_")).select("fp_", "first")
    other = ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("mark") != F.col("first.mark"))
    gone = cut(rows.join(classes, F.col("fp") == F.col("fp_")).filter(other).select(F.col("doc_id").alias("__capsort_id"), F.col("mark").alias("__capsort_mark")).distinct())
    again = cut(rows.groupBy(F.col("doc_id").alias("__capsort_id"), F.col("mark").alias("__capsort_mark")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    marked = docs.withColumn("__capsort_text", F.xxhash64("text"))

    def row(table: DataFrame) -> Column:
        return marked["doc_id"].cast("long").eqNullSafe(table["__capsort_id"]) & (marked["__capsort_text"] == table["__capsort_mark"])

    if hit := perhaps_in(gone, "__capsort_mark"):
        sure = ~hit("__capsort_text")
        kept = marked.filter(sure).unionAll(marked.filter(~sure).join(gone, row(gone), "left_anti"))
    else:
        kept = marked.join(gone, row(gone), "left_anti")
    if again.isEmpty():
        return kept.drop("__capsort_text")
    # Only rows that repeat an id and a text go through another exchange.
    once = kept.join(again, row(again), "left_semi").dropDuplicates(["doc_id", "__capsort_text"])
    return kept.join(again, row(again), "left_anti").unionAll(once).drop("__capsort_text")
