"""Exact removal of long repeated strings by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else, in the same text or another.

Which suffixes are sorted: the array is sparse. Of the ``SPAN`` possible places from a string's start the one with
the least hash of its 8 bytes is the string's anchor. It depends on the string's own bytes alone, so
equal strings have equal anchors, and strings of one anchor share the ``CORE`` bytes after it. Anchors whose core occurs
once are dropped (counted with partial aggregation); no repeated string is lost by that.

Merge sort: each task cuts the suffixes (at most LENGTH bytes) of its anchors with the at most SPAN - 1 bytes before
them, sorts them, folds equal ones, and writes runs in which each suffix is front-coded against its predecessor. Runs are
dealt by core hash, so all suffixes with a common core meet; a loser tree that carries common-prefix lengths merges
them and never compares a known prefix again. In a stretch with common prefix >= CORE, pairs are joined
from the longest common suffix down, small sets into large ones, and each new element is held against its two neighbours in
the order of the bytes before the anchor; that is enough for the longest extension to both sides, without all pairs.

Exact copies fold into one vertex before the exchange (by text digest) and are removed whole. Equal contexts fold within
each run, so a passage that a third of all rows share is one row per run.

Defined cases: null is the empty text. Texts under LENGTH bytes stay whole. Rows that repeat a text are
copies of each other, so they go whole if long enough. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsort.llm.common import cut, drop_tables

LENGTH, SPAN, GRAM = 400, 300, 8
CORE = LENGTH - SPAN + 1
#: Texts that are joined by broadcast because of their many copies, at most.
HOT = 1000
#: Anchors that meet in one merge, about, and bytes of contexts in a task before it writes its runs.
PER_MERGE, RUN_BYTES = 20_000, 48_000_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def anchors(data: bytes) -> list[int]:
    """Places that are the anchor of some string of LENGTH bytes, ascending."""
    n = len(data)
    if n < LENGTH:
        return []
    need = n - LENGTH + SPAN
    h = np.ndarray((need,), "<u8", data, 0, (1,)) * MIX[0]
    h ^= h >> np.uint64(29)
    h *= MIX[1]
    bits = np.uint64(n.bit_length())
    h = (h >> bits << bits) | np.arange(need, dtype=np.uint64)  # ties: the first place
    blocks = np.full(-(-need // SPAN) * SPAN, np.iinfo(np.uint64).max, np.uint64)
    blocks[:need] = h
    blocks = blocks.reshape(-1, SPAN)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - LENGTH + 1
    least = np.minimum(behind[:starts], ahead[SPAN - 1 : SPAN - 1 + starts])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return at[np.concatenate(([True], at[1:] != at[:-1]))].tolist()


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no comparison."""
    n = min(len(a), len(b))
    while known < n:
        x, y = a[known : known + 32], b[known : known + 32]
        if x != y:
            size = min(len(x), len(y))
            differ = int.from_bytes(x[:size], "big") ^ int.from_bytes(y[:size], "big")
            return known + size - (differ.bit_length() + 7) // 8
        known += len(x)
    return n


Item = tuple[bytes, bytes, list]  # suffix, reversed bytes before it, places (text, position)


def encode(items: list[Item]) -> bytes:
    """A front-coded run of sorted items."""
    shared, tails, left_shared, lefts, places = [], [], [], [], []
    last, last_left = b"", b""
    for suffix, left, where in items:
        k, j = common(last, suffix), common(last_left, left)
        shared.append(k)
        tails.append(suffix[k:])
        left_shared.append(j)
        lefts.append(left[j:])
        places.append(where)
        last, last_left = suffix, left
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps((shared, tails, left_shared, lefts, places), 5))


def decode(blob: bytes) -> Iterator[tuple[int, Item]]:
    """Items of a run, each with the length of the prefix it shares with the one before."""
    shared, tails, left_shared, lefts, places = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
    suffix = left = b""
    for k, tail, j, left_tail, where in zip(shared, tails, left_shared, lefts, places, strict=True):
        suffix, left = suffix[:k] + tail, left[:j] + left_tail
        yield k, (suffix, left, where)


def merge(runs: list[Iterator[tuple[int, Item]]]) -> Iterator[tuple[int, Item]]:
    """All items in order, each with its common prefix with the one before, by a loser tree.

    Of every contender the tree knows the common prefix with the last item put out. The longer one is
    the smaller suffix; only equal ones are compared, from that length on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[Item | None] = [None] * size
    prefix = [0] * size
    for i, run in enumerate(runs):
        heads[i] = next((item for _, item in [next(run, (0, None))]), None)

    def beats(a: int, b: int) -> int:
        """The winner; the loser's prefix becomes its common prefix with the winner."""
        if heads[b] is None:
            return a
        if heads[a] is None:
            return b
        if prefix[a] != prefix[b]:
            return a if prefix[a] > prefix[b] else b
        x, y = heads[a][0], heads[b][0]
        k = common(x, y, prefix[a])
        if k == len(x) or k < len(y) and x[k] < y[k]:
            prefix[b] = k
            return a
        prefix[a] = k
        return b

    losers = [0] * size

    def play(node: int) -> int:
        if node >= size:
            return node - size
        a, b = play(2 * node), play(2 * node + 1)
        winner = beats(a, b)
        losers[node] = b if winner == a else a
        return winner

    winner = play(1)
    while heads[winner] is not None:
        yield prefix[winner], heads[winner]
        found = next(runs[winner], None)
        if found is None:
            heads[winner] = None
        else:
            prefix[winner], heads[winner] = found
        node = (winner + size) // 2
        while node:
            first = beats(losers[node], winner)
            if first != winner:
                losers[node], winner = winner, first
            node //= 2


def extents(items: list[Item], shared: list[int]) -> list[tuple[int, int]]:
    """Per item of a stretch, how far repeated strings through its anchor reach before and after it.

    ``shared[i]``: common prefix of suffixes i - 1 and i. (0, 0): no string repeats.
    """
    reach = [(len(left), len(suffix)) if len(set(where)) > 1 and len(left) + len(suffix) >= LENGTH else (0, 0) for suffix, left, where in items]
    m = len(items)
    if m == 1:
        return reach

    def meet(a: int, b: int, right: int) -> None:
        left = common(items[a][1], items[b][1])
        if left + right >= LENGTH:
            for i in (a, b):
                reach[i] = (max(reach[i][0], left), max(reach[i][1], right))

    if m == 2:
        meet(0, 1, shared[1])
        return reach
    by_left = sorted(range(m), key=lambda i: items[i][1])
    rank = [0] * m
    for r, i in enumerate(by_left):
        rank[i] = r
    owner, sets = list(range(m)), [[rank[i]] for i in range(m)]

    def find(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for i in sorted(range(1, m), key=lambda i: -shared[i]):
        a, b = find(i - 1), find(i)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        for r in small:
            at = bisect_left(large, r)
            for near in large[max(0, at - 1) : at + 1]:
                meet(by_left[r], by_left[near], shared[i])
        if len(small) == 1:
            large.insert(bisect_left(large, small[0]), small[0])
        else:
            sets[a] = sorted(large + small)
        sets[b] = []
        owner[b] = a
    return reach


def stretches(merged: Iterator[tuple[int, Item]]) -> Iterator[tuple[list[Item], list[int]]]:
    """Items of a common core together; equal contexts of different runs folded into one."""
    items: list[Item] = []
    shared: list[int] = []
    folded: dict = {}
    carry = LENGTH
    for k, (suffix, left, where) in merged:
        carry = min(carry, k)
        if items and carry < CORE:
            yield items, shared
            items, shared, folded, carry = [], [], {}, 0
        if (own := folded.get((suffix, left))) is not None:
            items[own][2].extend(where)  # equal suffixes stand together, so prefixes stay as they are
            continue
        folded[suffix, left] = len(items)
        items.append((suffix, left, list(where)))
        shared.append(carry)
        carry = LENGTH
    if items:
        yield items, shared


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest, length and anchors with their core hashes, of each text."""
    for batch in batches:
        keys, sizes, sums, cores, places = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            data = _raw(text)
            digest = hashlib.sha256(data)
            own = anchors(data)
            keys.append(digest.digest()[:16])
            sizes.append(len(data))
            sums.append(digest.hexdigest())
            places.append(own)
            cores.append([xxhash.xxh64_intdigest(data[p : p + CORE]) - (1 << 63) for p in own])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sums, pa.string()), pa.array(cores, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], ["doc_id", "key", "n_bytes", "sha256", "cores", "places"])


def _runs(parts: int):
    def flush(contexts: dict[int, dict]) -> pa.RecordBatch:
        rows = [(part, encode([(s, l, w) for (s, l), w in sorted(own.items())])) for part, own in sorted(contexts.items())]
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], ["part", "run", "key", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        contexts: dict[int, dict] = {}
        held = 0
        for batch in batches:
            keys, texts, marks = (batch.column(i).to_pylist() for i in range(3))
            packed = []
            for key, text, marked in zip(keys, texts, marks, strict=True):
                data = _raw(text)
                packed.append(pack.compress(data))
                for mark in marked:
                    p = mark["place"]
                    own = contexts.setdefault(mark["core"] % parts, {})
                    context = data[p : p + LENGTH], data[max(0, p - SPAN + 1) : p][::-1]
                    if context not in own:
                        held += LENGTH + SPAN
                        own[context] = []
                    own[context].append((key, p))
                if held >= RUN_BYTES:
                    yield flush(contexts)
                    contexts, held = {}, 0
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["part", "run", "key", "packed"])
        if contexts:
            yield flush(contexts)

    return run


def _merge_part(rows: pd.DataFrame) -> pd.DataFrame:
    found: dict[bytes, list] = {}
    for items, shared in stretches(merge([decode(bytes(r)) for r in rows["run"]])):
        for (_, _, where), (left, right) in zip(items, extents(items, shared), strict=True):
            if right:
                for key, p in where:
                    found.setdefault(key, []).append((p - left, p + right))
    spans = {k: unite(v) for k, v in found.items()}
    return pd.DataFrame({"key": list(spans), "spans": [[x for s in v for x in s] for v in spans.values()]})


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        keys, removed, counts, sums = batch.column(0), [], [], []
        for packed, lists in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = unpack.decompress(packed)
            spans = unite([(x[i], x[i + 1]) for x in lists for i in range(0, len(x), 2)])
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            removed.append(sum(b - a for a, b in spans))
            counts.append(len(spans))
            sums.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([keys, pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.string())], ["key", "removed", "spans", "kept"])


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scan of ``docs``, packed texts by key, and (key, spans) rows, several per text possibly."""
    scanned = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, "doc_id long, key binary, n_bytes long, sha256 string, cores array<long>, places array<int>"))
    each = scanned.select("key", F.explode(F.arrays_zip("cores", "places")).alias("a")).select("key", F.col("a.cores").alias("core"), F.col("a.places").alias("place"))
    # An occurrence is a place of a text; copies of a text have the same ones.
    occurrence = F.xxhash64("key", "place")
    # A table of its own: the join below then reads two plain exchanges, and one very common core can be split.
    often = cut(each.groupBy("core").agg(F.min(occurrence).alias("low"), F.max(occurrence).alias("high")).filter("low <> high").select("core"))
    marks = cut(each.join(often, "core", "left_semi").groupBy("key").agg(F.collect_set(F.struct("place", "core")).alias("marks")))
    total = marks.agg(F.sum(F.size("marks"))).first()[0] or 0
    parts = int(total // PER_MERGE) + 1
    heads = scanned.groupBy("key").agg(F.min("doc_id").alias("head"))
    marked = marks.join(heads, "key").select(F.col("key").alias("key_"), "head", "marks")
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.filter(F.octet_length(text) >= LENGTH).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32)).alias("key"))
    texts = own.join(marked, own.doc_id.eqNullSafe(marked["head"]) & (own.key == marked.key_)).select("key", "text", "marks")
    runs = cut(texts.mapInArrow(_runs(parts), "part int, run binary, key binary, packed binary"))
    drop_tables(docs.sparkSession, [marks, often])
    found = runs.filter("part IS NOT NULL").select("part", "run").groupBy("part").applyInPandas(_merge_part, "key binary, spans array<int>")
    return scanned, runs.filter("key IS NOT NULL").select("key", "packed"), found


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    scanned, packed, found = repeated_spans(docs)
    by_text = found.groupBy("key").agg(F.collect_list("spans").alias("spans"))
    cleaned = by_text.join(packed.dropDuplicates(["key"]), "key").select("key", "packed", "spans").mapInArrow(_cut_out, "key binary, removed long, spans long, kept string")
    cleaned = cleaned.select(F.col("key").alias("key_"), "removed", F.col("spans").alias("n_spans"), "kept")
    counted = cut(scanned.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("copied"), "n"))
    # A text with so many copies would fill a task of the joins below. There are HOT of them at most, so they are broadcast.
    many = max(1000, scanned.count() // HOT)
    hot = F.broadcast(counted.filter(F.col("n") > many).select("copied"))
    rows = scanned.select("doc_id", "key", "n_bytes", "sha256")
    same = F.col("key") == F.col("copied")
    copies = counted.filter(F.col("n") <= many).select("copied")
    joined = rows.join(hot, same, "left_anti").join(copies, same, "left").join(cleaned, F.col("key") == F.col("key_"), "left")
    often = rows.join(hot, same).withColumns({c.name: F.lit(None).cast(c.dataType) for c in cleaned.schema})
    joined = joined.unionByName(often)
    whole = F.col("copied").isNotNull() & (F.col("n_bytes") >= LENGTH)
    pick = lambda all_, some, none: F.when(whole, all_).when(F.col("key_").isNotNull(), some).otherwise(none)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("removed"), zero).alias("n_removed"), pick(F.lit(1).cast("long"), F.col("n_spans"), zero).alias("n_spans"), pick(nothing, F.col("kept"), F.col("sha256")).alias("kept_sha256"))
