"""Benchmark decontamination with suffix arrays of the training words.

Documents are taken in shards of about ``SHARD`` bytes. Each shard gets a suffix array: its word positions,
sorted by the hashes of the next four words (an order of words as good as any for equality search). Every
test suffix is binary-searched in every shard; its range holds all places that share four words with it, and
these are extended word by word to a whole window (10 words, or the item if shorter). Word hashes only find candidates:
windows are verified on bytes. Windows that follow each other in item and document are one match, so the longest verbatim
matches and their locations come out at once, however long; a document's words inside a match are hit. Of an item's
matches in a document those inside a longer one are left out.

The test items are a stated query set: they are broadcast in blocks of at most ``BLOCK`` bytes of text, one
column of results per block, so the work per task stays bounded however many items there are. The documents
are read once, without a shuffle.

Defined cases: null texts have no words. Items without words have no window. Repeated items and ids are one item.
An item with a null id contaminates but is not listed. Repeated documents each get their row. Columns other
than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsort.llm.common import hand_back, lean

WINDOW = 10
SHARD = 250_000
#: Text bytes of test items in one broadcast.
BLOCK = 16_000_000
DEPTH = 4
BASE = 0x9E3779B97F4A7C15 | 1
STATE = "n_words long, hits array<int>, items array<string>, matches array<struct<item:string,first:int,words:int,at:int>>"


def _keep(b: int) -> int:
    """Lower-cased word bytes stay; all else is a space. Words are digits, letters and all non-ASCII."""
    if 65 <= b <= 90:
        return b + 32
    return b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32


TABLE = bytes(map(_keep, range(256)))


def normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE)


class Hasher:
    """64-bit hashes of all words of a byte string at once, from prefix sums of a polynomial."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) < n:
            inverse = pow(BASE, -1, 1 << 64)
            for name, base in (("power", BASE), ("inverse", inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the space-separated words."""
        raw = np.frombuffer(b" " + data + b" ", np.uint8)
        self.grow(len(raw) + 1)
        blank = raw == 32
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edge[::2], edge[1::2]
        total = np.zeros(len(data) + 1, np.uint64)
        np.multiply(raw[1:-1], self.power[: len(data)], out=total[1:])
        np.cumsum(total, out=total)
        h = (total[ends] - total[starts]) * self.inverse[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return starts, ends, h


def keys(h: np.ndarray) -> np.ndarray:
    """Of each position: 16 bits of each of the next DEPTH words, most significant first."""
    short = h >> np.uint64(48)
    out = np.zeros(len(h), np.uint64)
    for d in range(min(DEPTH, len(h))):
        out[: len(h) - d] |= short[d:] << np.uint64(48 - 16 * d)
    return out


def test_suffixes(items: list[tuple[object, str | None]]) -> dict:
    """All suffixes of the items that still hold a window: word hashes, search ranges and bytes."""
    hasher, texts = Hasher(), sorted({(str(i) if i is not None else None, normal(t)) for i, t in items}, key=str)
    words, owner, start, need, ids, bases = [], [], [], [], [], []
    hashes = [np.zeros(0, np.uint64)]
    base = 0
    for name, data in texts:
        own = data.split()
        if not own:
            continue
        window = min(WINDOW, len(own))
        hashes.append(hasher.words(data)[2])
        words += own
        n = len(own) - window + 1
        start += range(base, base + n)
        owner += [len(ids)] * n
        need += [window] * n
        ids.append(name)
        bases.append(base)
        base += len(own)
    h = np.concatenate(hashes)
    start, need = np.array(start, np.int64), np.array(need, np.int64)
    low = keys(h)[start] if len(start) else np.zeros(0, np.uint64)
    free = np.uint64(16) * (DEPTH - np.minimum(need, DEPTH)).astype(np.uint64)
    mask = (np.uint64(1) << free) - np.uint64(1)
    # Only distinct windows need a search, but each item that has the window is listed.
    return {"h": h, "words": words, "start": start, "need": need, "owner": np.array(owner, np.int64), "ids": ids, "base": bases, "low": low & ~mask, "high": low | mask}


def joined(windows: list[tuple[int, int, int]], need: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """Longest matches (item, first word in the document, words, first word in the item) of windows (item, place in the item less that in the document, place in the document).

    Windows of one item that follow each other on one diagonal are one match; matches inside another of the same item go.
    """
    runs: list[list[int]] = []
    for item, diagonal, place in sorted(windows):
        if runs and runs[-1][0] == item and runs[-1][1] == diagonal and runs[-1][3] == place - 1:
            runs[-1][3] = place
        else:
            runs.append([item, diagonal, place, place])
    out, last, end = [], None, -1
    for item, first, stop, diagonal in sorted((i, a, -(b + need[i]), d) for i, d, a, b in runs):
        if item != last:
            last, end = item, -1
        if -stop > end:
            end = -stop
            out.append((item, first, end - first, first + diagonal))
    return out


def search(docs: list[bytes], tests: dict, hasher: Hasher) -> list[tuple[int, np.ndarray, list[str], list[dict]]]:
    """Of each document of one shard: its number of words, hit word positions, items found, and longest matches."""
    data = b" \x01 ".join(docs)
    starts, ends, h = hasher.words(data)
    raw = np.frombuffer(data, np.uint8)
    fence = np.flatnonzero((raw[starts] == 1) & (ends - starts == 1)) if len(starts) else np.zeros(0, np.int64)
    first = np.concatenate(([0], fence + 1))
    n_words = np.diff(np.concatenate((first, [len(h) + 1]))) - 1
    found: list[set[tuple[int, int, int]]] = [set() for _ in docs]
    needs: dict[int, int] = {}
    mark = np.zeros(len(h) + 1, np.int64)
    if len(tests["start"]) and len(h):
        key = keys(h)
        suffix_array = np.argsort(key)
        ordered = key[suffix_array]
        low, high = np.searchsorted(ordered, tests["low"], "left"), np.searchsorted(ordered, tests["high"], "right")
        some = np.flatnonzero(high > low)
        for at in range(0, len(some), 4096):
            part = some[at : at + 4096]
            count = high[part] - low[part]
            which = np.repeat(part, count)
            place = suffix_array[np.repeat(low[part] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())]
            need = tests["need"][which]
            fits = place + need <= len(h)
            which, place, need = which[fits], place[fits], need[fits]
            for d in range(WINDOW):
                live = need > d
                same = ~live
                same[live] = h[place[live] + d] == tests["h"][tests["start"][which[live]] + d]
                which, place, need = which[same], place[same], need[same]
            doc = np.searchsorted(first, place, "right") - 1
            for w, p, n, k in zip(which.tolist(), place.tolist(), need.tolist(), doc.tolist(), strict=True):
                s = int(tests["start"][w])
                if data[starts[p] : ends[p + n - 1]].split() == tests["words"][s : s + n]:
                    mark[p] += 1
                    mark[p + n] -= 1
                    item = int(tests["owner"][w])
                    needs[item] = n
                    found[k].add((item, s - tests["base"][item] - p + int(first[k]), p - int(first[k])))
    hit = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    cuts = np.searchsorted(hit, first)
    parts = np.split(hit, cuts[1:])
    out = []
    for n, p, f, x in zip(n_words, parts, first, found, strict=True):
        names = {tests["ids"][item] for item, _, _ in x} - {None}
        matches = [{"item": tests["ids"][item], "first": a, "words": size, "at": at} for item, a, size, at in joined(list(x), needs)]
        out.append((int(n), p - f, sorted(names), matches))
    return out


def scan(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``rows`` with a struct column ``__capsort_hits``: n_words, hit word positions, item ids as text, and longest matches."""
    items = benchmark.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // BLOCK) + 1
    spark = rows.sparkSession

    def column(k: int):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        shared = spark.sparkContext.broadcast(test_suffixes([(r[0], r[1]) for r in own.collect()]))

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            hasher = Hasher()
            for texts in batches:
                out, shard, size = [], [], 0
                for t in texts:
                    shard.append(normal(t.as_py()))
                    size += len(shard[-1])
                    if size >= SHARD:
                        out += search(shard, shared.value, hasher)
                        shard, size = [], 0
                if shard:
                    out += search(shard, shared.value, hasher)
                match = pa.struct([("item", pa.string()), ("first", pa.int32()), ("words", pa.int32()), ("at", pa.int32())])
                types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(match)]
                columns = [[x[0] for x in out], [x[1].astype(np.int32) for x in out], [x[2] for x in out], [x[3] for x in out]]
                yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["n_words", "hits", "items", "matches"])
                del out, columns
                hand_back()

        return F.arrow_udf(lean(run), STATE)(F.col("text"))

    found = rows.withColumns({f"__capsort_hits{k}": column(k) for k in range(blocks)})
    names = [F.col(f"__capsort_hits{k}") for k in range(blocks)]
    hits, ids, matches = names[0]["hits"], names[0]["items"], F.concat(*[c["matches"] for c in names])
    for c in names[1:]:
        hits, ids = F.array_union(hits, c["hits"]), F.array_union(ids, c["items"])
    return found.withColumn("__capsort_hits", F.struct(names[0]["n_words"].alias("n_words"), hits.alias("hits"), ids.alias("items"), matches.alias("matches"))).drop(*[f"__capsort_hits{k}" for k in range(blocks)])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    c = F.col("__capsort_hits")
    n_hit = F.size(c["hits"]).cast("long")
    digest = F.sha2(F.array_join(F.array_sort(c["items"]), ",").cast("binary"), 256)
    return found.select("doc_id", c["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id (as text), first_word and item_word (places of the match in both, from 0) and words, one row a match."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark).select("doc_id", F.explode("__capsort_hits.matches").alias("m"))
    return found.select("doc_id", F.col("m.item").alias("item_id"), F.col("m.first").alias("first_word"), F.col("m.words").alias("words"), F.col("m.at").alias("item_word"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the affected documents."""
    return scan(docs, benchmark).filter(F.size("__capsort_hits.hits") == 0).drop("__capsort_hits")
