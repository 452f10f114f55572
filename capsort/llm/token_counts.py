"""Token counts by heap-and-linked-list byte-pair merging.

Each pre-token starts as its bytes. A heap holds the adjacent pairs that have a merge, by rank and then
position; the lowest is popped, its right symbol is unlinked from the list, and the two new neighbours
are pushed. Only the number of merges is kept: tokens = bytes - merges, and no identifiers are made.

Nulls count as the empty text: 0 bytes, 0 tokens. Texts are never cut. A row gives a row, so repeated rows
and ids give repeated results. Extra columns of the input are not read.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The fixed pattern of byte-level pre-tokenization (format constant of the vocabulary file).
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words remembered per Python worker, about 100 bytes each.
REMEMBERED = 800_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def load(path: str) -> dict:
    """Merges of a byte-level BPE file as integers: pair -> (rank, merged symbol)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = (spec.get("normalizer"), spec["pre_tokenizer"]["type"], spec["pre_tokenizer"]["add_prefix_space"])
    if kinds != (None, "ByteLevel", False) or spec["model"]["type"] != "BPE":
        raise ValueError("a byte-level BPE file without normalizer is needed")
    vocab = spec["model"]["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    pairs = {}
    for rank, (a, b) in enumerate(merges):
        pairs.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
    return {"bytes": [vocab[c] for c in byte_letters()], "pairs": pairs, "special": [t["content"] for t in spec["added_tokens"]]}


def merges(word: bytes, symbols: list[int], pairs: dict[int, tuple[int, int]]) -> int:
    """How many merges byte-pair encoding makes in one pre-token."""
    n = len(word)
    sym = [symbols[b] for b in word]
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [found[0] << 40 | i for i in range(n - 1) if (found := pairs.get(sym[i] << 20 | sym[i + 1]))]
    heapify(heap)
    made = 0
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFFFF
        j = right[i]
        if sym[i] < 0 or j >= n:
            continue
        found = pairs.get(sym[i] << 20 | sym[j])
        if found is None or found[0] != top >> 40:
            continue  # the pair at this place has changed meanwhile
        made += 1
        sym[i], sym[j] = found[1], -1
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            if new := pairs.get(sym[i] << 20 | sym[k]):
                heappush(heap, new[0] << 40 | i)
        h = left[i]
        if h >= 0 and (new := pairs.get(sym[h] << 20 | sym[i])):
            heappush(heap, new[0] << 40 | h)
    return made


def counter(spec: dict) -> Callable[[str], int]:
    """A function from text to its number of tokens, as the vocabulary's own library counts them."""
    pretoken = regex.compile(PRETOKEN)
    special = regex.compile("|".join(map(regex.escape, spec["special"]))) if spec["special"] else None
    symbols, pairs = spec["bytes"], spec["pairs"]
    whole = -(1 << 60)

    class Tokens(dict):
        def __missing__(self, token: str) -> int:
            raw = token.encode("utf-8", "surrogatepass")
            self[token] = n = len(raw) - merges(raw, symbols, pairs)
            return n

    tokens = Tokens()

    class Pieces(dict):
        """What stands between two single spaces, with the space before it. It splits as it does in its
        text unless white space is at its edge; ``whole`` says that."""

        def __missing__(self, piece: str) -> int:
            if not piece or piece[0].isspace() or piece[-1].isspace():
                n = whole
            elif piece.isalpha():  # one pre-token, not remembered twice
                raw = b" " + piece.encode("utf-8", "surrogatepass")
                n = len(raw) - merges(raw, symbols, pairs)
            else:
                n = sum(map(tokens.__getitem__, pretoken.findall(" " + piece)))
            if len(self) >= REMEMBERED:
                self.clear()
            if len(tokens) >= REMEMBERED:
                tokens.clear()
            self[piece] = n
            return n

    pieces = Pieces()

    def plain(text: str) -> int:
        first, *rest = text.split(" ")
        n = sum(map(pieces.__getitem__, rest)) if not first or not first[-1].isspace() else whole
        if n < 0 or not first and rest:
            return sum(map(tokens.__getitem__, pretoken.findall(text)))
        return n + sum(map(tokens.__getitem__, pretoken.findall(first)))

    def count(text: str) -> int:
        if special is None or not special.search(text):
            return plain(text)
        return len(special.findall(text)) + sum(map(plain, special.split(text)))

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    One narrow scan: no shuffle, a row in gives a row out. ``path`` is read on the driver and its merges
    (bounded by the vocabulary) are broadcast.
    """
    spec = load(path)
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    key = f"{path}:{len(spec['pairs'])}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = sys.__dict__.setdefault("_capsort_token_counters", {})  # lives as long as the worker
        if key not in kept:
            kept[key] = counter(shared.value)
        count = kept[key]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [count(t) for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
