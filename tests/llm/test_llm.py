"""Training-data operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from capsort.llm import decontam, langid, licenses, mixing, sharding, simhash, suffix_dedup, token_counts, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rate double, shard string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocab = {"en": "the of and house tree river walks quickly under bright morning idiot".split(), "de": "der die und haus baum fluß geht schnell unter heller morgen straße".split()}
    out = []
    for k in range(60):
        lang = "en" if k % 3 else "de"
        out.append((k, sentence(rng, rng.randint(1, 120), [w + rng.choice(["", "s", "x", "ing"]) for w in vocab[lang]]), lang, rng.choice(["a", "b", "hot", "hot", None])))
    long = sentence(rng, 3000, vocab["en"])
    passage = "".join(rng.choice("abcdefgh ") for _ in range(450))
    out += [(100, long, "en", "a"), (101, long, None, "hot"), (102, long[:5000] + " changed " + long[5000:], "en", "b"), (103, None, None, None), (104, "", "en", "a"), (105, " \t\n", None, "a"), (106, "123 !!", "de", "b"),
            (107, "x" * 900, "en", "a"), (108, "pre " + passage + " one", "en", "a"), (109, "other " + passage + " two", "en", "b"), (110, "<|endoftext|> a<|endoftext|>  b   c é'll 12", "en", "a"), (3, out[3][1], "en", "a"), (None, "no id here", "en", "a")]
    return [(i, t, lang, s, len(t or ""), 1.0, "x") for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).cache()


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(map(repr, token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()))
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in rows]
    from pyspark.sql import Row

    assert got == sorted(repr(Row(doc_id=i, n_bytes=b, n_tokens=n, over_limit=n > 512)) for i, b, n in want)


def test_mixing(spark, docs, rows):
    size = lambda t: len(WORD.findall(t or ""))
    of = {}
    for _, t, _, s, *_ in rows:
        of[s] = of.get(s, 0) + size(t)
    names = sorted((s for s in of if s is not None)) + [s for s in of if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    free, left, target = set(names), float(sum(of.values())), {}
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * of[s] + 1e-9}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * of[s]
        left = sum(of.values()) - sum(target.values())
        free -= over
    target |= {s: left * weight[s] / total for s in free}
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 for r in got)
    by = {}
    for (i, t, _, s, *_), r in zip(sorted(rows, key=repr), sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), strict=False):
        by[r.source_size] = r.target
    assert {round(v, 6) for v in by.values()} <= {round(v, 6) for v in target.values()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.n_copies for r in got)
    assert mixing.plan(docs.limit(0)).count() == 0


def brute_fingerprint(t):
    w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not w:
        return 0
    grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, docs, rows):
    got = simhash.near_duplicates(docs).collect()
    fps = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    group = list(range(len(fps)))
    for _ in fps:
        for a in range(len(fps)):
            for b in range(a):
                if (fps[a][1] ^ fps[b][1]).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    least = {}
    for (i, _), g in zip(fps, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    assert sorted(map(repr, [(r.doc_id, r.fingerprint, r.component_id) for r in got])) == sorted(repr((i, f"{h:016x}", least.get(g))) for (i, h), g in zip(fps, group, strict=True))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_representatives_of_null_and_repeated_ids(spark):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(None, words(0), 1), (None, words(1), 2), (None, words(1), 3), (4, words(2), 4), (4, words(3), 5), (6, words(0), 6), (7, None, 7), (8, "", 8), (4, words(2), 4)]
    kept = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept))) == sorted(map(repr, [(6, words(0)), (None, words(1)), (4, words(2)), (4, words(3)), (7, None)]))


def test_links_find_all_close_pairs(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 6))) for b in base for _ in range(6)} | set(base)
    signed = [x - (1 << 64) if x >> 63 else x for x in near]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    chain = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(chain).collect()} == {(k, 0) for k in range(51)} | {(100, 100), (101, 100)}


def test_representatives_of_similar_texts(spark):
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(400)]
    texts, sets = [], []
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(150, 400))]
        for edits in (0, 0.004, 0.01, 0.08):  # the last ones share far less than 0.8 of their shingles
            w = list(base)
            for at in rng.sample(range(len(w)), int(edits * len(w))):
                w[at] = rng.choice(vocab) + "new"
            texts.append(" ".join(w))
            sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)})
    kept = {r.doc_id for r in simhash.keep_representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    line = "one line that is repeated often in texts that share nothing else".split()
    for k in range(6):  # a repeated line counts once: these texts are unlike, whatever their length
        own = [f"u{k}x{j}" for j in range(200)]
        texts.append(" ".join(own + line * 30))
        sets.append({tuple((own + line * 30)[j : j + 5]) for j in range(len(own) + 30 * len(line) - 4)})
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    kept = {r.doc_id for r in simhash.keep_representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == set(root) and 100 < len(kept) < 150


def test_parities_never_exceed_the_difference(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for size in (0, 1, 63, 64, 65, 500, 1023, 1025, 3000):
        own = np.unique(rng.integers(0, 2**63, size, np.uint64))
        for changed in (0, 1, 40, size):
            other = np.unique(np.concatenate((own[changed // 2 :], rng.integers(0, 2**63, changed, np.uint64))))
            rows.append((len(want), simhash.parities(own).tolist(), simhash.parities(other).tolist()))
            want.append(len(np.setxor1d(own, other)))
    got = {r.k: r.n for r in spark.createDataFrame(rows, "k int, x array<long>, y array<long>").select("k", simhash._differing(F.col("x"), F.col("y")).alias("n")).collect()}
    assert all(got[k] <= n for k, n in enumerate(want)) and all(got[k] > 0 for k, n in enumerate(want) if n > 200)


def kept_by_brute_force(texts):
    """Of each component of pairs with Jaccard 0.8 or more of five-word shingles the first."""
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    group = list(range(len(sets)))
    for b in range(len(sets)):
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return {k for k, g in enumerate(group) if k == g}


def texts_near_the_limit():
    rng = random.Random(11)
    line = " ".join(f"c{k}" for k in range(11))
    texts = [" ".join(f"r{rng.random()}" for _ in range(n)) + f" {line}" * times for n, times in ((200, 15), (1000, 40)) for _ in range(4)]
    for _ in range(40):  # edits spread so that similarities lie about 0.7 to 0.85
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(base))
        for edits in (0.018, 0.021, 0.024, 0.03):
            w = list(base)
            for at in rng.sample(range(len(w)), max(1, round(edits * len(w)))):
                w[at] = f"new{rng.random()}"
            texts.append(" ".join(w))
    return texts + [" ".join(map(str, range(n))) for n in (3, 5, 6, 9, 10, 13, 14)]


def test_representatives_are_those_of_brute_force(spark):
    texts = texts_near_the_limit()
    kept = {r.doc_id for r in simhash.keep_representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == kept_by_brute_force(texts)


def test_representatives_come_by_fingerprints_first(spark, monkeypatch):
    search = simhash.shared_places
    monkeypatch.setattr(simhash, "shared_places", lambda *a: search(*a).limit(0))  # what is linked now is linked by SimHash
    rng = random.Random(9)
    texts = []
    for _ in range(5):
        base = [f"w{rng.randrange(5000)}" for _ in range(4000)]
        texts += [" ".join(base), " ".join(base[:-1] + ["end"]), " ".join(["start"] + base[1:])]
    texts += ["", None, "a", "one of few words"]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    assert sum((prints[k] ^ prints[k + 1]).bit_count() <= 4 for k in range(0, 15, 3)) == 5
    kept = {r.doc_id for r in simhash.keep_representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == {0, 3, 6, 9, 12, 15, 17, 18}


def test_unrelated_rows_change_no_decision(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLED", 30)
    texts = texts_near_the_limit()
    other = [" ".join(f"o{k}x{j}" for j in range(30)) + " c0 c1 c2 c3 c4 c5 c6" for k in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts + other)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_representatives(rows).collect()}
    assert kept == kept_by_brute_force(texts) | set(range(len(texts), len(texts) + len(other)))


def brute_repeats(texts):
    seen = {}
    for t in texts:
        for k in range(len(t) - 399):
            seen[t[k : k + 400]] = seen.get(t[k : k + 400], 0) + 1
    out = []
    for t in texts:
        cut = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                cut[k : k + 400] = b"\1" * 400
        kept = bytes(c for c, x in zip(t, cut, strict=True) if not x)
        out.append((len(t), sum(cut), len(re.findall(b"\1+", bytes(cut))), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark, docs, rows):
    rng = random.Random(9)
    base = "".join(rng.choice("abcd ") for _ in range(3000))
    more = [base[:1500], base[700:2300] + "zz", "q" + base[200:650], base[:420] + "é" + base[421:1200], "ab" * 600, ("line of text\n" * 60) + base[2500:]]
    extra = spark.createDataFrame([(1000 + k, t, None, None, 0, 0.0, "") for k, t in enumerate(more)], DOCS)
    want = brute_repeats([(t or "").encode() for _, t, *_ in rows] + [t.encode() for t in more])
    got = suffix_dedup.remove_repeats(docs.unionAll(extra)).collect()
    ids = [i for i, *_ in rows] + [1000 + k for k in range(len(more))]
    assert sorted(map(repr, [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got])) == sorted(repr((i, *w)) for i, w in zip(ids, want, strict=True))
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_merge_keeps_order_and_prefixes():
    rng = random.Random(2)
    runs = [sorted({(bytes(rng.choices(b"ab", k=rng.randint(0, 9))), b"") for _ in range(20)}) for _ in range(5)]
    coded = [suffix_dedup.decode(suffix_dedup.encode([(s, x, []) for s, x in r])) for r in runs]
    out = list(suffix_dedup.merge(coded))
    texts = [item[0] for _, item in out]
    assert texts == sorted(s for r in runs for s, _ in r)
    assert all(k == suffix_dedup.common(a, b) for (k, _), a, b in zip(out[1:], texts, texts[1:]))


LICENCE_TEXTS = {
    "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under the Eclipse Public License 2.0": "EPL", "This work is licensed under the GNU Affero General Public License, version 3": "AGPL", "AGPL-3.0": "AGPL", "Released under the ISC License": "ISC", "Available under CC BY-SA 4.0": "CC-BY-SA",
    "Text is available under CC BY-SA 4.0": "CC-BY-SA", "Available under the Apache 2.0 terms": "Apache-2.0", "Lizenziert unter CC BY 4.0": "CC-BY", "Publicado bajo licencia CC BY 4.0": "CC-BY", "Released under GPLv3": "GPL", "dual MIT / Apache-2.0": "Apache-2.0,MIT",
    "This work is in the public domain.": "Public-Domain", "Released under the LGPL": "LGPL", "Licensed under CC0 1.0": "CC0", "Licensed under the Mozilla Public License 2.0": "MPL",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BSD",
    "Licensed under the\n  Apache License,\n  Version 2.0 (the License)": "Apache-2.0",
    "one\ntwo\nReleased under the MIT License\nLicensed under CC BY-SA 4.0\nthree": "CC-BY-SA,MIT",
}
LICENCE_FREE = ["", None, " \n\n\t", "nothing here", "Proprietary license. All rights reserved", "The dog slept under the table in the public library", "MIT graduates found work", "Students at MIT may modify the report", "A driving license is needed for this job", "The eclipse was seen in public", "Er geht mit dem Hund, as it is only that of the nd and on this or at that"]
LICENCE_UNKNOWN = ["licensed under the foo license v3", "Licensed under the Artistic License, Version 2.0", "SPDX-License-Identifier: WTFPL", "Licensed under the Open Software License 3.0"]


def brute_licence(text, model):
    """Every paragraph and line scored on its own, without any gate."""
    paragraphs = [p for p in re.split("\n[ \\t\\r\\f\\x0b]*\n", text or "") if p.strip(" \t\r\n\f\x0b")]
    place = {g: i for i, g in enumerate(model["vocabulary"])}
    found, unknown = [], 0
    for p in paragraphs:
        sure, stated = [], False
        for unit in [p] + (p.split("\n") if "\n" in p else []):
            words = licenses.tokens(unit)
            known = [place[g] for g in licenses.grams(words) if g in place and g]
            z = (model["weights"][0] + model["weights"][known].sum(0)) / np.sqrt(len(known) + 1)
            odds = 1 / (1 + np.exp(z[0] - z[1:]))
            sure += [(odds[k], f) for k, f in enumerate(model["families"]) if odds[k] >= model["threshold"] and licenses.confirmed(f, words)]
            stated |= bool(odds.max() > 0.5)
        found.append(sure)
        unknown += stated and not sure
    every = [x for s in found for x in s]
    best = max((p for p, _ in every), default=0.0)
    return len(paragraphs), sum(map(bool, found)) + unknown, ",".join(sorted({f for _, f in every})), round(float(best), 9), unknown


def test_licenses(spark):
    model = licenses.train()
    texts = [*LICENCE_TEXTS, *LICENCE_FREE, *LICENCE_UNKNOWN]
    texts += ["\n\n".join(["word " * 4000, texts[0], "more " * 4000, texts[2], LICENCE_UNKNOWN[0]]), texts[0], " ".join(texts[:12]), "\n".join(texts[:12]), "l" * 200_000]
    table = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, families string")
    got = {r.doc_id: r for r in licenses.scan_licenses(table, model).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_paragraphs, r.n_notices, r.families, round(r.score, 9), r.n_unknown) == brute_licence(t, model), t
    for k, t in enumerate(texts[: len(LICENCE_TEXTS)]):
        assert got[k].families == LICENCE_TEXTS[t] and got[k].n_unknown == 0 and got[k].score >= model["threshold"], t
    for k, t in enumerate(texts):
        if t in LICENCE_FREE:
            assert got[k].n_notices == 0 and got[k].top_family is None and got[k].score == 0, t
        if t in LICENCE_UNKNOWN:
            assert got[k].families == "" and got[k].n_unknown == 1, t
    assert licenses.scan_licenses(table.limit(0), model).count() == 0


def test_toxicity(spark):
    rng = random.Random(3)
    plain = [f"w{k}" for k in range(300)]
    data = []
    for k in range(700):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if k % 5 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["nastyword", "vileword"]))
        data.append((k, " ".join(words), int(k % 5 == 0)))
    d = spark.createDataFrame([(k, t, "zz") for k, t, _ in data] + [(900, None, "zz"), (901, "", "zz")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in data] + [(5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, labels).collect()}
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    out = [(got[k].predicted, y) for k, _, y in data if got[k].held_out]
    assert sum(p == y for p, y in out) / len(out) > 0.9 and all(0 <= r.score <= 1 for r in got.values()) and len(got) == 702
    assert toxicity.toxicity(d, labels.limit(0)).agg(F.count_distinct("score")).first()[0] == 1


def test_sharding(spark, docs, rows):
    got = sharding.shard(docs, 7).collect()
    assert len(got) == len(rows)
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in per.values()) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    hot = spark.createDataFrame([(1, "same")] * 50 + [(k, "t") for k in range(2, 12)], "doc_id long, text string")
    nulls = sharding.shard(spark.createDataFrame([(None, f"t{k}") for k in range(700)], "doc_id long, text string"), 7)
    assert {r["count"] for r in nulls.groupBy("shard").count().collect()} == {100}
    counts = [r["count"] for r in sharding.shard(hot, 7).groupBy("shard").count().collect()]
    assert sum(counts) == 60 and max(counts) - min(counts) <= 1 and sharding.shard(hot.limit(0), 7).count() == 0


def test_ring_moves_little():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 1 << 63, 20000, dtype=np.uint64) * np.uint64(2))

    def place(n):
        points, owner = sharding.ring(n)
        node = np.searchsorted(points, h) % len(points)
        out, seen = np.zeros(len(h), int), np.zeros(len(points), int)
        stretches = {}
        for v, low, high, s, _ in sharding.walk(np.bincount(node, minlength=len(points)), owner, n):
            stretches.setdefault(v, []).append((low, high, s))
        for k, v in enumerate(node):
            out[k] = next(s for low, high, s in stretches[v] if low <= seen[v] < high)
            seen[v] += 1
        return out

    assert (place(40) != place(41)).mean() < 0.2


def test_language(spark, docs, rows):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (103, 104, 105, 106))
    known = [(by[i].lang_pred, lang) for i, t, lang, *_ in rows if i is not None and i < 100]
    assert sum(a == b for a, b in known) / len(known) > 0.9
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_decontamination(spark, docs, rows):
    items = [(1, " ".join((rows[5][1] + " " + rows[8][1]).split()[3:25])), (2, rows[100 - 40][1][1000:1300] if rows[60][1] else ""), (2, "river"), (3, None), (4, "!!"), (None, "under bright"), (10, rows[20][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    want = []
    for i, t, *_ in rows:
        w, hit, own = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if found := grams.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    own |= {str(x) for x in found if x is not None}
        want.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    assert sorted(map(repr, map(tuple, decontam.contamination(docs, bench).collect()))) == sorted(map(repr, want))
    assert decontam.remove_contaminated(docs, bench).columns == docs.columns
    longest = set()
    for i, t, *_ in rows:
        w = words(t)
        for item, u in items:
            v = words(u)
            n = min(10, len(v))
            ends = {}
            for p in range(len(w)):
                for s in range(len(v)):
                    size = 0
                    while p + size < len(w) and s + size < len(v) and w[p + size] == v[s + size]:
                        size += 1
                    if n and size >= n:
                        ends[p] = max(ends.get(p, 0), p + size)
            longest |= {(i, None if item is None else str(item), p, e - p) for p, e in ends.items() if all(q >= p or ends[q] < e for q in ends)}
    got = decontam.longest_matches(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.first_word, r.words) for r in got} == longest and max(x[3] for x in longest) > 30
    texts, tests = {r[0]: words(r[1]) for r in rows}, {None if i is None else str(i): words(t) for i, t in items if i != 2}
    for r in got:
        if r.item_id in tests and r.doc_id not in (3, None):
            assert texts[r.doc_id][r.first_word : r.first_word + r.words] == tests[r.item_id][r.item_word : r.item_word + r.words]
    assert decontam.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_blocks_of_items_agree(docs, spark, monkeypatch):
    bench = spark.createDataFrame([(k, f"river {w} tree") for k, w in enumerate(["walks", "under"])] + [(9, "the of")], "item_id long, text string")
    whole = sorted(map(repr, decontam.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK", 10)
    assert sorted(map(repr, decontam.contamination(docs, bench).collect())) == whole


def test_top_k(spark):
    rng = np.random.default_rng(5)
    v = [(k, [float(np.float32(x)) for x in rng.normal(size=8)], 1) for k in range(200)]
    v += [(250, v[50][1], 2), (251, None, 0), (300, [float("nan")] * 8, 0), (350, [1.0, None] * 4, 0), (301, [1.0] * 3, 0)]
    got = topk.top_k(spark.createDataFrame(v, "vec_id long, embedding array<float>, score int")).collect()
    use = [(i, np.floor(np.array(x) * 256)) for i, x, _ in v if x is not None and len(x) == 8 and all(y is not None and np.isfinite(y) for y in x)]
    want = []
    for i, q in use:
        if i % 50 == 0:
            best = sorted((-int(q @ x), j) for j, x in use if j != i)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    few, evaluated = topk.best_of(np.array([0]), np.array([[1000.0, 0]]), np.arange(5000), np.vstack([[[1000.0, k] for k in range(10)], rng.normal(0, 1, (4990, 2)).round()]), 5, np.array([[1000.0, 0.0], [0.0, 0.0]]))
    assert len(few[0]) == 5 and evaluated < 1000
    x = rng.normal(0, 300, (4000, 6)).round()
    whole, _ = topk.best_of(np.arange(3), x[:3], np.arange(4000), x, 5, x[:8])
    first, _ = topk.best_of(np.arange(3), x[:3], np.arange(2000), x[:2000], 5, x[:8])
    parts, _ = topk.best_of(np.arange(3), x[:3], np.arange(2000, 4000), x[2000:], 5, x[:8], first)
    brute = [sorted(((int(x[i] @ x[j]), j) for j in range(4000) if j != i), key=lambda t: (-t[0], t[1]))[:5] for i in range(3)]
    assert whole == parts == brute


def test_top_k_of_large_components_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(k, [float(v) for v in rng.normal(0, 1, 6) * 10.0 ** (k % 4 * 9)]) for k in range(200)] + [(200, [3e30] * 6), (201, [-3e30] * 6), (202, [1e307] * 6), (203, [1.0] * 6), (203, [1.0] * 6), (250, [1.0] * 6)]
    schema = "vec_id long, embedding array<double>"
    used = [(i, [int(x) for x in np.floor(np.array(v) * 256)]) for i, v in rows if i != 202]
    want = []
    for i, q in dict((i, q) for i, q in used if i % 50 == 0).items():
        best = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in used if j != i)[:5]
        want += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(best)]
    table = spark.createDataFrame(rows, schema).repartition(3)
    assert sorted(map(tuple, topk.top_k(table).collect())) == sorted(want)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 200)  # several blocks, one after the other
    assert sorted(map(tuple, topk.top_k(table).collect())) == sorted(want)
    assert topk.top_k(table.limit(0)).count() == 0


def test_pivots_eliminate(spark):
    x = np.floor(np.random.default_rng(4).normal(0, 0.125, (4000, 64)) * 256)
    found, evaluated = topk.best_of(np.arange(20), x[:20], np.arange(4000), x, 5, x[-48:])
    brute = [sorted(((int(x[i] @ x[j]), j) for j in range(4000) if j != i), key=lambda t: (-t[0], t[1]))[:5] for i in range(20)]
    assert found == brute and evaluated < 0.2 * 20 * 4000


def test_pipeline(spark, tmp_path, rows):
    good = [r for r in rows if r[0] is not None]
    spark.createDataFrame(good, DOCS).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(good[5][1].split()[:12]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
    first = spark.read.parquet(f"{tmp_path}/language_id")
    assert {103, 104, 105, 106}.isdisjoint(r.doc_id for r in first.select("doc_id").collect())
    second = [r.doc_id for r in spark.read.parquet(f"{tmp_path}/near_dedup").select("doc_id").collect()]
    assert len(second) == len(set(second)) and 101 not in second and 100 in second
    assert 5 not in [r.doc_id for r in spark.read.parquet(f"{tmp_path}/decontamination").select("doc_id").collect()]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out.count()


def test_convolution_by_tables_is_a_plain_convolution():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    texts = [sentence(rng, rng.randint(1, 40), words) for _ in range(120)] + ["", None, "one", "a b"] + [sentence(rng, 21_000, words)]
    model = toxicity.fit(texts[:120], [k % 3 == 0 for k in range(120)])
    ids, starts = toxicity.buckets(texts, toxicity.Hasher())
    got = toxicity.logits(ids, starts, model, toxicity.tables_of(model))
    for k, t in enumerate(texts):
        own = toxicity.buckets([t], toxicity.Hasher())[0]
        pads = np.full(2 * max(toxicity.WIDTHS), toxicity.BUCKETS)
        x = model["embedding"][np.concatenate((own, pads))].astype(np.float64)  # pads are zero: filters may hang over the end
        top = []
        for w in toxicity.WIDTHS:
            rows = len(own)
            sums = sum(x[j : j + rows] @ model["filters"][w][j].astype(np.float64) for j in range(w))
            top.append(sums.max(0))
        z = np.maximum(np.concatenate(top) + model["bias"], 0) @ model["out"] + model["out_bias"]
        assert abs(z - got[k]) < 1e-3 * max(1, abs(z)), (k, z, got[k])


def test_language_scores_are_those_of_the_dual_solution():
    rng = random.Random(12)
    vocab = {"a": "alpha beta gamma delta".split(), "b": "eins zwei drei vier".split(), "c": "uno dos tres cuatro".split()}
    texts, langs = [], []
    for k in range(90):
        lang = "abc"[k % 3]
        texts.append(sentence(rng, rng.randint(2, 12), [w + rng.choice(["", "x", "er"]) for w in vocab[lang]]))
        langs.append(lang)
    model = langid.fit(texts, langs)
    grams = lambda t: frozenset(np.flatnonzero(langid.presence(t)).tolist())
    kernel = lambda a, b: len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))
    own = [grams(t) for t in texts]
    z = [frozenset(np.flatnonzero(r).tolist()) for r in model["landmarks"]]
    matrix = lambda p, q: np.array([[kernel(a, b) for b in q] for a in p])
    middle = np.linalg.pinv(matrix(z, z), rcond=1e-6, hermitian=True)
    smooth = lambda p, q: matrix(p, z) @ middle @ matrix(z, q) + 1.0
    weight = np.array([len(langs) / (3 * langs.count(x)) for x in langs])
    target = np.array([[1.0 if x == n else -1.0 for n in model["langs"]] for x in langs])
    dual = np.linalg.solve(smooth(own, own) + langid.RIDGE * np.diag(1 / weight), target)
    asked = [sentence(rng, 5, sum(vocab.values(), [])) for _ in range(40)] + ["zwei", "x", "dos drei beta"]
    margin = smooth([grams(t) for t in asked], own) @ dual
    odds = np.exp(2 * (margin - margin.max(1, keepdims=True)))
    names, p = langid.score(asked, model)
    best = margin.argmax(1)
    for k in range(len(asked)):
        close = np.sort(margin[k])[-1] - np.sort(margin[k])[-2] < 1e-3
        assert close or names[k] == model["langs"][best[k]]
        assert abs(p[k] - odds[k, best[k]] / odds[k].sum()) < 1e-3


def test_sharding_is_that_of_a_naive_ring(spark):
    rng = random.Random(13)
    rows = [(k, f"t{rng.randint(0, 50)}") for k in range(900)] + [(5, "same")] * 400 + [(None, "n")] * 30
    for shards in (7, 8):
        points, owner = sharding.ring(shards, sharding.VNODES)
        frame = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.xxhash64(F.crc32(F.col("text").cast("binary")), (F.octet_length("text") + 16).cast("long"))).otherwise(F.xxhash64(F.col("doc_id").cast("string"))).alias("place"))
        docs = [(int(np.searchsorted(points, np.uint64(r.place % (1 << 64)), "left") % len(points)), r.place, r.doc_id is not None, r.doc_id or 0, zlib.crc32(r.text.encode()), len(r.text) + 16) for r in frame.collect()]
        room = [len(docs) // shards + (s < len(docs) % shards) for s in range(shards)]
        load, kept, over = [0] * shards, [], []
        for d in sorted(docs):  # every document by itself: to its own shard while there is room
            s = int(owner[d[0]])
            if load[s] < room[s]:
                kept.append((d, s, load[s]))
                load[s] += 1
            else:
                over.append(d)
        for d in over:  # then clockwise
            at = d[0]
            while load[int(owner[at])] >= room[int(owner[at])]:
                at = (at + 1) % len(points)
            kept.append((d, int(owner[at]), load[int(owner[at])]))
            load[int(owner[at])] += 1
        want = sorted((d[3] if d[2] else -1, d[4], d[5], s, slot) for d, s, slot in kept)
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.text_crc32, r.size, r.shard, r.slot) for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards).collect())
        assert got == want


def test_perhaps_in_and_bounded_texts(spark, monkeypatch):
    from capsort.llm import common

    rng = np.random.default_rng(2)
    values = rng.integers(-(2**63), 2**63, 3000)
    keys = spark.createDataFrame([(int(v),) for v in values[:1000]], "k long")
    hit = common.perhaps_in(keys, "k")
    got = {r.v for r in spark.createDataFrame([(int(v),) for v in values], "v long").filter(hit("v")).collect()}
    assert set(values[:1000].tolist()) <= got and len(got) < 1100
    monkeypatch.setattr(common, "BITMAP", 64)
    assert common.perhaps_in(keys, "k") is None
    rows = spark.createDataFrame([(k % 7, k % 2, "x" * k) for k in range(60)] * 3, "place long, label int, text string")
    some = common.bounded_texts(rows, 50, 500)
    assert sum(len(t) for _, _, t in some) <= 500 and len(some) == len(set(some)) and some == common.bounded_texts(rows.repartition(5), 50, 500)
    with pytest.raises(ValueError):
        common.bounded_sample(spark.createDataFrame([(k, f"l{k}", "t") for k in range(5)], "doc_id long, lang string, text string"), "lang", 10, 3, 1000)


def test_empty_tables_and_repeated_rows(spark, docs, rows):
    none = docs.limit(0)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
    assert token_counts.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert licenses.scan_licenses(none).count() == toxicity.toxicity(none, labels).count() == langid.identify(none).count() == decontam.contamination(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    twice = docs.unionAll(docs)
    for run in (licenses.scan_licenses, lambda d: toxicity.toxicity(d, labels), langid.identify):
        counts = {}
        for r in run(twice).collect():
            counts[tuple(map(repr, r))] = counts.get(tuple(map(repr, r)), 0) + 1
        assert sum(counts.values()) == 2 * len(rows) and all(n % 2 == 0 for n in counts.values())


def test_pipeline_of_hard_tables(spark, tmp_path):
    """Every stage on an empty table, and on null ids and texts, repeated rows, long texts and clashing columns."""
    words = lambda k, n=30: " ".join(f"word{k}x{j}" for j in range(n))
    hard = [(None, words(1), None, None), (None, words(1), "en", "a"), (1, None, "en", "a"), (2, "", "en", "a"), (3, words(3), "en", None), (3, words(3), "en", None), (3, words(4), "de", "b"), (4, words(5, 25_000), "en", "hot"), (5, words(5, 25_000), "en", "hot"), (6, "ab", "de", "b")]
    schema = "doc_id long, text string, lang string, source string"
    clash = {"n_chars": F.lit(1).cast("long"), "fp": F.lit(1), "root": F.lit("r"), "key": F.lit(2.0), "shard": F.lit(9), "score": F.lit("s"), "node": F.lit(0)}
    full = spark.createDataFrame(hard, schema).withColumns(clash)
    for name, table in (("hard", full), ("empty", full.limit(0))):
        where = f"{tmp_path}/{name}"
        table.write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame([(1, words(3, 12)), (None, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
        docs = spark.read.parquet(f"{where}/documents.parquet")
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, docs, where)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, stage
                out.write.parquet(f"{where}/{stage}")
                docs = spark.read.parquet(f"{where}/{stage}")
                ids = sorted(map(repr, ((r.doc_id, (r.text or "")[:6]) for r in docs.select("doc_id", "text").collect())))
                if name == "hard" and stage == "language_id":
                    assert len(ids) == 8
                if name == "hard" and stage == "near_dedup":
                    assert ids == sorted(map(repr, [(None, "word1x"), (3, "word3x"), (3, "word4x"), (4, "word5x"), (6, "ab")]))
                if name == "hard" and stage == "decontamination":
                    assert ids == sorted(map(repr, [(None, "word1x"), (3, "word4x"), (4, "word5x"), (6, "ab")]))
                if name == "empty":
                    assert not ids
        assert (out.count() == 0) == (name == "empty")


def test_suffix_dedup_of_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 10**9)  # every text with more than 1,000 copies is hot
    long, short = "z" + "".join(chr(97 + k * k % 23) for k in range(500)), "short text"
    rows = [(k, long) for k in range(1100)] + [(k, short) for k in range(2000, 3101)] + [(5000, "head " + long + " tail"), (5001, "alone")]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert all((got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (501, 1, empty) for k in range(1100))
    assert all((got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (0, 0, hashlib.sha256(short.encode()).hexdigest()) for k in range(2000, 3101))
    assert (got[5000].n_removed, got[5000].n_spans, got[5000].kept_sha256) == (501, 1, hashlib.sha256(b"head  tail").hexdigest()) and got[5001].n_removed == 0


def test_tasks_start_one_worker_a_core(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    docs = spark.createDataFrame([(k, f"alpha beta gamma delta word{k} epsilon") for k in range(40)], "doc_id long, text string")
    nodes = simhash.sets(docs, 5, 0.8, np.zeros(0, np.uint64)).groupBy("fp").agg(simhash._head())
    pair = nodes.select("fp").orderBy("fp").limit(2).collect()
    own = simhash.whole_sets(spark.createDataFrame([(pair[0].fp, pair[1].fp)], "a long, b long"), nodes, docs, 5)
    assert "Python" not in plan(own) and own.count() == 2 and all(len(r.own) == 2 for r in own.collect())
    # Rows made from Python's would start workers of another kind beside those of Arrow.
    assert "ExistingRDD" not in plan(sharding.shard(docs))


def test_shards_bound_what_a_worker_holds():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(5000)]
    texts = [decontam.normal(" ".join(rng.choices(words, k=400))) for _ in range(700)]
    tests = decontam.test_suffixes([(1, texts[3].decode()), (2, "none of these")])
    shard, size = [], 0
    for t in texts:
        if size < decontam.SHARD:
            shard.append(t)
            size += len(t)
    tracemalloc.start()
    found = decontam.search(shard, tests, decontam.Hasher())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [k for k, x in enumerate(found) if len(x[1])] == [3] and peak < 20_000_000
