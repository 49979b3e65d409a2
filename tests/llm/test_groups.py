"""Exact dedup, the Jaccard join, decontamination and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import re
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lanewise.llm import chunks, decontamination, exact_dedup, jaccard, licenses, suffix_dedup, textblocks
from lanewise.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(pair):
    return (pair[0] is None, pair[0] or 0, str(pair[1:]))


def bag(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)


def test_exact_dedup(nasty, rows_of, none):
    groups = defaultdict(list)
    for doc_id, text in rows_of:
        groups[text or ""].append(doc_id)
    want = []
    for doc_id, text in rows_of:
        own = groups[text or ""]
        keep = max((d for d in own if d is not None), default=None)
        want.append((doc_id, keep, len(own), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert bag(exact_dedup.exact_dedup(nasty, capacity=4), *names) == sorted(want, key=key)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_directory_splits_only_overfull_buckets(spark):
    crowded = [(k << 40,) for k in range(1, 41)] + [(-(k << 58),) for k in range(1, 9)]  # forty keys share 18 leading bits
    keys = spark.createDataFrame(crowded, "key long")
    cells, depth = exact_dedup.directory(keys, capacity=4)
    placed = keys.withColumn("cell", exact_dedup.cell_of(keys["key"], depth)).join(cells, "cell")
    assert placed.count() == len(crowded)
    sizes = {r["bucket"]: (r["local_depth"], r["count"]) for r in placed.groupBy("bucket", "local_depth").count().collect()}
    assert all(n <= 4 or level == depth for level, n in sizes.values()) and len({level for level, _ in sizes.values()}) > 1


def test_equal_keys_chain(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: exact_dedup.F.lit(5).cast("long"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    assert bag(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size") == [(1, 3, 2), (2, 2, 1), (3, 3, 2)]


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    members = defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        members[find(k)].append(doc_id)
    return sorted(((d, len(sets[k]), min((x for x in members[find(k)] if x is not None), default=None)) for k, (d, _) in enumerate(rows)), key=key)


def test_jaccard_groups(nasty, rows_of, none):
    assert bag(jaccard.jaccard_groups(nasty), "doc_id", "n_shingles", "component_id") == brute_groups(rows_of)
    assert jaccard.jaccard_groups(none).count() == 0
    kept = jaccard.one_of_each(nasty)
    assert kept.columns == nasty.columns
    want = [d for d, _, c in brute_groups(rows_of) if d == c]
    assert sorted([r["doc_id"] for r in kept.collect()], key=lambda d: (d is None, d or 0)) == want
    assert jaccard.one_of_each(none).count() == 0


def test_jaccard_chains_of_links_and_sliced_tiles(spark, monkeypatch):
    """A chain whose ends do not link, and a family with outliers so large for its slices that every tile is a grid."""
    monkeypatch.setattr(jaccard, "SLICE", 3)
    base = [f"w{k}" for k in range(120)]
    texts, current = [], list(base)
    for step in range(12):
        texts.append(" ".join(current))
        for j in range(4):
            current[(step * 4 + j) % 120] = f"s{step}x{j}"
    for k in range(20):
        own = list(base)
        for j in range(k % 7):
            own[5 * j + 60] = f"o{k}y{j}"
        texts.append(" ".join(own))
    rows = [(k + 1, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert bag(jaccard.jaccard_groups(docs), "doc_id", "n_shingles", "component_id") == brute_groups(rows)


def test_links_between_classes_are_all_links(nasty, rows_of, none):
    links, rows = jaccard.jaccard_links(nasty)
    classes = defaultdict(list)
    for r in rows.collect():
        classes[r["class"]].append(r["doc_id"])
    sets = [shingles(t) for _, t in rows_of]
    got = Counter()
    for r in links.collect():
        assert r["class_a"] > r["class_b"]
        got.update(frozenset((x, y)) for x in classes[r["class_a"]] for y in classes[r["class_b"]])
    for c, own in classes.items():
        if c is not None:
            got.update(frozenset((own[i], own[j])) for i in range(len(own)) for j in range(i))
    want = Counter(frozenset((rows_of[a][0], rows_of[b][0])) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    assert got == want and len(rows.columns) == 3
    links, rows = jaccard.jaccard_links(none)
    assert links.count() == 0 and rows.count() == 0


def test_one_of_each_tells_texts_under_one_id_apart(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "eins zwei drei vier")
    rows = [(3, b), (5, a), (5, b), (7, c), (7, c), (None, c), (None, "only here")]
    docs = spark.createDataFrame([(*r, 1, "v") for r in rows], "doc_id long, text string, kept_id int, version string").repartition(3)
    assert bag(jaccard.one_of_each(docs), "doc_id", "text", "version") == sorted([(3, b, "v"), (5, a, "v"), (7, c, "v"), (7, c, "v"), (None, "only here", "v")], key=key)


def test_signatures_bound_overlap_from_above():
    rng = np.random.default_rng(1)
    for n, m, common in ((50, 60, 30), (400, 300, 290), (1000, 40, 40)):
        shared = rng.integers(1, 1 << 48, common, dtype=np.uint64)
        a = np.concatenate([shared, rng.integers(1, 1 << 48, n - common, dtype=np.uint64)])
        b = np.concatenate([shared, rng.integers(1, 1 << 48, m - common, dtype=np.uint64)])
        s, t = jaccard.signature(a, n), jaccard.signature(b, m)
        size = min(len(s), len(t))
        apart = int(np.bitwise_count(jaccard._folded([s], size) ^ jaccard._folded([t], size)).sum())
        assert (n + m - apart) // 2 >= len(np.intersect1d(a, b))


@pytest.mark.parametrize("n", range(6))
def test_chunks_of_few_words(n):
    """A chunk may hold less text than one shingle, in one text or in several."""
    words = [f"w{k}" for k in range(n)]
    for texts in ([" ".join(words)], [*words], ["", " ".join(words[:1]), " ".join(words[1:]), None]):
        keys = jaccard.shingle_keys(*textblocks.text_bytes(pa.array(texts, pa.string())))
        assert np.bincount((keys & jaccard._LOW).astype(int), minlength=len(texts)).tolist() == [len(shingles(t)) for t in texts]


def test_jaccard_of_three_words_between_long_texts(spark, monkeypatch):
    """The three words are a chunk of their own."""
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 200)
    long = " ".join(f"w{k}" for k in range(100))
    rows = [(1, long), (2, "one two three"), (3, long + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert bag(jaccard.jaccard_groups(docs), "doc_id", "n_shingles", "component_id") == brute_groups(rows)


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    found = dict(bag(components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert found == {**dict.fromkeys(range(1, 41), 1), 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_decontamination(rows, items):
    windows = defaultdict(set)
    for item_id, text in items:
        w = item_words(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(item_id)
    found = []
    for doc_id, text in rows:
        w, hit, ids = item_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[x]
        names = sorted(str(i) for i in ids if i is not None)
        found.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(found, key=key)


@pytest.mark.parametrize("most_broadcast", [decontamination.MOST_BROADCAST, 0])
def test_decontamination(spark, nasty, rows_of, most_broadcast):
    texts = [t for _, t in rows_of if t and len(t.split()) > 60]
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    items = [(1, cut(texts[0], 5, 40)), (2, cut(texts[1], 30, 43)), (2, cut(texts[2], 0, 20)), (10, None), (11, ""), (12, "One! TWO three-four"), (13, "never seen words here at all, really, none of them, in any of these"), (None, cut(texts[3], 10, 24)), (14, "lo lo " * 9)]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words int")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute_decontamination(rows_of, items)
    assert bag(decontamination.decontamination(nasty, table, most_broadcast=most_broadcast), *names) == want
    clean = decontamination.clean_documents(nasty, table, most_broadcast=most_broadcast)
    assert clean.columns == nasty.columns and clean.count() == sum(not w[-1] for w in want) and any(w[-1] for w in want)


def test_decontamination_of_nothing(spark, nasty, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontamination(nasty, items).filter("n_hit = 0 AND NOT contaminated").count() == nasty.count()
    assert decontamination.decontamination(none, items).count() == 0


def brute_repeats(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    found = []
    for (doc_id, _), b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        found.append((doc_id, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(found, key=key)


@pytest.mark.parametrize("chunk_bytes", [suffix_dedup.CHUNK_BYTES, 1500])
def test_suffix_dedup(nasty, rows_of, monkeypatch, chunk_bytes):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk_bytes)
    want = brute_repeats(rows_of)
    assert any(0 < removed < size for _, size, removed, _, _ in want)
    assert bag(suffix_dedup.repeat_counts(nasty), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_suffix_dedup_spans(spark, none):
    assert suffix_dedup.repeat_counts(none).count() == 0
    text = "é" * 250
    docs = spark.createDataFrame([(1, text), (2, "b" * 200), (3, "b" * 199 + "c")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert [tuple(s) for s in found[1]["spans"]] == [(0, 500)] and bytes(found[1]["kept"]) == b""
    assert found[2]["spans"] == [] == found[3]["spans"] and bytes(found[2]["kept"]) == b"b" * 200


def test_cover():
    p, cover = suffix_dedup.PERIOD, suffix_dedup.COVER
    assert {(a - b) % p for a in cover for b in cover} == set(range(p))
    for a in range(p):
        for b in range(p):
            assert any((a + d) % p in cover and (b + d) % p in cover for d in range(p))


def test_key_planes_round_trip():
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 64, 1000, dtype=np.uint64))
    assert (chunks.from_planes(chunks.planes(keys)) == keys).all() and len(chunks.from_planes(b"")) == 0


def test_license_scan(spark, nasty, none):
    mit = licenses.KNOWN["MIT"]
    forms = ["Copyright (c) 2020 A\n (c) B\n\n" + mit, mit.upper().replace("\n", "  \n * "), mit.replace("sublicense", "sublicence") + "\n\u00a9 me", mit + " more", "", None]
    docs = spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")
    found = licenses.license_scan(docs, licenses.known_licenses(spark)).orderBy("doc_id").collect()
    assert [r["license_id"] for r in found] == ["MIT"] * 3 + [None] * 3 and len({r["canonical_sha256"] for r in found[:3]}) == 1
    assert licenses.license_scan(nasty, licenses.known_licenses(spark)).filter("NOT is_license").count() == nasty.count()
    assert licenses.license_scan(none, licenses.known_licenses(spark)).count() == 0


def test_licenses_of_usual_files(spark):
    """Whole files: with title and copyright lines, other line breaks, filled-in or left-out instructions; nothing else counts."""
    text = {f.stem: f.read_text("utf-8") for f in licenses.FOLDER.glob("*.txt")}
    mit, isc, bsd = licenses.KNOWN["MIT"], licenses.KNOWN["ISC"], text["BSD-3-Clause"]
    apache = text["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2024 A Company")
    third = bsd[bsd.index("3. Neither") : bsd.index("THIS SOFTWARE")]
    wrap = lambda t, n: "\n\n".join(textwrap.fill(" ".join(p.split()), n) for p in t.split("\n\n"))
    forms = [
        ("MIT", "MIT License\n\nCopyright (c) 2024 A B\n\n" + mit),
        ("MIT", "# The MIT License (MIT)\n=====\n\nCopyright (c) 2024 A B\nCopyright (c) 2025 C\n\n" + wrap(mit, 56)),
        ("ISC", "The ISC License\n\nCopyright (c) A B and Contributors\n\n" + wrap(isc, 72)),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2024, A B\nAll rights reserved.\n\n" + bsd),
        ("BSD-3-Clause", "Copyright (c) 2024, A B\n\n" + wrap(bsd, 64).replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")),
        ("BSD-2-Clause", "Copyright 2024 A B\n\n" + bsd.replace(third, "")),
        ("Apache-2.0", apache),
        ("Apache-2.0", apache.replace("http://", "https://")),
        ("Apache-2.0", apache[: apache.index("END OF TERMS") + 27]),
        ("GPL-2.0", text["GPL-2.0"][: text["GPL-2.0"].index("END OF TERMS") + 27]),
        *[(name, text[name]) for name in ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "Unlicense", "BSL-1.0", "Zlib", "0BSD", "Apache-2.0 WITH LLVM-exception")],
        (None, text["GPL-3.0"] + "\nand more"),
        (None, "MIT License"),
        (None, "Licensed under the Apache License, Version 2.0"),
    ]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(forms)], "doc_id long, text string")
    found = licenses.license_scan(docs, licenses.known_licenses(spark)).orderBy("doc_id").collect()
    assert [r["license_id"] for r in found] == [name for name, _ in forms]
