"""Name search, JSON containment and appends under several keys against brute force."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lanewise.operators import containment, names
from lanewise.sources import tables


def grams(name):
    words = re.findall(r"[^\W_]+", (name or "").lower())
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.fixture(scope="module")
def firms():
    rnd = random.Random(2)
    base = ["Nordic Freight & Cargo GmbH", "Pacific Lines", "Müller Söhne", "A", "ab", "12 Monkeys Ltd", "Freight Freight", "", None, "   -- ", "日本通運", "Pacific Line Holding"]
    for _ in range(150):
        word = "".join(rnd.choices("abcdeinorst", k=rnd.randint(1, 9)))
        base.append(f"{rnd.choice(['Pacific', 'Nordic', 'Freight', 'Global', word])} {word} {rnd.choice(['Lines', 'Ltd', 'GmbH', ''])}")
    return list(enumerate(base))


@pytest.mark.parametrize("threshold", [0.2, 0.3, 0.7, 1.0])
def test_search_finds_all_alike(spark, firms, threshold):
    df = spark.createDataFrame(firms, "id int, legal_name string").repartition(3)
    own = {k: grams(n) for k, n in firms}
    want = {(a, b): alike(own[a], own[b]) for a in own for b in own if alike(own[a], own[b]) >= threshold}
    got = {(r["query"], r["key"]): r["similarity"] for r in names.search(names.gram_index(df, "id", "legal_name"), df, "id", "legal_name", threshold).collect()}
    assert got == pytest.approx(want) and len(want) > 100
    best = names.search(names.gram_index(df, "id", "legal_name"), df, "id", "legal_name", threshold, 3)
    first = {}
    for (a, b), s in sorted(want.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
        first.setdefault(a, []).append(b)
    ranked = {}
    for r in sorted(best.collect(), key=lambda r: (r["query"], -r["similarity"], r["key"])):
        ranked.setdefault(r["query"], []).append(r["key"])
    assert ranked == {a: b[:3] for a, b in first.items()}


def test_first_names_among_many_with_common_grams(spark):
    texts = {k: f"Customer#{k:09d} TAX{k:010d}" for k in range(0, 90000, 300)} | {90001: "Customer elsewhere", 90002: "Customer elsewhere"}
    asked = {k: f"Custmer#{k:09d} & TAX{k:010d}" for k in range(0, 90000, 3000)} | {1: "Custom", 2: "xyzzy", 3: "Customer elsewhere"}
    frame = lambda d, names_: spark.createDataFrame([*d.items()], names_)
    index = names.gram_index(frame(texts, "id int, name string"), "id", "name")
    held, wanted = {k: grams(t) for k, t in texts.items()}, frame(asked, "id int, text string")
    want = {}
    for q, t in asked.items():
        best = sorted((-alike(grams(t), g), k) for k, g in held.items() if alike(grams(t), g) >= 0.3)[:3]
        want |= {(q, k): -s for s, k in best}
    got = {(r["query"], r["key"]): r["similarity"] for r in names.search(index, wanted, "id", "text", 0.3, 3).collect()}
    assert got == pytest.approx(want) and {q for q, _ in want} >= {1, 3} and (2, 0) not in got


def test_few_pairs_are_compared_at_a_high_similarity(spark, monkeypatch):
    texts = [(k, f"Customer#{k:09d} TAX{k:010d}") for k in range(100000, 130000, 97)]
    df, seen = spark.createDataFrame(texts, "id int, name string"), []
    pairs = names._pairs
    monkeypatch.setattr(names, "_pairs", lambda postings, each, t: seen.append((t, each.select("query").distinct().count(), pairs(postings, each, t).count())) or pairs(postings, each, t))
    names.search(names.gram_index(df, "id", "name"), df.limit(40), "id", "name", 0.3, 1).collect()
    assert seen[0][0] == 0.7 and len(seen) == 1 and seen[0][2] < 0.1 * 40 * len(texts)


def contained(a, b, top=True):
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and contained(a[k], v, False) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(contained(x, y, False) for x in a) for y in b)
    if isinstance(a, list) and top:
        return any(contained(x, b, False) for x in a if not isinstance(x, list))
    if isinstance(b, bool) or isinstance(a, bool) or b is None or a is None or isinstance(b, str) or isinstance(a, str):
        return type(a) is type(b) and a == b
    return not isinstance(a, (dict, list)) and a == b


def test_containment(spark):
    rnd = random.Random(7)

    def value(depth):
        kinds = [lambda: rnd.choice([1, 1.0, 2.5, -3, 0, 10**16 + 1]), lambda: rnd.choice(["a", "b", "1", "", "it's"]), lambda: rnd.choice([True, False, None])]
        if depth:
            kinds += [lambda: {rnd.choice(["x", "y", "it's", "a b"]): value(depth - 1) for _ in range(rnd.randint(0, 3))}, lambda: [value(depth - 1) for _ in range(rnd.randint(0, 3))]] * 2
        return rnd.choice(kinds)()

    documents = [value(3) for _ in range(400)] + [{"x": {"y": [1, {"x": "a", "y": 2.5}], "a b": None}}, [[1, 2], "a"], {"x": 1.0}, {"x": "1"}]
    rows = [(k, json.dumps(d)) for k, d in enumerate(documents)] + [(-1, None), (-2, "{not json"), (-3, "")]
    df = spark.createDataFrame(rows, "id int, doc string").repartition(4).cache()
    wanted = [{}, [], 1, "a", None, True, {"x": 1}, {"x": {"y": [{"y": 2.5}]}}, {"x": {"a b": None}}, [1], [[2]], ["a", "a"], {"it's": {}}, {"x": []}, 10**16 + 1, [10**16 + 1], {"x": "1"}, *[value(2) for _ in range(12)]]
    for w in wanted:
        got = {r["id"] for r in containment.containing(df, "doc", w).select("id").collect()}
        assert got == {k for k, d in enumerate(documents) if contained(d, w)}, w
    with pytest.raises(TypeError):
        containment.contains(F.lit("{}"), object())


def replayed(existing, rows, keys):
    used, out = [set() for _ in keys], []
    for stored, row in [(True, r) for r in existing] + [(False, r) for r in rows]:
        values = [None if any(row[c] is None for c in key) else tuple(row[c] for c in key) for key in keys]
        if stored or not any(v is not None and v in u for v, u in zip(values, used, strict=True)):
            for v, u in zip(values, used, strict=True):
                u.add(v)
            if not stored:
                out.append(row)
    return out


def test_append_under_several_keys_equals_a_replay(spark):
    schema, keys = "at int, a string, b string, c int, note string", [["a"], ["b", "c"], ["note"]]
    rnd = random.Random(11)
    pick = lambda n: None if rnd.random() < 0.1 else f"v{rnd.randrange(n)}"
    rows = [{"at": k, "a": pick(120), "b": pick(12), "c": None if k % 17 == 0 else rnd.randrange(12), "note": f"n{k}"} for k in range(300)]
    rows += [{"at": 1000 + k, "a": f"chain{k // 2}", "b": f"link{(k + 1) // 2}", "c": 1, "note": None} for k in range(24)]  # each decides the next
    existing = [{"at": 0, "a": "v1", "b": "v2", "c": 3, "note": None}, {"at": 0, "a": None, "b": "v3", "c": 4, "note": "n7"}]
    want = [r["at"] for r in replayed(existing, rows, keys)]
    shuffled = rnd.sample(rows, len(rows))
    names_ = [c.split()[0] for c in schema.split(", ")]
    df = lambda rs: spark.createDataFrame([tuple(r[c] for c in names_) for r in rs], schema)
    got = tables.new_rows_under(df(existing), df(shuffled).repartition(3), keys, ["at"])
    assert sorted(r["at"] for r in got.collect()) == sorted(want) and sum(a >= 1000 for a in want) == 12
    twice = tables.new_rows_under(df(existing), df([rows[0], rows[0]]), [["note"]], ["at"])
    assert twice.count() == 1 and tables.new_rows_under(df(existing), df([]), keys, ["at"]).count() == 0
