"""Token counts, token files, the mix, the language model and the quality classifier against the libraries and brute force."""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from made import made_texts
from pyspark.sql import functions as F

from lanewise.llm import language_model, mixing, quality, textblocks, token_counts, token_files
from lanewise.llm.queries import tokenizer_file
from lanewise.llm.shared import shared_folder

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def key(pair):
    return (pair[0] is None, pair[0] or 0, str(pair[1:]))


def bag(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(spark, nasty, rows_of, none, name):
    path, cache = tokenizer_file(name), shared_folder(spark)
    if name.endswith(".model"):
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        from tokenizers import Tokenizer

        encode = lambda t: Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids
    want = sorted(((d, len((t or "").encode()), len(encode(t or "")), len(encode(t or "")) > 100) for d, t in rows_of), key=key)
    names = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert bag(token_counts.token_counts(nasty, path, cache, limit=100), *names) == want
    first = spark.read.parquet(cache)
    assert first.count() == first.select("key").distinct().count() == len({t or "" for _, t in rows_of})
    assert bag(token_counts.token_counts(nasty, path, cache, limit=100), *names) == want
    assert spark.read.parquet(cache).count() == first.count()  # nothing was encoded again
    assert token_counts.token_counts(none, path).count() == 0


def test_counts_of_another_tokenizer_do_not_match(spark):
    docs, cache = spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), shared_folder(spark)
    counts = [token_counts.token_counts(docs, tokenizer_file(n), cache).first()["n_tokens"] for n in ("piece_bpe_32k.model", "byte_bpe_50k.json")]
    assert spark.read.parquet(cache).count() == 2 and counts[0] > 0


def test_token_files(spark, nasty, rows_of, none):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    model, want, start = Tokenizer.from_file(path), {}, 0
    for d, t in sorted(rows_of, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    folder = token_files.write_token_files(nasty, path, 2)
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(spark, folder).collect()}
    assert found == want
    shards = token_files.manifest(spark, folder).orderBy("shard").collect()
    assert [s["base"] for s in shards] == [sum(t["n_ids"] for t in shards[:k]) for k in range(len(shards))]
    doc_ids, offsets, ids = token_files.open_shard(folder, shards[0]["file"])
    assert ids.dtype == np.dtype("<u2") and isinstance(ids, np.memmap) and len(ids) == offsets[-1] == shards[0]["n_ids"] and ids[offsets[1] - 1] == 2
    assert token_files.token_output(none, path, 2).count() == 0


def test_pieces_encode_as_the_whole_text():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    model, ours = Tokenizer.from_file(path), token_files.encoder(path)

    pieces = [*"ab 's\n\t \x1c\x85,.1é日", "　", "  ", "<|endoftext|>", " '", "'ll"]

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from(pieces), max_size=25))
    def same(parts):
        text = "".join(parts)
        assert [x.tolist() for x in ours([text, "", text])] == [model.encode(t, add_special_tokens=False).ids for t in (text, "", text)]

    same()


def test_long_texts_and_full_memory_of_pieces(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    monkeypatch.setattr(token_files, "_LOADED", {})
    for name, value in (("PART", 11), ("PIECES", 20), ("CHARACTERS", 60)):
        monkeypatch.setattr(token_files, name, value)
    model, ours = Tokenizer.from_file(path), token_files.encoder(path)
    texts = [t or "" for t in made_texts()] + [" lead", "trail ", "x" * 50, " ".join(f"w{k}" for k in range(400))]
    for _ in range(2):
        for k in range(0, len(texts), 7):
            assert [x.tolist() for x in ours(texts[k : k + 7])] == [model.encode(t, add_special_tokens=False).ids for t in texts[k : k + 7]]


def test_tied_doc_ids_have_one_order(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(1, "same"), (1, "same"), (0, "first")], "doc_id long, text string")
    path = tokenizer_file("byte_bpe_50k.json")
    runs = [bag(token_files.token_output(d, path, 2), "start", "doc_id", "n_tokens", "ids_crc32") for d in (docs, docs.repartition(5))]
    assert runs[0] == runs[1] and runs[0][0][1] == 0


def brute_targets(sizes: dict, share=1.5, most=2, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix(nasty, none):
    given = [(r["doc_id"], r["text"], r["source"]) for r in nasty.collect()]
    sizes = Counter()
    for _, t, s in given:
        sizes[s] += len(SPACED.findall(t or ""))
    target = brute_targets(sizes)
    plan = mixing.mix_plan(nasty).collect()
    by_source = {}
    for r in plan:
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
    for d, t, s in given:
        r = next(r for r in plan if r["doc_id"] == d and r["size"] == len(SPACED.findall(t or "")))
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        by_source[s] = r["target"]
    assert sum(by_source.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert mixing.mix_plan(none).count() == 0 == mixing.mixed(none).count()
    mixed = mixing.mixed(nasty)
    assert mixed.columns == nasty.columns and mixed.count() == sum(r["copies"] for r in plan)
    again = mixing.mixed(nasty.repartition(7))
    assert bag(again.select("doc_id", "text", "source"), "doc_id", "text", "source") == bag(mixed.select("doc_id", "text", "source"), "doc_id", "text", "source")


@pytest.mark.parametrize("sizes", [{"a": 100}, {"a": 10, "b": 1000, "c": 0, None: 5}, {"a": 0, "b": 0}, {f"s{k:02}": (k * k * 7) % 101 for k in range(20)}])
def test_targets(spark, sizes):
    found = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    assert {r["source"]: pytest.approx(r["target"]) for r in found} == brute_targets(sizes)


def test_sources_come_near_their_targets(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 30).cast("int")).alias("text"))
    rows = mixing.mix_plan(docs).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.03 * r["target"] for r in rows)


def test_language_scores(nasty, rows_of, none):
    tokens = [SPACED.findall((t or "").translate(LOWER)) + [None] for _, t in rows_of]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows_of]
    count = Counter(w for own, out in zip(tokens, held, strict=True) if not out for w in own)
    total, known = sum(count.values()), len(count)
    found = bag(language_model.language_scores(nasty), "doc_id", "n_tokens", "held_out", "n_known", "train_tokens", "base_score", "score")
    want = [(d, len(w), h, sum(count[x] > 0 for x in w), total, sum(math.log10((count[x] + 1) / (total + known + 1)) for x in w)) for (d, _), w, h in zip(rows_of, tokens, held, strict=True)]
    for f, w in zip(found, sorted(want, key=key), strict=True):
        assert f[:5] == w[:5] and f[5] == pytest.approx(w[5]) and f[6] < 0
    assert sum(f[6] for f in found) > 1.1 * sum(f[5] for f in found)  # words in random order have nothing to learn
    assert language_model.language_scores(none).count() == 0


def small_vocabulary(bits=7):
    words = [f"w{'x' * (k % 15)}{k}{'.' * (k % 2)}" for k in range(3000)]
    counts = np.append([3000 // (k + 1) for k in range(2000)] + [0] * 1000, 40)  # the end comes last
    hashes, form, _ = language_model._tokens(*textblocks.text_bytes(pa.array([" ".join(words)])))
    form = form.astype(np.int64)
    cells = np.bincount(form * 64 + (hashes >> np.uint64(58)).astype(np.int64), counts, language_model.CELLS).reshape(language_model.FORMS, 64)
    model = language_model.Model(int(counts.sum()), int((counts > 0).sum()), cells, bits)
    codes, lengths = np.zeros(len(words) + 1, np.uint64), np.zeros(len(words) + 1, np.int64)
    bucket = hashes >> np.uint64(64 - bits)
    for b in np.unique(bucket):
        codes[bucket == b], lengths[bucket == b] = language_model.coded(counts[bucket == b], form[bucket == b])
    return model, hashes, form, counts, model.ways(hashes, form, codes, lengths)


def test_probabilities_add_up():
    """Over all ways: every known word, and one for the unknown words of each form and bucket, whatever comes before and whatever the weights."""
    model, _, form, counts, (codes, lengths, to_cell) = small_vocabulary()
    model.weights += np.random.default_rng(0).normal(0, 0.7, len(model.weights)).astype(np.float32)
    known = set(zip(codes[counts > 0].tolist(), lengths[counts > 0].tolist(), strict=True))
    assert len(known) == (counts > 0).sum() and not known & set(zip(codes[counts == 0].tolist(), lengths[counts == 0].tolist(), strict=True))

    def gone_down(prefix, depth, leaves):
        """The tree below, as far as leaves show it; a split without words of one side has the unknown words' leaf there."""
        inside = [(c, n) for c, n in leaves if c >> (64 - depth) == prefix] if depth else leaves
        if not inside or (len(inside) == 1 and inside[0][1] == depth):
            return [(prefix << (64 - depth), depth)]
        assert all(n > depth for _, n in inside)
        return gone_down(prefix << 1, depth + 1, inside) + gone_down(prefix << 1 | 1, depth + 1, inside)

    ways = gone_down(0, 0, sorted(known))
    own = np.array([c for c, _ in ways], np.uint64), np.array([n for _, n in ways])
    context = np.full(len(ways), 12345, np.uint64)
    taken, *used = model.features(*own, np.minimum(own[1], 9), context, context + np.uint64(7))
    logits = language_model._logits(model.weights, *used).astype(float)
    each = np.add.reduceat(-np.logaddexp(0, np.where(taken > 0, -logits, logits)), np.cumsum(own[1]) - own[1])
    assert np.exp(each).sum() == pytest.approx(1)


def test_codes_are_short_for_frequent_words():
    model, _, _, counts, (_, lengths, to_cell) = small_vocabulary()
    seen = counts > 0
    share = counts[seen] / counts.sum()
    entropy = -(share * np.log2(share)).sum()
    assert entropy <= (share * lengths[seen]).sum() < entropy + 3 and (to_cell < lengths).all() and lengths.max() <= 64
    weights = np.array([1.6**k for k in range(60)])  # without a least share the longest code has 59 bits
    codes, own = language_model.splits(weights, 2.0**-16)
    assert own.max() <= 24 and sum(2.0 ** -n for n in own.tolist()) == 1 and len({(int(c), int(n)) for c, n in zip(codes, own, strict=True)}) == 60


def test_a_step_is_the_gradient_of_the_likelihood():
    model, hashes, form, counts, (codes, lengths, to_cell) = small_vocabulary()
    model.weights += np.random.default_rng(1).normal(0, 0.3, len(model.weights)).astype(np.float32)
    own = np.arange(5)
    before, skip = (textblocks.mixed_bits(own.astype(np.uint64) + np.uint64(k)) for k in (1, 50))

    def likelihood(weights):
        taken, *used = model.features(codes[own], lengths[own], to_cell[own], before, skip)
        logits = language_model._logits(weights, *used)
        return -np.logaddexp(0, np.where(taken > 0, -logits, logits)).sum()

    taken, with_before, first, alone, with_skip = model.features(codes[own], lengths[own], to_cell[own], before, skip)
    weights = model.weights.astype(float)
    error = 1 / (1 + np.exp(-language_model._logits(weights, with_before, first, alone, with_skip))) - taken
    gradient = np.zeros(len(weights))
    for used, part in ((with_before, error), (alone, error[first]), (with_skip, error[first])):
        np.add.at(gradient, used, part)
    for slot in {*with_before[:6].tolist(), *alone[:6].tolist(), *with_skip[:6].tolist()}:
        ahead, behind = weights.copy(), weights.copy()
        ahead[slot] += 1e-5
        behind[slot] -= 1e-5
        assert -gradient[slot] == pytest.approx((likelihood(ahead) - likelihood(behind)) / 2e-5, abs=1e-5)


def test_a_broadcast_model_learns_with_plain_floats():
    """Unpickled weights have a type object of their own, for which each addition takes ``add.at``'s slow way."""
    model = small_vocabulary()[0]
    data, offsets = textblocks.text_bytes(pa.array([" ".join(f"w{(k * j) % 97}" for j in range(400)) for k in range(40)]))
    n = len(np.unique(language_model._tokens(data, offsets)[0]))
    answer = language_model.answer_about(np.full(n, 9), np.arange(n, dtype=np.uint64), np.full(n, 7))
    batch = pa.RecordBatch.from_pydict({"chunk": [0], "doc_ids": [[*range(40)]], "ends": [offsets[1:].tolist()], "body": [data.tobytes()], "answers": [[{"bucket": 0, "answer": answer}]]})

    def seconds(m):
        begun = time.process_time()
        change, squares = language_model._learn(m, iter([batch] * 10), 0, 7, 2)
        return time.process_time() - begun, change, squares

    seconds(model)
    here, there = seconds(model), seconds(pickle.loads(pickle.dumps(model)))
    assert (here[1] == there[1]).all() and (here[2] == there[2]).all() and np.abs(here[1]).sum() > 0
    assert there[0] < 2 * here[0] + 0.1
    assert pickle.loads(pickle.dumps(model)).weights.dtype is np.dtype(np.float32)


def test_features_are_those_of_the_splits():
    """Word by word and split by split: the split is a one and the code down to it."""
    model = language_model.Model(10, 5, np.zeros(language_model.CELLS, np.int64), 6)
    rng = np.random.default_rng(3)
    lengths = np.array([1, 64, 7, 30, 12])
    codes = (rng.integers(0, 2**64, 5, dtype=np.uint64) >> (64 - lengths).astype(np.uint64)) << (64 - lengths).astype(np.uint64)
    to_cell, before, skip = np.array([1, 9, 7, 40, 0]), rng.integers(0, 2**64, 5, dtype=np.uint64), rng.integers(0, 2**64, 5, dtype=np.uint64)
    down, spread, mixed = 65 - len(model.weights).bit_length(), int(language_model._SPLIT), int(language_model._WITH)
    want = [[], [], [], [], []]
    for code, n, cell, b, s in zip(codes.tolist(), lengths.tolist(), to_cell.tolist(), before.tolist(), skip.tolist(), strict=True):
        for depth in range(n):
            split = ((code >> (64 - depth) | 1 << depth) * spread) % 2**64
            if depth < cell:
                want[2].append(len(want[0]))
                want[3].append(split >> down)
                want[4].append(((split ^ s) * mixed) % 2**64 >> down)
            want[0].append(code >> (63 - depth) & 1)
            want[1].append(((split ^ b) * mixed) % 2**64 >> down)
    assert [x.tolist() for x in model.features(codes, lengths, to_cell, before, skip)] == want


def test_held_out_texts_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = [r for r in language_model.language_scores(docs).collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in out)
    assert sum(r["score"] - r["base_score"] for r in out) / tokens > 0.17


def test_word_hashes_are_those_of_the_words():
    texts = ["", None, "a  B\tc", "ABC abc\x0bAbC", " é É ", "x"]
    hashes, first = textblocks.word_hashes(*textblocks.text_bytes(pa.array(texts)))
    words = [SPACED.findall((t or "").translate(LOWER)) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in words]
    flat = [w for own in words for w in own]
    assert len(set(hashes.tolist())) == len(set(flat))
    assert all((hashes[i] == hashes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))
    assert [len(p) for p in textblocks.slices(pa.array(["ab", "cde", "", None, "x" * 50]), 4)] == [1, 3, 1]


def test_quality_learns_and_scores(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = quality.quality_scores(docs, labels).toPandas()
    assert len(found) == docs.count() and found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.7)).all()
    assert (found.held_out == found.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    known = found[found.held_out].merge(labels.toPandas(), on="doc_id")
    good, bad = known[known.quality == 1].score, known[known.quality == 0].score
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    # The held-out fold's labels, and columns other than the text, change nothing.
    other = docs.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string"), "score": F.lit(1)})
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.quality_scores(other, turned).toPandas()
    both = found.merge(again, on="doc_id")
    assert np.allclose(both.score_x, both.score_y)


def test_quality_edge_cases(spark, nasty, none):
    labels = spark.createDataFrame([(37, 1, 0), (37, 0, 0), (None, 1, 0), (74, None, 1), (111, 0, 0)], "doc_id long, quality int, toxic int")
    found = quality.quality_scores(nasty, labels)
    assert found.count() == nasty.count() and found.filter("score IS NULL OR isnan(score)").count() == 0
    assert quality.quality_scores(none, labels).count() == 0
    unlearnt = quality.quality_scores(nasty, labels.limit(0)).agg(F.min("score"), F.max("score")).first()
    assert tuple(unlearnt) == (0.5, 0.5)
    kept = quality.good_documents(nasty, labels)
    assert kept.columns == nasty.columns


def test_digest_of_tokenizer_depends_on_file():
    a, b = (token_counts.tokenizer_version(tokenizer_file(n)) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json"))
    assert a != b and len(a) == len(hashlib.sha256(b"").hexdigest())
