"""Removing repeated strings: a difference-cover sample of the suffixes, ranked first, then the rest bucket by bucket.

Positions whose number in the text, modulo ``PERIOD``, is in the difference cover ``COVER`` are the sample. For any two
positions there is an offset below ``PERIOD`` that brings both into the sample. So where two suffixes agree on
``LENGTH`` bytes, two sample suffixes agree on ``WINDOW = LENGTH - PERIOD + 1`` bytes:

1. Sample suffixes are ranked by their first ``WINDOW`` bytes. A suffix without a sample of a shared rank in reach is unique.
2. Samples of one rank are ranked again by all the bytes that the suffixes in reach of them span. Equal second ranks settle
   ``PERIOD`` suffixes at once: all are repeated. This resolves the long ties, without touching a suffix.
3. Suffixes in reach of samples with one first rank and different second ranks, near the ends of repeats, go to suffix buckets:
   each bucket is sorted on its own by ``LENGTH`` bytes and equal neighbours are repeated. Of equal second ranks one
   sample stands for all.

Ranks and bucket keys are 63-bit fingerprints: any order puts equal strings side by side. Tasks hold a chunk of text
or a bucket of fingerprints, nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm import chunks as ch
from lanewise.llm import textblocks
from lanewise.llm.shared import WIDE_ROWS, settings, stored

LENGTH = 200
#: Every number below PERIOD is a difference of two of these, modulo PERIOD.
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
WINDOW = LENGTH - PERIOD + 1
CHUNK_BYTES = 2_000_000
#: Text whose samples, or suffixes, one bucket takes.
BUCKET_BYTES = 12_000_000
_ONE = np.uint64(1)
_PATTERN = np.isin(np.arange(PERIOD), COVER)


def _samples(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sample positions whose window lies in their text, and the text of each."""
    positions, texts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if b - a >= LENGTH:
            own = np.flatnonzero(np.resize(_PATTERN, b - a - WINDOW + 1)) + a
            positions.append(own)
            texts.append(np.full(len(own), t))
    return np.concatenate(positions), np.concatenate(texts)


def _distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, the first column's lowest bit set where a row occurs twice in the chunk; each row's number among them."""
    columns = [c & ~_ONE if k == 0 else c for k, c in enumerate(columns)]
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    ranked = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in ranked], axis=0)
    heads = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    times = np.diff(np.append(heads, len(order)))
    found = [c[heads] for c in ranked]
    found[0] = found[0] | (times > 1).astype(np.uint64)
    return found, number


def _bits(batch: pa.RecordBatch, row: int, column: str, n: int) -> np.ndarray:
    """Answer bits of the chunk's distinct keys, in order. Each answer begins with its number of keys."""
    parts = [np.zeros(0, np.uint8)]
    for answer in ch.answer_of(batch, row, column):
        view = np.frombuffer(answer, np.uint8)
        parts.append(np.unpackbits(view[4:], count=int(view[:4].view("<u4")[0])))
    found = np.concatenate(parts)
    assert len(found) == n, "answers belong to other keys"
    return found.astype(bool)


def _packed(bits: np.ndarray) -> bytes:
    return np.array([len(bits)], "<u4").tobytes() + np.packbits(bits).tobytes()


def _messages(bits: int, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    for bucket, part in ch.split_by_bucket(columns[0], bits):
        yield bucket, b"".join(ch.planes(c[part]) for c in columns)


def _shared(messages: list[bytes]) -> list[bytes]:
    """Which keys occur twice, in one chunk or in two."""
    parts = [ch.from_planes(m) for m in messages]
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], (ranked[1:] ^ ranked[:-1]) > _ONE]))
    times = np.diff(np.append(heads, len(ranked)))
    twice = (times > 1) | (np.bitwise_or.reduceat(ranked, heads) & _ONE).astype(bool)
    found = np.empty(len(keys), bool)
    found[order] = np.repeat(twice, times)
    edges = np.cumsum([0, *map(len, parts)])
    return [_packed(found[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _settled(messages: list[bytes]) -> list[bytes]:
    """For each (first rank, second rank) two bits: whether it occurs twice, and whether it must show its suffixes.

    It must if its first rank has several second ranks and it is the first message with this one.
    """
    halves = [(ch.from_planes(m[: len(m) // 2]), ch.from_planes(m[len(m) // 2 :])) for m in messages]
    first, second = (np.concatenate([h[k] for h in halves]) for k in range(2))
    flag, first = first & _ONE, first & ~_ONE
    order = np.lexsort((second, first))
    f, s = first[order], second[order]
    new_rank = np.concatenate([[True], f[1:] != f[:-1]])
    new_pair = new_rank | np.concatenate([[True], s[1:] != s[:-1]])
    pair, rank = np.cumsum(new_pair) - 1, np.cumsum(new_rank) - 1
    heads = np.flatnonzero(new_pair)
    times = np.diff(np.append(heads, len(f)))
    twice = (times > 1) | np.bitwise_or.reduceat(flag[order], heads).astype(bool)
    several = np.bincount(rank[heads])[rank] > 1
    found = np.empty((len(f), 2), bool)
    found[order, 0] = twice[pair]
    found[order, 1] = several & new_pair
    edges = np.cumsum([0, *[len(h[0]) for h in halves]])
    return [_packed(found[a:b].ravel()) for a, b in zip(edges[:-1], edges[1:], strict=True)]


class _State:
    """A chunk and what is known of its suffixes after the answers it has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.sums = textblocks.running(data, lowered=False)
        self.position, self.text = _samples(data, offsets)
        self.keys, self.number = _distinct(self._hash(self.position, self.position + WINDOW))

    def _hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return textblocks.stretch_hash(self.sums, starts, ends)

    def rank(self, shared: np.ndarray) -> None:
        """With the first answers: samples of shared rank, and their ranks by all the bytes in reach."""
        keep = shared[self.number]
        self.position, self.text, first = self.position[keep], self.text[keep], self.keys[0][self.number[keep]]
        self.low = np.maximum(self.position - (PERIOD - 1), self.offsets[self.text])
        high = np.minimum(self.position + LENGTH, self.offsets[self.text + 1])
        cut = (self.position - self.low) * LENGTH + (high - self.position)
        second = textblocks.mixed_bits(self._hash(self.low, high) + cut.astype(np.uint64))
        self.last = np.minimum(self.position, high - LENGTH)
        self.keys, self.number = _distinct(first, second)

    def _marked(self, chosen: np.ndarray) -> np.ndarray:
        """The suffixes in reach of the chosen samples."""
        change = np.zeros(len(self.data) + 1, np.int32)
        chosen = chosen & (self.last >= self.low)
        np.add.at(change, self.low[chosen], 1)
        np.add.at(change, self.last[chosen] + 1, -1)
        return np.cumsum(change[:-1]) > 0

    def settle(self, bits: np.ndarray) -> None:
        """With the second answers: the suffixes known to be repeated, and those for the buckets."""
        twice, show = bits.reshape(-1, 2)[self.number].T
        self.repeated = self._marked(twice)
        self.shown = np.flatnonzero(self._marked(show))
        self.keys, self.number = _distinct(self._hash(self.shown, self.shown + LENGTH))

    def finish(self, shared: np.ndarray) -> np.ndarray:
        """With the last answers: the bytes that go."""
        self.repeated[self.shown[shared[self.number]]] = True
        starts = np.flatnonzero(self.repeated)
        change = np.zeros(len(self.data) + 1, np.int32)
        change[starts] += 1
        np.subtract.at(change, starts + LENGTH, 1)
        return np.cumsum(change[:-1]) > 0


def _state(batch: pa.RecordBatch, row: int, data: np.ndarray, offsets: np.ndarray, known: int) -> _State:
    state = _State(data, offsets)
    if known > 0:
        state.rank(_bits(batch, row, "ranks", len(state.keys[0])))
    if known > 1:
        state.settle(_bits(batch, row, "settled", 2 * len(state.keys[0])))
    return state


def _asking(bits: int, known: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (chunk, _, data, offsets) in enumerate(ch.rows_of(batch)):
                found = list(_messages(bits, _state(batch, k, data, offsets, known).keys))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([chunk] * len(found), pa.int64()), pa.array([m for _, m in found], pa.binary())], ["bucket", "chunk", "message"])

    return ch.freed(run)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, (_, doc_ids, data, offsets) in enumerate(ch.rows_of(batch)):
            state = _state(batch, k, data, offsets, 2)
            gone = state.finish(_bits(batch, k, "buckets", len(state.keys[0])))
            spans, kept = [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]])))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
                kept.append(data[a:b][~gone[a:b]].tobytes())
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, spans, kept``.

    Of every text's UTF-8 bytes, those covered by a string of ``LENGTH`` bytes that also starts anywhere else, in this text or
    another, are removed; what is left of a character cut in two stays as bytes. ``spans`` are the maximal removed runs
    (``start``, ``end`` exclusive) and ``kept`` the other bytes. Strings do not cross texts and are judged on the input.
    Null texts count as empty; shorter texts keep all. Repeated rows repeat each other's strings. Null doc_ids keep
    their rows. An empty table gives no rows. Other columns are not read.
    """
    with settings(docs.sparkSession, WIDE_ROWS):
        texts = ch.chunked(docs, text, doc_id, CHUNK_BYTES)
        bits = ch.bucket_bits(ch.text_volume(texts), BUCKET_BYTES)
        ranks = stored(ch.answered(texts.mapInArrow(_asking(bits, 0), ch.MESSAGES), _shared))
        ranked = ch.with_answers(texts, ranks, "ranks")
        settled = stored(ch.answered(ranked.mapInArrow(_asking(bits, 1), ch.MESSAGES), _settled))
        ranked = ch.with_answers(ranked, settled, "settled")
        buckets = stored(ch.answered(ranked.mapInArrow(_asking(bits, 2), ch.MESSAGES), _shared))
    return ch.with_answers(ranked, buckets, "buckets").mapInArrow(ch.freed(_cut), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def repeat_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of :func:`without_repeats`."""
    cut = without_repeats(docs, text, doc_id)
    with settings(docs.sparkSession, WIDE_ROWS):
        return stored(cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")))
