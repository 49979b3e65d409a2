"""Texts in chunks of some megabytes, and questions about keys that occur in many chunks.

A chunk's task works on whole arrays. What it must know about all other chunks it asks by key: it deals its keys over buckets by
their leading bits, one packed message a bucket; the bucket's task sees all keys of its range and answers each message;
answers meet their chunk's text again. A bucket has a bounded share of the distinct keys, and a key costs one entry a chunk
however often it occurs there, so a hot key cannot overload a bucket.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm import textblocks
from lanewise.llm.shared import stored, whole_text

CHUNKS = "chunk long, doc_ids array<long>, ends array<long>, body binary"
MESSAGES = "bucket int, chunk long, message binary"
#: Chunks that a worker gets at once, where the step is stored.
BATCH = 4
ANSWERS = "bucket int, chunk long, answer binary"


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Give what was freed inside back to the machine at the end: workers live on after a task, and the allocator keeps freed arrays."""
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, whose worker gives its memory back afterwards."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            yield from run(batches)

    return whole


def text_version(text: Column) -> Column:
    """Tells texts under one doc_id apart."""
    return F.xxhash64(text)


def chunked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = 2_000_000, versions: bool = False) -> DataFrame:
    """Chunks of about ``most`` bytes, written to the shared folder; a longer text is a chunk of its own. Null texts are empty.

    The doc_id is cast to long. ``versions``: one more column, each text's :func:`text_version`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            at = 0
            for part in textblocks.slices(batch.column("body"), most):
                data, offsets = textblocks.text_bytes(part)
                ids = batch.column("doc_id").slice(at, len(part)).to_pylist()
                columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([offsets[1:]], pa.list_(pa.int64())), pa.array([data.tobytes()], pa.binary())]
                if versions:
                    columns.append(pa.array([batch.column("version").slice(at, len(part)).to_pylist()], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(part)
                number += 1

    names = ["chunk", "doc_ids", "ends", "body", *(["versions"] if versions else [])]
    version = [text_version(whole_text(text)).alias("version")] if versions else []
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("body"), *version)
    return stored(rows.mapInArrow(run, CHUNKS + (", versions array<long>" if versions else "")))


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, list[int | None], np.ndarray, np.ndarray]]:
    """``chunk, doc_ids, data, offsets`` of every chunk in a batch."""
    for k in range(batch.num_rows):
        ends = np.array(batch.column("ends")[k].values, np.int64)
        data = np.frombuffer(batch.column("body")[k].as_buffer() or b"", np.uint8)
        yield batch.column("chunk")[k].as_py(), batch.column("doc_ids")[k].as_py(), data, np.concatenate([[0], ends])


def bucket_bits(total_bytes: int, each: int) -> int:
    """Leading bits that deal the keys of ``total_bytes`` of text to buckets for about ``each`` bytes of it; 6 at least."""
    return max(6, math.ceil(math.log2(max(1, total_bytes / each))))


def text_volume(chunks: DataFrame) -> int:
    return chunks.agg(F.sum(F.octet_length("body"))).first()[0] or 0


def asked(chunks: DataFrame, ask: Callable[[int, list, np.ndarray, np.ndarray], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """``ask(chunk, doc_ids, data, offsets)`` gives ``(bucket, message)`` pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            for row in (r for batch in batches for r in rows_of(batch)):
                found = list(ask(*row))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([row[0]] * len(found), pa.int64()), pa.array([m for _, m in found], pa.binary())], ["bucket", "chunk", "message"])

    return chunks.mapInArrow(run, MESSAGES)


def split_by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """For sorted keys, each bucket that has some and where they are."""
    edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = np.append(edges, len(keys))
    for bucket in np.flatnonzero(np.diff(edges)):
        yield int(bucket), slice(int(edges[bucket]), int(edges[bucket + 1]))


def answered(messages: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """All messages of a bucket meet in one call of ``answer``, which gives one answer for each."""

    def run(table: pa.Table) -> pa.Table:
        with released():
            table = table.sort_by("chunk").combine_chunks()
            found = answer([m.as_buffer() for m in table.column("message")])
        return pa.table([table.column("bucket"), table.column("chunk"), pa.array(found, pa.binary())], names=["bucket", "chunk", "answer"])

    return messages.groupBy("bucket").applyInArrow(run, ANSWERS)


def with_answers(chunks: DataFrame, answers: DataFrame, column: str = "answers") -> DataFrame:
    """Chunks with their answers, an array of ``(bucket, answer)`` in bucket order: as many as a chunk asked, of its own size."""
    own = answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "answer"))).alias(column))
    return chunks.join(own, "chunk", "left")


def answer_of(batch: pa.RecordBatch, row: int, column: str = "answers") -> list[bytes]:
    """The answers of one chunk, in bucket order."""
    found = batch.column(column)[row]
    return [x["answer"].as_buffer() for x in found.values] if found.is_valid else []


def planes(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys byte by byte, highest first: leading bytes repeat and compress."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    view = np.frombuffer(data, np.uint8)
    return np.ascontiguousarray(view.reshape(8, len(view) // 8).T).view(">u8").ravel().astype(np.uint64)
