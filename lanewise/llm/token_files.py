"""Token ids as flat unsigned integer files with 64-bit document offsets, one pair of files a partition.

``<shard>.bin``: the ids of the shard's documents one after the other, little-endian unsigned 16- or 32-bit integers.
``<shard>.idx``: little-endian 64-bit integers: number of documents n, bytes an id, then n + 1 offsets in ids, n doc_ids, and n
flags (1: the doc_id is not null). Shards are in ascending doc_id order; the manifest, a Parquet table beside them, names the
files that count, so files of lost or repeated task attempts are never read. A shard's base, the number of ids before it,
is a prefix sum over the manifest.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm import textblocks
from lanewise.llm.shared import shared_folder, whole_text

MANIFEST = "shard long, file string, n_docs long, n_ids long"
#: Encoded pieces that a worker remembers, and their characters; others are encoded again each time.
PIECES, CHARACTERS = 1_000_000, 32_000_000
#: Characters that are split at once, and bytes of text whose new pieces are encoded at once.
PART, SLICE_BYTES = 1_000_000, 2_000_000
#: How byte-level vocabularies write the space.
_SPACE_BYTE = "\u0120"
_INNER_SPACE = re.compile(r" (?=\s|$)")
_SPLIT = re.compile(r" (?=\S)")


def _splits_at_spaces(path: str) -> bool:
    """Whether the tokenizer always starts a new pre-token at a space before a word, so that such pieces encode apart."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    return plain and spec["model"].get("type", "BPE") == "BPE" and not spec["model"].get("dropout")


class _Pieces(dict):
    """piece -> its number; ids of pieces one after the other, those of piece k at ``starts[k]:starts[k + 1]``.

    A piece stands for itself behind a space; one that begins with two spaces for what follows them, at a text's beginning.
    """

    def __init__(self, encode: Callable[[str], np.ndarray], opens: np.ndarray):
        super().__init__()
        self.encode, self.opens, self.fresh = encode, opens, []
        self.ids, self.starts, self.characters = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), 0

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.fresh.append(piece)
        return number

    def encode_fresh(self) -> None:
        """Pieces met since the last call, the common ones in one call of the library: each begins with a token that opens with the space."""
        if not self.fresh:
            return
        known = len(self) - len(self.fresh)
        plain = np.flatnonzero([" " not in p for p in self.fresh])
        joined = self.encode("".join([" " + self.fresh[k] for k in plain]))
        first = np.flatnonzero(self.opens[joined])
        if len(first) != len(plain) or (len(first) and first[0]):
            plain, joined, first = plain[:0], joined[:0], first[:0]
        apart = np.delete(np.arange(len(self.fresh)), plain)
        found = [self.encode(p[2:] if p.startswith("  ") else " " + p) for p in map(self.fresh.__getitem__, apart)]
        size = np.empty(len(self.fresh), np.int64)
        size[plain] = np.diff(np.append(first, len(joined)))
        size[apart] = [len(f) for f in found]
        ends = self.starts[known] + np.cumsum(size)
        while len(self.starts) <= len(self):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while len(self.ids) < ends[-1]:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        begins = ends - size
        self.ids[np.arange(len(joined)) + np.repeat(begins[plain] - first, size[plain])] = joined
        for a, ids in zip(begins[apart], found, strict=True):
            self.ids[a : a + len(ids)] = ids
        self.starts[known + 1 : len(self) + 1] = ends

    def forget(self) -> None:
        """Of the pieces met since the last call, keep all while there is room, else none."""
        size = sum(map(len, self.fresh))
        if len(self) <= PIECES and self.characters + size <= CHARACTERS:
            self.characters += size
        else:
            for piece in self.fresh:
                del self[piece]
        self.fresh = []

    def gathered(self, numbers: np.ndarray) -> np.ndarray:
        first, size = self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers]
        before = np.cumsum(size) - size
        return self.ids[np.arange(size.sum()) + np.repeat(first - before, size)]


_LOADED: dict[str, Callable[[list[str]], list[np.ndarray]]] = {}


def encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """texts -> the ids of each, equal to the library's ids of the whole text without added special tokens.

    Pieces between spaces repeat a lot, so each is encoded by the library once and its ids are gathered from then on.
    Texts with a special token's string go to the library whole.
    """
    if path in _LOADED:
        return _LOADED[path]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def encode(text: str) -> np.ndarray:
        return np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    if not _splits_at_spaces(path):
        _LOADED[path] = lambda texts: [encode(t) for t in texts]
        return _LOADED[path]
    opens = np.zeros(max(model.get_vocab().values()) + 1, bool)
    opens[[k for token, k in model.get_vocab().items() if token.startswith(_SPACE_BYTE)]] = True
    pieces, special = _Pieces(encode, opens), [t.content for t in model.get_added_tokens_decoder().values()]

    def by_pieces(texts: list[str]) -> list[np.ndarray]:
        numbers: list[list[np.ndarray]] = []
        for text in texts:
            own: list[np.ndarray] = []
            if text and not any(s in text for s in special):
                for k, part in enumerate(_parts(text)):
                    split = _SPLIT.split(part) if _INNER_SPACE.search(part) else part.split(" ")
                    if k == 0:
                        split[0] = "  " + split[0]
                    own.append(np.fromiter(map(pieces.__getitem__, split), np.int64, len(split)))
            numbers.append(own)
        pieces.encode_fresh()
        found = [pieces.gathered(np.concatenate(own)) if own else encode(text) for own, text in zip(numbers, texts, strict=True)]
        pieces.forget()
        return found

    _LOADED[path] = by_pieces
    return by_pieces


def _parts(text: str) -> Iterator[str]:
    """A long text in parts, each but the first without the space that it begins with."""
    at = 0
    while len(text) - at > PART and (cut := _SPLIT.search(text, at + PART)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def id_kind(path: str, end_id: int) -> str:
    """The smallest unsigned type that holds every id."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def _write(folder: str, tokenizer: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], kind).tobytes()
        store, root = pafs.FileSystem.from_uri(folder)
        shard, stream = TaskContext.get().partitionId(), None
        name = f"{shard:06d}-{uuid.uuid4().hex[:12]}"
        lengths, ids, given = [], [], []
        for batch in batches:
            if stream is None and batch.num_rows:
                store.create_dir(root, recursive=True)
                stream = store.open_output_stream(f"{root}/{name}.bin")
            for part in textblocks.slices(batch.column("body"), SLICE_BYTES):
                for coded in encode(part.to_pylist()):
                    stream.write(coded.astype(kind).tobytes() + end)
                    lengths.append(len(coded) + 1)
            ids += [d or 0 for d in batch.column("doc_id").to_pylist()]
            given += batch.column("doc_id").is_valid().to_pylist()
        if stream is None:
            return
        stream.close()
        head = np.array([len(ids), int(kind[-1])], "<i8")
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
        with store.open_output_stream(f"{root}/{name}.idx") as index:
            for part in (head, offsets, np.array(ids, "<i8"), np.array(given, "<i8")):
                index.write(part.tobytes())
        row = [[shard], [name], [len(ids)], [int(offsets[-1])]]
        yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1]), pa.array(row[2], pa.int64()), pa.array(row[3], pa.int64())], ["shard", "file", "n_docs", "n_ids"])

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, text: str = "text", doc_id: str = "doc_id") -> str:
    """Encode every whole text, end each document with ``end_id``, write the shards and the manifest; the folder.

    Null texts count as empty: their document is the end id alone. Null doc_ids come first. Rows that share a doc_id are
    in the order of their texts' hash, then of their texts. An empty table gives an empty manifest. Other columns are not read.
    The folder must be one that Arrow's file systems reach (local, hdfs, s3, gs).
    """
    folder = folder or shared_folder(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("body")).withColumn("turn", F.xxhash64("body"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("turn"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "turn", "body").select("doc_id", "body")
    shards = ordered.mapInArrow(_write(f"{folder}/files", tokenizer, end_id, id_kind(tokenizer, end_id)), MANIFEST)
    shards.write.mode("overwrite").parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``shard, file, n_docs, n_ids, base``: one row a shard, so the running sum meets in one small window."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    table = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return table.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def open_shard(folder: str, name: str):
    """``(doc_ids with None, offsets, ids)`` of a shard; ids are memory-mapped where the store is a local or mounted disk."""
    store, root = pafs.FileSystem.from_uri(f"{folder}/files")
    with store.open_input_stream(f"{root}/{name}.idx") as file:
        index = np.frombuffer(file.read(), "<i8")
    n, kind = int(index[0]), f"<u{index[1]}"
    offsets, doc_ids, given = index[2 : n + 3], index[n + 3 : 2 * n + 3], index[2 * n + 3 :]
    if isinstance(store, pafs.LocalFileSystem):
        ids = np.memmap(f"{root}/{name}.bin", kind, "r")
    else:
        with store.open_input_file(f"{root}/{name}.bin") as file:
            ids = np.frombuffer(file.read(), kind)
    return [int(d) if g else None for d, g in zip(doc_ids, given, strict=True)], offsets, ids


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """What the files hold, a row a document: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                doc_ids, offsets, ids = open_shard(folder, name)
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(offsets[:-1] + base, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = manifest(spark, folder)
    # A task a shard: the rows are few and small, so sizes say nothing about the work.
    dealt = shards.repartitionByRange(max(1, shards.count()), "shard").select("file", "base")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write and read back; nulls, ties and empty tables as in :func:`write_token_files`."""
    return read_token_files(docs.sparkSession, write_token_files(docs, tokenizer, end_id, folder, text, doc_id))
