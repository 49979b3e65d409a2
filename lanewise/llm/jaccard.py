"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections of sorted arrays.

1. Every distinct shingle of every text is counted over all texts. A text with too few shingles that occur elsewhere has no
   partner and is done.
2. Equal sets become one class. Of each class, the prefix that any partner must share a shingle with, in order from rare to common,
   puts it into tiles: one for each prefix shingle and size band, as partners are in the same band or the next. Tiles with the
   same least member, their pivot, are one tile.
3. Every set is held against the pivot of most of its tiles first, then against its nearest other by signature. Only pairs of a tile whose components still differ are looked at then: bit counts of two signatures bound
   the overlap from above, and what the bound leaves is intersected exactly.

Links inside one component need not be found, so a tile of near copies costs its size, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm import chunks as ch
from lanewise.llm import textblocks
from lanewise.llm.components import joined
from lanewise.llm.shared import WIDE_ROWS, settings, stored, unused, whole_text

WORDS = 5
#: Least similarity in hundredths.
PERCENT = 75
CHUNK_BYTES = 1_000_000
BUCKET_BYTES = 8_000_000
#: Members that one task compares at once, and bytes of their signatures; larger tiles are dealt over a grid of slices.
SLICE, SLICE_BYTES = 1024, 1_000_000
_ROW_BITS = 16
_LOW = np.uint64((1 << _ROW_BITS) - 1)


def shingle_keys(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct keys: 48 bits of the shingle's hash, then 16 bits of the text's number in the chunk.

    Two different shingles share 48 bits once in 2.8e14 pairs.
    """
    hashes, first = textblocks.word_hashes(data, offsets)
    n = len(hashes)
    odd = [pow(0x9E3779B97F4A7C15, k + 2, 1 << 64) | 1 for k in range(words)]
    sums = np.zeros(max(0, n - words + 1), np.uint64)
    for k, factor in enumerate(odd):
        sums += hashes[k : len(sums) + k] * np.uint64(factor)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = text[: len(sums)] == text[words - 1 :] if len(sums) else np.zeros(0, bool)
    keys = [(textblocks.mixed_bits(sums[whole]) & ~_LOW) | text[: len(sums)][whole].astype(np.uint64)]
    counts = np.diff(first)
    for k in np.flatnonzero((counts > 0) & (counts < words)):
        short = hashes[first[k] : first[k + 1]] * np.array(odd[: counts[k]], np.uint64)
        keys.append((textblocks.mixed_bits(short.sum(keepdims=True) + np.uint64(counts[k])) & ~_LOW) | np.uint64(k))
    keys = np.sort(np.concatenate(keys))
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _ask(bits: int):
    def ask(chunk: int, doc_ids: list, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, bytes]]:
        keys = shingle_keys(data, offsets)
        for bucket, part in ch.split_by_bucket(keys, bits):
            yield bucket, ch.planes(keys[part])

    return ask


def _repeated(messages: list[bytes]) -> list[bytes]:
    """Of every message the keys whose shingle occurs in another text too, and the binary logarithm of in how many."""
    parts = [ch.from_planes(m) for m in messages]
    shingles = np.concatenate(parts) >> np.uint64(_ROW_BITS)
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    times = np.diff(np.append(heads, len(ranked)))
    found = np.empty(len(ranked), np.uint8)
    found[order] = np.repeat(np.minimum(255, np.log2(times) * 8).astype(np.uint8), times)
    edges, answers = np.cumsum([0, *map(len, parts)]), []
    for keys, a, b in zip(parts, edges[:-1], edges[1:], strict=True):
        more = found[a:b] > 0
        answers.append(ch.planes(keys[more]) + found[a:b][more].tobytes())
    return answers


def _needed(n: np.ndarray) -> np.ndarray:
    """Least overlap of a set of n with any partner."""
    return -(-PERCENT * n // 100)


def signature_bits(n: int) -> int:
    """A power of two of at least eight times the set's size, so that few elements share a bit."""
    return max(64, 1 << int(8 * n - 1).bit_length())


def signature(hashes: np.ndarray, n: int) -> bytes:
    """A bit for each hash value class: whether an odd number of the set's hashes fall in it."""
    bits = signature_bits(n)
    return np.packbits((np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(signatures: list, size: int) -> np.ndarray:
    """Signatures as rows of 64-bit words, longer ones folded to ``size`` bytes; parity makes folding exact."""
    rows = np.empty((len(signatures), size), np.uint8)
    for k, s in enumerate(signatures):
        view = np.frombuffer(s, np.uint8)
        rows[k] = np.bitwise_xor.reduce(view.reshape(-1, size), axis=0)
    return rows.view(np.uint64)


#: ``m``: how many of the n shingles occur in another text too; only these are in hashes and signature.
SETS = "row long, n long, m long, d1 long, d2 long, hashes binary, prefix array<long>, signature binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every text that may have a partner: its set and its prefix. Shingles that occur nowhere else are counted, not kept."""
    for batch in batches:
        for k in range(batch.num_rows):
            chunk, sizes = batch.column("chunk")[k].as_py(), np.array(batch.column("sizes")[k].values, np.int64)
            keys, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
            for answer in ch.answer_of(batch, k):
                n = len(answer) // 9
                keys.append(ch.from_planes(answer[: 8 * n]))
                times.append(np.frombuffer(answer[8 * n :], np.uint8))
            keys, times = np.concatenate(keys), np.concatenate(times)
            text = (keys & _LOW).astype(np.int64)
            order = np.argsort(text, kind="stable")  # by shingle within the text
            keys, times = (keys >> np.uint64(_ROW_BITS))[order], times[order]
            first = np.searchsorted(text[order], np.arange(len(sizes) + 1))
            rows = []
            for t in np.flatnonzero((np.diff(first) >= _needed(sizes)) & (sizes > 0)):
                own, often, n = keys[first[t] : first[t + 1]], times[first[t] : first[t + 1]], int(sizes[t])
                alone = n - len(own)
                prefix = own[np.lexsort((own, often))[: max(0, n - int(_needed(sizes[t])) + 1 - alone)]]
                row = (chunk << _ROW_BITS) + int(t)
                marks = textblocks.mixed_bits(own)
                # A set with a shingle of its own equals no other.
                digest = (np.array([marks.sum(), (marks * marks).sum()], np.uint64) if not alone else np.array([row, alone], np.uint64)).view(np.int64)
                rows.append((row, n, len(own), int(digest[0]), int(digest[1]), ch.planes(own), prefix.astype(np.int64), signature(own, len(own))))
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.binary(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["row", "n", "m", "d1", "d2", "hashes", "prefix", "signature"])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, (chunk, doc_ids, data, offsets) in enumerate(ch.rows_of(batch)):
            sizes = np.bincount((shingle_keys(data, offsets) & _LOW).astype(np.int64), minlength=len(doc_ids))
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), batch.column("versions").slice(k, 1), pa.array([sizes], pa.list_(pa.int64()))], ["chunk", "doc_ids", "versions", "sizes"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose exact similarity suffices. Pairs that the bit counts rule out are not intersected."""
    for batch in batches:
        yes = []
        for k in range(batch.num_rows):
            n_a, n_b, m_a, m_b = (batch.column(c)[k].as_py() for c in ("n_a", "n_b", "m_a", "m_b"))
            signs = [np.frombuffer(batch.column(c)[k].as_buffer(), np.uint8) for c in ("signature_a", "signature_b")]
            size = min(map(len, signs))
            shared = 0
            if _may_link(n_a, n_b, m_a, m_b, int(np.bitwise_count(_folded(signs[:1], size) ^ _folded(signs[1:], size)).sum())):
                shared = len(np.intersect1d(*(ch.from_planes(batch.column(c)[k].as_buffer()) for c in ("hashes_a", "hashes_b")), assume_unique=True))
            yes.append(100 * shared >= PERCENT * (n_a + n_b - shared))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(yes, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])


def _may_link(n_a, n_b, m_a, m_b, apart):
    """Bits that differ are elements of one set only, so the overlap is at most (m_a + m_b - apart) / 2: shingles of one text alone are in none."""
    most = np.minimum((m_a + m_b - apart) // 2, np.minimum(m_a, m_b))
    return 100 * most >= PERCENT * (n_a + n_b - most)


def _tile_pairs(nearest: bool):
    """From each tile (or part of one), pairs of different components that the bit counts do not rule out.

    ``nearest``: of each member only the pair with the fewest bits apart. ``apart`` is their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, across = batch.column("members"), batch.column("across").to_pylist()
            edges = lists.offsets.to_numpy()
            fields = {c: lists.values.field(c) for c in ("row", "n", "m", "component", "major", "signature")}
            row, n, m, component = (fields[c].to_numpy() for c in ("row", "n", "m", "component"))
            major = fields["major"].to_numpy(zero_copy_only=False)
            bits, ends = textblocks.text_bytes(fields["signature"])
            found_a, found_b, found_bits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                own = a + np.lexsort((row[a:b], n[a:b]))
                signs = _folded([bits[ends[j] : ends[j + 1]] for j in own], int(np.diff(ends[a : b + 1]).min()))
                sizes, shared = n[own], m[own]
                lasts = np.searchsorted(sizes, sizes * 100 // PERCENT, "right")
                for i in range(len(own) - 1):
                    others = np.arange(i + 1, max(i + 1, lasts[i]))
                    others = others[component[own[others]] != component[own[i]]]
                    if across[k]:
                        others = others[major[own[others]] != major[own[i]]]
                    if len(others):
                        apart = np.bitwise_count(signs[others] ^ signs[i]).sum(1).astype(np.int64)
                        may = np.flatnonzero(_may_link(sizes[i], sizes[others], shared[i], shared[others], apart))
                        if nearest and len(may):
                            may = may[[np.argmin(apart[may])]]
                        found_a.append(np.full(len(may), row[own[i]]))
                        found_b.append(row[own[others[may]]])
                        found_bits.append(apart[may])
            columns = [pa.array(np.concatenate(f), pa.int64()) for f in (found_a, found_b, found_bits)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "apart"])

    return run


def _exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    for side in "ab":
        own = sets.select(F.col("row").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "m", "signature", "hashes")])
        pairs = pairs.join(own, side)
    return stored(pairs.mapInArrow(ch.freed(_linked), "a long, b long"), batch_rows=500)


def _undecided(tiles: DataFrame, sets: DataFrame, found: DataFrame, nearest: bool) -> DataFrame:
    """Pairs of a tile whose components differ and whose signatures allow a link: all, or one of each member, the nearest over its tiles.

    A tile's largest component is dealt over slices, and its other members over slices of their own; parts of the tile pair
    a slice of the one with a slice of the other, or two slices of the others. No part has over two slices.
    """
    # A member's share of a slice.
    share = F.greatest(F.lit(1 / SLICE), F.octet_length("signature") / SLICE_BYTES)
    placed = tiles.join(found.withColumnRenamed("node", "row"), "row").join(sets.select("row", share.alias("share")), "row")
    counts = placed.groupBy("pivot", "component").agg(F.sum("share").alias("own"))
    shape = counts.groupBy("pivot").agg(F.max(F.struct("own", "component")).alias("top"), F.sum("own").alias("all"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    shape = shape.select("pivot", F.col("top.component").alias("largest"), F.ceil("top.own").cast("int").alias("s"), F.greatest(F.ceil(F.col("all") - F.col("top.own")), F.lit(1)).cast("int").alias("q"))
    dealt = placed.join(shape, "pivot").withColumn("major", F.col("component") == F.col("largest"))
    mine = F.pmod(F.xxhash64("row"), F.when(F.col("major"), F.col("s")).otherwise(F.col("q"))).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    mixed = F.when(F.col("major"), F.transform(upto("q"), lambda q: F.struct(F.lit(True).alias("across"), F.col("mine").alias("i"), q.alias("j"))))
    mixed = mixed.otherwise(F.concat(F.transform(upto("s"), lambda s: F.struct(F.lit(True).alias("across"), s.alias("i"), F.col("mine").alias("j"))), F.transform(upto("q"), lambda q: F.struct(F.lit(False).alias("across"), F.least(q, F.col("mine")).alias("i"), F.greatest(q, F.col("mine")).alias("j")))))
    parts = dealt.withColumn("mine", mine).withColumn("part", F.explode(mixed)).select("pivot", "part.*", "row", "component", "major")
    parts = parts.join(sets.select("row", "n", "m", "signature"), "row")
    groups = parts.groupBy("pivot", "across", "i", "j").agg(F.collect_list(F.struct("row", "n", "m", "component", "major", "signature")).alias("members"))
    pairs = groups.filter(F.size("members") > 1).select("members", "across").mapInArrow(ch.freed(_tile_pairs(nearest)), "a long, b long, apart long")
    if nearest:
        pairs = pairs.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best")).select("a", "best.b")
    else:
        pairs = pairs.select("a", "b").distinct()
    return stored(pairs, batch_rows=16)


class _Sets:
    """What both the groups and the links are made from: texts, their classes of equal sets, one set of each class, and tiles."""

    def __init__(self, docs: DataFrame, text: str, doc_id: str) -> None:
        texts = ch.chunked(docs, text, doc_id, CHUNK_BYTES, versions=True)
        bits = ch.bucket_bits(ch.text_volume(texts), BUCKET_BYTES)
        info = stored(texts.mapInArrow(ch.freed(_sizes), "chunk long, doc_ids array<long>, versions array<long>, sizes array<long>"), batch_rows=ch.BATCH)
        answers = ch.answered(ch.asked(texts, _ask(bits)), _repeated)
        sets = stored(ch.with_answers(info, answers).mapInArrow(ch.freed(_sets), SETS), batch_rows=ch.BATCH)
        members = sets.select("row", "n", "d1", "d2")
        classes = members.groupBy("n", "d1", "d2").agg(F.min("row").alias("class"))
        self.members = stored(members.join(classes, ["n", "d1", "d2"]).select("row", "class"))
        sets = sets.join(self.members.filter("row = class").select("row"), "row", "left_semi")
        self.sets = stored(sets.select("row", "n", "m", "hashes", "prefix", "signature"))
        at = info.select("chunk", F.posexplode(F.arrays_zip("doc_ids", "versions", "sizes")).alias("at", "x"))
        self.rows = at.select((F.shiftleft("chunk", _ROW_BITS) + F.col("at")).alias("row"), F.col("x.doc_ids").alias("doc_id"), F.col("x.versions").alias("version"), F.col("x.sizes").alias("n_shingles"))
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT))).cast("int")
        tokens = self.sets.select("row", band.alias("band"), F.explode("prefix").alias("token"))
        banded = tokens.select("row", "token", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("tile"))
        shared = banded.groupBy("token", "tile").agg(F.min("row").alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1")
        self.tiles = stored(banded.join(shared, ["token", "tile"]).groupBy("row", "pivot").agg(F.count(F.lit(1)).alias("times")))
        self.alone = self.sets.select(F.col("row").alias("node"), F.col("row").alias("component"))


def _grouped(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``row, doc_id, version, n_shingles, component`` of every row."""
    with settings(docs.sparkSession, WIDE_ROWS):
        return _with_components(_Sets(docs, text, doc_id))


def _with_components(own: _Sets) -> DataFrame:
    sets, tiles = own.sets, own.tiles
    first = tiles.filter("row > pivot").groupBy("row").agg(F.max(F.struct("times", "pivot")).alias("top"))
    found = joined(own.alone, _exact(first.select(F.col("row").alias("a"), F.col("top.pivot").alias("b")), sets))
    for nearest in (True, False):
        pairs = _undecided(tiles.select("row", "pivot"), sets, found, nearest)
        if pairs.isEmpty():
            break
        found = joined(found, _exact(pairs, sets))
    grouped = own.members.join(found.withColumnRenamed("node", "class"), "class").select("row", "component")
    return stored(own.rows.join(grouped, "row", "left").withColumn("component", F.coalesce("component", "row")))


def jaccard_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    A text's set is that of its distinct shingles of ``WORDS`` words (A-Z lowered), of all its words if it has fewer. Two
    texts link when ``100 * intersection >= PERCENT * union``; empty sets link with nothing. ``component_id`` is the least
    doc_id reachable by links, itself included. Null texts are empty. Null doc_ids are rows of their own that are no
    component's least id (a component of nulls only has null). Repeated rows link. Empty: no rows. Other columns are not read.
    """
    grouped = _grouped(docs, text, doc_id)
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(least, "component").select("doc_id", "n_shingles", "component_id")


def jaccard_links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The join itself, all its links: ``class_a, class_b`` (a > b) for every two classes that link, and ``class, doc_id, n_shingles`` for every row.

    A class is all rows of one non-empty set; its rows link with each other and with all rows of the classes it links with. Rows whose
    class is null link with nothing. Nulls, repeated rows and empty tables as in :func:`jaccard_groups`. Links are as many as they are, so a
    group of near copies of N different texts may have N * N / 2.
    """
    with settings(docs.sparkSession, WIDE_ROWS):
        own = _Sets(docs, text, doc_id)
        pairs = _undecided(own.tiles.select("row", "pivot"), own.sets, own.alone, nearest=False)
        links = _exact(pairs, own.sets)
    links = links.select(F.greatest("a", "b").alias("class_a"), F.least("a", "b").alias("class_b"))
    return links, own.rows.join(own.members, "row", "left").select("class", "doc_id", "n_shingles")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Of every group of :func:`jaccard_groups` the row with the least doc_id, with all its columns; a null doc_id after all others.

    Rows are told apart by doc_id and text: of different texts of a group under the least doc_id one stays, and a text that shares its doc_id
    with a dropped one is not dropped with it. Repeated rows, equal in doc_id and text, stay or go together.
    """
    # In a pipeline these tables lie beside those of the other stages, so they are packed more tightly.
    with settings(docs.sparkSession, {"spark.sql.parquet.compression.codec": "zstd"}):
        grouped = _grouped(docs, text, doc_id)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "version")
    kept = grouped.groupBy("component").agg(F.min(order).alias("k")).select("k.doc_id", "k.version").distinct()
    kept_id, kept_version, version = (unused(docs, c) for c in ("kept_id", "kept_version", "version"))
    kept = kept.toDF(kept_id, kept_version)
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(version) == F.col(kept_version))
    return docs.withColumn(version, ch.text_version(whole_text(text))).join(kept, same, "left_semi").drop(version)


SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, k, k + 4), ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM worded WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT b, root FROM reached JOIN edges ON node = a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM (SELECT node AS doc_id, min(root) AS component_id FROM reached GROUP BY node) LEFT JOIN sizes USING (doc_id)
"""
