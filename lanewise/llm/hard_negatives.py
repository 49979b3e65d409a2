"""Hard negatives by angular triangle filtering.

Each vector's angles to a few reference directions are stored. Two vectors are at least as far apart as the difference of their angles to
any reference and at most as far as the sum, so every reference gives an interval of their cosine; times both norms, rounded outwards,
that bounds their score. Vectors are packed in blocks of near ones. A pair of blocks is looked at if its bounds reach the scores wanted, and of such a
pair only the vectors whose own bounds do are multiplied, as integers.

1. Positives: a score is wanted from the 5th best of a sample, then from the 5th best of the block so far.
2. Negatives: scores within 80 to 100 % of a positive's are wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.shared import stored

SCALE = 256
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
REFERENCES = 16
#: Rows that references and first thresholds are taken from, at most, and bytes of them. Results do not depend on them.
SAMPLE, SAMPLE_BYTES = 4096, 8_000_000
#: Rows and anchors in a block, at most, and bytes of its vectors.
BLOCK_ROWS, BLOCK_ANCHORS, BLOCK_BYTES = 65_536, 16_384, 64_000_000
#: Rows and anchors that are compared at once.
_ROWS, _ANCHORS = 1024, 32
#: How far stored angles and cosines may be off.
_ANGLE_OFF, _COSINE_OFF = 4e-6, 1e-7
#: Pairs of block summaries are made in so many parts.
_SHARDS = 64

INDEX = "row long, id long, label long, q array<int>, norm double, angles array<float>, near int, angle float"
BLOCK = "block long, rows array<long>, ids array<long>, labels array<long>, q binary, norms array<double>, angles binary, low array<float>, high array<float>, norm_low double, norm_high double"


def usable(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``row, id, label, q``: rows that take part, a number for each, relabelled, with floored components."""
    v, identity = F.col(vector), F.col(vec_id).cast("long")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    size = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(F.floor(SCALE * x.cast("double")).cast("double"), F.lit(2.0)))
    own = F.col(label).cast("long")
    own = F.when(F.coalesce(identity % RELABEL_EVERY == 0, F.lit(False)), (own + 1) % LABELS).otherwise(own)
    kept = embeddings.filter(own.isNotNull() & v.isNotNull() & finite).filter(size < F.lit(2.0**62))
    return kept.select(F.monotonically_increasing_id().alias("row"), identity.alias("id"), own.alias("label"), F.transform(v, lambda x: F.floor(SCALE * x.cast("double")).cast("int")).alias("q"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of numbers as rows of ``dim`` components; missing ones are 0."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return values.reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _norms(q: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", q, q))


def references(q: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors that are spread like the sample: its farthest members first, then the means of what is nearest to each."""
    norms = _norms(q)
    units = q[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.zeros((0, q.shape[1]))
    picked = [int(np.argmax(units @ units.mean(0)))]
    nearest = units @ units[picked[0]]
    while len(picked) < min(count, len(units)):
        picked.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, units @ units[picked[-1]])
    centres = units[picked]
    for _ in range(4):
        own = np.argmax(units @ centres.T, axis=1)
        sums = np.stack([units[own == k].sum(0) for k in range(len(centres))])
        length = _norms(sums)
        centres = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], centres)
    return centres


def _indexed(centres: np.ndarray, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("q"), dim)
            norms = _norms(q)
            angles = np.arccos(np.clip(q @ centres.T / np.maximum(norms, 1e-300)[:, None], -1, 1)).astype(np.float32)
            if not angles.shape[1]:
                angles = np.zeros((len(q), 1), np.float32)
            near = np.argmin(angles, axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * angles.shape[1], pa.int32()), pa.array(angles.ravel()))
            found = [pa.array(norms), lists, pa.array(near, pa.int32()), pa.array(angles[np.arange(len(q)), near])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, "norm", "angles", "near", "angle"])

    return run


def _packed(dim: int, most: int):
    """Rows of a partition in blocks of up to ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting = TaskContext.get().partitionId() << 32, []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            angles = np.stack(table.column("angles").to_numpy())
            norms = table.column("norm").to_numpy()
            lists = [pa.array([table.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("row", "id", "label")]
            q = _matrix(table.column("q").combine_chunks(), dim).astype(np.int32)
            binary = [pa.array([x.tobytes()], pa.binary()) for x in (q, angles.astype(np.float32))]
            ends = [pa.array([x], pa.list_(pa.float32())) for x in (angles.min(0), angles.max(0))]
            columns = [pa.array([number], pa.int64()), *lists, binary[0], pa.array([norms], pa.list_(pa.float64())), binary[1], *ends, pa.array([norms.min()]), pa.array([norms.max()])]
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in BLOCK.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if waiting and sum(b.num_rows for b in waiting) + part.num_rows > most:
                    yield block()
                    number, waiting = number + 1, []
                waiting.append(part)
        if waiting:
            yield block()

    return run


def apart(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest angle between every row of ``a`` and every row of ``b``, from their angles to each reference."""
    least, most = np.zeros((len(a), len(b)), np.float32), np.full((len(a), len(b)), np.pi, np.float32)
    for k in range(a.shape[1]):
        x, y = a[:, k, None], b[None, :, k]
        np.maximum(least, np.abs(x - y), out=least)
        total = x + y
        np.minimum(most, np.minimum(total, np.float32(2 * np.pi) - total), out=most)
    return least, most


def score_bounds(least: np.ndarray, most: np.ndarray, norms_low: np.ndarray, norms_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the score of vectors so far apart whose norms' product is within the given bounds, rounded outwards."""
    low = np.cos(np.minimum(most.astype(np.float64) + _ANGLE_OFF, np.pi)) - _COSINE_OFF
    high = np.cos(np.maximum(least.astype(np.float64) - _ANGLE_OFF, 0)) + _COSINE_OFF
    return np.where(low >= 0, norms_low, norms_high) * low - 1, np.where(high >= 0, norms_high, norms_low) * high + 1


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks whose scores may be wanted: between the angles' and norms' ends of both, the least and largest possible score."""
    for batch in batches:
        keep = []
        for r in batch.to_pylist():
            low_a, high_a, low_b, high_b = (np.array(r[c]) for c in ("low_a", "high_a", "low", "high"))
            least = np.max(np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0))
            first, last = low_a + low_b, high_a + high_b
            most = np.min(np.where((first <= np.pi) & (last >= np.pi), np.pi, np.minimum(np.where(last < np.pi, last, np.pi), np.where(first > np.pi, 2 * np.pi - first, np.pi))))
            low, high = score_bounds(np.array(least), np.array(most), np.array(r["norm_low_a"] * r["norm_low"] * (1 - 1e-9)), np.array(r["norm_high_a"] * r["norm_high"] * (1 + 1e-9)))
            keep.append(bool(high >= r["from_a"] and low <= r["to_a"]))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("block", "block_a")], ["block", "block_a"])


class _Side:
    """A block as arrays."""

    def __init__(self, row: dict, end: str, dim: int) -> None:
        self.rows, self.labels = (np.array(row[f"{c}{end}"], np.int64) for c in ("rows", "labels"))
        ids = row[f"ids{end}"]
        self.unknown = np.array([i is None for i in ids], bool)
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        self.norms = np.array(row[f"norms{end}"])
        self.q = np.frombuffer(row[f"q{end}"], np.int32).reshape(-1, dim)
        self.angles = np.frombuffer(row[f"angles{end}"], np.float32).reshape(len(self.rows), -1)


def products(a: np.ndarray, b: np.ndarray, norm_a: float, norm_b: float) -> np.ndarray:
    """Exact inner products of integer vectors; as doubles where no sum on the way can reach 2**53."""
    if norm_a * norm_b < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _candidates(rows: _Side, anchors: _Side, a: slice, b: slice, lowest: np.ndarray, highest: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of anchors ``a`` and rows ``b`` (columns that no bound leaves are gone), which of them count, and the rows' numbers."""
    low, high = score_bounds(*apart(anchors.angles[a], rows.angles[b]), *[anchors.norms[a, None] * rows.norms[None, b]] * 2)
    may = (high >= lowest[:, None]) & (low <= highest[:, None]) & ((anchors.labels[a, None] == rows.labels[None, b]) == same)
    if same:
        may &= anchors.rows[a, None] != rows.rows[None, b]
    columns = np.flatnonzero(may.any(0))
    scores = products(anchors.q[a], rows.q[b][columns], anchors.norms[a].max(), rows.norms[b][columns].max(initial=0))
    return scores, may[:, columns], columns + b.start


def _best(scores: np.ndarray, at: np.ndarray, rows: _Side, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` first by score, then id, unknown ids last."""
    if len(scores) > most:
        enough = scores >= np.partition(scores, len(scores) - most)[len(scores) - most]
        scores, at = scores[enough], at[enough]
    order = np.lexsort((rows.ids[at], rows.unknown[at], -scores))[:most]
    return scores[order], at[order]


def _steps(size: int, step: int) -> Iterator[slice]:
    return (slice(k, min(size, k + step)) for k in range(0, size, step))


def _positives(dim: int):
    """Of every anchor of a pair of blocks the best rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for r in batch.to_pylist():
                rows, anchors = _Side(r, "", dim), _Side(r, "_a", dim)
                lowest = np.array(r["from_each_a"])
                for a in _steps(len(anchors.rows), _ANCHORS):
                    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * (a.stop - a.start)
                    for b in _steps(len(rows.rows), _ROWS):
                        scores, may, at = _candidates(rows, anchors, a, b, lowest[a], np.full(a.stop - a.start, np.inf), True)
                        for k in np.flatnonzero(may.any(1)):
                            own = may[k] & (scores[k] >= lowest[a][k])
                            held[k] = _best(np.append(held[k][0], scores[k][own]), np.append(held[k][1], at[own]), rows, POSITIVES)
                            if len(held[k][0]) == POSITIVES:
                                lowest[a.start + k] = max(lowest[a.start + k], held[k][0][-1])
                    for k, (score, at) in enumerate(held):
                        out[0] += [int(anchors.rows[a][k])] * len(at)
                        out[1] += [None if rows.unknown[j] else int(rows.ids[j]) for j in at]
                        out[2] += score.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["anchor", "id", "score"])

    return run


def _negatives(dim: int):
    """Of every positive of every anchor of a pair of blocks the best rows of other labels within its window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for r in batch.to_pylist():
                rows, anchors = _Side(r, "", dim), _Side(r, "_a", dim)
                lowest, highest = np.array(r["from_each_a"]), np.array(r["to_each_a"])
                for a in _steps(len(anchors.rows), _ANCHORS):
                    held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
                    for b in _steps(len(rows.rows), _ROWS):
                        scores, may, at = _candidates(rows, anchors, a, b, lowest[a], highest[a], False)
                        for k in np.flatnonzero(may.any(1)):
                            for p, top in enumerate(r["tops_a"][a.start + k] or []):
                                own = may[k] & (scores[k] <= top) & (scores[k] >= window_start(top))
                                if own.any():
                                    before = held.get((k, p), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                                    held[k, p] = _best(np.append(before[0], scores[k][own]), np.append(before[1], at[own]), rows, NEGATIVES)
                    for (k, p), (score, at) in held.items():
                        out[0] += [int(anchors.rows[a][k])] * len(at)
                        out[1] += [p] * len(at)
                        out[2] += [None if rows.unknown[j] else int(rows.ids[j]) for j in at]
                        out[3] += score.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["anchor", "place", "id", "score"])

    return run


def window_start(score: int) -> int:
    """The least score of which 100 times is 80 times ``score`` or more."""
    return -(-4 * score // 5)


def _seeds(q: np.ndarray, rows: np.ndarray, labels: np.ndarray, dim: int):
    """For each anchor the 5th best score among the sample's rows of its label, from where on its positives are; -inf if there are fewer."""
    norm = _norms(q).max(initial=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, row, label = _matrix(batch.column("q"), dim), batch.column("row").to_numpy(), batch.column("label").to_numpy()
            seeds = np.full(len(own), -np.inf)
            for a in _steps(len(own), _ANCHORS):
                scores = np.where((label[a, None] == labels[None]) & (row[a, None] != rows[None]), products(own[a], q, _norms(own[a]).max(initial=0), norm), np.iinfo(np.int64).min)
                if scores.shape[1] >= POSITIVES:
                    seeds[a] = np.partition(scores, -POSITIVES, axis=1)[:, -POSITIVES]
            seeds[seeds <= np.iinfo(np.int64).min / 2] = -np.inf
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(seeds)], ["row", "seed"])

    return run


def _pairs(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every pair of a block of rows and one of anchors that may have scores between the anchors' ``from`` and ``to``, with both blocks' columns."""
    ends = ["block", "low", "high", "norm_low", "norm_high"]
    own = anchors.select(*[F.col(c).alias(f"{c}_a") for c in anchors.columns])
    parts = blocks.select(*ends).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_SHARDS - 1))))
    summaries = own.select(*[f"{c}_a" for c in [*ends, "from", "to"]], F.pmod(F.xxhash64("block_a"), F.lit(_SHARDS)).cast("int").alias("part"))
    met = parts.join(summaries, "part").drop("part").mapInArrow(_meeting, "block long, block_a long")
    return met.join(blocks, "block").join(own, "block_a")


def _with_windows(anchors: DataFrame, windows: DataFrame, *more: str) -> DataFrame:
    """Anchor blocks with an array for each column of ``windows`` (``row, from_each, to_each`` and others), in the order of their rows.

    Nothing is wanted of a row that has no window.
    """
    places = anchors.select("block", F.posexplode("rows").alias("at", "row")).join(windows, "row", "left")
    places = places.fillna({"from_each": float("inf"), "to_each": float("-inf")})
    found = places.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "from_each", "to_each", *more))).alias("w"), F.min("from_each").alias("from"), F.max("to_each").alias("to"))
    return anchors.join(found, "block").select(*anchors.columns, "from", "to", *[F.col(f"w.{c}").alias(c) for c in ("from_each", "to_each", *more)])


def hard_negatives(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows with a null label or vector, or any null or non-finite component, take no part; nor do rows whose score with themselves is
    2**62 or more. Where the id is divisible by 7, the label is first ``(label + 1) % 10``. A component is ``floor(256 * x)``; a score
    is the integer inner product, missing components of the shorter vector being 0. Anchors are the rows whose id is divisible by 100; their
    positives the 5 first other rows of their label; for each, the 5 first rows of other labels with ``80 * positive <= 100 * negative <= 100 * positive``.
    Higher scores come first, then smaller ids, null ids last. Every row is a row of its own, also where rows or ids repeat. A positive without
    such rows gives none. Empty tables, or without usable rows: no rows. Other columns are not read.
    """
    rows = stored(usable(embeddings, vec_id, vector, label))
    dim = max(1, rows.agg(F.max(F.size("q"))).first()[0] or 1)
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))).toArrow().combine_chunks()  # of bounded size
    seen = _matrix(sample.column("q").combine_chunks(), dim) if sample.num_rows else np.zeros((0, dim))
    index = stored(rows.mapInArrow(_indexed(references(seen), dim), INDEX))
    near = ["near", "angle", "row"]
    fits = lambda most: max(1, min(most, BLOCK_BYTES // (8 * dim)))
    blocks = stored(index.repartitionByRange(*near).sortWithinPartitions(*near).mapInArrow(_packed(dim, fits(BLOCK_ROWS)), BLOCK))
    chosen = index.filter(F.col("id") % ANCHOR_EVERY == 0)
    anchors = stored(chosen.repartitionByRange(*near).sortWithinPartitions(*near).mapInArrow(_packed(dim, fits(BLOCK_ANCHORS)), BLOCK))

    seeds = chosen.select("row", "label", "q").mapInArrow(_seeds(seen, sample.column("row").to_numpy(), sample.column("label").to_numpy(), dim), "row long, seed double")
    first = _with_windows(anchors, seeds.select("row", F.col("seed").alias("from_each"), F.lit(float("inf")).alias("to_each")))
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    positives = stored(_pairs(blocks, first).mapInArrow(_positives(dim), "anchor long, id long, score long"), batch_rows=1)
    positives = stored(positives.withColumn("place", F.row_number().over(best("anchor")) - 1).filter(F.col("place") < POSITIVES))

    # A positive with a negative score has no window.
    tops = positives.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("found"), F.max("score").cast("double").alias("to_each"), F.min(F.col("score").cast("double")).alias("least"))
    tops = tops.select("row", F.col("found.score").alias("tops"), "to_each", (F.least("least", F.lit(0.0)) + F.greatest("least", F.lit(0.0)) * 0.8 * (1 - 1e-9) - 1).alias("from_each"))
    second = _with_windows(anchors, tops, "tops")
    negatives = stored(_pairs(blocks, second).mapInArrow(_negatives(dim), "anchor long, place long, id long, score long"), batch_rows=1)
    negatives = negatives.withColumn("rank", F.row_number().over(best("anchor", "place"))).filter(F.col("rank") <= NEGATIVES)
    named = positives.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = negatives.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(named, ["anchor", "place"])
    return found.join(chosen.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


SQL = r"""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER own)::INTEGER AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
WINDOW own AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER own <= 5
"""
