"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's tokens are its runs of letters and digits and its runs of other signs. Each token counts as itself and as its shape
(case, digits, length, which signs), alone and with the token before it, hashed to a fixed number of weights. The
features of a text are the shares of its n-grams, so that texts of any length compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lanewise.llm import textblocks
from lanewise.llm.shared import CLEANUP, remainder, settings, stored, unused, whole_text

#: Weights; the last one is the bias.
SIZE = 1 << 17
#: Labelled rows that the classifier is fitted on at most, those with the least hash of their doc_id.
MOST_ROWS = 16_000
#: Tasks that train side by side; their states are averaged after each round.
SHARDS = 8
ROUNDS = 6
_SLICES = 4
MINI_BATCH = 16
ALPHA, BETA, L1, L2 = 0.6, 1.0, 1e-4, 1e-3
THRESHOLD = 0.7

_SPACE, _WORD, _SIGN = 0, 1, 2
_KIND = np.full(256, _SIGN, np.int8)
_KIND[[*range(0x09, 0x0E), 0x20]] = _SPACE
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _KIND[_a : _b + 1] = _WORD
_UPPER = np.zeros(256, np.int32)
_UPPER[0x41:0x5B] = 1
_DIGIT = np.zeros(256, np.int32)
_DIGIT[0x30:0x3A] = 1


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For every token, its weights' numbers, one array for each kind of n-gram; each text's first token (end last)."""
    kind = np.concatenate([[_SPACE], _KIND[data], [_SPACE]]).astype(np.int8)
    change = kind[1:] != kind[:-1]
    change[offsets] = True  # texts do not run into each other
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    solid = kind[1:][starts] != _SPACE
    starts, ends = starts[solid], ends[solid]
    first = np.searchsorted(starts, offsets)
    token = textblocks.stretch_hash(textblocks.running(data), starts, ends)
    sign = kind[1:][starts] == _SIGN
    uppers, digits = (np.concatenate([[0], np.cumsum(table[data])]) for table in (_UPPER, _DIGIT))
    length, upper, digit = ends - starts, uppers[ends] - uppers[starts], digits[ends] - digits[starts]
    case = np.where(digit > 0, 3, np.where(upper == 0, 0, np.where((upper > 1) & (upper * 2 > length), 2, 1)))
    shape = np.where(sign, token, (case * 8 + np.minimum(length // 3, 7)).astype(np.uint64))
    opening = np.zeros(len(starts) + 1, bool)
    opening[first] = True
    opening = opening[:-1]

    def pair(values: np.ndarray) -> np.ndarray:
        """With the token before; the first token of a text has none."""
        before = np.concatenate([values[:1], values[:-1]])
        before[opening] = 0
        return before * np.uint64(0xC2B2AE3D27D4EB4F) + values

    same = pair(token) == token * np.uint64(0xC2B2AE3D27D4EB4F) + token
    grams = [token, pair(token), shape, pair(shape), same.astype(np.uint64) + np.uint64(2) * sign]
    return [(textblocks.mixed_bits(g + np.uint64(7919 * (k + 1))) % np.uint64(SIZE - 1)).astype(np.int64) for k, g in enumerate(grams)], first


def _margins(weights: np.ndarray, grams: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    total = sum(textblocks.per_text(weights[g], first) for g in grams)
    return total / np.maximum(1, first[1:] - first[:-1]) + weights[-1]


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leader's weights from its summed gradients and their squares."""
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _train(z: np.ndarray, n: np.ndarray, texts: pa.Array, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for at in range(0, len(texts), MINI_BATCH):
        grams, first = _features(*textblocks.text_bytes(texts.slice(at, MINI_BATCH)))
        tokens = first[1:] - first[:-1]
        weights = _weights(z, n)
        error = _sigmoid(_margins(weights, grams, first)) - wanted[at : at + MINI_BATCH]
        each = np.repeat(error / np.maximum(1, tokens), tokens)
        gradient = sum(np.bincount(g, each, SIZE) for g in grams)
        gradient[-1] = error.sum()
        n_new = n + gradient**2
        z += gradient - (np.sqrt(n_new) - np.sqrt(n)) / ALPHA * weights
        n = n_new
    return z, n


def _learner(state: Broadcast):
    """One shard's state in ``_SLICES`` parts, each with the shard's number of rows."""

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(textblocks.mixed_bits(pdf["id"].to_numpy().astype(np.uint64)), kind="stable")
        pdf = pdf.iloc[order]
        z, n = _train(state.value[0].copy(), state.value[1].copy(), pa.array(pdf["body"], pa.string()), pdf["wanted"].to_numpy())
        parts = np.split(np.stack([z, n]), _SLICES, axis=1)
        return pd.DataFrame([(k, pdf["shard"].iloc[0], len(pdf), part.tobytes()) for k, part in enumerate(parts)], columns=["slice", "shard", "rows", "part"])

    return learn


def _mean(pdf: pd.DataFrame) -> pd.DataFrame:
    """The shards' mean of one slice, weighted by their rows."""
    pdf = pdf.sort_values("shard")
    share = pdf["rows"].to_numpy() / pdf["rows"].sum()
    mean = sum(s * np.frombuffer(part) for s, part in zip(share, pdf["part"], strict=True))
    return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "part": [mean.tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", most_rows: int = MOST_ROWS) -> np.ndarray:
    """The weights, a fixed number of them, from at most ``most_rows`` labelled rows of ``labels`` (``doc_id`` and ``label``).

    Rows without id or label teach nothing; of several labels of one id the largest counts. Without any row all weights are 0
    and every score is 0.5. Every round trains in ``SHARDS`` tasks from the same state and averages what they return.
    """
    taught = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("wanted")).dropna().groupBy("id").agg(F.max("wanted").alias("wanted"))
    # most_rows bounds what is broadcast.
    chosen = taught.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    rows = docs.select(F.col(doc_id).alias("id"), whole_text(text).alias("body")).join(F.broadcast(chosen), "id")
    rows = stored(rows.select("id", "body", "wanted", F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(SHARDS)).alias("shard")))
    z, n = np.zeros(SIZE), np.zeros(SIZE)
    for _ in range(ROUNDS):
        state = docs.sparkSession.sparkContext.broadcast((z, n))
        with settings(docs.sparkSession, {CLEANUP: "true"}):
            learnt = rows.select("id", "body", "wanted", "shard").groupBy("shard").applyInPandas(_learner(state), "slice int, shard long, rows long, part binary")
            means = learnt.groupBy("slice").applyInPandas(_mean, "slice int, part binary").collect()  # one state of fixed size, not one a shard
        if means:
            z, n = np.concatenate([np.frombuffer(bytes(r["part"])).reshape(2, -1) for r in sorted(means, key=lambda r: r["slice"])], axis=1)
        state.unpersist()
    return _weights(z, n)


def with_scores(docs: DataFrame, weights: np.ndarray, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with one more column, the score between 0 and 1 of each whole text; null and empty texts have the bias's.

    The text alone decides. A column of that name is replaced. Other columns pass unchanged.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    kept = [c for c in docs.columns if c != score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0)]
            for part in textblocks.slices(batch.column(text)):
                found.append(_sigmoid(_margins(model.value, *_features(*textblocks.text_bytes(part))).astype(float)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(np.concatenate(found))], [*kept, score])

    rows = docs.select(*kept)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(score, DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = 4, held_out: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted`` (1 from a score of ``THRESHOLD``).

    Labels of the held-out fold (crc32 of the id as text, modulo ``folds``) are never learnt from. Null texts count as empty.
    A null doc_id is not held out. Repeated rows get equal scores. An empty table gives no rows.
    """
    weights = fit(docs, labels.filter(remainder(doc_id, folds) != held_out), text=text, doc_id=doc_id)
    scored = with_scores(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), weights).select("doc_id", "score")
    return scored.select("doc_id", (remainder("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the classifier, fitted as in :func:`quality_scores`, does not reject, with all their columns."""
    weights = fit(docs, labels.filter(remainder(doc_id, 4) != 2), text=text, doc_id=doc_id)
    score = unused(docs, "score")
    return with_scores(docs, weights, text, score).filter(F.col(score) >= THRESHOLD).drop(score)
