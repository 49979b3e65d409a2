"""Mixing sources to target weights: whole copies by the rate, one more by a seeded coin for what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.shared import SPACED_WORD, stored, unused

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words.
SHARE = 1.5
#: Most copies of a document.
MOST = 2
SEED = 7


def words_of(text: str = "text") -> Column:
    """Number of words (runs without ASCII white space); 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def coin(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the id only; a null id counts as the empty text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target, rate`` from rows ``source, size``; the null source is one source, last in order.

    Each target is ``min(weight * level, most * source_size)`` with one level for all, so that the targets add up to
    ``share`` of all words: what a source cannot take is shared by weight among the others. The level comes from running sums
    over the sources in the order in which they fill up; only sources, one row each, meet in those windows.
    Sources without words have target 0 and rate 0.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    ranked = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int") + 1))
    filling = Window.orderBy(F.col("fill"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = (
        ranked.withColumn("most", F.col("source_size") * most)
        .withColumn("fill", F.col("most") / F.col("weight"))
        .withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(rest))
    )
    # The first source in filling order that the level does not fill sets the level for itself and all after it.
    level = F.coalesce(F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(everything)["level"], F.max("fill").over(everything))
    target = F.least(F.col("weight") * level, F.col("most").cast("double"))
    targeted = levels.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return targeted.select("source", "source_size", "target", rate.alias("rate"))


def copies(rate: Column, doc_id: Column, seed: int = SEED) -> Column:
    """floor(rate) copies, and one more with a probability equal to the fraction."""
    return (F.floor(rate) + F.when(coin(doc_id, seed) < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix_plan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = SEED, **settings) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, copies, taken`` (words taken, repeats counted).

    Null texts have size 0. The null source is a source. Rows that repeat a doc_id toss the same coin. Empty: no rows.
    ``settings`` are those of :func:`source_targets`.
    """
    sized = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_of(text).alias("size")))
    targets = source_targets(sized, **settings).withColumnRenamed("source", "of")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", copies(F.col("rate"), F.col("doc_id"), seed))
    return joined.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = SEED, **settings) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as its copies, some not at all.

    Nulls, ties and empty input as in :func:`mix_plan`.
    """
    sizes = stored(docs.select(F.col(source).alias("source"), words_of(text).alias("size")))
    often, of, rate = (unused(docs, n) for n in ("copies", "of", "rate"))
    targets = stored(source_targets(sizes, **settings).select(F.col("source").alias(of), F.col("rate").alias(rate)))
    joined = docs.join(targets, F.col(source).eqNullSafe(F.col(of))).withColumn(often, copies(F.col(rate), F.col(doc_id), seed)).drop(of, rate)
    # A sequence of one number for each copy.
    return joined.filter(F.col(often) > 0).withColumn(often, F.explode(F.sequence(F.lit(1), F.col(often)))).drop(often)


SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, [3, 1, 2][turn + 1] AS weight, source_size * 2 AS most, (source_size * 2)::DOUBLE / [3, 1, 2][turn + 1] AS fill FROM per_source
), levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM ranked
), chosen AS (
  SELECT coalesce((SELECT level FROM levels WHERE level <= fill ORDER BY fill, level LIMIT 1), (SELECT max(fill) FROM levels)) AS level
), targets AS (
  SELECT l.source, l.source_size, least(l.weight * c.level, l.most::DOUBLE) AS target FROM levels l, chosen c
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0 END AS rate FROM targets
), tossed AS (
  SELECT doc_id, source, size, ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS toss FROM sized
)
SELECT t.doc_id, t.size, r.source_size, r.target,
       (floor(r.rate) + CASE WHEN t.toss < r.rate - floor(r.rate) THEN 1 ELSE 0 END)::INTEGER AS copies,
       (t.size * (floor(r.rate) + CASE WHEN t.toss < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM tossed t JOIN rated r ON t.source IS NOT DISTINCT FROM r.source
"""
