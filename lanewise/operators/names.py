"""Name search by shared trigrams, over an index of grams.

A name's words (letters and digits, lower case) are padded by two blanks before and one after; its grams are the distinct runs of three.
The similarity of two names is the number of shared grams over that of all. Whoever reaches a similarity t with a name of m grams has between
``t*m`` and ``m/t`` grams. With n grams it shares at least ``s = ceil(t/(1+t) * (m+n))`` of them, hence one of any ``m - s + 1``: the rarest ones
are looked up. Sets that share s differ in ``m + n - 2*s`` grams at most, so the parity bits of their hashes do in no more: what differs in more is left out
before names are compared. A search for the few most similar names asks for a high similarity first, and lower only for texts that found too few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.operators.ordering import union_all
from lanewise.sources.checkpoints import materialized

#: Similarity from which names count as alike, unless stated otherwise.
ALIKE = 0.3
#: Similarities asked for in turn, above the stated one, while a text lacks some of its most similar names.
STEPS = (0.7, 0.6, 0.5, 0.4)


def grams(name: Column) -> Column:
    """Distinct trigrams of a name; none for a null or a name without letters and digits."""
    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def parity(grams: Column) -> Column:
    """64 bits, each the parity of the number of grams whose hash points at it."""
    bit = lambda g: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(g), F.lit(64)).cast("int"))
    return F.aggregate(grams, F.lit(0).cast("long"), lambda bits, g: bits.bitwiseXOR(bit(g)))


def gram_index(names: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """``(names, postings)``: ``key, name, grams, bits`` (their parity) of every name that has some, and ``gram, n, bits, key`` (n: grams of the name) for each of them.

    Write both once, the postings clustered by gram; a search reads the grams it asks for.
    """
    held = names.select(F.col(key).alias("key"), F.col(name).alias("name"), grams(F.col(name)).alias("grams")).filter(F.size("grams") > 0)
    held = held.withColumn("bits", parity(F.col("grams")))
    return held, postings(held)


def postings(held: DataFrame) -> DataFrame:
    return held.select(F.explode("grams").alias("gram"), F.size("grams").alias("n"), "bits", "key")


def similarity(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def _pairs(postings: DataFrame, each: DataFrame, alike: float) -> DataFrame:
    """``query, key`` that may reach ``alike``; ``each`` has the grams of the queries with their place by rarity."""
    m, n = F.col("m"), F.col("n")
    prefix = each.filter(F.col("place") <= m - F.ceil(m * F.lit(alike) - 1e-9) + 1)
    sized = (n >= m * alike - 1e-9) & (n * alike <= m + 1e-9)
    least = F.ceil((m + n) * (alike / (1 + alike)) - 1e-9)
    near = (F.col("place") <= m - least + 1) & (2 * least <= m + n - F.bit_count(F.col("own_bits").bitwiseXOR(F.col("bits"))))
    return prefix.join(postings, "gram").filter(sized & near).select("query", "key").distinct()


def _alike(index: tuple[DataFrame, DataFrame], asked: DataFrame, each: DataFrame, alike: float) -> DataFrame:
    """Names that reach ``alike`` with a text of ``asked``, of the queries in ``each``."""
    held, postings = index
    scored = _pairs(postings, each, alike).join(asked, "query").join(held.drop("bits"), "key").withColumn("similarity", similarity(F.col("own"), F.col("grams")))
    return scored.filter(F.col("similarity") >= alike).select("query", "key", "name", "similarity")


def search(index: tuple[DataFrame, DataFrame], wanted: DataFrame, query: str, text: str, alike: float = ALIKE, most: int | None = None) -> DataFrame:
    """``query, key, name, similarity`` for every name that reaches ``alike`` with a text of ``wanted``; of each query the first ``most`` if given.

    More similar names come first, then lesser keys. Texts and names without grams match nothing; a null similarity does not occur.
    ``alike`` is more than 0. Postings of common grams are read only for texts that have no rarer ones to ask for. With ``most``, jobs run while
    the search is being built.
    """
    asked = wanted.select(F.col(query).alias("query"), grams(F.col(text)).alias("own")).filter((F.size("own") > 0) & F.col("query").isNotNull())
    each = asked.distinct().withColumn("own_bits", parity(F.col("own"))).select("query", "own", F.size("own").alias("m"), "own_bits", F.explode("own").alias("gram"))
    common = index[1].join(each.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("times"))
    rare_first = Window.partitionBy("query", "own").orderBy(F.coalesce("times", F.lit(0)), "gram")
    each = each.join(common, "gram", "left").withColumn("place", F.row_number().over(rare_first)).filter("times IS NOT NULL").drop("own", "times")
    if most is None:
        return _alike(index, asked, each, alike)
    each, enough = materialized(each), []
    first = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    for step in [s for s in STEPS if s > alike]:
        found = _alike(index, asked, each, step).withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= most)
        found = materialized(found)
        done = found.filter(F.col("_place") == most).select("query")
        enough.append(found.join(done, "query", "left_semi"))
        each = materialized(each.join(done, "query", "left_anti"))
        if each.isEmpty():
            return union_all(enough).drop("_place")
    rest = _alike(index, asked, each, alike).withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= most)
    return union_all([*enough, rest]).drop("_place")
