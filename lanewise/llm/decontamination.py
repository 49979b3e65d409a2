"""Benchmark decontamination as a prefix-filtered set join; DataFrame operations only.

Every item gives windows of a fixed number of words. A window is contained in a document whole or not at all, so of its
words, ordered from rare to common in the documents, a prefix of one is enough: a document without a window's rarest word cannot
contain it. The join on that word is followed by the bounds on position and length and by the exact comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.shared import ascii_lower, stored, unused, whole_text

WINDOW = 13
#: Separators; letters, digits and everything outside ASCII are words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows up to this many are broadcast (some 200 bytes each); more are joined by shuffling the documents' words.
MOST_BROADCAST = 100_000


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lowered; none for the empty text."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def windows_of(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``item_id, window``: every window of every item; an item of fewer words, but not none, is one window."""
    worded = items.select(F.col(item_id).cast("string").alias("item_id"), words_of(whole_text(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return worded.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), window).alias("window"))


def _numbered(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct windows with an id, and which items have them."""
    keyed = windows.withColumn("window_id", F.sha2(F.concat_ws(" ", "window"), 256))
    return keyed.select("window_id", "window").dropDuplicates(["window_id"]), keyed.select("window_id", "item_id").distinct()


def _prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``window_id, window, word, place``: the rarest word of each window, by the documents' counts, and its first place in it (from 0).

    A window with a word that no document has cannot occur and is left out.
    """
    spread = windows.select("window_id", F.posexplode("window").alias("place", "word"))
    counted = spread.join(counts, "word", "left").groupBy("window_id")
    rarest = counted.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("rarest")).filter("rarest.n > 0")
    return windows.join(rarest, "window_id").select("window_id", "window", "rarest.word", "rarest.place")


def occurrences(docs: DataFrame, windows: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``doc_id, version, start, length, window_id``: every place (from 0) where a window occurs in ``docs`` (``doc_id, version, words``)."""
    windows = stored(windows)
    small = windows.count() <= most_broadcast
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    each_word = docs.select(F.explode_outer("words").alias("word"))
    known = each_word.join(F.broadcast(vocabulary) if small else vocabulary, "word", "left_semi")
    prefixes = stored(_prefixes(windows, known.groupBy("word").agg(F.count(F.lit(1)).alias("n"))))
    start = F.col("at") - F.col("place")
    fits = (start >= 0) & (start + F.size("window") <= F.size("words"))
    same = F.slice("words", F.greatest(start + 1, F.lit(1)), F.size("window")) == F.col("window")
    if small:
        placed = docs.select("doc_id", "version", "words", F.posexplode_outer("words").alias("at", "word"))
        found = placed.join(F.broadcast(prefixes), "word").filter(fits & same)
    else:
        placed = docs.select("doc_id", "version", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("at", "word"))
        near = placed.join(prefixes.select("word", "place", "window_id", F.size("window").alias("length")), "word")
        near = near.filter((start >= 0) & (start + F.col("length") <= F.col("n_words"))).select("doc_id", "version", "at", "place", "window_id")
        near = near.join(prefixes.select("window_id", "window"), "window_id").select(F.col("doc_id").alias("id"), F.col("version").alias("v"), "at", "place", "window_id", "window")
        copies = docs.dropDuplicates(["doc_id", "version"])
        found = near.join(copies, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("v") == F.col("version"))).filter(same)
    return found.select("doc_id", "version", start.alias("start"), F.size("window").alias("length"), "window_id")


def decontamination(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word inside any occurrence of a window is hit; ``contaminated`` if any is and ``share * n_hit >= n_words``.
    ``items_sha256`` is of the ids of the items with occurring windows, sorted as strings and joined by commas (of the empty
    string without any). Null texts, of documents or items, have no words. Rows are told apart by doc_id and text, so
    rows that repeat a doc_id keep their own counts; items that repeat an id add their windows to it; a null item_id names no item
    but its windows hit. No items, or no documents: no hits, or no rows. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("body"))
    worded = rows.select("doc_id", F.xxhash64("body").alias("version"), words_of(F.col("body")).alias("words"))
    windows, owners = _numbered(windows_of(items, item_id, item_text, window))
    found = stored(occurrences(worded, windows, most_broadcast).distinct())
    places = found.select("doc_id", "version", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("word_at")).distinct()
    hit = places.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select("doc_id", "version", "window_id").distinct().join(owners, "window_id").groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    stats = hit.join(named, hit["doc_id"].eqNullSafe(named["doc_id"]) & (hit["version"] == named["version"])).select(hit["doc_id"].alias("id"), hit["version"].alias("v"), "n_hit", "items")
    sized = worded.select("doc_id", "version", F.size("words").cast("long").alias("n_words"))
    joined = sized.join(stats, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("version") == F.col("v")), "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; nulls and ties as in :func:`decontamination`."""
    version = unused(docs, "version")
    tagged = docs.withColumn(version, F.xxhash64(whole_text(text)))
    keyed = tagged.select(F.struct(F.col(doc_id).alias("id"), F.col(version).alias("version")).alias("row"), F.col(text).alias("text"))
    found = decontamination(keyed, items, item_text=item_text, doc_id="row", **settings).filter("contaminated").select("doc_id").distinct()
    bad = found.select(F.col("doc_id.id").alias(unused(tagged, "id")), F.col("doc_id.version").alias(unused(tagged, "of")))
    same = F.col(doc_id).eqNullSafe(F.col(bad.columns[0])) & (F.col(version) == F.col(bad.columns[1]))
    return tagged.join(bad, same, "left_anti").drop(version)


SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, len(s) AS length, array_to_string(s, ' ') AS win
  FROM (SELECT item_id, list_slice(w, pos, pos + 12) AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS pos FROM item WHERE len(w) > 0))
), lengths AS (SELECT DISTINCT length FROM win),
pos AS (
  SELECT doc_id, pos, length, array_to_string(list_slice(w, pos, pos + length - 1), ' ') AS win
  FROM (SELECT doc_id, w, length, unnest(range(1, len(w) - length + 2)) AS pos FROM doc, lengths WHERE len(w) >= length)
), hits AS (SELECT doc_id, pos, length, item_id FROM pos JOIN win USING (length, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + length)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
