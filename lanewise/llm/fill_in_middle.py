"""Fill-in-middle rewriting: a text is cut at two hash-chosen places and its parts are put in another order.

One ``fullmatch`` of ``(unit)*`` keeps every repetition of its group, so that ``ends(1)`` is the list of all places where a cut may
be: its length is the number of units, and both cuts are looked up in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: What marks the parts in the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Any code point.
CODE_POINT = "."
#: Of 100 texts, those from here on stay plain; of 100 others, those below SPM_BELOW have the suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
#: Repetitions that one match keeps. A longer text is matched in runs of as many, so memory is bounded by its length in bytes.
MOST_UNITS = 1_000_000


def unit_ends(unit: str) -> Callable[[str], np.ndarray]:
    """A function that says where each unit of a text ends. A text that is no sequence of units up to its end has none."""
    whole, run = regex.compile(f"({unit})*+", regex.DOTALL), regex.compile(f"({unit}){{1,{MOST_UNITS}}}+", regex.DOTALL)

    def ends(text: str) -> np.ndarray:
        if len(text) <= MOST_UNITS:
            match = whole.fullmatch(text)
            return np.array(match.ends(1) if match else [], np.int64)
        found, at = [], 0
        while at < len(text):
            match = run.match(text, at)
            if match is None or match.end() == at:
                return np.zeros(0, np.int64)
            found.append(np.array(match.ends(1), np.int64))
            at = match.end()
        return np.concatenate(found)

    return ends


def _rewritten(unit: str, field: int):
    ends_of = unit_ends(unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(f"h{k}").to_pylist() for k in range(1, 5)]
            texts = batch.column("given").field(field).cast(pa.string()).fill_null("")
            rows = []
            for text, h1, h2, h3, h4 in zip(texts.to_pylist(), *h, strict=True):
                ends = ends_of(text)
                n = len(ends)
                if n == 0 or h3 % 100 >= PLAIN_FROM or PREFIX in text or SUFFIX in text or MIDDLE in text:
                    rows.append((n, "plain", None, None, text))
                    continue
                first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
                a, b = (int(ends[k - 1]) if k else 0 for k in (first, last))
                if h4 % 100 < SPM_BELOW:
                    rows.append((n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))))
                else:
                    rows.append((n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("given"), *made], names)

    names = ["given", "n", "form", "prefix_chars", "middle_chars", "output"]
    return run


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", unit: str = CODE_POINT) -> DataFrame:
    """All rows and columns of ``docs`` in ``given`` (a struct), with ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    ``unit`` is a regular expression of what may not be cut (the empty match aside); ``n`` counts the units of the text. h1 to h4 are
    the first 8-digit groups of the hex sha256 of ``1:`` and the doc_id. Prefix and middle end after the smaller and the
    larger of ``h1 % (n+1)`` and ``h2 % (n+1)`` units. The form is ``plain`` (the text, no lengths) if the text is empty, holds a marker or is no
    sequence of units, or if ``h3 % 100 >= PLAIN_FROM``; else ``spm`` if ``h4 % 100 < SPM_BELOW``, else ``psm``. Lengths are
    code points. Null texts are empty, a null doc_id hashes as no digits; repeated doc_ids are cut at the same shares. Empty: no rows.
    """
    digits = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    field = [c.lower() for c in docs.columns].index(text.lower())
    made = [("n", LongType()), ("form", StringType()), ("prefix_chars", LongType()), ("middle_chars", LongType()), ("output", StringType())]
    schema = StructType([StructField("given", docs.schema), *[StructField(c, t) for c, t in made]])
    return docs.select(given.alias("given"), *groups).mapInArrow(_rewritten(unit, field), schema)


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from an output and its form alone.

    Texts with markers are plain, and no marker begins inside another, so each marker's first place is where it was put.
    """
    first, second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(PREFIX), F.lit(MIDDLE)
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    one = F.substring_index(body, SUFFIX, 1)
    one = F.when(form == "psm", one).otherwise(F.substring_index(body, PREFIX, 1))
    rest = F.substr(body, F.char_length(one) + F.char_length(first) + 1)
    two = F.substring_index(rest, MIDDLE, 1)
    middle = F.substr(rest, F.char_length(two) + F.char_length(second) + 1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def fill_in_middle_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of every row, as :func:`fill_in_middle` has them."""
    made = fill_in_middle(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("given.doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
drawn AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
    ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM hashed
), formed AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), cut AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM formed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""
