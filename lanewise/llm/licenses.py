"""Licence scan by canonical digest: texts that are a known licence whatever their case, punctuation, copyright lines and spelling.

DataFrame operations only. A text's canonical form is hashed and joined to the digests of the known licences' canonical forms.
"""

from __future__ import annotations

import re
import textwrap
from functools import cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.shared import ascii_lower, whole_text

#: A line that begins, after signs only, with a copyright notice.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Spellings that count as one, the first as the second.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("acknowledgements", "acknowledgments"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("behaviour", "behavior"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("judgement", "judgment"),
    ("labelled", "labeled"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("percent", "per cent"),
    ("recognised", "recognized"),
    ("sublicence", "sublicense"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
#: Texts of known licences without their copyright lines.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}


#: Texts as published, one file a licence, named by its id.
FOLDER = Path(__file__).with_name("license_texts")
#: Title lines that files put before a text which has none of its own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "License: MIT", "License (MIT)", "MIT", "Expat License", "This software is released under the MIT license:"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD-2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "2-Clause BSD License", "The 2-Clause BSD License", "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD-3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "3-Clause BSD License", "The 3-Clause BSD License", "BSD License", "The BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License", "0BSD", "BSD 0-Clause License"),
    "Unlicense": ("Unlicense", "The Unlicense", "UNLICENSE"),
}
#: Where a text begins that may stand without its title, and the line after which it may end.
BODIES = {
    "Apache-2.0": "TERMS AND CONDITIONS FOR USE",
    "Artistic-1.0-Perl": "Preamble",
    "BSL-1.0": "Permission is hereby",
    "CC0-1.0": "Statement of Purpose",
    "CDLA-Permissive-2.0": "This is the Community",
    "GFDL-1.2": "Everyone is permitted",
    "GFDL-1.3": "Everyone is permitted",
    "GPL-1.0": "Everyone is permitted",
    "GPL-2.0": "Everyone is permitted",
    "GPL-3.0": "Everyone is permitted",
    "LGPL-2.0": "Everyone is permitted",
    "LGPL-2.1": "Everyone is permitted",
    "LGPL-3.0": "Everyone is permitted",
    "MPL-1.1": "1. Definitions",
    "MPL-2.0": "1. Definitions",
    "OFL-1.1": "SIL OPEN FONT LICENSE Version",
    "Unicode-3.0": "NOTICE TO USER",
}
LAST_LINE = "END OF TERMS AND CONDITIONS"
#: The publisher's addresses that copies of the older GNU texts have.
GNU_ADDRESS = r"51 Franklin St(?:reet)?, Fifth Floor, Boston,?\s+MA\s+02110-1301,?\s+USA"
GNU_ADDRESSES = ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA", "675 Mass Ave, Cambridge, MA 02139, USA")
#: Texts of at most so many characters are known in the line breaks of these widths; lines that begin with "copyright" are left out of a form.
WRAPPED = 2500
WIDTHS = range(50, 101)


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words with one space between them, one spelling."""
    plain = F.regexp_replace(F.regexp_replace(ascii_lower(text), COPYRIGHT_LINE, "\n"), SIGNS, " ")
    padded = F.concat(F.lit(" "), F.btrim(plain), F.lit(" "))
    return F.btrim(reduce(lambda t, pair: F.replace(t, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), SPELLINGS, padded))


def _bsd_texts() -> list[tuple[str, str]]:
    """The two- and three-clause texts: items with numbers or signs, the names of holders that are common to many files."""
    whole, found = (FOLDER / "BSD-3-Clause.txt").read_text("utf-8"), []
    third = whole[whole.index("3. Neither") : whole.index("THIS SOFTWARE")]
    for holders, holder in (("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"), ("COPYRIGHT HOLDERS", "COPYRIGHT OWNER"), ("AUTHOR", "AUTHOR"), ("AUTHORS", "AUTHORS"), ("REGENTS", "REGENTS")):
        named = re.sub(r"COPYRIGHT\s+HOLDERS", holders, whole, count=1)
        named = re.sub(r"COPYRIGHT\s+HOLDER\b", holder, named, count=1)
        texts = [("BSD-2-Clause", named.replace(third, ""))]
        for name in ("the copyright holder", "the copyright holders", "the author", "the authors", "the University", "the organization", "the <organization>", "[project]"):
            texts.append(("BSD-3-Clause", named.replace("the copyright holder nor", f"{name} nor")))
        found += [(i, form) for i, t in texts for form in (t, re.sub(r"(?m)^\d\. ", "* ", t))]
    return found


def _plain(text: str) -> str:
    """Equal for forms of one text that :func:`canonical` makes equal."""
    return " ".join(re.sub("[^a-z0-9]+", " ", re.sub(COPYRIGHT_LINE, "\n", text.lower())).split())


def _line_breaks(text: str) -> list[str]:
    """The text as it is, without line breaks, and in the line breaks of ``WIDTHS``, one text for each form; forms differ in the lines that begin with a copyright notice."""
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
    broken = [text, "\n\n".join(paragraphs)]
    if len(text) <= WRAPPED:
        broken += ["\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False, subsequent_indent=indent) for p in paragraphs) for width in WIDTHS for indent in ("", "   ")]
    return list({_plain(t): t for t in reversed(broken)}.values())


@cache
def license_forms() -> list[tuple[str, str]]:
    """Id and text of every form of the known licences: with and without title and closing instructions, http or https, line breaks."""
    texts = [*KNOWN.items(), *_bsd_texts()]
    for file in sorted(FOLDER.glob("*.txt")):
        if (name := file.stem) != "BSD-3-Clause":
            text = file.read_text("utf-8")
            own = [re.sub(GNU_ADDRESS, a, text) for a in GNU_ADDRESSES] if re.search(GNU_ADDRESS, text) else []
            texts += [(name, t) for t in [text, *own]]
    forms: dict[tuple[str, str], str] = {}
    for name, text in texts:
        end = text.find(LAST_LINE) if " WITH " not in name else -1  # an exception follows that line
        for part in [text] if end < 0 else [text, text[: end + len(LAST_LINE)]]:
            start = part.find(BODIES[name]) if name in BODIES else 0
            for body in {part, part[start:]} if start >= 0 else {part}:
                for form in {body, body.replace("http://", "https://"), body.replace("https://", "http://")}:
                    for broken in _line_breaks(form):
                        plain = _plain(broken)
                        forms |= {(name, f"{_plain(title)} {plain}"): f"{title}\n\n{broken}" for title in ("", *TITLES.get(name, ()))}
    return [(name, form) for (name, _), form in forms.items()]


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(license_forms(), "license_id string, text string")


def license_scan(docs: DataFrame, licenses: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, canonical_sha256, license_id`` (null if none), ``is_license``.

    ``licenses`` has ``license_id`` and ``text``; of several with one canonical form the least id counts, and empty forms match
    nothing. Null texts count as empty. Null or repeated doc_ids and repeated rows keep their own rows. Empty: no rows.
    """
    known = licenses.select("license_id", canonical(whole_text("text")).alias("form")).filter("form <> ''")
    known = known.groupBy(F.sha2("form", 256).alias("canonical_sha256")).agg(F.min("license_id").alias("license_id"))
    digests = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(canonical(whole_text(text)), 256).alias("canonical_sha256"))
    found = digests.join(known, "canonical_sha256", "left")
    return found.select("doc_id", "canonical_sha256", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def _sql_form(text: str) -> str:
    lowered = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    plain = f"regexp_replace(regexp_replace({lowered}, '{COPYRIGHT_LINE}', chr(10), 'g'), '{SIGNS}', ' ', 'g')"
    return "trim(" + reduce(lambda t, pair: f"replace({t}, ' {pair[0]} ', ' {pair[1]} ')", SPELLINGS, f"(' ' || trim({plain}) || ' ')") + ")"


def sql() -> str:
    rows = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN.items())
    return f"""
WITH known AS (SELECT sha256({_sql_form('text')}) AS canonical_sha256, min(license_id) AS license_id FROM (VALUES {rows}) v(license_id, text) GROUP BY 1),
digests AS (SELECT doc_id, sha256({_sql_form("coalesce(text, '')")}) AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, license_id, license_id IS NOT NULL AS is_license FROM digests LEFT JOIN known USING (canonical_sha256)
"""
