"""Licence scan by canonical digest lookup, in DataFrame functions only.

A unit is a whole text, one of its lines or one of its paragraphs. Units are brought to one canonical form (lower case, no
copyright statements, one spelling for words with several, punctuation as space, single spaces), digested, and hash-joined
with the digests of known licences: one-line notices (KNOWN) and full texts (known_licences). A full text is known as a whole,
with and without its title, and as the row of its paragraphs: where all of them follow each other in a text, it is a block
of that text. The lookup table is a parameter (license, digest of a whole unit); the default is bounded by that fixed list.

Defined cases: null and empty texts have no unit and match nothing (text_license null, n_license_lines 0); a text that
is only a copyright line has an empty canonical form and matches nothing, nor does an empty known text; blocks of several
lines count with all their lines that are not blank; texts with a holder's own name inside a clause are not known; repeated rows are returned once each with
equal values; rows are told apart by a hash of id and text, so a null id and an id with several texts lose nothing; very long
texts are scanned whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pathlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_text

# Licence identifiers with the public wording of their notices or short full texts.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
]
#: Equivalent spellings, applied in this order to lower-case text.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("organisation", "organization"), ("https://", "http://"), ("version ", "v ")]


#: A line that starts as a copyright statement, up to its end or to the licence text that follows on the same line.
_YEAR = r"[\[(<{]?(?:\d{4}|yyyy|year\b)"
STATEMENT = (
    r"(?m)^[ \t*#/;%>-]*(?:(?i:(?:copyright\b[ \t:]*(?:\(c\)|©)|©)[ \t]*\S|(?:copyright|\(c\))[ \t:,]*(?:by[ \t]+)?" + _YEAR + r")"
    r"|Copyright[ \t]+(?:by[ \t]+)?(?!Licen[cs]e|Notice|Holder|Owner|Law|Act\b|Treaty|Statement|Disclaimer|Interest)[A-Z]"
    r"|(?i:all rights reserved\.?[ \t\r]*$))"
    r"[^\n]*?(?=$|(?i:\b(?:permission is hereby|permission to use|redistribution and use|everyone is permitted|licensed under|released under)\b))"
)
#: Titles that a full text may carry.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "Expat License"], "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "BSD License"],
}
BREAK = r"\n[ \t\r]*(?:\n[ \t\r]*)+"
EMPTY = hashlib.sha256(b"").hexdigest()
#: Known digests up to which they are broadcast; a longer table is met by a shuffled join.
BROADCAST_ROWS = 50_000


def canonical(text: Column) -> Column:
    t = F.lower(F.regexp_replace(text, STATEMENT, " "))
    for a, b in SPELLINGS[:-1]:
        t = F.replace(t, F.lit(a), F.lit(b))
    # The last spelling ends in a space, so it comes after line breaks have become one.
    return F.trim(F.replace(F.regexp_replace(t, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), *map(F.lit, SPELLINGS[-1])))


def full_texts() -> list[tuple[str, str]]:
    """(license, body) of each full text and its usual variants: without appendix, other list signs, other words for the holder."""
    out = []
    for path in sorted((pathlib.Path(__file__).parent / "known_licences").glob("*.txt")):
        name, body = path.stem, path.read_text().strip("\n")
        bodies = [body]
        if (end := re.search(r"(?m)^\s*END OF TERMS AND CONDITIONS\s*$", body)):
            bodies += [body[: end.start()], body[: end.end()]]
        if name.startswith("BSD"):
            bodies += [re.sub("COPYRIGHT\\s+HOLDER\\s+OR\\s+CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS", x) for x in bodies]
            bodies += [re.sub(r"(?m)^(\s*)\d\. ", r"\1* ", x) for x in bodies]
            # List entries with a blank line between them or none, and after the first sentence or not.
            bodies += [re.sub(r"\n\n(?=\s*(?:[2-9]\.|\*))", "\n", x) for x in bodies] + [re.sub(r"\n\n(?=\s*(?:\d\.|\*))", "\n", x) for x in bodies]
        out += [(name, x) for x in dict.fromkeys(bodies)]
    return out


def known_digests(spark: SparkSession) -> DataFrame:
    """license, digest, variant, k, m: digest is that of a whole unit (m is 1) or of paragraph k of the m of a variant."""
    wholes, rows = [*KNOWN], []
    for v, (name, body) in enumerate(full_texts()):
        wholes += [(name, f"{title}\n\n{body}") for title in ("", *TITLES.get(name, []))]
        parts = re.split(BREAK, body)
        rows += [(name, part, v, k, len(parts)) for k, part in enumerate(parts) if len(parts) > 1]
    rows += [(name, body, -1 - k, 0, 1) for k, (name, body) in enumerate(wholes)]
    table = spark.createDataFrame(rows, "license string, body string, variant int, k int, m int").select("license", F.sha2(canonical(F.col("body")), 256).alias("digest"), "variant", "k", "m")
    whole = table.where("m = 1").groupBy("digest").agg(F.min("license").alias("license"), F.max("variant").alias("variant"))
    return whole.select("license", "digest", "variant", F.lit(0).alias("k"), F.lit(1).alias("m")).unionByName(table.where("m > 1"))


def _known(spark: SparkSession, known: DataFrame | None) -> DataFrame:
    known = known if known is not None else known_digests(spark)
    if "variant" not in known.columns:
        known = known.select("license", "digest", F.xxhash64("digest").alias("variant"), F.lit(0).alias("k"), F.lit(1).alias("m"))
    known = known.where(F.col("digest") != EMPTY)
    if known.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return known.select("license", "digest", F.col("variant").cast("long").alias("variant"), "k", "m")
    # Few rows travel as values, so that the filter is not repeated on each unit of the documents.
    rows = [tuple(r) for r in known.select("license", "digest", F.col("variant").cast("long"), "k", "m").collect()]
    return F.broadcast(spark.createDataFrame(rows, "license string, digest string, variant long, k int, m int"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_license (of the entire text), licenses (of lines and blocks, sorted, comma-joined), n_license_lines."""
    rows = whole_text(docs, id_col, text_col)

    def unit(kind: int, body: Column, at: Column = F.lit(0), lines: Column = F.lit(1)) -> Column:
        return F.struct(F.lit(kind).alias("kind"), body.alias("body"), at.cast("int").alias("at"), lines.cast("int").alias("lines"))

    def lines_of(text: Column) -> Column:
        return F.size(F.filter(F.split(text, "\n", -1), lambda x: F.trim(F.replace(x, F.lit("\r"), F.lit(""))) != ""))

    text = F.col("text")
    paragraphs = F.when(text.rlike(BREAK), F.transform(F.split(text, BREAK, -1), lambda x, at: unit(2, x, at, lines_of(x)))).otherwise(F.array().cast("array<struct<kind:int,body:string,at:int,lines:int>>"))
    # An entire text without paragraphs is its own block.
    entire = unit(0, text, F.lit(0), F.when(text.rlike(BREAK), F.lit(1)).otherwise(lines_of(text)))
    units = rows.select(
        F.xxhash64("doc_id", "text").alias("row_key"),
        F.explode(F.concat(F.array(entire), F.transform(F.split(text, "\n", -1), lambda x, at: unit(1, x, at)), paragraphs)).alias("u"),
    )
    block = (F.col("kind") != 1) & (F.col("lines") > 1)
    found = (
        units.select("row_key", "u.kind", "u.at", "u.lines", F.sha2(canonical(F.col("u.body")), 256).alias("digest"))
        .join(_known(docs.sparkSession, known), "digest").where("m = 1 OR kind = 2")
        # A set for each place of a row: rows that repeat id and text find each place once.
        .groupBy("row_key", "kind", "license", "variant", "m", (F.col("at") - F.col("k")).alias("start"))
        .agg(F.collect_set(F.struct("k", "lines")).alias("parts")).where("size(parts) = m")
        .withColumn("lines", F.aggregate("parts", F.lit(0), lambda s, x: s + x["lines"]))
        .groupBy("row_key", "kind", "license", "start").agg(F.max("lines").alias("lines"))
        .groupBy("row_key")
        .agg(
            F.min(F.when(F.col("kind") == 0, F.col("license"))).alias("text_license"),
            F.array_join(F.array_sort(F.collect_set(F.when((F.col("kind") == 1) | block, F.col("license")))), ",").alias("licenses"),
            F.sum(F.when((F.col("kind") == 1) | block, F.col("lines")).otherwise(0)).alias("n_license_lines"),
        )
    )
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key")).join(found, "row_key", "left").select(
        "doc_id", "text_license", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines")
    )


def oracle() -> str:
    def sql(x: str) -> str:
        t = rf"regexp_replace(lower({x}), '(?m)^[^\n]*(copyright|\(c\)|©)[^\n]*$', ' ', 'g')"
        for a, b in SPELLINGS:
            t = f"replace({t}, '{a}', '{b}')"
        return rf"sha256(trim(regexp_replace({t}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '))"

    values = ", ".join("('{}', '{}')".format(k, body.replace("'", "''")) for k, body in KNOWN)
    return f"""
WITH known AS (SELECT min(license) AS license, digest FROM (SELECT license, {sql('body')} AS digest FROM (VALUES {values}) k(license, body)) GROUP BY digest),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS body FROM documents),
hit AS (SELECT l.doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(*) AS n FROM lines l JOIN known k ON k.digest = {sql('l.body')} GROUP BY l.doc_id),
whole AS (SELECT d.doc_id, k.license FROM documents d JOIN known k ON k.digest = {sql("coalesce(d.text, '')")})
SELECT d.doc_id, w.license AS text_license, coalesce(h.licenses, '') AS licenses, CAST(coalesce(h.n, 0) AS BIGINT) AS n_license_lines
FROM documents d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN whole w ON w.doc_id = d.doc_id
"""
