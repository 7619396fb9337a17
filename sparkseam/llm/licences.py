"""Licence scan: canonical digests of whole texts and of their lines, hash-joined to known licences; DataFrame operations only."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseam.llm.common import UPPER, ascii_lower
from sparkseam.llm.licence_digests import DIGESTS
from sparkseam.llm.licence_texts import SPELLINGS, STATEMENTS, TEXTS

#: A line that names the owner: copyright or its sign before a sign, a year, a place to fill in, or "by"; not a line of wording
#: that begins with "copyright notice" or with item (c).
OWNER = r"\n[ \t]*(?:©|&copy;|copyright[ \t:,]*(?:\(c\)|©|&copy;|[12][0-9]{3}|[\[<{]|by[ \t])|\(c\)[ \t:,]*(?:copyright|[12][0-9]{3}|[\[<{]|by[ \t]))[^\n]*"
#: The pattern of ORACLE_SQL, which has no such distinction: a text with a line of wording that begins so has another digest there.
SQL_OWNER = r"\n[ \t]*(?:copyright|\(c\)|©)[^\n]*"
#: What becomes a space: all but letters, digits and line ends.
PUNCTUATION = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """A text in lower case (A-Z), without owner lines, in one spelling, with single spaces for punctuation; lines stay."""
    c = F.regexp_replace(F.concat(F.lit("\n"), ascii_lower(F.coalesce(text, F.lit("")))), OWNER, "")
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, PUNCTUATION, " ")


#: Spellings of several words, which a line end can part.
PARTED = tuple((a, b) for a, b in SPELLINGS if " " in a)


def whole(lines: Column) -> Column:
    c = F.trim(F.regexp_replace(lines, "[ \n]+", " "))
    for a, b in PARTED:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def canonical(text: str) -> str:
    """canonical_lines() and whole() of one known text, for building the table of digests."""
    t = re.sub(OWNER, "", "\n" + text.translate(str.maketrans(UPPER, UPPER.lower())))
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    t = " ".join(re.sub(r"[^\w\n]|_", " ", t).split())
    for a, b in PARTED:
        t = t.replace(a, b)
    return t


def known(whole_text: bool) -> list[tuple[str, str]]:
    """(digest, licence) of the licence texts, and for lines of the statements."""
    return sorted({(hashlib.sha256(canonical(t).encode()).hexdigest(), name) for name, t in (TEXTS if whole_text else STATEMENTS)})


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_sha256 (canonical digest of the whole text), license (of a text that is one as a whole, a
    statement alone included; else null), statements (licences that its lines state, sorted, comma-joined, "" if none), n_statements
    (lines that state one).

    Null and empty texts have the digest of the empty text and no licence. The known digests are a list in this
    package, of under a hundred rows, so that the broadcast has a fixed bound. Statement lines are counted per doc_id: rows that
    share a doc_id share them; a row without one has none. Extra columns are ignored.
    """
    spark = docs.sparkSession
    table = lambda rows, *names: F.broadcast(spark.sql(f"SELECT * FROM VALUES {str(rows)[1:-1]} AS t({', '.join(names)})"))
    base = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    texts = base.select("doc_id", F.sha2(whole(F.col("lines")), 256).alias("text_sha256"))
    texts = texts.join(table(sorted(dict(known(True) + known(False) + list(DIGESTS)).items()), "text_sha256", "license"), "text_sha256", "left")
    line = base.where("doc_id IS NOT NULL").select("doc_id", F.explode(F.split("lines", "\n")).alias("line"))
    stated = line.select("doc_id", F.sha2(F.trim("line"), 256).alias("digest")).join(table(known(False), "digest", "stated"), "digest")
    stated = stated.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("stated")), ",").alias("statements"), F.count("*").alias("n_statements"))
    out = texts.join(stated, "doc_id", "left")
    return out.select("doc_id", "text_sha256", "license", F.coalesce("statements", F.lit("")).alias("statements"), F.coalesce("n_statements", F.lit(0)).alias("n_statements"))


def _sql() -> str:
    base = f"regexp_replace(chr(10) || translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{SQL_OWNER}', '', 'g')"
    for a, b in SPELLINGS:
        base = f"replace({base}, '{a}', '{b}')"
    values = lambda rows: ", ".join(f"('{d}', '{n}')" for d, n in rows)
    return rf"""
WITH b AS (SELECT doc_id, regexp_replace({base}, '[^\pL\pN\n]+', ' ', 'g') AS lines FROM documents),
w(digest, license) AS (VALUES {values(sorted(dict(known(True) + known(False)).items()))}),
k(digest, stated) AS (VALUES {values(known(False))}),
t AS (SELECT doc_id, sha256(trim(regexp_replace(lines, '[ \n]+', ' ', 'g'))) AS text_sha256 FROM b),
s AS (SELECT doc_id, sha256(trim(unnest(string_split(lines, chr(10))))) AS digest FROM b),
m AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT stated)), ',') AS statements, count(*) AS n FROM s JOIN k USING (digest) GROUP BY doc_id)
SELECT doc_id, text_sha256, license, coalesce(statements, '') AS statements, coalesce(n, 0) AS n_statements
FROM t LEFT JOIN w ON digest = text_sha256 LEFT JOIN m USING (doc_id)"""


ORACLE_SQL = _sql()
