"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

A posting is (term, doc_id, positions): where a term stands in a training text. A test window of 13 words is looked
up from its rarest terms: the posting lists of the rarest ones are moved back by the term's offset in the item and
intersected, so that only (item, document, diagonal) triples seen from all of them remain, and the words of those
documents confirm the phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseam.llm.common import ascii_lower, maybe_broadcast, written

#: What separates words: all of ASCII but letters (lower case by then) and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: So many of a window's rarest terms are looked up in the index.
RAREST = 3
#: Candidates (document, item, diagonal), of 60 words each on average, up to which they are broadcast.
MOST_CANDIDATES = 20_000


def words(text: Column) -> Column:
    """Words of a text; null and word-less texts give an empty array."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def tokens(docs: DataFrame) -> DataFrame:
    """A row (doc_id, pos, term) for each word of each text."""
    return docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "term"))


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings (term, doc_id, positions ascending), written to the shared folder; terms: index only these.

    Null and empty texts have no postings. Rows that repeat a doc_id share its posting list, without repeats.
    """
    rows = tokens(docs)
    if terms is not None:
        rows = rows.join(maybe_broadcast(terms), "term", "left_semi")
    return written(rows.groupBy("term", "doc_id").agg(F.sort_array(F.collect_set("pos")).alias("positions")))


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct (item_id, w, at): the item's words and where each run of `size` of them, or of all of a shorter item, begins."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    return w.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - F.lit(size), F.lit(0)))).alias("at"))


def rarest_terms(docs: DataFrame, windows: DataFrame, size: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """windows with `rare`, the window's rarest terms as (n, p, term), rarest first, p counted from the item's start.

    Windows with a term that no text has are left out: they occur nowhere. Terms are counted over all texts.
    """
    terms = written(windows.select(F.explode("w").alias("term")).distinct().coalesce(1))
    counts = written(tokens(docs).join(maybe_broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n")))
    phrase = F.slice("w", F.col("at") + 1, size)
    each = windows.select("item_id", "w", "at", F.posexplode(phrase).alias("i", "term")).join(counts, "term")
    ranked = each.groupBy("item_id", "w", "at").agg(F.sort_array(F.collect_list(F.struct("n", (F.col("at") + F.col("i")).alias("p"), "term"))).alias("all"))
    return ranked.where(F.size("all") == F.least(F.size("w"), F.lit(size))).select("item_id", "w", "at", F.slice("all", 1, rarest).alias("rare"))


def phrase_hits(docs: DataFrame, items: DataFrame, size: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """Per document row: doc_id, n_words, hits: array of (item_id, start, length) of each exact window occurrence.

    Null or empty texts: no words and no hits. Exactly repeated rows each keep a result row. Rows without a doc_id
    can't be reported by the index and have no hits. Extra columns are ignored.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    windows = written(rarest_terms(docs, item_windows(items, size), size, rarest).coalesce(8))
    anchors = windows.select("item_id", F.explode("rare").alias("r")).select("item_id", "r.p", "r.term").distinct()
    index = build_index(docs, written(anchors.select("term").distinct().coalesce(1)))
    # Lists moved back by the term's place in the item: what lies on one diagonal may be one phrase.
    moved = index.join(anchors, "term").select("item_id", "doc_id", "p", F.explode("positions").alias("pos"))
    met = moved.groupBy("item_id", "doc_id", (F.col("pos") - F.col("p")).alias("diagonal")).agg(F.collect_set("p").alias("met"))
    needs = windows.groupBy("item_id", "w").agg(F.collect_list(F.struct("at", F.col("rare.p").alias("ps"))).alias("ws"))
    fits = F.filter("ws", lambda x: (F.size(F.array_except(x["ps"], "met")) == 0) & (F.col("diagonal") + x["at"] >= 0))
    found = met.join(needs, "item_id").select("item_id", "doc_id", "diagonal", "w", fits["at"].alias("ats")).where(F.size("ats") > 0)
    by_doc = written(found.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diagonal", "w", "ats")).alias("maybe")))
    length = lambda c: F.least(F.size(c["w"]), F.lit(size))
    same = lambda c, at: F.slice("words", c["diagonal"] + at + 1, length(c)) == F.slice(c["w"], at + 1, length(c))
    confirmed = F.transform("maybe", lambda c: F.transform(F.filter(c["ats"], lambda at: same(c, at)), lambda at: F.struct(c["item_id"].alias("item_id"), (c["diagonal"] + at).alias("start"), length(c).alias("length"))))
    # Candidates of few, short texts are broadcast; else the texts are shuffled by doc_id.
    n = by_doc.agg(F.coalesce(F.sum(F.size("maybe")), F.lit(0)), F.coalesce(F.sum(F.expr("aggregate(maybe, 0L, (a, c) -> a + size(c.w))")), F.lit(0))).first()
    small = F.broadcast(by_doc) if n[0] <= MOST_CANDIDATES and n[1] <= 60 * MOST_CANDIDATES else by_doc
    known = docs.join(small, "doc_id", "left").select("doc_id", words(F.col("text")).alias("words"), "maybe")
    return known.select("doc_id", F.size("words").cast("long").alias("n_words"), F.coalesce(F.flatten(confirmed), F.array()).alias("hits"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (at least a twentieth of its words hit)."""
    h = phrase_hits(docs, items)
    places = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1))))
    ids = F.sort_array(F.array_distinct(F.transform("hits", lambda x: x["item_id"].cast("string"))))
    out = h.select("doc_id", "n_words", F.size(places).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def proximity_matches(docs: DataFrame, items: DataFrame, slack: int = 5) -> DataFrame:
    """Pairs (item_id, doc_id, start): all words of the item stand, in any order, within its length + slack words.

    start is the first such place. Items of no words match nothing.
    """
    t = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    t = written(t.select("item_id", F.array_distinct("w").alias("terms"), (F.size("w") + slack).alias("span")))
    asked = t.select("item_id", "span", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    index = build_index(docs, written(asked.select("term").distinct().coalesce(1)))
    lists = asked.join(index, "term").groupBy("item_id", "doc_id", "span", "n").agg(F.collect_list(F.struct("term", "positions")).alias("l")).where(F.size("l") == F.col("n"))
    ends = F.transform("l", lambda x: F.filter(x["positions"], lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("span"))))
    starts = lists.select("item_id", "doc_id", "span", "l", F.explode(F.flatten(F.col("l.positions"))).alias("start"))
    return starts.where(F.forall(ends, lambda e: F.size(e) > 0)).groupBy("item_id", "doc_id").agg(F.min("start").alias("start"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[p:p + 12], ' ') AS s
       FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) u(p) WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, p, k.k AS k, array_to_string(w[p:p + k.k - 1], ' ') AS s FROM d, k, unnest(range(1, len(w) - k.k + 2)) u(p)),
h AS (SELECT DISTINCT dw.doc_id, dw.p, dw.k, iw.item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.k = iw.k),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
