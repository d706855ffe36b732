"""Line dedup: lines that spread over many sites are boilerplate; each stays only where it first appears.

A line's spread is the number of distinct sites it is on. A HyperLogLog sketch for each line hash, merged by
aggregation, estimates it; lines whose estimate is near the threshold get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, stored

#: Distinct sites from which a line is boilerplate.
SITES = 10
#: log2 of a sketch's buckets, and the relative error of its estimate that is taken as possible (over six deviations).
LG_K, MARGIN = 12, 0.1
#: The column that cleaned() adds last; where docs has one of that name, it is called the same with one more underscore.
REMOVED = "_lines_removed"


def _place() -> Column:
    """Of a line: by doc_id, then by pos; rows without a doc_id last, told apart by their text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), "_text").alias("doc"), "pos")


def lines(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: doc_id, _text (the text's hash), site, pos, and the trimmed line's hashes."""
    texts = docs.where("text is not null").select(
        "doc_id", F.xxhash64("text").alias("_text"), F.col("source").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    line = F.regexp_replace("line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    rows = texts.select("doc_id", "_text", "site", "pos", line.alias("line")).where("line <> ''")
    return rows.select("doc_id", "_text", "site", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def boilerplate(found: DataFrame, sites: int = SITES) -> DataFrame:
    """h1, h2 of each line on at least `sites` sites, and its first place: the smallest _place()."""
    site = F.coalesce(F.concat(F.lit("s"), F.col("site")), F.lit("-"))
    sketched = (
        found.groupBy("h1", "h2")
        .agg(F.hll_sketch_agg(site, LG_K).alias("sketch"), F.min(_place()).alias("first"), F.count("*").alias("n"))
        .where(F.col("n") >= sites)
        .withColumn("spread", F.hll_sketch_estimate("sketch"))
        .drop("sketch")
    )
    sketched = stored(sketched.where(F.col("spread") >= sites * (1 - MARGIN) - 1))
    near = F.col("spread") <= sites * (1 + MARGIN) + 1
    exact = (
        found.join(sketched.where(near).select("h1", "h2"), ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2")
        .agg(F.count_distinct(site).alias("sites"))
        .where(F.col("sites") >= sites)
    )
    sure = sketched.where(~near).select("h1", "h2", "first")
    return sure.unionByName(sketched.where(near).join(exact, ["h1", "h2"]).select("h1", "h2", "first"))


def removals(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """doc_id, _text and _gone (0-based places of the lines to remove) of the documents that lose a line."""
    found = lines(docs)
    known = stored(boilerplate(found, sites))
    hits = found.join(known, ["h1", "h2"]).where(_place() != F.col("first"))
    return hits.groupBy("doc_id", "_text").agg(F.collect_set("pos").alias("_gone"))


def cleaned(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """docs with the text that is left, and as last column _lines_removed.

    A boilerplate line stays in the document with the smallest doc_id that has it, at its first place there.
    A text of which no line is left is empty; a null text stays null, and lines without a word are never
    removed. A null source is a site of its own. Rows without a doc_id come after all others and are told apart
    by their text. Repeated rows are treated alike; an empty table gives an
    empty one; other columns are kept.
    """
    gone = removals(docs, sites).withColumnsRenamed({"doc_id": "_id", "_text": "_hash"})
    rows = packed(docs, F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_own"))
    joined = rows.join(gone, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left")
    text = F.col("_row")["text"]
    # linear in the lines: the places that stay, by hashing, then the lines at them
    stay = F.array_except(F.sequence(F.lit(0), F.size(F.split(text, "\n")) - 1), F.col("_gone"))
    left = F.transform(F.array(F.split(text, "\n")), lambda ls: F.array_join(F.transform(stay, lambda i: F.get(ls, i)), "\n"))[0]
    text = F.when(F.col("_gone").isNull(), text).otherwise(left)
    own = [text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]
    removed = REMOVED
    while removed in docs.columns:
        removed = "_" + removed
    return joined.select(*own, F.coalesce(F.array_size("_gone"), F.lit(0)).alias(removed))


def line_dedup(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars and text_sha256 of each row of docs after cleaned(); a null text counts as empty."""
    rows = cleaned(docs.select("doc_id", "source", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines")), sites)
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"),
        F.col(REMOVED).cast("long").alias("n_removed"),
        F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, '-') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), x AS (
  SELECT doc_id, site, unnest(ls) AS raw, generate_subscripts(ls, 1) AS pos FROM d
), l AS (
  SELECT *, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM x
), b AS (
  SELECT line, min([doc_id, pos]) AS first FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10
), k AS (
  SELECT l.doc_id, l.pos, l.raw, b.line IS NOT NULL AND [l.doc_id, l.pos] <> b.first AS gone FROM l LEFT JOIN b ON l.line = b.line
), t AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM k GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, length(text) AS n_chars, sha256(text) AS text_sha256 FROM t
"""
