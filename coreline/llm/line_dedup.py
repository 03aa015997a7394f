"""Removal of repeated runs of lines by overlapping three-line windows.

Every three consecutive lines of a text are one window, named by two 64-bit
hashes.  The first occurrence of a window in the table, by (doc_id, position),
stays; the lines under every later occurrence go.  Windows overlap, so a longer
repeated run is covered as a whole.  Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coreline.llm.common import frozen

HAS_WORD = r"[^\x20\x09-\x0D]"
_KEY = ["__id", "__text_hash"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__id": F.col("doc_id"), "__text_hash": F.xxhash64("text")})


def line_windows(docs: DataFrame) -> DataFrame:
    """``__id, __text_hash, pos, h1, h2`` of every three-line window that has a word."""
    lines = F.col("lines")
    rows = _keyed(docs.select("doc_id", "text")).select(*_KEY, _lines(F.col("text")).alias("lines"))
    triples = F.arrays_zip(
        lines.alias("a"),
        F.slice(lines, 2, F.size(lines)).alias("b"),
        F.slice(lines, 3, F.size(lines)).alias("c"),
    )
    each = rows.where(F.size("lines") > 2).select(*_KEY, F.posexplode(triples).alias("pos", "w"))
    each = each.select(*_KEY, "pos", "w.*").where(F.col("c").isNotNull())
    wordy = F.rlike(F.concat("a", "b", "c"), F.lit(HAS_WORD))
    return each.where(wordy).select(
        *_KEY, "pos", F.xxhash64("a", "b", "c").alias("h1"), F.xxhash64("c", "a", "b").alias("h2")
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__n_lines``, ``__n_removed`` and ``__kept``, the text without repeated runs.

    Lines end at ``\\n``.  A window without any word counts as no repeat, and a
    text of fewer than three lines has no window.  A window's first occurrence
    is the one with the smallest (doc_id, text hash, position), NULL doc_id
    first; rows that repeat both doc_id and text are one document and get the
    same result.  A NULL text has no lines and stays NULL, an empty one has one
    empty line.  Other columns are kept; an empty table stays empty.
    """
    windows = frozen(line_windows(docs), "line-windows")
    here = F.struct(*_KEY, "pos")
    first = windows.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    first = first.where("first < last").drop("last")
    # one row a window on the right; a hot window's rows on the left are split by adaptive execution
    later = windows.join(first, ["h1", "h2"]).where(here > F.col("first"))
    covered = later.groupBy(*_KEY).agg(
        F.array_distinct(
            F.flatten(F.transform(F.collect_set("pos"), lambda p: F.array(p, p + 1, p + 2)))
        ).alias("__covered")
    ).select(F.col("__id").alias("__cid"), F.col("__text_hash").alias("__chash"), "__covered")
    joined = _keyed(docs).join(
        covered,
        F.col("__id").eqNullSafe(F.col("__cid")) & (F.col("__text_hash") == F.col("__chash")),
        "left",
    )
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text"))))
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("__covered"))
    split = joined.withColumn("__lines", F.when(F.col("__covered").isNotNull(), _lines(F.col("text"))))
    kept = F.when(
        F.col("__covered").isNotNull(),
        F.concat_ws("\n", F.transform(stay, lambda i: F.get("__lines", i))),
    ).otherwise(F.col("text"))
    out = split.withColumns(
        {
            "__n_lines": n_lines.cast("long"),
            "__n_removed": F.when(F.col("__covered").isNull(), 0).otherwise(F.size("__covered")).cast("long"),
            "__kept": kept,
        }
    )
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "__n_lines", "__n_removed", "__kept")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` in its own columns, with the shortened texts (and ``n_chars``, where there is one)."""
    found = dedup_lines(docs)
    new = {"text": F.col("__kept"), "n_chars": F.char_length("__kept").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
WITH lined AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), windows AS (
  SELECT doc_id, text, pos - 1 AS pos, lines[pos] AS a, lines[pos + 1] AS b, lines[pos + 2] AS c
  FROM (SELECT *, unnest(range(1, len(lines) - 1)) AS pos FROM lined WHERE len(lines) > 2)
), named AS (
  SELECT *, min((doc_id, pos)) OVER (PARTITION BY a, b, c) AS first
  FROM windows WHERE regexp_matches(a || b || c, '[^\\x20\\x09-\\x0D]')
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos
  FROM (SELECT doc_id, pos, unnest([0, 1, 2]) AS k FROM named WHERE (doc_id, pos) > first)
), lines AS (
  SELECT doc_id, pos - 1 AS pos, lines[pos] AS line
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS pos FROM lined)
), texts AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
         string_agg(line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL) AS kept
  FROM lines AS l LEFT JOIN covered AS c ON l.doc_id = c.doc_id AND l.pos = c.pos
  GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS kept_text
FROM documents AS d LEFT JOIN texts AS t ON d.doc_id = t.doc_id
"""
