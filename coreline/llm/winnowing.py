"""Document fingerprints by winnowing, in built-in expressions.

Every ``gram`` words in a row have a hash.  From every ``window`` hashes in a row
the smallest is chosen, the rightmost one on ties; the chosen hashes and their
word positions are the fingerprint.  Two texts that share at least
``gram + window - 1`` words in a row share a chosen hash there.  A run of more
than 16 characters without white space counts as several words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coreline.llm.common import shares, text_bytes

GRAM = 5
WINDOW = 6
PART_BYTES = 8 << 20
_UNIT = r"[^\x20\x09-\x0D]{1,16}"
#: Low bits of a sort key hold the position, counted down so that ties go right.
_PLACE = (1 << 31) - 1


def _hashes(words: Column, gram: int) -> Column:
    """Hashes of all runs of ``gram`` words; a shorter text has one, of all its words."""
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - gram, F.lit(0)))
    every = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(gram)]))
    return F.when(F.size(words) > 0, every).otherwise(F.array().cast("array<bigint>"))


def _smallest(keys: Column, window: int) -> Column:
    """Minimum of every ``window`` neighbours (of all, where there are fewer), by doubling."""
    n = F.size(keys)
    span, out = 1, keys
    while span < window:
        step = min(span, window - span)
        count = F.greatest(n - (span + step) + 1, F.lit(1))
        behind = F.slice(out, F.lit(step + 1), count)
        out = F.zip_with(F.slice(out, F.lit(1), count), behind, lambda a, b: F.least(a, b))
        span += step
    return F.when(n < window, F.array(F.array_min(keys))).otherwise(out)


def with_fingerprint(df: DataFrame, text: str, hashes: str, places: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add the chosen hashes of a text column and their positions, in text order."""
    rows = df.withColumn("__words", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_UNIT), F.lit(0)))
    rows = rows.withColumn("__grams", _hashes(F.col("__words"), gram)).drop("__words")
    key = F.transform(
        "__grams",
        lambda h, i: h.bitwiseAND(F.lit(~_PLACE)).bitwiseOR((F.lit(_PLACE) - i).cast("long")),
    )
    rows = rows.withColumn("__keys", key)
    chosen = F.when(F.size("__grams") > 0, F.array_distinct(_smallest(F.col("__keys"), window)))
    chosen = F.coalesce(chosen, F.array().cast("array<bigint>"))
    rows = rows.withColumn(
        places, F.transform(chosen, lambda v: (F.lit(_PLACE) - v.bitwiseAND(F.lit(_PLACE))).cast("int"))
    )
    rows = rows.withColumn(hashes, F.transform(places, lambda p: F.get("__grams", p)))
    return rows.drop("__grams", "__keys")


def as_text(hashes: str, places: str) -> Column:
    """A fingerprint as text: ``hash@position``, hashes in hexadecimal."""
    each = F.zip_with(hashes, places, lambda h, p: F.concat(F.lower(F.hex(h)), F.lit("@"), p.cast("string")))
    return F.array_join(each, " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two lists of hashes; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(common / union)


def _part(docs: DataFrame, parts: int) -> Column:
    """Number of the doc_id range of a row; larger ids come first."""
    quantiles = [i / parts for i in range(1, parts)]
    bounds = docs.agg(F.percentile_approx("doc_id", quantiles, 10 * parts)).first()[0] if quantiles else None
    edges = sorted(set(bounds or []))
    if not edges:
        return F.lit(0)
    # two short scans instead of one long one
    width = max(1, int(len(edges) ** 0.5))
    coarse = F.array(*[F.lit(int(e)).cast("long") for e in edges[::width]])
    fine = F.array(*[F.lit(int(e)).cast("long") for e in edges])
    skip = F.greatest(F.size(F.filter(coarse, lambda e: e < F.col("doc_id"))) - 1, F.lit(0)) * width
    near = F.slice(fine, skip + 1, F.lit(width + 1))
    below = skip + F.size(F.filter(near, lambda e: e < F.col("doc_id")))
    return F.coalesce(F.lit(len(edges)) - below, F.lit(len(edges) + 1)).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text``: each document and the one behind it, by falling doc_id.

    Documents are dealt once, to ranges of doc_id; the next text is the next row of
    the range, or the first row of the next range, of which there is one a range.
    The first document follows the last.  NULL ids come last, rows of one doc_id
    stand in the order of their texts, and a NULL text counts as empty.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = shares(text_bytes(docs), PART_BYTES)
    dealt = docs.withColumn("part", _part(docs, parts)).repartition(max(parts, 2), "part")
    order = Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), "text")
    rows = dealt.select("*", F.lead("text").over(order).alias("follows"))
    heads = dealt.select("part", "text", F.row_number().over(order).alias("i")).where("i = 1").drop("i")
    ranges = heads.select("part")
    line = Window.orderBy("part")
    before = ranges.select(
        "part", F.coalesce(F.lag("part").over(line), F.max("part").over(Window.partitionBy())).alias("before")
    )
    first = heads.join(before, "part").select(F.col("before").alias("part"), F.col("text").alias("head"))
    return rows.join(first, "part").select("doc_id", "text", F.coalesce("follows", "head").alias("next_text"))


def fingerprint_report(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses.

    The edited text has its last floor(n_chars / 2) characters replaced by as many
    of the first characters of the next document (all, if it has fewer).  Columns:
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``.  Texts without words have the empty fingerprint; two such texts
    have likeness 1.  See :func:`with_next` for ties and missing values; further
    columns are ignored, an empty table gives no rows.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")),
        F.substring(F.col("next_text"), F.lit(1), half),
    )
    rows = rows.withColumn("edited", edited)
    for text, name in (("text", "own"), ("edited", "new"), ("next_text", "next")):
        rows = with_fingerprint(rows, text, f"{name}_hashes", f"{name}_places", gram, window)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("own_hashes", "own_places").alias("fingerprint"),
        as_text("new_hashes", "new_places").alias("edited_fingerprint"),
        likeness("own_hashes", "new_hashes").alias("near_edited"),
        likeness("own_hashes", "next_hashes").alias("near_next"),
    )
