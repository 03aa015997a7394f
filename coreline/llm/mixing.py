"""Mixing sources to target weights by Sainte-Laguë quotas of equal-word blocks.

Targets first: sources in code point order weigh 5, 2, 1, repeating, and share
the words of the table; no target passes three times its source's words, and
what a capped source leaves goes to the others by weight.

Every source is dealt, by a seeded hash, to shards of about ``shard_words``
words, however large the source.  Within a shard the documents stand in seeded
order on one line of words, cut into n equal blocks of about ``block_words``.
The shards of all sources compete for the blocks of the mix, whose number is
fixed before: the sum of all e, rounded, where e is the shard's part of its
source's target, in blocks.  The k-th block (from 0) of a shard has the quotient
e / (2k + 1); the highest quotients win, equal ones by a hash of the shard, and
no shard wins more than 3n blocks.

No list of all quotients is sorted.  Rounds of one aggregation each count the
quotients above some probes and narrow a bracket around the lowest one that
still wins, until at most ``MOST_RANKED`` are inside; only these are ranked.
The result is a pair (quotient, hash) that every shard compares its own
quotients with, so the quotas need no join.

A shard with quota q takes each of its n blocks q div n times, and the q mod n
blocks from a seeded one on (around the line's end) once more.  As documents
stand in seeded order, that run is a random choice of them, and it cuts two
documents a shard at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coreline.llm.common import WORD, frozen
from coreline.operators.joins import broadcast_checked

WEIGHTS = (5, 2, 1)
MOST = 3
SHARD_WORDS = 1 << 18
BLOCK_WORDS = 16
SEED = "mix"
#: As many quotients are ranked in one task at most.
MOST_RANKED = 1 << 17
PROBES = 32
#: Parts of a block that expected blocks are summed in, so that their sum is exact.
PARTS = 1_000_000


def n_words(text: Column) -> Column:
    """Words of a text; none for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(seed: str, *parts: Column) -> Column:
    """A number below 2**32 from an MD5 of the parts."""
    named = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``__source, __words, __target`` of every source, from rows of ``__source, __size``.

    One row for each source: they are ordered, and their weights and caps summed,
    in one small task.
    """
    big = "decimal(38,0)"
    totals = sizes.groupBy("__source").agg(F.sum("__size").alias("__words"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("__source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    rows = totals.select("__source", "__words", weight.cast("long").alias("w"), (F.col("__words") * MOST).alias("cap"), rank.alias("r"))
    rows = rows.withColumn("all", F.sum("__words").over(Window.partitionBy()))
    # sources fill up in the order of cap / weight
    fill = Window.orderBy(F.col("cap") / F.col("w"), "r")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.select(
        "*",
        (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        F.sum("w").over(onward).alias("w_left"),
        F.row_number().over(fill).alias("i"),
    )
    free = F.col("cap").cast("decimal(20,0)") * F.col("w_left").cast("decimal(17,0)") >= F.col("left").cast(
        "decimal(20,0)"
    ) * F.col("w").cast("decimal(17,0)")
    first = F.min(F.when(free, F.struct("i", "left", "w_left"))).over(Window.partitionBy())
    rows = rows.withColumn("first", first)
    shared = (F.col("first.left").cast(big) * F.col("w")).cast("double") / F.col("first.w_left").cast("double")
    target = F.when(F.col("i") >= F.col("first.i"), shared).otherwise(F.col("cap").cast("double"))
    return rows.select("__source", "__words", target.alias("__target"))


def _reaching(e: Column, most: Column, low: Column | float, above: bool = False) -> Column:
    """How many of the quotients e / (2k + 1), k < ``most``, are at least ``low`` (or above it)."""
    low = F.lit(low) if isinstance(low, float) else low
    wins = (lambda k: e / (2 * k + 1) > low) if above else (lambda k: e / (2 * k + 1) >= low)
    # the division may be off by one place; the quotients themselves decide
    near = F.floor(F.least((e / low + 1) / 2, most.cast("double")))
    more = F.when(wins(near), 1).otherwise(0)
    fewer = F.when((near > 0) & ~wins(near - 1), 1).otherwise(0)
    return F.least(near + more - fewer, most)


def lowest_winner(shards: DataFrame, most_ranked: int = MOST_RANKED) -> tuple[float, str] | None:
    """Quotient and tie of the last block that wins, from rows of ``e, most, tie``.

    None where there is no block to win.  Blocks are ordered by falling quotient,
    then by rising ``tie``, which no two shards share.
    """
    parts = F.sum(F.floor(F.col("e") * PARTS).cast("decimal(38,0)"))
    shards = shards.where("e > 0")
    all_parts, top = shards.agg(parts, F.max("e")).first()
    seats = (int(all_parts or 0) + PARTS // 2) // PARTS
    if not seats:
        return None
    e, most = F.col("e"), F.col("most")
    # quotients from high on are too few, those from low on enough
    low, high, few, enough = 0.0, 2 * top, 0, math.inf
    probes = [0.5 + side * 0.5**j for j in range(2, PROBES // 2) for side in (-1, 1)]
    while enough - few > most_ranked:
        probes = sorted({p for p in probes if low < p < high})
        if not probes:
            if math.nextafter(low, high) >= high:
                break
        else:
            counts = shards.agg(*[F.sum(_reaching(e, most, p)) for p in probes]).first()
            for p, n in zip(probes, counts, strict=True):
                if n >= seats:
                    low, enough = p, n
                else:
                    high, few = p, n
                    break
        base = low or high * 2.0**-40
        step = (high / base) ** (1 / PROBES) if high > 2 * base else None
        probes = [base * step**i if step else base + (high - base) * i / PROBES for i in range(PROBES)]
        probes += [math.nextafter(low, high)] if low else []
    inside = F.explode(F.sequence(_reaching(e, most, high), _reaching(e, most, low) - 1))
    blocks = shards.where(_reaching(e, most, low) > _reaching(e, most, high)).select("tie", "e", inside.alias("k"))
    blocks = blocks.select("tie", (e / (2 * F.col("k") + 1)).alias("quotient"))
    left, size, head = seats - few, enough - few, 0
    while size > most_ranked and head < 32:
        # all inside have one quotient: count by the beginning of the tie
        head += 3
        counts = blocks.groupBy(F.substring("tie", 1, head).alias("head")).count().orderBy("head").collect()
        for start, size in counts:
            if left <= size:
                blocks = blocks.where(F.col("tie").startswith(start))
                break
            left -= size
    return tuple(blocks.orderBy(F.desc("quotient"), "tie").offset(left - 1).limit(1).first()[::-1])


def blocks_won(e: Column, most: Column, tie: Column, last: tuple[float, str] | None) -> Column:
    """Blocks of a shard that stand no later than the last one that wins."""
    if last is None:
        return F.lit(0).cast("long")
    quotient, name = last
    above, reach = _reaching(e, most, quotient, above=True), _reaching(e, most, quotient)
    won = F.when(tie <= name, reach).otherwise(above)
    return F.when(e > 0, won).otherwise(0).cast("long")


def mix(
    docs: DataFrame,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
    seed: str = SEED,
    sizes: DataFrame | None = None,
    most_ranked: int = MOST_RANKED,
) -> DataFrame:
    """``docs`` (with ``__size``, and any other columns) with what the mix takes of each row.

    Adds ``__words`` and ``__target`` of the row's source, ``__taken`` (words, repeats
    counted), ``__times`` (whole copies) and ``__cuts``: up to two further ranges of
    the row's words, as ``from, to`` structs.  ``sizes`` are the rows'
    ``doc_id, source, __size``, where they are written already.

    NULL is a source of its own, the last one.  A row without words takes no part
    and is taken 0 words; a source without words has target 0.  Rows that repeat a
    doc_id stand beside each other on their line, each with its own words.  The
    same rows give the same result on every run; an empty table gives no rows.
    """
    if sizes is None:
        sizes = frozen(docs.select("doc_id", "source", "__size"), "mix-sizes")
    named = sizes.select("doc_id", F.col("source").cast("string").alias("__source"), "__size")
    # a row for each source
    targets = frozen(source_targets(named), "mix-targets").withColumnRenamed("__source", "__of")
    side = broadcast_checked(targets, ["__of", "__words", "__target"])
    key = ["__source", "__shard"]

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.join(side, F.col("__source").eqNullSafe(F.col("__of"))).drop("__of")
        shards = F.greatest(F.lit(1), F.ceil(F.col("__words") / shard_words))
        return rows.withColumn("__shard", _draw(f"{seed}-shard", F.col("doc_id")) % shards)

    blocks = F.greatest(F.lit(1), F.expr(f"(__line + {block_words // 2}) div {block_words}"))
    e = F.when(F.col("__words") > 0, F.col("__target") * F.col("__blocks") / F.col("__words"))
    source = F.coalesce(F.concat(F.lit("="), F.col("__source")), F.lit("null"))
    tie = F.md5(F.concat_ws(":", F.lit(f"{seed}-tie"), source, F.col("__shard").cast("string")))
    most = F.col("__blocks") * MOST
    lines = dealt(named).groupBy(*key, "__words", "__target").agg(F.sum("__size").alias("__line"))
    lines = lines.where("__words > 0").withColumn("__blocks", blocks)
    parties = frozen(lines.select(e.alias("e"), most.alias("most"), tie.alias("tie")), "mix-shards")
    last = lowest_winner(parties, most_ranked)

    rows = dealt(docs.withColumn("__source", F.col("source").cast("string")))
    line = Window.partitionBy(*key).orderBy(_draw(f"{seed}-order", F.col("doc_id")), "doc_id", "__size")
    rows = rows.select(
        "*",
        F.sum("__size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("__end"),
        F.sum("__size").over(Window.partitionBy(*key)).alias("__line"),
    )
    rows = rows.withColumn("__blocks", blocks)
    rows = rows.withColumn("__quota", blocks_won(e, most, tie, last))
    rows = rows.withColumns(
        {
            "__times": F.expr("__quota div __blocks"),
            "__more": F.expr("__quota % __blocks"),
            "__first": _draw(f"{seed}-start", *map(F.col, key)) % F.col("__blocks"),
        }
    )
    edge = "({} * __line) div __blocks"
    ranges = {
        "__run": (edge.format("__first"), edge.format("least(__first + __more, __blocks)")),
        "__wrap": ("0", edge.format("greatest(__first + __more - __blocks, 0)")),
    }
    size, begin = F.col("__size"), F.col("__end") - F.col("__size")
    cuts = {}
    for name, (low, high) in ranges.items():
        start = F.least(F.greatest(F.expr(low) - begin, F.lit(0)), size)
        stop = F.greatest(F.least(F.expr(high) - begin, size), start)
        cuts[name] = F.struct(start.cast("long").alias("from"), stop.cast("long").alias("to"))
    rows = rows.withColumn("__cuts", F.filter(F.array(*cuts.values()), lambda c: c["from"] < c["to"]))
    extra = F.aggregate("__cuts", F.lit(0).cast("long"), lambda a, c: a + c["to"] - c["from"])
    rows = rows.withColumn("__taken", (F.col("__times") * size + extra).cast("long"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*names, "__words", "__target", "__taken", "__times", "__cuts")


def mix_report(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and ``source`` of every document."""
    sizes = frozen(docs.select("doc_id", "source", n_words(F.col("text")).alias("__size")), "mix-sizes")
    return mix(sizes, sizes=sizes, **settings).select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__words").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__taken").alias("taken"),
        "source",
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each copy that it takes.

    A document that a run of blocks cuts gives the words inside the run, with the
    white space between and behind them; ``n_chars``, where there is one, follows.
    """
    # the input travels as one struct, so that no name of its own can clash
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("__size"), F.struct("*").alias("__doc"))
    own = F.col("__doc")
    whole = F.when(F.col("__size") > 0, F.struct(F.lit(0).cast("long").alias("from"), F.col("__size").alias("to")))
    ranges = F.concat(F.array_repeat(whole, F.col("__times").cast("int")), F.col("__cuts"))
    rows = mix(sized, **settings).where("__taken > 0").withColumn("__range", F.explode(ranges))
    low, high = F.col("__range.from"), F.col("__range.to")
    pieces = F.split(F.regexp_replace(own["text"], r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    some = F.concat_ws("", F.slice(pieces, (low + 1).cast("int"), (high - low).cast("int")))
    text = F.when(high - low == F.col("__size"), own["text"]).otherwise(some)
    rows = rows.withColumn("__text", text)
    new = {"text": F.col("__text"), "n_chars": F.char_length("__text").cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else own[c].alias(c) for c in docs.columns])


def _draw_sql(seed: str, *parts: str) -> str:
    named = " || ':' || ".join([f"'{seed}'", *[f"coalesce(CAST({p} AS VARCHAR), 'null')" for p in parts]])
    return f"CAST('0x' || substr(md5({named}), 1, 8) AS BIGINT)"


ORACLE = f"""
WITH sizes AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS words,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS r
  FROM sizes GROUP BY source
), filled AS (
  SELECT *, 3 * words AS cap,
         sum(words) OVER () - coalesce(sum(3 * words) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest,
         row_number() OVER f AS i
  FROM sources WINDOW f AS (ORDER BY CAST(3 * words AS DOUBLE) / w, r)
), fixed AS (
  SELECT *, min(i) FILTER (cap * w_rest >= rest * w) OVER () AS at FROM filled
), targets AS (
  SELECT f.source, CAST(f.words AS BIGINT) AS words,
         CASE WHEN f.i >= f.at THEN CAST(g.rest * f.w AS DOUBLE) / CAST(g.w_rest AS DOUBLE)
              ELSE CAST(f.cap AS DOUBLE) END AS target
  FROM fixed AS f JOIN fixed AS g ON g.i = f.at
), dealt AS (
  SELECT s.*, t.words, t.target,
         {_draw_sql(SEED + "-shard", "doc_id")} % greatest(1, CAST(ceil(t.words / {SHARD_WORDS}.0) AS BIGINT)) AS shard,
         {_draw_sql(SEED + "-order", "doc_id")} AS place
  FROM sizes AS s JOIN targets AS t ON s.source IS NOT DISTINCT FROM t.source
), lines AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source, shard ORDER BY place, doc_id, size
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS a,
         CAST(sum(size) OVER (PARTITION BY source, shard) AS BIGINT) AS line
  FROM dealt
), blocks AS (
  SELECT *, greatest(1, (line + {BLOCK_WORDS // 2}) // {BLOCK_WORDS}) AS n FROM lines
), parties AS (
  SELECT DISTINCT source, shard, n, target * n / words AS e,
         md5('{SEED}-tie:' || coalesce('=' || source, 'null') || ':' || CAST(shard AS VARCHAR)) AS tie
  FROM blocks WHERE words > 0
), quotients AS (
  SELECT source, shard, row_number() OVER (ORDER BY e / (2 * k + 1) DESC, tie) AS place
  FROM (SELECT *, unnest(range({MOST} * n)) AS k FROM parties WHERE e > 0)
), won AS (
  SELECT source, shard, count(*) AS q FROM quotients
  WHERE place <= (SELECT (sum(CAST(floor(e * {PARTS}) AS HUGEINT)) + {PARTS // 2}) // {PARTS} FROM parties)
  GROUP BY source, shard
), quotas AS (
  SELECT b.*, coalesce(w.q, 0) AS q, {_draw_sql(SEED + "-start", "b.source", "b.shard")} % n AS s
  FROM blocks AS b LEFT JOIN won AS w ON b.source IS NOT DISTINCT FROM w.source AND b.shard = w.shard
), runs AS (
  SELECT *, (s * line) // n AS x1, (least(s + q % n, n) * line) // n AS y1,
         (greatest(s + q % n - n, 0) * line) // n AS y2
  FROM quotas
)
SELECT doc_id, size, words AS source_size, target,
       CAST((q // n) * size + greatest(0, least(y1, a + size) - greatest(x1, a))
            + greatest(0, least(y2, a + size) - a) AS BIGINT) AS taken,
       source
FROM runs
"""
