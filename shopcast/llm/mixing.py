"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

A document's size is its number of words.  Sources in code-point order (null
last) weigh 3, 1, 2, repeating; they share ``SHARE`` times all sizes by weight,
but no source gets more than ``REPEAT`` times its own size, the excess being
shared by weight among the others (water-filling, solved in closed form over
one row per source).

The schedule of a source over training time t in [0, 1] is
``target * (1 + slope * (2 t - 1))``; its integral ``target * (t + slope * (t*t - t))``
is the source's cumulative demand.  Documents are laid end to end in the order
of a hash of their ids, then once more for repeats; a document (occurrence)
whose words end before the demand is taken whole, the one across it in part.
Inverting the demand at the middle of what is taken gives the training position.

Running sums go over (source, first three digits of the hash): 4,096 pieces of
every source, so a source with a third of all rows is 4,096 small windows and
one sum over their totals.

Defined cases: a null or empty text has size zero and is never taken; equal
rows are interchangeable; a null source is a source of its own.  Extra columns
are kept by ``mixed`` and ignored by ``allotted``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

SHARE, REPEAT = 1.5, 2
WEIGHTS = (3, 1, 2)
SLOPES = (0.5, -0.5, 0.0)     # of the sources in turn: early less, early more, even
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _in_turn(rank: Column, values: tuple) -> Column:
    out = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        out = F.when(F.pmod(rank, F.lit(len(values))) == i, F.lit(v)).otherwise(out)
    return out


def targets(totals: DataFrame) -> DataFrame:
    """(no_source, source_key, source_size, weight, slope, target) from one row of totals per source."""
    order = Window.orderBy("no_source", "source_key")
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    ranked = totals.withColumn("rank", F.row_number().over(order) - 1)
    ranked = (ranked.withColumn("weight", _in_turn(F.col("rank"), WEIGHTS).cast("long"))
              .withColumn("slope", _in_turn(F.col("rank"), SLOPES))
              .withColumn("cap", F.col("source_size") * REPEAT))
    every = Window.partitionBy()
    level = ((F.lit(SHARE) * F.sum("source_size").over(every)
              - (F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")))
             / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("level", level)
    # sources from the first whose level is within its cap on share that level; those before it are at their caps
    ranked = ranked.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(every))
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).select(
        "no_source", "source_key", "source_size", "weight", "slope", "target")


def keyed(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All columns in struct ``row`` beside the keys the mix works on."""
    hashed = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), size.alias("size"),
                       F.col(source_col).isNull().alias("no_source"), F.coalesce(source_col, F.lit("")).alias("source_key"),
                       F.substring(hashed, 1, 3).alias("piece"), hashed.alias("hash"))


def laid_out(rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` of ``keyed`` with source_size, target, slope and ``ends``: words of the source up to and with the row.

    ``sizes`` is a cheaper table of the same keys and sizes, if there is one.
    """
    keys = ["no_source", "source_key"]
    pieces = written((rows if sizes is None else sizes).groupBy(*keys, "piece").agg(F.sum("size").alias("words")), "mixing-pieces")
    plan = targets(pieces.groupBy(*keys).agg(F.sum("words").alias("source_size")))
    before = pieces.withColumn("before", F.sum("words").over(
        Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    within = Window.partitionBy(*keys, "piece").orderBy("hash", "size").rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("ends", F.sum("size").over(within))
            .join(before.join(plan, keys).drop("words"), [*keys, "piece"])
            .withColumn("ends", F.col("ends") + F.col("before")).drop("before", "piece", "hash"))


def _taken(again: int) -> Column:
    """Words taken of a row's first (0) or second (1) occurrence."""
    lies = F.col("ends") - F.col("size") + again * F.col("source_size")
    return F.least(F.greatest(F.round("target").cast("long") - lies, F.lit(0).cast("long")), F.col("size"))


def _position(again: int, taken: Column) -> Column:
    """The time at which the source's cumulative demand reaches the middle of what is taken."""
    u = (F.col("ends") - F.col("size") + again * F.col("source_size") + taken / 2) / F.col("target")
    a = F.col("slope")
    t = F.when(a == 0, u).otherwise((a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * u)) / (2 * a))
    return F.when(taken > 0, F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)))


def allotted(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position) of every row, in order of first position."""
    sizes = written(keyed(docs.select("doc_id", "source", size_of("text").alias("size")), F.col("size")), "mixing-sizes")
    out = laid_out(sizes).withColumn("first", _taken(0)).withColumn("second", _taken(1))
    return out.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
                      (F.col("first") + F.col("second")).alias("taken"),
                      _position(0, F.col("first")).alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows the mix takes, whole, repeated or cut to whole words, with all their columns, by position."""
    rows = keyed(docs, size_of(text_col))
    sizes = written(rows.drop("row"), "mixing-sizes")
    out = laid_out(rows, sizes).withColumn("takes", F.array(*(
        F.struct(F.lit(i).alias("again"), _taken(i).alias("words"), _position(i, _taken(i)).alias("position")) for i in (0, 1))))
    out = (out.withColumn("take", F.explode(F.filter("takes", lambda x: x["words"] > 0)))
           .repartitionByRange("take.position", "take.again").sortWithinPartitions("take.position", "take.again"))
    words = F.filter(F.split(F.col(f"row.{text_col}"), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    text = F.when(F.col("take.words") >= F.col("size"), F.col(f"row.{text_col}")).otherwise(
        F.array_join(F.slice(words, 1, F.col("take.words").cast("int")), " "))
    out = out.select("row", text.alias("t"))
    made = {text_col: F.col("t"), chars_col: F.length("t").cast("long")}
    return out.select(*(made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


_SIZED = f"""sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source_key,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
  FROM {{docs}})"""

PLAN_SQL = """ranked AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         CASE rank % 3 WHEN 0 THEN 0.5 WHEN 1 THEN -0.5 ELSE 0.0 END AS slope, 2 * source_size AS cap
  FROM (SELECT *, row_number() OVER (ORDER BY no_source, source_key) - 1 AS rank
        FROM (SELECT no_source, source_key, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL))),
levels AS (
  SELECT *, (1.5 * sum(source_size) OVER ()
             - (sum(cap) OVER (ORDER BY cap / weight, rank ROWS UNBOUNDED PRECEDING) - cap))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
plan AS (
  SELECT no_source, source_key, source_size, CAST(slope AS DOUBLE) AS slope,
         least(CAST(cap AS DOUBLE), CAST(weight * max(CASE WHEN level <= cap / weight THEN level END) OVER () AS DOUBLE)) AS target
  FROM levels),
laid AS (
  SELECT s.*, source_size, target, slope,
         CAST(sum(size) OVER (PARTITION BY no_source, source_key ORDER BY hash, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ends
  FROM sized s JOIN plan USING (no_source, source_key)),
taken AS (
  SELECT *, least(greatest(CAST(round(target) AS BIGINT) - (ends - size), 0), size) AS first,
         least(greatest(CAST(round(target) AS BIGINT) - (ends - size + source_size), 0), size) AS second
  FROM laid)"""

SQL = f"""WITH {_SIZED.format(docs="documents")},
{PLAN_SQL},
timed AS (SELECT *, (ends - size + first / 2) / target AS u FROM taken)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(first + second AS BIGINT) AS taken,
       CASE WHEN first > 0 THEN least(greatest(CASE WHEN slope = 0 THEN u
         ELSE (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * u)) / (2 * slope) END, 0.0), 1.0) END AS position
FROM timed"""
