"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source the keys are put in order by
ranges (chunks of the key space, as many as the source's rows ask for), prefix sums of the
word counts are taken within each chunk and carried over the chunks, and the source is cut
at its exact budget; a source with a budget above its own size is repeated in whole epochs
first. DataFrame functions only.

Defined results: null and empty texts have size 0 and are taken 0 words; a null source is a
source of its own, last in order; repeated rows count each for itself; a null id is keyed by
its text; an empty table gives an empty table. Extra columns are carried if asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, md5_key, n_words, unit, written

#: Rows that a chunk of a source's key space holds on average.
CHUNK_ROWS = 2_000


def source_targets(sized: DataFrame, weights: tuple = (5, 2, 1), most_epochs: int = 3) -> DataFrame:
    """One row per source: source, source_size, source_rows, weight, target.

    Sources by code point, null last, take the weights in turn. The words of all sources are
    shared by weight; a target stops at ``most_epochs`` times its source's size and the
    excess is shared again by weight, until no target is above. Sorted by size per weight,
    the stopped sources are a prefix, so running sums over the sources (one row each) give
    the level at which the sharing ends."""
    cap = F.col("source_size") * F.lit(most_epochs)
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy(F.col("ratio"), F.col("place"))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
        .withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(turn, (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("ratio", cap / F.col("weight"))
        .withColumn("left_words", F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("share", F.col("weight") * F.col("left_words") / F.col("left_weight"))
        .withColumn("stopped", F.col("share") > cap)
        # the first source that isn't stopped sets the level for itself and all after it
        .withColumn("level", F.min(F.when(~F.col("stopped"), F.struct("ratio", "place", "left_words", "left_weight")))
                    .over(every))
        .withColumn("free", F.col("level").isNotNull()
                    & (F.struct("ratio", "place") >= F.struct("level.ratio", "level.place")))
        .withColumn("target", F.when(F.col("free"), F.col("weight") * F.col("level.left_words") / F.col("level.left_weight"))
                    .otherwise(cap.cast("double")))
        .select("source", "source_size", "source_rows", "weight", "target")
    )


def mix(spark: SparkSession, docs: DataFrame, weights: tuple = (5, 2, 1), most_epochs: int = 3, seed: str = "mix",
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None,
        chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words that the mix takes,
    repeats counted) and the columns of ``carry``, held in a struct while the work goes on
    so that no name can clash."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        md5_key(seed, F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))).alias("key"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []))
    if not carry:  # the texts are read once; what the plan reads again is small
        rows = written(spark, rows, "mix-sized")
    light = rows.select("id", "source", "size", "key")
    sources = written(spark, source_targets(light, weights, most_epochs), "mix-sources")

    def chunked(df: DataFrame) -> DataFrame:
        s = sources.select(F.col("source").alias("s_source"), "source_size", "source_rows", "target")
        chunks = F.ceil(F.col("source_rows") / F.lit(chunk_rows))
        return (df.join(s, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
                .withColumn("chunk", F.floor(unit(F.col("key")) * chunks)))

    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(spark, (chunked(light).groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
               .select(F.col("source").alias("o_source"), F.col("chunk").alias("o_chunk"),
                       F.coalesce(F.sum("chunk_size").over(earlier), F.lit(0)).alias("offset"))), "mix-offsets")
    within = (Window.partitionBy("source", "chunk").orderBy("key", "id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    before = F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    return (
        chunked(rows).join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("chunk") == F.col("o_chunk")))
        .withColumn("before", before)
        .select(F.col("id").alias(id_col), "size", "source_size", "target",
                (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))))
                .cast("long").alias("taken"), *(["carried"] if carry else [])))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, white space kept as it is."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: each document as often as the mix takes
    it whole, and the document at a source's cut once more up to the cut."""
    text = options.get("text_col", "text")
    out = mix(spark, docs, carry=docs.columns, **options).where("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size"))
    part = F.col("taken") - whole * F.col("size")
    copies = F.sequence(F.lit(1).cast("long"), whole + F.when(part > 0, 1).otherwise(0))
    out = out.withColumn("whole", whole).withColumn("part", part).withColumn("copy", F.explode(copies))
    cut = F.when(F.col("copy") > F.col("whole"), first_words(F.col(f"carried.`{text}`"), F.col("part"))) \
        .otherwise(F.col(f"carried.`{text}`"))
    return out.select(*[cut.alias(c) if c == text else F.col(f"carried.`{c}`").alias(c) for c in docs.columns])


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, text, '')) AS key
  FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) ASC NULLS LAST)) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, encode(source) ASC NULLS LAST) AS place FROM named),
shared AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))::DOUBLE AS left_words,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS left_weight
  FROM ranked WINDOW w AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT * FROM shared WHERE weight * left_words / left_weight <= 3 * source_size ORDER BY place LIMIT 1),
targets AS (
  SELECT s.source, s.source_size,
         CASE WHEN s.place >= l.place THEN s.weight * l.left_words / l.left_weight
              ELSE (3 * s.source_size)::DOUBLE END AS target
  FROM shared s LEFT JOIN level l ON true),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM placed
"""
