"""Benchmark decontamination with a distributed positional inverted index.

The index is a written table of postings (word, row, position), each partition sorted by word: the
lists of the words that the test items hold, for all documents in full. A posting of the empty word
closes every document and so keeps its length and id. The texts are read once; everything
after works on posting lists:

1. The corpus frequency of every test word is a count over the lists.
2. A window is ``width`` consecutive words of an item. The lists of each window's two rarest words,
   shifted by their offsets in the item, are intersected: what is left are alignments of an item
   with a document.
3. An alignment's other words are looked up in their lists the same way. Runs of at least a
   window's length of words in place are the exact phrase matches.

``proximity_matches`` starts from the rarest word too and asks for all words of an item, in any
order, within a stretch of words. DataFrame functions only.

Test words and items, which don't grow with the corpus, are broadcast only if counted to be under
``BROADCAST_ROWS``; beyond it they are joined by shuffles, for words with salted keys, as one word
may hold a large share of all postings. Groups are a document's matches or an item's words.

Defined results: a null or empty text has no words and no hits; an item without words has no
window, one with fewer than ``width`` is one window; items of one id are one item, a null id is an
item without a name; repeated rows each get their row; a null document id is kept; an empty
``docs`` gives an empty table, without items nothing is hit; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of digits, letters and characters beyond ASCII, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
#: Rows of three short columns that are broadcast at most (some 30 MB in memory).
BROADCAST_ROWS = 200_000
#: Parts that a word's rows are dealt to where words are joined by a shuffle.
SALTS = 32


def words(text: Column) -> Column:
    """Array of the words in order; empty for null. ``lower`` is quicker than ``translate`` and does
    the same to a text within ASCII."""
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(low, SEPARATORS), ""), F.array().cast("array<string>"))


def small(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def with_words(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` joined to ``wanted`` (not unique) on ``word``."""
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(wanted), "word")
    salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("row", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["word", "salt"]).drop("salt")


def item_words(spark: SparkSession, items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, name, size, off, word) of all words of the items; ``item`` numbers the items' rows."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("string").alias("name"),
                        words(F.col(text_col)).alias("ws"))
    return written(spark, rows.select("item", "name", F.size("ws").alias("size"), F.posexplode("ws").alias("off", "word")), "items")


def build_index(spark: SparkSession, docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (word, row, pos, id) of the words of ``vocabulary`` (column word); ``row`` numbers
    the documents' rows. The empty word's posting has the number of words as its position, and the id."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("ws"))
    each = rows.select("row", "id", F.posexplode(F.concat("ws", F.array(F.lit("")))).alias("pos", "word"))
    wanted = written(spark, vocabulary.select("word").union(spark.range(1).select(F.lit("").alias("word"))).distinct(), "vocabulary")
    kept = with_words(each, wanted).select("word", "row", "pos", F.when(F.col("word") == "", F.col("id")).alias("id"))
    return written(spark, kept.sortWithinPartitions("word", "row", "pos"), "postings")


def frequencies(spark: SparkSession, postings: DataFrame) -> DataFrame:
    return written(spark, postings.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")), "frequencies")


def rarest_pairs(words_: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """Distinct (item, off1, word1, off2, word2): the two rarest words of every window that can
    occur (all its words do); the same one twice in a window of one word."""
    frame = Window.partitionBy("item").orderBy("off").rowsBetween(0, width - 1)
    known = words_.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    windows = (known.withColumn("by", F.array_sort(F.collect_list(F.struct("n", "off", "word")).over(frame)))
               .where(F.col("off") <= F.greatest(F.lit(0), F.col("size") - width)))
    first, second = F.col("by")[0], F.when(F.size("by") > 1, F.element_at("by", 2)).otherwise(F.col("by")[0])
    return (windows.where(first["n"] > 0)
            .select("item", first["off"].alias("off1"), first["word"].alias("word1"), second["off"].alias("off2"), second["word"].alias("word2"))
            .distinct())


def phrase_matches(spark: SparkSession, postings: DataFrame, words_: DataFrame, width: int = WIDTH) -> DataFrame:
    """(row, item, name, first, last): the runs of words of an item, ``width`` or the whole of a
    shorter item at the least, that stand in a document, by the positions of their ends."""
    pairs = written(spark, rarest_pairs(words_, frequencies(spark, postings), width), "pairs")
    lists = postings.where("word <> ''").select("word", "row", "pos")
    firsts = with_words(lists, pairs.withColumnRenamed("word1", "word"))
    firsts = firsts.select("row", "item", (F.col("pos") - F.col("off1")).alias("at"),
                           (F.col("pos") - F.col("off1") + F.col("off2")).alias("pos"), F.col("word2").alias("word"))
    seconds = with_words(lists, pairs.select(F.col("word2").alias("word")).distinct()).select("row", "pos", "word")
    aligned = written(spark, firsts.join(seconds, ["row", "pos", "word"]).select("row", "item", "at").distinct(), "alignments")
    asked = (aligned.join(small(words_), "item")
             .select("row", "item", "name", "size", "at", "off", "word", (F.col("at") + F.col("off")).alias("pos")).where("pos >= 0"))
    found = lists.join(asked, ["row", "pos", "word"])  # no hint: the same plan whatever the number of matches
    place = F.row_number().over(Window.partitionBy("row", "item", "at").orderBy("off"))
    runs = (found.withColumn("run", F.col("off") - place).groupBy("row", "item", "name", "size", "at", "run")
            .agg(F.min("pos").alias("first"), F.max("pos").alias("last")))
    return runs.where(F.col("last") - F.col("first") + 1 >= F.least(F.lit(width), F.col("size"))).select("row", "item", "name", "first", "last")


def proximity_matches(spark: SparkSession, postings: DataFrame, words_: DataFrame, within: int) -> DataFrame:
    """(row, item, name, pos): the places of an item's rarest word that lie in a stretch of at most
    ``within`` words which holds all distinct words of the item, in any order."""
    distinct = words_.select("item", "name", "word").distinct()
    ranked = written(spark, distinct.join(frequencies(spark, postings), "word", "left").withColumn("n", F.coalesce("n", F.lit(0))), "ranked")
    rare = (ranked.groupBy("item", "name").agg(F.min(F.struct("n", "word")).alias("rare"), F.count(F.lit(1)).alias("size"))
            .where("rare.n > 0").where(F.col("size") <= within).select("item", "name", "size", F.col("rare.word").alias("word")))
    rare = written(spark, rare, "rarest")
    lists = postings.where("word <> ''").select("word", "row", "pos")
    anchors = with_words(lists, rare)
    alone = anchors.where("size = 1").select("row", "item", "name", "pos")
    others = ranked.select("item", F.col("word").alias("other"))
    block = F.floor(F.col("pos") / within)
    asked = (anchors.where("size > 1").join(small(others), "item").where("other <> word")
             .select("row", "item", "name", "size", F.col("pos").alias("at"), F.col("other").alias("word"),
                     F.explode(F.sequence(block - 1, block + 1)).alias("block")))
    near = (lists.withColumn("block", block).join(asked, ["row", "word", "block"]).where(F.abs(F.col("pos") - F.col("at")) < within))
    starts = F.sequence(F.greatest("pos", "at") - within + 1, F.least("pos", "at"))
    full = (near.select("row", "item", "name", "size", "at", "word", F.explode(starts).alias("start")).distinct()
            .groupBy("row", "item", "name", "size", "at", "start").agg(F.count(F.lit(1)).alias("n")).where("n = size - 1"))
    return alone.union(full.select("row", "item", "name", F.col("at").alias("pos")).distinct())


def report(spark: SparkSession, postings: DataFrame, matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, n_words, n_hit (words in any match), n_items, items_sha256 (of the
    ids of matched items, sorted as strings, comma-joined), contaminated."""
    matches = written(spark, matches, "matches")
    earlier = Window.partitionBy("row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("last") - F.greatest(F.coalesce(F.max("last").over(earlier), F.lit(-1)), F.col("first") - 1))
    hits = matches.select("row", "first", "last").distinct().withColumn("new", new).groupBy("row").agg(F.sum("new").alias("n_hit"))
    items = (matches.select("row", "name").distinct().groupBy("row")
             .agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names")))
    docs = postings.where("word = ''").select("row", F.col("id").alias(id_col), F.col("pos").cast("long").alias("n_words"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (docs.join(hits, "row", "left").join(items, "row", "left")
            .select(id_col, "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), (hit > 0).alias("contaminated")))


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``report`` of all documents against all items."""
    words_ = item_words(spark, items, item_id, item_text)
    postings = build_index(spark, docs, words_, id_col, text_col)
    return report(spark, postings, phrase_matches(spark, postings, words_, width), id_col)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents),
b AS (
  SELECT item_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM benchmark),
k AS (SELECT item_id, ws, least(10, len(ws)) AS l, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0),
g AS (SELECT DISTINCT item_id, l, array_to_string(ws[i:i + l - 1], ' ') AS gram FROM k),
p AS (SELECT r, ws, unnest(generate_series(1, len(ws))) AS i FROM d),
q AS (SELECT p.r, p.i, z.l, array_to_string(p.ws[p.i:p.i + z.l - 1], ' ') AS gram
      FROM p JOIN (SELECT DISTINCT l FROM g) z ON p.i + z.l - 1 <= len(p.ws)),
m AS (SELECT q.r, q.i, q.l, g.item_id FROM q JOIN g ON q.l = g.l AND q.gram = g.gram),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + l - 1)) AS j FROM m) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names
      FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM m) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""
