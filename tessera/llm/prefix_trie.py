"""Prefixes that conversations share, from a z-fast trie of all conversations.

Conversations are first rebuilt (``rebuilt``), then numbered turns give each prefix a 128-bit hash:
the exclusive or of hashes of (depth, role, text), so that running values over chunks of turns make
up any prefix. Equal conversations are one string with a list of members.

The trie holds compacted nodes: places where strings branch or end. A node has an extent (depth and
hash of the whole prefix), the depth of its parent and, as its key in the hash table, the hash
of its extent's prefix at the two-fattest depth between the two. Strings are inserted in
``BATCHES``, larger ones later:

1. Fat binary search: the deepest node whose extent begins a string is found by looking up the
   hash of its prefix at the two-fattest depth of what is left of its range, halving the range.
   Then the edge on which it exits, by the hash one turn further, and the last depth on it.
2. Edges are split at exit depths. What the batch's strings have beyond gives new nodes where
   they branch or end; parents and table keys of new and cut nodes are made anew.

Then counts, leaves and bytes are summed up the trie by doubling pointers, in as many rounds as
the logarithm of its height, and edges are expanded to a row for each depth.

All steps are joins and aggregations over turns or nodes; no conversation, edge or group of equal
conversations is gathered in a task. Digests of members stream over pieces of sorted ids.

Defined results: a null role or text is empty; ties of turn go by role, then text, repeated rows
are turns each; rows without a conv_id are left out; an empty table gives an empty table; other
columns are left alone.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import tidy, written

#: Shares of the strings in the trie after each batch.
BATCHES = (1 / 8, 1.0)
#: Turns over which a running value is taken in one window.
CHUNK_TURNS = 4_096
#: Ids (by their value) that make up a piece of a digest's list.
PIECE_IDS = 1 << 16
#: The rebuilding's period and its largest number of shared turns.
PERIOD, MOST_SHARED = 5, 8


def numbered(spark: SparkSession, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """(conv, pos, s1, s2, bytes, n): every turn's place in its conversation from 0, hashes of role
    and text, bytes of the text, turns of the conversation. Places come from a range partitioning by
    conversation and turn, so a conversation may span partitions."""
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = (rows.repartitionByRange(n, F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 16))
            .sortWithinPartitions(F.col("conv"), F.col("turn").asc_nulls_first(), "role", "text"))
    rows = written(spark, rows.select(
        "conv", F.monotonically_increasing_id().alias("at"), F.xxhash64("role", "text").alias("s1"),
        F.xxhash64(F.lit("turn"), "text", F.length("role"), "role").alias("s2"), F.octet_length("text").cast("long").alias("bytes")), "turns")
    part = F.shiftright("at", 33)
    parts = rows.groupBy("conv", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    whole = Window.partitionBy("conv")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv", "part", "first", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"),
                         F.sum("here").over(whole).alias("n"))
    return (rows.withColumn("part", part).join(parts, ["conv", "part"])
            .select("conv", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "s1", "s2", "bytes", "n"))


def rebuilt(spark: SparkSession, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conversation c becomes the first h turns of conversation c - c % 5
    and its own turns after its first h, with h = crc32(c) % 9. Turns have (conv, depth from 1, s1,
    s2, bytes), conversations (conv, len)."""
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_SHARED + 1)
    own = written(spark, numbered(spark, turns), "numbered")
    convs = own.where("pos = 0").select("conv", "n")
    bases = convs.where(F.col("conv") % PERIOD == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = (convs.withColumn("base", F.col("conv") - F.col("conv") % PERIOD).withColumn("h", shared).join(bases, "base", "left")
             .withColumn("m", F.least(F.col("h"), F.coalesce("base_n", F.lit(0))))
             .withColumn("len", F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).select("conv", "base", "h", "m", "len"))
    convs = written(spark, convs, "rebuilt")
    heads = own.where((F.col("conv") % PERIOD == 0) & (F.col("pos") < MOST_SHARED)).drop("n").withColumnRenamed("conv", "base")
    head = convs.join(heads, "base").where("pos < h").select("conv", (F.col("pos") + 1).alias("depth"), "s1", "s2", "bytes")
    tail = own.drop("n").join(convs, "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("m") + 1).alias("depth"), "s1", "s2", "bytes")
    return head.union(tail), convs.select("conv", "len")


def prefixes(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, q1, q2, bytes, cum): hash of the prefix of each depth (k) and of the one
    a turn shorter (q), bytes of the turn and of the whole prefix."""
    terms = turns.select("conv", "depth", F.xxhash64("depth", "s1", "s2").alias("t1"), F.xxhash64("s2", "depth", "s1").alias("t2"), "bytes",
                         F.floor((F.col("depth") - 1) / CHUNK_TURNS).alias("chunk"))
    terms = written(spark, terms, "terms")
    chunks = terms.groupBy("conv", "chunk").agg(F.bit_xor("t1").alias("c1"), F.bit_xor("t2").alias("c2"), F.sum("bytes").alias("c"))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    chunks = chunks.select("conv", "chunk", F.coalesce(F.bit_xor("c1").over(earlier), zero).alias("b1"),
                           F.coalesce(F.bit_xor("c2").over(earlier), zero).alias("b2"), F.coalesce(F.sum("c").over(earlier), zero).alias("b"))
    within = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    k1, k2 = (F.col(f"b{i}").bitwiseXOR(F.bit_xor(f"t{i}").over(within)) for i in (1, 2))
    out = (terms.join(chunks, ["conv", "chunk"])
           .select("conv", "depth", k1.alias("k1"), k2.alias("k2"), "t1", "t2", "bytes", (F.col("b") + F.sum("bytes").over(within)).alias("cum")))
    return written(spark, out.select("conv", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("t1")).alias("q1"),
                                     F.col("k2").bitwiseXOR(F.col("t2")).alias("q2"), "bytes", "cum"), "prefixes")


# ------------------------------------------------------------------ the trie
NODE = ["e", "k1", "k2", "rep", "p", "p1", "p2", "f", "f1", "f2", "c1", "c2"]


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] with the most trailing zeros."""
    top = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, top), top)


def keyed(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes (e, k1, k2, rep, p, p1, p2) with their table keys: the hash at the two-fattest depth of
    (p, e] and the one at p + 1, both read from the path of a string that runs through the node."""
    at = paths.select(F.col("conv").alias("rep"), "depth", F.col("k1").alias("x1"), F.col("k2").alias("x2"))
    nodes = nodes.withColumn("f", two_fattest(F.col("p"), F.col("e"))).withColumn("g", F.col("p") + 1)
    nodes = nodes.join(at.toDF("rep", "f", "f1", "f2"), ["rep", "f"])
    return nodes.join(at.toDF("rep", "g", "c1", "c2"), ["rep", "g"]).select(*NODE)


def located(spark: SparkSession, strings: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Where each string (conv, len) leaves the trie: (conv, len, t, t1, t2) of the deepest node that
    begins it (0 and zeros: the root), the exit edge's lower node (xe, x1, x2, xrep, xp, xp1, xp2; null
    without one) and the last depth on that edge with its hash (c, k1, k2)."""
    zero = F.lit(0).cast("long")
    key = paths.select("conv", "depth", "k1", "k2")
    state = written(spark, strings.select("conv", "len", zero.alias("t"), zero.alias("t1"), zero.alias("t2"), F.col("len").alias("hi")), "search")
    longest = strings.agg(F.max("len")).first()[0] or 0
    table = nodes.select("f", "f1", "f2", "e", F.col("k1").alias("e1"), F.col("k2").alias("e2"))
    done = []
    for _ in range(int(longest).bit_length()):
        done.append(state.where("t >= hi"))
        live = state.where("t < hi").withColumn("f", two_fattest(F.col("t"), F.col("hi")))
        seen = (live.join(key.toDF("conv", "f", "f1", "f2"), ["conv", "f"]).join(table, ["f", "f1", "f2"], "left")
                .join(key.toDF("conv", "e", "m1", "m2"), ["conv", "e"], "left"))
        deeper = F.coalesce((F.col("m1") == F.col("e1")) & (F.col("m2") == F.col("e2")), F.lit(False))
        state = written(spark, seen.select(
            "conv", "len", F.when(deeper, F.col("e")).otherwise(F.col("t")).alias("t"), F.when(deeper, F.col("m1")).otherwise(F.col("t1")).alias("t1"),
            F.when(deeper, F.col("m2")).otherwise(F.col("t2")).alias("t2"), F.when(deeper, F.col("hi")).otherwise(F.col("f") - 1).alias("hi")), "search")
        if state.where("t < hi").isEmpty():
            break
    for d in done:
        state = state.union(d)
    state = state.drop("hi")
    edges = nodes.select((F.col("p") + 1).alias("g"), "c1", "c2", F.col("e").alias("xe"), F.col("k1").alias("x1"), F.col("k2").alias("x2"),
                         F.col("rep").alias("xrep"), F.col("p").alias("xp"), F.col("p1").alias("xp1"), F.col("p2").alias("xp2"))
    step = (state.withColumn("g", F.col("t") + 1).join(key.toDF("conv", "g", "c1", "c2"), ["conv", "g"], "left")
            .join(edges, ["g", "c1", "c2"], "left").drop("g", "c1", "c2"))
    step = written(spark, step, "exits")
    on = step.where("xe is not null").select("conv", "xrep", (F.col("t") + 1).alias("lo"), F.least("xe", "len").alias("hi"))
    common = (each_depth(on, "lo", "hi").join(key, ["conv", "depth"])
              .join(key.toDF("xrep", "depth", "y1", "y2"), ["xrep", "depth"]).where("k1 = y1 and k2 = y2")
              .groupBy("conv").agg(F.max(F.struct("depth", "k1", "k2")).alias("last")))
    return (step.join(common, "conv", "left")
            .withColumn("c", F.coalesce("last.depth", "t")).withColumn("k1", F.coalesce("last.k1", "t1")).withColumn("k2", F.coalesce("last.k2", "t2")).drop("last"))


def each_depth(rows: DataFrame, low: str, high: str, step: int = CHUNK_TURNS) -> DataFrame:
    """A row for each depth from ``low`` to ``high``, by way of runs of depths."""
    rows = rows.where(F.col(low) <= F.col(high)).withColumn("run", F.explode(F.sequence(F.col(low), F.col(high), F.lit(step).cast("long"))))
    return rows.withColumn("depth", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + (step - 1), F.col(high))))).drop("run")


def inserted(spark: SparkSession, nodes: DataFrame, strings: DataFrame, paths: DataFrame) -> DataFrame:
    """``nodes`` after a batch of strings (conv, len)."""
    at = written(spark, located(spark, strings, nodes, paths), "located")
    # edges are split where strings leave them; what hangs below goes to the lowest cut
    edge = Window.partitionBy("xe", "x1", "x2").orderBy("c")
    above = F.lag(F.struct("c", "k1", "k2")).over(edge)
    cuts = at.where("xe is not null").select("xe", "x1", "x2", "xrep", "xp", "xp1", "xp2", "c", "k1", "k2").distinct().withColumn("up", above)
    cuts = written(spark, cuts, "cuts")
    split = cuts.select(F.col("c").alias("e"), "k1", "k2", F.col("xrep").alias("rep"), F.coalesce("up.c", "xp").alias("p"),
                        F.coalesce("up.k1", "xp1").alias("p1"), F.coalesce("up.k2", "xp2").alias("p2"))
    lowest = cuts.groupBy("xe", "x1", "x2").agg(F.max(F.struct("c", "k1", "k2")).alias("low"), F.min("xrep").alias("rep"))
    below = lowest.select(F.col("xe").alias("e"), F.col("x1").alias("k1"), F.col("x2").alias("k2"), "rep", F.col("low.c").alias("p"),
                          F.col("low.k1").alias("p1"), F.col("low.k2").alias("p2"))

    # beyond their exits the batch's strings branch or end among themselves
    exits = at.select("conv", "len", "c", F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    beyond = written(spark, paths.join(exits, "conv").where("depth > c").select("conv", "depth", "k1", "k2", "q1", "q2", "len", "c", "a1", "a2"), "beyond")
    steps = beyond.groupBy("depth", "k1", "k2", "q1", "q2").agg(F.max((F.col("depth") == F.col("len")).cast("int")).alias("end"),
                                                                F.max((F.col("depth") == F.col("c") + 1).cast("int")).alias("first"))
    steps = written(spark, steps, "steps")
    branches = (steps.where("first = 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2"))
                .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("depth", "k1", "k2"))
    fresh = branches.union(steps.where("end = 1").select("depth", "k1", "k2")).distinct()
    before = F.lag(F.struct("depth", "k1", "k2")).over(Window.partitionBy("conv").orderBy("depth"))
    on = beyond.join(fresh, ["depth", "k1", "k2"]).withColumn("up", before)
    new = (on.groupBy(F.col("depth").alias("e"), "k1", "k2")
           .agg(F.min("conv").alias("rep"), F.min(F.struct(F.coalesce("up.depth", "c").alias("p"), F.coalesce("up.k1", "a1").alias("p1"),
                                                           F.coalesce("up.k2", "a2").alias("p2"))).alias("up"))
           .select("e", "k1", "k2", "rep", "up.p", "up.p1", "up.p2"))
    changed = keyed(split.union(below).union(new), paths)
    kept = nodes.join(lowest.select(F.col("xe").alias("e"), F.col("x1").alias("k1"), F.col("x2").alias("k2")), ["e", "k1", "k2"], "left_anti")
    return written(spark, kept.select(*NODE).union(changed), "nodes")


def build(spark: SparkSession, strings: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes of the trie of all strings (conv, len) with turns; the root isn't among them."""
    nodes = spark.createDataFrame([], ", ".join(f"{c} long" for c in NODE))
    order = F.pmod(F.xxhash64(F.lit("batch"), "conv"), F.lit(1 << 20)) / float(1 << 20)
    low = 0.0
    for high in BATCHES:
        part = strings.where((F.col("len") > 0) & (order >= low) & (order < high)).select("conv", "len")
        low = high
        if not part.isEmpty():
            nodes = inserted(spark, nodes, part, paths)
    return nodes


# ------------------------------------------------------------------ sums and rows
def subtree(spark: SparkSession, nodes: DataFrame, sums: list[str], least: list[str]) -> DataFrame:
    """``nodes`` (id, up: id of the parent or null below the root, values) with the values summed,
    or their least taken, over the node and all below it; pointers double in each round."""
    values = [*sums, *least]
    state = nodes.select("id", "up", *values)
    while not (live := state.where("up is not null")).isEmpty():
        got = live.groupBy(F.col("up").alias("id")).agg(*[F.sum(c).alias(f"+{c}") for c in sums], *[F.min(c).alias(f"+{c}") for c in least])
        merged = state.join(got, "id", "left").select(
            "id", "up", *[(F.col(c) + F.coalesce(f"+{c}", F.lit(0))).alias(c) for c in sums], *[F.least(c, f"+{c}").alias(c) for c in least])
        # rows without a pointer stay out of the join, as they would all meet in one task
        jump = state.where("up is not null").select(F.col("id").alias("up"), F.col("up").alias("next"))
        state = written(spark, merged.where("up is null").union(
            merged.where("up is not null").join(jump, "up", "left").select("id", F.col("next").alias("up"), *values)), "sums")
    return state.drop("up")


def digests(spark: SparkSession, ends: DataFrame) -> DataFrame:
    """(len, k1, k2, ends_sha256): digest of the ids (conv), ascending and comma-joined, of each key.
    Pieces of ids are joined first, so a key with very many has few rows; they stream in order."""
    pieces = (ends.groupBy("len", "k1", "k2", F.floor(F.col("conv") / PIECE_IDS).alias("piece"))
              .agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")))
    pieces = pieces.repartition("len", "k1", "k2").sortWithinPartitions("len", "k1", "k2", "piece")

    def run(batches):
        key, state = None, None
        for b in batches:
            out = []
            for *k, ids in zip(*(b.column(c).to_pylist() for c in ("len", "k1", "k2", "ids")), strict=True):
                if k == key:
                    state.update(b"," + ids.encode())
                else:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
            yield batch(out)
        if key:
            yield batch([(*key, state.hexdigest())])

    def batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["len", "k1", "k2", "ends_sha256"])

    return pieces.select("len", "k1", "k2", "ids").mapInArrow(tidy(run), "len long, k1 long, k2 long, ends_sha256 string")


def shared_prefixes(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """One row per node of the uncompacted trie: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    parts, convs = rebuilt(spark, turns)
    every = prefixes(spark, parts)
    zero = F.lit(0).cast("long")
    ends = (convs.join(every.select("conv", F.col("depth").alias("len"), "k1", "k2"), ["conv", "len"], "left")
            .select("conv", "len", F.coalesce("k1", zero).alias("k1"), F.coalesce("k2", zero).alias("k2")))
    ends = written(spark, ends, "ends")
    strings = written(spark, ends.groupBy("len", "k1", "k2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")), "strings")
    paths = written(spark, every.join(strings.select("conv"), "conv", "left_semi"), "paths")
    nodes = build(spark, strings, paths)

    # numbered nodes with their parents, what ends at them, their children and bytes
    nodes = written(spark, nodes.select(F.monotonically_increasing_id().alias("id"), "e", "k1", "k2", "rep", "p", "p1", "p2"), "trie")
    up = nodes.select(F.col("id").alias("up"), F.col("e").alias("p"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    under = nodes.groupBy(F.col("p").alias("e"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("children"))
    stops = strings.select(F.col("len").alias("e"), "k1", "k2", F.col("n").alias("n_ends"), F.col("conv").alias("first"))
    low = paths.select(F.col("conv").alias("rep"), F.col("depth").alias("e"), F.col("cum").alias("cum_e"))
    high = paths.select(F.col("conv").alias("rep"), F.col("depth").alias("g"), (F.col("cum") - F.col("bytes")).alias("cum_p"))
    full = (nodes.where("p > 0").join(up, ["p", "p1", "p2"], "left").union(nodes.where("p = 0").select("p", "p1", "p2", "id", "e", "k1", "k2", "rep", F.lit(None).cast("long")))
            .join(under, ["e", "k1", "k2"], "left").join(stops, ["e", "k1", "k2"], "left").join(low, ["rep", "e"])
            .withColumn("g", F.col("p") + 1).join(high, ["rep", "g"])
            .select("id", "up", "rep", "p", "e", "k1", "k2", F.coalesce("children", zero).alias("children"), F.coalesce("n_ends", zero).alias("members"),
                    "first", "cum_e", "cum_p", F.when(F.col("children").isNull(), 1).otherwise(0).cast("long").alias("leaves")))
    full = written(spark, full, "trie-full")
    totals = written(spark, subtree(spark, full, ["members", "leaves"], ["first"]), "trie-members")
    full = written(spark, full.drop("members", "leaves", "first").join(totals, "id"), "trie-counted")
    edges = full.withColumn("edge", (F.col("members") - 1) * (F.col("cum_e") - F.col("cum_p"))).withColumn("saved", F.col("edge"))
    saved = subtree(spark, edges, ["saved"], [])
    marks = digests(spark, ends).withColumnsRenamed({"len": "e"})
    names = full.select(F.col("id").alias("up"), F.col("first").alias("up_first"))
    start = ends.agg(F.min("conv").alias("root"))
    below = edges.drop("saved").join(saved, "id").withColumn("below", F.col("saved") - F.col("edge"))
    below = (below.where("up is not null").join(names, "up", "left").select(*below.columns, "up_first")
             .union(below.where("up is null").select(*below.columns, F.lit(None).cast("long"))))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    rows = each_depth(below.withColumn("g", F.col("p") + 1), "g", "e").join(
        paths.select(F.col("conv").alias("rep"), "depth", (F.col("cum") - F.col("bytes")).alias("cum_d")), ["rep", "depth"])
    last = F.col("depth") == F.col("e")
    rows = (rows.join(marks, ["e", "k1", "k2"], "left").crossJoin(F.broadcast(start))  # one row
            .select(F.col("first").alias("conv_id"), "depth",
                    F.when(F.col("depth") > F.col("g"), F.col("first")).when(F.col("p") == 0, F.col("root")).otherwise(F.col("up_first")).alias("parent_conv_id"),
                    F.col("members").alias("n_convs"), F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"),
                    F.col("leaves").alias("n_leaves"), (F.col("below") + (F.col("members") - 1) * (F.col("cum_e") - F.col("cum_d"))).alias("saved_tokens"),
                    F.when(last, F.coalesce("ends_sha256", nothing)).otherwise(nothing).alias("ends_sha256")))
    tops = full.agg(F.coalesce(F.sum((F.col("p") == 0).cast("long")), zero).alias("n_children"),
                    F.greatest(F.lit(1).cast("long"), F.coalesce(F.sum(F.when(F.col("children") == 0, 1)), zero)).alias("n_leaves"))
    weight = edges.agg(F.coalesce(F.sum("edge"), zero).alias("saved_tokens"))
    root = (ends.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").crossJoin(tops).crossJoin(weight)
            .join(marks.where("e = 0").select("ends_sha256"), F.lit(True), "left"))
    return rows.union(root.select("conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                                  "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")))


SQL = r"""
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list({'r': role, 't': text} ORDER BY turn ASC NULLS FIRST, encode(role), encode(text)) AS ws FROM o GROUP BY c),
h AS (
  SELECT c, ws, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END + z)))) % 9 AS h
  FROM l),
r AS (SELECT x.c, list_concat(coalesce(b.ws[1:x.h], []), x.ws[x.h + 1:]) AS ws FROM h x LEFT JOIN l b ON b.c = x.c - x.c % 5),
p AS (SELECT c, ws, len(ws) AS n, unnest(generate_series(0, len(ws))) AS d FROM r),
q AS (SELECT c, d, n, ws[1:d] AS k FROM p),
n AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends
      FROM q GROUP BY d, k),
e AS (SELECT y.d, y.k, y.conv_id, y.n_convs, y.ends, x.conv_id AS parent_conv_id
      FROM n y LEFT JOIN n x ON x.d = y.d - 1 AND x.k = y.k[1:y.d - 1]),
f AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
g AS (SELECT e.*, coalesce(f.n_children, 0) AS n_children, CASE WHEN e.d = 0 THEN 0 ELSE (n_convs - 1) * strlen(e.k[e.d].t) END AS saved
      FROM e LEFT JOIN f ON f.d = e.d AND f.k = e.k),
u AS (SELECT a, k[1:a] AS k, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
      FROM (SELECT k, saved, n_children, unnest(generate_series(0, d)) AS a FROM g) GROUP BY 1, 2)
SELECT g.conv_id, g.d::BIGINT AS depth, g.parent_conv_id, g.n_convs::BIGINT AS n_convs, g.n_children::BIGINT AS n_children,
       u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, sha256(g.ends) AS ends_sha256
FROM g JOIN u ON u.a = g.d AND u.k = g.k
"""
