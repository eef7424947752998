import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from .helpers import saved
from pyspark.sql import functions as F

from tessera.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved_ = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved_[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved_[k],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if made[c] == list(k)).encode()).hexdigest()) for k, m in members.items()), key=str)


def grown(seed, n, depth, alphabet):
    """Random conversations that share prefixes of any length, some equal or prefixes of others."""
    r, out, all_ = random.Random(seed), [], []
    for c in range(n):
        v = r.choice(all_)[:r.randint(0, depth)] if all_ and r.random() < 0.7 else []
        v = v + [(r.choice("ua"), r.choice(alphabet)) for _ in range(r.randint(0, 4))]
        all_.append(v or [("u", "")])
        out += [(c * r.choice((1, 1, 5)), i, *t) for i, t in enumerate(all_[-1])]
    return out


EDGES = [(1, None, None, None), (1, None, "user", "x"), (1, 3, "user", "é" * 50), (1, 3, "user", "é" * 50), (2, 0, "", ""), (None, 0, "user", "no id"),
         (5, 0, "user", "a"), (5, 1, "bot", "b"), (6, 0, "user", "zz"), (10, 7, "user", "x" * 100_000), (11, 0, "user", "x" * 100_000), (11, 1, None, "q"),
         (12, 0, "user", "one"), (13, 0, "user", "one"), (14, 0, "user", "one"), (14, 1, "user", "one")]


@pytest.mark.parametrize("turns, chunk", [(EDGES + [(100 + c, *t) for c, *t in grown(1, 60, 6, "xyz")], 2), (grown(2, 30, 20, "x"), 4_096)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, turns, chunk):
    monkeypatch.setattr(P, "CHUNK_TURNS", chunk)
    monkeypatch.setattr(P, "PIECE_IDS", 4)
    table = saved(spark, spark.createDataFrame(turns, SCHEMA).withColumn("conv", F.lit(1)).withColumn("depth", F.lit("x")), tmp_path / "c")
    got = sorted(map(tuple, P.shared_prefixes(spark, table).collect()), key=str)
    assert got == brute(turns)


def test_sql_equals_brute_force(spark):
    con = duckdb.connect()
    turns = EDGES + grown(3, 50, 6, "xyz")
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", turns)
    assert sorted(con.execute(P.SQL).fetchall(), key=str) == brute(turns)


def test_one_conversation_over_partitions_and_empty(spark, tmp_path):
    turns = [(3, i // 2, "u", f"t{i % 7}") for i in range(600)] + [(0, 0, "u", "t0")]
    got = sorted(map(tuple, P.shared_prefixes(spark, saved(spark, spark.createDataFrame(turns, SCHEMA), tmp_path / "c")).collect()), key=str)
    assert got == brute(turns)
    assert P.shared_prefixes(spark, saved(spark, spark.createDataFrame([], SCHEMA), tmp_path / "e")).count() == 0


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", P.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda x: x & -x) for r in got)
