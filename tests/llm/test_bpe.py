import hashlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, blocks
from tessera.llm.common import table
from tessera.llm.queries import op3_bpe_round_trip, tokenizer_path
from tests.conftest import SF001

from .helpers import edge_docs, empty_docs, saved

PATH = tokenizer_path("word_bpe_49k.json")
TRICKY = [
    "It's we'RE i'd THEY'LL ''s 'S", "<|endoftext|> a<|startoftext|>b <|endoftext", "İSTANBUL ΣΊΣΥΦΟΣ ẞ ŉ ǅ",
    "é é ﬁ Å Å ẛ̣", "漢字かな한국어 हिन्दी עברית", "emoji 😀👩‍👩‍👧 ‍​", "\x00\x1c\x1d\x1e\x1f\x7f\x85\xa0",
    "a b c　d᠎e", "½²³ ٣٤ Ⅷ 〇", "—‘’“”… ‐‑‧", "@@@###$$$ !!!'s''t", "﻿bom", "ß straße µ ª º", "x" * 5000, "\n", "'", "</w> </w>a",
]


def expected(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return ids, (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                 hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def compare(rows, texts):
    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(tok, texts[r["doc_id"]])[1], texts[r["doc_id"]]


def test_documents_equal_the_library(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF001, "documents").collect()}
    rows = op3_bpe_round_trip(spark, SF001).collect()
    assert len(rows) == len(texts)
    compare(rows, texts)


def test_every_character_splits_as_in_the_library():
    import pyarrow as pa

    words = bpe.Words(bpe.read_tokenizer(PATH))
    chars = [chr(c) for c in [*range(bpe.LIMIT), *range(0x2008, 0x2030)]]
    texts = [t for c in chars for t in (c, f"a{c}b", f"1{c}!", f"{c}{c}'s", f"'{c}")] + ["'", "''s", "'s't'rest", "x'll'", "é's", "a '", "'"]
    got = []
    for _, to, (raw, owner, a, b) in words.spans(pa.array(texts)):
        data = raw.tobytes()
        rows = [[] for _ in range(to)]
        for r, x, y in zip(owner.tolist(), a.tolist(), b.tolist(), strict=True):
            rows[r].append(data[x:y].decode())
        got += rows
    for text, mine in zip(texts, got, strict=True):
        assert mine == words.split(text), text


def test_tricky_texts_equal_the_library(spark, tmp_path):
    rng = np.random.default_rng(0)
    pools = [range(32, 127), range(0x20, 0x300), range(0, 0x2100), [*range(0x300, 0x370), *range(97, 123), 0x2028, 0xA0]]
    texts = TRICKY + ["".join(chr(rng.choice(np.array(pools[i % 4]))) for _ in range(60)) for i in range(200)]
    df = saved(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), tmp_path / "t")
    rows = bpe.encode(df, bpe.read_tokenizer(PATH)).collect()
    assert len(rows) == len(texts)
    compare(rows, dict(enumerate(texts)))


def test_edges(spark, tmp_path):
    df = saved(spark, edge_docs(spark), tmp_path / "e")
    rows = bpe.encode(df, bpe.read_tokenizer(PATH), with_ids=True).collect()
    assert len(rows) == 15
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in df.collect())
    compare([r for r in rows if r["doc_id"] is not None], {r["doc_id"]: r["text"] for r in df.collect()})
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {(0, empty, empty)}
    for r in rows:
        assert hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"] and len(r["ids"]) == 4 * r["n_tokens"]
        assert hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"]
    assert bpe.encode(saved(spark, empty_docs(spark), tmp_path / "n"), bpe.read_tokenizer(PATH)).count() == 0


def test_many_small_blocks_give_the_same(spark, monkeypatch):
    docs = table(spark, SF001, "documents")
    whole = sorted(map(tuple, bpe.encode(docs, bpe.read_tokenizer(PATH)).collect()))
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 20_000)
    assert sorted(map(tuple, bpe.encode(docs, bpe.read_tokenizer(PATH)).collect())) == whole


def test_decode_joins_ids_to_pieces(spark):
    words = bpe.Words(bpe.read_tokenizer(PATH))
    tok = Tokenizer.from_file(PATH)
    rows = [(1, tok.encode("hello big world <|endoftext|>", add_special_tokens=False).ids), (2, []), (3, None),
            (4, tok.encode("hello", add_special_tokens=False).ids), (5, tok.encode("hello", add_special_tokens=False).ids)]
    df = spark.createDataFrame(rows, "id long, ids array<int>").withColumn("piece", F.lit("mine")).withColumn("at", F.lit(3))
    got = {r["id"]: r["decoded"] for r in bpe.decode(spark, df, words).collect()}
    assert got == {i: None if x is None else tok.decode(x, skip_special_tokens=False) for i, x in rows}


def test_pack_round_trip():
    for x in ([], [0], [255, 256, 0], [2**40, 1]):
        assert blocks.unpack(blocks.pack(np.array(x, np.int64))).tolist() == x
