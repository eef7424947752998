import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from .helpers import EDGE_ROWS, edge_docs, empty_docs, saved
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import alignment as A
from tessera.llm.bpe import byte_letters, read_tokenizer
from tessera.llm.queries import tokenizer_path

SOURCE = read_tokenizer(tokenizer_path("byte_bpe_50k.json"))
with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
    MODEL = f.read()

TEXTS = ["two  spaces and   three", " leading", "trailing ", "  ", "\n", "a\n b\n\n c \t d", "don't can't we'll I'VE", "tab\tend\t \tx", "no break  wide　x y",
         "▁ low bar", "a▁b", "<|endoftext|> and <s> </s> <unk>", "漢字かな交じり文 です", "emoji 👩‍👩‍👧 ok", "naïve café", "x" * 5_000, "1234567890 12 3", "\x00 nul \x1c fs \x85 nel",
         "a" * 300 + " " * 300 + "b", "hello world hello world", "hello world", "Ǆ ﬁ ½ İ", " ▁ ", "end with nbsp  x", "tail 3　 y", "  line   par"]


def brute(rows):
    tok, sp = Tokenizer.from_str(SOURCE), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    tok.encode_special_tokens = True
    back = {c: b for b, c in byte_letters().items()}

    def a_bytes(i):
        return bytes(back[c] for c in tok.id_to_token(i))

    def b_bytes(i):
        return bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()

    count, made = Counter(), []
    for doc_id, text in rows:
        a, b = (tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        if not b"".join(map(a_bytes, a)) == b"".join(map(b_bytes, b)) == (" " + (text or "")).encode():
            a, b = [], []
        ends = [np.cumsum([len(f(i)) for i in ids]).astype(int).tolist() for f, ids in ((a_bytes, a), (b_bytes, b))]
        groups, p, q = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x, y = p, q
            while p < len(a) and ends[0][p] <= cut:
                p += 1
            while q < len(b) and ends[1][q] <= cut:
                q += 1
            groups.append((a[x:p], b[y:q]))
        links = Counter()
        for x, y in groups:
            for i, m in Counter(x).items():
                for j, n in Counter(y).items():
                    links[i, j] += m * n
        count.update(links.keys())
        made.append((doc_id, a, b, groups, links))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for doc_id, a, b, groups, links in made:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), sum(links.values()), sum(n for k, n in links.items() if count[k] == best[k[0]]),
                    sum(n * count[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


ROWS = [(r[0], r[1]) for r in EDGE_ROWS] + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(200, " ".join(TEXTS) * 3)]


@pytest.mark.parametrize("fan, block, kept", [(256, 8 << 20, 400_000), (2, 300, 5)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, fan, block, kept):
    monkeypatch.setattr(A, "FAN", fan)
    monkeypatch.setattr(A, "BUCKETS", 3)
    frame = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("keys", F.lit("x"))
    docs = saved(spark, frame.repartition(5), tmp_path / "d")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        got = A.align(spark, docs, SOURCE, MODEL)
        assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_chunks_kept_between_blocks_are_bounded(monkeypatch):
    monkeypatch.setattr(A, "KEPT_CHUNKS", 2)
    chunks = A.Aligned(SOURCE, MODEL, digests=True)
    for words in ([b"a", b"bc"], [b"d", b"a", b"eee"], [b"eee", b"a"], [b"zz"]):
        place = chunks.places(words)
        fresh = A.Aligned(SOURCE, MODEL, digests=True)
        want = fresh.places(words)
        assert [chunks.text[i] for i in place] == [fresh.text[i] for i in want]
        assert np.array_equal(chunks.numbers[place], fresh.numbers[want])
    assert len(chunks.known) <= 3


def test_perfect_hash_is_minimal_and_verified():
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << 48, 20_000))
    sizes, bits = A.perfect_hash(keys)
    assert sorted(A.hashed(keys, sizes, bits).tolist()) == list(range(len(keys)))
    assert int(bits.sum()) == len(keys) and len(bits) < 5 * len(keys)
    placed = np.empty_like(keys)
    placed[A.hashed(keys, sizes, bits)] = keys
    row = {"sizes": sizes, "bits": bits, "keys": placed}
    assert np.array_equal(placed[A.verified(keys[:100], row)], keys[:100])
    with pytest.raises(RuntimeError):
        A.verified(np.array([keys[0], -5]), row)
    assert A.perfect_hash(np.zeros(0, np.int64))[1].size == 0


def test_tables_of_edge_rows_and_empty(spark, tmp_path):
    rows = [(r[0], r[1]) for r in EDGE_ROWS]
    got = A.align(spark, saved(spark, edge_docs(spark), tmp_path / "d"), SOURCE, MODEL)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert A.align(spark, saved(spark, empty_docs(spark), tmp_path / "e"), SOURCE, MODEL).count() == 0


def test_texts_are_read_and_aligned_once(spark, tmp_path):
    """Before, a second pass read and aligned all texts again."""
    folder = tmp_path / "d"
    docs = saved(spark, spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3), folder)
    got = A.align(spark, docs, SOURCE, MODEL)
    assert any(str(folder) in f for f in docs.inputFiles())
    assert not any(str(folder) in f for f in got.inputFiles())
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)
