import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.fixtures import docs_of, empty_docs
from verdant.llm import packing as pk

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(VOCABULARY)


def check(rows, texts, plain, capacity=pk.CAPACITY):
    """Every piece is where it says, every sequence is gapless and not too long; returns the number of sequences."""
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [pk.END] for i, t in texts.items()}
    cut, placed = defaultdict(list), defaultdict(list)
    for r in rows:
        cut[r.doc_id].append((r.piece, r.start, r.length))
        placed[r.sequence_id].append((r.offset, r.length))
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r.ids_crc32
    for i, t in ids.items():
        assert [(s, n) for _, s, n in sorted(cut[i])] == pk.cuts(len(t)) and [p for p, _, _ in sorted(cut[i])] == list(range(len(cut[i])))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(cut) == len(texts)
    return len(placed), -(-sum(map(len, ids.values())) // capacity)


def test_given_documents(spark, plain):
    at = "/root/testdata/sf0.01/documents.parquet"
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{at}'").fetchall())
    used, least = check(pk.pack(pk.pieces(spark.read.parquet(at), VOCABULARY)).collect(), texts, plain)
    assert used <= least * 1.01 + 1


def test_encoding_in_parts_equals_encoding_whole(plain):
    rng = random.Random(8)
    texts = ["", " ", "  ", "a  b", "a \nb", "a\n b", " lead", "trail ", "don't we'll", "é ñ x 　 y", "a b c", "x\x1c y \x1f", "12 34  56", "🎉 🎉\t🎉", "<|endoftexT|> a"]
    texts += ["".join(rng.choices(" \n\tab'sé1!漢 ", k=rng.randrange(40))) for _ in range(3000)]
    end = "<|endoftext|>"
    texts += [f"{end} hi", f"hi {end}", f"a b {end} c d", f"a{end}b c", end, end + end, f" {end} {end}  x", f"<|endof {end}text|> y", f"{end}\n\n{end} z", "<|endof text|>"]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABC'-.,!?_0123456789<|>/ \n\n", k=rng.randrange(60))) for _ in range(5000)]
    ranks = pk.merge_ranks(VOCABULARY)
    assert len(ranks) == 50256
    for encoder in (pk.Encoder(VOCABULARY), pk.Encoder(VOCABULARY, ranks)):
        for t, ids in zip(texts, encoder.ids(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_cases(spark, plain):
    texts = [None, "", "a", "a", "word " * 5000, "x" * 3000, " y" * 1023, " y" * 1024, " y" * 1022, "<|endoftext|> hi", "a <|endoftext|> b " * 700]
    rows = pk.pack(pk.pieces(docs_of(spark, texts), VOCABULARY)).collect()
    check(rows, dict(enumerate(texts)), plain)
    assert pk.pack(pk.pieces(empty_docs(spark), VOCABULARY)).count() == 0


def test_sequences_hold_the_ids(spark, plain):
    texts = [f"text number {i} " + "more " * (i * 7) for i in range(60)]
    packed = pk.pack(pk.pieces(docs_of(spark, texts), VOCABULARY, keep_ids=True))
    whole = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in pk.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == np.frombuffer(bytes(r.ids), "<u4").tolist()


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_count_and_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(pk.CAPACITY + 1, dtype=np.int64)
    lengths = [rng.integers(1, 1025, 20000), rng.geometric(0.01, 30000) % 1024 + 1, np.full(5000, 1024), np.full(4000, 700), rng.choice([300, 400, 512, 624], 9000), rng.integers(1, 30, 50)][seed]
    np.add.at(counts, lengths, 1)
    steps = pk.plan(counts)
    used = np.zeros_like(counts)
    for row, repeats in steps:
        assert sum(row) <= pk.CAPACITY and repeats > 0
        np.add.at(used, row, repeats)
    assert (used == counts).all()
    bound = -(-int((counts * np.arange(len(counts))).sum()) // pk.CAPACITY)
    big = int(counts[pk.CAPACITY // 2 + 1 :].sum())
    total = sum(r for _, r in steps)
    assert total <= max(bound, big) * 1.02 + 1 or seed == 4
    table = pk.ranges(steps)
    assert all((np.diff(table[table[:, 0] == n][:, 1]) > 0).all() for n in np.unique(table[:, 0]))
