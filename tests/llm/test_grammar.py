"""Token files against the library, and the grammar as an exact round trip."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assure.llm import grammar

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, part int, ids string, first long"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocab = ["the", "river", "stone,", "Ünder", "it's", "42", "\n", "日本", "!!", "end."]
    out = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 300))), 1, "x", 2) for i in range(150)]
    out += [(7, "again", 1, "x", 2), (7, "again", 1, "x", 2), (None, "no id", 1, "x", 2), (500, None, 1, "x", 2), (501, "", 1, "x", 2)]
    out += [(502, "a" * 60_000, 1, "x", 2), (503, "la " * 30_000, 1, "x", 2), (504, "x<|endoftext|> y <|endoftext|>", 1, "x", 2), (-3, " \n\t lead  and trail ", 1, "x", 2)]
    return out


def test_files_are_the_library(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    lib = library()
    ids = {t: [*lib.encode(t or "", add_special_tokens=False).ids, 2] for _, t, *_ in rows}
    got = grammar.token_files(docs).collect()
    assert len(got) == len(rows)
    at = 0
    want_by_doc = {}
    for d, t, *_ in rows:
        want_by_doc.setdefault(d, []).append(ids[t])
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        found = next(x for x in want_by_doc[r["doc_id"]] if len(x) == r["n_tokens"] and zlib.crc32(np.array(x, "<u4").tobytes()) == r["ids_crc32"])
        want_by_doc[r["doc_id"]].remove(found)
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted([d for d in order if d is not None]) + [None]
    assert grammar.token_files(docs.limit(0)).count() == 0


def test_random_access(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    grammar.write(docs, f"file://{tmp_path}/files", shard_ids=5000)
    files = spark.read.parquet(f"file://{tmp_path}/files")
    assert files.count() >= 8
    lib = library()
    full = {d: [*lib.encode(t or "", add_special_tokens=False).ids, 2] for d, t, *_ in rows if d is not None}
    rng = random.Random(2)
    spans = [(d, rng.randint(0, len(x)), rng.randint(0, 50)) for d, x in full.items() if d != 7 for _ in range(3)] + [(999, 0, 5), (503, 70_000, 40), (502, 0, 10**9)]
    got = grammar.slices(files, spark.createDataFrame(spans, "doc_id long, first long, n long")).collect()
    assert all(r["ids"] == full[r["doc_id"]][r["first"] : r["first"] + r["n"]] for r in got)
    assert {(r["doc_id"], r["first"], r["n"]) for r in got} == {s for s in spans if s[0] != 999}
    back = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in grammar.read(files).collect() if r["doc_id"] is not None}
    assert back.keys() == full.keys() and all(back[d] == full[d] for d in full if d != 7)


def test_grammar_is_a_round_trip():
    rng = np.random.default_rng(3)
    for case in range(120):
        n, kinds = int(rng.integers(1, 3000)), int(rng.integers(1, 40))
        ids = rng.zipf(1.5, n).clip(1, kinds).astype(np.uint16)
        if case % 4 == 0:  # runs, in which a pair overlaps itself
            ids = np.repeat(ids, rng.integers(1, 9, n))[:n]
        ends = np.unique(np.append(rng.integers(1, n + 1, int(rng.integers(0, 20))), n))
        symbols, cut, rules, lengths = grammar.compress(ids, ends, 50, least=2)
        shard = grammar.Shard(symbols.tobytes(), rules.tobytes(), lengths.tobytes(), cut, 50)
        assert (shard.ids() == ids).all() and len(cut) == len(ends)
        assert all(len(grammar.expand(np.array([50 + k]), shard.rules, shard.lengths, 50)) == w for k, w in enumerate(lengths.tolist()))
        starts = np.concatenate([[0], ends[:-1]])
        for k in range(len(ends)):
            a, m = int(rng.integers(0, ends[k] - starts[k] + 1)), int(rng.integers(0, 60))
            assert (shard.slice(k, a, m) == ids[starts[k] : ends[k]][a : a + m]).all()
    ids = np.tile(np.array([5, 6, 7, 8], np.uint16), 4096)
    symbols, _, rules, lengths = grammar.compress(ids, np.array([len(ids)]), 50)
    assert len(symbols) < 20 and (grammar.expand(symbols, rules, lengths, 50) == ids).all()


def test_pieces_are_cut_where_words_begin():
    rng, lib, coder = random.Random(1), library(), grammar.encoder_of(PATH)
    parts = ["a", "B", " ", " ", " b", ",", "\0", "  ", "\n", "\t", "\x85", "\xa0", " ", "\x1c", "'s", "'", "12", "!", "<|endoftext|>", "<|endof", "é", "日本", "\r\n", "don't", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(40_000)]
    want = [np.array(e.ids, "<u2").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert coder.encode(pa.array(texts)).to_pylist() == want == coder.encode(pa.array(texts)).to_pylist()
    assert coder.encode(pa.array([], pa.string())).to_pylist() == []


def test_columns_with_the_names_of_the_format(spark, rows):
    docs = spark.createDataFrame(rows[:20], SCHEMA).withColumns({"symbols": F.lit(1), "h": F.lit(2), "m": F.lit(3)})
    assert grammar.token_files(docs).count() == 20
