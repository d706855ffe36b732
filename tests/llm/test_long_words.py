"""Words of any length against the library: random letters, runs, periods, and pieces that need text to their right."""

import hashlib
import random
import struct
import time

import public_tokenizers
import pytest

from assure.llm import bpe


def texts():
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = ["".join(rng.choice(letters) for _ in range(n)) for n in (60, 500, 2000)]
    out += [c * n for c in "aze=-" for n in (255, 513, 3001)] + ["-" * 777, "é" * 900, "日本" * 700]
    out += [p * (3000 // len(p)) for p in ("ab", "abc", "the", "ation", "xyzzy", "aab")]
    common = ["tion", "ing", "th", "er", "an", "re", "inter", "national", "iz"]
    return out + ["".join(rng.choice(common) for _ in range(800)) for _ in range(6)] + ["".join(rng.choice("aab") for _ in range(1500)) for _ in range(6)]


@pytest.mark.parametrize("window", [None, 8])
def test_long_words(spark, monkeypatch, window):
    import tiktoken

    vocab = bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    if window:  # shorter than some pieces, so that windows are doubled
        vocab.window = window
        monkeypatch.setattr(bpe, "vocabulary", lambda path: vocab)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ids, special_tokens={})
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in bpe.byte_bpe(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t)
        assert got[i] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()), t[:30]


def test_a_very_long_word_takes_time_in_proportion(spark):
    rng = random.Random(3)

    def took(n):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        began = time.perf_counter()
        assert bpe.byte_bpe(spark.createDataFrame([(1, word)], "doc_id long, text string")).first()["n_tokens"] > n / 8
        return time.perf_counter() - began

    took(1000)
    assert took(100_000) < 60
