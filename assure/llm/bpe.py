"""Byte-level BPE by higher-order functions: ranked merges fold over the byte arrays of distinct words.

In these vocabularies a piece's rank is its id, and all ids are below 55,296, so an id is written as the
character with that code point and a sequence of ids as a string. The rank map is a literal: an array of small
maps from two neighbouring ids to the id of the merged piece, a pair's bucket being computed from its hash. A
word starts as the ids of its bytes; each step of the fold merges the pair of the least rank.

Words of a text are the matches of the pattern. The frequent ones, a table of bounded size, are folded once.
Texts are taken in groups of bounded bytes: a group's distinct words are looked up in that table by hash, those
that it lacks are folded once for the group, and each text takes their ids by position.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

PAIR_BUCKETS = 32_749
#: Words in the table of frequent ones at most; ties at its end are left out together.
TABLE_WORDS = 1 << 19
#: Bytes of words in the texts whose distinct words are folded together; a longer text is a group of its own.
GROUP_BYTES = 4 << 20
#: Most ids: code points below the surrogates.
IDS = 0xD800
#: Bytes that are folded at once; a fold's cost grows with their square, so a long word's windows are short.
WINDOW = 24
#: No merge, and the edge of a word: above all ids.
NONE, EDGE = "\uffff", "\ufffe"
#: Stands for the id 0 in a call that would drop it.
ZERO = "\ud7ff"


class Vocabulary:
    """The pieces of a rank file: ids, the merges of two pieces, and the literals made from them."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max(self.ids.values()) >= IDS - 1:
            raise ValueError(f"{path}: ids must be below {IDS - 1}")
        self.merges = {}
        for piece, n in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    self.merges[chr(a) + chr(b)] = chr(n)
        self.bytes_ = "".join(chr(self.ids[bytes([b])]) for b in range(256))
        #: Pieces that their own merges don't lead to; the tokenizer takes a word that is a piece at once.
        self.whole = {p: chr(n) for p, n in self.ids.items() if self.merge(p) != chr(n)}
        self.window = WINDOW

    def merge(self, word: bytes) -> str:
        """The ids of a word of any length, by a heap of its neighbouring pairs."""
        ids = [self.bytes_[b] for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        merges = self.merges
        heap = [(m, i, i + 1) for i in range(len(ids) - 1) if (m := merges.get(ids[i] + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            m, i, j = heapq.heappop(heap)
            if ids[i] is None or after[i] != j or merges.get(ids[i] + ids[j]) != m:
                continue  # one of the two has been merged since
            ids[i], ids[j] = m, None
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if new := merges.get(m + ids[k]):
                    heapq.heappush(heap, (new, i, k))
            h = before[i]
            if h >= 0 and (new := merges.get(ids[h] + m)):
                heapq.heappush(heap, (new, h, i))
        return "".join(x for x in ids if x is not None)

    def encode(self, word: str) -> str:
        raw = word.encode("utf-8", "replace")
        return chr(self.ids[raw]) if raw in self.ids else self.merge(raw)

    def rank_map(self) -> list[dict[str, str]]:
        """Buckets of pair -> the merged id."""
        buckets: list[dict[str, str]] = [{} for _ in range(PAIR_BUCKETS)]
        for pair, merged in self.merges.items():
            h = xxhash.xxh64_intdigest(pair.encode("utf-8"), 42)
            buckets[(h - (h >> 63 << 64)) % PAIR_BUCKETS][pair] = merged
        return buckets

    def pieces(self) -> list[str]:
        """The hex of each piece, by id."""
        table = [""] * (max(self.ids.values()) + 1)
        for piece, n in self.ids.items():
            table[n] = piece.hex()
        return table


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def with_literals(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """rows with _ranks and _pieces: the rank map and the pieces as constants of the plan.

    They are scalar subqueries over a stored row: literals once the plan runs, in Spark's compact form, and not
    printed with the plan. An expression is to use each column once; Spark then puts the constant into it.
    """
    text = [(json.dumps(vocab.rank_map()), json.dumps(vocab.pieces()))]
    made = rows.sparkSession.createDataFrame(text, "ranks string, pieces string")
    row = stored(made.select(F.from_json("ranks", "array<map<string,string>>").alias("ranks"), F.from_json("pieces", "array<string>").alias("pieces")))
    return rows.withColumns({"_ranks": row.select("ranks").scalar(), "_pieces": row.select("pieces").scalar()})


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


def encoder(vocab: Vocabulary, ranks: Column, pieces: Column) -> Callable[[Column], Column]:
    """word -> its ids, as an expression: the fold of ranked merges over the word's bytes, window by window.

    Ids are the encoding of a word if those of each two neighbours are the encoding of what the two stand for: no merge
    between others could come before. So a window's ids are kept up to one that begins in its first half, if the window
    that begins there begins with the same id. Else more of the text to the right decides: the window is doubled. Where
    that changes the id at which the window before it ended, that one is doubled, or else the word begins anew with windows
    twice as wide.
    """
    latin = "".join(map(chr, range(256)))
    # translate() would drop a character that goes to U+0000
    start = vocab.bytes_.replace("\0", ZERO)

    def rank(pair: Column) -> Column:
        """The merged id of a pair; null if there is no such merge."""
        return F.get(ranks, F.pmod(F.xxhash64(pair), F.lit(PAIR_BUCKETS)).cast("int"))[pair]

    def one_merge(state: Column) -> Column:
        """The leftmost pair of the least rank is merged, and its two neighbours looked up."""
        s, r = state["s"], state["r"]

        def at(p: Column) -> Column:
            m = F.get(r, p - 1)
            around = F.array(F.concat(F.substr(s, p - 1, F.lit(1)), m), F.concat(m, F.substr(s, p + 2, F.lit(1))))
            return F.struct(
                F.concat(F.substr(s, F.lit(1), p - 1), m, F.substr(s, p + 2)).alias("s"),
                F.concat(F.slice(r, F.lit(1), p - 2), F.transform(around, lambda x: F.coalesce(rank(x), F.lit(NONE))), F.slice(r, p + 2, F.size(r))).alias("r"),
            )

        least = F.array_min(r)
        return F.when(least == NONE, state).otherwise(_let(F.array_position(r, least).cast("int"), at))

    def merged(raw: Column) -> Column:
        # an edge at both ends merges with nothing, so that every merge has a neighbour on both sides
        s = F.concat(F.lit(EDGE), raw, F.lit(EDGE))
        first = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.coalesce(rank(F.substr(s, i, F.lit(2))), F.lit(NONE)))
        steps = F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1)))
        done = F.aggregate(steps, F.struct(s.alias("s"), first.alias("r")), lambda state, _: one_merge(state))
        return F.translate(done["s"], EDGE, "")

    def starts(ids: Column) -> Column:
        """Where each id's bytes begin, and where the last's end."""
        sizes = F.transform(F.split(ids, ""), lambda x: F.length(F.get(pieces, F.ascii(x))).cast("int") / 2)
        return F.aggregate(sizes, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array((F.element_at(acc, -1) + x).cast("int"))))

    def fold(raw: Column) -> Column:
        return _let(F.encode(raw, "UTF-16BE"), folded)

    def folded(raw: Column) -> Column:
        """raw: two bytes for each id, so that a window is found by its place."""
        n, width = (F.octet_length(raw) / 2).cast("int"), vocab.window

        def state(at: Column, wide: Column, base: Column, done: Column, ids: Column, before: Column | None = None) -> Column:
            """before: at, wide, done and ids of the window before this one; wide is 0 where it isn't known."""
            none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("wide"), F.lit("").alias("done"), F.lit("").alias("ids"))
            return F.struct(at.alias("at"), wide.alias("wide"), base.alias("base"), done.alias("done"), ids.alias("ids"), (none if before is None else before).alias("before"))

        def window(at: Column, wide: Column) -> Column:
            return merged(F.decode(F.substr(raw, at * 2 + 1, wide * 2), "UTF-16BE"))

        def step(now: Column) -> Column:
            at, wide, base, done, ids, before = (now[c] for c in ("at", "wide", "base", "done", "ids", "before"))
            anew = state(F.lit(0), base * 2, base * 2, F.lit(""), window(F.lit(0), base * 2))

            def begins_alike(a: Column, new: Column, old: Column) -> Column:
                return (a == 0) | (F.substr(new, F.lit(1), F.lit(1)) == F.substr(old, F.lit(1), F.lit(1)))

            def back(new: Column) -> Column:
                same = (before["wide"] > 0) & begins_alike(before["at"], new, before["ids"])
                return F.when(same, state(before["at"], before["wide"] * 2, base, before["done"], new)).otherwise(anew)

            def doubled(new: Column) -> Column:
                again = _let(window(before["at"], before["wide"] * 2), back)
                return F.when(begins_alike(at, new, ids), state(at, wide * 2, base, done, new, before)).otherwise(again)

            wider = _let(window(at, wide * 2), doubled)
            mine = F.struct(at.alias("at"), wide.alias("wide"), done.alias("done"), ids.alias("ids"))

            def cut(places: Column) -> Column:
                # of the ids that begin in the first half the last; the second id if only one does
                j = F.greatest(F.size(F.filter(places, lambda p: p * 2 <= wide)) - 1, F.lit(1))

                def kept(q: Column) -> Column:
                    def next_window(new: Column) -> Column:
                        same = F.substr(new, F.lit(1), F.lit(1)) == F.substr(ids, j + 1, F.lit(1))
                        return F.when(same, state(at + q, base, base, F.concat(done, F.substr(ids, F.lit(1), j)), new, mine)).otherwise(wider)

                    return F.when(j >= F.size(places) - 1, wider).otherwise(_let(window(at + q, base), next_window))

                return _let(F.get(places, j), kept)

            return F.when(at + wide >= n, now).otherwise(_let(starts(ids), cut))

        # a window moves on by a quarter, about; a word that isn't done after so many steps is folded as one
        steps = F.when(n <= width, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), (n * 8 / width).cast("int") + 8))
        first = state(F.lit(0), F.lit(width), F.lit(width), F.lit(""), window(F.lit(0), F.lit(width)))
        last = F.aggregate(steps, first, lambda now, _: step(now))
        return _let(last, lambda x: F.when(x["at"] + x["wide"] >= n, F.concat(x["done"], x["ids"])).otherwise(window(F.lit(0), n)))

    def encode(word: Column) -> Column:
        raw = F.replace(F.translate(F.decode(word.cast("binary"), "ISO-8859-1"), latin, start), F.lit(ZERO), F.lit("\0"))
        ids = _let(raw, fold)
        for piece, n in vocab.whole.items():
            ids = F.when(word.cast("binary") == F.lit(piece), F.lit(n)).otherwise(ids)
        return F.when(F.length(word) == 0, F.lit("")).otherwise(ids)

    return encode


def decoder(pieces: Column) -> Callable[[Column], Column]:
    """ids -> the bytes of their pieces one after the other, as an expression."""

    def decode(ids: Column) -> Column:
        each = F.when(F.length(ids) > 0, F.split(ids, "")).otherwise(F.array().cast("array<string>"))
        return F.unhex(F.array_join(F.transform(each, lambda n: F.get(pieces, F.ascii(n))), ""))

    return decode


def words(text: Column, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The matches of the tokenizer's pattern; \\s is Unicode white space there."""
    pattern = pattern.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def _groups(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows of up to GROUP_BYTES each, one row at least."""
    runs, first, held = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and held + size > GROUP_BYTES:
            runs.append((first, i))
            first, held = i, 0
        held += size
    return [*runs, (first, len(sizes))] if len(sizes) else runs


def _of_word(vocab: Vocabulary, then: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """then(word -> struct of its ids and of the decoded bytes, back), with the literals of with_literals()."""

    def made(ranks: Column, pieces: Column) -> Callable[[Column], Column]:
        encode, decode = encoder(vocab, ranks, pieces), decoder(pieces)
        return lambda word: _let(encode(word), lambda ids: F.struct(ids.alias("ids"), decode(ids).cast("string").alias("back")))

    return _let(F.col("_ranks"), lambda ranks: _let(F.col("_pieces"), lambda pieces: then(made(ranks, pieces))))


def frequent(docs: DataFrame, vocab: Vocabulary, most: int = TABLE_WORDS) -> DataFrame:
    """hash, word, ids, other (the decoded bytes where they aren't the word's): the words that occur most, twice at least."""
    counts = stored(docs.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1"))
    by_count = counts.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.desc("n")).toLocalIterator()
    least, room = None, most
    for row in by_count:
        if row["m"] > room:
            break
        least, room = row["n"], room - row["m"]
    kept = counts.where(F.col("n") >= least) if least else counts.limit(0)
    known = with_literals(kept, vocab).select("word", _of_word(vocab, lambda of: of(F.col("word"))).alias("e"))
    return known.select(F.xxhash64("word").alias("hash"), "word", F.col("e.ids").alias("ids"), F.when(F.col("e.back") != F.col("word"), F.col("e.back")).alias("other"))


class Table:
    """The frequent words, in order of hash."""

    def __init__(self, rows: pa.Table):
        self.hashes = rows["hash"].to_numpy()
        self.word, self.ids, self.other = (rows[c].combine_chunks() for c in ("word", "ids", "other"))

    def known(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """ids and decoded bytes of each word; null where the table lacks it."""
        if not len(self.hashes) or not len(words):
            return pa.nulls(len(words), pa.string()), pa.nulls(len(words), pa.string())
        own = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words)).view(np.int64)
        at = pa.array(np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1))
        same = pc.equal(self.word.take(at), words)
        none = pa.scalar(None, pa.string())
        return pc.if_else(same, self.ids.take(at), none), pc.if_else(same, pc.coalesce(self.other.take(at), words), none)


def encoded(docs: DataFrame, path: str | None = None, carry: tuple[str, ...] | None = None, table_words: int = TABLE_WORDS) -> DataFrame:
    """docs' columns with _ids (a string of id characters) and _decoded (their bytes) of each text.

    docs: text and any other columns; carry: those of them to return, all by default. A null text counts as empty.
    table_words bounds the table of frequent words; the results do not depend on it.
    """
    vocab = vocabulary(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = list(carry) if carry is not None else docs.columns
    table = docs.sparkSession.sparkContext.broadcast(Table(stored(frequent(docs, vocab, table_words)).orderBy("hash").toArrow()))
    pa.default_memory_pool().release_unused()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, lists = batch.column("_row"), batch.column("_words")
            ends = lists.offsets.to_numpy()
            bytes_ = np.concatenate([[0], np.cumsum(pc.binary_length(lists.values).to_numpy(zero_copy_only=False))])
            for a, b in _groups(np.diff(bytes_[ends])):
                coded = lists.values.slice(ends[a], ends[b] - ends[a]).dictionary_encode()
                ids, back = table.value.known(coded.dictionary)
                lacks = ids.is_null().to_numpy(zero_copy_only=False)
                # runs of known words, each up to a word that the table lacks or to its text's end
                gone = np.flatnonzero(lacks[coded.indices.to_numpy()])
                bounds = ends[a : b + 1] - ends[a]
                cuts = pa.array(np.sort(np.concatenate([bounds, gone + 1])), pa.int32())
                runs = [pc.binary_join(pa.ListArray.from_arrays(cuts, pc.fill_null(x, "").take(coded.indices)), "") for x in (ids, back)]
                per_text = np.searchsorted(gone, bounds)
                segments, places = pa.array(per_text + np.arange(len(bounds)), pa.int32()), pa.array(per_text, pa.int32())
                at = pa.array((np.cumsum(lacks) - 1)[coded.indices.to_numpy()[gone]], pa.int32())
                parts = [*(pa.ListArray.from_arrays(segments, x) for x in runs), pa.ListArray.from_arrays(places, at)]
                columns = (rows.slice(a, b - a), *parts, coded.dictionary.filter(pa.array(lacks)))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns], names)

    names = ["_rows", "_ids", "_back", "_at", "_lacking"]
    cut = docs.select(F.struct(*[F.col(c) for c in own], F.lit(0).alias("_")).alias("_row"), words(F.col("text")).alias("_words"))
    strings = T.ArrayType(T.StringType())
    kinds = [T.ArrayType(cut.schema["_row"].dataType), T.ArrayType(strings), T.ArrayType(strings), T.ArrayType(T.ArrayType(T.IntegerType())), strings]
    groups = with_literals(cut.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])), vocab)

    def joined(text: Column, new: Column, name: str) -> Column:
        return F.array_join(F.zip_with(text[f"_{name}"], text["_at"], lambda part, i: F.concat(part, F.coalesce(F.get(new, i)[name], F.lit("")))), "")

    def of_texts(new: Column) -> Column:
        each = F.arrays_zip("_rows", "_ids", "_back", "_at")
        return F.transform(each, lambda t: F.struct(t["_rows"].alias("row"), joined(t, new, "ids").alias("ids"), joined(t, new, "back").alias("back")))

    new = _of_word(vocab, lambda of: F.transform("_lacking", of))
    texts = groups.select(F.inline(_let(new, of_texts)))
    return texts.select(*[F.col("row")[c].alias(c) for c in own], F.col("ids").alias("_ids"), F.col("back").cast("binary").alias("_decoded"))


def id_bytes(ids: Column) -> Column:
    """ids as little-endian unsigned 32-bit integers."""
    return F.encode(F.regexp_replace(ids, "(?s)(.)", "$1\0"), "UTF-16LE")


def id_array(ids: Column) -> Column:
    """ids as an array of whole numbers."""
    return F.when(F.length(ids) > 0, F.transform(F.sequence(F.lit(1), F.length(ids)), lambda i: F.ascii(F.substr(ids, i, F.lit(1))))).otherwise(F.array().cast("array<int>"))


def byte_bpe(docs: DataFrame, path: str | None = None, table_words: int = TABLE_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs (doc_id, text).

    A null text counts as empty: no tokens, hashes of no bytes. Whole texts and words of any length are
    encoded; repeated rows give repeated results, an empty table an empty one; other columns are ignored.
    """
    rows = encoded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, carry=("doc_id",), table_words=table_words)
    return rows.select(
        "doc_id", F.length("_ids").cast("long").alias("n_tokens"), F.sha2(id_bytes(F.col("_ids")), 256).alias("ids_sha256"),
        F.sha2("_decoded", 256).alias("decoded_sha256"),
    )
