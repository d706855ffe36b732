"""Token files under Re-Pair grammars: frequent id pairs become nonterminals, shard by shard, with random access.

Texts are dealt in ranges of doc_id and sorted, so that a partition's documents follow each other in the files. A task
encodes them, appends the end id to each, and gathers shards of about two million ids. In a shard, round by round, the
frequent pairs of neighbouring symbols are replaced by nonterminals: those of a round are taken from the most frequent
down, so that no symbol is the left of one and the right of another; their occurrences then cannot overlap. A pair never
crosses the end of a document. It ends when no pair is frequent enough or all 16-bit symbols are used.

The format is a Parquet table with a row for each shard:

    part, seq      the range of doc_id and the place in it; shards in this order hold the documents in ascending doc_id
    before, n_ids  ids of the range before this shard, and in it
    doc_id, ids    of each document in turn: its id and its number of ids, the end id included
    ends           of each document: where its symbols end
    symbols        16 bits each, little-endian: ids, and from the number of ids on the nonterminals
    rules          two symbols of 16 bits for each nonterminal, made of ids and earlier nonterminals
    lengths        32 bits for each nonterminal: how many ids it stands for

A slice of a document is found by adding up lengths, and only the symbols that cover it are expanded.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored
from .tokens import CALL_BYTES

#: Appended to each document by default.
END = 2
#: Ids of a shard, about; a longer document is a shard of its own.
SHARD_IDS = 1 << 21
#: Occurrences that a pair must have in its shard for a rule: a rule takes 8 bytes and saves 2 bytes an occurrence.
LEAST = 8
#: Of the count of a round's most frequent pair, what its other pairs must reach.
SHARE = 1 / 32
SYMBOLS = 1 << 16
#: Bytes of texts that are cut and encoded together.
GROUP_BYTES = 8 << 20
#: Pieces that a worker remembers, about.
PIECES = 1 << 20
#: Stands where a text may be cut; a text that has it is encoded as it is.
CUT = "\0"
#: White space as the tokenizer's pattern takes it, and the information separators; the same without the line feed.
SPACES, NOT_LF = (rf"\x{{9}}{lf}\x{{B}}-\x{{D}}\x{{1C}}-\x{{20}}\x{{85}}\p{{Z}}" for lf in (r"\x{A}", ""))
#: Next to each other no white space but two line feeds before a word: in a text without these, a new word begins at every
#: space and at every line feed, whatever comes before.
UNCUT = rf"[{SPACES}][{NOT_LF}]|[{NOT_LF}]\n|\n\n\n|\n\n\z|\x{{0}}"
#: A new word begins with the mark after a letter.
MARKED = r"(\p{L})([.,;:!?])"


def runs(sizes: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` bytes; a longer text is alone."""
    first, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > first and held + size > most:
            yield first, k
            first, held = k, 0
        held += size
    if len(sizes):
        yield first, len(sizes)


class Encoder:
    """The tokenizers library over pieces that begin where a word must begin; a piece is encoded once while it is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ids = self.tokenizer.get_vocab_size()
        if self.ids > SYMBOLS:
            raise ValueError(f"{path}: ids must fit in 16 bits")
        special = self.tokenizer.get_added_tokens_decoder()
        #: Bytes of each id's piece; a piece is written with a character for each byte, a special one as it is.
        self.bytes = np.array([len(special[n].content.encode() if n in special else self.tokenizer.id_to_token(n)) for n in range(self.ids)])
        # a special token ends the text before it; in RE2, each of its characters by its code
        self.uncut = "|".join([UNCUT, *("".join(rf"\x{{{ord(c):X}}}" for c in t.content) for t in special.values())])
        self.forget()

    def forget(self) -> None:
        self.pieces, self.coded = pa.array([], pa.string()), pa.array([], pa.binary())

    def _plain(self, texts: list[str]) -> pa.Array:
        return pa.array([np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)], pa.binary())

    def _words(self, pieces: pa.Array) -> pa.Array:
        """Pieces of a space or line feed and a word each: they can follow each other, so they are encoded as one text and told apart by their bytes."""
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), "")[0].as_py()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(pc.binary_length(pieces).to_numpy())) + 1
        offsets = np.concatenate([[0], 2 * ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(pieces), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Remember the ids of pieces that each begin a word; where each of them is kept."""
        word = pc.match_substring_regex(new, rf"^[ \n].*[^{SPACES}]\z")
        words, others = new.filter(word), new.filter(pc.invert(word))
        calls = runs(pc.binary_length(words).to_numpy(), CALL_BYTES)
        coded = [self._words(words.slice(a, b - a)) for a, b in calls]
        is_word = word.to_numpy(zero_copy_only=False)
        at = len(self.pieces) + np.where(is_word, np.cumsum(is_word) - 1, len(words) + np.cumsum(~is_word) - 1)
        self.pieces = pa.concat_arrays([self.pieces, words, others])
        self.coded = pa.concat_arrays([self.coded, *coded, self._plain(others.to_pylist())])
        return at

    def _ids(self, pieces: pa.Array) -> pa.Array:
        if len(self.pieces) > PIECES:
            self.forget()
        found = pc.index_in(pieces, self.pieces)
        lacking, at = found.is_null(), pc.fill_null(found, 0).to_numpy().copy()
        at[lacking.to_numpy(zero_copy_only=False)] = self._learn(pieces.filter(lacking))
        return self.coded.take(pa.array(at))

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text, 16 bits each: a text is cut where words must begin, where it shows that, else encoded as it is."""
        uncut = pc.match_substring_regex(texts, self.uncut)
        cut = pc.replace_substring_regex(pc.if_else(uncut, "", texts), MARKED, rf"\1{CUT}\2")
        for space in " \n":
            cut = pc.replace_substring(cut, space, CUT + space)
        lists = pc.split_pattern(cut, CUT)
        coded = lists.values.dictionary_encode()
        ids = self._ids(coded.dictionary).take(coded.indices)
        found = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, ids), b"")
        return pc.replace_with_mask(found, uncut, self._plain(texts.filter(uncut).to_pylist()))


@cache
def encoder_of(path: str) -> Encoder:
    """One for each Python worker, which Spark uses again for later tasks."""
    return Encoder(path)


def _frequent(pairs: np.ndarray, least: int, room: int) -> np.ndarray:
    """Of all pairs (left << 16 | right), those to be replaced together, the most frequent first; left and right share no symbol, or are the same."""
    pairs = np.sort(pairs)
    if not len(pairs):
        return pairs
    at = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    counts = np.diff(np.concatenate([at, [len(pairs)]]))
    often = counts >= max(least, counts.max() * SHARE)
    pairs, counts = pairs[at[often]], counts[often]
    lefts, rights, twins, chosen = set(), set(), set(), []
    for pair in pairs[np.lexsort((pairs, -counts))].tolist():
        a, b = pair >> 16, pair & 0xFFFF
        if a in rights or b in lefts or a in twins or b in twins or (a == b and a in lefts):
            continue
        if a == b:
            twins.add(a)
        else:
            lefts.add(a)
            rights.add(b)
        chosen.append(pair)
        if len(chosen) == room:
            break
    return np.array(chosen, np.uint32)


def _alternate(hits: np.ndarray) -> np.ndarray:
    """Of neighbouring places every other one, from the first of each run."""
    starts = np.flatnonzero(np.concatenate([[True], np.diff(hits) != 1])) if len(hits) else hits
    run = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(hits)]]))) if len(hits) else hits
    return hits[(np.arange(len(hits)) - starts[run]) % 2 == 0] if len(hits) else hits


def compress(ids: np.ndarray, ends: np.ndarray, terminals: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """symbols, ends, rules, lengths of a shard: ids of its documents one after the other, each up to its end, none empty."""
    s = ids.astype(np.uint32)
    last = np.zeros(len(s), bool)
    last[ends - 1] = True
    rules, length = [], np.ones(SYMBOLS, np.int64)
    made = terminals
    while made < SYMBOLS and len(s) > 1:
        every, inside = s[:-1] << 16 | s[1:], ~last[:-1]
        pairs = _frequent(every[inside], least, SYMBOLS - made)
        if not len(pairs):
            break
        a, b = pairs >> 16, pairs & 0xFFFF
        new = np.arange(made, made + len(pairs), dtype=np.uint32)
        side = np.zeros(SYMBOLS, np.uint8)
        side[a] |= 1
        side[b] |= 2
        sides = side[s]
        hits = np.flatnonzero((sides[:-1] & sides[1:] >> 1 & 1).view(bool) & inside)
        order = np.argsort(pairs)
        key = every[hits]
        at = np.minimum(np.searchsorted(pairs[order], key), len(pairs) - 1)
        same = pairs[order][at] == key
        hits, at = hits[same], order[at[same]]
        # only a pair of twins overlaps itself
        twin = (a == b)[at]
        if twin.any():
            kept = np.ones(len(hits), bool)
            kept[twin] = np.isin(hits[twin], _alternate(hits[twin]), assume_unique=True)
            hits, at = hits[kept], at[kept]
        s[hits] = new[at]
        last[hits] = last[hits + 1]
        stay = np.ones(len(s), bool)
        stay[hits + 1] = False
        s, last = s[stay], last[stay]
        rules.append(np.stack([a, b], 1))
        length[new] = length[a] + length[b]
        made += len(pairs)
    rules = np.concatenate(rules) if rules else np.zeros((0, 2))
    return s.astype("<u2"), np.flatnonzero(last) + 1, rules.astype("<u2"), length[terminals:made].astype("<u4")


def _opened(s: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """The ids that symbols stand for; every step opens all nonterminals once, as deep as the rules go."""
    while (open_ := s >= terminals).any():
        at = np.flatnonzero(open_)
        pair = rules[s[at] - terminals]
        s = np.repeat(s, 1 + open_)
        at += np.arange(len(at))
        s[at], s[at + 1] = pair[:, 0], pair[:, 1]
    return s


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, terminals: int) -> np.ndarray:
    """The ids that symbols stand for: the nonterminals among them are opened once each, then taken by place."""
    rule = np.flatnonzero(symbols >= terminals)
    kinds, which = np.unique(symbols[rule].astype(np.int64), return_inverse=True)
    table = np.concatenate([np.arange(terminals), _opened(kinds, rules, terminals)]).astype("<u4")
    wide = lengths[kinds - terminals].astype(np.int32)
    start, size = symbols.astype(np.int32), np.ones(len(symbols), np.int32)
    start[rule], size[rule] = (terminals + np.cumsum(wide, dtype=np.int32) - wide)[which], wide[which]
    to = np.cumsum(size, dtype=np.int64)
    out = np.repeat(start - (to - size), size)
    out += np.arange(len(out))
    return table[out]


class Shard:
    """A row of the files."""

    def __init__(self, symbols: bytes, rules: bytes, lengths: bytes, ends: np.ndarray, terminals: int):
        self.symbols, self.ends, self.terminals = np.frombuffer(symbols, "<u2"), ends, terminals
        self.rules, self.lengths = np.frombuffer(rules, "<u2").reshape(-1, 2), np.frombuffer(lengths, "<u4")

    def ids(self) -> np.ndarray:
        """All ids of the shard."""
        return expand(self.symbols, self.rules, self.lengths, self.terminals)

    def slice(self, k: int, first: int, n: int) -> np.ndarray:
        """n ids of document k from its id `first` on, as many as it has: expands only the symbols that cover them."""
        s = self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]]
        wide = np.ones(len(s), np.int64)
        rule = s >= self.terminals
        wide[rule] = self.lengths[s[rule].astype(np.int64) - self.terminals]
        to = np.cumsum(wide)
        a, b = np.searchsorted(to, first, "right"), np.searchsorted(to, first + max(n, 0), "left") + 1
        skip = first - (to[a - 1] if a else 0)
        return expand(s[a:b], self.rules, self.lengths, self.terminals)[skip : skip + max(n, 0)]


COLUMNS = "part int, seq int, before long, n_ids long, doc_id array<long>, ids array<long>, ends array<long>, symbols binary, rules binary, lengths binary"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def shards(docs: DataFrame, path: str, end: int, shard_ids: int = SHARD_IDS, least: int = LEAST) -> DataFrame:
    """The rows of the files (see above) of docs (doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # one id may have many rows: they are dealt by text and place too
    keyed = own.select("*", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m"))
    keys = [F.asc_nulls_last("doc_id"), F.asc("h"), F.asc("m")]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(path), TaskContext.get().partitionId()
        mark = np.array([end], "<u2").tobytes()
        held: list[bytes] = []
        doc_ids: list[int | None] = []
        n = seq = before = 0

        def shard() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u2")
            sizes = np.array([len(h) // 2 for h in held])
            symbols, ends, rules, lengths = compress(ids, np.cumsum(sizes), encoder.ids, least)
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (doc_ids, sizes.tolist(), ends.tolist())]
            payload = [pa.array([x.tobytes()], pa.binary()) for x in (symbols, rules, lengths)]
            place = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64())]
            return pa.RecordBatch.from_arrays([*place, *lists, *payload], NAMES)

        for batch in batches:
            rows, texts = iter(batch.column("doc_id").to_pylist()), batch.column("text")
            for first, stop in runs(pc.binary_length(texts).to_numpy()):
                for ids in encoder.encode(texts.slice(first, stop - first)).to_pylist():
                    held.append(ids + mark)
                    doc_ids.append(next(rows))
                    n += len(held[-1]) // 2
                    if n >= shard_ids:
                        yield shard()
                        held, doc_ids, seq, before, n = [], [], seq + 1, before + n, 0
        if held:
            yield shard()

    return dealt.mapInArrow(run, COLUMNS)


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END, shard_ids: int = SHARD_IDS) -> None:
    """Write docs' ids as files in folder, which must not exist; see the top for the format.

    docs: doc_id, text; a null text counts as empty, so its ids are the end id alone. Rows of a null doc_id come last, rows
    of one doc_id in the order of their texts' hashes. Whole texts of any length are encoded; other columns are ignored.
    """
    rows = shards(docs, path or public_tokenizers.path("byte_bpe_50k.json"), end, shard_ids)
    rows.write.option("compression", "none").parquet(folder)


def opened(files: DataFrame) -> DataFrame:
    """The files' shards with first, the number of ids before each in all files.

    Ids are added up by range of doc_id; the driver sees one number for each range.
    """
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, rows = 0, []
    for part in sorted(totals):
        rows.append((part, base))
        base += totals[part]
    offsets = files.sparkSession.createDataFrame(rows, "part int, _base long")
    return files.join(small(offsets), "part").withColumn("first", F.col("_base") + F.col("before")).drop("_base")


def read(files: DataFrame, path: str | None = None, whole_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (if whole_ids; little-endian unsigned 32-bit integers) of each document of the files.

    start: the ids of all documents before it.
    """
    terminals = encoder_of(path or public_tokenizers.path("byte_bpe_50k.json")).ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                shard = _shard(row, terminals)
                sizes = row.column("ids").flatten().to_numpy()
                to = np.cumsum(sizes)
                raw = memoryview(shard.ids().tobytes())
                texts = [raw[4 * (b - n) : 4 * b] for b, n in zip(to.tolist(), sizes.tolist())]
                columns = [row.column("doc_id").flatten(), pa.array(row.column("first")[0].as_py() + to - sizes), pa.array(sizes), pa.array([zlib.crc32(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array([bytes(t) for t in texts], pa.binary())] * whole_ids], names)

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * whole_ids
    names = [c.split()[0] for c in kinds.split(", ")]
    return opened(files).select("doc_id", "ids", "first", "ends", "symbols", "rules", "lengths").mapInArrow(run, kinds)


def _shard(row: pa.RecordBatch, terminals: int) -> Shard:
    return Shard(*(row.column(c)[0].as_py() for c in ("symbols", "rules", "lengths")), row.column("ends").flatten().to_numpy(), terminals)


def slices(files: DataFrame, spans: DataFrame, path: str | None = None) -> DataFrame:
    """spans (doc_id, first, n) with ids, an array of n ids of that document from the one numbered `first` on (fewer at its end).

    Random access: spans go to the shard that holds the document, where only what covers them is expanded. A document that
    is not there gives no row, one that is there several times a row for each.
    """
    terminals = encoder_of(path or public_tokenizers.path("byte_bpe_50k.json")).ids
    index = files.select("part", "seq", F.posexplode("doc_id").alias("k", "doc_id")).where("doc_id IS NOT NULL")
    wanted = spans.select("doc_id", F.col("first").cast("long").alias("first"), F.col("n").cast("long").alias("n")).join(index, "doc_id")
    asked = wanted.groupBy("part", "seq").agg(F.collect_list(F.struct("doc_id", "k", "first", "n")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _shard(batch.slice(i, 1), terminals)
                asked = batch.column("asked")[i].as_py()
                ids = pa.array([shard.slice(x["k"], x["first"], x["n"]) for x in asked], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in asked], pa.int64()) for c in ("doc_id", "first", "n")), ids], ["doc_id", "first", "n", "ids"])

    rows = files.join(asked, ["part", "seq"]).select("symbols", "rules", "lengths", "ends", "asked")
    return rows.mapInArrow(run, "doc_id long, first long, n long, ids array<long>")


def token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row of docs, written as token files in the shared folder and read back.

    Nulls, repeated rows and long texts as in write(); an empty table gives an empty one.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    return read(stored(shards(docs, path, END), compression="none"), path, whole_ids=False)
