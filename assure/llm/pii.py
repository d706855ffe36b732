"""PII: fixed patterns find seed entities; bootstrapped contexts find identifiers that the patterns miss.

Beside the four kinds of the fixed patterns there are secrets: keys and tokens. Strings in well-known formats are
their seeds, but none is taken for a secret by its form alone, only where patterns say so.
Seeds induce lexical patterns, the words around them. Patterns and the identifier-like strings that occur in
them form a bipartite graph, which Spark scores in rounds until one accepts nothing new: a pattern's confidence is the share of its
instances that are known, an instance's score the chance that not all of its patterns err. Instances that
score high become known and lend their weight to further patterns. Contexts and candidates have no greatest length; words and
strings over 256 characters are named by a 128-bit digest in the graph.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stored, texts_of

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
#: Kinds in the order in which spans of one start are listed.
ORDERED = (*KINDS, SECRET)
#: Known instances that a pattern needs; least confidence of a pattern, score of an instance.
SUPPORT, CONFIDENCE, SCORE = 3, 0.7, 0.7

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't begin inside a run of digits: it would have begun with the run
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_AFTER_AT = re.compile(r"@[^\s@]+")
#: Strings of digits that might be identifiers which the patterns above don't take.
_NUMBER = re.compile(r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}|(?<![0-9])[0-9]{1,3}(?:[.,:\x20]{1,3}[0-9]{1,3}){3}")
#: Strings that might be secrets: long runs of letters and digits mixed.
_MIXED = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
# Formats of well-known keys and tokens, as prefixes or as hexadecimal digits of usual lengths.
_KEYS = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|github_pat_|sk_live_|sk_test_|xoxb-|xoxp-|AIza|eyJ).*|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}", re.S)
_CONTEXT = re.compile(r"\w+|[=:#@]")
_EDGE = ".,;:!?\"'()[]{}<>"
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping; from each @ backwards, so that a long run without one costs nothing."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of each, by start and then kind."""
    spans = [(s, e, "email") for s, e in _emails(text)]
    spans += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 12 <= len(digits) <= 19 and _luhn(digits):
            spans.append((m.start(), m.end(), "card"))
    spans += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))


def _may_be(instance: str) -> list[str]:
    digits = len(_DIGITS.sub("", instance))
    if "@" in instance:
        return ["email"]
    kinds = ["ip"] if re.fullmatch(r"[0-9]{1,3}(?:[.,:\x20]{1,3}[0-9]{1,3}){3}", instance) else []
    return kinds + ["card"] * (12 <= digits <= 19) + ["phone"] * (7 <= digits <= 15)


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, apart and in order: each point inside one is inside a span."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _met(taken: tuple[list[int], list[int]], s: int, e: int) -> tuple[int, int]:
    """First and end place of the stretches that overlap s to e."""
    return bisect_right(taken[1], s), bisect_left(taken[0], e)


def mixed_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, bool]]:
    """start, end and whether it is in a well-known format, of the strings that might be secrets: base spans are within them or apart."""
    out = []
    taken = _merged([x[:2] for x in base])
    for m in _MIXED.finditer(text):
        s, e = m.span()
        own = m[0]
        digits = sum(map(own.count, "0123456789"))
        if digits < 3 or sum(map(str.isalpha, own)) < 3:
            continue
        # digits inside a key may look like a card by chance; an address reaches beyond the run
        i, j = _met(taken, s, e)
        if i >= j or (s <= taken[0][i] and taken[1][j - 1] <= e):
            out.append((s, e, bool(_KEYS.fullmatch(own))))
    return out


def _might_be(text: str) -> Iterator[tuple[int, int]]:
    """Places of strings around a single @, however long, and of number-like strings between them."""
    done = 0
    for m in _AFTER_AT.finditer(text):
        first = m.start()
        for k in range(m.start() - 1, done - 1, -1):  # back to a space, an @ or the string before: no place is passed twice
            if text[k] == "@" or text[k].isspace():
                break
            first = k
        if first < m.start():
            yield from (n.span() for n in _NUMBER.finditer(text, done, first))
            yield first, m.end()
            done = m.end()
    yield from (n.span() for n in _NUMBER.finditer(text, done))


def like_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, list[str]]]:
    """start, end and possible kinds of the identifier-like strings that overlap none of the places taken."""
    out = []
    stretches = _merged(taken)
    for s, e in _might_be(text):
        closed = text.rfind(")", s, e)
        while s < e and text[s] in _EDGE and not (text[s] == "(" and closed > s):
            s += 1
        while e > s and text[e - 1] in _EDGE:
            e -= 1
        i, j = _met(stretches, s, e)
        if e - s >= 5 and i >= j:
            kinds = _may_be(text[s:e])
            if kinds:
                out.append((s, e, kinds))
    return out


def named(word: str) -> str:
    """A word, or for one over 256 characters its digest, which stands for it in patterns and in the graph."""
    return word if len(word) <= 256 else "##" + xxhash.xxh3_128_hexdigest(word.encode("utf-8", "replace"))


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a place: the two words or signs before it, and those on both sides, whole and however far."""
    near = 64
    before: list[str] = []
    while True:  # as far back as two whole words need
        first = max(0, start - near)
        before = _CONTEXT.findall(text[first:start].lower())
        if len(before) > 2 or first == 0:
            break
        near *= 4
    m = _CONTEXT.search(text, end)
    after = m[0].lower() if m else ""
    left = (["", ""] + before[-2:])[-2:]
    return [f"{named(left[0])} {named(left[1])} _", f"{named(left[1])} _ {named(after)}"]


def _span_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scanned(docs: DataFrame) -> DataFrame:
    """A row for each document: base results, and the mentions (base and identifier-like) with their patterns."""

    def of_batch(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")[1:]}
        for text in texts_of(batch):
            base = base_spans(text)
            joined = _span_text(base)
            row = {"key": xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63), "base": joined, "base_sha256": hashlib.sha256(joined.encode()).hexdigest()}
            row |= {f"n_{k}": sum(x[2] == k for x in base) for k in KINDS}
            mixed = mixed_spans(text, base)
            like = like_spans(text, [x[:2] for x in base] + [x[:2] for x in mixed])
            # 2: a span of its own right, 1: a seed that patterns have to confirm, 0: unknown
            mentions = [(s, e, k, 2) for s, e, k in base] + [(s, e, SECRET, int(known)) for s, e, known in mixed] + [(s, e, k, 0) for s, e, ks in like for k in ks]
            row |= {"m_start": [m[0] for m in mentions], "m_end": [m[1] for m in mentions], "m_kind": [m[2] for m in mentions]}
            row |= {"m_seed": [m[3] for m in mentions], "m_text": [named(text[m[0] : m[1]].lower()) for m in mentions]}
            around = [contexts(text, m[0], m[1]) for m in mentions]
            row |= {"m_left": [c[0] for c in around], "m_both": [c[1] for c in around]}
            for name, x in row.items():
                out[name].append(x)
        return {"doc_id": batch.column("doc_id")} | out

    schema = (
        "doc_id long, key long, base string, base_sha256 string, n_email long, n_ip long, n_card long, n_phone long, "
        "m_start array<long>, m_end array<long>, m_kind array<string>, m_seed array<long>, m_text array<string>, m_left array<string>, m_both array<string>"
    )
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), of_batch, schema)


def bootstrap(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """instance, kind of the identifier-like strings that the graph accepts, in rounds until nothing new is accepted.

    pairs: distinct pattern, instance, kind, seed (2: known and a span already, 1: known, 0: not known). What is known only grows, so a round accepts all that the one
    before it did; a graph that has not settled after `rounds` is an error. Sums are of whole numbers, so a result does not depend on
    the order in which they are taken.
    """
    known = stored(pairs.where("seed > 0").select("instance", "kind").distinct())
    sizes = stored(pairs.groupBy("pattern").agg(F.count_distinct("instance").alias("instances")))
    for _ in range(rounds):
        support = pairs.join(known, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.count_distinct("instance").alias("good"))
        confident = support.where(F.col("good") >= SUPPORT).join(sizes, "pattern")
        confident = confident.withColumn("confidence", F.col("good") / (F.col("instances") + 1)).where(F.col("confidence") >= CONFIDENCE)
        doubt = F.sum(F.round(-1e6 * F.log1p(-F.col("confidence"))).cast("long"))
        scores = pairs.where("seed < 2").select("pattern", "instance", "kind").join(confident, ["pattern", "kind"]).groupBy("instance", "kind").agg(doubt.alias("weight"))
        accepted = stored(scores.where(1 - F.exp(-F.col("weight") / 1e6) >= SCORE))
        more = stored(accepted.select("instance", "kind").join(known, ["instance", "kind"], "left_anti"))
        if more.isEmpty():
            break
        known = stored(known.union(more))
    else:
        raise RuntimeError(f"the bootstrap did not settle in {rounds} rounds")
    order = F.array_position(F.array(*[F.lit(k) for k in ORDERED]), F.col("kind"))
    return accepted.groupBy("instance").agg(F.max_by("kind", F.struct("weight", -order)).alias("kind"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found of each row of docs (doc_id, text).

    The counts and base_sha256 are of the fixed patterns alone; spans holds theirs and, beside them, the
    n_found that the contexts discovered. A null text counts as empty; rows without a doc_id are told
    apart by their text. Kinds found are the four and secret, which sorts after them. Whole texts of any length are read;
    repeated rows give repeated results, and copies of a text count once as evidence of a pattern, since
    instances are counted as distinct strings. An empty table gives an empty one; other columns are ignored.
    """
    rows = stored(scanned(docs))
    columns = ("start", "end", "kind", "seed", "text", "left", "both")
    mention = F.explode(F.arrays_zip(*[F.col(f"m_{c}").alias(c) for c in columns])).alias("m")
    mentions = rows.where(F.size("m_kind") > 0).select("doc_id", "key", mention).select("doc_id", "key", "m.*")
    pattern = F.explode(F.array(F.concat(F.lit("l:"), "left"), F.concat(F.lit("b:"), "both"))).alias("pattern")
    pairs = mentions.select(pattern, F.col("text").alias("instance"), "kind", "seed").distinct()
    accepted = bootstrap(stored(pairs))
    found = (
        mentions.where("seed < 2")
        .join(accepted.select(F.col("instance").alias("text"), "kind"), ["text", "kind"])
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("start", "end", "kind")).alias("found"))
    )
    order = F.array(*[F.lit(k) for k in ORDERED])
    item = F.split(F.col("base"), ",")
    base = F.transform(
        F.filter(item, lambda x: x != ""),
        lambda x: F.struct(
            F.element_at(F.split(x, ":"), 2).cast("long").alias("start"), F.array_position(order, F.element_at(F.split(x, ":"), 1)).alias("kind"), x.alias("span")
        ),
    )
    more = F.transform(
        F.coalesce("found", F.array().cast("array<struct<start:long,end:long,kind:string>>")),
        lambda x: F.struct(
            x["start"].alias("start"), F.array_position(order, x["kind"]).alias("kind"),
            F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")).alias("span"),
        ),
    )
    spans = F.array_join(F.transform(F.array_sort(F.concat(base, more)), lambda x: x["span"]), ",")
    found = found.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    return joined.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"), F.size(more).cast("long").alias("n_found"))
