"""Quality rules: base counts of words, symbols and repetitions, and bands of n-gram perplexity.

The language model is a modified Kneser-Ney model of the characters of a text, its words joined by single spaces,
so that n-grams cross from word to word; there is one for each language. Spark lists all n-grams of the corpus,
counts them where the text is no heap of symbols (junk would explain itself otherwise), and derives discounts, continuation counts and probabilities by joins and aggregations. An n-gram is packed
into 64 bits, 16 a character (code points beyond 16 bits share 2,048 classes), and the model is stored in arrays
sorted by that hash, with log probabilities in whole millionths. Each language's perplexities have quartiles;
documents outside their fences are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_extend, small, stored, texts_of

ORDER = 4
START, END = "\x02", "\x03"
#: Distinct n-grams that a task keeps counts of before it hands them on.
GRAMS_KEPT = 1 << 20
#: n-grams of a model, 12 bytes each, up to which it is broadcast; a larger one is joined, with equal scores.
BROADCAST_GRAMS = 4_000_000
#: Fences: so many interquartile ranges beyond the quartiles, and at least so far (natural log of perplexity).
FENCE, LEAST_WIDTH = 3.0, 0.1
#: Share of the model of all languages together in a top-order probability: a passage in another language is no junk.
POOLED = 0.3
#: Steps of log perplexity in the histogram that the quartiles are read from.
STEP = 1e-4
#: Symbols (those of SYMBOLS) a word beyond which the model does not learn from a text; it is judged like any other.
LEARN_SYMBOLS = 0.1
#: Units of a natural logarithm that scores are summed in.
UNIT = 1e6
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text that are taken together; characters whose n-grams are made at once.
GROUP_BYTES, PIECE = 1 << 20, 1 << 20


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of the texts, one for each character and the end, and the number of the text that each is of."""
    a = np.frombuffer("".join(START * (ORDER - 1) + t + END for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.where(a > 0xFFFF, 0xD800 + (a & 0x7FF), a).astype(np.uint16)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER
    text = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    inside = np.ones(len(a), bool)
    for k in range(ORDER - 1):
        inside[np.cumsum(size) - size + k] = False
    for first in range(0, len(a), PIECE):
        at = first + np.flatnonzero(inside[first : first + PIECE])
        grams = np.zeros(len(at), np.uint64)
        for back in range(ORDER - 1, -1, -1):
            grams = (grams << np.uint64(16)) | a[at - back]
        yield grams.view(np.int64), text[at]


def symbols(raw: bytes) -> int:
    return len(raw) - len(raw.translate(None, SYMBOLS))


def _text_of(words: list[bytes]) -> str:
    return b" ".join(words).decode("utf-8", "replace")


def _summed(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(np.concatenate(grams), return_inverse=True)
    return found, np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of some texts, and how often each is there."""
    parts = [np.unique(g, return_counts=True) for g, _ in _pieces(texts)]
    return parts[0] if len(parts) == 1 else _summed([g for g, _ in parts], [c for _, c in parts])


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, g, c: each n-gram of the highest order in the texts of a language, and how often it is in those that are
    no heaps of symbols (0 where it is only in such)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a language's texts are held in two lots: those to learn from, and the others
        waiting: dict[tuple[str | None, bool], list[str]] = {}
        size: dict[tuple[str | None, bool], int] = {}
        held: dict[tuple[str | None, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

        def count(lot: tuple[str | None, bool]) -> None:
            held.setdefault(lot, []).append(_counted(waiting.pop(lot)))
            size[lot] = 0
            if sum(len(g) for g, _ in held[lot]) > GRAMS_KEPT:
                held[lot] = [_summed([g for g, _ in held[lot]], [c for _, c in held[lot]])]

        def flush(lot: tuple[str | None, bool]) -> pa.RecordBatch:
            g, c = _summed([g for g, _ in held[lot]], [c for _, c in held.pop(lot)])
            return pa.RecordBatch.from_arrays([pa.array([lot[0]] * len(g), pa.string()), pa.array(g), pa.array(c * lot[1])], ["lang", "g", "c"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
                raw = text.encode("utf-8", "replace")
                words = raw.split()
                if words:
                    lot = lang, symbols(raw) <= LEARN_SYMBOLS * len(words)
                    waiting.setdefault(lot, []).append(_text_of(words))
                    size[lot] = size.get(lot, 0) + len(text)
                    if size[lot] > GROUP_BYTES:
                        count(lot)
                        if len(held[lot]) == 1 and len(held[lot][0][0]) > GRAMS_KEPT // 2:
                            yield flush(lot)
        for lot in list(waiting):
            count(lot)
        for lot in list(held):
            yield flush(lot)

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, g long, c long")
    return counted.groupBy("lang", "g").agg(F.sum("c").alias("c"))


def _discounts(level: DataFrame) -> DataFrame:
    """d1, d2, d3 of each language: modified Kneser-Ney discounts from its counts of counts (a row a language)."""
    by = level.groupBy("lang").agg(*[F.count_if(F.col("c") == k).alias(f"t{k}") for k in (1, 2, 3, 4)])
    y = F.col("t1") / F.greatest(F.col("t1") + 2 * F.col("t2"), F.lit(1))

    def d(k: int) -> Column:
        raw = k - (k + 1) * y * F.try_divide(F.col(f"t{k + 1}"), F.col(f"t{k}"))
        return F.least(F.greatest(F.coalesce(raw, F.lit(0.5 * k)), F.lit(0.05 * k)), F.lit(0.95 * k))

    return by.select(F.col("lang").alias("_l"), d(1).alias("d1"), d(2).alias("d2"), d(3).alias("d3"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """lang, n, g, logp, loggamma of each n-gram of each order 1 to ORDER; loggamma is its weight as a context.
    logp is null where an n-gram is a context only.

    counts: lang, g, c of the highest order. Lower orders have continuation counts: of distinct one character
    longer n-grams that end so and were learnt. An n-gram of count 0 gets what its shorter one gives it.
    """
    levels = [counts]
    for n in range(ORDER - 1, 0, -1):
        shorter = F.col("g").bitwiseAND(F.lit((1 << 16 * n) - 1))
        levels.append(stored(levels[-1].groupBy("lang", shorter.alias("g")).agg(F.count_if(F.col("c") > 0).alias("c"))))
    known: DataFrame | None = None
    made = []
    for n, level in enumerate(reversed(levels), 1):
        cut = small(_discounts(level))
        rows = level.join(cut, level["lang"].eqNullSafe(cut["_l"])).drop("_l")
        rows = rows.withColumn("ctx", F.shiftrightunsigned("g", 16))
        taken = F.when(F.col("c") == 0, F.lit(0.0)).when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        total = F.sum("c")
        left = F.first("d1") * F.count_if(F.col("c") == 1) + F.first("d2") * F.count_if(F.col("c") == 2) + F.first("d3") * F.count_if(F.col("c") > 2)
        weights = rows.groupBy("lang", "ctx").agg(total.alias("total"), F.coalesce(F.try_divide(left, total), F.lit(1.0)).alias("gamma"))
        context = stored(weights.withColumnsRenamed({"lang": "_l", "ctx": "_x"}))
        rows = rows.join(context, rows["lang"].eqNullSafe(context["_l"]) & (rows["ctx"] == context["_x"]))
        own = F.when(F.col("c") > 0, (F.col("c") - taken) / F.col("total")).otherwise(F.lit(0.0))
        if known is None:
            kinds = small(level.groupBy("lang").agg(F.count("*").alias("kinds")).withColumnRenamed("lang", "_v"))
            rows = rows.join(kinds, rows["lang"].eqNullSafe(kinds["_v"]))
            p = own + F.col("gamma") / F.col("kinds")
        else:
            shorter = F.col("g").bitwiseAND(F.lit((1 << 16 * (n - 1)) - 1))
            lower = known.select(F.col("lang").alias("_v"), F.col("g").alias("_s"), F.col("p").alias("_p"))
            rows = rows.join(lower, rows["lang"].eqNullSafe(F.col("_v")) & (shorter == F.col("_s")))
            p = own + F.col("gamma") * F.col("_p")
        known = stored(rows.select("lang", "g", p.alias("p")))
        made.append((known, context))
    out = None
    for n, (level, _) in enumerate(made, 1):
        rows = level.select("lang", F.lit(n).alias("n"), "g", F.log("p").alias("logp"))
        if n < ORDER:
            # contexts that end in START are n-grams of no count: they get a row for their weight alone
            context = made[n][1].select("_l", F.lit(n).alias("_n"), "_x", F.log("gamma").alias("loggamma"))
            rows = rows.join(context, rows["lang"].eqNullSafe(F.col("_l")) & (F.col("g") == F.col("_x")), "full")
            lang = F.when(F.col("g").isNull(), F.col("_l")).otherwise(F.col("lang"))
            rows = rows.select(lang.alias("lang"), F.coalesce("n", "_n").alias("n"), F.coalesce("g", "_x").alias("g"), "logp", "loggamma")
        else:
            rows = rows.withColumn("loggamma", F.lit(None).cast("double"))
        out = rows if out is None else out.unionByName(rows)
    return out


class Model:
    """The n-grams of the highest order of each language, sorted by hash, with their log probabilities in UNITs."""

    def __init__(self, runs: pa.Table):
        """runs: those of sorted_runs(); nothing is sorted or copied twice here, as the driver builds it."""
        parts: dict[str | None, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for lang, first, g, lp in zip(*(runs[c] for c in ("lang", "first", "g", "lp"))):
            parts.setdefault(lang.as_py(), []).append((first.as_py(), np.frombuffer(g.as_buffer(), np.int64), np.frombuffer(lp.as_buffer(), np.int32)))
        self.arrays: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
        for lang, found in parts.items():
            found.sort(key=lambda run: run[0])
            self.arrays[lang] = np.concatenate([run[1] for run in found]), np.concatenate([run[2] for run in found])

    def sums(self, lang: str | None, texts: list[str]) -> tuple[list[int], list[int]]:
        """Of each text, whose n-grams the model has listed: its log probability and number of n-grams."""
        keys, lp = self.arrays[lang]
        total, n = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for grams, text in _pieces(texts):
            total += np.bincount(text, lp[np.searchsorted(keys, grams)], len(texts)).astype(np.int64)
            n += np.bincount(text, minlength=len(texts))
        return total.tolist(), n.tolist()


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are in the text twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    k = np.int64(len(ids))
    pairs = a[:-2] * k + a[1:-1]
    if len(ids) >= 1 << 20:  # three numbers would not fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, place, times = np.unique(pairs * k + a[2:], return_inverse=True, return_counts=True)
    twice = times[place] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= twice
    return int(inside.sum())


def base_counts(text: str) -> tuple[list[bytes], list]:
    """The words of a text, and its columns of BASE."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, SPACES))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    n, repeat = len(words), repeated_words(words)
    return words, [n, len(text) - spaces, symbols(raw), dup, repeat, n < 50 or 100 * repeat > 50 * n]


def scored(docs: DataFrame, model) -> DataFrame:
    """docs with the columns of BASE and logppl (null where a text has no word).

    model: a broadcast Model of all words of docs, or None for the base columns alone.
    """

    def of_batch(batch: pa.RecordBatch) -> list:
        rows: list[list] = []
        logppl: list[float | None] = [None] * batch.num_rows
        langs = batch.column("lang").to_pylist() if model else [None] * batch.num_rows
        waiting: dict[str | None, list[tuple[int, str]]] = {}
        size: dict[str | None, int] = {}

        def score(lang: str | None) -> None:
            places, texts = zip(*waiting.pop(lang))
            size[lang] = 0
            for i, total, n in zip(places, *model.value.sums(lang, list(texts))):
                logppl[i] = -float(total) / UNIT / n

        for i, (lang, text) in enumerate(zip(langs, texts_of(batch))):
            words, counts = base_counts(text)
            rows.append(counts)
            if model and words:
                waiting.setdefault(lang, []).append((i, _text_of(words)))
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] > GROUP_BYTES:
                    score(lang)
        for lang in list(waiting):
            score(lang)
        return [*zip(*rows), logppl]

    return arrow_extend(docs, of_batch, BASE + ", logppl double")


def bands(rows: DataFrame) -> DataFrame:
    """lang, low, high: the fences of log perplexity of each language, over its distinct texts that pass the base rules.

    rows: lang, _text (the text's hash), logppl, base_failed. Quartiles come from a histogram in steps of STEP.
    """
    used = rows.where("not base_failed and logppl is not null").select("lang", "_text", F.round(F.col("logppl") / STEP).cast("long").alias("at"))
    bins = used.distinct().groupBy("lang", "at").agg(F.count("*").alias("n"))
    q = bins.groupBy("lang").agg(F.expr("percentile(at, array(0.25D, 0.75D), n)").alias("q"))
    q = q.select("lang", (F.col("q")[0] * STEP).alias("q1"), (F.col("q")[1] * STEP).alias("q3"))
    width = F.greatest((F.col("q3") - F.col("q1")) * FENCE, F.lit(LEAST_WIDTH))
    return q.select("lang", (F.col("q1") - width).alias("low"), (F.col("q3") + width).alias("high"))


def model_rows(docs: DataFrame) -> DataFrame:
    """kneser_ney() of each language of docs, its top order mixed with that of all languages together."""
    own = stored(gram_counts(docs))
    # all languages together are one language more; a letter before each keeps its name apart
    named = own.withColumn("lang", F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("-")))
    together = own.groupBy(F.lit("*").alias("lang"), "g").agg(F.sum("c").alias("c"))
    both = stored(kneser_ney(stored(named.select("lang", "g", "c").unionByName(together))))
    pooled = both.where((F.col("lang") == "*") & (F.col("n") == ORDER)).select(F.col("g").alias("_g"), F.col("logp").alias("_all"))
    lang = F.when(F.col("lang") != "-", F.substr("lang", F.lit(2)))
    rows = both.where(F.col("lang") != "*").withColumn("lang", lang)
    top = rows.where(F.col("n") == ORDER).join(pooled, F.col("g") == F.col("_g"))
    mix = F.log((1 - POOLED) * F.exp("logp") + POOLED * F.exp("_all"))
    return rows.where(F.col("n") < ORDER).unionByName(top.select("lang", "n", "g", mix.alias("logp"), "loggamma"))


def sorted_runs(rows: DataFrame) -> DataFrame:
    """lang, first, g, lp: runs of a language's sorted n-grams and their log probabilities as packed arrays, 12 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("lang").dictionary_encode(null_encoding="encode")
            place, g, lp = own.indices.to_numpy(), batch.column("g").to_numpy(), batch.column("lp").to_numpy().astype(np.int32)
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
            made = [(own.dictionary[int(place[a])].as_py(), int(g[a]), g[a:b].tobytes(), lp[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made), (pa.string(), pa.int64(), pa.binary(), pa.binary()))], ["lang", "first", "g", "lp"])

    return rows.orderBy("lang", "g").mapInArrow(run, "lang string, first long, g binary, lp binary")


def trained(docs: DataFrame):
    """The model of docs as a broadcast variable; as a table where it is too large for that, None without words."""
    top = model_rows(docs).where(F.col("n") == ORDER)
    rows = stored(top.select("lang", "g", F.round(F.col("logp") * UNIT).cast("long").alias("lp")))
    n = rows.count()
    if not n or n > BROADCAST_GRAMS:
        return rows if n else None
    model = docs.sparkSession.sparkContext.broadcast(Model(sorted_runs(rows).toArrow()))
    pa.default_memory_pool().release_unused()
    return model


def _joined_scores(docs: DataFrame, model: DataFrame) -> DataFrame:
    """scored(), with a model that is too large to broadcast: each document's distinct n-grams meet it in a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, lang, text in zip(batch.column("_key").to_pylist(), batch.column("lang").to_pylist(), texts_of(batch)):
                words = text.encode("utf-8", "replace").split()
                if words:
                    g, c = _counted([_text_of(words)])
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(g), pa.int64()), pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(c)], ["_key", "lang", "g", "c"])

    key = F.xxhash64("lang", "text")
    texts = docs.select(key.alias("_key"), "lang", "text").dropDuplicates(["_key"])
    asked = texts.mapInArrow(run, "_key long, lang string, g long, c long")
    top = model.select(F.col("lang").alias("_l"), F.col("g").alias("_g"), "lp")
    met = asked.join(top, asked["lang"].eqNullSafe(F.col("_l")) & (asked["g"] == F.col("_g")))
    sums = met.groupBy("_key").agg((-F.sum(F.col("lp") * F.col("c")).cast("double") / UNIT / F.sum("c")).alias("_ppl"))
    base = scored(docs, None).drop("logppl").withColumn("_own", key)
    return base.join(sums, base["_own"] == sums["_key"], "left").drop("_own", "_key").withColumnRenamed("_ppl", "logppl")


def judged(docs: DataFrame, carry: tuple[str, ...] | None = None) -> DataFrame:
    """docs (doc_id, text, lang and others) with the columns of BASE, logppl, low, high and kept.

    carry: the columns of docs to return, all by default; scores are stored with these alone. A null text counts
    as empty and fails the base rules; a null language is a language of its own. Repeated rows are judged alike;
    an empty table gives an empty one. Texts within the fences of their language, or of a language in which no
    text passes the base rules, are kept if they pass the base rules.
    """
    model = trained(docs)
    by_join = isinstance(model, DataFrame)
    rows = _joined_scores(docs, model) if by_join else scored(docs, model)
    own = docs.columns if carry is None else list(carry)
    made = [c.split()[0] for c in BASE.split(", ")] + ["logppl"]
    rows = stored(rows.select(*own, F.col("lang").alias("_lang"), F.xxhash64("text").alias("_text"), *made))
    if model and not by_join:
        model.destroy()
    fence = small(stored(bands(rows.withColumnRenamed("_lang", "lang") if "lang" not in own else rows)).withColumnRenamed("lang", "_l"))
    rows = rows.join(fence, rows["_lang"].eqNullSafe(fence["_l"]), "left").drop("_l", "_lang", "_text")
    inside = F.coalesce((F.col("logppl") >= F.col("low")) & (F.col("logppl") <= F.col("high")), F.lit(True))
    return rows.withColumn("kept", ~F.col("base_failed") & inside)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the columns of BASE, kept, logppl, low and high of each row of docs (doc_id, text, lang)."""
    rows = judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), carry=("doc_id",))
    return rows.select("doc_id", *[c.split()[0] for c in BASE.split(", ")], "kept", "logppl", "low", "high")


def passing(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    row = F.struct(*docs.columns).alias("_row")
    return judged(docs.select(row, "lang", "text"), carry=("_row",)).where("kept").select("_row.*")
