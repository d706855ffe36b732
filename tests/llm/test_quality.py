"""The perplexity model and its bands against a brute-force version over dictionaries of strings."""

import math
import random
from collections import Counter, defaultdict

import pytest

from assure.llm import quality

SCHEMA = "doc_id long, text string, lang string, _text int, low string, logppl string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocab = ["the", "of", "river", "stone", "Ünder", "ño", "it's", "mountain", "42", "walks", "slowly", "bright", "water", "𝔘x"]
    made = []
    for i in range(80):
        text = " ".join(rng.choice(vocab) for _ in range(rng.randint(40, 160)))
        made.append((i, text, rng.choice(["en", "de", None])))
    made += [(100 + i, " ".join("".join(rng.choice("qxzjkw#") for _ in range(5)) for _ in range(60)), "en") for i in range(2)]
    made += [(110, " ".join(["stone"] * 70), "en"), (111, None, "en"), (112, "", None), (113, " \n\t ", "xx"), (None, made[0][1], made[0][2]), (1, made[1][1], made[1][2])]
    made += [(120, "x" * 200_000 + " y" * 60, "de")]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "a", "b") for i, t, lang in rows], SCHEMA)


def text_of(text):
    return " ".join((text or "").split())


def learnt(text):
    return sum(text.count(s) for s in "#*$%&|<>") * 10 <= len(text.split())


def model_of(texts):
    """(context, character) -> probability in the highest order, by the definition of modified Kneser-Ney."""
    grams = Counter()
    for t in texts:
        padded = "\x02" * 3 + t + "\x03"
        each = [padded[k - 3 : k + 1] for k in range(3, len(padded))]
        grams.update(each if learnt(t) else dict.fromkeys(each, 0))
    levels = [grams]
    for n in (3, 2, 1):
        ends = Counter()
        for g in levels[-1]:
            ends[g[1:]] += levels[-1][g] > 0
        levels.append(ends)
    p = None
    for level in reversed(levels):
        of = Counter(level.values())
        y = of[1] / max(of[1] + 2 * of[2], 1)

        def cut(k, of=of, y=y):
            raw = k - (k + 1) * y * of[k + 1] / of[k] if of[k] else 0.5 * k
            return min(max(raw, 0.05 * k), 0.95 * k)

        cuts = [0, cut(1), cut(2), cut(3)]
        total, taken = defaultdict(int), defaultdict(float)
        for g, c in level.items():
            total[g[:-1]] += c
            taken[g[:-1]] += cuts[min(c, 3)]
        back = {x: taken[x] / total[x] if total[x] else 1 for x in total}
        own = {g: (c - cuts[min(c, 3)]) / total[g[:-1]] if c else 0 for g, c in level.items()}
        p = {g: own[g] + back[g[:-1]] * (p[g[1:]] if p else 1 / len(level)) for g in level}
    return p


def test_perplexity_and_verdicts_are_brute_force(docs, rows):
    texts = defaultdict(list)
    for _, t, lang in rows:
        if text_of(t):
            texts[lang].append(text_of(t))
    models = {lang: model_of(x) for lang, x in texts.items()}
    pooled = model_of([t for x in texts.values() for t in x])
    ppl = {}
    for i, t, lang in rows:
        t = text_of(t)
        if t:
            padded = "\x02" * 3 + t + "\x03"
            each = [padded[k - 3 : k + 1] for k in range(3, len(padded))]
            ppl[i, lang] = -sum(math.log(0.7 * models[lang][g] + 0.3 * pooled[g]) for g in each) / len(each)
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(rows)
    lang_of = {(i, text_of(t)): lang for i, t, lang in rows}
    assert lang_of
    fences = {}
    for lang in texts:
        used = sorted({t: ppl[i, lang] for i, t, x in rows if x == lang and text_of(t) and not quality.base_counts(t)[1][5]}.values())
        if used:
            at = [used[0] + 0] if len(used) == 1 else used

            def quantile(q, at=at):
                k = (len(at) - 1) * q
                return at[int(k)] + (at[min(int(k) + 1, len(at) - 1)] - at[int(k)]) * (k - int(k))

            width = max(3 * (quantile(0.75) - quantile(0.25)), 0.1)
            fences[lang] = quantile(0.25) - width, quantile(0.75) + width
    verdicts = Counter()
    by_id = {i: (t, lang) for i, t, lang in rows}
    for r in got:
        t, lang = by_id[r["doc_id"]]
        if text_of(t):
            assert abs(r["logppl"] - ppl[r["doc_id"], lang]) < 1e-5
            low, high = fences.get(lang, (-1e9, 1e9))
            assert lang not in fences or abs(r["low"] - low) < 2e-4 and abs(r["high"] - high) < 2e-4
            inside = low <= ppl[r["doc_id"], lang] <= high
        else:
            assert r["logppl"] is None
            inside = True
        assert r["kept"] == (not r["base_failed"] and inside)
        verdicts[r["base_failed"], r["kept"]] += 1
    assert verdicts[False, True] > 70 and verdicts[False, False] >= 2


def test_a_model_too_large_to_broadcast_scores_equally(docs, monkeypatch):
    one = sorted(map(tuple, quality.quality_rules(docs).collect()), key=repr)
    monkeypatch.setattr(quality, "BROADCAST_GRAMS", 0)
    assert one == sorted(map(tuple, quality.quality_rules(docs).collect()), key=repr)


def test_pieces_do_not_change_counts(spark, docs, monkeypatch):
    one = sorted(map(tuple, quality.gram_counts(docs).collect()), key=repr)
    monkeypatch.setattr(quality, "PIECE", 7)
    assert sorted((tuple(x) for x in zip(*[y.tolist() for y in quality._counted(["abcabcabc", "xy"])]))) == sorted(
        Counter(int(g) for gs, _ in quality._pieces(["abcabcabc", "xy"]) for g in gs).items()
    )
    assert one


def test_passing_keeps_rows_and_columns(docs, rows):
    kept = quality.passing(docs)
    assert kept.columns == docs.columns
    want = sum(r["kept"] for r in quality.quality_rules(docs).collect())
    assert kept.count() == want and kept.where("doc_id is null").count() == 1


def test_words_in_another_order_score_worse(spark):
    rng = random.Random(1)
    sentence = "a stone lies by the river and the water runs past it to the sea where ships wait for wind"
    prose = " ".join([sentence] * 12)
    salad = prose.split()
    rng.shuffle(salad)
    rows = [(i, prose + f" {i}", "en") for i in range(40)] + [(99, " ".join(salad), "en")]
    got = {r["doc_id"]: r["logppl"] for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[99] > max(v for k, v in got.items() if k != 99)


def test_symbols_in_many_texts_do_not_explain_themselves(spark):
    rng = random.Random(2)
    words = "a stone lies by the river and the water runs past it to the sea where ships wait for wind".split()
    prose = [(i, " ".join(rng.choice(words) for _ in range(200)), "en") for i in range(40)]
    noise = [(100 + i, " ".join(rng.choice(words) + rng.choice(["***", "%%%", " |"]) for _ in range(200)), "en") for i in range(8)]
    alone = [(200 + i, t, "xx") for i, (_, t, _) in enumerate(noise[:2])]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(prose + noise + alone, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i, _, _ in prose) and not any(got[i]["kept"] for i, _, _ in noise)
    assert all(got[i]["logppl"] > 0 for i, _, _ in alone)
