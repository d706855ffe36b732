"""Each operator against a brute-force version, and its defined results for nulls, empty and repeated rows."""

import hashlib
import random
import re
import struct

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from assure.llm import bpe, html_extract, line_dedup, mixing, pii, quality, queries, simhash, tokens, topk, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, lppl double, _row int"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def documents(spark, rows):
    """rows: doc_id, text, lang, source; with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 0.5, 2) for r in rows], DOCS)


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(5)
    vocab = ["the", "of", "and", "river", "stone", "Ünder", "ño", "it's", "mountain", "42", "walks", "slowly", "bright", "water"]
    rows = []
    for i in range(60):
        text = "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 5)))
        rows.append((i, text, rng.choice(["en", "de"]), f"s{i % 12}"))
    rows += [(100 + i, rows[0][1], "en", f"s{i}") for i in range(12)]
    rows += [(200, None, None, None), (201, "", "en", "s1"), (202, " \n\t", None, "s2"), (203, "x" * 30_000, "en", "s3"), (203, "x" * 30_000, "en", "s3")]
    rows += [(204, "share this line\n" + rows[1][1], "en", None)] + [(210 + i, f"share this line\nown {i}", "en", f"s{i}") for i in range(11)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, sample):
    return documents(spark, sample)


def test_pii_base_spans_and_discovery(spark):
    rows = [(i, f"Pay now. My account number is {x} thanks", "en", "s") for i, x in enumerate(f"+1 555 000 11{k}" for k in range(10, 18))]
    rows += [(50, "So: my account number is 555 123 9876 thanks", "en", "s"), (51, None, "en", "s"), (52, "", "en", "s"), (53, "a@b.c%d@e.f 1.2.3.4 999.1.1.1, 4111 1111 1111 1111", "en", "s")]
    got = {r["doc_id"]: r for r in pii.personal_data(documents(spark, rows)).collect()}
    assert got[50]["spans"] == "phone:25:37" and got[50]["n_phone"] == 0
    assert got[51]["spans"] == "" and got[51]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    want = "email:0:5,email:5:11,ip:12:19,card:31:50"
    assert got[53]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert pii.personal_data(documents(spark, rows).limit(0)).count() == 0


def test_pii_patterns_are_the_plain_ones():
    def plain(t):
        spans = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        spans += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        cards = [(m, re.sub("[^0-9]", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)]
        spans += [(m.start(), m.end(), "card") for m, d in cards if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0]
        spans += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return sorted(spans, key=lambda x: (x[0], pii.KINDS.index(x[2])))

    rng = random.Random(1)
    parts = ["a", "b.", "@", "@c.d", ".", "-", " ", "+", "1", "2", "34", "(", "4242 4242 4242 4242", "255", "\n", "%", "+12345"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == plain(t)


def test_html_keeps_the_article(spark):
    page = """<html><head><title>x</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies.</div>
    <nav><a href=1>One</a></nav><article><h1>Title &amp; more</h1><p>First   paragraph with some words.<p>Ok.<br>Yes</p><div class="ad">Buy now!</div><p>Second <a href=x>linked</a> paragraph of it.</p></article>
    <section id="comments"><p>Great article, I liked it a lot, thank you!</p></section><form><p>Your name and a long message to us please.</p></form><footer>&copy; Me</footer></body></html>"""
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>cut off <b"), (1, "u", page)], "page_id long, url string, html string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.main_text(rows).orderBy("page_id").collect()]
    text = "Title & more\nFirst paragraph with some words.\nOk. Yes\nSecond linked paragraph of it."
    assert got[0] == got[1] == (1, text, len(text)) and got[2] == (2, "", 0) and got[3] == (3, "", 0)


def test_max_flow_is_the_cheapest_labelling():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 8)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(keep):
            return sum(max(o, 0) if not k else max(-o, 0) for o, k in zip(odds, keep)) + sum(c for i, j, c in edges if keep[i] != keep[j])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_extract.max_flow_cut(odds, edges)) - best) < 1e-6


def test_url_automaton_is_the_globs():
    globs = ["a*b", "**x**", "q/**", "*.c/d**", "abc"] * 20
    machine, rng = url_filter.Automaton(globs), random.Random(4)
    texts = ["".join(rng.choice("abcxq/.d") for _ in range(rng.randint(0, 9))) for _ in range(800)] + ["a" * 700 + "b", "a" * 300 + "/b" + "x" * 300, ""]
    rules = [re.compile("".join({"**": ".*", "*": "[^/]*"}.get(x, re.escape(x)) for x in re.findall(r"\*+|[^*]", g)), re.S) for g in globs]
    hit = machine.matches([t.encode() for t in texts])
    assert all(hit[i, j] == bool(r.fullmatch(t)) for i, t in enumerate(texts) for j, r in enumerate(rules))


def test_url_rules(spark):
    cases = {
        "http://A.Example.org/es/x?q": ("a.example.org", "/es/x", "example.org/es/", "block"), "https://x.org": ("x.org", "", None, "allow"), "https://evil.com/x.org/": ("evil.com", "/x.org/", None, "allow"),
        "https://m.org/": ("m.org", "/", "org/", "allow"), "http://c.com/de/casino": ("c.com", "/de/casino", "com/de/", "block"), "http://casino.net/": ("casino.net", "/", None, "block"), None: ("", "", None, "allow"), "nothing": ("", "", None, "allow"),
    }
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(rows).collect()}
    assert list(cases.values()) == [got[i] for i in range(len(cases))]


def test_top_k_is_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[100:200] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(400, None), (450, [1.0, None]), (500, [float("nan")] * 8), (550, [1.0, 2.0]), (0, [float(x) for x in v[0]])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), index=topk.Index(pivots=4, annuli=3, block_rows=16, query_rows=2))
    whole = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    ids = [*range(300), 0]  # a repeated row counts, and is a query too
    want = []
    for q in [*range(0, 300, 50), 0]:
        s = whole @ whole[q]
        best = sorted((i for i in ids if i != q), key=lambda i: (-s[i], i))[:5]
        want += [(q, r, i, int(s[i])) for r, i in enumerate(best, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_quality_base_columns(docs, sample, spark):
    got = {}
    for r in quality.quality_rules(docs).collect():
        got.setdefault(r["doc_id"], r)
    for i, text, _, _ in sample:
        w = words(text)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        inside = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)} if len(w) < 2000 else set()
        lines = [x for x in (text or "").split("\n") if words(x)]
        dup = sum(x in lines[:k] for k, x in enumerate(lines))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(docs.limit(0)).count() == 0
    assert quality.passing(docs).columns == docs.columns


def classes(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs, sample):
    fps = {}
    for i, text, _, _ in sample:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else [0]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    want = classes(fps)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(sample)
    assert all((r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", want[r["doc_id"]]) for r in got)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [1, 48])
def test_links_join_what_brute_force_joins(spark, bucket):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps)[:8]:
        fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(12)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket=bucket)
    got = simhash.components(edges)
    want = classes({s: s & (2**64 - 1) for s in signed})
    sizes = {}
    for s, r in want.items():
        sizes.setdefault(r, set()).add(s)
    assert {(r["node"], r["root"]) for r in got.collect()} == {(s, min(c)) for c in sizes.values() if len(c) > 1 for s in c}


def test_token_counts(docs, sample):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(t.encode(text or "", add_special_tokens=False)) for i, text, _, _ in sample}
    got = tokens.token_counts(docs).collect()
    assert len(got) == len(sample)
    assert all((r["n_tokens"], r["over_limit"]) == (want[r["doc_id"]], want[r["doc_id"]] > 2048) for r in got)


def test_token_counts_of_odd_texts():
    odd = ["", " <|endoftext|>a b<|startoftext|>  It's  ́x  ΟΔΟΣ Σ é é\n", " a b\x85c", "𝔘nicode 😀😀"]
    c = tokens.counter_of(public_tokenizers.path("word_bpe_49k.json"))
    assert c.counts([x.encode() for x in odd]) == [len(e) for e in c.tokenizer.encode_batch(odd, add_special_tokens=False)]


def test_line_dedup(spark, docs, sample):
    spread, first = {}, {}
    for i, text, _, source in sample:
        for pos, line in enumerate((text or "").split("\n")):
            line = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
            if line:
                spread.setdefault(line, set()).add(source)
                first[line] = min(first.get(line, (i, pos)), (i, pos))
    want = {}
    for i, text, _, _ in sample:
        kept = []
        for pos, line in enumerate((text or "").split("\n")):
            key = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
            if not key or len(spread[key]) < 10 or first[key] == (i, pos):
                kept.append(line)
        want[i] = "\n".join(kept)
    got = line_dedup.cleaned(docs)
    assert got.columns == [*docs.columns, line_dedup.REMOVED]
    rows = got.collect()
    assert len(rows) == len(sample) and sum(r[line_dedup.REMOVED] for r in rows) > 10
    assert all((r["text"] or "") == want[r["doc_id"]] for r in rows)


def test_mixing(spark, docs, sample):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), "en", f"s{min(i % 7, 3)}" if i % 5 else None) for i in range(3000)]
    rows += [(5000, None, "en", "empty"), (5001, "", "en", "empty")]
    got = mixing.taken(documents(spark, rows)).collect()
    again = mixing.taken(documents(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    size, source = {i: len(words(t)) for i, t, _, _ in rows}, {i: s for i, _, _, s in rows}
    totals, took, target = {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        totals[s] = totals.get(s, 0) + r["size"]
        took[s] = took.get(s, 0) + r["taken"]
        target[s] = r["target"]
    order = sorted(totals, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, left, open_ = {}, 1.5 * sum(totals.values()), set(order)
    while True:  # fill up, cap, share again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * totals[s]}
        if not over:
            break
        for s in over:
            want[s] = 2 * totals[s]
            left -= want[s]
        open_ -= over
    want |= {s: weight[s] * level for s in open_}
    assert all(abs(target[s] - want[s]) < 1e-6 for s in order)
    assert all(abs(took[s] - target[s]) <= 30 for s in order)
    mixed = mixing.mixed(documents(spark, rows))
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.taken(documents(spark, rows).limit(0)).count() == 0


def test_bpe_is_the_library(spark, docs, sample):
    import tiktoken

    vocab = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ids, special_tokens={})
    odd = ["￼y\n\n  z \t", "日本語テキスト  ñandú's 12345!!! 😀😀", "   hi\u0085", " \0nul\0 !!", "a" * 700 + " b", "-" * 300 + "\n"]
    rows = sample + [(900 + i, t, "en", "s") for i, t in enumerate(odd)]
    texts = {i: t or "" for i, t, _, _ in rows}
    got = bpe.byte_bpe(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.byte_bpe(documents(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("name", list(queries.SQL))
def test_queries_with_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def test_pipeline_against_its_stages(spark, tmp_path, sample):
    import corpus_pipeline

    rows = documents(spark, [r for r in sample if r[0] != 203])
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [r for r in quality.judged(docs).collect() if r["kept"]]
    cleaned = line_dedup.cleaned(quality.passing(docs))
    assert cleaned.count() == len(kept)
    ids = {r["doc_id"] for r in simhash.near_duplicates(cleaned).collect() if r["doc_id"] == r["component_id"]}
    assert {r["doc_id"] for r in out} <= ids
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "byte_bpe"]
    library_words = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    for r in out:
        if r["ids"]:
            vocab = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
            back = {n: p for p, n in vocab.ids.items()}
            ids_ = struct.unpack(f"<{r['n_tokens']}I", bytes(r["ids"]))
            assert b"".join(back[i] for i in ids_).decode() == library_words[r["doc_id"]]


def test_tables_that_are_empty(spark, docs):
    assert line_dedup.cleaned(docs.limit(0)).count() == 0
    assert tokens.token_counts(docs.limit(0)).count() == 0
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert docs.select(F.lit(1)).limit(1).count() == 1
