"""Row-wise operators: packing, PII, pages, and the trained ones, with the awkward cases."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from helpers import WORD, clashing, crc, frame, lower
from pyspark.sql import functions as F

from wideloom.llm import catalog, gbt, html_text, kneser_ney, language, packing, pii, quality, rules
from wideloom.llm.common import chunks, components, fold

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "😀 é ÀB 12"), (None, "some words here"), (6, "word " * 30_000), (7, "x" * 50_000), (8, "same"), (8, "same")]


def test_chunks_bound_the_text():
    assert list(chunks([50, 0, 500, 1], 200)) == [(0, 2), (2, 3), (3, 4)]
    assert list(chunks([], 10)) == []


def test_fold_is_crc32(spark):
    got = spark.range(50).select("id", fold(F.col("id"), 7).alias("f")).collect()
    assert all(r.f == crc(r.id) % 7 for r in got)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (2, 1)]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.label for r in got} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}
    line = [(i, i + 1) for i in range(200)]
    assert {r.label for r in components(spark.createDataFrame(line, "a bigint, b bigint")).collect()} == {0}


# Packing

def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    path = catalog.tokenizer_path()
    tok = Tokenizer.from_file(path)
    docs = ODD + [(10, "It's <|endoftext|> naïve ΣΑΣ İ é don't  123"), (11, "ä b c\x85d\x1ce")]
    got = packing.pack(clashing(frame(spark, docs)), path, context=64).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 for r in got)
    by: dict = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for doc, text in dict((d, t) for d, t in docs).items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        copies = sum(d == doc for d, _ in docs)
        pieces = sorted(by[doc], key=lambda r: r.start)[::copies]
        assert b"".join(bytes(p.ids) for p in pieces) == np.array(ids, "<u4").tobytes()
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(bytes(p.ids)) for p in pieces)
    assert sorted(packing.pack(frame(spark, docs), path, context=64, keep_units=False).drop("sequence_id").collect(), key=str) == \
        sorted((r for r in packing.pack(frame(spark, docs), path, context=64).drop("sequence_id").collect()), key=str)
    assert packing.pack(frame(spark, []), path).collect() == []
    with pytest.raises(ValueError):
        packing.pack(frame(spark, []), path, context=100)


def test_packing_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    e = packing.Encoder(catalog.tokenizer_path())
    texts = [" ".join(f"w{i}x" for i in range(j, j + 4)) for j in range(20)]
    assert e.encode(texts) == packing.Encoder(catalog.tokenizer_path()).encode(texts)
    for t in texts:
        assert e.encode([t]) == packing.Encoder(catalog.tokenizer_path()).encode([t])
        assert len(e.known) <= 5 and len(e.older) <= 5


def test_units_match_the_tokenizer():
    """Texts of awkward signs, encoded unit by unit, against the tokenizer on the whole text."""
    rng, e = random.Random(1), packing.Encoder(catalog.tokenizer_path())
    plain = [*"abAB1'-.,ßÉé \n", "'s", "'ll"]
    rare = [*plain, *"\t\xa0日本İ€×<|>_²Ⅷ\x1c\x85", "e\u0301", "<|endoftext|>"]
    for turn in range(60):
        batch = ["".join(rng.choices(rare if turn % 2 else plain, k=rng.randrange(40))) for _ in range(20)]
        for text, raw in zip(batch, e.encode(batch)):
            assert np.frombuffer(raw, "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_buckets_on_disk(spark, tmp_path):
    pieces = packing.pack(frame(spark, [(1, "a b c d e f g")]), catalog.tokenizer_path())
    packing.write_buckets(pieces, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert sorted(r.length for r in back.collect()) == sorted(r.length for r in pieces.collect())


# PII

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    return sum((v - 9 if v > 9 else v) for v in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d)))) % 10 == 0


def _base(t):
    out = []
    for k, (name, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, t or ""):
            s, d = m.group(), re.sub("[^0-9]", "", m.group())
            if name == "ip" and any(int(x) > 255 for x in s.split(".")) or name == "card" and not (12 <= len(d) <= 19 and _luhn(d)) \
                    or name == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), s))
    return sorted(out)


def test_base_spans_match_the_plain_patterns(spark):
    rng = random.Random(5)
    bits = ["a@b.c", "@", ".", "x", "_", "+", "1", "22", "255", "256", "0", "-", " ", "(", ")", "😀", "\n", "4111111111111111", "4111 1111 1111 1111", "+1 (988) 555-2485",
            "1.2.3.4", "001.02.3.4", "1.2.3.4.5", "a@b.c_d@e.f", "x@y.com+z@w.org", "é", "a@b", "+4930123456", "--", "000000000000"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(600)]
    docs += [(700, "mail x@y.zz " * 300), (701, None), (702, ""), (703, "a" * 20_000 + "@b"), (704, "1" * 20_000), (705, "a@" + "b." * 6000 + "c"), (706, "1 " * 20_000)]
    rows = pii.base_spans(frame(spark, docs).select("doc_id", "text")).select("doc_id", "base").collect()
    text = dict(docs)
    for r in rows:
        want = _base(text[r.doc_id])
        assert [(s.start, s.kind, s.end, s.m) for s in r.base] == want, repr(text[r.doc_id][:200])


def test_wide_candidates_are_voted_on(spark):
    docs = []
    for i in range(60):
        docs.append((2 * i, f"Please call +1 (988) 555-2{i:03d} today, mail joe.{i}@mail.example.com soon"))
        docs.append((2 * i + 1, f"tel 988-555-2{i:03d} please. order no. 12-34-56-{i:02d} and write joe (at) example (dot) com"))
    found = {r.doc_id: r for r in pii.find(clashing(frame(spark, docs))).collect()}
    for i in range(60):
        assert [(s.kind) for s in found[2 * i].base] == [3, 0] and len(found[2 * i].spans) == 2
        assert not found[2 * i + 1].base
        assert all("12-34" not in s.m for s in found[2 * i + 1].spans)
    assert {s.m for i in range(60) for s in found[2 * i + 1].spans} <= {"joe (at) example (dot) com"} | {f"988-555-2{i:03d}" for i in range(60)}


def test_spelled_out_addresses_in_upper_case(spark):
    text = "JOE (AT) EXAMPLE (DOT) COM"
    rows = pii.candidates(pii.base_spans(frame(spark, [(1, text), (2, f"{text} at home")]).select("doc_id", "text"))).collect()
    assert [[(s.start, s.kind, s.end, s.m) for s in r.wide] for r in rows] == [[(0, 0, len(text), text)]] * 2


def test_reliabilities_follow_the_votes():
    table = []
    for truth in (0, 1):   # the first two labelers mostly right, the third a coin, the last abstains
        for a, b, c in product((0, 1), repeat=3):
            n = 1000 * (0.9 if a == truth else 0.1) * (0.8 if b == truth else 0.2) * 0.5
            table.append({"kind": 0, "regex": a, "gazetteer": b, "context": -1, "edge": c, "long": 0, "cut": 0, "luhn": 0, "n": n})
    post, model = pii.reliabilities(table)
    assert model[0, "regex", 1][1] > 0.75 and model[0, "gazetteer", 1][1] > 0.6 and abs(model[0, "edge", 1][1] - model[0, "edge", 0][1]) < 0.2
    assert max(p for r, p in zip(table, post) if r["regex"] == r["gazetteer"] == 0) < 0.5 < min(p for r, p in zip(table, post) if r["regex"] == r["gazetteer"] == 1)


def test_mask_keeps_columns_and_rows(spark):
    docs = ODD + [(20, "a joe@mail.com b 4111111111111111 c 1.2.3.4")]
    src = clashing(frame(spark, docs))
    got = pii.mask(src)
    assert got.columns == src.columns
    rows = got.collect()
    assert len(rows) == len(docs)
    text = {r.doc_id: r.text for r in rows}
    assert text[20] == "a <EMAIL> b <CARD> c <IP>" and text[1] is None and text[2] == "" and text[6] == "word " * 30_000
    assert {r.doc_id: r.n_chars for r in rows}[20] == len(text[20])
    assert pii.mask(frame(spark, [])).collect() == []


def test_pii_is_native(spark):
    plan = pii.find(frame(spark, [(1, "a@b.cc")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Pages

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header">Site</header><nav><ul><li><a href="/a>b">One</a></ul></nav><!-- x <p> --><div class="cookie-notice">We use cookies and it is the law of the land to tell you so</div>
<article><h1>Ti&amp;tle</h1><p>A <b>bold</b>&nbsp; word,<br>next  line.<p>Second &lt;p&gt; of the it<div class="ad banner">buy this now</div><form>Name <input></form>
<ul><li>item one<li>item two</ul><section id="comments"><h2>Comments</h2><p>I like it and the rest of it as well, it is of note</p></section></article>
<aside>side</aside><footer>&copy; x</footer><script>open"""


def test_page_text():
    assert html_text.main_text(PAGE) == "Ti&tle\nA bold word, next line.\nSecond <p> of the it\nitem one\nitem two"
    for t in (None, "", "<", "</", "<!--", "<p", "<script>x", "<div></p></div></div>"):
        assert html_text.main_text(t) == ""
    long = "This is the text of a page that has no article and it is long enough. "
    page = f"<body><div id=menu><a href=x>a</a> <a href=y>b</a></div><div><h2>Head</h2><p>{long}<p>Short.<p>{long}</div><div><a href=z>link one</a><a href=q>link two</a></div></body>"
    assert html_text.main_text(page) == f"Head\n{long.strip()}\nShort.\n{long.strip()}"


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None), (3, "v", "<p>" * 20_000 + "x")], "page_id bigint, url string, html string")
    rows = sorted(html_text.extract(pages.withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(2))).collect(), key=lambda r: r.page_id)
    assert [(r.page_id, r.n_chars) for r in rows] == [(1, len(html_text.main_text(PAGE))), (2, 0), (2, 0), (3, 1 if rows[3].text else 0)]
    assert html_text.extract(pages.limit(0)).collect() == []


def test_pages_without_a_good_block_keep_their_text(spark):
    nav = '<nav><a href="/">Home</a></nav><p><a href="/a">all of it is a link</a></p>'
    pages = {1: ("<p>" * 20_000 + "x", "x"), 2: ("<body><p>Short text.", "Short text."),
             3: (f"<body>{nav}<h1>标题</h1><p>这是一个没有空格的段落，它很长，但只算一个词。</p><footer>f</footer></body>", "标题\n这是一个没有空格的段落，它很长，但只算一个词。"),
             4: (f"<body>{nav}<p>Dit is een lange tekst op een bladzijde zonder enig gemarkeerd artikel, helemaal geschreven door mensen.</p><div class=menu>m</div>",
                 "Dit is een lange tekst op een bladzijde zonder enig gemarkeerd artikel, helemaal geschreven door mensen."),
             5: (f"<body>{nav}</body>", "")}
    table = spark.createDataFrame([(i, "u", page) for i, (page, _) in pages.items()], "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(table).collect()} == {i: text for i, (_, text) in pages.items()}


# Language

def test_codewords_are_apart():
    for k in (2, 3, 4, 7, 12, 30):
        code = language.codewords(k)
        assert len({tuple(r) for r in code}) == k
        gap = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
        assert gap >= (2 ** (k - 2) if k <= 7 else 0.25 * code.shape[1])


def _spoken(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.mark.parametrize("k", [1, 2, 3, 9])
def test_language_of_held_out_texts(spark, k):
    rng = random.Random(k)
    alphabets = {f"l{i}": "abcdefghijklmnopqrstuvwxyzäöüéèßñç"[2 * i:2 * i + 14] for i in range(k)}
    rows = [(i, _spoken(rng, alphabets[f"l{i % k}"], 40), f"l{i % k}") for i in range(60 * k)]
    docs = frame(spark, rows + [(9001, None, "l0"), (9002, "12 !", "l0"), (9003, "no label " * 3, None)])
    model = language.train(clashing(docs), fold(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: r for r in language.predict(clashing(docs), model).collect()}
    held = [(i, lang) for i, _, lang in rows if crc(i) % 5 == 0]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert (got[9001].lang_pred, got[9001].score, got[9002].lang_pred) == ("und", 0.0, "und")
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_without_labels(spark):
    docs = frame(spark, [(1, "abc"), (2, None)])
    assert {r.lang_pred for r in language.predict(docs, language.train(docs)).collect()} == {"und"}
    assert language.predict(frame(spark, []), language.train(docs)).collect() == []


# Quality

def test_trees_match_row_by_row_traversal():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = gbt.fit(x, y, trees=30)
    p = model.probability(x)
    assert ((p > 0.5) == (y > 0)).mean() > 0.97
    for i in range(20):
        total = model.base
        for t in range(len(model.feature)):
            at = 0
            while at < model.feature.shape[1]:
                at = 2 * at + 1 + (x[i, model.feature[t, at]] > model.threshold[t, at])
            total += model.leaf[t, at - model.feature.shape[1]]
        assert abs(p[i] - 1 / (1 + math.exp(-total))) < 1e-12
    assert gbt.fit(x[:0], y[:0]).probability(x[:2]).tolist() == [0.5, 0.5]


def _labelled(spark, n=400):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice("alpha beta gamma delta the of and to it".split()) for _ in range(80)]
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good), 0))
    return rows, frame(spark, rows + ODD[:4]), spark.createDataFrame(labels + [(5000, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")


def test_quality_of_held_out_rows(spark):
    rows, docs, labels = _labelled(spark)
    model = quality.train(clashing(docs), labels, allowed=~quality.held_out(F.col("doc_id")))
    got = {r.doc_id: r for r in quality.score(clashing(docs), model).collect()}
    want = {r.doc_id: r.quality for r in labels.where("quality IS NOT NULL").collect()}
    held = [i for i, _ in rows if crc(i) % 5 == 0 and i > 4]
    assert held and all(got[i].predicted == want[i] for i in held)
    kept = quality.keep_good(clashing(docs), model)
    assert kept.columns == clashing(docs).columns and kept.count() == sum(r.predicted for r in quality.score(docs, model).collect())
    assert quality.score(frame(spark, []), model).collect() == [] and quality.keep_good(frame(spark, []), model).collect() == []
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_sample_is_bounded(spark):
    from wideloom.llm.common import kept_sample
    df = spark.range(10_000)
    assert kept_sample(df, F.col("id"), 100).count() == 100 and kept_sample(df, F.col("id"), 20_000).count() == 10_000


def test_rules(spark):
    rows, docs, labels = _labelled(spark)
    model = rules.train(clashing(docs), labels, allowed=~quality.held_out(F.col("doc_id")))
    got = {r.doc_id: r for r in rules.judge(clashing(docs), model).where("doc_id > 4").collect()}
    want = {r.doc_id: r.quality for r in labels.where("quality IS NOT NULL").collect()}
    held = [i for i, _ in rows if crc(i) % 5 == 0 and i > 4]
    assert all((got[i].probability >= 0.3) == bool(want[i]) for i in held)
    assert all(r.kept == (not r.base_failed and r.probability >= 0.3) for r in got.values())
    assert rules.judge(frame(spark, []), rules.train(docs, labels.limit(0))).collect() == []


def test_facts_match_brute_force():
    rng = random.Random(8)
    for i in range(300):
        t = "".join(rng.choice(["a ", "b ", "c", "\n", "é", "#", " | ", " ", "\t", "a b c ", "\x1c"]) for _ in range(rng.randrange(60)))
        w = WORD.findall(t)
        times = Counter(zip(w, w[1:], w[2:]))
        cover = {j + d for j in range(len(w) - 2) if times[tuple(w[j:j + 3])] >= 2 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert rules.facts(t) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)), repr(t)
    assert rules.facts(None) == (0, 0, 0, 0, 0)


# Language model

def _tokens(t):
    return WORD.findall(lower(t or "")) + [None]


def _kneser_ney(train, order):
    """Modified Kneser-Ney straight from its definition, over tuples."""
    counts = {order: Counter()}
    for t in train:
        w = ["<s>"] * (order - 1) + _tokens(t)
        for j in range(order - 1, len(w)):
            counts[order][tuple(w[j - order + 1:j + 1])] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {k: kneser_ney.discounts([float(sum(c == i for c in counts[k].values())) for i in (1, 2, 3, 4)]) for k in counts}
    words = {g[-1] for g in counts[order]}

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(words) + 1)
        own = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        d = lambda c: cut[k][min(c, 3) - 1] if c else 0
        total = sum(own.values())
        return max(own.get(gram, 0) - d(own.get(gram, 0)), 0) / total + sum(map(d, own.values())) / total * p(gram[1:])
    return p, words


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_the_definition(spark, order):
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice("the The of cat dog sat on mat a b c d e".split()) for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(90, None), (91, ""), (92, "unknown words the cat"), (93, "the cat"), (93, "the cat")]
    train = [t for i, t in rows if crc(i) % 7 != 2]
    p, words = _kneser_ney(train, order)
    model = kneser_ney.train(clashing(frame(spark, rows)), fold(F.col("doc_id"), 7) != 2, order=order)
    got = kneser_ney.score(clashing(frame(spark, rows)), model).collect()
    uni = Counter(w for t in train for w in _tokens(t))
    n, v = sum(uni.values()), len(uni)
    text = dict(rows)
    assert (model.tokens, model.vocabulary, len(got)) == (n, v, len(rows))
    for r in got:
        w = _tokens(text[r.doc_id])
        full = ["<s>"] * (order - 1) + w
        want = sum(math.log10(p(tuple(full[j:j + order]))) for j in range(len(w)))
        assert abs(r.score - want) < 1e-6 and abs(r.base_score - sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)) < 1e-9
        assert (r.n_tokens, r.n_known) == (len(w), sum(uni[x] > 0 for x in w))
    context = ("cat",) * (order - 1)
    assert abs(sum(p(context + (w,)) for w in words) + p(context + ("never",)) - 1) < 1e-9


def test_the_query_sees_two_words_of_context(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("the cat dog sat on mat a b".split()) for _ in range(rng.randrange(12)))) for i in range(60)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    p, _ = _kneser_ney([t for i, t in rows if crc(i) % 7 != 2], 3)
    text = dict(rows)
    for r in catalog.op3_language_model(spark, str(tmp_path)).collect():
        full = ["<s>"] * 2 + _tokens(text[r.doc_id])
        assert abs(r.score - sum(math.log10(p(tuple(full[j:j + 3]))) for j in range(len(full) - 2))) < 1e-6


def test_shards_change_nothing(spark, monkeypatch):
    rows = [(i, f"a{i % 7} b{i % 5} c{i % 3} d") for i in range(80)]
    one = kneser_ney.score(frame(spark, rows), kneser_ney.train(frame(spark, rows), order=3)).collect()
    monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", 30)
    many = kneser_ney.train(frame(spark, rows), order=3)
    assert many.shard_bits >= 3
    two = {r.doc_id: r.score for r in kneser_ney.score(frame(spark, rows), many).collect()}
    assert all(abs(two[r.doc_id] - r.score) < 1e-9 for r in one)


def test_counts_are_bytes_and_large_ones_stay_exact(tmp_path):
    rng = np.random.default_rng(1)
    for shape in ((4000,), (4000, 4)):
        n = rng.integers(0, 5, shape)
        n[::97] = 255
        n[5], n[3999] = 2 ** 40 + 1, 254
        kneser_ney._save_counts(str(tmp_path), "n", n)
        at = rng.integers(0, 4000, 9000)
        assert (kneser_ney.Counts(f"{tmp_path}/n")[at] == n[at]).all()
        assert (tmp_path / "n.npy").stat().st_size <= n.size + 128


def test_language_model_of_nothing(spark):
    model = kneser_ney.train(frame(spark, []))
    row = kneser_ney.score(frame(spark, [(1, "a b")]), model).head()
    assert (row.n_tokens, row.n_known, row.base_score, row.score) == (3, 0, 0.0, 0.0)
    assert kneser_ney.score(frame(spark, []), model).collect() == []
