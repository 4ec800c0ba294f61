"""Token counts at every prefix and the alignment of two tokenizers, against the libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import clashing, frame

from wideloom.llm import catalog, token_align, token_counts, tokens

BYTES = catalog.tokenizer_path("byte_bpe_50k.json")
SIGNS = [*"aB1'-. \n\t<|>", "'s", "'ll", "<|endoftext|>", "<|endo", "  ", "é", "　", "\x85", "\x1c", "日本", "😀", " the", "ing", "꟱"]
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "😀 é ÀB 12"), (None, "some words here"), (6, "word " * 30_000), (7, "x" * 20_000), (8, "same"),
       (8, "same"), (9, "a <|endoftext|> b"), (10, "it's  the\n\n end's "), (11, "日本 " * 500)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(BYTES)


def length(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def odd_texts(n, seed, most=12):
    rng = random.Random(seed)
    return ["".join(rng.choices(SIGNS, k=rng.randrange(most))) for _ in range(n)]


def test_every_entry_is_one_token():
    chains = token_counts.chains(BYTES)
    assert all(chains.counts(entry)[-1] == 1 for entry in chains.vocabulary.id_of)


def test_units_are_those_of_the_library(library):
    for text in odd_texts(2000, 5):
        found = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        cutter = token_counts.chains(BYTES).cutter
        assert cutter.units(text) == found
        assert "".join(cutter.compounds(text)) == text
        if tokens.PLAIN.fullmatch(text):
            assert tokens.COMPOUNDS.findall(text) == cutter.compounds(text)


def test_every_prefix_against_the_library(library):
    texts = odd_texts(600, 3)
    counter = token_counts.Counter(BYTES)
    found = {}
    for i, piece in counter.prefixes(texts):
        found.setdefault(i, []).extend(piece.tolist())
    for i, text in enumerate(texts):
        assert found.get(i, []) == [length(library, text[:k + 1]) for k in range(len(text))], text


def test_memory_and_parts_do_not_change_counts(library, monkeypatch):
    monkeypatch.setattr(tokens, "PART", 7)
    monkeypatch.setattr(tokens.parts, "__defaults__", (7,))
    monkeypatch.setattr(token_counts, "PAIRS", 5)
    monkeypatch.setattr(token_counts, "CHUNK_BYTES", 30)
    counter = token_counts.Counter(BYTES)
    counter.memory.units = 6
    texts = odd_texts(150, 9, 40)
    found = {}
    for i, piece in counter.prefixes(texts):
        found.setdefault(i, []).extend(piece.tolist())
        assert len(counter.memory.known) <= 6 and len(counter.memory.older) <= 6
    for i, text in enumerate(texts):
        assert found.get(i, []) == [length(library, text[:k + 1]) for k in range(len(text))]


def test_count(spark, library):
    got = token_counts.count(clashing(frame(spark, ODD)), BYTES, limit=5).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    for doc, text in ODD:
        text, r = text or "", by[doc]
        assert (r.n_bytes, r.n_chars, r.n_tokens) == (len(text.encode()), len(text), length(library, text))
        assert r.over_limit == (r.n_tokens > 5)
        assert length(library, text[:r.fit_chars]) <= 5
        if len(text) < 1000:
            assert r.fit_chars == max(k for k in range(len(text) + 1) if length(library, text[:k]) <= 5)
    assert token_counts.count(frame(spark, []), BYTES).collect() == []


def test_prefix_table_answers_questions(spark, library):
    docs = [(1, "it's  the end's"), (2, None), (3, "tokenization of words " * 40), (4, "a <|endoftext|> b")]
    table = token_counts.prefix_table(frame(spark, docs), BYTES, block=16)
    asked = [(d, k) for d, t in docs for k in range(len(t or "") + 2)]
    got = token_counts.count_at(table, spark.createDataFrame(asked, "doc_id bigint, n_chars bigint"), block=16).collect()
    text = {d: t or "" for d, t in docs}
    assert len(got) == len(asked)
    assert all(r.n_tokens == (length(library, text[r.doc_id][:r.n_chars]) if r.n_chars <= len(text[r.doc_id]) else None) for r in got)
    for budget in (0, 3, 50):
        for r in token_counts.longest_within(table, budget, block=16).collect():
            counts = [length(library, text[r.doc_id][:k]) for k in range(len(text[r.doc_id]) + 1)]
            assert r.n_chars == max(k for k, n in enumerate(counts) if n <= budget) and r.n_tokens == counts[r.n_chars]


# Alignment

PIECES = catalog.tokenizer_path("piece_bpe_32k.model")


def test_gallop_finds_lower_bounds():
    rng = np.random.default_rng(4)
    for n, m in ((0, 5), (1, 0), (3, 100), (500, 40), (1000, 1000), (17, 100_000)):
        driver, ends = (np.sort(rng.choice(200_000, k, replace=False)) for k in (n, m))
        assert np.array_equal(token_align.gallop(driver, ends), np.searchsorted(ends, driver))
        a, b = token_align.common(driver, ends)
        shared = np.intersect1d(driver, ends)
        assert np.array_equal(driver[a], shared) and np.array_equal(ends[b], shared)


def plain_alignment(docs):
    """The definition, text by text with whole encodings."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a_side, b_side = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    a_side.encode_special_tokens = True
    signs = tokens.byte_alphabet()
    names = {i: bytes(signs[c] for c in s) for s, i in a_side.get_vocab().items() if s != "<|endoftext|>"}
    piece = lambda i: (bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode())
    rows = []
    for doc, text in docs:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        want = (" " + text).encode() if text else b""
        if b"".join(names[i] for i in a) != want or b"".join(map(piece, b)) != want:
            a = b = []
        ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for ids, f in ((a, names.get), (b, piece))]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, links, lo = [], [], [0, 0]
        for end in both:
            hi = [e.index(end) + 1 for e in ends]
            groups.append("|".join(",".join(map(str, ids[x:y])) for ids, x, y in zip((a, b), lo, hi)))
            links.append((a[hi[0] - 1], b[hi[1] - 1]))
            lo = hi
        rows.append((doc, len(a), len(b), ";".join(groups), links))
    count = Counter(link for r in rows for link in r[4])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(doc, a, b, len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "", g) for doc, a, b, g, links in rows]


def as_rows(df):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_alignment_against_the_definition(spark):
    docs = [(d, t) for d, t in ODD if t is None or len(t) < 20_000] + [(20 + i, t) for i, t in enumerate(odd_texts(150, 11))]
    docs += [(300, "a ▁ b"), (301, " "), (302, "  two  "), (303, "trailing "), (304, "<s> <0x41> </s>")]
    docs += [(400 + i, r.text[:1500]) for i, r in enumerate(catalog.read(spark, "/root/testdata/sf0.001", "documents").limit(40).collect())]
    key = lambda r: tuple((x is None, x) for x in r)
    got = as_rows(token_align.align(clashing(frame(spark, docs)).repartition(5), BYTES, PIECES, with_groups=True))
    assert got == sorted(plain_alignment(docs), key=key)
    assert {r[0] for r in got if r[0] and r[1] == 0} >= {2, 300} and sum(r[1] > 0 for r in got) > 150


def test_alignment_of_long_and_empty_input(spark, monkeypatch):
    docs = [(1, "word " * 30_000 + "end"), (2, "x" * 30_000), (3, None)]
    got = {r.doc_id: r for r in token_align.align(frame(spark, docs), BYTES, PIECES).collect()}
    whole = {r[0]: r for r in plain_alignment([(1, docs[0][1]), (3, None)])}
    assert tuple(got[1])[:5] == whole[1][:5] and got[1].groups_sha256 == whole[1][7]
    assert tuple(got[3]) == (3, 0, 0, 0, 0, 0, 0, "") and got[2].n_a > 0
    assert token_align.align(frame(spark, []), BYTES, PIECES).collect() == []
    monkeypatch.setattr(tokens.parts, "__defaults__", (7,))
    aligner = token_align.Aligner(BYTES, PIECES)
    texts = odd_texts(100, 21, 40)
    assert [x.decode() for x in aligner.chunk(texts)["lists"]] == [r[8] for r in plain_alignment(enumerate(texts))]
