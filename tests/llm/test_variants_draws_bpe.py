"""Spelling variants, importance resampling and BPE next to brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetloom.llm import bpe, resampling, spelling

SF = "/root/testdata/sf0.001"


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want))


# -- 11 spelling variants


def fold(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def plain_variants(rows, ratio=10):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c > 1}
    # Words that agree once a letter is masked or left out.
    keys = {}
    for w in n:
        for i in range(len(w)):
            keys.setdefault(("masked", i, w[:i] + w[i + 1 :]), set()).add(w)
            keys.setdefault(w[:i] + w[i + 1 :], set()).add(("shorter of", w))
    near = {w: set() for w in n}
    for key, own in keys.items():
        if isinstance(key, tuple):
            for w in own:
                near[w] |= own - {w}
        elif key in n:
            for _, w in own:
                near[w].add(key)
                near[key].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def test_variants(spark, corpus):
    rng = random.Random(3)
    letters = "abcdefgé"
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([6, 7, 7, 8, 9]))) for _ in range(300)]
    words += ["x" * 70, "x" * 71, "x" * 63, "x" * 64, "x" * 65 + "y", "é" * 3000, "é" * 3001, "ß" * 8 + "×÷"]
    edited = []
    for w in words * 2:
        k = rng.randrange(len(w))
        edited.append(w[:k] + rng.choice(["", rng.choice(letters), w[k] + rng.choice(letters)]) + w[k + 1 :])
    rows = [(k, " ".join(rng.choices(words, k=40) + rng.choices(edited, k=4)).title()) for k in range(200)]
    rows += [(7, None), (None, "abcdefgh " * 9), (None, "abcdefgh " * 9), (8, "")]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    both = made.unionByName(corpus.select("doc_id", "text"))
    got = spelling.variants(both).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = plain_variants(texts(both))
    same([tuple(r) for r in got], want)
    assert sum(w[3] is not None for w in want) > 20


def test_variants_of_nothing(spark, empty):
    assert spelling.variants(empty).count() == 0
    short = spark.createDataFrame([(1, "of to in"), (2, None)], "doc_id long, text string")
    assert spelling.variants(short).count() == 0


def test_small_cells_find_the_same(spark, corpus, monkeypatch):
    want = plain_variants(texts(corpus))
    monkeypatch.setattr(spelling, "CELL", 20)
    words = spelling.word_counts(corpus)
    trees = spelling.sampled_trees(words)
    assert max(len(t.leaves) for t in trees.values()) > 5
    got = {r["word"]: r["n_near"] for r in spelling.near_words(words).collect()}
    assert got == {w: k for w, _, k, *_ in want if k}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcé", min_size=7, max_size=9), min_size=1, max_size=60, unique=True))
def test_cell_search(words):
    by_size = {k: [w for w in words if len(w) == k] for k in (7, 8, 9)}
    for own in by_size.values():
        pairs = {(own[i], own[j]) for x, y in spelling.near_in_cell(own, own, spelling.SAME) for i, j in zip(x, y)}
        assert pairs == {(a, b) for a in own for b in own if sum(x != y for x, y in zip(a, b)) == 1}
    shorter, longer = by_size[7], by_size[8]
    pairs = {(shorter[i], longer[j]) for x, y in spelling.near_in_cell(longer, shorter, spelling.LONGER) for i, j in zip(x, y)}
    assert pairs == {(a, b) for a in shorter for b in longer if any(b[:k] + b[k + 1 :] == a for k in range(8))}


# -- 12 importance resampling


def plain_resample(rows, target, percent=25, least=20):
    def runs(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
        return len(words), [zlib.crc32(g.encode()) % 10000 for g in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    found = [(doc_id, *runs(text)) for doc_id, text in rows]
    s, t = Counter(), Counter()
    for _, _, own in found:
        s.update(own)
    for text in target:
        t.update(runs(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    scored = []
    for doc_id, n, own in found:
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        scored.append((doc_id, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[2], -r[3]))
    k = percent * len(fit) // 100
    rest = fit[k:] + [r for r in scored if r[1] < least]
    return [(r[0], *r[2:], rank) for rank, r in enumerate(fit[:k], 1)] + [(r[0], *r[2:], None) for r in rest]


def test_resampling(spark, corpus):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    many = spark.createDataFrame([(None, "word " * 25)] * 60 + [(k % 3, "same text of words " * 9) for k in range(90)], "doc_id long, text string")
    docs = corpus.select("doc_id", "text").unionByName(many)
    want = plain_resample(texts(docs), [r["text"] for r in target.collect()])
    same([tuple(r) for r in resampling.resample(docs, target).collect()], want)
    # Extra columns are of no account.
    assert resampling.resample(corpus, target).columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_resampling_of_nothing(spark, empty, corpus):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert resampling.resample(empty, target).count() == 0
    few = spark.createDataFrame([(1, None), (2, ""), (3, "a few words")], "doc_id long, text string")
    assert {r["rank"] for r in resampling.resample(few, target).collect()} == {None}
    got = [tuple(r) for r in resampling.resample(corpus, target.where("false")).collect()]
    same(got, plain_resample(texts(corpus), []))


@pytest.mark.parametrize("k", [1, 2, 399, 700, 1000])
def test_kth_key(spark, k):
    rng = random.Random(k)
    rows = [(rng.choice([5, 5, 5, rng.randrange(9)]), 0, rng.randrange(4), 0, 0, n) for n in range(1000)]
    keys = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in resampling._KEY)).repartition(7)
    assert resampling.kth_key(keys, k, pivots=3) == sorted(rows)[k - 1]


# -- 13 BPE


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tools():
    vocabulary = bpe.Vocabulary(bpe.vocabulary_path("byte_bpe_50k.json"))
    return vocabulary, vocabulary.splitter(), vocabulary.encoder()


def test_bpe(spark, corpus, tokenizer, monkeypatch):
    rng = random.Random(8)
    alphabet = "ab 'sté9½日　 \x85\x1c\n\t\r 😀́<|endoftext|>ǅ٣​\x00"
    made = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for k in range(300)]
    made += [(1, "<|endoftext|><|endoftext|> x<|endoftext|>"), (2, "it's we'll 'S   \n\n x"), (None, "z" * 30_000), (3, " " * 5000)]
    monkeypatch.setattr(bpe, "BLOCK_TEXTS", 50)
    docs = spark.createDataFrame(made, "doc_id long, text string").unionByName(corpus.select("doc_id", "text")).repartition(3)
    got = [(r["doc_id"], r["ids"], r["text"]) for r in bpe.roundtrip(docs).collect()]
    want = []
    for doc_id, text in texts(docs):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, ids, tokenizer.decode(ids, skip_special_tokens=False)))
    same(got, want)
    coded = [(r["doc_id"], r["ids"]) for r in bpe.encode(corpus).collect()]
    same(coded, [(d, tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in texts(corpus)])


def test_decode_any_ids(spark, tokenizer):
    rng = random.Random(4)
    rows = [(k, [rng.randrange(50257) for _ in range(rng.randrange(40))]) for k in range(200)] + [(1, None), (None, []), (5, [None, 50256, 99999])]
    coded = spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(4)
    want = [(d, tokenizer.decode([i for i in ids or [] if i is not None and i < 50257], skip_special_tokens=False)) for d, ids in rows]
    same([tuple(r) for r in bpe.decode(coded).collect()], want)


def test_bpe_of_nothing(empty):
    assert bpe.roundtrip(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(text=st.text(st.characters(codec="utf-8"), max_size=40))
def test_split(tools, text):
    vocabulary, split, encode = tools
    words = split(text)
    assert "".join(words) == text
    assert [i for w in encode(words) for i in w] == vocabulary.tokenizer.encode(text, add_special_tokens=False).ids
