"""Operators next to brute-force versions, on small tables and hard cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetloom.llm import chat, copies, decontaminate, licenses, packing, quality, rules, simhash, suffixes, urls, warc

SF = "/root/testdata/sf0.001"


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want))


# -- 1 packing


def test_packing_covers_every_id_once(corpus):
    from tokenizers import Tokenizer

    from facetloom.llm.tokens import vocabulary_path

    tokenizer = Tokenizer.from_file(vocabulary_path())
    pieces = packing.pack(corpus, window=256)
    found = pieces.collect()
    by_doc = defaultdict(list)
    by_sequence = defaultdict(list)
    for p in found:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    want = defaultdict(list)
    for doc, text in texts(corpus):
        want[doc].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    for doc, lists in want.items():
        own = sorted(by_doc[doc], key=lambda p: (p["sequence_id"], p["offset"]))
        rest = [i for p in own for i in np.frombuffer(p["ids"], "<u4").tolist()]
        assert len(rest) == sum(map(len, lists))
        if len(lists) == 1:
            assert rest == lists[0] and [p["start"] for p in own] == np.cumsum([0] + [p["length"] for p in own])[:-1].tolist()
            assert {p["doc_tokens"] for p in own} == {len(lists[0])}
        else:
            assert Counter(rest) == Counter(i for one in lists for i in one)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, own in by_sequence.items():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == np.cumsum([0] + [p["length"] for p in own])[:-1].tolist()
        size = sum(p["length"] for p in own)
        assert size == 256 or size < 256 and size & (size - 1) == 0
    whole = packing.sequences(pieces, 256).collect()
    assert all(len(r["ids"]) == 4 * r["n_ids"] for r in whole)


def test_packing_of_nothing(empty):
    assert packing.pack(empty).count() == 0


def test_tail_sizes():
    assert packing.tail_sizes(0) == [] and packing.tail_sizes(1300) == [1024, 256, 16, 4]


# -- 2 warc


def test_warc_roundtrip(spark):
    rows = [(k, f"http://a/{k}%\r\nx", ["<p>same</p>", "", None, f"<p>own {k} é</p>" * 50][k % 4]) for k in range(60)]
    rows += [(3, None, "<p>same</p>"), (None, "http://n", "<p>null id</p>"), (None, "http://n", "<p>null id</p>"), (None, "u", "<p>same</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = [tuple(r) for r in warc.roundtrip(pages).select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest").collect()]
    first = {}
    count = Counter()
    for page, _, html in rows:
        count[html or ""] += 1
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    want = []
    for page, url, html in rows:
        data = (html or "").encode()
        to = first.get(html or "")
        response = to is None or to == page
        want.append((page, url, "response" if response else "revisit", None if response else to, len(data), warc.digest_of(data)))
    same(got, want)


def test_warc_archive_has_dictionary_and_single_frames():
    records = [warc.record(k, "http://x", (f"<html><body>{'page text ' * 40}{k}</body></html>").encode(), None, "d") for k in range(400)]
    data = b"".join(warc.archive(records, warc.train(records)))
    assert data[:4] == bytes.fromhex("5d2a4d18")
    back = list(warc.records_in(data))
    assert [r for _, r in back] == records
    size = 8 + int.from_bytes(data[4:8], "little")
    assert len(data) - size < len(b"".join(warc.archive(records, None))) / 2
    assert list(warc.records_in(b"".join(warc.archive(records[:2], None))))[1][1] == records[1]


def test_warc_of_nothing(spark):
    assert warc.roundtrip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_every_archive_has_a_dictionary(spark):
    for sizes in ([1], [70_000] * 3, [400_000] * 5, [0, 10]):
        records = [warc.record(k, None, f"<p>text {k}</p>".encode() * n, None, "1970-01-01T00:00:00Z") for k, n in enumerate(sizes)]
        dictionary = warc.train(warc.sample(records))
        data = b"".join(warc.archive(records, dictionary))
        assert len(dictionary.as_bytes()) >= 200 and data[:4] == warc.struct.pack("<I", warc.DICTIONARY_FRAME)
        assert [r for _, r in warc.records_in(data)] == records
    pieces = warc.sample([bytes(100_000)] * 30)
    assert warc.PIECES <= len(pieces) <= warc.PIECES + 1 and sum(map(len, pieces)) <= warc.TRAINING_BYTES
    pages = spark.createDataFrame([(1, "u", "<p>a</p>")], "page_id long, url string, html string")
    folder = "file:" + str(warc.scratch_path(spark, "warc-one")).removeprefix("file:")
    assert warc.write_archives(pages, folder.replace("file:/", "file:///", 1)).where("dictionary_bytes >= 200").count() == 1


# -- 3 urls


def brute_rule(host, path):
    best = None
    for action, rule in urls.RULES:
        site, _, below = rule.partition("/")
        if (host == site or host.endswith("." + site)) and path.startswith("/" + below) and (best is None or len(rule) > len(best[1])):
            best = action, rule
    return best or (None, None)


def test_url_rules_and_models(spark):
    known = [
        (1, "HTTP://Example.NET/en/x?q"), (2, "http://net"), (3, "http://a.net/"), (4, "https://x.example.com/de/1#a"), (5, None),
        (6, "no scheme"), (7, "http://notnet/"), (8, "http://b.org/fr/é"), (9, "http://b.org/fr"), (10, ""), (8, "http://b.org/fr/é"), (None, "a://b?c/d"),
    ]
    rows = known + [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()]
    rows += [(1000 + k, f"http://{'spam' if k % 2 else 'good'}{k}.{'net/x' if k % 2 else 'org/fr/'}{k}") for k in range(60)]
    rows += [(2000 + k, f"http://{'spam' if k % 2 else 'good'}{k}.info/{k}") for k in range(20)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    want = []
    for page, url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        action, rule = brute_rule(host, path)
        want.append((page, host, path, rule, action))
    same([(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in got], want)
    assert all(r["verdict"] in ("allow", "block") for r in got)


def test_url_gram_scores_are_witten_bell(spark):
    rng = random.Random(3)
    order, size = 2, 8
    grams = {"".join(rng.choice("abc") for _ in range(order + 1)): (rng.randrange(4), rng.randrange(4)) for _ in range(18)}
    df = spark.createDataFrame([(g, a, r) for g, (a, r) in grams.items()], "gram string, accepted long, rejected long")
    got = {r["gram"]: r["ratio"] for r in urls.gram_scores(df, order, size).collect()}

    def probability(gram, which, k):
        if k < 0:
            return 1 / size
        tail = gram[len(gram) - k - 1:]
        sums = Counter()
        for g, n in grams.items():
            own = g[len(g) - k - 1:]
            if own[:-1] == tail[:-1]:
                sums[own] += n[which]
        seen, kinds = sum(sums.values()), sum(1 for v in sums.values() if v)
        below = probability(gram, which, k - 1)
        return (sums[tail] + kinds * below) / (seen + kinds) if seen else below

    for g in grams:
        assert got[g] == pytest.approx(np.log(probability(g, 0, order)) - np.log(probability(g, 1, order)))


# -- 4 simhash


def brute_fingerprint(text, shingle):
    import xxhash

    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if not words:
        return 0
    grams = [" ".join(words[k:k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    values = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in values) * 2 > len(values))


def brute_components(values, radius=2):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    values = list(parent)
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("shingle", [3, 5])
def test_simhash_against_all_pairs(corpus, shingle):
    rows = simhash.near_duplicates(corpus, shingle).collect()
    want = [(doc, brute_fingerprint(text, shingle)) for doc, text in texts(corpus)]
    same([(r["doc_id"], r["fp"] % (1 << 64)) for r in rows], want)
    roots = brute_components([fp for _, fp in want])
    smallest = {}
    for doc, fp in want:
        if doc is not None:
            smallest[roots[fp]] = min(doc, smallest.get(roots[fp], doc))
    same([(r["doc_id"], r["component_id"]) for r in rows], [(d, smallest.get(roots[fp])) for d, fp in want])


@pytest.mark.parametrize("crowd", [2, 48])
def test_links_of_crowds(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(crowd)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            v = centre
            for b in rng.sample(range(64), rng.randrange(4)):
                v ^= 1 << b
            values.add(v)
    values |= {rng.getrandbits(64) for _ in range(200)} | {0, 1 << 63, 3}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(edges).collect()}
    want = brute_components(values)
    groups = lambda m: {frozenset(k for k in values if m.get(k, k) == r) for r in {m.get(k, k) for k in values}}
    assert groups(got) == groups(want)
    assert all(((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 2 for r in edges.collect())


def test_thresholds_miss_no_partner():
    rng = np.random.default_rng(1)
    groups = [list(range(0, 21)), list(range(21, 42)), list(range(42, 64))]
    histograms = {(p, c): rng.integers(0, 50, 1 << len(cols)).astype(float) for p, g in enumerate(groups) for c, cols in enumerate(simhash.chunked(g))}
    plan = simhash.Allocation(groups, histograms, 100_000, 2)
    chosen = plan.thresholds(rng.integers(0, 2, (500, 64)).astype(np.uint8))
    assert (chosen.sum(axis=1) == 2 - 3 + 1).all() and chosen.min() >= -1


def test_simhash_keeps_one(corpus, empty):
    kept = simhash.drop_near_duplicates(corpus)
    assert kept.columns == corpus.columns
    rows = texts(kept)
    assert Counter(d for d, _ in rows)[900005] <= 1 and (None, texts(corpus)[0]) not in rows
    ids = {r["component_id"] for r in simhash.near_duplicates(corpus).collect()}
    assert {d for d, _ in rows} == ids
    assert simhash.drop_near_duplicates(empty).count() == 0


def brute_copies(rows, similar=0.8):
    """Smallest (id is null, id) of each group by all pairs of shingle sets."""
    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()

    sets = {frozenset(): []}
    for doc, text in rows:
        sets.setdefault(grams(text), []).append((doc is None, doc or 0))
    parent = {s: s for s in sets}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    kinds = list(sets)
    for i, a in enumerate(kinds):
        for b in kinds[i + 1:]:
            if a and b and 0.8 * len(a) <= len(b) <= len(a) / 0.8 and 5 * len(a & b) >= 4 * len(a | b):
                parent[find(a)] = find(b)
    first = {}
    for s, ids in sets.items():
        for k in ids:
            first[find(s)] = min(k, first.get(find(s), k))
    return Counter(first.values())


@pytest.mark.parametrize("leaders", [0, 2])
def test_near_copies_against_all_pairs(spark, corpus, empty, monkeypatch, leaders):
    monkeypatch.setattr(copies, "LEADERS", leaders)
    rng = random.Random(7)
    word = lambda: "w" + str(rng.randrange(3000))
    rows = []
    for group in range(3):
        base = [word() for _ in range(120 + 80 * group)]
        for k in range(40):  # edited copies on both sides of four fifths
            edited = list(base)
            for at in rng.sample(range(len(base)), rng.randrange(1, 8)):
                edited[at] = word()
            rows.append((800000 + 100 * group + k, " ".join(edited)))
    some = corpus.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = copies.drop_near_copies(some)
    assert Counter((d is None, d or 0) for d, _ in texts(kept)) == brute_copies(texts(some))
    assert copies.drop_near_copies(empty).count() == 0


def test_pipeline_drops_edited_copies(spark):
    import corpus_pipeline

    words = [f"word{k}" for k in range(300)]
    edited = [*words[:100], "other", *words[101:200], "another", *words[201:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, "unlike the others")], "doc_id long, text string")
    assert {d for d, _ in texts(corpus_pipeline.drop_near_duplicates(spark, docs, SF))} == {1, 3}


# -- 5 licenses


def test_license_blocks(spark):
    mit = licenses.TEMPLATES["MIT-text"]
    rows = [
        (1, "Words before.\nReleased under the MIT License.\nWords after."), (2, "Licensed under CC BY-NC 4.0."),
        (3, "Licensed under CC BY-NC 3.0."), (4, None), (5, ""), (6, "My driving licence expired."), (7, mit.replace(" and/or", "\nand/or") + "."),
        (8, "x" * 100_000 + " License " + "y" * 1000), (9, mit.replace("free of charge", "for a fee")), (2, "Licensed under CC BY-NC 4.0."),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    good = Counter((r["doc_id"], r["license"]) for r in got if r["confirmed"])
    assert good == Counter({(1, "MIT"): 1, (2, "CC-BY-NC-4.0"): 2, (7, "MIT-text"): 1, (9, "MIT-text"): 1})
    assert next(r for r in got if r["doc_id"] == 3)["confirmed"] is False
    assert next(r for r in got if r["doc_id"] == 9 and r["confirmed"])["missing"] != ""
    text = rows[0][1]
    one = next(r for r in got if r["doc_id"] == 1)
    assert text[one["start"]:one["end"]].strip() == "Released under the MIT License."


@pytest.mark.parametrize("width", [30, 40, 60, 80])
@pytest.mark.parametrize("mark", ["", "# ", "// ", " * "])
def test_licenses_wrapped_at_any_width(width, mark):
    import textwrap

    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.TOLERANCE)
    for name, notice in licenses.TEMPLATES.items():
        lines = textwrap.wrap(notice + ("" if notice.endswith(".") else "."), width, break_long_words=False)
        text = "int main();\n\n" + "\n".join(mark + line for line in lines) + "\n\nOther words of the file."
        good = [r for r in scanner.scan(text) if r["confirmed"]]
        assert [r["license"] for r in good] == [name], (name, good)
        assert notice.split()[0] in text[good[0]["start"]:good[0]["end"]]


def test_neighbouring_licenses_are_both_reported():
    import textwrap

    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.TOLERANCE)
    two = [licenses.TEMPLATES["MIT-text"] + ".", licenses.TEMPLATES["Apache-2.0-header"] + "."]
    text = "\n\n".join("\n".join(textwrap.wrap(n, 80)) for n in two)
    assert sorted(r["license"] for r in scanner.scan(text) if r["confirmed"]) == ["Apache-2.0-header", "MIT-text"]
    # A cue in very long text without any mark between sentences.
    filler = "\n".join(["some words of a line without an end"] * 5000)
    text = filler + "\n" + "\n".join(textwrap.wrap(licenses.TEMPLATES["MIT-text"], 40)) + "\n" + filler
    assert [r["license"] for r in scanner.scan(text) if r["confirmed"]] == ["MIT-text"]


# -- 6 decontamination


def brute_words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute_hits(text, items, window=13):
    words = brute_words(text)
    hit, who = set(), set()
    for item, t in items:
        ws = brute_words(t)
        size = min(window, len(ws))
        grams = {tuple(ws[k:k + size]) for k in range(len(ws) - size + 1)} if ws else set()
        for k in range(len(words) - size + 1):
            if ws and tuple(words[k:k + size]) in grams:
                hit |= set(range(k, k + size))
                who.add(item)
    return len(words), hit, who


@pytest.mark.parametrize("block_bytes", [4 << 20, 2000])
def test_hits_against_all_windows(spark, corpus, block_bytes):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(7001, "Is and"), (7002, "the"), (7003, None), (7004, "..."), (7001, "Is and"), (7005, items[0][1])]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_hits(corpus, df, block_bytes=block_bytes).collect()
    for r in got:
        n, hit, who = brute_hits(r["text"], items)
        assert r["hits"]["n_words"] == n
        assert {k for s in r["hits"]["runs"] for k in range(s["start"], s["end"])} == hit
        assert set(r["hits"]["items"]) == who


def test_automaton_on_random_words():
    rng = random.Random(9)
    for _ in range(60):
        items = [(k, [b"%d" % rng.randrange(3) for _ in range(rng.randrange(0, 12))]) for k in range(5)]
        automaton = decontaminate.ItemAutomaton(items, window=4)
        words = [b"%d" % rng.randrange(4) for _ in range(60)]
        runs, who = automaton.scan(words)
        hit, named = set(), set()
        for item, ws in items:
            size = min(4, len(ws))
            for k in range(len(words) - size + 1):
                if ws and any(words[k:k + size] == ws[j:j + size] for j in range(len(ws) - size + 1)):
                    hit |= set(range(k, k + size))
                    named.add(item)
        assert {k for s, e in runs for k in range(s, e)} == hit and who == named


def test_decontaminate(spark, corpus, empty):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    left = decontaminate.decontaminate(corpus, items)
    assert left.columns == corpus.columns
    assert 900007 not in {d for d, _ in texts(left)} and 900010 in {d for d, _ in texts(left)}
    found = decontaminate.find_hits(left, items).where("size(hits.runs) > 0").count()
    assert found == 0
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(corpus, items.where("false")).count() == corpus.count()
    assert decontaminate.without_words("Ab, cd! ef gh.", [{"start": 1, "end": 3}]) == "Ab,  gh."


# -- 7 quality


def test_quality_held_out(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    judged = quality.classify(docs, labels.where(fold == 0)).select("doc_id", "verdict")
    rows = judged.join(labels.where(fold == 1), "doc_id").collect()
    clean = [r["verdict"]["kept"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["verdict"]["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.05


def test_em_finds_the_better_labeller():
    rng = np.random.default_rng(0)
    bad = rng.random(20000) < 0.2
    votes = [np.where(rng.random(20000) < a, bad, ~bad).astype(int) for a in (0.95, 0.9, 0.7)]
    patterns = Counter("".join(map(str, v)) + "2" for v in zip(*votes, strict=True))
    chance, rates = quality.expectation_maximisation(patterns)
    accuracy = (rates[:, 0, 0] + rates[:, 1, 1]) / 2
    assert accuracy[0] > accuracy[1] > accuracy[2] and abs(accuracy[0] - 0.95) < 0.03
    assert chance["1112"] > 0.95 and chance["0002"] < 0.02
    assert quality.expectation_maximisation({})[0] == {}


def test_votes_teach_beside_labels(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before = quality.fit(docs, labels)["junk"]
    one = labels.where("quality = 1").orderBy("doc_id").limit(1)
    voted = quality.with_known(quality.votes(docs, one, 20_000), one)
    assert quality.training_rows(voted).count() == docs.select("doc_id").distinct().count()  # one label does not silence the others
    few = quality.training_rows(quality.with_known(quality.votes(docs, labels, 40), labels)).count()
    assert 10 <= few <= 80  # by hash, so about as many as asked for
    known = labels.select(F.col("doc_id").alias("known")).distinct()
    assert docs.join(known, docs.doc_id == known.known, "left_anti").count() > 0
    monkeypatch.setitem(quality.TASKS, "junk", {name: lambda d: quality.BAD if len(d.text) % 2 else quality.GOOD for name in quality.TASKS["junk"]})
    assert not np.allclose(before, quality.fit(docs, labels)["junk"])


def test_quality_hard_cases(spark, corpus, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality.classify(corpus, labels)
    assert judged.count() == corpus.count() and set(judged.columns) == set(corpus.columns)
    assert quality.keep_good(empty, labels.where("false")).count() == 0
    assert quality.keep_good(corpus, labels.where("false")).columns == corpus.columns


# -- 8 rules


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    covered = {j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(k, k + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rules_against_brute_force(corpus, empty):
    got = rules.cascade(corpus).collect()
    want = [(d, *brute_measures(t)) for d, t in texts(corpus)]
    same([(r["doc_id"], *(r[c] for c in rules.BASE)) for r in got], want)
    kept = Counter((r["doc_id"], r["first_rejection"] is None) for r in got)
    assert kept == Counter((d, not any(rule.rejects(rules.Measures(t)) for rule in rules.RULES)) for d, t in texts(corpus))
    assert rules.cascade(empty).count() == 0


def test_rule_order_prefers_cheap_rejections(corpus):
    import time as clock

    slow = rules.Rule("slow", lambda m: clock.sleep(0.002) or True)
    quick, idle = rules.Rule("quick", lambda m: True), rules.Rule("idle", lambda m: False)
    order = [r[0] for r in rules.rule_order(corpus.select("doc_id", "text"), (slow, idle, quick))]
    assert order == ["quick", "slow", "idle"]


# -- 9 chat

TEMPLATE = chat.Template()
tricky = st.text(st.sampled_from(list("<[/s>INST]\\SYROLETU ax\né")), max_size=40) | st.text(max_size=20)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "<s>"]) | tricky, tricky), max_size=5))
def test_template_reads_back(turns):
    chunk = "".join(t for role, text in turns for t, _ in TEMPLATE.segments(role, text))
    assert TEMPLATE.read(chunk) == turns
    loss = [TEMPLATE.show(t) for role, text in turns for t, flag in TEMPLATE.segments(role, text) if flag]
    assert loss == [text for role, text in turns if role == "assistant"]


def test_chat_digests(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [
        (None, 0, "user", "x"), (None, None, None, None), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"),
        (-2, 0, "user", "tie"), (-2, 0, "assistant", "tie"), (-3, 0, "tool", "[ROLE]\\"), (-3, 1, "assistant", "y" * 100_000), (-3, 1, "assistant", "again"), (-3, 1, "assistant", "again"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = [tuple(r) for r in chat.read_back(chat.format_turns(df)).drop("formatted_chars", "n_refused").collect()]
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    want = []
    for conv, turns in by.items():
        turns.sort()
        said = "".join(t for _, _, role, t in turns if role == "assistant")
        log = "".join(f"{role}\n{t}\n" for _, _, role, t in turns)
        want.append((conv, len(turns), hashlib.sha256(log.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    same(got, want)


def test_chat_order(spark):
    rows = [(1, k, r, "t") for k, r in enumerate(["system", "user", "assistant", "user", "user", "assistant", "tool"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [r["allowed"] for r in chat.format_turns(df).orderBy("position").collect()]
    assert got == [True, True, True, True, False, True, False]
    assert chat.read_back(chat.format_turns(df.where("false"))).count() == 0


# -- 10 suffixes


def brute_cover(datas, length):
    count = Counter(d[i:i + length] for d in datas for i in range(len(d) - length + 1))
    for d in datas:
        mask = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                mask[i:i + length] = True
        yield mask


@pytest.mark.parametrize(("wide", "shard", "piece"), [(4096, 3072, 1 << 20), (4, 8, 4096)])
def test_repeats_against_all_windows(corpus, monkeypatch, wide, shard, piece):
    monkeypatch.setattr(suffixes, "WIDE", wide)
    monkeypatch.setattr(suffixes, "SHARD", shard)
    rows = suffixes.remove_repeats(corpus, 200).collect()
    datas = [(r["text"] or "").encode() for r in rows]
    for r, data, mask in zip(rows, datas, brute_cover(datas, 200), strict=True):
        got = np.zeros(len(data), bool)
        for s in r["cuts"]["spans"]:
            got[s["begin"]:s["end"]] = True
        assert (got == mask).all(), r["doc_id"]
        assert r["cuts"]["kept"] == np.frombuffer(data, np.uint8)[~mask].tobytes()
        assert r["cuts"]["n_bytes"] == len(data)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(4)
    for trial in range(30):
        sizes = rng.integers(1, 60, 6)
        alphabet = 2 if trial % 2 else 5
        parts = [bytes(rng.integers(97, 97 + alphabet, n).astype(np.uint8)) for n in sizes]
        offsets = np.cumsum(sizes + 1) - (sizes + 1)
        text = np.zeros(int((sizes + 1).sum()), np.int16)
        for o, p in zip(offsets, parts, strict=True):
            text[o:o + len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) + 1
        order, rank = suffixes.suffix_array(text)
        plain = text.tolist()
        assert order.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
        shared = suffixes.common_prefixes(np.where(text > 0, text - 1, 0), order, rank, offsets, sizes, sizes, len(text))
        place = np.argsort(order)
        for o, p in zip(offsets, parts, strict=True):
            for j in range(len(p)):
                i = o + j
                before = order[place[i] - 1] if place[i] else None
                n = 0
                while before is not None and plain[i + n] and plain[i + n] == plain[before + n]:
                    n += 1
                assert shared[i] == n


def test_truncated_order_gives_the_same_windows():
    import pandas as pd

    rng = np.random.default_rng(9)
    for trial in range(20):
        length = 20
        base = rng.integers(97, 99, 300).astype(np.uint8).tobytes()
        pieces = [base[a:a + int(rng.integers(length, 60))] for a in rng.integers(0, 240, 12)] + [b"a" * 50, b"ab" * 25]
        frame = pd.DataFrame({"data": pieces, "n": [len(p) - length + 1 for p in pieces]})
        which, start, equal, alone = suffixes.repeated_windows(frame, length)
        found = [pieces[w][s:s + length] for w, s in zip(which, start, strict=True)]
        count = Counter(found)
        assert [count[f] > 1 for f in found] == equal.tolist()
        # One of several equal windows is reported.
        assert Counter(f for f, a in zip(found, alone, strict=True) if a) == Counter(set(found))


def test_runs_meet_by_binary_search(spark):
    rng = np.random.default_rng(3)
    rows, want, seen = [], Counter(), defaultdict(list)
    for shard in range(7):
        keys = np.sort(rng.choice(40, 15, replace=False))
        run = np.zeros(len(keys), suffixes.ENTRY)
        run["key"] = [int(k).to_bytes(16, "big") for k in keys]
        run["doc"], run["begin"], run["flags"] = shard, keys, [2 * (shard == 0) + (k % 5 == 0) for k in keys]
        for k in keys:
            seen[int(k)].append(shard)
        rows.append((0, bytearray(run.tobytes())))
    for k, shards in seen.items():
        if len(shards) > 1 and k % 5:
            want.update((None if s == 0 else s, 0, k, k + 20) for s in shards)
    got = suffixes.merge_shards(spark.createDataFrame(rows, "piece long, run binary"), 20).collect()
    assert Counter(map(tuple, got)) == want


def test_many_equal_rows_are_opened_once(spark):
    text = " ".join(f"word{k}" for k in range(300))
    docs = spark.range(0, 600, 1, 8).selectExpr("CASE WHEN id < 300 THEN 1 END AS doc_id", f"'{text}' AS text")
    other = spark.createDataFrame([(2, text[:900] + " an own end " + "xyz " * 100), (3, "short")], "doc_id long, text string")
    rows = suffixes.remove_repeats(docs.unionByName(other), 200).collect()
    datas = [r["text"].encode() for r in rows]
    for r, data, mask in zip(rows, datas, brute_cover(datas, 200), strict=True):
        assert r["cuts"]["kept"] == np.frombuffer(data, np.uint8)[~mask].tobytes()
        assert len(r["cuts"]["spans"]) <= 1 + (r["doc_id"] == 2)


def test_drop_repeats(corpus, empty):
    kept = suffixes.drop_repeats(corpus)
    assert kept.columns == corpus.columns and kept.count() == corpus.count()
    assert all(t == "" for d, t in texts(kept) if d in (900005, 900008))
    assert suffixes.drop_repeats(empty).count() == 0


# -- all


def test_pieces_agree_with_query(spark):
    from facetloom.llm.queries import QUERIES

    rows = QUERIES["op1_packing"](spark, SF).collect()
    assert all(0 <= r["ids_crc32"] < 1 << 32 for r in rows)
    whole = [r for r in rows if r["length"] == r["doc_tokens"]]
    ids = {p["doc_id"]: p["ids"] for p in packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), 1 << 20).collect()}
    assert whole and all(r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]]) for r in whole if len(ids[r["doc_id"]]) == 4 * r["doc_tokens"])


def test_pipeline(spark, corpus):
    import corpus_pipeline

    docs = corpus
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == corpus.columns, name
        docs = corpus_pipeline.store(docs, name)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {d for d, _ in texts(docs)}
    left = {d for d, _ in texts(docs)}
    assert 900007 not in left and 900010 in left
    assert not {900005, 900006} <= left


def test_near_copies_start_from_simhash_and_check_it(spark, corpus):
    """First candidates reach what SimHash links, and a link between unlike sets of shingles does not count."""
    line = "one line that comes back seven words "
    loud = [(700000 + k, line * 900 + " ".join(f"t{k}w{j}" for j in range(60))) for k in range(4)]
    docs = corpus.select("doc_id", "text").union(spark.createDataFrame(loud, "doc_id long, text string"))
    rows = copies.nodes_of(docs, 5)
    text_of = {d: t for d, t in texts(docs) if d is not None and d not in (900005, 900009)}
    for r in rows.where("doc_id IS NOT NULL").select("doc_id", "fp").collect():
        if r["doc_id"] in text_of:
            assert r["fp"] == simhash.fingerprint(text_of[r["doc_id"]], 5)
    pairs = [tuple(r) for r in copies.simhash_pairs(rows).collect()]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    linked = simhash.near_duplicates(docs, shingle=5).select("text_key", "doc_id", "keeper_id", "keeper_key").distinct()
    groups = {}
    for r in rows.join(linked, ["text_key", "doc_id"]).select("node", "keeper_id", "keeper_key").collect():
        groups.setdefault((r["keeper_id"], r["keeper_key"]), set()).add(find(r["node"]))
    assert pairs and all(len(g) == 1 for g in groups.values())
    assert rows.where("doc_id BETWEEN 700000 AND 700003").select("fp").distinct().count() == 1
    assert {d for d, _ in texts(copies.drop_near_copies(docs))} >= {d for d, _ in loud}


def test_texts_that_share_half_are_not_compared_in_pairs(spark, monkeypatch):
    """Many texts with one long passage in common meet under shared keys, yet only the similar ones are compared."""
    common = " ".join(f"c{k}" for k in range(100))
    texts = [f"{common} " + " ".join(f"d{i}w{k}" for k in range(100)) for i in range(120)]
    texts.append(texts[0] + " one more word")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, store = [], copies.store

    def counted(df, name):
        out = store(df, name)
        asked.extend([out.count()] * (name == "candidate-pairs"))
        return out

    monkeypatch.setattr(copies, "store", counted)
    assert {r["doc_id"] for r in copies.drop_near_copies(docs).collect()} == set(range(120))
    assert 1 <= sum(asked) < 60
