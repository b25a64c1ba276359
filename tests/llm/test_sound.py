"""Structured words, large clusters, padding, many blocks of a benchmark, hostile pages."""

import re
import sys
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

from panelkit.llm import decontaminate, graph, langid, licenses, lm, neardup, packing, queries, shared, suffixes
from panelkit.llm.textscan import NOT_SPACE, Words, run_hashes, text_buffer


def thue_morse(letters, n=1024):
    """An order of two things in which sums over powers of one base cancel out, and the order with the two exchanged."""
    bits = [k.bit_count() % 2 for k in range(n)]
    return [letters[b] for b in bits], [letters[1 - b] for b in bits]


def test_structured_words_and_runs_have_hashes_of_their_own():
    one, two = ("".join(x) for x in thue_morse("ab"))
    long = [" ".join(x) for x in thue_morse(("north", "south"))]
    texts = pa.array([one, two, *long])
    data, offsets = text_buffer(texts)
    words = Words(data, offsets, NOT_SPACE)
    value = words.hashes()
    assert value[0] != value[1]
    runs = run_hashes(value, words.first[:-1], np.diff(words.first))
    assert len(set(runs.tolist())) == 4
    assert len({tuple(x) for x in neardup._sequence(words).tolist()}) == 4


def test_structured_texts_are_not_taken_for_equal(spark):
    one, two = ("".join(x) for x in thue_morse("ab"))
    long = [" ".join(x) for x in thue_morse(("north", "south"))]
    rows = [(1, f"{one} and some more words to score"), (2, f"{two} and other things that are said"), (3, long[0]), (4, long[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {1, 2} | {min(i for i, t in rows[2:] if shingles(t) == s) for s in {frozenset(shingles(t)) for _, t in rows[2:]}}
    assert {r.doc_id for r in neardup.keep_one(docs).collect()} >= whole
    # The two long words are one word each, and neither text has the other's.
    words = {r.doc_id: r for r in lm.scores(docs.where("doc_id < 3"), order=1).collect()}
    total = 14 - 7
    assert round(words[1].log_score, 6) == round(6 * np.log(1 / total) + np.log(1 / total), 6)
    item = spark.createDataFrame([(7, f"{one} and")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.report(docs, item).collect()} == {1: 2, 2: 0, 3: 0, 4: 0}


def shingles(text, width=5):
    w = text.split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def similar_groups(texts):
    """The least place reachable over pairs of a similarity of 0.8 or more, by lists of the texts of each shingle."""
    sets = [shingles(t.translate({i: i + 32 for i in range(65, 91)})) for t in texts]
    lists = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            lists[x].append(k)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for k, s in enumerate(sets):
        common = Counter(j for x in s for j in lists[x] if j < k)
        for j, n in common.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) and find(j) != find(k):
                root[max(find(j), find(k))] = min(find(j), find(k))
    return [find(k) for k in range(len(texts))]


def test_no_similar_pair_of_the_table_is_missed(spark):
    rows = [(r.doc_id, r.text) for r in shared.table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").collect() if r.text and re.search("[^ \t-\r]", r.text)]
    group = similar_groups([re.sub("[ \t-\r]+", " ", t).strip() for _, t in rows])
    want = {rows[g][0] for g in group}
    docs = shared.table(spark, "/root/testdata/sf0.01", "documents").where(F.rlike("text", F.lit("[^ \\t-\\r]")))
    assert {r.doc_id for r in neardup.keep_one(docs).collect()} == want


@pytest.mark.parametrize("n", [500, 1000, 2000])
def test_edges_of_a_large_cluster_grow_in_proportion_to_it(spark, monkeypatch, n):
    """Copies of one text with a word changed: the similarity of two is about 0.7, to the first 0.84."""
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 128)
    made = []
    block_edges = neardup._block_edges
    monkeypatch.setattr(neardup, "_block_edges", lambda *a: made.append(shared.pinned(block_edges(*a))) or made[-1])
    rng = np.random.default_rng(n)
    base = [f"word{k}" for k in range(70)]
    rows = [(0, " ".join(base))]
    for k in range(1, n):
        own = list(base)
        own[int(rng.integers(0, 70))] = f"other{k}"
        rows.append((k, " ".join(own)))
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in kept] == [0]
    assert sum(e.count() for e in made) <= 4 * n


def test_many_rows_without_an_id(spark):
    """Rows without an id share none: each text among them is compared once, whatever their number."""
    base = [f"word{k}" for k in range(60)]
    near = [" ".join([*base[:j], f"other{j}", *base[j + 1 :]]) for j in range(0, 60, 3)]
    rows = [(None, t) for t in near for _ in range(5)] + [(None, f"text {k} that is like no other one {k} of all {k}") for k in range(100)] + [(4, near[0]), (4, near[0])]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.text.split()[0]) for r in kept) == [(False, "other0")] + [(True, "text")] * 100


def test_star_edges_span_what_the_edges_span():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 1 << 62, 400).astype(np.uint64)[rng.integers(0, 400, (2, 300))]
    u, v = graph.stars(a, b)
    assert len(u) == len({*a.tolist(), *b.tolist()}) - len({*u.tolist()} | ({*a[a == b].tolist()} - {*u.tolist(), *v.tolist()}))

    def parts(x, y):
        root = {}

        def find(k):
            while root.setdefault(k, k) != k:
                k = root[k]
            return k

        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            p, q = find(p), find(q)
            root[max(p, q)] = min(p, q)
        return {k: find(k) for k in root if find(k) != k}

    assert parts(u, v) == parts(a, b) == dict(zip(v.tolist(), u.tolist(), strict=True))


def test_windows_are_full_and_their_count_rises(spark):
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, packing.PIECE + 1, 200).tolist()
    parts = packing.windows_of(lengths, packing.CAPACITY)
    assert sorted(i for p in parts for i in p) == list(range(200))
    assert all(sum(lengths[i] for i in p) <= packing.CAPACITY for p in parts)
    assert len(packing.windows_of([600] * 4, 1024)) == 4
    assert packing.windows_of([], 1024) == []
    # Over all groups of a task little is left empty; only its last window is not full.
    packer = packing._Packer(packing.CAPACITY, packing.GROUP_WINDOWS)
    for n in rng.integers(1, 3000, 4000).tolist():
        packer.add(0, np.zeros(n, np.uint32))
    packer.close()
    pieces = packer.taken()
    held = sum(p[2] for p in pieces)
    assert held >= 0.98 * packing.CAPACITY * packer.sequence
    # Sequences of several tasks have numbers of their own.
    docs = spark.createDataFrame([(k, "some words " * (40 * k % 700)) for k in range(300)], "doc_id long, text string").repartition(4)
    filled = packing.pack(docs, queries.byte_bpe).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert filled.where("n <> end OR n > 1024").isEmpty() and filled.where("sequence_id >= 1099511627776").count() > 0


def test_passes_over_many_benchmark_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", 2)
    items = [(k, " ".join(f"w{(k * 7 + j) % 50}" for j in range(15))) for k in range(20)] + [(3, "w1 w2")]
    docs = spark.createDataFrame([(k, " ".join(f"w{j % 50}" for j in range(k, k + 40))) for k in range(30)], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    few, many = (sorted(map(str, decontaminate.scan(docs, benchmark, block_bytes=b).collect())) for b in (1 << 20, 100))
    assert few == many and any("Row(word" in x for x in few)


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontaminate, "run_hashes", lambda value, start, size: np.zeros(len(start), np.uint64))
    windows = decontaminate.WindowSet([(1, "a b c"), (2, "d e f"), (2, "d e f"), (5, "a b c")], 3)
    data, offsets = text_buffer(pa.array(["x a b c", "d e f"]))
    found, sizes, items = windows.hits(Words(data, offsets, decontaminate.ALNUM))
    assert (found, sizes, items) == ([1, 4], [3, 3], [[1, 5], [2]])


def test_repeated_and_periodic_bytes(spark):
    rng = np.random.default_rng(11)
    draw = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared_text, phrase = draw(900), draw(64)
    rows = [(5, "ab" * 700), (6, "ab" * 400 + draw(40)), (7, draw(200) + "ab" * 90), (8, "x" * 3000), (9, "x" * 49), (10, "x" * 60)]
    rows += [(20 + k, draw(int(rng.integers(0, 90))) + shared_text[int(rng.integers(0, 300)) :] + draw(30)) for k in range(12)]
    rows += [(40 + k, "".join(draw(int(rng.integers(1, 60))) + phrase for _ in range(4))) for k in range(6)]
    rows += [(40, shared_text), (None, shared_text), (None, phrase * 3), (3, None), (2, ""), (60, "é" * 80), (61, "é" * 80)]
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], 1 << 62), 1 << 62 if i is None else i)
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        want.append((str(i), len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((str(r[0]), *tuple(r)[1:4]) for r in suffixes.deduplicate(docs, with_text=False).collect()) == sorted(want)


def test_every_known_sentence_has_a_hint_and_a_licence_of_its_own():
    assert all(re.search(licenses.HINT, s) for s in licenses.KNOWN)
    assert all(re.sub(licenses.NOT_NORMAL, " ", s) == s for s in licenses.KNOWN)
    assert all(i in licenses.SENTENCES for _, ids in licenses.RULES for i in ids)


def test_visible_text_of_hostile_pages():
    assert langid.visible_text("a<b>c</b> <!-- x > y --> d<script>if (a < b) {}</script >e<STYLE>p</style>f") == "a c d e f"
    assert langid.visible_text("x <script>never closed") == "x" and langid.visible_text("x <!-- never closed") == "x"
    assert langid.visible_text("1 < 2 &amp; 3") == "1 < 2 & 3" and langid.visible_text(None) == langid.visible_text("") == ""
    for piece in ("<script>", "<!--", "<", "<html ", "</script ", "&#" + "9" * 5000 + ";", "<style><script>"):
        start = time.perf_counter()
        langid.visible_text(piece * ((1 << 20) // len(piece)))
        assert time.perf_counter() - start < 5


def test_hostile_pages_and_clashing_columns(spark):
    model = langid.TextModel(["de", "en"], np.log(np.full((2, langid._BUCKETS), 1 / langid._BUCKETS)))
    rows = [(k, "http://a.de/", p * ((1 << 20) // len(p)), "x", 1, "y", 2) for k, p in enumerate(("<script>", "<html ", "<!--", "a" * 64))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, n_host int, lang string, logs int")
    start = time.perf_counter()
    got = langid.identify(pages, model).collect()
    assert len(got) == 4 and time.perf_counter() - start < 60


def test_posterior_by_brute_force(spark):
    """The fused evidence over a small table, added up in plain Python."""
    rng = np.random.default_rng(3)
    languages = ["de", "en", "fr"]
    table = rng.random((3, langid._BUCKETS)) ** 4 + 1e-3
    model = langid.TextModel(languages, np.log(table / table.sum(1, keepdims=True)))
    hosts = ["a.x.de", "b.x.de", "c.example.com", "d.example.com", "single"]
    rows = []
    for k in range(40):
        host = hosts[int(rng.integers(0, 5))]
        lang = ["", ' lang="de"', " lang=en-US", " LANG='fr'"][int(rng.integers(0, 4))]
        text = "".join(rng.choice(list("abcdefgh "), int(rng.integers(0, 60))))
        rows.append((k, f"http://u@{host}:80/p?q" if k % 7 else None, f"<html{lang}><p>{text}</p>" if k % 11 else None))
    rows.append(rows[-1])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    cases = []
    for _, url, html in rows:
        text = re.sub(" +", " ", re.sub("<[^>]*>", " ", html or "")).strip().encode()
        grams = langid._trigrams(np.frombuffer(text, np.uint8)).tolist()
        logs = np.array([sum(model.logs[m][g] for g in grams) for m in range(3)]) * (min(len(grams), langid.EVIDENCE) / max(len(grams), 1))
        host = url.split("@")[1].split(":")[0] if url else ""
        declared = re.search(r"(?i)<html\b[^>]*?lang=[\"']?([a-z]{2,3})", html or "")
        parts = host.split(".")
        cases.append({"logs": logs, "text": languages[int(np.argmax(logs))], "host": host, "domain": ".".join(parts[-2:]) if len(parts) > 1 else "", "suffix": parts[-1] if len(parts) > 1 else "", "declared": declared[1].lower() if declared else ""})
    count = lambda key, value: np.array([sum(c["text"] == x and c[key] == value for c in cases) for x in languages], float)
    prior = np.array([sum(c["text"] == x for c in cases) + 1.0 for x in languages])
    whole = prior / prior.sum()
    want = []
    for c in cases:
        own = np.array([float(c["text"] == x) for x in languages])
        smooth = lambda n, towards, weight: (n + weight * towards) / (n.sum() + weight)
        domain = smooth(count("domain", c["domain"]) - own, whole, langid.DOMAIN_WEIGHT)
        logs = c["logs"] + np.log(smooth(count("host", c["host"]) - own, domain, langid.HOST_WEIGHT))
        for signal in ("declared", "suffix"):
            if c[signal]:
                n = count(signal, c[signal])
                share = max(n.sum() - 1, 1.0) / prior.sum()
                logs = logs + np.log((n - own + langid.SIGNAL_WEIGHT * share) / ((prior + langid.SIGNAL_WEIGHT) * share))
        p = np.exp(logs - logs.max())
        want.append((languages[int(np.argmax(logs))], round(float(p.max() / p.sum()), 6)))
    got = langid.identify(pages, model).collect()
    assert sorted((r.page_id, r.lang, round(r.posterior, 6)) for r in got) == sorted((row[0], *w) for row, w in zip(rows, want, strict=True))


def test_sample_of_a_language_is_of_distinct_texts(spark):
    rows = [("en", "the same text again")] * 400 + [("en", f"text number {k} of many") for k in range(60)] + [("de", f"ein Text {k}") for k in range(5)] + [(None, "x"), ("fr", None)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = langid.fit(docs, sample_texts=30)
    assert model.languages == ["de", "en"]
    for k, n in ((0, 5), (1, 30)):
        most = np.exp(model.logs[k]).max()
        assert most < 0.9 and n
