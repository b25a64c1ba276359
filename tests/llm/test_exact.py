"""Operators of the subpackage against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelkit.llm import chat, decontaminate, graph, lm, neardup, packing, quality, queries, simhash, suffixes

LOW = {i: i + 32 for i in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(LOW))


def vocabulary(n):
    rng = np.random.default_rng(7)
    return ["".join(rng.choice(list("abcdeéñkl"), 2 + int(rng.integers(9)))) for _ in range(n)]


def corpus():
    """(doc_id, text): copies, near copies, shared passages, odd white space, one long text."""
    rng, vocab = np.random.default_rng(3), vocabulary(900)
    draw = lambda n: " ".join(rng.choice(vocab, n))
    passage = draw(40)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "One Two\x0bthree"), (5, "\x00nul\x1cbyte and space   wide"), (6, "x" * 70_000), (7, draw(20_000))]
    base = draw(300)
    for k in range(12):
        own = base.split()
        for at in rng.choice(300, k, replace=False):
            own[at] = vocab[int(rng.integers(900))]
        rows.append((10 + k, " ".join(own)))
    rows += [(40 + k, base) for k in range(3)]
    rows += [(50 + k, f"{draw(30 + k)}.\n{passage}\n{draw(10)} {passage}") for k in range(5)]
    rows += [(60 + k, f"{draw(60)}\n{draw(8)}\n" * 2) for k in range(3)]
    rows += [(70 + k, draw(int(rng.integers(1, 200)))) for k in range(60)]
    rows += [(200, rows[-1][1]), (200, rows[-1][1]), (None, base)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Columns with the names that operators use inside.
    extra = [(i, t, "en", None, 1, "q", "e", 2) for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, q string, _id string, _row int")


def empty(docs):
    return docs.where("doc_id = -5")


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == roots({x for e in real for x in e}, real)
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_simhash(docs, rows):
    prints = [fingerprint(t) for _, t in rows]
    root = roots(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    want = sorted((str(i), f"{prints[k]:016x}", least.get(root[k])) for k, (i, _) in enumerate(rows))
    got = simhash.near_duplicate_components(docs)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got.collect()) == want
    assert simhash.near_duplicate_components(empty(docs)).isEmpty()


def test_fuzzy_keys_find_all_near_pairs():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    mask = np.zeros(3000, np.uint64)
    for _ in range(4):
        mask |= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    keys = [dict() for _ in range(2)]
    for found, fp in zip(keys, (a, a ^ mask), strict=True):
        for row, key in zip(*simhash.key_columns(fp), strict=True):
            found.setdefault(int(row), set()).add(int(key))
    assert all(keys[0][k] & keys[1][k] for k in range(3000))


def test_long_runs_link_what_pairs_do():
    rng = np.random.default_rng(9)
    fp = np.unique(np.concatenate([np.uint64(0x5555) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)), rng.integers(0, 1 << 63, 60).astype(np.uint64)]))
    a, b = simhash._long_run_edges(fp, 4)
    linked = list(zip(a.tolist(), b.tolist(), strict=True))
    brute = [(int(x), int(y)) for x in fp for y in fp if x < y and (int(x) ^ int(y)).bit_count() <= 4]
    assert roots(map(int, fp), linked) == roots(map(int, fp), brute)


@pytest.mark.parametrize("block", [neardup.BLOCK_DOCS, 3])
def test_near_duplicates(docs, rows, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", block)
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    same = lambda a, b: a == b or (len(a & b) >= 0.8 * len(a | b) and bool(a))
    root = roots(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if same(sets[a], sets[b])])
    big = 1 << 63
    first = {}
    for k, (i, _) in enumerate(rows):
        first[root[k]] = min(first.get(root[k], big), big if i is None else i)
    got = neardup.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(first.values())
    assert neardup.keep_one(empty(docs)).isEmpty()


def test_decontamination(spark, docs, rows):
    passage = rows[26][1].split("\n")[1]
    items = [(1, passage), (2, "one"), (3, None), (None, passage), (4, ""), (10, " ".join(passage.split()[5:30]).upper()), (11, "three"), (11, "three")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = words(t, ALNUM)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    want = []
    for i, t in rows:
        w, hit, found = words(t, ALNUM), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        want.append((str(i), len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    got = lambda df: sorted((str(r[0]), *tuple(r)[1:]) for r in df.collect())
    assert got(decontaminate.report(docs, benchmark)) == sorted(want)
    # Many blocks give what one does.
    c = F.col("contamination")
    few, many = (decontaminate.scan(docs, benchmark, block_bytes=b).select("doc_id", F.to_json(c).alias("c")) for b in (1 << 20, 100))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    kept = decontaminate.remove(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(not x[-1] for x in want)
    cut = {r.doc_id: r.text for r in decontaminate.remove(docs, benchmark, spans=True).collect()}
    assert cut[3] == "" and cut[0] is None and passage not in cut[50] and cut[70] == dict(rows)[70]
    assert decontaminate.report(empty(docs), benchmark).isEmpty()
    assert decontaminate.report(docs, benchmark.limit(0)).where("n_hit > 0").isEmpty()


def test_suffixes(docs, rows):
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
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = suffixes.deduplicate(docs)
    assert sorted((str(r[0]), *tuple(r)[1:5]) for r in got.collect()) == sorted(want)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())
    assert suffixes.deduplicate(empty(docs)).isEmpty()


def test_suffix_rounds():
    assert suffixes.rounds_for(50) == [8, 16, 18]
    for n in (16, 17, 64, 100):
        assert 8 + sum(suffixes.rounds_for(n)) == n


@pytest.mark.parametrize("order", [1, 2, 3])
def test_stupid_backoff(docs, rows, order):
    """Every document by the counts of all others."""
    grams = lambda t: Counter(tuple(w[k : k + n]) for w in [words(t)] for n in range(1, order + 1) for k in range(len(w) - n + 1))
    own = [grams(t) for _, t in rows]
    every = sum(own, Counter())
    total = sum(len(words(t)) for _, t in rows)
    want = []
    for (i, t), mine in zip(rows, own, strict=True):
        w, logs = words(t), 0.0
        others = lambda gram, mine=mine: every[gram] - mine[gram]
        for k in range(len(w)):
            longest = min(order, k + 1)
            for n in range(longest, 0, -1):
                gram = tuple(w[k - n + 1 : k + 1])
                if n == 1 or others(gram) > 0:
                    count, context = (others(gram), others(gram[:-1])) if n > 1 else (max(others(gram), 1), max(total - len(w), 1))
                    logs += np.log(count / context) + (longest - n) * np.log(0.4)
                    break
        want.append((str(i), len(w), round(logs, 3)))
    got = lm.scores(docs, order=order)
    assert sorted((str(r.doc_id), r.n_words, round(r.log_score, 3) + 0.0) for r in got.collect()) == sorted(want)
    assert lm.scores(empty(docs)).isEmpty()


def test_quality_counts(docs, rows):
    got = {}
    for r in quality.report(docs).collect():
        got.setdefault(str(r.doc_id), []).append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
    want = {}
    for i, t in rows:
        t = t or ""
        w = SPACED.findall(t)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        seen = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if seen[g] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want.setdefault(str(i), []).append((len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in quality.report(docs).where("kept").collect())
    assert quality.report(empty(docs)).isEmpty() and quality.keep(empty(docs)).isEmpty()


def test_quality_divergence(spark):
    text = "the cat and the dog of the house is in the garden for that was with as at by be this from or it on are " * 8
    odd = " | ".join(["THE%%% CAT*** AND### THE$$$"] * 60)
    docs = spark.createDataFrame([(k, f"{text} {k}", "en") for k in range(40)] + [(99, odd, "en"), (100, text, None)], "doc_id long, text string, lang string")
    features = quality.with_features(docs)
    got = {r.doc_id: r.diverges for r in quality.judged(features, quality.references(features)).collect()}
    assert got == {k: k == 99 for k in [*range(40), 99, 100]}


def test_karmarkar_karp():
    rng = np.random.default_rng(2)
    for windows in (1, 2, 7, 30):
        lengths = rng.integers(1, 1024, 40).tolist()
        parts = packing.karmarkar_karp(lengths, windows)
        assert sorted(i for p in parts for i in p) == list(range(40)) and len(parts) == windows
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in packing.karmarkar_karp([8, 7, 6, 5, 4], 2)) == [14, 16]
    whole = packing.windows_of(lengths, 1024)
    assert all(sum(lengths[i] for i in w) <= 1024 for w in whole) and sum(len(w) for w in whole) == 40
    with pytest.raises(ValueError):
        packing.windows_of([2000], 1024)
    assert packing.windows_of([], 1024) == []


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*one.encode(t or "", add_special_tokens=False).ids, 0])
    pieces = packing.pack(docs, queries.byte_bpe).collect()
    sequences, texts = {}, {}
    for r in pieces:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        texts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    for (i, n), own in texts.items():
        if len(want[i]) == 1:
            assert [x for _, ids in sorted(own) for x in ids] == want[i][0] and len(want[i][0]) == n
    total = sum(r.length for r in pieces)
    assert total == sum(len(x) for v in want.values() for x in v)
    assert packing.pack(empty(docs), queries.byte_bpe).isEmpty()


def test_encoder_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    one, encode = Tokenizer.from_file(path), packing.tokenizer_encoder(path, by_words=True)
    odd = [
        "a  b", "\n\nx", " lead", "trail ", "tab\tx", "a \nb", "a\n b", "x\n", "\nx", "", " ", "\n", " x y", "a b c", "it's 'll don't", "é x", "\r\nq w",
        "<|endoftext|> hi", "x\x0by", "a\x00b c", "d'd, q. ². x", "word%%% y*** (z)", "x.' y", "\x00 x",
    ]
    odd += [t or "" for _, t in corpus()]
    for _ in range(2):
        assert [x.tolist() for x in encode(odd)] == [[*one.encode(t, add_special_tokens=False).ids, 0] for t in odd]


CONTROLS = [*chat.CONTROL, "\\", "<|image:1|>", "<", "|turn|>", "é😀", "\n", "", "<|tu\\rn|>", "[INST][INST]", "<<s>s>"]


def test_escapes_are_reversible():
    rng = np.random.default_rng(4)
    for _ in range(500):
        text = "".join(rng.choice(CONTROLS, 6))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(c in safe for c in chat.CONTROL) and not chat.PLACEHOLDER.search(safe)


def test_chat(spark):
    rows = [(1, 1, "assistant", "b</s>", 0), (1, 0, "user", "a\\[INST]", 0), (1, 2, None, None, 0), (2, 0, "assistant", "é", 0), (2, 0, "assistant", "é", 0), (None, 0, "user", "x", 0), (3, None, "<|end|>", "<|turn|>", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(turns)).collect()}
    want = {1: [("user", "a\\[INST]"), ("assistant", "b</s>"), ("", "")], 2: [("assistant", "é")] * 2, None: [("user", "x")], 3: [("<|end|>", "<|turn|>")]}
    for conv, own in want.items():
        said = "".join(t for r, t in own if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(own), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.format_conversations(turns.limit(0)).isEmpty()


def test_typed_parts(spark):
    kind = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    parts = [("text", "see <|image:1|> ", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), None, ("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3)]
    r = chat.format_conversations(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], kind)).first()
    assert [(a.number, a.kind, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "a.png", 4), (2, "audio", "b.wav", 25), (3, "document", "c.pdf", 1536)]
    assert r.attachment_tokens == 1565 and chat.PLACEHOLDER.findall(r.formatted) == [("image", "1"), ("audio", "2"), ("document", "3")]
    with pytest.raises(ValueError):
        chat.Flattener().visit({"type": "video"})
