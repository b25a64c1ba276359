"""Near-duplicates on word shingles: Golay keys of SimHash fingerprints and bands of least hashes find candidates, exact Jaccard similarity decides.

Texts of the same words collapse first. Two segments of the SimHash of a text's
shingles that share a codeword index make a key: that finds all fingerprints of
five or fewer differing bits. Texts of a similarity near the threshold differ in
more bits, so bands of least shingle hashes are keys too: of a pair at the
threshold all bands differ in one of a million. Candidates are checked where
their keys meet, fingerprints by their bits and bands by a sketch of 128 bits, so
that clusters are of texts that resemble one another. Within a cluster shingle
sets are compared exactly, each with those not reached yet. A cluster of several
blocks is compared within each block; what links blocks is found by one text of
each group of a block, and the texts outside the largest group are then held
against all blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm import golay, graph, shards
from panelkit.llm.shared import boxed, pinned, unboxed
from panelkit.llm.simhash import SEGMENTS, fuzzy_edges, keyed_rows, keyed_values, majority_bits
from panelkit.llm.textscan import NOT_SPACE, Words, chunks, mix, run_hashes, text_buffer

WIDTH = 5
SIMILARITY = 0.8
#: Differing bits of 64 that two equal segment indices of three are sure to find.
CANDIDATE_BITS = 5
#: Bands of least hashes and hashes in each: a pair of similarity s shares no band with probability (1 - s**5)**36, 6e-7 at 0.8.
BANDS, BAND_HASHES = 36, 5
#: Differing bits of 128, one of each least hash, up to which texts of one band are candidates: 4.5 deviations over the mean at 0.8.
SKETCH_BITS = 28
#: Texts and shingles of a cluster in one block, about; larger clusters have several.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1 << 20
#: Blocks that one block is made of where texts are sent to all of them, by texts and by shingles, and the least number of those.
WIDE_DOCS, WIDE_SHINGLES, WIDE_LEAST = 8, 3, 8
#: Texts of a block that are compared one by one; texts that are held against a block at once; numbers in what is made of them, and in a block's matrix.
FEW_TEXTS, MET_TEXTS, MET_NUMBERS, HELD_NUMBERS = 128, 256, 1 << 21, 1 << 24
_FACTORS = mix(np.arange(1, BANDS * BAND_HASHES + 1, dtype=np.uint64)) | np.uint64(1)
#: Bytes of a text's signature: its bands, then its sketch.
_SIGNATURE = 8 * BANDS + 16
_NO_ID = (1 << 63) - 1


def _scan(texts: pa.Array) -> Iterator[Words]:
    data, offsets = text_buffer(texts)
    for low, high in chunks(offsets):
        yield Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], NOT_SPACE)


def _sequence(words: Words) -> np.ndarray:
    """128 bits of a cryptographic hash of the words of each text, as two columns."""
    raw, at = words.spaced()
    edges = at[words.first].tolist()
    digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(edges[:-1], edges[1:], strict=True))
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def _shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles, repeats included, and the range of each text."""
    start, size = words.run_starts(width, whole=True)
    return run_hashes(words.hashes(), start, size), np.searchsorted(start, words.first)


def _signatures(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text with shingles the keys of its bands and two numbers of 64 bits, one bit of each of the first 128 least hashes."""
    has = np.flatnonzero(first[1:] > first[:-1])
    at = first[:-1][has]
    out = np.zeros((len(first) - 1, BANDS + 2), np.uint64)
    for k in range(BANDS * BAND_HASHES if len(has) else 0):
        least = np.minimum.reduceat(shingles * _FACTORS[k], at)
        if k % BAND_HASHES == 0:
            out[has, k // BAND_HASHES] = np.uint64(k)
        out[has, k // BAND_HASHES] = mix(out[has, k // BAND_HASHES] ^ least)
        if k < 128:
            # A middle bit of the mixed number: low bits of products are not spread.
            out[has, BANDS + k // 64] |= (mix(least) >> np.uint64(40) & np.uint64(1)) << np.uint64(k % 64)
    return out


def _with_sequence(docs: DataFrame, width: int | None = None) -> DataFrame:
    """All columns of ``docs`` and ``_a``, ``_b``, the word sequence; with ``width`` ``_id`` alone, ``_a``, ``_b``, the number of
    words ``_n``, the fingerprint ``_fp`` and the signature ``_sig``, null where a text has no words."""
    at = docs.columns.index("text")
    kept = [i for i, c in enumerate(docs.columns) if width is None or c == "_id"]
    fields = [docs.schema.fields[i] for i in kept]
    added = [T.StructField(n, T.LongType()) for n in ["_a", "_b"] + ["_n", "_fp"] * (width is not None)]
    added += [T.StructField("_sig", T.BinaryType())] * (width is not None)
    names = [f.name for f in [*fields, *added]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
            sig: list[bytes | None] = []
            for words in _scan(batch.column(at)):
                sequence = _sequence(words)
                made[0].append(sequence[:, 0])
                made[1].append(sequence[:, 1])
                if width is not None:
                    shingles, first = _shingles(words, width)
                    made[2].append(np.diff(words.first))
                    made[3].append(majority_bits(shingles, first).view(np.int64))
                    sig += [s.tobytes() if n else None for s, n in zip(_signatures(shingles, first), np.diff(first), strict=True)]
            columns = [pa.array(np.concatenate(x)) for x in made[: 2 if width is None else 4]]
            columns += [pa.array(sig, pa.binary())] * (width is not None)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *columns], names)

    return docs.mapInArrow(run, T.StructType([*fields, *added]))


def _pair_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of two codeword indices, for each two of the three segments."""
    index, count = zip(*(golay.fuzzy_keys((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)) for low, width in SEGMENTS), strict=True)
    rows, keys = [], []
    for kind, (p, q) in enumerate(((0, 1), (0, 2), (1, 2))):
        for i in range(6):
            for j in range(6):
                at = np.flatnonzero((count[p] > i) & (count[q] > j))
                rows.append(at)
                keys.append((index[p][at, i] << 12 | index[q][at, j] | kind << 24).astype(np.uint64))
    return np.concatenate(rows), np.concatenate(keys)


def _run_links(sketch: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within a run of one band: each text is held against those that no text before it has reached."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        hub, wave, left = left[0], left[:1], left[1:]
        while len(wave) and len(left):
            near = np.bitwise_count(sketch[left] ^ sketch[wave[0]]).sum(1) <= bits
            a.append(np.full(int(near.sum()), fp[hub]))
            b.append(fp[left[near]])
            wave, left = np.concatenate([wave[1:], left[near]]), left[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _band_edges(scanned: DataFrame, rows: int) -> DataFrame:
    """Star edges ``a``, ``b`` between fingerprints of texts that share a band and whose sketches are near; keys travel as blobs by bucket."""
    buckets = shards.buckets_for(rows * BANDS * 32)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = np.flatnonzero(batch.column(1).is_valid())
            if not len(has):
                continue
            sig = np.frombuffer(b"".join(batch.column(1).drop_null().to_pylist()), np.uint64).reshape(-1, BANDS + 2)
            # The same words in several rows of a batch are sent once.
            sig, once = np.unique(sig, axis=0, return_index=True)
            fp = batch.column(0).to_numpy()[has][once].view(np.uint64)
            key = sig[:, :BANDS].T.ravel()
            order = np.argsort(key)
            row = order % len(sig)
            yield keyed_rows(key[order], buckets, fps=fp[row], sketches=sig[row, BANDS:])

    def link(_: int, found: pa.Table) -> Iterator[dict]:
        key, fp, sketch = keyed_values(found, "fps", "sketches")
        order = np.argsort(key)
        key, fp, sketch = key[order], fp[order], sketch.reshape(-1, 2)[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        pairs = [np.zeros((2, 0), np.uint64)]
        # Most runs are of two texts: those are compared all at once.
        two = start[size == 2]
        near = two[np.bitwise_count(sketch[two] ^ sketch[two + 1]).sum(1) <= SKETCH_BITS]
        pairs.append(np.stack([fp[near], fp[near + 1]]))
        for at, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            pairs.append(np.stack(_run_links(sketch[at : at + n], fp[at : at + n], SKETCH_BITS)))
        a, b = graph.stars(*np.concatenate(pairs, axis=1))
        if len(a):
            yield {"a": a.view(np.int64), "b": b.view(np.int64)}

    keys = scanned.select("_fp", "_sig").mapInArrow(emit, "bucket int, size bigint, keys binary, fps binary, sketches binary")
    return shards.each_bucket(keys, link, "a bigint, b bigint").distinct()


class _Sets:
    """Sets of numbers, and how many of one are in each of some others."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.similarity = similarity
        self.size = np.array([len(s) for s in sets], np.int64)
        self.edge = np.concatenate([[0], np.cumsum(self.size)])
        # Numbers as small ones, so that a set is a mask.
        self.every = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)[1]
        self.mask = np.zeros(int(self.every.max(initial=-1)) + 1, bool)

    def near(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` have ``similarity`` or more with the set ``one``; places in ``others``."""
        # The sizes bound the similarity, most of the rest is not counted at all.
        able = (np.minimum(self.size[others], self.size[one]) >= self.similarity * np.maximum(self.size[others], self.size[one])).nonzero()[0]
        if not len(able):
            return able
        own = self.every[self.edge[one] : self.edge[one + 1]]
        self.mask[own] = True
        length = self.size[others[able]]
        before = np.concatenate([[0], np.cumsum(length)[:-1]])
        at = np.repeat(self.edge[others[able]] - before, length) + np.arange(length.sum())
        common = np.add.reduceat(self.mask[self.every[at]].astype(np.int64), before) if len(at) else length
        self.mask[own] = False
        return able[common >= self.similarity * (length + self.size[one] - common)]


def _own_edges(node: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Star edges of the components of some texts; each is held against those not reached yet."""
    held, left = _Sets(sets, similarity), np.arange(len(sets))
    a, b = [], []
    while len(left):
        hub, wave, left = int(left[0]), [int(left[0])], left[1:]
        while wave and len(left):
            near = held.near(wave.pop(), left)
            reached = left[near]
            a += [int(node[hub])] * len(reached)
            b += node[reached].tolist()
            wave += reached.tolist()
            left = np.delete(left, near)
    return a, b


class _Held:
    """The texts of a block, and which of them are similar to others: shingles of many texts are counted by a matrix product, the others by lists of their texts."""

    def __init__(self, node: list[int], sets: list[np.ndarray], similarity: float):
        self.similarity = similarity
        self.node = np.array(node, np.int64)
        self.size = np.array([len(s) for s in sets], np.int64)
        self.known, at, self.count = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
        text = np.repeat(np.arange(len(sets)), self.size)
        # Columns of shingles that a sixteenth of the texts have, the most frequent ones as far as the room goes.
        often = np.flatnonzero(self.count > max(32, len(sets) // 16))
        often = often[np.argsort(-self.count[often], kind="stable")[: HELD_NUMBERS // max(1, len(sets))]]
        self.column = np.full(len(self.known), -1, np.int64)
        self.column[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), len(sets)), np.float32)
        column = self.column[at]
        self.dense[column[column >= 0], text[column >= 0]] = 1
        self.listed = text[np.argsort(at, kind="stable")].astype(np.int32)
        self.start = np.cumsum(self.count) - self.count
        self.edges: list[np.ndarray] = []

    def meet(self, node: list[int], sets: list[np.ndarray]) -> None:
        """Takes up edges whose components are those of all similar pairs of these texts and the block's."""
        size = np.array([len(s) for s in sets], np.int64)
        row = np.repeat(np.arange(len(sets)), size)
        every = np.concatenate([np.zeros(0, np.uint64), *sets])
        at = np.minimum(np.searchsorted(self.known, every), max(0, len(self.known) - 1))
        found = self.known[at] == every if len(self.known) else np.zeros(len(every), bool)
        at, row = at[found], row[found]
        rare = self.column[at] < 0
        work = np.cumsum(np.bincount(row[rare], self.count[at[rare]], len(sets)))
        low = 0
        while low < len(sets):
            high = int(np.searchsorted(work, (work[low - 1] if low else 0) + MET_NUMBERS, "right"))
            high = min(len(sets), max(low + 1, high), low + MET_TEXTS)
            part = slice(*np.searchsorted(row, [low, high]))
            self._meet(np.array(node[low:high], np.int64), size[low:high], at[part], row[part] - low)
            low = high

    def _meet(self, node: np.ndarray, size: np.ndarray, at: np.ndarray, row: np.ndarray) -> None:
        n, rare = len(self.node), self.column[at] < 0
        held = np.zeros((len(node), len(self.dense)), np.float32)
        held[row[~rare], self.column[at[~rare]]] = 1
        common = held @ self.dense
        length = self.count[at[rare]]
        places = np.repeat(self.start[at[rare]] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        common += np.bincount(np.repeat(row[rare] * n, length) + self.listed[places], minlength=common.size).reshape(common.shape)
        # A bound that rounding can't miss, then the pairs that are within it.
        least = self.similarity / (1 + self.similarity)
        x, y = np.nonzero(common >= (least * size).astype(np.float32)[:, None] + (least * self.size - 0.5).astype(np.float32))
        both = common[x, y].astype(np.int64)
        similar = both >= self.similarity * (self.size[y] + size[x] - both)
        near = np.zeros(common.shape, np.float32)
        near[x[similar], y[similar]] = 1
        # Each text of the block with the first that it is similar to, and those that have one of the block in common.
        met = np.flatnonzero(near.any(0))
        p, q = np.nonzero(np.triu(near @ near.T, 1))
        a, b = np.concatenate([node[near[:, met].argmax(0)], node[p]]), np.concatenate([self.node[met], node[q]])
        self.edges.append(np.stack(graph.stars(a, b)))
        if sum(e.shape[1] for e in self.edges) > MET_NUMBERS // 16:
            self.edges = [np.stack(graph.stars(*np.concatenate(self.edges, axis=1)))]

    def linked(self) -> tuple[np.ndarray, np.ndarray]:
        """Star edges of all that was taken up."""
        return graph.stars(*np.concatenate([np.zeros((2, 0), np.int64), *self.edges], axis=1))


def _block_edges(rows: DataFrame, width: int, similarity: float, cross: bool = False) -> DataFrame:
    """Edges ``a``, ``b`` within the texts of each ``cluster`` and ``block``, or with ``cross`` of those that are ``sent`` with the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, last = None, None, None
        node: list[int] = []
        sets: list[np.ndarray] = []

        def clear() -> None:
            nonlocal node, sets
            node, sets = [], []

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not cross and 1 < len(node) <= FEW_TEXTS:
                a, b = _own_edges(np.array(node), sets, similarity)
            elif held is None and (cross or len(node) < 2):
                a, b = [], []
            else:
                held = held or _Held(node, sets, similarity)
                held.meet(node, sets)
                a, b = held.linked()
            held = None
            clear()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            groups, nodes, marks = zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            made = []
            for words in _scan(batch.column(4)):
                shingles, first = _shingles(words, width)
                made += [np.unique(shingles[x:y]) for x, y in zip(first[:-1], first[1:], strict=True)]
            for key, n, s, found in zip(groups, nodes, marks, made, strict=True):
                if key != current:
                    yield from done()
                    current, last = key, None
                # Rows of one id and one text are one node.
                if last == (n, s):
                    continue
                last = n, s
                if s and held is None:
                    held = _Held(node, sets, similarity)
                    clear()
                elif s and len(node) >= MET_TEXTS:
                    # What is sent is not held: of a large cluster it may be most texts.
                    held.meet(node, sets)
                    clear()
                node.append(n)
                sets.append(found)
        yield from done()

    ordered = rows.select("cluster", "block", "node", "sent", "text").repartition("cluster", "block").sortWithinPartitions("cluster", "block", "sent", "node")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def _texts(rows: DataFrame, members: DataFrame, repeated: bool) -> DataFrame:
    """``node``, ``cluster``, ``n_blocks``, ``n_wide`` and ``text`` of the rows that are members, by id and words; where rows are ``repeated``, of one of each."""
    found = _with_sequence(rows).join(members, ["_id", "_a", "_b"]).select("node", "cluster", "n_blocks", "n_wide", "text")
    return found.dropDuplicates(["node"]) if repeated else found


def _verified(rows: DataFrame, members: DataFrame, repeated: bool, width: int, similarity: float) -> DataFrame:
    """Edges between members (``_id, _a, _b, node, cluster, n_blocks, n_wide``) whose components are those of all similar pairs of a cluster."""

    def placed(some: DataFrame) -> DataFrame:
        return _texts(rows, some, repeated).withColumns({"block": F.pmod(F.xxhash64("node"), F.col("n_blocks")), "sent": F.lit(False)})

    edges = pinned(_block_edges(placed(members.where("n_blocks = 1")), width, similarity))
    large = members.where("n_blocks > 1")
    if large.isEmpty():
        return edges
    big = pinned(placed(large))

    def across(senders: DataFrame) -> DataFrame:
        """``senders`` (``node``) against all texts of their clusters, in fewer blocks, as each gets them all."""
        own = big.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_wide")))
        sent = big.join(senders, "node", "left_semi").withColumns({"block": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_wide") - 1)), "sent": F.lit(True)})
        return pinned(_block_edges(own.unionByName(sent), width, similarity, True))

    # Within blocks, then one text of each group of a block: mostly that makes the groups of a cluster one.
    own = pinned(_block_edges(big, width, similarity))
    own = own.unionByName(across(own.select(F.col("a").alias("node")).distinct()))
    named = pinned(graph.components(own))
    grouped = large.select("node", "cluster").join(named, "node", "left").withColumn("root", F.coalesce("root", "node"))
    largest = grouped.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
    # Of two similar texts in different groups one is outside the largest.
    rest = across(grouped.join(largest, "cluster").where("root <> largest").select("node"))
    return edges.unionByName(own).unionByName(rest)


def components(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, bits: int = CANDIDATE_BITS) -> DataFrame:
    """``_id``, ``_a``, ``_b``, ``kept`` and ``n_rows``: the distinct documents, whether each is the one of its group that stays, and its rows.

    The one that stays has the smallest ``doc_id`` (a null is greater than any), then the smallest sequence hash.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("_id"), "text")
    scanned = pinned(_with_sequence(rows, width))
    total = scanned.count()
    seen = pinned(scanned.groupBy("_id", "_a", "_b").agg(F.count("*").alias("n_rows"), F.first("_n").alias("n"), F.first("_fp").alias("fp")), total)
    # One node for each word sequence. Numbers are given once, as the table is written.
    grouped = seen.groupBy("_a", "_b").agg(F.min("_id").alias("least"), F.first("fp").alias("fp"), F.first("n").alias("n"))
    nodes = pinned(grouped.withColumn("node", F.monotonically_increasing_id()), total)
    count = nodes.count()
    near = fuzzy_edges(pinned(nodes.select("fp").distinct(), count), _pair_keys, 85, bits)
    stars = graph.components(near.unionByName(_band_edges(scanned, count)))
    clusters = stars.withColumnRenamed("node", "fp").withColumnRenamed("root", "cluster")
    # All nodes of one fingerprint are of one cluster, which has its own number where nothing else is linked to it.
    clusters = pinned(nodes.join(clusters, "fp", "left").withColumn("cluster", F.coalesce("cluster", "fp")), count)
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("k"), F.sum("n").alias("words")).where("k > 1")
    n_blocks = F.ceil(F.greatest(F.col("k") / BLOCK_DOCS, F.col("words") / BLOCK_SHINGLES))
    n_wide = F.ceil(F.greatest(F.col("k") / (BLOCK_DOCS * WIDE_DOCS), F.col("words") / (BLOCK_SHINGLES * WIDE_SHINGLES), F.lit(WIDE_LEAST)))
    # Written before the join, so that the join is all there is after its exchanges, and a large cluster can be split.
    n_blocks = F.greatest(F.least(n_blocks, "k"), F.lit(1)).cast("bigint")
    sizes = pinned(sizes.select("cluster", n_blocks.alias("n_blocks"), F.least(n_wide, n_blocks).cast("bigint").alias("n_wide")), count)
    members = pinned(clusters.join(sizes, "cluster").select(F.col("least").alias("_id"), "_a", "_b", "node", "cluster", "n_blocks", "n_wide"), count)
    repeated = not seen.where("n_rows > 1").isEmpty()
    linked = graph.components(_verified(rows, members, repeated, width, similarity)).withColumnRenamed("root", "group")
    grouped = nodes.join(linked, "node", "left").withColumn("group", F.coalesce("group", "node"))
    first = grouped.groupBy("group").agg(F.min(F.struct("least", "_a", "_b")).alias("stays"))
    named = grouped.join(first, "group").select("_a", "_b", "stays")
    stays = F.col("stays")
    kept = (F.col("_id") == stays["least"]) & (F.col("_a") == stays["_a"]) & (F.col("_b") == stays["_b"])
    return seen.join(named, ["_a", "_b"]).select("_id", "_a", "_b", kept.alias("kept"), "n_rows")


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, bits: int = CANDIDATE_BITS) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one of the smallest ``doc_id``; columns unchanged.

    Groups are linked by ``similarity`` or more of the sets of ``width``-word shingles of lower-cased words; a shorter text
    is one shingle, texts without words are one group. A null ``doc_id`` is greater than any; of repeated rows one stays.
    """
    found = pinned(components(docs, width, similarity, bits))
    gone = found.where("NOT kept").select("_id", "_a", "_b")
    given = boxed(docs, "doc_id", "text").withColumn("_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)))
    left = _with_sequence(given).join(gone, ["_id", "_a", "_b"], "left_anti")
    repeated = found.where("kept AND n_rows > 1").select("_id", "_a", "_b")
    if not repeated.isEmpty():
        left = left.join(repeated, ["_id", "_a", "_b"], "left_anti").unionByName(
            left.join(repeated, ["_id", "_a", "_b"], "left_semi").dropDuplicates(["_id", "_a", "_b"])
        )
    return unboxed(left, docs.columns, "doc_id", "text")
