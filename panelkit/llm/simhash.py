"""SimHash near-duplicates over Golay-code fuzzy keys.

Fingerprints are made map-side, exact repeats collapse in a partial aggregate,
and only distinct fingerprints get keys. A 64-bit fingerprint is cut into
segments of 23, 23 and 18 bits. At most four errors leave either every segment
with two or fewer (a key of three codeword indices), or one segment with three
or more and then at most one error in the other two (a key of one exact segment
and the other's codeword index, both ways round). Sorted key runs give star
edges, never all pairs; components are found by alternating stars.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm import golay, graph, shards
from panelkit.llm.shared import pinned
from panelkit.llm.textscan import NOT_SPACE, Words, chunks, mix, text_buffer

SEGMENTS = ((0, 23), (23, 23), (46, 18))
MAX_BITS = 4
#: Runs of up to this many fingerprints are compared by lag, longer ones by search.
SHORT_RUN = 8
#: Fingerprints whose keys are made and packed together.
KEYED_ROWS = 4_096
#: Fingerprints dealt to a task that makes keys.
SPREAD_ROWS = 8_192


def shingle_hashes(texts: pa.Array, width: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each chunk of texts: XXH64 of every ``width``-word shingle of the lower-cased words, and the shingle range of each text."""
    data, offsets = text_buffer(texts)
    digest = xxhash.xxh64_intdigest
    for low, high in chunks(offsets):
        words = Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], NOT_SPACE)
        raw, at = words.spaced()
        start, count = words.run_starts(width, whole=True)
        pairs = zip(at[start].tolist(), (at[start + count] - 1).tolist(), strict=True)
        hashes = np.fromiter((digest(raw[a:b], seed) for a, b in pairs), np.uint64, len(start))
        yield hashes, np.searchsorted(start, words.first)


def majority_bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit fingerprints: a bit is set if more than half of the hashes of the range have it; an empty range gives zero."""
    n = len(first) - 1
    out = np.zeros(n, np.uint64)
    for low in range(0, n):
        # Ranges differ in length by orders of magnitude; eight byte-wide counters at a time add up blocks of 255.
        part = hashes[first[low] : first[low + 1]]
        if len(part) == 0:
            continue
        edges = np.arange(0, len(part), 255)
        counts = np.zeros(64, np.int64)
        for bit in range(8):
            lanes = np.add.reduceat((part >> np.uint64(bit)) & np.uint64(0x0101010101010101), edges)
            counts[bit::8] = lanes.view(np.uint8).reshape(-1, 8).sum(0)
        bits = np.flatnonzero(2 * counts > len(part)).astype(np.uint64)
        out[low] = np.bitwise_or.reduce(np.uint64(1) << bits) if len(bits) else 0
    return out


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = 4, seed: int = 42) -> DataFrame:
    """``keep`` columns and ``fp``, the 64-bit SimHash of the text as a signed long. A null or wordless text has 0."""
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", fp bigint"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority_bits(h, first) for h, first in shingle_hashes(batch.column(0), width, seed)]
            fp = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp)], [*(f.name for f in fields), "fp"])

    return docs.select(F.col(text), *(F.col(f.name) for f in fields)).mapInArrow(scan, schema)


def key_columns(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All fuzzy keys of some fingerprints: row numbers, and keys that two fingerprints at four or fewer differing bits share."""
    parts, index, count = [], [], []
    for low, width in SEGMENTS:
        part = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
        keys, n = golay.fuzzy_keys(part)
        parts.append(part)
        index.append(keys.astype(np.uint64))
        count.append(n)
    rows, keys = [], []

    def put(mask: np.ndarray, key: np.ndarray, kind: int) -> None:
        at = np.flatnonzero(mask)
        rows.append(at)
        keys.append(key[at] | np.uint64(kind << 60))

    for i in range(6):
        for j in range(6):
            for k in range(6):
                mask = (count[0] > i) & (count[1] > j) & (count[2] > k)
                put(mask, index[0][:, i] << np.uint64(24) | index[1][:, j] << np.uint64(12) | index[2][:, k], 0)
    kind = 1
    for exact in range(3):
        for fuzzy in range(3):
            if exact != fuzzy:
                for i in range(6):
                    put(count[fuzzy] > i, parts[exact] << np.uint64(12) | index[fuzzy][:, i], kind)
                kind += 1
    return np.concatenate(rows), np.concatenate(keys)


def _short_run_edges(key: np.ndarray, fp: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for lag in range(1, SHORT_RUN):
        if len(key) <= lag:
            return
        same = np.flatnonzero(key[lag:] == key[:-lag])
        if len(same) == 0:
            return
        near = same[np.bitwise_count(fp[same + lag] ^ fp[same]) <= bits]
        yield fp[near], fp[near + lag]


def _long_run_edges(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the components within one run; each fingerprint is compared only with those not reached so far."""
    left, source, target = np.unique(fp), [], []
    while len(left):
        hub, wave, left = left[0], left[:1], left[1:]
        while len(wave) and len(left):
            near = np.bitwise_count(left ^ wave[0]) <= bits
            reached = left[near]
            source.append(np.full(len(reached), hub))
            target.append(reached)
            wave, left = np.concatenate([wave[1:], reached]), left[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *source]), np.concatenate([none, *target])


def run_edges(key: np.ndarray, fp: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of at most ``bits`` differing bits within the runs of key-sorted fingerprints; star edges for long runs."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    short = np.repeat((size > 1) & (size <= SHORT_RUN), size)
    yield from _short_run_edges(key[short], fp[short], bits)
    for at in np.flatnonzero(size > SHORT_RUN):
        yield _long_run_edges(fp[start[at] : start[at] + size[at]], bits)


def keyed_rows(key: np.ndarray, buckets: int, **values: np.ndarray) -> pa.RecordBatch:
    """Keys and what goes with them, in order of the keys, as one row of blobs for each bucket."""
    edges = shards.split_sorted(key, buckets)
    full = np.flatnonzero(np.diff(edges))
    parts = [slice(edges[b], edges[b + 1]) for b in full]
    columns = [pa.array(full.astype(np.int32)), pa.array([p.stop - p.start for p in parts], pa.int64()), pa.array([shards.pack_sorted(key[p]) for p in parts], pa.binary())]
    columns += [pa.array([np.ascontiguousarray(v[p]).tobytes() for p in parts], pa.binary()) for v in values.values()]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "size", "keys", *values])


def keyed_values(rows: pa.Table, *names: str) -> list[np.ndarray]:
    """The keys of a bucket and the values of some columns of 64-bit numbers, in order of rows."""
    size = rows.column("size").to_pylist()
    key = np.concatenate([shards.unpack_sorted(k.as_py(), n) for k, n in zip(rows.column("keys"), size, strict=True)])
    return [key, *(np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint64) for c in names)]


def spread(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` dealt out evenly, some thousand to a task, before each of them is made into many keys."""
    return rows.repartition(max(1, min(-(-count // SPREAD_ROWS), 1 << 16)))


def fuzzy_edges(distinct: DataFrame, keys_of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], per_row: int, bits: int) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints ``fp`` that share a key of ``keys_of`` and differ in ``bits`` or fewer.

    Keys travel as blobs, one row for each bucket of a few thousand fingerprints; ``per_row`` is about how many keys one has.
    A bucket gives the components of what it links as star edges.
    """
    count = distinct.count()
    buckets = shards.buckets_for(count * per_row * 16)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for low in range(0, len(every), KEYED_ROWS):
                fp = every[low : low + KEYED_ROWS]
                row, key = keys_of(fp)
                key = mix(key)
                order = np.argsort(key)
                yield keyed_rows(key[order], buckets, fps=fp[row[order]])

    def link(_: int, rows: pa.Table) -> Iterator[dict]:
        key, fp = keyed_values(rows, "fps")
        order = np.argsort(key)
        key, fp = key[order], fp[order]
        # A key of one fingerprint, as most are, links nothing.
        again = key[1:] == key[:-1]
        keep = np.concatenate([again, [False]]) | np.concatenate([[False], again])
        pairs = [np.stack(x) for x in run_edges(key[keep], fp[keep], bits)]
        if pairs and (found := np.concatenate(pairs, axis=1)).size:
            a, b = graph.stars(*found)
            yield {"a": a.view(np.int64), "b": b.view(np.int64)}

    keys = spread(distinct.select("fp"), count).mapInArrow(emit, "bucket int, size bigint, keys binary, fps binary")
    return shards.each_bucket(keys, link, "a bigint, b bigint").distinct()


def fingerprint_edges(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Edges ``a``, ``b`` whose components are those of all pairs of fingerprints within ``bits`` (at most four) differing bits."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the keys find pairs of at most {MAX_BITS} differing bits")
    return fuzzy_edges(distinct, key_columns, 185, bits)


def near_duplicate_components(docs: DataFrame, bits: int = MAX_BITS, width: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 lowercase hex digits) and ``component_id``, the smallest ``doc_id`` reachable over
    links of fingerprints at ``bits`` or fewer differing bits.

    Null and wordless texts have the fingerprint 0 and are linked like any other. A null ``doc_id`` keeps its row and
    never names a component that has another id. Repeated rows stay; other columns are ignored.
    """
    rows = pinned(fingerprints(docs, width=width, seed=seed))
    distinct = pinned(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), rows.count())
    stars = graph.components(fingerprint_edges(distinct, bits))
    rooted = distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
