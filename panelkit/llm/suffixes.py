"""Removal of repeated byte strings by distributed prefix doubling.

Two exact steps make the work smaller first. A sieve: the least hash of the short
substrings of a window is the same in equal windows, so windows whose least hash
no other document has are unique and leave. Then stretches of the windows that
remain are cut into chunks where their content says so; of equal chunks (with the
bytes that their last windows reach) only those of the smallest document are
ranked, as all windows of the others also start there.

The positions of these get ranks of their 8-byte prefixes, and rounds at offsets
8, 16 and 18 sort pairs of ranks and rerank them for prefixes of 16, 32 and 50
bytes. A position leaves as soon as its prefix occurs once. Pairs travel packed,
one row for each shard and bucket, each distinct pair of a shard once. Buckets are
chosen by the least hash within the prefix and ranks are given in order of
appearance, so that neighbours mostly stay neighbours and pack well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm import shards as S
from panelkit.llm.shared import pinned, release
from panelkit.llm.textscan import inverse_powers, mix, powers

LENGTH = 50
#: Bytes of the substrings that the sieve hashes, and low bits of the hashes that are left out.
SIEVE = 26
_SIEVE_MASK = np.uint64(2**64 - 2**16)
#: A chunk ends where the hash of this many bytes is a multiple of the next number, on average after so many windows; at the third at most.
CUT_BYTES, CUT_MEAN, CUT_MOST = 16, 64, 512
#: Positions that are hashed together.
_BLOCK = 1 << 16
_NONE = np.iinfo(np.int64).max
_RANKED = 40


def rounds_for(length: int) -> list[int]:
    """Offsets that take prefixes from 8 bytes to ``length``: each at most the length so far."""
    if length < 16:
        raise ValueError("strings of 16 bytes or more")
    offsets, have = [], 8
    while have < length:
        offsets.append(min(have, length - have))
        have += offsets[-1]
    return offsets


def _least_hashes(data: np.ndarray, length: int, part: int) -> np.ndarray:
    """For each position the least hash of the ``part``-byte substrings of the ``length`` bytes from there."""
    n = len(data) - length + 1
    out = np.zeros(max(n, 0), np.uint64)
    for at in range(0, n, _BLOCK):
        own = data[at : at + _BLOCK + length - 1]
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum((own.astype(np.uint64) + np.uint64(1)) * powers(len(own)), out=sums[1:])
        low = mix((sums[part:] - sums[:-part]) * inverse_powers(len(own) + 1)[: len(sums) - part])
        width, have = length - part + 1, 1
        while have < width:
            step = min(have, width - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        out[at : at + _BLOCK] = low
    return out


def _windows(offsets: np.ndarray, length: int) -> np.ndarray:
    """Whether a window of ``length`` bytes within one text starts at each byte."""
    edge = np.zeros(int(offsets[-1]) + 1, np.int32)
    size = np.diff(offsets)
    long = np.flatnonzero(size >= length)
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - length + 1, -1)
    return np.cumsum(edge)[:-1] > 0


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    n = len(columns[0])
    head = np.zeros(n, bool)
    head[:1] = True
    for c in columns:
        head[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(head)


def _sizes(heads: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(heads, n))


class _Sieve:
    """The windows of a shard and their least hashes; sent once per distinct hash."""

    def __init__(self, blob: bytes, length: int, sieve: int):
        self.keys, self.data, self.offsets = S.open_shard(blob)
        self.at = np.flatnonzero(_windows(self.offsets, length))
        values = _least_hashes(self.data, length, sieve)[self.at] & _SIEVE_MASK if len(self.at) else np.zeros(0, np.uint64)
        self.owner = np.searchsorted(self.offsets, self.at, "right") - 1
        # Neighbouring windows mostly share their least hash: runs of it are sorted, not windows.
        heads = _heads(values, self.owner)
        self.run = np.repeat(np.arange(len(heads)), _sizes(heads, len(values)))
        values, owner = values[heads], self.owner[heads]
        order = np.argsort(values, kind="stable")
        ranked, own = values[order], owner[order]
        start = _heads(ranked)
        self.values = ranked[start]
        self.place = np.empty(len(values), np.int64)
        self.place[order] = np.repeat(np.arange(len(start)), _sizes(start, len(values)))
        self.shared = np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start) if len(start) else np.zeros(0, bool)


def _listed(edges: np.ndarray, **columns) -> dict[str, list]:
    """A row for each bucket that has values; ``columns`` make a value from the bucket's number and its slice."""
    rows: dict[str, list] = {k: [] for k in columns}
    for b in np.flatnonzero(np.diff(edges)).tolist():
        part = slice(int(edges[b]), int(edges[b + 1]))
        for k, make in columns.items():
            rows[k].append(make(b, part))
    return rows


def _bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(S.inflate(blob, -(-n // 8), np.uint8))[:n].astype(bool)


def _pack_bits(values: np.ndarray) -> bytes:
    return S.deflate(np.packbits(values))


def _residuals(values: np.ndarray, kind: str) -> np.ndarray:
    """What is left of each number after a guess from the one before: the next number (``rank``), or the same."""
    out = values.astype(np.uint64)
    out[1:] -= out[:-1].copy() + np.uint64(kind == "rank")
    return out


def _restored(x: np.ndarray, kind: str) -> np.ndarray:
    out = np.cumsum(x, dtype=np.uint64)
    return out + np.arange(len(x), dtype=np.uint64) if kind == "rank" else out


def _pack(values: np.ndarray, kind: str) -> bytes:
    """Numbers in compressed byte planes of what a guess leaves."""
    return S.deflate(_residuals(values, kind).astype(">u8").view(np.uint8).reshape(-1, 8).T)


def _unpack(blob: bytes, n: int, kind: str) -> np.ndarray:
    planes = S.inflate(blob, n * 8, np.uint8).reshape(8, n)
    return _restored(np.ascontiguousarray(planes.T).view(">u8").ravel().astype(np.uint64), kind)


def _pack_text(data: np.ndarray, at: np.ndarray, length: int) -> bytes:
    """The ``length`` bytes from each of some positions; neighbours are one run of text."""
    head = _heads(at - np.arange(len(at)))
    size = _sizes(head, len(at))
    whole = size + length - 1
    before = np.cumsum(whole) - whole
    text = data[np.repeat(at[head] - before, whole) + np.arange(whole.sum())]
    sizes = size.astype(">u4").view(np.uint8).reshape(-1, 4).T
    return np.array([len(size), len(text)], np.int64).tobytes() + S.deflate(np.concatenate([sizes.ravel(), text]))


def _unpack_text(blob: bytes) -> np.ndarray:
    """The first and the second eight bytes of each position as numbers, two columns."""
    n, total = np.frombuffer(blob[:16], np.int64).tolist()
    found = S.inflate(blob[16:], 4 * n + total, np.uint8)
    size = np.ascontiguousarray(found[: 4 * n].reshape(4, n).T).view(">u4").ravel().astype(np.int64)
    value = _eights(found[4 * n :])
    whole = size + 15
    base = np.cumsum(whole) - whole
    at = np.repeat(base - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return np.stack([value[at], value[at + 8]])


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number; eight zero bytes are the greatest one, as zero stands for no rank."""
    if len(data) < 8:
        return np.zeros(0, np.uint64)
    value = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(">u8").ravel().astype(np.uint64)
    value[value == 0] = np.uint64(2**64 - 1)
    return value


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _gathered(rows: pa.Table, name: str, read, *rest) -> np.ndarray:
    """A column of blobs of all rows, one after the other."""
    size = rows.column("size").to_pylist()
    return np.concatenate([read(v.as_py(), n, *rest) for v, n in zip(rows.column(name), size, strict=True)])


def _answers(bucket: int, rows: pa.Table, values: np.ndarray, pack, **more) -> dict:
    size = _column(rows, "size")
    edges = np.concatenate([[0], np.cumsum(size)])
    return {
        "shard": _column(rows, "shard"),
        "bucket": np.full(len(size), bucket),
        "size": size,
        "answer": [pack(values[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)],
    } | more


_ANSWER = "shard bigint, bucket int, size bigint, answer binary"


def _answer_sieve(bucket: int, rows: pa.Table) -> Iterator[dict]:
    """Whether each hash comes from several documents."""
    every, marks = _gathered(rows, "values", S.unpack_sorted), _gathered(rows, "shared", _bits)
    order = np.argsort(every)
    start = _heads(every[order])
    count = _sizes(start, len(every))
    good = np.empty(len(every), bool)
    good[order] = np.repeat((count > 1) | np.logical_or.reduceat(marks[order], start), count)
    yield _answers(bucket, rows, good, _pack_bits)


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", S.LEVEL))) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.BufferReader(blob)).read_all().combine_chunks()


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of some strings one after the other and their n+1 offsets."""
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


def _stretches(found: _Sieve, good: np.ndarray, length: int) -> bytes:
    """The maximal byte stretches of neighbouring windows that are left: ``row``, ``key``, ``start`` and ``bytes``."""
    at = found.at[good[found.place][found.run]] if len(found.at) else found.at
    owner = np.searchsorted(found.offsets, at, "right") - 1
    head = _heads(at - np.arange(len(at)), owner)
    start = at[head]
    stop = start + _sizes(head, len(at)) + length - 1
    row = owner[head]
    raw = found.data.tobytes()
    # A document without an id is greater than any.
    keys = found.keys.cast(pa.int64()).fill_null(_NONE).to_numpy()
    pieces = pa.array([raw[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)], pa.large_binary())
    return _stream(pa.table({"row": row, "key": keys[row], "start": start - found.offsets[row], "bytes": pieces}))


class _Chunks:
    """The windows of a shard's stretches in chunks cut by content; equal chunks are one, of the smallest key that has it."""

    def __init__(self, blob: bytes, length: int):
        table = _read(blob)
        self.row, self.start = table.column("row").to_numpy(), table.column("start").to_numpy()
        self.data, self.offsets = _joined(table.column("bytes").to_pylist())
        at = np.flatnonzero(_windows(self.offsets, length))
        owner = np.searchsorted(self.offsets, at, "right") - 1
        head = np.zeros(len(at), bool)
        head[_heads(owner)] = True
        head |= _least_hashes(self.data, CUT_BYTES, CUT_BYTES)[at] % np.uint64(CUT_MEAN) == 0 if len(at) else head
        place = np.arange(len(at))
        head |= (place - np.maximum.accumulate(np.where(head, place, 0))) % CUT_MOST == 0
        heads = np.flatnonzero(head)
        self.first, self.size, self.owner = at[heads], _sizes(heads, len(at)), owner[heads]
        self.key = table.column("key").to_numpy()[self.owner]
        raw = self.data.tobytes()
        stop = self.first + self.size + length - 1
        digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(self.first.tolist(), stop.tolist(), strict=True))
        high, low = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
        order = np.lexsort((self.key, low, high))
        start = _heads(high[order], low[order])
        self.best = order[start]
        self.high, self.low, self.least = high[self.best], low[self.best], self.key[self.best]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.repeat(np.arange(len(start)), _sizes(start, len(order)))


def _answer_chunks(bucket: int, rows: pa.Table) -> Iterator[dict]:
    """Whether each chunk is in a document of a smaller key than any of the asking shard."""
    high, low, least = _gathered(rows, "high", S.unpack_sorted), _gathered(rows, "low", _unpack, "same"), _gathered(rows, "least", _unpack, "same").view(np.int64)
    order = np.lexsort((low, high))
    start = _heads(high[order], low[order])
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(least[order], start), _sizes(start, len(order)))
    yield _answers(bucket, rows, out < least, _pack_bits)


def _collapsed(found: _Chunks, gone: np.ndarray, length: int) -> tuple[bytes, bytes, int]:
    """What is to be ranked (``key`` and ``bytes`` of pieces), all chunks (``row``, ``key``, ``start``, ``size`` and ``at``, where among the
    ranked bytes the windows of the chunk are, or -1 where all of them also start in a smaller document), and how many bytes."""
    kept = np.sort(found.best[~gone])
    first, size, owner = found.first[kept], found.size[kept], found.owner[kept]
    # Neighbouring chunks are one piece.
    apart = np.ones(len(kept), bool)
    apart[1:] = (first[1:] != first[:-1] + size[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(apart)
    start = first[head]
    stop = (first + size)[np.append(head[1:], len(kept)) - 1] + length - 1 if len(kept) else start
    raw = found.data.tobytes()
    texts = [raw[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
    base = np.concatenate([[0], np.cumsum(stop - start)])
    piece = np.cumsum(apart) - 1
    at = np.full(len(found.first), -1, np.int64)
    at[kept] = base[piece] + first - start[piece] if len(kept) else at[kept]
    ranked = np.where(gone[found.place] | (found.key > found.least[found.place]), -1, at[found.best[found.place]]) if len(at) else at
    pieces = pa.table({"key": found.key[kept][head], "bytes": pa.array(texts, pa.large_binary())})
    chunks = {"row": found.row[found.owner], "key": found.key, "start": found.start[found.owner] + found.first - found.offsets[found.owner], "size": found.size, "at": ranked}
    return _stream(pieces), _stream(pa.table(chunks)), int(base[-1])


class _Ranks:
    """Ranks of the prefixes of a shard's pieces, taken on round by round with the answers to the pairs it sent."""

    def __init__(self, blob: bytes, buckets: int):
        table = _read(blob)
        self.buckets, self.key = buckets, table.column("key").to_numpy()
        self.data, self.offsets = _joined(table.column("bytes").to_pylist())
        self.owner = np.repeat(np.arange(len(self.key)), np.diff(self.offsets))
        self.have = 8
        self.rank = np.zeros(len(self.data), np.uint64)
        value = _eights(self.data)
        self.rank[: len(value)] = np.where(_windows(self.offsets, 8)[: len(value)], value, np.uint64(0))

    def pairs(self, offset: int) -> None:
        """Distinct pairs of ranks at ``offset``, by bucket and in order of appearance."""
        self.have += offset
        later = np.zeros_like(self.rank)
        if offset < len(self.rank):
            later[:-offset] = np.where(self.owner[:-offset] == self.owner[offset:], self.rank[offset:], np.uint64(0))
        self.at = np.flatnonzero((self.rank > 0) & (later > 0))
        a, b = self.rank[self.at], later[self.at]
        value = mix(a ^ mix(b))
        self.order = np.argsort(value)
        start = _heads(value[self.order])
        own_a, own_b = a[self.order], b[self.order]
        if len(_heads(own_a, own_b)) != len(start):
            # Different pairs of one hash: sort by the pairs themselves.
            self.order = np.lexsort((b, a))
            own_a, own_b = a[self.order], b[self.order]
            start = _heads(own_a, own_b)
        self.start, count = start, _sizes(start, len(a))
        first = np.minimum.reduceat(self.order, start) if len(start) else start
        least = _least_hashes(self.data, self.have, self.have * 5 // 8)[self.at[first]] if len(first) else np.zeros(0, np.uint64)
        bucket = mix(least) >> np.uint64(64 - int(self.buckets).bit_length() + 1)
        bucket = bucket.astype(np.uint16 if self.buckets <= 1 << 16 else np.int64)
        by_place = np.argsort(first)
        listed = by_place[np.argsort(bucket[by_place], kind="stable")]
        new = np.empty(len(listed), np.int64)
        new[listed] = np.arange(len(listed))
        self.place = np.empty(len(a), np.int64)
        self.place[self.order] = np.repeat(new, count)
        first = first[listed]
        self.listed, self.first, self.second, self.places, self.many = listed, a[first], b[first], self.at[first], (count > 1)[listed]
        self.edges = np.searchsorted(bucket[listed], np.arange(self.buckets + 1))

    def sent(self, shard: int, first: bool, last: bool) -> dict:
        keys = self.key[self.owner[self.at[self.order]]] if last else np.zeros(0, np.int64)
        least = np.minimum.reduceat(keys, self.start)[self.listed].view(np.uint64) if last and len(keys) else keys.view(np.uint64)
        rows = _listed(
            self.edges,
            bucket=lambda k, p: k,
            shard=lambda k, p: shard,
            size=lambda k, p: p.stop - p.start,
            first=lambda k, p: _pack_text(self.data, self.places[p], 16) if first else _pack(self.first[p], "rank"),
            second=lambda k, p: b"" if first else _pack(self.second[p], "rank"),
            # The smallest document counts in the last round alone; before, whether the shard has the pair more than once.
            rest=lambda k, p: _pack(least[p], "same") if last else _pack_bits(self.many[p]),
        )
        # Which pair each position has comes back with the answers, so that nothing has to be sorted again.
        own = (((shard >> 32) * 31 + (shard & 0xFFFFFFFF)) % self.buckets, shard, -len(self.at) - 1, _pack(self.at, "rank"), _pack(self.place, "rank"), b"")
        for values, v in zip(rows.values(), own, strict=True):
            values.append(v)
        return rows

    def answered(self, rows: pa.Table, k: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """Positions and the answers of round ``k`` to their pairs."""
        own = rows.filter(pa.compute.equal(rows.column("round"), k)).sort_by("bucket")
        found, at, place = [np.zeros(0, np.uint64)], None, None
        for blob, rest, n, b in zip(own.column("answer"), own.column("rest"), own.column("size").to_pylist(), own.column("bucket").to_pylist(), strict=True):
            if n < 0:
                at, place = (_unpack(x.as_py(), -n - 1, "rank").view(np.int64) for x in (blob, rest))
                continue
            value = _unpack(blob.as_py(), n, kind)
            found.append(np.where(value > 0, value + (np.uint64(b) << np.uint64(_RANKED)), value) if kind == "rank" else value)
        answer = np.concatenate(found)
        if at is None or len(answer) != int(place.max(initial=-1)) + 1:
            raise ValueError("a shard did not get the ranks it asked for")
        return at, answer[place]

    def take(self, rows: pa.Table, k: int, offset: int) -> None:
        at, answer = self.answered(rows, k, "rank")
        self.have += offset
        self.rank = np.zeros(len(self.data), np.uint64)
        self.rank[at] = answer


def _rerank(first: bool, last: bool):
    def answer(bucket: int, rows: pa.Table) -> Iterator[dict]:
        """New ranks of the pairs in order of appearance, 0 for a pair there is once; in the last round the least document of each."""
        maps = rows.filter(pa.compute.less(rows.column("size"), 0))
        if maps.num_rows:
            yield {"shard": _column(maps, "shard"), "bucket": np.full(maps.num_rows, -1), "size": _column(maps, "size"), "answer": maps.column("first"), "rest": maps.column("second")}
        rows = rows.filter(pa.compute.greater(rows.column("size"), 0))
        if not rows.num_rows:
            return
        if first:
            a, b = np.concatenate([_unpack_text(v.as_py()) for v in rows.column("first")], axis=1)
        else:
            a, b = _gathered(rows, "first", _unpack, "rank"), _gathered(rows, "second", _unpack, "rank")
        value = mix(a ^ mix(b))
        order = np.argsort(value)
        start = _heads(value[order])
        if len(_heads(a[order], b[order])) != len(start):
            order = np.lexsort((b, a))
            start = _heads(a[order], b[order])
        count = _sizes(start, len(a))
        if last:
            least = _gathered(rows, "rest", _unpack, "same").view(np.int64)
            given = np.minimum.reduceat(least[order], start).view(np.uint64)
        else:
            several = (count > 1) | np.logical_or.reduceat(_gathered(rows, "rest", _bits)[order], start)
            seen = np.minimum.reduceat(order, start)
            numbered = np.zeros(len(start), np.uint64)
            by_place = np.argsort(seen)
            by_place = by_place[several[by_place]]
            numbered[by_place] = np.arange(1, len(by_place) + 1, dtype=np.uint64)
            given = numbered
        out = np.empty(len(a), np.uint64)
        out[order] = np.repeat(given, count)
        yield _answers(bucket, rows, out, lambda x: _pack(x, "same" if last else "rank"), rest=[b""] * rows.num_rows)

    return answer


def _sieved(packed: DataFrame, length: int, sieve: int) -> DataFrame:
    """Per shard ``state``, the stretches of windows that may repeat."""
    n_bytes = packed.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = S.buckets_for(n_bytes // 2)

    def ask(shard: int, _: int, blob: bytes) -> Iterator[dict]:
        found = _Sieve(blob, length, sieve)
        yield _listed(
            S.split_sorted(found.values, buckets),
            bucket=lambda k, p: k,
            shard=lambda k, p: shard,
            size=lambda k, p: p.stop - p.start,
            values=lambda k, p: S.pack_sorted(found.values[p]),
            shared=lambda k, p: _pack_bits(found.shared[p]),
        )

    def narrow(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _Sieve(left.column("blob")[0].as_py(), length, sieve)
        good = np.concatenate([np.zeros(0, bool), _gathered(right.sort_by("bucket"), "answer", _bits)]) if right.num_rows else np.zeros(0, bool)
        return pa.table({"shard": left.column("shard"), "state": pa.array([_stretches(found, good, length)], pa.binary())})

    asked = S.each_shard(packed, ask, "bucket int, shard bigint, size bigint, values binary, shared binary")
    answered = S.each_bucket(asked, _answer_sieve, _ANSWER)
    return pinned(packed.groupBy("shard").cogroup(answered.groupBy("shard")).applyInArrow(narrow, "shard bigint, state binary"))


def _chunked(state: DataFrame, length: int) -> DataFrame:
    """Per shard ``pieces``, what is to be ranked, ``chunks``, all chunks, and ``n_bytes`` of the pieces."""
    n_bytes = state.agg(F.sum(F.length("state"))).first()[0] or 0
    buckets = S.buckets_for(n_bytes * 2)

    def ask(shard: int, blob: bytes) -> Iterator[dict]:
        found = _Chunks(blob, length)
        yield _listed(
            S.split_sorted(found.high, buckets),
            bucket=lambda k, p: k,
            shard=lambda k, p: shard,
            size=lambda k, p: p.stop - p.start,
            high=lambda k, p: S.pack_sorted(found.high[p]),
            low=lambda k, p: _pack(found.low[p], "same"),
            least=lambda k, p: _pack(found.least[p].view(np.uint64), "same"),
        )

    def collapse(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _Chunks(left.column("state")[0].as_py(), length)
        gone = _gathered(right.sort_by("bucket"), "answer", _bits) if right.num_rows else np.zeros(0, bool)
        pieces, chunks, n = _collapsed(found, gone, length)
        return pa.table({"shard": left.column("shard"), "pieces": pa.array([pieces], pa.binary()), "chunks": pa.array([chunks], pa.binary()), "n_bytes": pa.array([n], pa.int64())})

    asked = S.each_shard(state, ask, "bucket int, shard bigint, size bigint, high binary, low binary, least binary")
    answered = S.each_bucket(asked, _answer_chunks, _ANSWER)
    schema = "shard bigint, pieces binary, chunks binary, n_bytes bigint"
    return pinned(state.groupBy("shard").cogroup(answered.groupBy("shard")).applyInArrow(collapse, schema))


def repeated_spans(packed: DataFrame, length: int = LENGTH, sieve: int = SIEVE) -> DataFrame:
    """Per shard of ``packed``: ``spans``, an Arrow stream of ``row``, ``start`` and ``end`` of the byte runs covered by
    ``length``-byte strings that also start in a document of a smaller key."""
    session = packed.sparkSession
    state = _sieved(packed, length, sieve)
    release(session)
    state = _chunked(state, length)
    release(session)
    # Pairs of two numbers, and the smallest document in the last round.
    buckets = S.buckets_for((state.agg(F.sum("n_bytes")).first()[0] or 0) * 20)
    offsets = rounds_for(length)
    answers: DataFrame | None = None

    def ranked(blob: bytes, got: pa.Table | None, upto: int) -> _Ranks:
        ranks = _Ranks(blob, buckets)
        if upto:
            ranks.have += sum(offsets[: upto - 1])
            ranks.take(got, upto - 1, offsets[upto - 1])
        ranks.pairs(offsets[upto])
        return ranks

    sent = "bucket int, shard bigint, size bigint, first binary, second binary, rest binary"
    names = [c.split()[0] for c in sent.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def round_of(k: int, before: DataFrame | None) -> DataFrame:
        """The pinned answers of round ``k``."""
        first, last = not k, k == len(offsets) - 1

        def one(shard: int, blob: bytes) -> Iterator[dict]:
            yield ranked(blob, None, k).sent(shard, first, last)

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            made = ranked(left.column("pieces")[0].as_py(), right, k).sent(left.column("shard")[0].as_py(), first, last)
            return pa.table({n: pa.array(made[n], t) for n, t in zip(names, kinds, strict=True)})

        own = state.select("shard", "pieces")
        pairs = S.each_shard(own, one, sent) if before is None else own.groupBy("shard").cogroup(before.groupBy("shard")).applyInArrow(both, sent)
        return pinned(S.each_bucket(pairs, _rerank(first, last), f"{_ANSWER}, rest binary").withColumn("round", F.lit(k)))

    for k in range(len(offsets)):
        # The answers of a round have all that those before it had.
        answers = round_of(k, answers)
        release(session)

    def cover(left: pa.Table, right: pa.Table) -> pa.Table:
        ranks = _Ranks(left.column("pieces")[0].as_py(), buckets)
        least = np.full(len(ranks.data) + 1, _NONE, np.int64)
        at, answer = ranks.answered(right, len(offsets) - 1, "same")
        least[at] = answer.view(np.int64)
        table = _read(left.column("chunks")[0].as_py())
        row, key, start, size, at = (table.column(c).to_numpy() for c in ("row", "key", "start", "size", "at"))
        chunk = np.repeat(np.arange(len(row)), size)
        place = np.arange(len(chunk)) - np.repeat(np.cumsum(size) - size, size)
        ranked_at = at[chunk]
        # Windows of chunks that are not ranked all start in a smaller document too; a document without an id loses nothing.
        hit = ((ranked_at < 0) | (least[np.where(ranked_at < 0, -1, ranked_at + place)] < key[chunk])) & (key[chunk] != _NONE)
        row, begin = row[chunk][hit], (start[chunk] + place)[hit]
        apart = np.ones(len(row), bool)
        apart[1:] = (row[1:] != row[:-1]) | (begin[1:] > begin[:-1] + length)
        head = np.flatnonzero(apart)
        tail = np.append(head[1:], len(row)) - 1 if len(row) else head
        spans = _stream(pa.table({"row": row[head], "start": begin[head], "end": begin[tail] + length}))
        return pa.table({"shard": left.column("shard"), "spans": pa.array([spans], pa.binary())})

    return pinned(state.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(cover, "shard bigint, spans binary"))


def deduplicate(docs: DataFrame, length: int = LENGTH, sieve: int = SIEVE, with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, with ``with_text``, ``kept`` (bytes).

    Removed are the bytes covered by a string of ``length`` bytes that also starts in a document of a smaller ``doc_id``.
    Null and short texts lose nothing. A row without an id neither loses bytes nor makes others lose any; rows of one id
    are one document; other columns are ignored.
    """
    if docs.schema["doc_id"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("doc_id must be an integer")
    key = docs.schema["doc_id"].dataType.simpleString()
    packed = S.make(docs)
    spans = repeated_spans(packed, length, sieve)
    release(docs.sparkSession)
    schema = f"doc_id {key}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else "")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, data, offsets = S.open_shard(left.column("blob")[0].as_py())
        found = _read(right.column("spans")[0].as_py())
        edge = np.zeros(len(data) + 1, np.int32)
        base = offsets[found.column("row").to_numpy()]
        np.add.at(edge, base + found.column("start").to_numpy(), 1)
        np.add.at(edge, base + found.column("end").to_numpy(), -1)
        gone = np.cumsum(edge)[:-1] > 0
        before = np.concatenate([[False], gone[:-1]])
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        sums = np.concatenate([[0], np.cumsum(gone)])
        heads = np.concatenate([[0], np.cumsum(gone & ~before)]) if len(data) else np.zeros(1, np.int64)
        removed, n_spans = np.diff(sums[offsets]), np.diff(heads[offsets])
        kept = [(data[a:b][~gone[a:b]] if n else data[a:b]).tobytes() for a, b, n in zip(offsets[:-1], offsets[1:], removed, strict=True)]
        columns = {
            "doc_id": keys,
            "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        }
        if with_text:
            columns["kept"] = pa.array(kept, pa.binary())
        return pa.table(columns)

    return packed.groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(cut, schema)
