"""Token packing by Karmarkar-Karp multiway differencing.

Each task tokenises its documents, cuts full sequences off long ones and gathers
the remainders, in pieces, into groups of a fixed number of tokens. In a group the largest
differencing method merges partial partitions, the fullest windows of one with
the emptiest of the other, into windows of nearly equal length. Where one is over
the capacity the window count rises.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
#: Windows of one group of remainders, and tokens of 1,024 that are left free in each, so that differencing mostly fits.
GROUP_WINDOWS = 32
SLACK = 6
#: Tokens of a piece of a remainder, at most.
PIECE = 256
END_ID = 0


def karmarkar_karp(lengths: list[int], windows: int) -> list[list[int]]:
    """Indices of ``lengths`` in ``windows`` lists of nearly equal sums.

    Partial partitions are arrays of falling sums. Of the two with the greatest imbalance the fullest window of one goes with
    the emptiest of the other; the places are followed back from the last partition to the first.
    """
    own: list[list[int]] = [[] for _ in range(windows)]
    if not lengths:
        return own
    sums: dict[int, np.ndarray] = {}
    heap = []
    for i, n in enumerate(lengths):
        sums[i] = np.zeros(windows, np.int64)
        sums[i][0] = n
        heap.append((-n if windows > 1 else 0, i))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    ticket = len(lengths)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        merged = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-merged, kind="stable")
        sums[ticket] = merged = merged[order]
        merges.append((a, b, order))
        heapq.heappush(heap, (int(merged[-1] - merged[0]), ticket))
        ticket += 1
    labels = {ticket - 1: np.arange(windows)}
    for node, (a, b, order) in zip(range(ticket - 1, len(lengths) - 1, -1), reversed(merges), strict=True):
        found = np.empty(windows, np.int64)
        found[order] = labels.pop(node)
        labels[a], labels[b] = found, found[::-1]
    for i in range(len(lengths)):
        own[int(labels[i][0])].append(i)
    return own


def windows_of(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``lengths``, each of at most ``capacity``, in windows of at most ``capacity``: as few as the sum needs, and one
    more as long as differencing exceeds the capacity."""
    if lengths and max(lengths) > capacity:
        raise ValueError("a length over the capacity has to be cut")
    count = max(1, -(-sum(lengths) // capacity))
    while True:
        parts = karmarkar_karp(lengths, count)
        if max((sum(lengths[i] for i in p) for p in parts), default=0) <= capacity:
            return [p for p in parts if p]
        count += 1


class _Packer:
    """Packs the documents of one task in order; holds the remainders of one group at a time."""

    def __init__(self, capacity: int, group_windows: int):
        self.capacity, self.full = capacity, group_windows * (capacity - SLACK * capacity // 1024)
        self.sequence, self.held, self.tokens = 0, [], 0
        self.out: list[tuple] = []

    def made(self, doc, start: int, ids: np.ndarray, total: int, offset: int) -> tuple:
        return doc, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False)), total, self.sequence, offset, ids

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            self.out.append(self.made(doc, start, ids[start : start + self.capacity], total, 0))
            self.sequence += 1
            start += self.capacity
        while start < total:
            # Short pieces level out; the last two of a remainder are nearly equal. The group closes at its number of tokens, if need be inside a piece.
            left = total - start
            n = min(left if left <= PIECE else PIECE if left > 2 * PIECE else -(-left // 2), self.full - self.tokens)
            self.held.append((doc, start, ids[start : start + n], total))
            self.tokens += n
            start += n
            if self.tokens == self.full:
                self.close()

    def close(self) -> None:
        for own in windows_of([len(h[2]) for h in self.held], self.capacity):
            offset = 0
            for i in own:
                doc, start, ids, total = self.held[i]
                self.out.append(self.made(doc, start, ids, total, offset))
                offset += len(ids)
            self.sequence += 1
        self.held, self.tokens = [], 0

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


#: Distinct words that a Python worker remembers; further ones are encoded whenever they come.
REMEMBERED = 2_000_000
_MARKS = re.compile(r"[!-&(-/:-@\[-`{-~]+$")
#: White space other than the space and the line end.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_DOUBLED = ("  ", " \n", "\n ", "\n\n")


@lru_cache(maxsize=2)
def tokenizer_encoder(path: str, by_words: bool = False) -> Callable[[list[str]], Iterator[np.ndarray]]:
    """Ids by a ``tokenizers`` file, no special tokens added, with ``END_ID`` after each text.

    ``by_words`` is for byte-level BPE files whose pre-tokens begin at single spaces and line ends: each distinct word is
    then encoded once, with the space before it, and remembered by the worker. Texts with other or doubled white space, or
    with a special token's string, go through the library whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(path)
    special = [t.content for t in one.get_added_tokens_decoder().values()]

    def whole(texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in one.encode_batch_fast(texts, add_special_tokens=False)]

    end, line = np.uint32(END_ID).tobytes(), whole(["\n"])[0]
    #: Words by what stands before them: a space, a line end, or nothing at the start of a text, which is marked by a NUL and a space.
    known: dict[str, bytes] = {}
    marks: dict[str, bytes] = {}

    def lines(words: list[str]) -> list[bytes]:
        """The ids of some words without white space inside, encoded as the lines of one text; one by one where that doesn't come apart."""
        ids = np.array(one.encode("\n".join(words), add_special_tokens=False).ids, np.uint32)
        cuts = 4 * np.flatnonzero(ids == np.frombuffer(line, np.uint32)[0])
        if len(line) != 4 or len(cuts) != len(words) - 1:
            return whole(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)], strict=True)]

    def spelled(word: str) -> str:
        return word[1:] if word[0] == "\n" else word[2:] if word.startswith("\0 ") else " " + word

    def learn(words: set[str]) -> dict[str, bytes]:
        """The ids of words that are not remembered; they are, as long as there is room."""
        new = words.difference(known)
        found = known if len(known) + len(new) <= REMEMBERED else {}
        # Letters and the marks after them are pre-tokens of their own: what is new is mostly letters alone.
        cut = {w: (w[: m.start()], m[0]) for w in new if (m := _MARKS.search(w)) and w[: m.start()].isalpha()}
        plain = {a for a, _ in cut.values()}.difference(known).union(new.difference(cut))
        for w, raw in zip(plain, lines([spelled(w) for w in plain]) if plain else [], strict=True):
            found[w] = line + raw if w[0] == "\n" else raw
        missing = list({b for _, b in cut.values()}.difference(marks))
        marks.update(zip(missing, lines(missing) if missing else [], strict=True))
        found.update((w, (known[a] if a in known else found[a]) + marks[b]) for w, (a, b) in cut.items())
        return found

    def plain_spaced(text: str) -> bool:
        if not text or text[-1] == " " or text[0] == " " or any(d in text for d in _DOUBLED) or any(s in text for s in special):
            return False
        return "\0" not in text and not any(c in text for c in _OTHER_SPACE)

    def encode(texts: list[str]) -> Iterator[np.ndarray]:
        if not by_words:
            for raw in whole(texts):
                yield np.frombuffer(raw + end, np.uint32)
            return
        parts = [("\0 " + t.replace("\n", " \n")).split(" ") if plain_spaced(t) else None for t in texts]
        for p in parts:
            if p is not None:
                p[:2] = ["\0 " + p[1]]
        # Most texts have only words that are remembered; the words of the others are learnt together.
        found: list[bytes | None] = []
        for text, p in zip(texts, parts, strict=True):
            try:
                found.append(whole([text])[0] if p is None else b"".join(map(known.__getitem__, p)))
            except KeyError:
                found.append(None)
        open_texts = [k for k, raw in enumerate(found) if raw is None]
        rest = learn(set().union(*(parts[k] for k in open_texts))) if open_texts else known
        for k in open_texts:
            found[k] = b"".join(map(known.__getitem__, parts[k])) if rest is known else b"".join([known[w] if w in known else rest[w] for w in parts[k]])
        for raw in found:
            yield np.frombuffer(raw + end, np.uint32)

    return encode


PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], Iterator[np.ndarray]]], capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, with ``with_ids``, ``ids``.

    ``encoder`` makes, on an executor, the function from texts to id arrays. A null text is empty, its document is the
    end id alone. A null ``doc_id`` and repeated rows are packed like any other; other columns are ignored; no rows give
    no pieces. Sequence ids are distinct over all tasks; a sequence is the work of one task and its offsets have no gap.
    """
    from pyspark import TaskContext

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, {PIECES}" + (", ids array<bigint>" if with_ids else "")
    kinds = [pa.int64()] * 6 + ([pa.list_(pa.int64())] if with_ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(), _Packer(capacity, group_windows)
        high = TaskContext.get().partitionId() << 40

        def rows(pieces: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
            doc, *rest, ids = zip(*pieces, strict=True)
            rest[4] = [high + x for x in rest[4]]
            columns = [pa.array(doc, doc_type), *(pa.array(x, pa.int64()) for x in rest)]
            if with_ids:
                columns.append(pa.array([x.tolist() for x in ids], kinds[-1]))
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

        doc_type = None
        for batch in batches:
            doc_type = batch.column(0).type
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = part.column(1).fill_null("").to_pylist()
                for doc, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                    packer.add(doc, ids)
                if done := packer.taken():
                    yield rows(done, doc_type)
        packer.close()
        if done := packer.taken():
            yield rows(done, doc_type)

    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)
