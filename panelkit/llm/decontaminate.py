"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

The windows of the test items are hashed on the driver in blocks of bounded
size; some blocks are broadcast at a time and every document is scanned against
them map-side, then the result is written and the next blocks follow.
A hash hit counts only after its words equal those of a test window.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm.shared import boxed, pinned, unboxed
from panelkit.llm.textscan import ALNUM, Words, chunks, per_document, run_hashes, text_buffer

WINDOW = 13
#: Bytes of item text in one broadcast block, of at most half as many windows; more items make more blocks, each scanned against all documents.
BLOCK_BYTES = 2 << 20
#: Blocks that one pass over the documents is scanned against.
PASS_BLOCKS = 8
_BLOOM_BITS = 22


class WindowSet:
    """Windows of one block of items: hashes in order, the words of each as a byte range, and its item; arrays, of 32 bytes a window beside the text."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        data, offsets = text_buffer(pa.array([text for _, text in items], pa.large_string()))
        words = Words(data, offsets, ALNUM)
        start, size = words.run_starts(window, whole=True)
        self.raw, at = words.spaced()
        item = np.array([i for i, _ in items], np.int64)[words.docs()[start]] if len(start) else start
        hashes = run_hashes(words.hashes(), start, size)
        order = np.lexsort((item, hashes))
        self.hashes, self.item = hashes[order], item[order]
        self.low, self.high = at[start[order]], at[(start + size)[order]] - 1
        self.sizes = np.unique(size).tolist()
        # An item has a window once.
        again = np.flatnonzero((self.hashes[1:] == self.hashes[:-1]) & (self.item[1:] == self.item[:-1])) + 1
        keep = np.ones(len(order), bool)
        keep[[k for k in again.tolist() if self.words(k) == self.words(k - 1)]] = False
        self.hashes, self.item, self.low, self.high = (x[keep] for x in (self.hashes, self.item, self.low, self.high))
        self.bloom = np.zeros(1 << _BLOOM_BITS, bool)
        self.bloom[self.hashes >> np.uint64(64 - _BLOOM_BITS)] = True

    def words(self, k: int) -> bytes:
        return self.raw[self.low[k] : self.high[k]]

    def hits(self, words: Words) -> tuple[list[int], list[int], list[list[int]]]:
        """First word, length and items of every window that occurs in the scanned documents; equal hashes count only for equal words."""
        found, sizes, items = [], [], []
        if not len(words) or not self.sizes:
            return found, sizes, items
        value, spaced = words.hashes(), None
        for size in self.sizes:
            start, _ = words.run_starts(size)
            hashes = run_hashes(value, start, size)
            maybe = np.flatnonzero(self.bloom[hashes >> np.uint64(64 - _BLOOM_BITS)])
            low, high = (np.searchsorted(self.hashes, hashes[maybe], side) for side in ("left", "right"))
            real = np.flatnonzero(high > low)
            for s, a, b in zip(start[maybe[real]].tolist(), low[real].tolist(), high[real].tolist(), strict=True):
                spaced = words.spaced() if spaced is None else spaced
                own = spaced[0][spaced[1][s] : spaced[1][s + size] - 1]
                if met := [int(self.item[k]) for k in range(a, b) if self.words(k) == own]:
                    found.append(s)
                    sizes.append(size)
                    items.append(met)
        return found, sizes, items


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_bytes`` of text; the whole is never on the driver at once."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in block.collect()]


SPANS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("words", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.LongType())),
        T.StructField("bytes", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def _runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` and ``contamination``: ``n_words``, the maximal hit word runs, the distinct item ids
    and the byte ranges of the hit runs in the text.

    ``docs`` has ``text``, ``benchmark`` has ``item_id`` and ``text``. Null texts have no words; items without an id or
    a text are left out; an empty benchmark hits nothing. Columns whose names clash with the added one are replaced.
    """
    session = docs.sparkSession
    out = docs.drop("contamination")
    names = out.columns
    schema = T.StructType([*out.schema.fields, T.StructField("contamination", SPANS)])
    blocks, first = _blocks(benchmark, block_bytes), True
    shared = [session.sparkContext.broadcast(WindowSet(items, window)) for items in islice(blocks, PASS_BLOCKS)]
    while shared:
        out = out.mapInArrow(_scanner(shared, len(names), names.index("text"), first), schema)
        first, more = False, next(blocks, None)
        if more is None:
            break
        # Written, so that the blocks of the pass can go before the next are made.
        out = pinned(out)
        for one in shared:
            one.destroy()
        shared = [session.sparkContext.broadcast(WindowSet(items, window)) for items in (more, *islice(blocks, PASS_BLOCKS - 1))]
    return out


def _scanner(shared: list, width: int, text_at: int, first: bool):
    kind = pa.struct(
        [("n_words", pa.int64()), ("hit", pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64())]))), ("items", pa.list_(pa.int64())), ("bytes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[WindowSet] = [x.value for x in shared]
        for batch in batches:
            data, offsets = text_buffer(batch.column(text_at))
            before = None if first else batch.column(width).to_pylist()
            rows = []
            for low, high in chunks(offsets):
                words = Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], ALNUM)
                start, size, items = (list(chain.from_iterable(x)) for x in zip(*(b.hits(words) for b in blocks), strict=True))
                start, size = np.array(start, np.int64), np.array(size, np.int64)
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + size, -1)
                covered = np.cumsum(cover)[:-1] > 0
                counts = per_document(covered, words.first)
                owner = np.searchsorted(words.first, start, "right") - 1
                own: dict[int, set[int]] = {}
                for d, found in zip(owner.tolist(), items, strict=True):
                    own.setdefault(d, set()).update(found)
                for d in range(high - low):
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    spans, old = [], None if before is None else before[low + d]
                    ids = own.get(d, set())
                    mask = covered[a:b]
                    if old and old["hit"]:
                        mask, ids = mask.copy(), ids | set(old["items"])
                        for x in old["hit"]:
                            mask[x["word"] : x["word"] + x["words"]] = True
                    if counts[d] or (old and old["hit"]):
                        spans = list(zip(*(x.tolist() for x in _runs(mask)), strict=True))
                    base = int(words.offsets[d])
                    rows.append(
                        {
                            "n_words": b - a,
                            "hit": [{"word": s, "words": e - s} for s, e in spans],
                            "items": sorted(ids),
                            "bytes": [{"start": int(words.start[a + s]) - base, "end": int(words.end[a + e - 1]) - base} for s, e in spans],
                        }
                    )
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(rows, kind)], [*batch.schema.names[:width], "contamination"])

    return run


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``.

    A document is contaminated if it has hit words and they are a twentieth of its words or more.
    """
    c = F.col("contamination")
    n_hit = F.aggregate(c["hit"], F.lit(0).cast("bigint"), lambda total, run: total + run["words"])
    listed = F.array_join(F.array_sort(F.transform(c["items"], lambda i: i.cast("string"))), ",")
    return (
        scan(docs.select("doc_id", "text"), benchmark, window)
        .select("doc_id", c["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(c["items"]).cast("bigint").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, spans: bool = False, whole: bool | None = None) -> DataFrame:
    """``docs`` without contaminated documents (``whole``), and, with ``spans``, with the hit word runs cut out of the text of those that stay.

    Without ``whole`` no document goes; it is the opposite of ``spans`` where it is not given. Columns stay as they are; a
    null text stays null and is never contaminated.
    """
    scanned = scan(boxed(docs, "text"), benchmark, window)
    c = F.col("contamination")
    if whole or (whole is None and not spans):
        n_hit = F.aggregate(c["hit"], F.lit(0).cast("bigint"), lambda total, run: total + run["words"])
        scanned = scanned.where(~((n_hit > 0) & (20 * n_hit >= c["n_words"])))
    if not spans:
        return unboxed(scanned, docs.columns, "text")
    raw = F.encode("text", "UTF-8")
    # Bytes between the cut runs: from the end of one to the start of the next.
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(c["bytes"], lambda b: b["end"]))
    ends = F.concat(F.transform(c["bytes"], lambda b: b["start"]), F.array(F.octet_length("text").cast("bigint")))
    kept = F.aggregate(
        F.arrays_zip(starts.alias("s"), ends.alias("e")),
        F.lit(b"").cast("binary"),
        lambda text, p: F.concat(text, F.substring(raw, (p["s"] + 1).cast("int"), (p["e"] - p["s"]).cast("int"))),
    )
    text = F.when(F.size(c["hit"]) > 0, F.decode(kept, "UTF-8")).otherwise(F.col("text"))
    return unboxed(scanned, docs.columns, "text", text=text)
