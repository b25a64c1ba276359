"""Stupid-backoff scores over n-gram counts of the whole corpus.

Shards send their distinct n-grams, with counts, to hash buckets; a bucket joins
them, adds the counts up and answers every shard; a shard then scores its
documents position by position. Every n-gram of the corpus counts. A document is
scored by what the other documents have: its own counts are taken off, or none
of its n-grams would ever back off.

n-grams are compared by 64-bit hashes: of m different ones about m * m / 2**65
pairs have one hash and share their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm import shards as S
from panelkit.llm.shared import pinned, release
from panelkit.llm.textscan import NOT_SPACE, Words, chunks, mix, run_hashes

ORDER = 3
ALPHA = 0.4


def _grams(data: np.ndarray, offsets: np.ndarray, sizes: range) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n of ``sizes`` the hash of the n words that end at each word, 0 where the text has fewer before it; word ranges of the texts."""
    found: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in sizes]
    first = [np.zeros(1, np.int64)]
    for low, high in chunks(offsets):
        words = Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], NOT_SPACE)
        value = words.hashes()
        place = np.arange(len(words)) - np.repeat(words.first[:-1], np.diff(words.first))
        for own, n in zip(found, sizes, strict=True):
            out = np.zeros(len(words), np.uint64)
            ends = np.flatnonzero(place >= n - 1)
            out[ends] = run_hashes(value, ends - (n - 1), n) | np.uint64(1)
            own.append(out)
        first.append(words.first[1:] + first[-1][-1])
    return [np.concatenate(x) for x in found], np.concatenate(first)


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, how often each is there, and the place of each value among them."""
    order = np.argsort(values)
    ranked = values[order]
    start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(values) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(values)))
    place = np.empty(len(values), np.int64)
    place[order] = np.repeat(np.arange(len(start)), count)
    return ranked[start], count, place


def _counted(packed: DataFrame, sizes: range, buckets: int) -> DataFrame:
    """Pinned answers: per shard, n and bucket the corpus counts of the shard's distinct n-grams in order of hash, and ``total``, the
    occurrences of all the bucket's n-grams, once for each n and bucket."""

    def ask(shard: int, _: int, blob: bytes) -> Iterator[dict]:
        _, data, offsets = S.open_shard(blob)
        grams, _ = _grams(data, offsets, sizes)
        rows: dict[str, list] = {k: [] for k in ("bucket", "shard", "n", "size", "grams", "counts")}
        for n, values in zip(sizes, grams, strict=True):
            distinct, counts, _ = _groups(values[values > 0])
            edges = S.split_sorted(distinct, buckets)
            for b in np.flatnonzero(np.diff(edges)):
                part = slice(edges[b], edges[b + 1])
                made = (int(b), shard, n, int(edges[b + 1] - edges[b]), S.pack_sorted(distinct[part]), S.deflate(counts[part].astype(np.uint32)))
                for k, v in zip(rows, made, strict=True):
                    rows[k].append(v)
        yield rows

    def answer(bucket: int, rows: pa.Table) -> Iterator[dict]:
        at, size = rows.column("n").to_numpy(), rows.column("size").to_numpy()
        for n in sizes:
            own = np.flatnonzero(at == n)
            if not len(own):
                continue
            every = np.concatenate([S.unpack_sorted(rows.column("grams")[int(k)].as_py(), int(size[k])) for k in own])
            counts = np.concatenate([S.inflate(rows.column("counts")[int(k)].as_py(), int(size[k]), np.uint32) for k in own])
            distinct, _, place = _groups(every)
            sums = np.bincount(place, counts, len(distinct)).astype(np.int64)[place]
            edges = np.concatenate([[0], np.cumsum(size[own])])
            yield {
                "shard": rows.column("shard").to_numpy()[own],
                "n": at[own],
                "bucket": np.full(len(own), bucket),
                "size": size[own],
                "counts": [S.deflate(sums[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)],
                "total": np.where(np.arange(len(own)) == 0, int(counts.sum(dtype=np.int64)), 0),
            }

    asked = S.each_shard(packed, ask, "bucket int, shard bigint, n int, size bigint, grams binary, counts binary")
    return pinned(S.each_bucket(asked, answer, "shard bigint, n int, bucket int, size bigint, counts binary, total bigint"))


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``log_score`` (sum of natural logs) and ``per_word`` (null without words).

    Words are lower-cased in A-Z and cut at ASCII white space. The score of a word is the count of the longest n-gram that
    ends in it and is in another document over the count of its context, times ``alpha`` for each word of context given up;
    for a lone word the count over all words. All counts are those of the other rows; contexts are counted over all their
    occurrences; a word that no other row has counts once. Null and empty texts have no words and a score of 0; repeated
    rows are documents of their own; other columns are ignored.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    packed = S.make(docs)
    n_bytes = packed.agg(F.sum("n_bytes")).first()[0] or 0
    # About one distinct n-gram for every six bytes, of six bytes each.
    buckets = S.buckets_for(n_bytes * 2)
    answered: DataFrame | None = None
    # One exchange after the other, so that the requests of one are gone before the next; words go with pairs of them.
    for sizes in (range(1, min(order, 2) + 1), *(range(n, n + 1) for n in range(3, order + 1))):
        got = _counted(packed, sizes, buckets)
        answered = got if answered is None else answered.unionByName(got)
        release(docs.sparkSession)
    total = answered.where("n = 1").agg(F.sum("total")).first()[0] or 0

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, data, offsets = S.open_shard(left.column("blob")[0].as_py())
        grams, first = _grams(data, offsets, range(1, order + 1))
        n_words = np.diff(first)
        own_doc = np.repeat(np.arange(len(n_words)), n_words)
        got = right.sort_by([("n", "ascending"), ("bucket", "ascending")])
        others = []
        for n, values in enumerate(grams, 1):
            part = got.filter(pa.compute.equal(got.column("n"), n))
            table = np.concatenate([np.zeros(0, np.int64), *(S.inflate(b.as_py(), k, np.int64) for b, k in zip(part.column("counts"), part.column("size").to_pylist(), strict=True))])
            at = np.flatnonzero(values)
            distinct, _, place = _groups(values[at])
            if len(table) != len(distinct):
                raise ValueError("a shard did not get the counts it asked for")
            # How often the text itself has the n-gram.
            _, times, mine = _groups(mix(values[at] ^ mix(own_doc[at].astype(np.uint64))))
            out = np.zeros(len(values), np.int64)
            out[at] = table[place] - times[mine]
            others.append(out)
        rest = np.maximum(total - n_words, 1)[own_doc]
        logs = np.full(len(own_doc), np.nan)
        have = np.arange(len(own_doc)) - first[:-1][own_doc] + 1
        for n in range(order, 0, -1):
            # The context is the n-gram before the last word: the (n-1)-gram that ends one word earlier.
            context = np.concatenate([[0], others[n - 2][:-1]]) if n > 1 and len(logs) else rest
            count = others[n - 1] if n > 1 else np.maximum(others[0], 1)
            kept = np.isnan(logs) & (count > 0) & (context > 0) & (have >= n)
            back = np.minimum(order, have[kept]) - n
            logs[kept] = back * np.log(alpha) + np.log(count[kept] / context[kept])
        value = np.array([logs[a:b].sum() for a, b in zip(first[:-1], first[1:], strict=True)], float)
        per = [v / n if n else None for v, n in zip(value.tolist(), n_words.tolist(), strict=True)]
        return pa.table({"doc_id": doc, "n_words": pa.array(n_words, pa.int64()), "log_score": pa.array(value, pa.float64()), "per_word": pa.array(per, pa.float64())})

    schema = f"doc_id {key}, n_words bigint, log_score double, per_word double"
    return packed.groupBy("shard").cogroup(answered.groupBy("shard")).applyInArrow(score, schema)
