"""Large clusters of the near-duplicate stage of which most texts are in no group."""

from __future__ import annotations

import numpy as np
import pytest
from test_sound import similar_groups

from panelkit.llm import graph, neardup


def family(rng: np.random.Generator, n: int) -> list[str]:
    """Copies of one text with two words changed: 0.74 to the text, less to each other; every fifth has a near copy of its own."""
    base, texts = [f"word{k}" for k in range(70)], []
    for k in range(n):
        own = list(base)
        if texts and k % 5 == 0:
            own = [*texts[-1].split()[:-1], f"last{k}"]
        else:
            for at in rng.choice(13, 2, replace=False):
                own[5 * int(at)] = f"other{k}"
        texts.append(" ".join(own))
    return [" ".join(base), *texts]


def test_a_cluster_without_a_main_group_is_not_sent_to_every_block(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 8)
    given, block_edges = [], neardup._block_edges
    monkeypatch.setattr(neardup, "_block_edges", lambda rows, *a: given.append(rows.count()) or block_edges(rows, *a))
    texts = family(np.random.default_rng(2), 400)
    want = sorted(set(similar_groups(texts)))
    kept = neardup.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert 200 < len(want) < 360 and sorted(r.doc_id for r in kept) == want
    assert sum(given) <= 16 * len(texts)


@pytest.mark.parametrize("numbers", [neardup.MET_NUMBERS, 500])
def test_texts_held_against_a_block_are_linked_as_one_by_one(monkeypatch, numbers):
    monkeypatch.setattr(neardup, "MET_NUMBERS", numbers)
    rng = np.random.default_rng(4)
    sets = [np.zeros(0, np.uint64)] * 2
    for size in [60] * 3 + [20] * 5 + [1] * 2:
        base = rng.integers(0, 1 << 60, size).astype(np.uint64)
        for _ in range(40):
            other = rng.random(size) < rng.uniform(0, 0.3)
            sets.append(np.unique(np.where(other, rng.integers(0, 1 << 60, size).astype(np.uint64), base)[: max(1, int(size * rng.uniform(0.8, 1)))]))
    node = rng.permutation(len(sets))
    want = graph.stars(*map(np.array, neardup._own_edges(node, sets, 0.8)))
    whole = neardup._Held(node.tolist(), sets, 0.8)
    whole.meet(node.tolist(), sets)
    # In two blocks: each within itself, and the second sent to the first.
    half = [(node[k::2].tolist(), sets[k::2]) for k in range(2)]
    parts = [neardup._Held(*half[k], 0.8) for k in (0, 1, 0)]
    for part, sent in zip(parts, (0, 1, 1), strict=True):
        part.meet(*half[sent])
    for got in (whole.linked(), graph.stars(*np.concatenate([p.linked() for p in parts], axis=1))):
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(zip(*(x.tolist() for x in want), strict=True))
