"""Pairs of a bucket are judged in bounded parts."""

import numpy as np

from wallframe.llm import golay_simhash as gs


def test_bucket_pairs_do_not_depend_on_the_parts(monkeypatch):
    rng = np.random.default_rng(3)
    nodes, groups, sizes = np.arange(60), rng.integers(0, 9, 60), rng.integers(90, 110, 60)
    bits = rng.integers(0, 3, (60, 8)).astype(np.uint64)
    found, most, judge = [], [], gs._may_link

    def watched(left, right, *rest):
        most.append(len(left) * len(right))
        return judge(left, right, *rest)

    monkeypatch.setattr(gs, "_may_link", watched)
    for cells in (120, gs.CELLS):
        monkeypatch.setattr(gs, "CELLS", cells)
        i, j = gs.bucket_pairs(nodes, groups, sizes, bits, 0.8, True)
        found.append(sorted(zip(i.tolist(), j.tolist(), strict=True)))
        assert max(most) <= max(cells, 60)
    assert found[0] and found[0] == found[1]
