"""Windows whose end is known are asked for once per block; the results are those of brute force."""

import numpy as np

from tabulon.llm import negatives as ng


def _rows(n, seed):
    rng = np.random.default_rng(seed)
    at = np.arange(n)
    return ng.Rows(at, at.copy(), np.zeros(n, bool), rng.integers(0, 3, n), np.floor(rng.normal(size=(n, 12)) * 256))


def test_known_ends_are_asked_for_at_once(monkeypatch):
    rows = _rows(900, 1)
    anchors = rows.part(np.arange(0, 900, 50))
    scores = anchors.v @ rows.v.T
    k = 3
    for same in (True, False):
        fit = ((anchors.label[:, None] == rows.label) == same) & (anchors.row[:, None] != rows.row)
        low = np.full(len(anchors), -np.inf) if same else np.full(len(anchors), 50_000.0)
        high = np.full(len(anchors), np.inf) if same else np.full(len(anchors), 400_000.0)
        want = []
        for a in range(len(anchors)):
            inside = np.flatnonzero(fit[a] & (scores[a] >= low[a]) & (scores[a] <= high[a]))
            best = inside[np.lexsort((inside, -scores[a][inside]))][:k]
            want += [(a, int(scores[a][r]), int(r)) for r in best]
        ends = np.sort(np.where(fit & (scores <= high[:, None]), scores, -np.inf)[:, ::7], axis=1)[:, -k]
        for floor, rungs in ((np.full(len(anchors), -np.inf), None), (ends, 1)):   # unknown, known from some rows
            asked = []
            lower = ng.Block.lower
            monkeypatch.setattr(ng.Block, "lower", lambda b, s, f=lower: asked.append(1) or f(b, s))
            found = ng.Found(len(anchors), k, floor)
            for start in range(0, 900, 300):
                ng.match(anchors, ng.Windows(np.arange(len(anchors)), low, high), rows.part(slice(start, start + 300)),
                         found, same)
            monkeypatch.setattr(ng.Block, "lower", lower)
            at = found.at
            assert sorted(zip(at["slot"].tolist(), at["score"].astype(int).tolist(), at["row"].tolist())) == sorted(want)
            assert rungs is None or len(asked) == 3 * rungs   # once per block
