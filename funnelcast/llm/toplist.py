"""Short lists of the best (score, id) pairs: higher scores first, equal ones by smaller id."""

from __future__ import annotations

import numpy as np

Best = tuple[np.ndarray, np.ndarray]  # scores and ids, best first

NOTHING: Best = (np.empty(0, np.int64), np.empty(0, np.int64))


def merged(best: Best, scores: np.ndarray, ids: np.ndarray, k: int) -> Best:
    """The k best of ``best`` and the new pairs."""
    if len(best[0]) == k:
        worth = scores >= best[0][-1]
        scores, ids = scores[worth], ids[worth]
    if not len(scores):
        return best
    if len(scores) > 4 * k:
        worth = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[worth], ids[worth]
    scores, ids = np.concatenate([best[0], scores]), np.concatenate([best[1], ids])
    first = np.lexsort((ids, -scores))[:k]
    return scores[first], ids[first]
