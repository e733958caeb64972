"""A two-label linear-chain conditional random field over hashed features, in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Size of the hashed feature space.
SPACE = 1 << 16


def feature_ids(names: Sequence[str], cache: dict[str, int]) -> list[int]:
    """Stable ids of feature names, the same in every process."""
    out = []
    for name in names:
        k = cache.get(name)
        if k is None:
            h = 1469598103934665603
            for c in name.encode():
                h = ((h ^ c) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
            k = cache[name] = (h ^ (h >> 33)) % SPACE
        out.append(k)
    return out


class ChainField:
    """Labels 0 (other) and 1 (credential); ``weights`` scores label 1 per feature."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None) -> None:
        self.weights = np.zeros(SPACE) if weights is None else weights
        self.moves = np.zeros((2, 2)) if moves is None else moves

    def fit(self, sequences: Sequence[Sequence[Sequence[int]]], labels: Sequence[Sequence[int]], rounds: int = 120, rate: float = 0.15, decay: float = 2e-6) -> "ChainField":
        """Maximum likelihood by Adam on the whole set; forward-backward runs over all
        sequences at once, padded to the longest."""
        n, longest = len(sequences), max(map(len, sequences))
        width = max(len(f) for s in sequences for f in s)
        pad = SPACE  # a feature whose weight stays 0
        feats = np.full((longest, n, width), pad, dtype=np.int64)
        gold = np.zeros((longest, n), dtype=np.int64)
        mask = np.zeros((longest, n), dtype=bool)
        for k, (s, y) in enumerate(zip(sequences, labels, strict=True)):
            for t, f in enumerate(s):
                feats[t, k, : len(f)] = f
            gold[: len(y), k] = y
            mask[: len(s), k] = True
        places = feats[mask]
        weights = np.append(self.weights, 0.0)
        m1, v1, m2, v2 = np.zeros_like(weights), np.zeros_like(weights), np.zeros((2, 2)), np.zeros((2, 2))
        counts_gold = np.zeros((2, 2))
        both = mask[1:] & mask[:-1]
        np.add.at(counts_gold, (gold[:-1][both], gold[1:][both]), 1)
        for step in range(1, rounds + 1):
            score = np.zeros((longest, n, 2))
            emit = np.zeros((longest, n))
            emit[mask] = weights[places].sum(axis=1)
            score[..., 1] = emit
            alpha, beta = np.zeros_like(score), np.zeros_like(score)
            alpha[0] = score[0]
            for t in range(1, longest):
                new = np.logaddexp(alpha[t - 1, :, 0, None] + self.moves[0], alpha[t - 1, :, 1, None] + self.moves[1]) + score[t]
                alpha[t] = np.where(mask[t, :, None], new, alpha[t - 1])
            for t in range(longest - 2, -1, -1):
                ahead = score[t + 1] + beta[t + 1]
                new = np.logaddexp(self.moves[:, 0][None] + ahead[:, 0, None], self.moves[:, 1][None] + ahead[:, 1, None])
                beta[t] = np.where(mask[t + 1, :, None], new, 0.0)
            whole = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
            p = np.exp(alpha + beta - whole[None, :, None])[..., 1]
            pull = (gold - p)[mask]
            grad = np.bincount(places.ravel(), np.repeat(pull, width), minlength=SPACE + 1) / n - decay * weights
            grad[pad] = 0
            pair = np.zeros((2, 2))
            for a in range(2):
                for b in range(2):
                    pair[a, b] = np.exp(alpha[:-1, :, a] + self.moves[a, b] + score[1:, :, b] + beta[1:, :, b] - whole)[both].sum()
            grad2 = (counts_gold - pair) / n
            m1, v1 = 0.9 * m1 + 0.1 * grad, 0.999 * v1 + 0.001 * grad**2
            m2, v2 = 0.9 * m2 + 0.1 * grad2, 0.999 * v2 + 0.001 * grad2**2
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            weights += rate * (m1 / c1) / (np.sqrt(v1 / c2) + 1e-8)
            self.moves = self.moves + rate * (m2 / c1) / (np.sqrt(v2 / c2) + 1e-8)
        self.weights = weights[:SPACE]
        return self

    def viterbi(self, features: Sequence[Sequence[int]]) -> list[int]:
        """The most probable labels of one sequence."""
        w, moves = self.weights, self.moves.tolist()
        if not features:
            return []
        best = [0.0, float(w[features[0]].sum())]
        back: list[tuple[int, int]] = []
        for f in features[1:]:
            emit = float(w[f].sum())
            zero = 0 if best[0] + moves[0][0] >= best[1] + moves[1][0] else 1
            one = 0 if best[0] + moves[0][1] >= best[1] + moves[1][1] else 1
            best = [best[zero] + moves[zero][0], best[one] + moves[one][1] + emit]
            back.append((zero, one))
        label = int(best[1] > best[0])
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]
