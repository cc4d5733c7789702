"""Boosted trees of ``pyspark.ml`` for rows that fit one task.

The rules are those of ``GBTRegressor`` and ``GBTClassifier``: thresholds by strides of weight over the
distinct values, trees grown level by level on weighted variance, the first one not shrunk. Sums run in
row order, as in a frame of one partition, so the trees are the same; what goes are the jobs,
of which ``pyspark.ml`` starts one for each level of each tree. Rounds are grown one at a time and end with the patience.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPSILON = np.finfo(float).eps


def thresholds(values: np.ndarray, weight: np.ndarray, most: int) -> np.ndarray:
    """At most about ``most`` cuts between the distinct values, each after another stride of weight; all cuts where there are few."""
    distinct, place = np.unique(values, return_inverse=True)
    cuts = (distinct[:-1] + distinct[1:]) / 2
    if len(cuts) <= most:
        return cuts
    reached = np.cumsum(np.bincount(place, weights=weight))
    stride = weight.sum() / (most + 1)
    chosen, target = [], stride
    gaps = reached.tolist()
    for at in range(1, len(gaps)):
        if abs(gaps[at - 1] - target) < abs(gaps[at] - target):
            chosen.append(at - 1)
            target += stride
    return cuts[chosen]


@dataclass(frozen=True)
class Settings:
    rate: float
    depth: int
    bins: int
    least_rows: int  # of a node


class LevelTrees:
    """Grows trees on the first ``len(weight)`` rows of ``x`` and routes all rows of it along."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, settings: Settings) -> None:
        n = len(weight)
        self.settings, self.weight = settings, weight
        most = min(settings.bins, n) - 1
        cuts = [thresholds(column[:n], weight, most) for column in x.T]
        self.codes = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)])
        self.width = max((len(c) for c in cuts), default=0) + 1
        # a feature's last bin and those it doesn't have are no cuts
        self.cut = np.arange(self.width) < np.array([len(c) for c in cuts])[:, None]

    def _sums(self, node: np.ndarray, rows: np.ndarray, nodes: int, stats: list[np.ndarray | None]) -> np.ndarray:
        """(stat, node, feature, bin): sums of each of ``stats`` over ``rows``, a count for None."""
        out = np.empty((len(stats), nodes, len(self.codes), self.width))
        whole = len(rows) == len(self.weight)
        stats = stats if whole else [s if s is None else s[rows] for s in stats]
        first = node * self.width
        for f, codes in enumerate(self.codes):
            at = first + (codes[: len(rows)] if whole else codes[rows])
            for k, s in enumerate(stats):
                out[k, :, f] = np.bincount(at, weights=s, minlength=nodes * self.width).reshape(nodes, self.width)
        return out

    def grow(self, label: np.ndarray) -> np.ndarray:
        """Prediction of one tree fitted to ``label`` for every row of ``x``."""
        n, depth, least = len(self.weight), self.settings.depth, self.settings.least_rows
        weighted = self.weight * label
        stats = [self.weight, weighted, weighted * label, None]
        total = self.weight.sum()
        out = np.full(self.codes.shape[1], weighted.sum() / total)
        impurity = np.array([_variance(total, weighted.sum(), (weighted * label).sum())])
        every = np.arange(self.codes.shape[1])  # rows in nodes that may be split
        node = np.zeros(len(every), dtype=np.int64)
        for _ in range(depth):
            fit = int(np.searchsorted(every, n))
            nodes = len(impurity)
            left = self._sums(node[:fit], every[:fit], nodes, stats).cumsum(axis=3)
            right = left[..., -1:] - left
            # a side without rows is ruled out by its count
            with np.errstate(divide="ignore", invalid="ignore"):
                on_left, on_right = _variance(*left[:3]), _variance(*right[:3])
                both = left[0] + right[0]
                gain = impurity[:, None, None] - left[0] / both * on_left - right[0] / both * on_right
            gain[(left[3] < least) | (right[3] < least) | ~self.cut | ~(gain > 0)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            feature, at = np.divmod(best, self.width)
            spot = (np.arange(nodes), feature, at)
            split = gain[spot] > 0
            if not split.any():
                break
            with np.errstate(divide="ignore", invalid="ignore"):  # in nodes that are not split
                means = np.stack([side[1][spot] / side[0][spot] for side in (left, right)], axis=1)
            spread = np.stack([on_left[spot], on_right[spot]], axis=1)
            keep = split[node]
            every, node = every[keep], node[keep]
            side = (self.codes[feature[node], every] > at[node]).astype(np.int64)
            out[every] = means[node, side]
            # a child without spread is a leaf
            alive = split[:, None] & (np.abs(spread) >= EPSILON)
            number = np.cumsum(alive.ravel()).reshape(alive.shape) - 1
            impurity = spread[alive]
            keep = alive[node, side]
            every, node = every[keep], number[node, side][keep]
            if not len(impurity):
                break
        return out


def _variance(weight, total, squares):
    return (squares - total * total / weight) / weight


def _log_loss(label: np.ndarray, margin: np.ndarray) -> np.ndarray:
    return 2 * np.logaddexp(0, -2 * label * margin)


def boosted(
    x: np.ndarray,
    label: np.ndarray,
    weight: np.ndarray,
    train: int,
    settings: Settings,
    rounds: int,
    patience: int,
    classes: bool = False,
) -> tuple[np.ndarray, int]:
    """Margins of the rows behind the first ``train`` ones by the best number of rounds, and that number.

    The first ``train`` rows are fitted, the others decide the rounds. With ``classes`` labels are 0 and 1; half the
    log-odds of a 1 are the margin.
    """
    label = 2 * label - 1 if classes else label
    fit, rest = label[:train], label[train:]
    trees = LevelTrees(x, weight[:train], settings)
    margin, best, chosen, least = np.zeros(len(x)), 0, np.zeros(len(rest)), np.inf
    for at in range(rounds):
        if at == 0:
            margin += trees.grow(fit)
        else:
            now = margin[:train]
            margin += settings.rate * trees.grow(4 * fit / (1 + np.exp(2 * fit * now)) if classes else 2 * (fit - now))
        errors = _log_loss(rest, margin[train:]) if classes else (rest - margin[train:]) ** 2
        loss = float((errors * weight[train:]).sum() / weight[train:].sum())
        if at == 0 or loss < least:
            best, chosen, least = at, margin[train:].copy(), loss
        elif at - best >= patience:
            break
    return chosen, best + 1


def probability(margin: np.ndarray) -> np.ndarray:
    """Chance of a 1."""
    return 1 / (1 + np.exp(-2 * margin))
