"""Small numeric helper run inside one grouped task: boosted trees and a balanced logit.

Spark decides what one task sees (one series and target); this only fits it.
Trees are grown leaf by leaf on binned features. Rows to predict are routed
down together with the fitting rows, so no tree is ever stored.
"""

from __future__ import annotations

import numpy as np

# The learner settings that results are specified with.
LEAVES = 31
LEARNING_RATE = 0.05
MIN_LEAF_ROWS = 20
MAX_BINS = 255
LOGIT_STEPS = 200


class Binning:
    """Feature values → bin numbers; the last bin holds missing values."""

    def __init__(self, fit_rows: np.ndarray) -> None:
        self.edges = [self._edges(column[~np.isnan(column)]) for column in fit_rows.T]
        self.width = max([len(e) for e in self.edges], default=0) + 2

    @staticmethod
    def _edges(values: np.ndarray) -> np.ndarray:
        distinct = np.unique(values)
        if len(distinct) > MAX_BINS:
            ranks = np.linspace(0, 1, MAX_BINS + 1)[1:-1]
            return np.unique(np.quantile(values, ranks))
        return (distinct[:-1] + distinct[1:]) / 2

    def codes(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(rows.shape, dtype=np.int64)
        for j, edges in enumerate(self.edges):
            column = rows[:, j]
            out[:, j] = np.where(np.isnan(column), self.width - 1, np.searchsorted(edges, column, side="left"))
        return out


class _Trees:
    """Grows trees on one set of fitting rows and routes the rows to predict along."""

    def __init__(self, fit_codes: np.ndarray, out_codes: np.ndarray, width: int) -> None:
        n, self.n_features = fit_codes.shape
        self.width, self.missing = width, width - 1
        self.fit_columns = np.ascontiguousarray(fit_codes.T)
        self.out_columns = np.ascontiguousarray(out_codes.T)
        # one cell number per (feature, bin), so one bincount fills all histograms
        self.cells = fit_codes + np.arange(self.n_features) * width
        self.has_missing = bool((fit_codes == self.missing).any())
        self.every_fit, self.every_out = np.arange(n), np.arange(len(out_codes))
        self.shape = (self.n_features, width)
        self.all_counts = np.bincount(self.cells.ravel(), minlength=self.n_features * width)

    def _histogram(self, residual: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
        """Residual sums and row counts, stacked: (2, feature, bin). ``None`` means all rows."""
        size = self.n_features * self.width
        cells = (self.cells if rows is None else self.cells[rows]).ravel()
        out = np.empty((2, size))
        weights = np.repeat(residual if rows is None else residual[rows], self.n_features)
        out[0] = np.bincount(cells, weights=weights, minlength=size)
        out[1] = self.all_counts if rows is None else np.bincount(cells, minlength=size)
        return out.reshape(2, *self.shape)

    def _best_splits(self, hists: np.ndarray) -> list:
        """Per leaf of (leaf, 2, feature, bin): (gain, feature, last left bin, missing goes left)."""
        whole = hists[:, :, :1, :].sum(axis=3, keepdims=True)
        parent = whole[:, 0, 0, 0] ** 2 / whole[:, 1, 0, 0]
        left = hists[:, :, :, :-1].cumsum(axis=3)
        sides = [left, left + hists[:, :, :, -1:]] if self.has_missing else [left]
        best = [(0.0, -1, -1, False)] * len(hists)
        for missing_left, ls in enumerate(sides):
            rs = whole - ls
            ln, rn = ls[:, 1], rs[:, 1]
            gain = ls[:, 0] ** 2 / np.maximum(ln, 1.0) + rs[:, 0] ** 2 / np.maximum(rn, 1.0)
            gain[(ln < MIN_LEAF_ROWS) | (rn < MIN_LEAF_ROWS)] = -1.0
            flat = gain.reshape(len(hists), -1)
            for i, at in enumerate(flat.argmax(axis=1)):
                value = flat[i, at] - parent[i]
                if flat[i, at] >= 0.0 and value > best[i][0] + 1e-12:
                    best[i] = (value, *divmod(int(at), self.width - 1), bool(missing_left))
        return best

    def grow(self, residual: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """One tree leaf by leaf: [(fitting rows, rows to predict, mean residual)]."""
        root = self._histogram(residual, None)
        leaves = [(self._best_splits(root[None])[0], self.every_fit, self.every_out, root)]
        gains = [leaves[0][0][0]]
        while len(leaves) < LEAVES:
            gain = max(gains)
            if gain <= 0.0:
                break
            at = gains.index(gain)
            (_, feature, last_bin, missing_left), fit, out, hist = leaves[at]
            fit_code, out_code = self.fit_columns[feature][fit], self.out_columns[feature][out]
            fit_left, out_left = fit_code <= last_bin, out_code <= last_bin
            if missing_left:
                fit_left |= fit_code == self.missing
                out_left |= out_code == self.missing
            fits, outs = (fit[fit_left], fit[~fit_left]), (out[out_left], out[~out_left])
            # Only the smaller side is counted; the other is the difference.
            small = int(len(fits[1]) < len(fits[0]))
            pair = np.empty((2, *hist.shape))
            pair[small] = self._histogram(residual, fits[small])
            np.subtract(hist, pair[small], out=pair[1 - small])
            splits = self._best_splits(pair)
            leaves[at : at + 1] = [(splits[i], fits[i], outs[i], pair[i]) for i in (0, 1)]
            gains[at : at + 1] = [splits[0][0], splits[1][0]]
        return [(fit, out, residual[fit].mean()) for _, fit, out, _ in leaves]


def boosted_forecast(fit_codes, y, out_codes, width, rounds, y_out=None, patience=None):
    """Forecast of the ``out`` rows. With ``y_out`` the best round by squared error is kept.

    Returns (forecast, rounds used).
    """
    trees = _Trees(fit_codes, out_codes, width)
    fitted = np.full(len(y), y.mean())
    forecast = np.full(len(out_codes), y.mean())
    best, best_loss, best_round = forecast.copy(), np.inf, 0
    for number in range(1, rounds + 1):
        leaves = trees.grow(y - fitted)
        for fit, out, value in leaves:
            fitted[fit] += LEARNING_RATE * value
            forecast[out] += LEARNING_RATE * value
        if y_out is None:
            best, best_round = forecast, number
        else:
            loss = float(np.mean((y_out - forecast) ** 2))
            if loss < best_loss:
                best, best_loss, best_round = forecast.copy(), loss, number
            elif patience and number - best_round >= patience:
                break
        if len(leaves) == 1:
            break
    return best, best_round


def balanced_logit(rows: np.ndarray, positive: np.ndarray) -> np.ndarray | None:
    """Coefficients (weights…, intercept) with balanced classes and unit L2 on the weights.

    Newton steps with halving; ``None`` when they do not settle.
    """
    n, n_pos = len(positive), positive.sum()
    if n_pos in (0, n):
        return None
    share = np.where(positive == 1, n / (2 * n_pos), n / (2 * (n - n_pos)))
    design = np.column_stack([rows, np.ones(n)])
    penalty = np.append(np.ones(rows.shape[1]), 0.0)

    def loss(w):
        margin = design @ w
        return float(share @ (np.logaddexp(0, margin) - positive * margin) + 0.5 * penalty @ w**2)

    w = np.zeros(design.shape[1])
    current = loss(w)
    for _ in range(LOGIT_STEPS):
        p = probability(rows, w)
        gradient = design.T @ (share * (p - positive)) + penalty * w
        if np.abs(gradient).max() < 1e-6 * n:
            return w
        curvature = (design * (share * p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-10)
        try:
            step = np.linalg.solve(curvature, gradient)
        except np.linalg.LinAlgError:
            return None
        scale = 1.0
        while scale > 1e-8 and not loss(w - scale * step) <= current:
            scale /= 2
        if scale <= 1e-8:
            return w
        w = w - scale * step
        current = loss(w)
    return w if np.isfinite(w).all() else None


def probability(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
    margin = rows @ w[:-1] + w[-1]
    return 0.5 * (1 + np.tanh(0.5 * margin))
