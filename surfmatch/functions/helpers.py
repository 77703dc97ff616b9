"""Small numpy helpers that run inside tasks."""

from __future__ import annotations

import numpy as np


def pool(pos: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Pool adjacent violators over blocks in score order: (pos, n, lowest score, highest score) of ever larger means."""
    out: list[list[float]] = []
    for p, m, a, b in zip(pos.tolist(), n.tolist(), lo.tolist(), hi.tolist()):
        out.append([p, m, a, b])
        while len(out) > 1 and out[-2][0] * out[-1][1] >= out[-1][0] * out[-2][1]:
            p2, m2, _, b2 = out.pop()
            out[-1][0] += p2
            out[-1][1] += m2
            out[-1][3] = b2
    return [tuple(x) for x in out]


def balanced_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-6, steps: int = 100) -> np.ndarray:
    """Coefficients then intercept of a class-balanced logistic fit on weighted rows; the ridge spares the intercept."""
    x = x.reshape(len(y), -1)
    n1, n0 = n[y == 1].sum(), n[y == 0].sum()
    w = np.where(y == 1, (n1 + n0) / (2 * n1), (n1 + n0) / (2 * n0)) * n
    design = np.column_stack([x, np.ones(len(y))])
    penalty = np.diag([ridge] * x.shape[1] + [0.0])
    beta = np.zeros(design.shape[1])

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float(w @ (np.logaddexp(0, z) - y * z) + 0.5 * b @ penalty @ b)

    now = loss(beta)
    for _ in range(steps):
        z = design @ beta
        p = 0.5 * (1 + np.tanh(z / 2))
        gradient = design.T @ (w * (p - y)) + penalty @ beta
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + penalty + 1e-12 * np.eye(len(beta))
        move, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-8 and (new := loss(beta - size * move)) > now + 1e-12:
            size /= 2
        beta, change = beta - size * move, abs(now - new)
        now = new
        if np.abs(size * move).max() < 1e-10 or change < 1e-14:
            break
    return beta


def best_lag(a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    """Lag and height of the peak normalized cross-correlation over all integer lags; NaN counts as the mean."""
    a = np.nan_to_num(a - np.nanmean(a)) if len(a) else a
    b = np.nan_to_num(b - np.nanmean(b)) if len(b) else b
    size = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
    if size == 0.0:
        return 0, 0.0
    n = 1 << (len(a) + len(b) - 1).bit_length()
    c = np.fft.irfft(np.fft.rfft(a, n) * np.conj(np.fft.rfft(b, n)), n)
    corr = np.concatenate([c[n - len(b) + 1 :] if len(b) > 1 else c[:0], c[: len(a)]]) / size
    at = int(np.argmax(np.round(corr, 12)))
    return at - (len(b) - 1), float(corr[at])


def centred(rows: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Signals as rows of unit norm about their means, padded by zeros (NaN counts as the mean), and their lengths; constant ones are zeros, missing ones have length 0."""
    out, sizes = np.zeros((len(rows), width)), np.zeros(len(rows), int)
    for at, x in enumerate(rows):
        x = np.zeros(0) if x is None else np.asarray(x, float)
        if np.isfinite(x).any():
            v = np.nan_to_num(x - np.nanmean(x))
            norm = np.sqrt((v * v).sum())
            out[at, : len(v)], sizes[at] = v / norm if norm > 0 else 0.0, len(v)
    return out, sizes


def lag_matrix(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    """Lag and height of the correlation peak of every signal of a against every one of b (as best_lag has them), in one batch; NaN without a signal."""
    longest = [max([len(x) for x in s if x is not None], default=0) for s in (a, b)]
    n = 1 << max(sum(longest) - 1, 1).bit_length()
    (va, na), (vb, nb) = centred(a, n), centred(b, n)
    lags = np.arange(1 - max(longest[1], 1), max(longest[0], 1))
    corr = np.fft.irfft(np.fft.rfft(va)[:, None] * np.conj(np.fft.rfft(vb))[None], n)[:, :, lags % n]
    inside = (lags > -nb[None, :, None]) & (lags < na[:, None, None])
    at = np.where(inside, np.round(corr, 12), -np.inf).argmax(2)
    peak = np.take_along_axis(corr, at[:, :, None], 2)[:, :, 0]
    some = (na > 0)[:, None] & (nb > 0)
    flat = ~va.any(1)[:, None] | ~vb.any(1)
    lag = np.where(flat, 0, lags[at]).astype(float)
    return np.where(some, lag, np.nan), np.where(some, np.where(flat, 0.0, peak), np.nan)


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """The circular shift (rows, columns) of map b that correlates best with map a, and the correlation there; NaN counts as the mean."""
    a, b = (np.nan_to_num(x - np.nanmean(x)) if np.isfinite(x).any() else np.zeros(x.shape) for x in (a, b))
    size = np.sqrt((a * a).sum() * (b * b).sum())
    if size == 0.0:
        return 0, 0, 0.0
    corr = np.fft.ifft2(np.fft.fft2(a) * np.conj(np.fft.fft2(b))).real / size
    at = np.unravel_index(np.argmax(np.round(corr, 12)), corr.shape)
    dy, dx = (int(p - n) if 2 * p > n else int(p) for p, n in zip(at, corr.shape))
    return dy, dx, float(corr[at])
