"""Singular values and right vectors of a small triangle: Householder, dqds, twisted factorisations."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def bidiagonalised(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): r = u B v^T for an orthogonal u, B upper bidiagonal with diagonal a and b above it."""
    m = np.array(r, float)
    d = m.shape[1]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(x)
        if norm == 0:
            return None
        h = x / norm
        h[0] += 1.0 if h[0] >= 0 else -1.0
        return h / np.linalg.norm(h)

    for k in range(d):
        h = reflector(m[k:, k])
        if h is not None:
            m[k:, k:] -= 2 * np.outer(h, h @ m[k:, k:])
        if k < d - 2:
            h = reflector(m[k, k + 1 :])
            if h is not None:
                m[:, k + 1 :] -= 2 * np.outer(m[:, k + 1 :] @ h, h)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ h, h)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _bound(q: np.ndarray, e: np.ndarray) -> float:
    """A number not above the least eigenvalue: one over the trace of the inverse."""
    d, total = q[0], 0.0
    for k in range(len(q)):
        if d <= 0:
            return 0.0
        total += 1.0 / d
        if k + 1 < len(q):
            d = q[k + 1] * (d / (d + e[k]))
    return 1.0 / total


def _step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One differential quotient-difference step with shift; None if the shift was too large."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    for k in range(n - 1):
        new_q[k] = d + e[k]
        if d < 0 or new_q[k] <= 0:
            return None
        ratio = q[k + 1] / new_q[k]
        new_e[k] = e[k] * ratio
        d = d * ratio - shift
    if d < 0:
        return None
    new_q[n - 1] = d
    return new_q, new_e


def singular_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal matrix, falling: dqds with Newton shifts from below.

    Each step takes the shift from the trace of the inverse, which never passes the least
    eigenvalue, so all quantities stay positive and keep their relative accuracy. A negligible
    last coupling splits off one value, a negligible one further up cuts the matrix in two.
    """
    found: list[float] = []
    stack = [(np.square(np.asarray(a, float)), np.square(np.asarray(b, float)), 0.0)]
    while stack:
        q, e, sigma = stack.pop()
        while len(q) > 1:
            if q[0] < q[-1] / 2:
                q, e = _turned(q, e)
            small = np.flatnonzero(e <= (4 * EPS) ** 2 * (sigma + np.minimum(q[:-1], q[1:])))
            if len(small):
                cut = int(small[-1])
                if cut < len(q) - 2:
                    stack.append((q[: cut + 1], e[:cut], sigma))
                    q, e = q[cut + 1 :], e[cut + 1 :]
                    continue
                found.append(sigma + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            shift = _bound(q, e)
            made, back = _step(q, e, shift), 1 - 1e-6
            while made is None:
                # Only rounding can make the shift too large; without one the step always succeeds.
                shift, back = (shift * back if back > 0.1 else 0.0), back**8
                made = _step(q, e, shift)
            (q, e), sigma = made, sigma + shift
        if len(q):
            found.append(sigma + q[0])
    return np.sort(np.array(found))[::-1]


def _turned(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same singular values in reverse order: the transpose, read from its other end."""
    return q[::-1].copy(), e[::-1].copy()


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B^T B = L D L^T for an eigenvalue, from its twisted factorisation.

    The stationary transform gives L+ D+ L+^T from the top, the progressive one U- D- U-^T from
    the bottom; they are joined where the twist element is least.
    """
    n = len(a)
    if n == 1:
        return np.ones(1)
    scale = max(float(np.max(np.abs(a))), float(np.max(np.abs(b))))
    tiny = (EPS * scale) ** 2 * EPS
    a = np.where(np.abs(a) < EPS * scale, EPS * scale, a)
    d, low = a * a, b / a[:-1]
    stationary, s = np.empty(n - 1), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + d[i]
        pivot = pivot if abs(pivot) > tiny else -tiny
        stationary[i] = d[i] * low[i] / pivot
        s[i + 1] = stationary[i] * low[i] * s[i] - value
    progressive, p = np.empty(n - 1), np.empty(n)
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * low[i] * low[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else -tiny
        t = d[i] / pivot
        progressive[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    twist = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -stationary[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -progressive[i] * z[i]
    return z / np.linalg.norm(z)


def _apart(a: np.ndarray, b: np.ndarray, value: float, others: np.ndarray, seed: int) -> np.ndarray:
    """A vector for one of several close values: inverse iteration kept at right angles to the others."""
    n = len(a)
    t = np.diag(a * a + np.concatenate([[0.0], b * b])) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    shifted = t - (value + 4 * EPS * max(value, EPS * np.trace(t))) * np.eye(n)
    z = np.random.default_rng(seed).standard_normal(n)
    for _ in range(4):
        for _ in range(2):
            z -= others @ (others.T @ z)
        z /= np.linalg.norm(z)
        z = np.linalg.lstsq(shifted, z, rcond=EPS)[0]
        z /= np.linalg.norm(z)
    for _ in range(2):
        z -= others @ (others.T @ z)
    return z / np.linalg.norm(z)


def leading_directions(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of a square triangle, falling, and unit right vectors of the first `count`.

    Only values above the rounding error of the greatest have a vector. Where a coupling of the
    bidiagonal matrix is nil, each block gives its own values and vectors; vectors of values closer
    than one part in 10,000 are made orthogonal to the ones before, by inverse iteration where the
    twisted vector is not far enough from them.
    """
    d = r.shape[1]
    a, b, v = bidiagonalised(r)
    norm = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    cuts = [0, *(np.flatnonzero(np.abs(b) <= EPS * norm) + 1).tolist(), d]
    parts = []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        if high > low:
            squares = singular_squares(a[low:high], b[low : high - 1])
            parts += [(float(x), low, high) for x in squares]
    parts.sort(key=lambda x: (-x[0], x[1]))
    values = np.array([x[0] for x in parts])
    rank = int(np.sum(values > (d * EPS) * values[0])) if d and values[0] > 0 else 0
    vectors = np.zeros((d, min(count, rank)))
    for j in range(vectors.shape[1]):
        value, low, high = parts[j]
        inner_a, inner_b = a[low:high], b[low : high - 1]
        z = np.zeros(d)
        z[low:high] = twisted_vector(inner_a, inner_b, value)
        near = [i for i in range(j) if parts[i][1] == low and parts[i][0] - value <= 1e-4 * parts[i][0]]
        if near:
            others = vectors[:, near]
            left = z - others @ (others.T @ z)
            if np.linalg.norm(left) > 0.1:
                z = left / np.linalg.norm(left)
                z -= others @ (others.T @ z)
                z /= np.linalg.norm(z)
            else:
                z = np.zeros(d)
                z[low:high] = _apart(inner_a, inner_b, value, others[low:high], j)
        vectors[:, j] = z
    return values, v @ vectors
