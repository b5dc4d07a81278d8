"""Singular values and right singular vectors of a small triangular matrix by quotient differences.

Householder reflections turn it into an upper bidiagonal B with non-negative entries. The differential qd transform with
shifts (dqds) finds the squares of B's singular values from the squares of its entries without a subtraction other than
the shift. Shifts are lower bounds of the least one, 1 / trace of the inverse, so that the transform stays positive.
Twisted factorisations of B'B - w, a stationary transform from the top met by a progressive one from the bottom where
their join is least, give each vector without solving a system.
"""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(np.float64).eps)
_NEGLIGIBLE = (10 * _EPS) ** 2


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and b such that (1 - b v v') x lies on the first axis."""
    size = float(np.linalg.norm(x))
    v = x.copy()
    if size == 0:
        return v, 0.0
    v[0] += np.copysign(size, x[0])
    return v, 2.0 / float(v @ v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal (both >= 0) and V of r = U B V', U and V orthogonal; r is square."""
    a, n = r.astype(np.float64), len(r)
    right = np.eye(n)
    for k in range(n):
        v, b = _reflector(a[k:, k])
        a[k:, k:] -= b * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v, b = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= b * np.outer(a[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= b * np.outer(right[:, k + 1 :] @ v, v)
    diagonal, upper = np.diag(a).copy(), np.diag(a, 1).copy()
    sign = 1.0  # of the column; rows take theirs from the diagonal
    for k in range(n):
        right[:, k] *= sign
        row = np.copysign(1.0, diagonal[k] * sign)
        if k < n - 1:
            sign = row * np.copysign(1.0, upper[k])
    diagonal, upper = np.abs(diagonal), np.abs(upper)
    _clear_rows(diagonal, upper)
    return diagonal, upper, right


def _clear_rows(diagonal: np.ndarray, upper: np.ndarray) -> None:
    """A row whose diagonal entry is only rounding becomes zero, by rotations with the rows below (of U, not of V)."""
    scale = max(float(diagonal.max()), float(upper.max(initial=0.0)))
    for k in range(len(upper)):
        if diagonal[k] > _EPS * scale:
            continue
        diagonal[k] = 0.0
        fill, upper[k] = upper[k], 0.0
        for j in range(k + 1, len(diagonal)):
            if fill == 0:
                break
            size = float(np.hypot(diagonal[j], fill))
            cosine, sine = diagonal[j] / size, fill / size
            diagonal[j] = size
            if j < len(upper):
                fill, upper[j] = -sine * upper[j], cosine * upper[j]


def _least_bound(q: list[float], e: list[float]) -> float:
    """A positive lower bound of the least eigenvalue: one over the trace of the inverse."""
    d = q[0]
    if d <= 0:
        return 0.0
    total = 1.0 / d
    for k in range(len(e)):
        d = q[k + 1] * (d / (d + e[k]))
        if d <= 0:
            return 0.0
        total += 1.0 / d
    return (1.0 - 8.0 * len(q) * _EPS) / total


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds step, or None where the shift was too large."""
    new_q, new_e = [0.0] * len(q), [0.0] * len(e)
    d = q[0] - shift
    for k in range(len(e)):
        if d < 0:
            return None
        new_q[k] = d + e[k]
        if new_q[k] == 0:
            new_e[k], d = 0.0, q[k + 1] - shift
            continue
        ratio = q[k + 1] / new_q[k]
        new_e[k] = e[k] * ratio
        d = d * ratio - shift
    if d < 0 or d != d:
        return None
    new_q[-1] = d
    return new_q, new_e


def squares(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of B, falling."""
    out: list[float] = []
    blocks = [((diagonal**2).tolist(), (upper**2).tolist(), 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        steps = 0
        while len(q) > 1:
            if e[-1] <= _NEGLIGIBLE * (moved + q[-1]) or e[-1] == 0:
                out.append(moved + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            split = next((k for k in range(len(e) - 2, -1, -1) if e[k] <= _NEGLIGIBLE * (moved + min(q[k], q[k + 1])) or e[k] == 0), None)
            if split is not None:
                blocks.append((q[: split + 1], e[:split], moved))
                q, e = q[split + 1 :], e[split + 1 :]
                continue
            if q[-1] > 1.5 * q[0]:  # graded the wrong way round
                q, e = q[::-1], e[::-1]
            shift = _least_bound(q, e)
            stepped = _transform(q, e, shift)
            if stepped is None:
                shift, stepped = 0.0, _transform(q, e, 0.0)
            (q, e), moved, steps = stepped, moved + shift, steps + 1
            if steps > 10_000 + 100 * len(diagonal):
                raise ArithmeticError("singular values did not converge")
        out.extend(moved + v for v in q)
    return np.sort(np.array(out))[::-1]


def _twisted(d: np.ndarray, low: np.ndarray, value: float, most: int) -> tuple[list[np.ndarray], float]:
    """Vectors of L D L' - value for the ``most`` best places of the twist, and the best one's correction of value."""
    n, tiny = len(d), 1e-50  # far below the least d, which is _EPS squared
    down, s = np.zeros(n), np.zeros(n)
    s[0] = -value
    for k in range(n - 1):
        plus = s[k] + d[k]
        if abs(plus) <= tiny:
            plus = -tiny
        down[k] = d[k] * low[k] / plus
        s[k + 1] = down[k] * low[k] * s[k] - value
    up, gamma = np.zeros(n), np.zeros(n)
    p = d[n - 1] - value
    gamma[n - 1] = s[n - 1] + d[n - 1]
    for k in range(n - 2, -1, -1):
        minus = d[k] * low[k] ** 2 + p
        if abs(minus) <= tiny:
            minus = -tiny
            p = minus - d[k] * low[k] ** 2
        ratio = d[k] / minus
        up[k] = low[k] * ratio
        gamma[k] = s[k] + p * ratio
        p = p * ratio - value
    out, correction = [], 0.0
    for place in np.argsort(np.abs(gamma))[:most].tolist():
        z = np.zeros(n)
        z[place] = 1.0
        for k in range(place - 1, -1, -1):
            z[k] = -down[k] * z[k + 1]
        for k in range(place, n - 1):
            z[k + 1] = -up[k] * z[k]
        size = float(np.linalg.norm(z))
        if not out:
            correction = float(gamma[place]) / size**2
        out.append(z / size)
    return out, correction


def vectors(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal eigenvectors of B'B, as columns, for the largest of its eigenvalues in falling order."""
    n, scale = len(diagonal), max(float(np.max(diagonal)), float(np.max(upper, initial=0.0)))
    a = np.maximum(diagonal / scale, _EPS)  # a change within rounding, so that L D L' exists
    b, d = np.where(upper > _EPS * scale, upper / scale, 0.0), a**2
    low = b / a[:-1]
    main = d + np.append(0.0, d[:-1] * low**2)
    side = d[:-1] * low

    def residual(z: np.ndarray, value: float) -> float:
        out = (main - value) * z
        out[:-1] += side * z[1:]
        out[1:] += side * z[:-1]
        return float(np.linalg.norm(out))

    found: list[np.ndarray] = []
    for k, value in enumerate(values / scale**2):
        for _ in range(2):
            _, correction = _twisted(d, low, value, 1)
            if abs(correction) <= 1e-10 * value:
                value += correction
        # Equal eigenvalues share their best place; the other places then give more vectors of the same space.
        equal = k > 0 and values[k - 1] - values[k] <= 1e-8 * values[k - 1]
        best, least = None, np.inf
        for nudge in (0, 8, -8, 64, -64):  # where the value lies between two that are equal but for rounding
            at = value * (1 + nudge * _EPS)
            for z in _twisted(d, low, at, n if equal else min(n, 3))[0]:
                for _ in range(2):
                    for other in found:
                        z = z - (other @ z) * other
                    size = float(np.linalg.norm(z))
                    if size < 1e-3:
                        break
                    z = z / size
                if size >= 1e-3 and (rest := residual(z, at)) < least:
                    best, least = z, rest
            if least <= 1e-13 * value * n:
                break
        if best is None:
            raise ArithmeticError("no vector found for a singular value")
        found.append(best)
    return np.array(found).reshape(len(values), n).T
