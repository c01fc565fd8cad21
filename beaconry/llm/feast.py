"""Leading eigenpairs of a symmetric matrix by contour integration.

For an interval (a, b) the projector onto the eigenvectors whose eigenvalues lie in it is the contour integral of the
resolvent (zI - V)^-1 around it. A Gauss-Legendre rule on the upper half of a circle turns it into complex shifted solves,
conjugate points coming for free. Each round applies that rational filter to a block of vectors and extracts eigenpairs
by Rayleigh-Ritz. Inertia counts tell how many eigenvalues an interval holds, cut the wanted range into intervals whose
neighbourhood is clear of other eigenvalues, and verify that none is missed.
"""

from __future__ import annotations

import numpy as np

POINTS, ROUNDS = 8, 30
#: Where an interval is cut; the next one is tried if an eigenvalue lies on a cut.
CUTS = (0.5123, 0.4871, 0.5391)


class Inertia:
    """Counts of eigenvalues beyond a shift, by the signs of the pivots of LDL'.

    The matrix is reduced to three diagonals once, which keeps its inertia at every shift; a count is then one sweep.
    """

    def __init__(self, v: np.ndarray):
        a = np.array(v, dtype=np.float64)
        d = len(a)
        for k in range(d - 2):
            u = a[k + 1:, k].copy()
            length = np.linalg.norm(u)
            if length == 0:
                continue
            u[0] += np.copysign(length, u[0])
            u /= np.linalg.norm(u)
            rest = a[k + 1:, k + 1:]
            p = rest @ u
            q = p - (u @ p) * u
            rest -= 2 * (np.outer(u, q) + np.outer(q, u))
            a[k + 1:, k] -= 2 * u * (u @ a[k + 1:, k])
        self.main = np.diag(a).tolist()
        self.side = np.diag(a, -1).tolist()
        self.tiny = np.finfo(float).tiny ** 0.5

    def above(self, shift: float) -> int:
        """Eigenvalues greater than ``shift``."""
        count, pivot = 0, 1.0
        for i, m in enumerate(self.main):
            pivot = m - shift - (self.side[i - 1] ** 2 / pivot if i else 0.0)
            if abs(pivot) < self.tiny:
                pivot = -self.tiny
            count += pivot > 0
        return count


def contour(a: float, b: float, points: int) -> list[tuple[complex, complex]]:
    """(z, weight) on the upper half of the circle over (a, b)."""
    x, w = np.polynomial.legendre.leggauss(points)
    theta = np.pi / 2 * (1 - x)
    turn = (b - a) / 2 * np.exp(1j * theta)
    return [((a + b) / 2 + t, wt * t / 2) for t, wt in zip(turn, w)]


def inside(v: np.ndarray, a: float, b: float, count: int, around: int, points: int = POINTS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of ``v`` in (a, b), ascending; by inertia there are that many, and ``around`` near the interval.

    Raises ArithmeticError if no round finds that many with small residuals.
    """
    d = len(v)
    size = min(d, max(around, 3 * count // 2) + 4)
    y = np.random.default_rng(seed).standard_normal((d, size))
    scale, eye = np.abs(v).sum(axis=1).max(), np.eye(d)
    rule = contour(a, b, points)
    inverses = [np.linalg.inv(z * eye - v) for z, _ in rule]
    best = None
    for _ in range(ROUNDS):
        q = sum((w * (r @ y)).real for (_, w), r in zip(rule, inverses))
        q, _ = np.linalg.qr(q)
        small = q.T @ v @ q
        e, s = np.linalg.eigh((small + small.T) / 2)
        y = q @ s
        hit = np.flatnonzero((e > a) & (e < b))
        if len(hit) >= count:
            residual = np.linalg.norm(v @ y[:, hit] - y[:, hit] * e[hit], axis=0)
            order = np.sort(np.argsort(residual)[:count])
            worst = residual[order].max()
            if best is not None and worst >= best[0] / 2 and best[0] <= 1e-10 * scale:
                break
            if best is None or worst < best[0]:
                best = worst, e[hit][order], y[:, hit][:, order]
    if best is None or best[0] > 1e-10 * scale:
        raise ArithmeticError(f"fewer than {count} eigenpairs found in ({a}, {b})")
    return best[1], best[2]


def slices(count: Inertia, a: float, b: float, least: float, cut: float) -> list[tuple[float, float, int, int]]:
    """(a, b, eigenvalues inside, eigenvalues inside or near) of intervals that cover (a, b) and have clear surroundings."""
    low, high = count.above(a), count.above(b)
    if low == high:
        return []
    margin = (b - a) / 4
    near = count.above(a - margin) - count.above(b + margin)
    if near == low - high or b - a <= least:
        return [(a, b, low - high, near)]
    middle = a + (b - a) * cut
    return slices(count, a, middle, least, cut) + slices(count, middle, b, least, cut)


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the ``k`` largest eigenvalues of a covariance, falling.

    Eigenvalues that are zero within rounding are left out, so there may be fewer. The lower end is bisected by inertia until
    few more than ``k`` eigenvalues lie above it, then moved into the gap below them.
    """
    d = len(v)
    top = float(np.abs(v).sum(axis=1).max()) if d else 0.0
    if not top:
        return np.zeros(0), np.zeros((d, 0))
    count = Inertia(v)
    low, high = top * d * 16 * np.finfo(float).eps, top
    held = count.above(low)
    k = min(k, held)
    while held > k and high - low > 1e-9 * top:
        middle = (low + high) / 2
        n = count.above(middle)
        if n >= k:
            low, held = middle, n
        else:
            high = middle
    step = (top - low) / 4
    while step > 1e-12 * top:
        if low > step and count.above(low - step) == held:
            low -= step / 2
            break
        step /= 2
    for last, cut in zip((False, False, True), CUTS):
        try:
            found = [inside(v, a, b, n, near) for a, b, n, near in slices(count, low, top * 1.01, 1e-9 * top, cut)]
            break
        except ArithmeticError:
            if last:
                raise
    if sum(len(e) for e, _ in found) != held:
        raise ArithmeticError(f"{held} eigenvalues above {low} by inertia, others found")
    q, _ = np.linalg.qr(np.hstack([w for _, w in found]))
    small = q.T @ v @ q
    e, s = np.linalg.eigh((small + small.T) / 2)
    w = q @ s[:, ::-1][:, :k]
    return e[::-1][:k], w / np.linalg.norm(w, axis=0)
