"""Largest eigenpairs of a symmetric operator that is known by its products
only, by a block Jacobi-Davidson method (numpy; vectors of one dimension).

The operator is asked for products with a few columns at a time, so that one
pass over distributed data serves all open pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Product = Callable[[np.ndarray], np.ndarray]
EPS = float(np.finfo(np.float64).eps)


def orthonormal(columns: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns' part that is orthogonal to
    ``against``; columns with next to no such part are left out."""
    kept: list[np.ndarray] = []
    for column in columns.T:
        size = np.linalg.norm(column)
        if not size > 0 or not np.isfinite(size):
            continue
        t = column / size
        for _ in range(3):  # repeated, as one pass leaves what cancellation hides
            for basis in (*against, *([np.column_stack(kept)] if kept else [])):
                t = t - basis @ (basis.T @ t)
            size = np.linalg.norm(t)
            if size < 1e-8:
                break
            t = t / size
        else:
            kept.append(t)
    return np.column_stack(kept) if kept else np.zeros((len(columns), 0))


def minres(product: Product, right: np.ndarray, shifts: np.ndarray, project: list[np.ndarray], steps: int, tol: float) -> np.ndarray:
    """Columns t of (1 - QQ')(A - shift)(1 - QQ') t = right, one Q and shift a
    column, each by its own MINRES; a step is one product for all columns."""

    def projected(columns: np.ndarray) -> np.ndarray:
        return np.column_stack([c - q @ (q.T @ c) for c, q in zip(columns.T, project, strict=True)])

    d, k = right.shape
    x, now = np.zeros((d, k)), projected(right)
    beta = np.linalg.norm(now, axis=0)
    start = np.where(beta > 0, beta, 1.0)
    now = now / start
    before, w0, w1 = np.zeros((d, k)), np.zeros((d, k)), np.zeros((d, k))
    c0, s0, c1, s1 = np.ones(k), np.zeros(k), np.ones(k), np.zeros(k)
    rest, link = beta.copy(), np.zeros(k)
    open_columns = beta > 0
    for _ in range(steps):
        if not open_columns.any():
            break
        # One step of Lanczos ...
        ahead = projected(product(now) - now * shifts)
        alpha = np.einsum("ij,ij->j", now, ahead)
        ahead = projected(ahead - now * alpha - before * link)
        following = np.linalg.norm(ahead, axis=0)
        # ... and the rotations that keep its matrix triangular.
        above = s0 * link
        off = c0 * link
        epsilon, delta = above, c1 * off + s1 * alpha
        gamma = -s1 * off + c1 * alpha
        size = np.hypot(gamma, following)
        size = np.where(size > 0, size, 1.0)
        c2, s2 = gamma / size, following / size
        w2 = (now - w0 * epsilon - w1 * delta) / size
        x = np.where(open_columns, x + w2 * (c2 * rest), x)
        rest = np.where(open_columns, -s2 * rest, rest)
        open_columns &= (np.abs(rest) > tol * start) & (following > EPS * (np.abs(shifts) + 1e-300))
        before, now = now, ahead / np.where(following > 0, following, 1.0)
        w0, w1, link = w1, w2, following
        c0, s0, c1, s1 = c1, s1, c2, s2
    return x


def largest_eigenpairs(product: Product, d: int, wanted: int, *, most_columns: int = 64, inner_steps: int = 4,
                       rounds: int = 80, factor: float = 32.0) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues, falling, their unit vectors as
    columns, and the largest residual over the largest eigenvalue.

    A pair is locked once its residual is below ``factor`` times the double
    precision of the largest eigenvalue; products then stay orthogonal to it."""
    wanted = min(wanted, d)
    rng = np.random.default_rng(20)
    locked, values, worst = np.zeros((d, 0)), [], 0.0
    basis = orthonormal(rng.standard_normal((d, min(d, 2 * wanted))))
    images = product(basis)
    scale = 0.0
    for _ in range(rounds):
        small = basis.T @ images
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        vectors, images = basis @ turn, images @ turn
        scale = max(scale, abs(theta[0]) if len(theta) else 0.0)
        residuals = images - vectors * theta
        norms = np.linalg.norm(residuals, axis=0)
        # Lock from the largest down, so that none is passed over.
        done = 0
        full = locked.shape[1] + vectors.shape[1] >= d
        while done < len(theta) and len(values) + done < wanted and (norms[done] <= factor * EPS * scale or full):
            done += 1
        if done:
            locked = np.column_stack([locked, vectors[:, :done]])
            values += theta[:done].tolist()
            worst = max(worst, float(norms[:done].max()))
        if len(values) == wanted:
            break
        left = wanted - len(values)
        keep = slice(done, done + (most_columns if vectors.shape[1] - done + left <= most_columns else 2 * wanted))
        basis, images, theta, residuals, norms = vectors[:, keep], images[:, keep], theta[keep], residuals[:, keep], norms[keep]
        asked = slice(0, min(2 * left, len(theta)))
        spaces = [np.column_stack([locked, basis[:, [i]]]) for i in range(len(theta))[asked]]
        steps = minres(product, -residuals[:, asked], theta[asked], spaces, inner_steps, 1e-3)
        fresh = orthonormal(np.column_stack([steps, residuals[:, asked]]), locked, basis)
        if not fresh.shape[1]:  # nothing new in sight: look elsewhere
            fresh = orthonormal(rng.standard_normal((d, left)), locked, basis)
        basis = orthonormal(np.column_stack([basis, fresh]), locked)
        images = np.column_stack([images, product(fresh)]) if basis.shape[1] == images.shape[1] + fresh.shape[1] else product(basis)
    else:
        raise RuntimeError(f"{len(values)} of {wanted} eigenpairs after {rounds} rounds")
    order = np.argsort(values)[::-1]
    return np.array(values)[order], locked[:, order], worst / scale if scale else 0.0
