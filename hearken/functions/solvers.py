"""Small dense solvers, many problems at a time.

Spark reduces the rows of every fit to a k*k system; these helpers solve the
systems of one Arrow batch together.
"""

from __future__ import annotations

import numpy as np


def solve_free(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Least-norm solution of each symmetric system (batch, k, k)."""
    return np.einsum("nij,nj->ni", np.linalg.pinv(gram, hermitian=True, rcond=1e-12), rhs)


def solve_nonneg(gram: np.ndarray, rhs: np.ndarray, sweeps: int = 3000, tol: float = 1e-13) -> np.ndarray:
    """Minimise b'Gb/2 - c'b over b >= 0 for each problem of the batch.

    Coordinate descent finds which coefficients are positive; an exact solve on
    that support removes its last rounding. The exact solve is kept where it is feasible and optimal.
    """
    n, k = rhs.shape
    b = np.zeros((n, k))
    diag = np.einsum("nii->ni", gram)
    live = diag > 1e-14
    safe = np.where(live, diag, 1.0)
    grad = rhs.copy()
    for _ in range(sweeps):
        moved = np.zeros(n)
        for j in range(k):
            new = np.where(live[:, j], np.maximum(0.0, b[:, j] + grad[:, j] / safe[:, j]), 0.0)
            step = new - b[:, j]
            b[:, j] = new
            grad -= gram[:, :, j] * step[:, None]
            moved = np.maximum(moved, np.abs(step))
        if moved.max(initial=0.0) <= tol * (1.0 + np.abs(b).max(initial=0.0)):
            break
    support = b > 0
    for pattern in np.unique(support, axis=0):
        on = np.flatnonzero(pattern)
        if not len(on):
            continue
        rows = np.flatnonzero((support == pattern).all(axis=1))
        exact = solve_free(gram[np.ix_(rows, on, on)], rhs[np.ix_(rows, on)])
        full = np.zeros((len(rows), k))
        full[:, on] = exact
        slope = rhs[rows] - np.einsum("nij,nj->ni", gram[rows], full)
        scale = 1.0 + np.abs(rhs[rows]).max(axis=1)
        fine = (exact >= 0).all(axis=1) & (slope.max(axis=1) <= 1e-8 * scale)
        b[rows[fine]] = full[fine]
    return b


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(v, -700.0, 700.0)))


def pair_terms(x_a, x_b, t_a, t_b, w_a, w_b, beta, slope: float, mask=None):
    """Loss, gradient and curvature of the soft pair loss between two blocks of rows."""
    target = sigmoid(slope * (t_a[:, None] - t_b[None, :]))
    prob = np.clip(sigmoid(slope * ((x_a @ beta)[:, None] - (x_b @ beta)[None, :])), 1e-9, 1.0 - 1e-9)
    weight = np.sqrt(w_a[:, None] * w_b[None, :])
    if mask is not None:
        weight = np.where(mask, weight, 0.0)
    loss = float(np.sum(weight * (-target * np.log(prob) - (1.0 - target) * np.log(1.0 - prob))))
    pull = weight * slope * (prob - target)
    grad = x_a.T @ pull.sum(axis=1) - x_b.T @ pull.sum(axis=0)
    bend = weight * slope * slope * prob * (1.0 - prob)
    cross = x_a.T @ bend @ x_b
    curve = (x_a.T * bend.sum(axis=1)) @ x_a + (x_b.T * bend.sum(axis=0)) @ x_b - cross - cross.T
    return loss, grad, curve


def projected_newton_step(beta, grad, hess, bounded):
    """Direction for a bound-constrained Newton step: coordinates held at zero by their gradient stay."""
    free = ~(bounded & (beta <= 0.0) & (grad > 0.0))
    step = np.zeros_like(beta)
    idx = np.flatnonzero(free)
    step[idx] = -np.linalg.lstsq(hess[np.ix_(idx, idx)], grad[idx], rcond=None)[0]
    return step


def project(beta, bounded):
    return np.where(bounded, np.maximum(beta, 0.0), beta)


def minimise_bounded(evaluate, beta, bounded, iterations: int = 200, tol: float = 1e-10):
    """Projected Newton with step halving. ``evaluate(beta)`` gives loss, gradient, curvature."""
    loss, grad, hess = evaluate(beta)
    for _ in range(iterations):
        residual = beta - project(beta - grad, bounded)
        if np.abs(residual).max() <= tol:
            break
        step = projected_newton_step(beta, grad, hess, bounded)
        size = 1.0
        while size > 1e-12:
            trial = project(beta + size * step, bounded)
            new = evaluate(trial)
            if new[0] <= loss + 1e-4 * float(grad @ (trial - beta)) + 1e-15 * abs(loss):
                break
            size *= 0.5
        else:
            break
        if np.abs(trial - beta).max() <= 1e-15 * (1.0 + np.abs(beta).max()):
            break
        beta, (loss, grad, hess) = trial, new
    return beta, loss, grad


def solve_elastic(gram: np.ndarray, rhs: np.ndarray, l1: np.ndarray, l2: np.ndarray, sweeps: int = 20000, tol: float = 1e-12) -> np.ndarray:
    """Minimise b'Gb/2 - c'b + l1*|b| + l2*b'b/2 per problem by coordinate descent."""
    n, k = rhs.shape
    b = np.zeros((n, k))
    grad = rhs.copy()
    diag = np.einsum("nii->ni", gram)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(k):
            pull = grad[:, j] + diag[:, j] * b[:, j]
            new = np.sign(pull) * np.maximum(np.abs(pull) - l1, 0.0) / np.maximum(diag[:, j] + l2, 1e-300)
            step = new - b[:, j]
            b[:, j] = new
            grad -= gram[:, :, j] * step[:, None]
            moved = max(moved, float(np.abs(step).max(initial=0.0)))
        if moved <= tol:
            break
    return b
