"""A gated recurrent layer in numpy: forward pass, and backpropagation through the steps of a window.

Inputs come projected already: x[t] holds the three gate inputs (update, reset, candidate) of each row of the batch.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def run(x: np.ndarray, u: np.ndarray, h: np.ndarray) -> np.ndarray:
    """States after each step, (steps, rows, H), from x (steps, rows, 3H), recurrent weights u (H, 3H) and first state h."""
    steps, rows, width = x.shape
    n = width // 3
    out = np.empty((steps, rows, n), np.float32)
    for t in range(steps):
        g = h @ u
        zr = x[t, :, : 2 * n] + g[:, : 2 * n]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1.0
        np.reciprocal(zr, out=zr)
        c = g[:, 2 * n :]
        c *= zr[:, n:]
        c += x[t, :, 2 * n :]
        np.tanh(c, out=c)
        c -= h
        c *= zr[:, :n]
        h = np.add(h, c, out=out[t])
    return out


def run_kept(x: np.ndarray, u: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list]:
    """As run, with what the backward pass needs."""
    steps, _, width = x.shape
    n = width // 3
    states, kept = [], []
    for t in range(steps):
        g = h @ u
        zr = sigmoid(x[t, :, : 2 * n] + g[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(x[t, :, 2 * n :] + r * g[:, 2 * n :])
        kept.append((h, z, r, c, g[:, 2 * n :]))
        h = h + z * (c - h)
        states.append(h)
    return np.stack(states), kept


def back(d_states: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of x and u from the gradients of the states; the window's first state is a constant (truncation)."""
    steps, rows, n = d_states.shape
    dx, du = np.empty((steps, rows, 3 * n), np.float32), np.zeros_like(u)
    dh = np.zeros((rows, n), np.float32)
    for t in reversed(range(steps)):
        h, z, r, c, gc = kept[t]
        dh = dh + d_states[t]
        dc = dh * z * (1 - c * c)
        dz = dh * (c - h) * z * (1 - z)
        dr = dc * gc * r * (1 - r)
        dg = np.concatenate((dz, dr, dc * r), axis=1)
        dx[t] = np.concatenate((dz, dr, dc), axis=1)
        du += h.T @ dg
        dh = dh * (1 - z) + dg @ u.T
    return dx, du


class Adagrad:
    """Steps scaled by the root of the squared gradients so far; sparse for tables of rows."""

    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.params, self.rate = params, rate
        self.seen = {k: np.full(v.shape, 1e-6, np.float32) for k, v in params.items()}

    def dense(self, name: str, grad: np.ndarray) -> None:
        self.seen[name] += grad * grad
        self.params[name] -= self.rate * grad / np.sqrt(self.seen[name])

    def rows(self, name: str, index: np.ndarray, grad: np.ndarray) -> None:
        """Gradients of the rows `index` (with repeats) of a table."""
        if not len(index):
            return
        order = np.argsort(index, kind="stable")
        index = index[order]
        first = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
        total, index = np.add.reduceat(grad.take(order, axis=0), first, axis=0), index[first]
        seen = self.seen[name]
        seen[index] += total * total
        self.params[name][index] -= self.rate * total / np.sqrt(seen[index])


def run_across(emb: np.ndarray, row: np.ndarray, u: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """As run, of the table's rows row (steps, rows), with a state in each column: (states (steps, H, rows), gates if `keep`).

    A gate is then one stretch of memory, and a step a few passes over it.
    """
    steps, rows = row.shape
    n, ut = len(h), np.ascontiguousarray(u.T)
    out = np.empty((steps, n, rows), np.float32)
    gates = [np.empty((steps, k * n, rows), np.float32) for k in (2, 1, 1)] if keep else None
    for t in range(steps):
        x, g = np.ascontiguousarray(emb.take(row[t], axis=0).T), ut @ h
        zr = np.add(x[: 2 * n], g[: 2 * n], out=gates[0][t] if keep else x[: 2 * n])
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1.0
        np.reciprocal(zr, out=zr)
        c = np.multiply(g[2 * n :], zr[n:], out=gates[1][t] if keep else g[2 * n :])
        c += x[2 * n :]
        np.tanh(c, out=c)
        if keep:
            gates[2][t] = g[2 * n :]
        d = c - h
        d *= zr[:n]
        h = np.add(h, d, out=out[t])
    return out, gates


def back_across(d_states: np.ndarray, first: np.ndarray, states: np.ndarray, gates: tuple, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As back, after run_across from the state `first`: gradients of the table's rows read, (steps, 3H, rows), and of u."""
    steps, n, rows = d_states.shape
    zr, c, gc = gates
    z, r = zr[:, :n], zr[:, n:]
    before = np.concatenate((first[None], states[:-1]))
    stay = 1 - z
    to_c = z * (1 - c * c)
    part = np.empty((steps, 3, n, rows), np.float32)  # gradients of the gates' inputs for one of the state
    np.multiply(to_c, r, out=part[:, 2])
    part[:, 1] = part[:, 2] * gc * (1 - r)
    part[:, 0] = (c - before) * z * stay
    dh, carried = np.empty_like(d_states), np.zeros((n, rows), np.float32)
    for t in reversed(range(steps)):
        np.add(carried, d_states[t], out=dh[t])
        part[t] *= dh[t]
        carried = dh[t] * stay[t]
        carried += u @ part[t].reshape(3 * n, rows)
    dx = part.reshape(steps, 3 * n, rows)
    du = np.matmul(before, dx.transpose(0, 2, 1)).sum(axis=0)
    np.multiply(dh, to_c, out=part[:, 2])
    return dx, du
