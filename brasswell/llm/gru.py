"""A gated recurrent language model in numpy with a class-factored softmax, trained by truncated backpropagation.

A token's probability is that of its class given the state, times that of the token in its class given the state. The first classes are runs
of the most frequent words by falling count. The classes behind them hold groups of rarer words, the last one all words that are in none: there
only the class depends on the state, the words' shares in it are fixed by their counts. An id is a frequent word's or a group's.
"""

from __future__ import annotations

import numpy as np

HIDDEN, WINDOW, RATE = 16, 8, 0.1
#: Where sums of squared gradients begin.
SEEN = 1e-4
#: Lanes side by side: as many as leave ``UPDATES`` windows in a pool, and no more than ``LANES``.
LANES, UPDATES = 512, 128
#: Cases whose outputs are computed at once when scoring.
CASES = 4096
#: Cases of classes at once, and documents side by side when scoring.
AT_ONCE, ABREAST = 1024, 1024


def shapes(classes: int, size: int, groups: int) -> dict[str, tuple[int, ...]]:
    """classes of ``size`` words, then the groups; the embedding has a row for each word and for each group."""
    h = HIDDEN
    return {"emb": (classes * size + groups, h), "wx": (h, 3 * h), "bx": (3 * h,), "u": (h, 3 * h), "wc": (h, classes + groups), "bc": (classes + groups,), "ww": (classes, h, size), "bw": (classes, size)}


def initial(counts: np.ndarray, groups: np.ndarray | float, classes: int, size: int) -> dict[str, np.ndarray]:
    """Starts at the unigram distribution: counts of the classes' words (0: no such word), and of the groups, the last of which holds all others."""
    rng, groups = np.random.default_rng(7), np.atleast_1d(groups)
    p = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in shapes(classes, size, len(groups)).items()}
    grid = counts.reshape(classes, size).astype(float)
    p["bw"] = np.where(grid > 0, np.log(np.maximum(grid, 1)), -30).astype(np.float32)
    held = np.concatenate((grid.sum(axis=1), groups[:-1]))
    p["bc"] = np.append(np.where(held > 0, np.log(np.maximum(held, 1)), -30), np.log(groups[-1] + 1)).astype(np.float32)
    p["bx"][:] = 0
    p["wc"] *= 0
    p["ww"] *= 0
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.reshape(-1) for v in p.values()])


def unflat(v: np.ndarray, classes: int, size: int, groups: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(classes, size, groups).items():
        out[k] = v[at : at + int(np.prod(s))].reshape(s).astype(np.float32)
        at += int(np.prod(s))
    return out


def step(p, x: np.ndarray, h: np.ndarray):
    """The next state, and what backpropagation needs. Columns are cases, so that gates are whole rows."""
    n, k = HIDDEN, p["u"].T @ h
    gates = x[: 2 * n] + k[: 2 * n]
    np.exp(np.negative(gates, out=gates), out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    z, r, kn = gates[:n], gates[n:], k[2 * n :]
    new = r * kn
    new += x[2 * n :]
    np.tanh(new, out=new)
    after = h - new
    after *= z
    after += new
    return after, (h, z, r, kn, new)


def _softmax(x: np.ndarray, wanted: np.ndarray, grads: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Columns of x are cases (sums run along whole rows, so they vectorise): each one's log-probability, and the gradient of its loss."""
    x -= x.max(axis=0)
    cases = np.arange(x.shape[1])
    told = x[wanted, cases]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    if not grads:
        return told - np.log(total), None
    x /= total
    x[wanted, cases] -= 1
    return told - np.log(total), x


def outputs(p, h: np.ndarray, ids: np.ndarray, size: int, grads: dict | None = None):
    """Natural log-probabilities of the ids after the states h; with grads, adds to them and gives the states' gradients too.

    A one behind each state makes biases a row of the weights, so that products add them and sum their gradients.
    """
    classes, n, learns = len(p["bw"]), HIDDEN, grads is not None
    c = np.where(ids < classes * size, ids // size, ids - classes * (size - 1))
    order = np.argsort(c.astype(np.int16), kind="stable")
    ids, c, ones = ids[order], c[order], np.ones((len(ids), n + 1), h.dtype)
    ones[:, :n] = h[order]
    w, score, dh, dw = np.vstack((p["wc"], p["bc"])), np.empty(len(ids), h.dtype), None, 0
    if learns:
        dh = np.empty((len(ids), n), h.dtype)
    for a in range(0, len(ids), AT_ONCE):  # as many as a core's own cache holds
        part = slice(a, a + AT_ONCE)
        score[part], d = _softmax(w.T @ ones[part].T, c[part], learns)
        if learns:
            dw += d @ ones[part]
            np.matmul(d.T, p["wc"].T, out=dh[part])
    # Words: each class fills its columns, and one softmax does all.
    cuts = np.searchsorted(c, np.arange(classes + 1)).tolist()
    own, w = cuts[-1], np.concatenate((p["ww"], p["bw"][:, None]), axis=1)
    parts = [(k, slice(cuts[k], cuts[k + 1])) for k in range(classes) if cuts[k + 1] > cuts[k]]
    x = np.empty((size, own), h.dtype)
    for k, rows in parts:
        np.matmul(w[k].T, ones[rows].T, out=x[:, rows])
    told, d = _softmax(x, ids[:own] - c[:own] * size, learns)
    score[:own] += told
    out = np.empty(len(ids))
    out[order] = score
    if not learns:
        return out, None
    grads["wc"], grads["bc"] = dw[:, :n].T, dw[:, n]
    dw = np.zeros((classes, size, n + 1), h.dtype)
    for k, rows in parts:
        np.matmul(d[:, rows], ones[rows], out=dw[k])
        dh[rows] += d[:, rows].T @ p["ww"][k].T
    grads["ww"], grads["bw"] = dw[:, :, :n].transpose(0, 2, 1), dw[:, :, n]
    back = np.empty_like(dh)
    back[order] = dh
    return out, back


class Trainer:
    """Learns from a stream of ids in lanes that run side by side, states carried from window to window (Adagrad)."""

    def __init__(self, p: dict[str, np.ndarray], size: int, end: int, seen: dict[str, np.ndarray] | None = None) -> None:
        self.p, self.size, self.end = {k: v.copy() for k, v in p.items()}, size, end
        self.seen = {k: v.copy() for k, v in seen.items()} if seen else {k: np.full_like(v, SEEN) for k, v in p.items()}
        self.room: list[np.ndarray] | None = None

    def learn(self, ids: np.ndarray) -> None:
        lanes = max(1, min(LANES, len(ids) // (UPDATES * WINDOW)))
        length = -(-len(ids) // lanes)
        ids = np.append(ids, np.full(lanes * length - len(ids), self.end, ids.dtype))  # empty documents fill the last lane
        grid = np.concatenate((np.full((1, lanes), self.end), ids.reshape(lanes, length).T))
        h = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(0, length, WINDOW):
            h = self._window(grid[t : t + WINDOW], grid[t + 1 : t + WINDOW + 1], h)

    def _window(self, seen: np.ndarray, wanted: np.ndarray, h: np.ndarray) -> np.ndarray:
        p, n, t = self.p, HIDDEN, len(wanted)
        seen = seen[:t]
        lanes, at = len(h), seen.reshape(-1)
        if self.room is None or self.room[0].shape[1] != t * lanes:  # kept from window to window, so that memory isn't asked for again
            self.room = [np.empty((k * n, t * lanes), p["u"].dtype) for k in (3, 3, 3, 1)] + [np.empty((t * lanes, n), p["u"].dtype)]
        x, dx, dk_all, befores, states = self.room
        e = p["emb"][at]
        np.matmul(p["wx"].T, e.T, out=x)
        x += p["bx"][:, None]
        kept, live, h = [], (seen != self.end).astype(x.dtype), h.T
        parts = [slice(i * lanes, (i + 1) * lanes) for i in range(t)]
        for i in range(t):
            before = np.multiply(h, live[i], out=befores[:, parts[i]])  # a document begins without a state
            h, k = step(p, x[:, parts[i]], before)
            states[parts[i]] = h.T
            kept.append(k)
        g: dict[str, np.ndarray] = {}
        _, dh_all = outputs(p, states, wanted.reshape(-1), self.size, g)
        dh = np.zeros((n, lanes), x.dtype)
        for i in range(t - 1, -1, -1):
            before, z, r, kn, new = kept[i]
            dh += dh_all[parts[i]].T
            dnew = dh * (1 - z)
            dz = before - new
            dz *= z
            dz *= dnew
            dnew *= 1 - new * new
            dr = dnew * kn
            dr *= r
            dr *= 1 - r
            d, dk = dx[:, parts[i]], dk_all[:, parts[i]]
            d[:n], d[n : 2 * n], d[2 * n :] = dz, dr, dnew
            dk[:n], dk[n : 2 * n] = dz, dr
            np.multiply(dnew, r, out=dk[2 * n :])
            dh *= z
            dh += p["u"] @ dk
            dh *= live[i]
        g["u"] = befores @ dk_all.T
        g["wx"], g["bx"] = (dx @ e).T, dx.sum(axis=1)
        de = p["wx"] @ dx
        g["emb"] = np.stack([np.bincount(at, d, len(p["emb"])) for d in de], axis=1).astype(p["emb"].dtype)
        scale = 1 / wanted.size
        for k, v in g.items():
            v = np.multiply(v, scale, order="C")
            self.seen[k] += v * v
            v *= RATE
            v /= np.sqrt(self.seen[k])
            p[k] -= v
        return h.T


def score_documents(p, ids: list[np.ndarray], size: int, end: int) -> np.ndarray:
    """The natural log-probability of each whole document (its ids, the end included). Documents run side by side, ``ABREAST`` at once, longest first."""
    order = np.argsort([-len(x) for x in ids], kind="stable")
    projected, out = np.ascontiguousarray((p["emb"] @ p["wx"] + p["bx"]).T), np.zeros(len(ids))
    for a in range(0, len(ids), ABREAST):
        mine = order[a : a + ABREAST]
        out[mine] = _abreast(p, projected, [ids[i] for i in mine], size, end)
    return out


def _abreast(p, projected: np.ndarray, ids: list[np.ndarray], size: int, end: int) -> np.ndarray:
    """The same of documents that are sorted by falling length."""
    lengths, total, each = np.array([len(x) for x in ids]), np.zeros(len(ids)), np.arange(len(ids))
    h, block = np.zeros((HIDDEN, len(ids)), np.float32), 64
    last = np.full(len(ids), end)
    states, wanted, rows = np.empty((block * len(ids), HIDDEN), np.float32), np.empty(block * len(ids), last.dtype), np.empty(block * len(ids), np.int64)
    for t in range(0, int(lengths.max(initial=0)), block):
        live, n = int(np.searchsorted(-lengths, -t, side="left")), 0
        grid = np.full((block, live), end)
        for i in range(live):
            x = ids[i][t : t + block]
            grid[: len(x), i] = x
        for i, now in enumerate(np.searchsorted(t - lengths[:live], -np.arange(block), side="left").tolist()):
            if not now:
                break
            h[:, :now], _ = step(p, projected.take(last[:now], axis=1, mode="clip"), h[:, :now])
            last[:now] = grid[i, :now]
            states[n : n + now], wanted[n : n + now], rows[n : n + now] = h[:, :now].T, last[:now], each[:now]
            n += now
        for i in range(0, n, CASES):
            part = slice(i, min(i + CASES, n))
            total[:live] += np.bincount(rows[part], outputs(p, states[part], wanted[part], size)[0], live)
    return total
