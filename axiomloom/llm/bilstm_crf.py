"""A character-level bidirectional LSTM with CRF transitions in numpy."""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def init(classes: int, hidden: int, tags: int, seed: int = 1) -> Params:
    rng = np.random.default_rng(seed)
    mat = lambda *s, k=0.2: rng.normal(0, k, s).astype(np.float32)
    p = {"out": mat(2 * hidden, tags), "out_b": np.zeros(tags, np.float32), "step": mat(tags, tags), "first": mat(tags)}
    for d in ("f", "b"):
        bias = np.zeros(4 * hidden, np.float32)
        bias[hidden:2 * hidden] = 1  # forget gates start open
        p |= {f"{d}_in": mat(classes, 4 * hidden), f"{d}_rec": mat(hidden, 4 * hidden), f"{d}_bias": bias}
    return p


def _lstm(ids: np.ndarray, inp: np.ndarray, rec: np.ndarray, bias: np.ndarray, keep: bool):
    """ids (T, B) -> states (T, B, H). The input matrix is looked up by class."""
    steps, batch = ids.shape
    size = rec.shape[0]
    h = c = np.zeros((batch, size), np.float32)
    states, cache = np.empty((steps, batch, size), np.float32), []
    for t in range(steps):
        g = inp[ids[t]] + h @ rec + bias
        s = _sigmoid(g[:, :3 * size])
        i, f, o = s[:, :size], s[:, size:2 * size], s[:, 2 * size:]
        a = np.tanh(g[:, 3 * size:])
        before, c = c, f * c + i * a
        tc = np.tanh(c)
        if keep:
            cache.append((i, f, o, a, before, tc, h))
        h = o * tc
        states[t] = h
    return states, cache


def _lstm_back(ids: np.ndarray, rec: np.ndarray, cache: list, d_states: np.ndarray, classes: int):
    size = rec.shape[0]
    d_in, d_rec, d_bias = np.zeros((classes, 4 * size), np.float32), np.zeros_like(rec), np.zeros(4 * size, np.float32)
    dh = dc = np.zeros(d_states.shape[1:], np.float32)
    for t in range(len(ids) - 1, -1, -1):
        i, f, o, a, before, tc, h_before = cache[t]
        dh = dh + d_states[t]
        dc = dc + dh * o * (1 - tc * tc)
        dg = np.concatenate([dc * a * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - a * a)], axis=1)
        np.add.at(d_in, ids[t], dg)
        d_rec += h_before.T @ dg
        d_bias += dg.sum(axis=0)
        dh, dc = dg @ rec.T, dc * f
    return d_in, d_rec, d_bias


def _states(p: Params, ids: np.ndarray, keep: bool):
    f, fc = _lstm(ids, p["f_in"], p["f_rec"], p["f_bias"], keep)
    b, bc = _lstm(ids[::-1], p["b_in"], p["b_rec"], p["b_bias"], keep)
    return np.concatenate([f, b[::-1]], axis=2), fc, bc


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _alphas_betas(p: Params, e: np.ndarray):
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + p["first"]
    for t in range(1, len(e)):
        alpha[t] = e[t] + _lse(alpha[t - 1][:, :, None] + p["step"][None], 1)
    for t in range(len(e) - 2, -1, -1):
        beta[t] = _lse(p["step"][None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    return alpha, beta, _lse(alpha[-1], 1)


def marginals(p: Params, ids: np.ndarray) -> np.ndarray:
    """ids (B, T) -> posterior of each tag at each place (B, T, tags)."""
    e = _states(p, ids.T, False)[0] @ p["out"] + p["out_b"]
    alpha, beta, total = _alphas_betas(p, e)
    return np.exp(alpha + beta - total[None, :, None]).transpose(1, 0, 2)


def gradients(p: Params, ids: np.ndarray, tags: np.ndarray) -> tuple[float, Params]:
    """Negative log likelihood per window, and its gradients. ids, tags: (B, T)."""
    ids, tags = ids.T, tags.T
    batch = ids.shape[1]
    s, fc, bc = _states(p, ids, True)
    e = s @ p["out"] + p["out_b"]
    alpha, beta, total = _alphas_betas(p, e)
    at = np.arange(batch)
    gold = p["first"][tags[0]] + e[0, at, tags[0]]
    d_e = np.exp(alpha + beta - total[None, :, None])
    d_first = d_e[0].sum(axis=0)
    np.add.at(d_first, tags[0], -1)
    d_step = np.zeros_like(p["step"])
    for t in range(1, len(ids)):
        gold = gold + p["step"][tags[t - 1], tags[t]] + e[t, at, tags[t]]
        pair = alpha[t - 1][:, :, None] + p["step"][None] + (e[t] + beta[t])[:, None, :] - total[:, None, None]
        d_step += np.exp(pair).sum(axis=0)
        np.add.at(d_step, (tags[t - 1], tags[t]), -1)
    for t in range(len(ids)):
        d_e[t, at, tags[t]] -= 1
    g = {"out": np.einsum("tbh,tbk->hk", s, d_e), "out_b": d_e.sum(axis=(0, 1)), "first": d_first, "step": d_step}
    d_s = d_e @ p["out"].T
    half, classes = s.shape[2] // 2, p["f_in"].shape[0]
    g["f_in"], g["f_rec"], g["f_bias"] = _lstm_back(ids, p["f_rec"], fc, d_s[:, :, :half], classes)
    g["b_in"], g["b_rec"], g["b_bias"] = _lstm_back(ids[::-1], p["b_rec"], bc, d_s[::-1, :, half:], classes)
    return float((total - gold).mean()), {k: v / batch for k, v in g.items()}


def fit(ids: np.ndarray, tags: np.ndarray, classes: int, n_tags: int, hidden: int, epochs: int, batch: int = 64,
        rate: float = 0.01, seed: int = 1) -> Params:
    """Adam over shuffled windows, gradients clipped to norm 5."""
    p = init(classes, hidden, n_tags, seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for lo in range(0, len(order), batch):
            pick = order[lo:lo + batch]
            _, g = gradients(p, ids[pick], tags[pick])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            step += 1
            for k, x in g.items():
                x = x * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.999 * v[k] + 0.001 * x * x
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p
