"""Exact gradients of the networks' mean loss by reverse differentiation, in NumPy.

Each ``_..._forward`` returns its output and a function from the output's gradient to the input's, which adds
the weights' gradients to ``grads``. Dropout draws its masks in the order of ``networks.encode``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .networks import as_list, sigmoid

Back = Callable[[np.ndarray], np.ndarray]


def _drop(x: np.ndarray, share: float, rng: np.random.Generator | None) -> tuple[np.ndarray, Back]:
    if rng is None or not share:
        return x, lambda d: d
    mask = (rng.random(x.shape) >= share) / (1 - share)
    return x * mask, lambda d: d * mask


def _dense(x: np.ndarray, w: dict, at: str, grads: dict) -> tuple[np.ndarray, Back]:
    """x @ w.T + b over the last axis."""

    def back(d: np.ndarray) -> np.ndarray:
        flat, inputs = d.reshape(-1, d.shape[-1]), x.reshape(-1, x.shape[-1])
        grads[f"{at}.w"] = flat.T @ inputs
        grads[f"{at}.b"] = flat.sum(0)
        return d @ w[f"{at}.w"]

    return x @ w[f"{at}.w"].T + w[f"{at}.b"], back


def _relu(x: np.ndarray) -> tuple[np.ndarray, Back]:
    return np.maximum(x, 0), lambda d: d * (x > 0)


def _conv(x: np.ndarray, w: dict, at: str, grads: dict, stride: int, padding: int, dilation: int) -> tuple[np.ndarray, Back]:
    kernel = w[f"{at}.w"]
    padded = np.pad(x, ((0, 0), (0, 0), (padding, padding)))
    reach = dilation * (kernel.shape[2] - 1) + 1
    view = np.lib.stride_tricks.sliding_window_view(padded, reach, axis=2)[:, :, ::stride, ::dilation]

    def back(d: np.ndarray) -> np.ndarray:
        grads[f"{at}.w"] = np.einsum("not,nctk->ock", d, view)
        grads[f"{at}.b"] = d.sum((0, 2))
        out, last = np.zeros(padded.shape), stride * (d.shape[2] - 1) + 1
        for k in range(kernel.shape[2]):
            out[:, :, k * dilation : k * dilation + last : stride] += np.einsum("not,oc->nct", d, kernel[:, :, k])
        return out[:, :, padding : padding + x.shape[2]]

    return np.einsum("nctk,ock->not", view, kernel) + w[f"{at}.b"][None, :, None], back


def _lstm(x: np.ndarray, w: dict, at: str, grads: dict) -> tuple[np.ndarray, Back]:
    wx, wh, b = w[f"{at}.x"], w[f"{at}.h"], w[f"{at}.b"]
    n, steps, _ = x.shape
    h, c, out, held = np.zeros((n, wh.shape[1])), np.zeros((n, wh.shape[1])), [], []
    for t in range(steps):
        i, f, g, o = np.split(x[:, t] @ wx.T + h @ wh.T + b, 4, axis=1)
        i, f, g, o = sigmoid(i), sigmoid(f), np.tanh(g), sigmoid(o)
        after = f * c + i * g
        held.append((i, f, g, o, c, h, np.tanh(after)))
        h, c = o * np.tanh(after), after
        out.append(h)

    def back(d: np.ndarray) -> np.ndarray:
        dwx, dwh, db, dx = np.zeros(wx.shape), np.zeros(wh.shape), np.zeros(b.shape), np.zeros(x.shape)
        dh, dc = np.zeros_like(h), np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            i, f, g, o, before, h_before, squashed = held[t]
            dh = dh + d[:, t]
            dc = dc + dh * o * (1 - squashed**2)
            gates = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - g**2), dh * squashed * o * (1 - o)], axis=1)
            dwx += gates.T @ x[:, t]
            dwh += gates.T @ h_before
            db += gates.sum(0)
            dx[:, t] = gates @ wx
            dh, dc = gates @ wh, dc * f
        grads[f"{at}.x"], grads[f"{at}.h"], grads[f"{at}.b"] = dwx, dwh, db
        return dx

    return np.stack(out, axis=1), back


def _norm(x: np.ndarray, w: dict, at: str, grads: dict) -> tuple[np.ndarray, Back]:
    scale = np.sqrt(x.var(-1, keepdims=True) + 1e-5)
    unit = (x - x.mean(-1, keepdims=True)) / scale

    def back(d: np.ndarray) -> np.ndarray:
        grads[f"{at}.w"], grads[f"{at}.b"] = (d * unit).sum((0, 1)), d.sum((0, 1))
        u = d * w[f"{at}.w"]
        return (u - u.mean(-1, keepdims=True) - unit * (u * unit).mean(-1, keepdims=True)) / scale

    return unit * w[f"{at}.w"] + w[f"{at}.b"], back


def _attention(x: np.ndarray, w: dict, at: str, grads: dict, heads: int, share: float, rng) -> tuple[np.ndarray, Back]:
    n, steps, e = x.shape
    size = e // heads
    mixed, back_in = _dense(x, w, f"{at}.qkv", grads)
    q, k, v = (y.reshape(n, steps, heads, size).transpose(0, 2, 1, 3) for y in np.split(mixed, 3, axis=2))
    score = q @ k.transpose(0, 1, 3, 2) / np.sqrt(size)
    score = np.exp(score - score.max(-1, keepdims=True))
    score /= score.sum(-1, keepdims=True)
    kept, back_drop = _drop(score, share, rng)
    out, back_out = _dense((kept @ v).transpose(0, 2, 1, 3).reshape(n, steps, e), w, f"{at}.out", grads)

    def back(d: np.ndarray) -> np.ndarray:
        d = back_out(d).reshape(n, steps, heads, size).transpose(0, 2, 1, 3)
        dv, ds = kept.transpose(0, 1, 3, 2) @ d, back_drop(d @ v.transpose(0, 1, 3, 2))
        ds = score * (ds - (ds * score).sum(-1, keepdims=True)) / np.sqrt(size)
        parts = (ds @ k, ds.transpose(0, 1, 3, 2) @ q, dv)
        return back_in(np.concatenate([p.transpose(0, 2, 1, 3).reshape(n, steps, e) for p in parts], axis=2))

    return out, back


def _encoded(model: dict, x: np.ndarray, grads: dict, rng) -> tuple[np.ndarray, Back]:
    spec, w = model["spec"], model["weights"]
    share, family, backs = spec.get("dropout", 0), spec["family"], []

    def then(result: tuple[np.ndarray, Back]) -> np.ndarray:
        backs.append(result[1])
        return result[0]

    if family == "linear":
        return x.reshape(len(x), -1), lambda d: d
    if family == "cnn":
        x = x.transpose(0, 2, 1)
        for i in range(len(as_list(spec["conv_channels"]))):
            x = then(_relu(then(_conv(x, w, f"conv{i}", grads, spec.get("stride", 1), spec.get("padding", 0), spec.get("dilation", 1)))))
        shape = x.shape
        x = then((x.reshape(len(x), -1), lambda d: d.reshape(shape)))
    elif family == "lstm":
        for i in range(spec["lstm_size"]):
            x = then(_lstm(x, w, f"lstm{i}", grads))
        x = then(_last(x))
    else:
        x = then(_dense(x, w, "embed", grads))

        def place(d: np.ndarray) -> np.ndarray:
            grads["place"] = d.sum(0)
            return d

        x = then((x + w["place"], place))
        for i in range(spec["num_layers"]):
            x = then(_layer(x, w, f"enc{i}", grads, spec["num_heads"], share, rng))
        x = then(_last(x))
    x = then(_drop(x, share, rng))

    def back(d: np.ndarray) -> np.ndarray:
        for b in reversed(backs):
            d = b(d)
        return d

    return x, back


def _last(x: np.ndarray) -> tuple[np.ndarray, Back]:
    def back(d: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        out[:, -1] = d
        return out

    return x[:, -1], back


def _layer(x: np.ndarray, w: dict, at: str, grads: dict, heads: int, share: float, rng) -> tuple[np.ndarray, Back]:
    """A transformer layer: attention and feed-forward, each dropped out, added to its input and normalised."""
    mixed, back_mix = _attention(x, w, at, grads, heads, share, rng)
    mixed, back_drop1 = _drop(mixed, share, rng)
    middle, back_n1 = _norm(x + mixed, w, f"{at}.n1", grads)
    up, back_up = _dense(middle, w, f"{at}.up", grads)
    up, back_relu = _relu(up)
    up, back_drop2 = _drop(up, share, rng)
    down, back_down = _dense(up, w, f"{at}.down", grads)
    down, back_drop3 = _drop(down, share, rng)
    out, back_n2 = _norm(middle + down, w, f"{at}.n2", grads)

    def back(d: np.ndarray) -> np.ndarray:
        d = back_n2(d)
        d = d + back_up(back_relu(back_drop2(back_down(back_drop3(d)))))
        d = back_n1(d)
        return d + back_mix(back_drop1(d))

    return out, back


def gradients(model: dict, x: np.ndarray, z: np.ndarray | None, target: np.ndarray, rng: np.random.Generator | None = None) -> dict:
    """The gradient of the mean loss by every weight; with dropout where ``rng`` is given."""
    grads: dict[str, np.ndarray] = {}
    h, back = _encoded(model, np.asarray(x, np.float64), grads, rng)
    width, w = h.shape[1], model["weights"]
    if model["spec"]["exogenous"]:
        h = np.concatenate([h, np.asarray(z, np.float64).reshape(len(h), -1)], axis=1)
    miss = (sigmoid(h @ w["head.w"] + w["head.b"][0]) - target) / len(target)
    back(np.outer(miss, w["head.w"][:width]))
    return {**grads, "head.w": miss @ h, "head.b": np.array([miss.sum()])}
