"""Forward passes of the sequence classifiers in NumPy: x is (samples, steps, features), the result a logit per sample.

Every model ends in one linear head over its encoding and, where it has exogenous inputs, z. Dropout
(of the encoding, and of the transformer's attention and sub-layers) acts where an ``rng`` is given, in training only. Weights are plain arrays in a dict, so a model is broadcast as data.
"""

from __future__ import annotations

import numpy as np

BOOK, TRADE_BOOK = 22, 29
FAMILIES = ("linear", "cnn", "lstm", "transformer")
#: Variants by input: features, exogenous inputs.
VARIANTS = {"lob": (BOOK, 0), "trade_lob": (TRADE_BOOK, 0), "exogenous_trade_lob": (TRADE_BOOK, 2)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def conv_steps(steps: int, kernels: list[int], stride: int = 1, padding: int = 0, dilation: int = 1) -> int:
    """Steps that are left behind all convolutions; too few is an error."""
    for k in kernels:
        steps = (steps + 2 * padding - dilation * (k - 1) - 1) // stride + 1
        if steps < 1:
            raise ValueError("too few steps for the convolutions")
    return steps


def as_list(x) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


def build(family: str, features: int, sequence: int, exogenous: int = 0, seed: int = 0, **p) -> dict:
    """A model with freshly drawn weights (uniform within 1 / sqrt(inputs))."""
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family}")
    if not 0 <= p.get("dropout", 0) < 1 or (family == "linear" and p.get("dropout")):
        raise ValueError("dropout must be in [0, 1), and the linear model has none")
    rng = np.random.default_rng(seed)

    def draw(*shape: int, fan: int) -> np.ndarray:
        return rng.uniform(-1, 1, shape) / np.sqrt(fan)

    w: dict[str, np.ndarray] = {}
    spec = {"family": family, "features": features, "sequence": sequence, "exogenous": exogenous, **p}
    if family == "linear":
        width = features * sequence
    elif family == "cnn":
        channels, kernels = as_list(p["conv_channels"]), as_list(p["kernel_size"])
        inputs = features
        for i, (c, k) in enumerate(zip(channels, kernels, strict=True)):
            w[f"conv{i}.w"], w[f"conv{i}.b"] = draw(c, inputs, k, fan=inputs * k), draw(c, fan=inputs * k)
            inputs = c
        width = inputs * conv_steps(sequence, kernels, p.get("stride", 1), p.get("padding", 0), p.get("dilation", 1))
    elif family == "lstm":
        h = p["hidden_size"]
        for i in range(p["lstm_size"]):
            n = features if i == 0 else h
            w[f"lstm{i}.x"], w[f"lstm{i}.h"], w[f"lstm{i}.b"] = draw(4 * h, n, fan=h), draw(4 * h, h, fan=h), draw(4 * h, fan=h)
        width = h
    else:
        e, f = p["embedding_size"], p["dim_feedforward"]
        if e % p["num_heads"]:
            raise ValueError("embedding_size must be a multiple of num_heads")
        w["embed.w"], w["embed.b"], w["place"] = draw(e, features, fan=features), draw(e, fan=features), rng.standard_normal((sequence, e))
        for i in range(p["num_layers"]):
            w |= {f"enc{i}.qkv.w": draw(3 * e, e, fan=e), f"enc{i}.qkv.b": np.zeros(3 * e), f"enc{i}.out.w": draw(e, e, fan=e), f"enc{i}.out.b": np.zeros(e)}
            w |= {f"enc{i}.up.w": draw(f, e, fan=e), f"enc{i}.up.b": draw(f, fan=e), f"enc{i}.down.w": draw(e, f, fan=f), f"enc{i}.down.b": draw(e, fan=f)}
            w |= {f"enc{i}.n1.w": np.ones(e), f"enc{i}.n1.b": np.zeros(e), f"enc{i}.n2.w": np.ones(e), f"enc{i}.n2.b": np.zeros(e)}
        width = e
    w["head.w"], w["head.b"] = draw(width + exogenous, fan=width + exogenous), draw(1, fan=width + exogenous)
    return {"spec": spec, "weights": w}


def _conv(x: np.ndarray, w: np.ndarray, b: np.ndarray, stride: int, padding: int, dilation: int) -> np.ndarray:
    """x: (samples, channels, steps)."""
    x = np.pad(x, ((0, 0), (0, 0), (padding, padding)))
    reach = dilation * (w.shape[2] - 1) + 1
    view = np.lib.stride_tricks.sliding_window_view(x, reach, axis=2)[:, :, ::stride, ::dilation]
    return np.einsum("nctk,ock->not", view, w) + b[None, :, None]


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All hidden states; gates in the order input, forget, cell, output."""
    n, steps, _ = x.shape
    size = wh.shape[1]
    h, c, out = np.zeros((n, size)), np.zeros((n, size)), []
    for t in range(steps):
        i, f, g, o = np.split(x[:, t] @ wx.T + h @ wh.T + b, 4, axis=1)
        c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
        h = sigmoid(o) * np.tanh(c)
        out.append(h)
    return np.stack(out, axis=1)


def _norm(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    mean, var = x.mean(-1, keepdims=True), x.var(-1, keepdims=True)
    return (x - mean) / np.sqrt(var + 1e-5) * w + b


def _drop(x: np.ndarray, share: float, rng: np.random.Generator | None) -> np.ndarray:
    """x with a share of its values at 0 and the others scaled up; without ``rng`` x itself."""
    return x if rng is None or not share else x * (rng.random(x.shape) >= share) / (1 - share)


def _attention(x: np.ndarray, w: dict, at: str, heads: int, share: float = 0, rng: np.random.Generator | None = None) -> np.ndarray:
    n, steps, e = x.shape
    q, k, v = (y.reshape(n, steps, heads, e // heads).transpose(0, 2, 1, 3) for y in np.split(x @ w[f"{at}.qkv.w"].T + w[f"{at}.qkv.b"], 3, axis=2))
    score = q @ k.transpose(0, 1, 3, 2) / np.sqrt(e // heads)
    score = np.exp(score - score.max(-1, keepdims=True))
    mixed = _drop(score / score.sum(-1, keepdims=True), share, rng) @ v
    return mixed.transpose(0, 2, 1, 3).reshape(n, steps, e) @ w[f"{at}.out.w"].T + w[f"{at}.out.b"]


def encode(model: dict, x: np.ndarray, rng: np.random.Generator | None = None) -> np.ndarray:
    """What the head reads of x, without z; with dropout where ``rng`` is given."""
    spec, w = model["spec"], model["weights"]
    share = spec.get("dropout", 0)
    if x.ndim == 2:  # a single sample
        x = x[None]
    family = spec["family"]
    if family == "linear":
        return x.reshape(len(x), -1)
    if family == "cnn":
        x = x.transpose(0, 2, 1)
        for i in range(len(as_list(spec["conv_channels"]))):
            x = np.maximum(_conv(x, w[f"conv{i}.w"], w[f"conv{i}.b"], spec.get("stride", 1), spec.get("padding", 0), spec.get("dilation", 1)), 0)
        return _drop(x.reshape(len(x), -1), share, rng)
    if family == "lstm":
        for i in range(spec["lstm_size"]):
            x = _lstm(x, w[f"lstm{i}.x"], w[f"lstm{i}.h"], w[f"lstm{i}.b"])
        return _drop(x[:, -1], share, rng)
    x = x @ w["embed.w"].T + w["embed.b"] + w["place"]
    for i in range(spec["num_layers"]):
        at = f"enc{i}"
        x = _norm(x + _drop(_attention(x, w, at, spec["num_heads"], share, rng), share, rng), w[f"{at}.n1.w"], w[f"{at}.n1.b"])
        up = _drop(np.maximum(x @ w[f"{at}.up.w"].T + w[f"{at}.up.b"], 0), share, rng)
        x = _norm(x + _drop(up @ w[f"{at}.down.w"].T + w[f"{at}.down.b"], share, rng), w[f"{at}.n2.w"], w[f"{at}.n2.b"])
    return _drop(x[:, -1], share, rng)


def logits(model: dict, x: np.ndarray, z: np.ndarray | None = None, rng: np.random.Generator | None = None) -> np.ndarray:
    h = encode(model, np.asarray(x, np.float64), rng)
    if model["spec"]["exogenous"]:
        h = np.concatenate([h, np.asarray(z, np.float64).reshape(len(h), -1)], axis=1)
    return h @ model["weights"]["head.w"] + model["weights"]["head.b"][0]


def loss_of(z: np.ndarray, target: np.ndarray) -> float:
    return float(np.mean(np.maximum(z, 0) - z * target + np.log1p(np.exp(-np.abs(z)))))
