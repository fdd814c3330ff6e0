"""Hyper-parameters of trials: random draws, and a tree-structured Parzen estimator over finished trials.

A space maps names to ranges [least, most, step]. A trial's values are flat: a CNN with ``layers`` has channels and
kernels for each layer (``conv_channels.0``), which exist only in trials with as many layers; that is the tree.

Each parameter is sampled on its own. The finished trials that have it are split by loss into the few best and the
others; both make a density over the range's options, a kernel around each value and one flat kernel; of several
options drawn from the density of the best, the one with the highest ratio of the two is taken. Trials that are still
running count among the others, so a round of several trials spreads out. The first STARTUP trials are random.
"""

from __future__ import annotations

import math

import numpy as np

#: Search spaces by family: the names that may be ranged, besides those of every family.
SPACES = {
    "linear": (),
    "cnn": ("conv_channels", "kernel_size", "layers", "stride", "padding", "dilation"),
    "lstm": ("hidden_size", "lstm_size"),
    "transformer": ("embedding_size", "num_heads", "dim_feedforward", "num_layers"),
}
COMMON = ("epochs", "learning_rate", "dropout", "sequence_size")
PER_LAYER = ("conv_channels", "kernel_size")

#: Trials before the densities are used; candidates of each choice; share and largest number of the best.
STARTUP, CANDIDATES, SHARE, MOST_GOOD = 10, 24, 0.15, 25

Flat = dict[str, float]


def options(low: float, high: float, step: float) -> int:
    return int(math.floor((high - low) / step + 1e-9)) + 1


def value_of(bounds: list, i: int) -> float:
    """The i-th option of a range; a float where its bounds or step are."""
    low, _, step = bounds
    value = low + step * i
    return value if isinstance(low, float) or isinstance(step, float) else int(value)


def density(k: int, at: np.ndarray) -> np.ndarray:
    """Probabilities of k options from the options seen: a normal kernel around each, cut to the range, and a flat one.

    A kernel is as wide as the gap to the farther of its neighbours (or the range's end), but no narrower than the
    range divided by the number of kernels.
    """
    out = np.full(k, 1 / k)
    if not len(at):
        return out
    seen = np.sort(at.astype(float))
    edges = np.concatenate([[-0.5], seen, [k - 0.5]])
    width = np.clip(np.maximum(seen - edges[:-2], edges[2:] - seen), k / min(100, 1 + len(seen)), k)
    bounds = (np.arange(k + 1) - 0.5 - seen[:, None]) / (width[:, None] * math.sqrt(2))
    mass = np.diff(np.vectorize(math.erf)(bounds), axis=1)
    return (out + (mass / mass.sum(1, keepdims=True)).sum(0)) / (1 + len(seen))


def choose(bounds: list, good: list[float], others: list[float], rng: np.random.Generator) -> float:
    """An option that is likely among the good trials' values and unlikely among the others'."""
    low, _, step = bounds
    k = options(*bounds)
    index = [np.clip(np.rint((np.array(v, float) - low) / step), 0, k - 1) for v in (good, others)]
    likely, unlikely = density(k, index[0]), density(k, index[1])
    drawn = rng.choice(k, CANDIDATES, p=likely / likely.sum())
    return value_of(bounds, int(drawn[np.argmax(likely[drawn] / unlikely[drawn])]))


def check_space(space: dict, family: str | None) -> None:
    if family and (unknown := set(space) - {*SPACES[family], *COMMON}):
        raise ValueError(f"no parameters of {family}: {sorted(unknown)}")


def propose(space: dict, finished: list[tuple[Flat, float]], pending: list[Flat], trial: int, seed: int = 0, family: str | None = None) -> Flat:
    """The flat values of a trial; the same for the same trial, seed, finished and pending trials."""
    check_space(space, family)
    rng = np.random.default_rng((seed, trial))
    ordered = [flat for flat, _ in sorted(finished, key=lambda t: math.inf if t[1] is None or math.isnan(t[1]) else t[1])]

    def pick(name: str, bounds: list) -> float:
        seen = [flat[name] for flat in ordered if name in flat]
        if len(seen) < STARTUP:
            return value_of(bounds, int(rng.integers(options(*bounds))))
        n = min(MOST_GOOD, math.ceil(SHARE * len(seen)))
        return choose(bounds, seen[:n], seen[n:] + [flat[name] for flat in pending if name in flat], rng)

    layered = "layers" in space
    out = {name: pick(name, bounds) for name, bounds in space.items() if not (layered and name in PER_LAYER)}
    for i in range(out.get("layers", 0)):
        out |= {f"{name}.{i}": pick(f"{name}.{i}", space[name]) for name in PER_LAYER}
    return out


def parameters(flat: Flat) -> dict:
    """A model's parameters: lists for the layers; an embedding is widened to a multiple of its heads."""
    out = {name: v for name, v in flat.items() if "." not in name}
    layers = out.pop("layers", None)
    if layers is not None:
        out |= {name: [flat[f"{name}.{i}"] for i in range(layers)] for name in PER_LAYER}
    if "num_heads" in out and "embedding_size" in out:
        out["embedding_size"] = -(-out["embedding_size"] // out["num_heads"]) * out["num_heads"]
    return out


def draw(space: dict, trial: int, seed: int = 0, family: str | None = None) -> dict:
    """The parameters of a trial at random."""
    return parameters(propose(space, [], [], trial, seed, family))
