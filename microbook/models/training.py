"""Training with Adam on binary cross-entropy, one day per batch in date order, with early stopping. Gradients are exact.

Dropout is drawn by row: its masks depend on the seed, the epoch and the row's key, not on which rows are computed
together, so training gives the same model wherever the rows are.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

import numpy as np

from . import networks
from .backward import gradients

#: A day: x, z (or None), target, and the rows' keys (or none, then their numbers).
Day = tuple


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, weights: dict, gradient: dict) -> None:
        self.t += 1
        for k, g in gradient.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0.0) + 0.1 * g
            v = self.v[k] = 0.999 * self.v.get(k, 0.0) + 0.001 * g * g
            weights[k] = weights[k] - self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


class RowDraws:
    """Random numbers for dropout, a stream for each row; ``random`` as a generator has it, rows first."""

    def __init__(self, seed: int, epoch: int, keys: np.ndarray):
        self.rows = [np.random.Generator(np.random.Philox(key=[(seed << 32) + epoch, int(k) & (2**64 - 1)])) for k in np.asarray(keys).tolist()]

    def random(self, shape: tuple[int, ...]) -> np.ndarray:
        return np.stack([r.random(shape[1:]) for r in self.rows]) if self.rows else np.zeros(shape)


def draws(model: dict, seed: int, epoch: int, day: Day) -> RowDraws | None:
    """The dropout of a day's rows in an epoch; None for a model without."""
    if not model["spec"].get("dropout"):
        return None
    return RowDraws(seed, epoch, day[3] if len(day) > 3 else np.arange(len(day[2])))


@dataclass
class State:
    """A training under way: it learns batch by batch, and an epoch is closed with its losses."""

    model: dict
    adam: Adam
    best: dict = field(default_factory=dict)
    best_loss: float = np.inf
    waited: int = 0
    epoch: int = 0
    history: list[tuple] = field(default_factory=list)

    @classmethod
    def of(cls, model: dict, rate: float) -> State:
        return cls(copy.deepcopy(model), Adam(rate), copy.deepcopy(model))

    def learn(self, gradient: dict) -> None:
        self.adam.step(self.model["weights"], gradient)

    def close(self, own: float, held: float) -> bool:
        """End an epoch with its train and validation loss; whether the latter is the best (strictly lowest) so far."""
        self.epoch += 1
        self.history.append((self.epoch, own, held))
        better = held < self.best_loss
        if better:
            self.best, self.best_loss, self.waited = copy.deepcopy(self.model), held, 0
        else:
            self.waited += 1
        return better

    def ended(self, epochs: int, patience: int) -> bool:
        return self.epoch >= epochs or self.waited >= patience


def losses(model: dict, days: list[Day]) -> tuple[float, int]:
    """Sum of the losses of all samples, and their number."""
    n = sum(len(d[2]) for d in days)
    return sum(networks.loss_of(networks.logits(model, d[0], d[1]), d[2]) * len(d[2]) for d in days if len(d[2])), n


def evaluate(model: dict, days: list[Day]) -> float:
    """Mean loss over all samples of the days."""
    total, n = losses(model, days)
    return total / n if n else float("nan")


def train(model: dict, days: list[Day], validation: list[Day], epochs: int, rate: float, patience: int = 10, seed: int = 0) -> tuple[dict, list[tuple]]:
    """The weights of the best validation loss (strictly lower counts) and (epoch, train loss, validation loss) of each epoch that ran."""
    state = State.of(model, rate)
    while not state.ended(epochs, patience):
        for day in days:
            state.learn(gradients(state.model, *day[:3], draws(model, seed, state.epoch, day)))
        state.close(evaluate(state.model, days), evaluate(state.model, validation))
    return state.best, state.history
