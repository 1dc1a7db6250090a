"""A linear-chain conditional random field with two states, over hashed features, in numpy."""

from __future__ import annotations

import numpy as np

#: Emission scores beyond this are cut off, so that odds stay finite.
LIMIT = 30.0


class Chains:
    """The places of tokens in chains, longest chain first, for steps over all chains at once."""

    def __init__(self, first: np.ndarray):
        """first: for each token whether a chain begins there."""
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(first)))
        order = np.argsort(-sizes, kind="stable")
        self.starts, self.sizes = starts[order], sizes[order]
        self.live = np.searchsorted(-self.sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), "right")  # chains that have a token at each step

    def odds(self, emission: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State 1 against state 0 of each token: forward odds (its own emission included) and backward odds.

        transition: log potentials of 0 to 1, 1 to 0 and 1 to 1; 0 to 0 is 0.
        """
        e, (t01, t10, t11) = np.exp(np.clip(emission, -LIMIT, LIMIT)), np.exp(transition)
        forward, backward = e.copy(), np.ones_like(e)
        for step in range(1, len(self.live)):
            at = self.starts[: self.live[step]] + step
            x = forward[at - 1]
            forward[at] = np.clip(e[at] * (x * t11 + t01) / (x * t10 + 1), 1e-200, 1e200)
        for step in range(len(self.live) - 1, 0, -1):
            at = self.starts[: self.live[step]] + step
            y = e[at] * backward[at]
            backward[at - 1] = np.clip((y * t11 + t10) / (y * t01 + 1), 1e-200, 1e200)
        return forward, backward


def marginal_log_odds(chains: Chains, emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Log odds of state 1 at each token, given the whole chain."""
    forward, backward = chains.odds(emission, transition)
    return np.log(forward) + np.log(backward)


class Model:
    """Weights of hashed features, a bias, and transitions."""

    def __init__(self, bits: int):
        self.weights, self.bias, self.transition = np.zeros(1 << bits), 0.0, np.zeros(3)

    def emission(self, features: np.ndarray) -> np.ndarray:
        """features: places of each token's features, one row for each kind."""
        total = np.full(features.shape[1], self.bias)
        for row in features:
            total += self.weights[row]
        return total

    def fit(self, features: np.ndarray, first: np.ndarray, labels: np.ndarray, *, rounds: int = 40, rate: float = 0.4, decay: float = 1e-3) -> None:
        """Maximises the conditional likelihood of the token labels by gradient steps with momentum."""
        chains, y = Chains(first), labels.astype(float)
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        follows = np.flatnonzero(~first)
        seen = np.stack([np.sum((1 - y[follows - 1]) * y[follows]), np.sum(y[follows - 1] * (1 - y[follows])), np.sum(y[follows - 1] * y[follows])])
        size = max(1.0, y.sum())
        moments: dict[str, list] = {}

        def step(name: str, value, gradient, k: int):
            m, v = moments.setdefault(name, [0.0, 0.0])
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient * gradient
            moments[name] = [m, v]
            return value + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)

        for k in range(1, rounds + 1):
            emission = self.emission(features)
            forward, backward = chains.odds(emission, self.transition)
            odds = forward * backward
            wrong = y - odds / (1 + odds)
            gradient = np.zeros_like(self.weights)
            for row in features:
                gradient += np.bincount(row, wrong, minlength=len(gradient))
            x, z = forward[follows - 1], np.exp(np.clip(emission[follows], -LIMIT, LIMIT)) * backward[follows]
            t01, t10, t11 = np.exp(self.transition)
            pair = np.stack([t01 * z, x * t10, x * t11 * z])
            held = (pair / (1 + pair.sum(0))).sum(1)
            self.weights = step("w", self.weights, gradient / size - decay * self.weights, k)
            self.bias = float(step("b", self.bias, wrong.sum() / size, k))
            self.transition = np.clip(step("t", self.transition, (seen - held) / size - decay * self.transition, k), -8, 8)
