"""Hyper-parameters with their admissible ranges."""

import math
from dataclasses import dataclass, replace


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class AlgoParams:
    max_iter: int = 30
    min_delta_alpha: float = 0.01
    decline: float = 0.5
    batch_prob: float = 0.8
    epsilon: float = 0.0001
    clip_quantile: float = 0.0
    constant_step: bool = False
    linear_term: bool = True
    seed: int = 0

    def __post_init__(self):
        _require(0.0 <= self.clip_quantile <= 0.99, "clip_quantile must lie in [0, 0.99]")
        _require(0.0 < self.batch_prob < 1.0, "batch_prob must lie in (0, 1)")
        _require(0.0 < self.decline <= 1.0, "decline must lie in (0, 1]")
        _require(self.epsilon >= 0.0, "epsilon must not be negative")


@dataclass(frozen=True)
class ModelParams:
    C: float = 1.0
    delta: float = 0.5

    def __post_init__(self):
        _require(self.C > 0.0, "C must be positive")

    def step_size(self, algo: AlgoParams, iteration: int) -> float:
        """Step size of iteration 1, 2, ...: geometric decay, or one fixed decline."""
        return self.delta * algo.decline ** (1 if algo.constant_step else iteration)

    def with_cost(self, C: float) -> "ModelParams":
        return replace(self, C=C)


@dataclass(frozen=True)
class SplitRatios:
    """Positional split: first train, then validation, the rest test."""

    train: float = 0.5
    test: float = 0.1

    def __post_init__(self):
        _require(0.0 < self.train < 1.0, "train must lie in (0, 1)")
        _require(self.test >= 0.0 and self.train + self.test < 1.0, "train + test must stay below 1")

    def sizes(self, rows: int, strict: bool = False) -> tuple[int, int, int]:
        """Row counts (train, validation, test); ``strict`` refuses ratios that do not divide evenly."""
        n_train = math.floor(rows * self.train)
        n_validation = math.floor(rows * (1.0 - (self.train + self.test)))
        n_test = rows - n_train - n_validation
        if strict:
            _require(math.floor(rows * self.test) == n_test, "the ratios do not divide the rows exactly")
            _require(n_validation % 4 == 0, "validation rows must be a multiple of four")
            _require(n_test % 4 == 0, "test rows must be a multiple of four")
        return n_train, n_validation, n_test
