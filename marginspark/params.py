"""Hyperparameters of the margin-distribution loss."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MarginParams:
    """``theta`` is the half width of the free band around margin 1, ``lam`` the
    loss weight, ``mu`` the relative weight of margins above the band, ``tol``
    the stopping threshold and ``eta`` the gradient step."""

    theta: float = 0.5
    lam: float = 32.0
    mu: float = 0.5
    tol: float = 1e-6
    eta: float = 1e-4

    def __post_init__(self) -> None:
        if not 0.0 <= self.theta < 1.0:
            raise ValueError("theta must be in [0, 1)")
        if self.lam <= 0.0 or self.mu <= 0.0:
            raise ValueError("lam and mu must be positive")

    @property
    def low(self) -> float:
        """Margins strictly below this are penalised."""
        return 1.0 - self.theta

    @property
    def high(self) -> float:
        """Margins strictly above this are penalised with weight ``mu``."""
        return 1.0 + self.theta

    def loss_weight(self, m: float) -> float:
        """Weight of one squared deviation when ``m`` rows share the loss."""
        return self.lam / (m * self.low**2)

    def ridge(self, m: float) -> float:
        """Diagonal term of the dual problem; ``1 / (2 * loss_weight)``."""
        return m * self.low**2 / (2.0 * self.lam)
