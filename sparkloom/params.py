"""Parameters of the kernels; the defaults are the values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SimParams:
    """Constants of the particle simulation. A cell narrower than the cutoff would lose pairs and is refused."""

    density: float = 0.0005
    mass: float = 0.01
    cutoff: float = 0.01
    dt: float = 0.0005
    bin_factor: float = 2.1
    save_every: int = 10

    def __post_init__(self) -> None:
        if self.bin_factor < 1:
            raise ValueError("bin_factor must be 1 or more: cells may not be narrower than the cutoff")

    @property
    def min_r(self) -> float:
        return self.cutoff / 100

    @property
    def cell(self) -> float:
        return self.bin_factor * self.cutoff

    def size(self, n: int) -> float:
        return (self.density * n) ** 0.5

    def dim(self, size: float) -> int:
        return int(size // self.cell) + 1


RANKS = 8
PEAK_GFLOPS = 56.0
EPSILON = 2.220446049250313e-16
