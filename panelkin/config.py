"""All constants of the linkage and scoring pipeline, as one parameter object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Bands:
    """Random blocking: ``count`` bands of ``width`` columns each, blocks of 2 to ``cap`` rows."""

    count: int
    width: int
    seed: int
    cap: int = 8


@dataclass(frozen=True)
class Config:
    # fixed values of the method
    categorical: tuple[str, ...] = ("SS1200000", "AS1C10148", "TS_VOLATILITY_APS001_FLIPS", "TS_MOMENTUM_APS001_STATE")
    threshold: float = 0.45
    half_life: float = 3.0
    max_gap: int = 2
    m_clip: tuple[float, float] = (0.5, 0.999)
    f_floor: float = 1e-5
    u_floor: float = 1e-6
    fs_threshold: float = 300.0
    n_changing: int = 12
    informative_share: float = 0.3
    changing_share: float = 0.5
    first: Bands = Bands(40, 3, 0)
    first_distinct: int = 500
    sure_rate: float = 0.9
    stable_diff: float = 0.02
    second: Bands = Bands(80, 4, 1)
    second_distinct: int = 100
    train_rate: float = 0.95
    third: Bands = Bands(200, 3, 2)
    weak: Bands = Bands(150, 2, 5, 6)
    weak_same: float = 0.97
    weak_distinct: int = 200
    weak_range: tuple[float, float] = (0.8, 0.9)
    knn_dims: int = 180
    knn_ks: tuple[int, ...] = (10, 50, 200)
    knn_extra: int = 10
    weight_eps: float = 1e-3
    far_factor: float = 1.5
    missing_rank: float = -0.25
    block_weights: tuple[float, ...] = (0.6, 0.3, 0.1)
    importance_rounds: int = 300  # trees of the model that ranks columns
    rounds: tuple[int, int, int] = (1100, 1200, 2000)  # boosted trees, trees of the forest, iterations of the linear model
    seeds: tuple[int, int, int] = (3, 2, 1)
