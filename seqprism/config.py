"""Options of an analysis, with the defaults of the method."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AnalysisConfig:
    """Names follow what an option does; P13 and the like are settled in the operators' docstrings."""

    # Input.
    window: int = 150
    kmin: int = 4
    kmax: int = 5
    min_subclass: int = 200
    merge_low: bool = False
    screen_repeats: bool = False
    max_repeat_share: float = 0.5
    random_regions: bool = False
    # Training.
    regularization: float = 10.0
    rho: float = 1.7
    rho_max: float = 1000.0
    over_relaxation: float = 1.9
    admm_rounds: int = 400
    outer_rounds: int = 15
    blocks: int = 5
    folds: int = 3
    tolerance: float = 1e-2
    # Scanning.
    min_scan: int = 6
    max_scan: int = 14
    hill_threshold: float = 0.1
    top_hills: int = 750
    max_lower_case: float = 0.2
    min_model_hills: int = 100
    # Clustering.
    penetrance: float = 0.04
    bootstraps: int = 30
    k_values: tuple[int, ...] = (2, 3, 4, 5, 6)
    cluster_rounds: int = 10
    stratum_rows: int = 1000
    # Motifs.
    motif_min_width: int = 6
    motif_max_width: int = 13
    motifs_per_cluster: int = 3
    motif_window: int = 16
    motif_min_roc: float = 0.7
    seed: int = 42

    def features(self) -> int:
        """k-mers of all lengths: the bound of a model's rows."""
        return sum(4**k for k in range(self.kmin, self.kmax + 1))
