"""Settings of a run: defaults, an overlay from a JSON file, and range checks."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass

#: Accepted choices.
MODES = ("matrix_only", "decision_tree_only", "ml_only", "both")
CHOICES = {
    "ancestral_allele": ("Y", "N"),
    "matrices_type": ("all", "coding", "sense-mutations"),
    "multiple_testing_method": ("fdr_bh", "bonferroni"),
    "pipeline_mode": MODES,
    "ml_algorithm": ("auto", "RF", "MLP", "LR", "MBCS", "DT", "SVC", "SCV", "DNL"),
}
#: Least and greatest values; None: no bound.
RANGES: dict[str, tuple[float | None, float | None]] = {
    "qual_threshold": (0, None), "min_dp_per_sample": (0, None), "mq_threshold": (0, None), "mq0f_threshold": (0, 1),
    "min_sample_presence": (1, None), "min_minor_count": (0, None), "matrices_repeat_number": (1, None),
    "significance_level": (0, 1), "chi2_min_expected": (1, None), "n_permutation_tests": (0, None), "prefilter_alpha": (0, 1),
    "min_nonmissing_prefilter": (0, 1), "min_maf_prefilter": (0, 0.5), "max_prefiltered_features": (1, None), "max_depth": (1, None),
    "min_samples_split": (2, None), "min_samples_leaf": (1, None), "max_epistatic_interactions": (1, None), "n_bootstrap_samples": (1, None),
    "bootstrap_outer_iters": (1, None), "ml_min_sensitivity": (0, 1), "ml_max_sensitivity": (0, 1), "ml_remove_empty_field_threshold": (0, 1),
}


@dataclass(frozen=True)
class Settings:
    """Names of settings are those that configuration files use."""

    generic_name: str = "matrix"
    qual_threshold: float = 30.0
    min_dp_per_sample: int = 10
    mq_threshold: float = 40.0
    mq0f_threshold: float = 0.1
    biallelic_only: bool = True
    min_sample_presence: int = 3
    ancestral_allele: str = "Y"
    remove_invariant: bool = True
    min_minor_count: int = 0
    matrices_repeat_number: int = 5
    matrices_type: str = "all"
    matrices_fix: str = ""
    significance_level: float = 0.05
    chi2_min_expected: int = 5
    n_permutation_tests: int = 500
    prefilter_alpha: float = 0.05
    min_nonmissing_prefilter: float = 0.2
    min_maf_prefilter: float = 0.0
    max_prefiltered_features: int | None = 10_000
    multiple_testing_method: str = "fdr_bh"
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    epistasis_strength_threshold: float = 0.05
    max_epistatic_interactions: int = 50
    n_bootstrap_samples: int = 1000
    bootstrap_outer_iters: int = 5
    use_integer_variant_ids: bool = False
    random_state: int = 42
    pipeline_mode: str = "decision_tree_only"
    run_ml_protocol: bool = False
    ml_algorithm: str = "auto"
    ml_min_sensitivity: float = 0.5
    ml_max_sensitivity: float = 1.0
    ml_step_sensitivity: float = 0.1
    ml_empty_symbol: str = ""
    ml_remove_empty_field_threshold: float = 1.0

    def __post_init__(self) -> None:
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        for name, (low, high) in RANGES.items():
            x = getattr(self, name)
            if x is not None and ((low is not None and x < low) or (high is not None and x > high)):
                raise ValueError(f"{name} is out of range: {x}")
        if self.ml_step_sensitivity <= 0 or self.ml_min_sensitivity > self.ml_max_sensitivity:
            raise ValueError("the sensitivity grid is empty")
        if self.run_ml_protocol and self.pipeline_mode == "decision_tree_only":
            object.__setattr__(self, "pipeline_mode", "both")

    @property
    def trees(self) -> bool:
        return self.pipeline_mode in ("decision_tree_only", "both")

    @property
    def learns(self) -> bool:
        return self.pipeline_mode in ("ml_only", "both")

    def but(self, **given: object) -> Settings:
        """A copy with the given settings; unknown names and None are ignored."""
        known = {f.name for f in dataclasses.fields(self)}
        return dataclasses.replace(self, **{k: v for k, v in given.items() if k in known and v is not None})

    def overlaid(self, path: str) -> Settings:
        """A copy with the settings of a JSON file; a null there is taken as such."""
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        known = {f.name for f in dataclasses.fields(self)}
        return dataclasses.replace(self, **{k: v for k, v in given.items() if k in known})

    def as_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2)
