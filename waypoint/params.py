"""Job parameters (the scalar configuration of the model)."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Fixed values that must equal the reference model's for right results:
# analysis year 2024, unit cap 45, spend step 1000 capped at 8000,
# extract fraction 0.039679166667, sample size 10000, LOB domain
# air / lodging / car, default segment "Low Frequency", calculated-tier
# thresholds 5 / 15 / 30 with tier codes 1 Blue, 2 Silver, 3 Gold, 5 Platinum.
REFERENCE_ANALYSIS_YEAR = 2024
REFERENCE_UNIT_CAP = 45
REFERENCE_SPEND_STEP = 1000
REFERENCE_SPEND_CAP = 8000
REFERENCE_EXTRACT_FRACTION = 0.039679166667
REFERENCE_SAMPLE_SIZE = 10000
MODEL_LOBS = ("air", "lodging", "car")
TYPING_LOBS = ("air", "lodging")
FOREST_LOBS = ("activity", "air", "car", "insurance", "lodging")
DEFAULT_SEGMENT = "Low Frequency"
TIER_THRESHOLDS = (5, 15, 30)


@dataclass(frozen=True)
class ModelParams:
    analysis_year: int = REFERENCE_ANALYSIS_YEAR
    unit_cap: int = REFERENCE_UNIT_CAP
    spend_step: int = REFERENCE_SPEND_STEP
    spend_cap: int = REFERENCE_SPEND_CAP
    extract_fraction: float = REFERENCE_EXTRACT_FRACTION
    brand: str | None = None  # the modelled brand code; required by the line filters
    lobs: tuple[str, ...] = MODEL_LOBS
    typing_lobs: tuple[str, ...] = TYPING_LOBS
    transition_lobs: tuple[str, ...] = TYPING_LOBS
    forest_lobs: tuple[str, ...] = FOREST_LOBS
    sample_size: int = REFERENCE_SAMPLE_SIZE
    # testing mode: run the model on the lines of a uniform customer sample
    testing: bool = False
    default_segment: str = DEFAULT_SEGMENT
    segmentation: str | None = None
    # the segments in level order, for the order of output rows (by name, if not given)
    segment_levels: tuple[str, ...] = ()
    tier_thresholds: tuple[int, int, int] = TIER_THRESHOLDS
    seed: int = 7
    # uncovered spend cells: "error" (as the reference) or "default"
    on_uncovered: str = "error"
    num_buckets: int = 3
    band_max: int = 20
    # forest: trees grow until pure, as deep as Spark ML allows, and try floor(sqrt(5)) = 2
    # of the 5 features at a split
    forest_trees: int = 200
    # customers that the forest scores: a uniform sample of so many, or all where fewer exist
    scored_size: int = REFERENCE_SAMPLE_SIZE
    forest_depth: int = 30
    forest_min_node: int = 1
    forest_features_per_split: int = 2
    # lines of business that the wide respondent table may have
    max_lobs: int = 1000

    def with_(self, **kw) -> "ModelParams":
        return replace(self, **kw)


def fixture_params() -> ModelParams:
    """Parameters for the driver's synthetic tables (see FIXTURES.md 2.4)."""
    return ModelParams(
        analysis_year=1998,
        unit_cap=31,
        spend_step=40000,
        spend_cap=80000,
        brand="BR1",
        sample_size=50,
        segmentation="tier_expanded",
        default_segment="Blue",
    )
