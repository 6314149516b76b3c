"""Settings of a run, with the published defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# The twelve-determinand panel, code -> display name.
COMMON_CORE_PANEL = {
    "76": "Temperature of Water",
    "61": "pH",
    "162": "Alkalinity to pH 4.5 as CaCO3",
    "77": "Conductivity at 25 C",
    "9924": "Oxygen, Dissolved as O2",
    "118": "Nitrite as N",
    "117": "Nitrate as N",
    "111": "Ammoniacal Nitrogen as N",
    "180": "Orthophosphate, reactive as P",
    "116": "Nitrogen, Total Oxidised as N",
    "119": "Ammonia un-ionised as N",
    "9901": "Oxygen, Dissolved, % Saturation",
}


@dataclass(frozen=True)
class CleaningSettings:
    keep_materials: tuple[str, ...] = (
        "RIVER / RUNNING SURFACE WATER",
        "RIVER/RUNNING SURFACE WATER",
    )
    exclude_determinands: tuple[str, ...] = ("Ionic Balance",)
    exclude_units: tuple[str, ...] = ("CEL", "Hazen", "JTU", "FTU")
    censored_factor: float = 0.5


@dataclass(frozen=True)
class FeatureSettings:
    year_start: int = 2015
    year_end: int = 2024
    min_sites_per_determinand: int = 200
    min_obs_per_site_determinand: int = 30
    min_feature_coverage: float = 0.60
    max_missing_features: int = 3
    panel: dict[str, str] = field(default_factory=lambda: dict(COMMON_CORE_PANEL))


@dataclass(frozen=True)
class ScoringSettings:
    method: str = "typology_peers"
    geographic_k: int = 20
    flag_percentile: float = 95.0
    min_group_size: int = 10
    notable_z: float = 2.0


@dataclass(frozen=True)
class PeerSettings:
    shortlist_k: int = 50
    final_k: int = 5
    broad_k: int = 20
    cross_type_threshold: float = 0.4
    strong_agreement_threshold: float = 0.8
    resolve_threshold: float = 0.6


@dataclass(frozen=True)
class ConfidenceSettings:
    well_visits: int = 30
    well_year: int = 2023
    moderate_visits: int = 12
    moderate_year: int = 2020


@dataclass(frozen=True)
class GateSettings:
    row_count_tolerance: float = 0.15
    first_run_rows: int = 5_000_000
    min_site_count: int = 10_000
    max_null_rate: float = 0.05
    min_years: int = 5
    min_regions: int = 5
    max_age_years: int = 2
    value_ranges: dict[str, tuple[float, float]] = field(
        default_factory=lambda: {
            "pH": (0.0, 14.0),
            "Temperature of Water": (-5.0, 45.0),
            "Oxygen, Dissolved, % Saturation": (0.0, 500.0),
        }
    )
    known_bad_sites: tuple[str, ...] = ("AN-NETL5", "NW-88024185", "NW-88000857", "AN-MT2405")
    known_bad_max_rank: int = 50
    known_clean_sites: tuple[str, ...] = ()
    known_clean_min_rank: int = 500
    min_spearman: float = 0.85
    min_skewness: float = 1.0
    flagged_range: tuple[int, int] = (200, 800)
    max_global_share: float = 0.10
    min_summary_length: int = 50
    lat_bounds: tuple[float, float] = (49.9, 55.8)
    lon_bounds: tuple[float, float] = (-6.4, 1.8)
    size_mb_range: tuple[float, float] = (1.0, 15.0)


@dataclass(frozen=True)
class Settings:
    cleaning: CleaningSettings = field(default_factory=CleaningSettings)
    features: FeatureSettings = field(default_factory=FeatureSettings)
    scoring: ScoringSettings = field(default_factory=ScoringSettings)
    peers: PeerSettings = field(default_factory=PeerSettings)
    confidence: ConfidenceSettings = field(default_factory=ConfidenceSettings)
    gates: GateSettings = field(default_factory=GateSettings)
