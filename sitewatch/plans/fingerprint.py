"""Chains of operators shared by jobs and queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatch.config import FeatureSettings
from sitewatch.operators import features as feat
from sitewatch.operators.checkpoints import cut
from sitewatch.operators.statistics import site_determinand_stats


@dataclass(frozen=True)
class Signatures:
    """Pruned signatures: the complete grid with gaps, and the kept sites."""

    grid: DataFrame  # site_id, feature, value (null for gaps)
    sites: DataFrame  # site_id, n_features_present
    features: list[str]


def build_signatures(stats: DataFrame, settings: FeatureSettings) -> Signatures:
    """From statistics to the pruned grid.

    The feature names come to the driver once: pruning sites needs their number and
    the grid their list. ``stats`` should be a written layer, as it is read more than
    once; signatures are written here for the same reason.
    """
    long = cut(feat.signature_long(feat.select_features(stats, settings)), "signatures")
    kept = feat.prune_features(long, settings.min_feature_coverage)
    names = sorted(r["feature"] for r in kept.select("feature").collect())
    if not names:
        raise feat.NoFeatures("no feature reaches the coverage threshold")
    inside = long.where(F.col("feature").isin(*names))
    sites = feat.prune_sites(inside, len(names), settings.max_missing_features)
    grid = feat.complete_grid(inside.join(sites.select("site_id"), "site_id", "left_semi"), names)
    grid = cut(grid, "grid")
    return Signatures(grid, sites, names)


def signatures_from_observations(obs: DataFrame, settings: FeatureSettings) -> Signatures:
    return build_signatures(cut(site_determinand_stats(obs, settings), "stats"), settings)
