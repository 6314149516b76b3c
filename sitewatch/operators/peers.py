"""What a site's nearest peers say about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch.config import PeerSettings
from sitewatch.operators.checkpoints import cut
from sitewatch.operators.neighbours import (
    pair_distances,
    planar_neighbours,
    refine_shortlist,
    vector_neighbours,
)

UNKNOWN = "Unknown"


def peer_diagnostics(
    vectors: DataFrame, points: DataFrame, settings: PeerSettings = PeerSettings()
) -> DataFrame:
    """Chemical distance to chemical, embedding and hybrid peers, and their overlap.

    ``vectors`` is ``(site_id, vector)`` of scaled features, ``points`` is
    ``(site_id, x, y)``; only sites in both take part. The hybrid peers are the
    chemically nearest of the broad embedding neighbourhood. One broad embedding
    search serves both embedding-based sets.
    """
    complete = vectors.join(points.select("site_id", "x", "y"), "site_id")
    vec = complete.select("site_id", "vector")
    k = settings.final_k
    chem = vector_neighbours(vec, k)
    broad = cut(
        planar_neighbours(complete.select("site_id", "x", "y"), max(settings.broad_k, k)), "broad_edges"
    )
    measured = pair_distances(broad, vec).join(
        broad.select("site_id", "peer_id", "rank"), ["site_id", "peer_id"]
    )
    # Bounded lists: at most broad_k peers per site.
    around = measured.groupBy("site_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "distance", "peer_id"))).alias("_near")
    )
    own = chem.groupBy("site_id").agg(
        F.avg("distance").alias("chem_knn_mean_distance"), F.collect_list("peer_id").alias("_chem")
    )

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)

    embedded = F.slice("_near", 1, k)
    in_broad = F.filter("_near", lambda e: e["rank"] <= settings.broad_k)
    hybrid = F.slice(F.array_sort(F.transform(in_broad, lambda e: e["distance"])), 1, k)
    shared = F.size(F.array_intersect(F.col("_chem"), F.transform(embedded, lambda e: e["peer_id"])))
    return own.join(around, "site_id").select(
        "site_id",
        "chem_knn_mean_distance",
        mean(F.transform(embedded, lambda e: e["distance"])).alias("umap_knn_mean_chem_distance"),
        mean(hybrid).alias("hybrid_peer_mean_chem_distance"),
        (shared / F.size("_chem")).alias("peer_overlap_chem_umap"),
    )


def final_peers(
    points: DataFrame, z_vectors: DataFrame, settings: PeerSettings = PeerSettings()
) -> DataFrame:
    """Embedding shortlist re-ranked by distance between z-score vectors."""
    shortlist = planar_neighbours(points, settings.shortlist_k)
    return refine_shortlist(shortlist, z_vectors, min(settings.final_k, settings.shortlist_k))


def peer_typology(
    edges: DataFrame, sites: DataFrame, settings: PeerSettings = PeerSettings()
) -> DataFrame:
    """Type mix of each site's peers compared with its own type.

    ``edges`` has ``site_id, peer_id, rank``; ``sites`` has ``site_id, wfd_type``.
    A type tie goes to the type of the closest tied peer.
    """
    label = F.col("wfd_type")
    official = (label != "") & (F.lower(label) != "nan")
    typed = sites.select(
        "site_id",
        F.coalesce(official, F.lit(False)).alias("_official"),
        F.coalesce(F.when(official & (F.trim(label) != ""), F.trim(label)), F.lit(UNKNOWN)).alias("_type"),
    )
    peer_types = edges.join(
        typed.select(F.col("site_id").alias("peer_id"), F.col("_type").alias("_peer_type")), "peer_id"
    )
    # At most final_k rows per site.
    by_type = peer_types.groupBy("site_id", "_peer_type").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("rank").alias("_first"),
        F.collect_list(F.struct("rank", "peer_id")).alias("_ids"),
    )
    mixed = by_type.groupBy("site_id").agg(
        F.max(F.struct("_n", (-F.col("_first")).alias("_order"), "_peer_type")).alias("_top"),
        F.sum("_n").alias("_k"),
        F.map_from_entries(F.collect_list(F.struct("_peer_type", "_n"))).alias("_counts"),
        F.array_sort(F.flatten(F.collect_list("_ids"))).alias("_ids"),
    )
    same = F.coalesce(F.try_element_at("_counts", F.col("_type")), F.lit(0)) / F.col("_k")
    top_share = F.col("_top._n") / F.col("_k")
    return typed.join(mixed, "site_id", "left").select(
        "site_id",
        F.when(F.col("_official"), same).otherwise(top_share).alias("peer_agreement_ratio"),
        F.nullif(F.col("_top._peer_type"), F.lit(UNKNOWN)).alias("dominant_peer_type"),
        F.coalesce(F.col("_official") & (same <= settings.cross_type_threshold), F.lit(False)).alias(
            "is_cross_type"
        ),
        F.coalesce(
            F.col("_official") & (same >= settings.strong_agreement_threshold), F.lit(False)
        ).alias("is_strong_agreement"),
        F.coalesce(
            F.transform("_ids", lambda e: e["peer_id"]), F.array().cast("array<string>")
        ).alias("peer_site_ids"),
    )


def resolve_type(sites: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Give an untyped site the dominant type of its peers when they agree."""
    adopt = (
        F.col("wfd_type").isNull()
        & (F.col("peer_agreement_ratio") >= threshold)
        & F.col("dominant_peer_type").isNotNull()
    )
    resolved = F.when(adopt, F.col("dominant_peer_type")).otherwise(F.col("wfd_type"))
    return sites.withColumn("wfd_type_resolved", resolved).withColumn(
        "wfd_type_inferred",
        F.col("wfd_type").isNull() & F.col("wfd_type_resolved").isNotNull(),
    )
