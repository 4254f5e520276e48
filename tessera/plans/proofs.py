"""Permits resolved strictly, the funnel of their gates, and a catalogue built in three stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import resolution
from tessera.plans.registry import stored
from tessera.sources.adapters import load


def permits_and_cafes(spark, sf_dir):
    return load(spark, sf_dir, "permit_places"), load(spark, sf_dir, "cafe_places")


@stored
def strict_resolution(spark, sf_dir):
    """Each permit as verified, missing or ambiguous, with collisions."""
    made = resolution.resolve_strictly(*permits_and_cafes(spark, sf_dir))
    return made.withColumn("distance_m", F.round("distance_m", 3))


@stored
def permit_coverage(spark, sf_dir):
    """What came of all permits, and how large the verified ones are."""
    permits, cafes = permits_and_cafes(spark, sf_dir)
    return resolution.coverage_report(resolution.resolve_strictly(permits, cafes), permits.select("permit_id", "area"), cafes)


@stored
def gate_funnel(spark, sf_dir):
    """Pairs and permits that pass each of the gates; cafes of the permits' own source don't count."""
    permits, cafes = permits_and_cafes(spark, sf_dir)
    return resolution.gate_funnel(resolution.gate_masks(permits, cafes, "permit"))


def built(spark, sf_dir):
    a, b = load(spark, sf_dir, "catalogue_a"), load(spark, sf_dir, "catalogue_b")
    return resolution.provider_catalogue(a.where("place_id % 2 = 0"), a.where("place_id % 2 = 1"), b)


@stored
def provider_catalogue(spark, sf_dir):
    """Places of a provider given to the first catalogue, to permits, and by identity alone."""
    return built(spark, sf_dir)[0].select("source", "source_id", "provider_id", "stage", "rule")


@stored
def provider_stages(spark, sf_dir):
    """How many of the provider's places each stage matched, left open or found none for."""
    return built(spark, sf_dir)[1]
