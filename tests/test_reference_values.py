"""Queries for the reference's own operators run at the reference's sizes."""

from pyspark.sql import functions as F

from sievewright.plans import catalogue, resampling, selecting

SF = "/root/testdata/sf0.001"


def test_permutation_resolves_below_one_in_201(spark):
    assert catalogue.QUERIES["permutation_p"](spark, SF).first()[0] < 1 / 201
    assert resampling.ITERATIONS == 5000


def test_kid_draws_a_hundred_subsets(spark, monkeypatch):
    seen, own = [], selecting.selection.kernel_distance

    def spied(df, subsets, size, seed):
        seen.append((subsets, size, own(df, subsets, size, seed).count()))
        return own(df, subsets, size, seed)

    monkeypatch.setattr(selecting.selection, "kernel_distance", spied)
    assert catalogue.QUERIES["kid"](spark, SF).count() == 1
    assert seen == [(100, 1000, 100)]


def test_forests_of_every_seed(spark, monkeypatch):
    assert selecting.RF_TREES == 500
    monkeypatch.setattr(selecting, "RF_TREES", 2)
    got = catalogue.QUERIES["rf_seed_scores"](spark, SF).groupBy("condition").agg(F.count_distinct("seed")).collect()
    assert sorted(map(tuple, got)) == sorted((e, 10) for e in selecting.EXPERIMENTS) and len(selecting.EXPERIMENTS) == 5
