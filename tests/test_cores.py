import pytest
from pyspark.sql import functions as F

import survey_data as D
from coreline.constants import TYPE_LEVELS, Constants
from coreline.operators.summary import mean_se
from coreline.plans import cores as C
from conftest import rows


@pytest.fixture(scope="module")
def sites(spark):
    return D.sites(spark).cache()


@pytest.fixture(scope="module")
def slices(spark):
    return D.slices(spark).cache()


def test_slice_carbon(spark):
    df = spark.createDataFrame(
        [("s", "s_1", "m", 10.0, 30.0, 5.0, 0.8, 0.9, 1.0), ("s", "s_1", "m", 0.0, 10.0, 0.0, 0.5, 1.0, 1.0),
         ("s", "s_1", "m", 0.0, 10.0, None, 0.5, 1.0, 1.0)],
        D.SLICE_SCHEMA,
    )
    a, b, c = C.slice_carbon(df).collect()
    assert a.carbon_density == pytest.approx(0.8 * 0.9 * 5 / 100)
    assert a.carbon_stock == pytest.approx(0.036 * 100 * 20)
    assert a.sample_volume == pytest.approx(3.141592653589793 * 6.25 * 20)
    assert b.c_percent == 0.001 and c.c_percent is None and c.carbon_stock is None
    assert C.slice_carbon(df, Constants(zero_carbon_floor_perc=0.5)).collect()[1].c_percent == 0.5


def test_horizon_clip_on_the_site_dimension(slices, sites):
    full = C.slice_carbon(slices)
    got = C.horizon_clip(full, sites).collect()
    assert {r.site for r in got} == {s[0] for s in D.SITES} - {"MRCH1", "MRPL"}
    for r in got:
        assert r.depth_from <= r.horizon_cm
        assert r.depth_at_horizon == min(r.depth_to, r.horizon_cm)
        if r.carbon_stock is not None:
            assert r.stock_to_horizon <= r.carbon_stock + 1e-12
    assert max(r.depth_at_horizon for r in got if r.site == "MR1992") == 10.5
    # Converted sites keep every slice whole
    whole = [r for r in got if r.site == "MDBP"]
    assert len(whole) == 10 and all(r.slice_to_horizon == r.depth_to - r.depth_from for r in whole)


def test_a_slice_starting_at_the_horizon_stays_with_length_zero(spark):
    df = spark.createDataFrame(
        [(10.0, 20.0, 10.0, 0.02), (11.0, 20.0, 10.0, 0.02), (0.0, None, 10.0, 0.02), (0.0, 5.0, None, 0.02)],
        "depth_from double, depth_to double, horizon_cm double, carbon_density double",
    )
    got = rows(C.clip_at_horizon(df), "depth_from")
    assert [(r["depth_from"], r["stock_to_horizon"]) for r in got] == [(0.0, None), (10.0, 0.0)]


def test_stand_age_from_dirty_years(sites):
    got = {r.site: r.age for r in sites.select("site", C.stand_age("site_year").alias("age")).collect()}
    assert got["MRCH1"] is None and got["MRCH2"] == 37.0 and got["MDBP"] == 2017.0


def test_stock_to_depth_uses_strict_core_sums(slices, sites):
    got = rows(C.stock_to_depth(slices, sites, "site_type", 100.0), "site_type")
    assert [(r["site_type"], r["n"]) for r in got] == [
        ("Converted", 6), ("Established", 6), ("Rehabilitated", 12)
    ]
    by_core = {}
    for r in C.slice_carbon(slices).filter("depth_to <= 100").collect():
        by_core.setdefault(r.site_core, []).append(r.carbon_stock)
    totals = [sum(v) if None not in v else None for k, v in by_core.items() if k.startswith("MN")]
    present = [v for v in totals if v is not None]
    assert len(present) == 5 and len(totals) == 6  # one core has a missing density
    assert got[1]["av"] == pytest.approx(sum(present) / 5)
    lenient = rows(C.stock_to_depth(slices, sites, "site", 100.0, "lenient", "strict"), "site")
    assert len(lenient) == 12 and all(r["av"] is not None for r in lenient)


def test_stock_to_horizon(slices, sites):
    got = rows(C.stock_to_horizon(slices, sites, "site", digits=1), "site")
    assert len(got) == 10 and all(r["n"] == 2 for r in got)
    assert all(r["av"] is None or r["av"] == round(r["av"], 1) for r in got)


def test_percent_of_reference(slices, sites):
    totals = C.core_stock(C.slice_carbon(slices), "site_core", "strict", 100.0)
    placed = C.place_cores(totals, sites, ["site_type"])
    reference = C.reference_stock(placed, "Established")
    assert reference.collect()[0].site_year == "1970"
    got = C.percent_of_reference(placed, reference.select("av"), "Converted").collect()[0]
    mean = mean_se(placed.filter(F.col("site_type") == "Converted"), [], "total", "lenient").collect()[0].av
    assert got.av == pytest.approx(mean / reference.collect()[0].av * 100)


def test_legacy_correction_counts_slices(slices):
    got = rows(C.legacy_core_correction(C.legacy_core_moments(slices, ["site", "site_core"]), "site"), "site")
    brute = {}
    core = {}
    shallow = [r for r in slices.collect() if r.depth_to <= 100]
    for r in shallow:
        core[r.site_core] = core.get(r.site_core, 0.0) + r.section_stock
    for r in shallow:
        deep = r.depth_to / r.compaction
        keep = 100 - (deep - r.depth_to) / r.depth_to * 100
        brute.setdefault(r.site, []).append(core[r.site_core] * keep / 100)
    for r in got:
        values = brute[r["site"]]
        assert r["n"] == 8 and r["av"] == pytest.approx(sum(values) / 8)


def test_accretion_since_horizon(slices, sites):
    clipped = C.horizon_clip(
        C.slice_carbon(slices), sites, ["horizon_cm", "site_year_numeric", "site_type_25y"]
    )
    cores = C.core_accretion(clipped, ["site_core", "site", "site_year_numeric", "site_type_25y"])
    shown = {r.site_core: r for r in C.zero_for_converted(cores).collect()}
    assert shown["MDBP_1"].per_year_shown == 0.0 and shown["MDBP_1"].per_year > 0.0
    r = shown["MRAP_1"]
    assert r.stand_age == 20.0 and r.per_year == pytest.approx(r.total / 20.0)
    out = rows(C.accretion_by_type(cores, "site_type_25y", TYPE_LEVELS), "level_idx")
    assert [r["site_type_25y"] for r in out] == list(TYPE_LEVELS)
    assert out[1]["co2_equivalent"] == pytest.approx(out[1]["av"] * 3.67)


def test_stand_age_zero_gives_missing_rate(spark):
    df = spark.createDataFrame([("c", 2017, 5.0)], "core string, site_year_numeric int, stock_to_horizon double")
    assert C.core_accretion(df, ["core", "site_year_numeric"]).collect()[0].per_year is None


def test_dated_accretion(slices, spark):
    from coreline.operators.joins import join_dim
    from coreline.sources.rates import dated_rates

    rates = dated_rates(spark)
    assert rates.count() == 13
    def rated(moments):
        return join_dim(moments, rates, "site", ["mar"])

    core = ["site", "site_core"]
    got = rows(C.accretion_dated(rated(C.carbon_moments(slices, core)), "site"), "site")
    got = {r["site"]: r for r in got}
    assert got["MRPL"]["mean_car"] is None and got["MRPL"]["n_car"] == 10
    carbon = [r.c_perc for r in slices.filter("site = 'MRAP'").collect()]
    assert got["MRAP"]["mean_car"] == pytest.approx(0.32 * sum(carbon) / 10)
    shallow = C.accretion_dated_shallow(rated(C.shallow_core_moments(slices, core)), "site").collect()
    r = next(r for r in shallow if r.site == "MRAP")
    assert r.n == 6 and r.av_co2 == pytest.approx(r.av * 3.67)
