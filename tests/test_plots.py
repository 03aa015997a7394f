import pytest
from pyspark.sql import functions as F

import survey_data as D
from coreline.operators.joins import join_dim
from coreline.operators.summary import mean_se
from coreline.plans import plots as P
from conftest import rows


def test_plot_summary_reproduces_recorded_means(spark):
    data = [(s, v / 0.464 * 10) for s, v in D.plant_values()]
    plots = P.plot_carbon(spark.createDataFrame(data, "site string, biomass_kg double"))
    got = {r["site"]: r for r in rows(mean_se(plots, "site", "plant_c", "mixed"), "site")}
    for site, mean, n, sd in D.PLANT:
        assert got[site]["n"] == n
        assert got[site]["av"] == pytest.approx(mean) and got[site]["sd"] == pytest.approx(sd)


def test_age_buckets(spark):
    sites = D.sites(spark)
    for r in sites.withColumn("b", P.age_bucket()).collect():
        assert r.b == r.site_type_25y
    odd = spark.createDataFrame(
        [("Rehabilitated", None), ("Established", None), (None, 1980)],
        "site_type string, site_year_numeric int",
    )
    assert [r.b for r in odd.select(P.age_bucket().alias("b")).collect()] == [None, "Established", None]


@pytest.fixture(scope="module")
def sides(spark):
    plots = spark.createDataFrame(
        [("A", "A_1", 2.0), ("A", "A_2", 4.0), ("A", "A_9", 6.0), ("B", "B_1", None)],
        "site string, site_core string, plant_per_year double",
    )
    cores = spark.createDataFrame(
        [("A_1", "Rehabilitated", 1.0), ("A_2", "Rehabilitated", 3.0), ("B_1", "Rehabilitated", 5.0),
         ("C_1", "Rehabilitated", 7.0)],
        "site_core string, site_type string, soil_per_year double",
    )
    return plots, cores


def test_plots_without_a_core_stay(sides):
    both = P.combine_plots_and_cores(*sides, "site_core", keep="plots")
    got = {r["site_core"]: r for r in rows(both, "site_core")}
    assert set(got) == {"A_1", "A_2", "A_9", "B_1"}
    assert got["A_1"]["combined"] == 3.0 and got["A_1"]["co2"] == pytest.approx(11.01)
    assert got["A_9"]["soil_per_year"] is None and got["A_9"]["combined"] is None


def test_cores_without_a_plot_stay(sides):
    both = P.combine_plots_and_cores(*sides, "site_core", keep="cores")
    assert {r.site_core for r in both.collect()} == {"A_1", "A_2", "B_1", "C_1"}


def test_accumulation_text(sides):
    both = P.combine_plots_and_cores(*sides, "site_core", keep="plots")
    got = {r.site: r for r in P.accumulation_table(both, ["site"]).collect()}
    # SD is strict, so the missing core hides the soil SE but not its mean
    assert got["A"].soil_carbon_per_year == "2 ± NA"
    assert got["A"].plant_carbon_per_year == "4 ± 1.2"
    assert got["B"].plant_carbon_per_year == "NA ± NA"
    overall = {r.site_type: r for r in P.accumulation_summary(both, "site_type").collect()}
    assert overall[None].n_plant_per_year == 1 and overall["Rehabilitated"].n_plant_per_year == 3


def test_mirrored_table(spark):
    plant = spark.createDataFrame([("A", 3.0)], "site string, av double")
    soil = spark.createDataFrame([("A", 5.0), ("B", 0.5)], "site string, av double")
    got = rows(P.above_below(plant, soil), "av")
    assert [(r["stock"], r["av"]) for r in got] == [("Soil", -5.0), ("Soil", -0.5), ("Plant", 3.0)]


def test_site_effect_table(spark):
    rows_ = [("A", "old", 1.0), ("A", "old", 2.125), ("B", "young", None), ("B", "young", 1.0)]
    side = spark.createDataFrame(rows_, "site string, bucket string, value double")
    got = rows(P.site_effect_table(side, side), "stock_source", "site")
    assert [(r["stock_source"], r["site"], r["av"], r["se"]) for r in got] == [
        ("Aboveground", "A", 1.56, 0.56), ("Aboveground", "B", None, None),
        ("Belowground", "A", 1.56, 0.56), ("Belowground", "B", None, None),
    ]


def test_plot_rate(spark):
    plots = spark.createDataFrame([("MRAP", 500.0), ("MRCH1", 500.0)], "site string, biomass_kg double")
    placed = join_dim(plots, D.sites(spark), "site", ["site_year_numeric"])
    got = {r.site: r for r in P.plot_rate(placed).collect()}
    assert got["MRAP"].plant_per_year == pytest.approx(0.464 * 50 / 20)
    assert placed.filter(F.col("site_year_numeric").isNull()).count() == 0
