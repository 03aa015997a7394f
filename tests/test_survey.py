"""Every catalog function on survey files in their usual columns."""

import pytest

import survey_data as D
from coreline.catalog import carbon, elements, statistics, summaries
from coreline.sources.survey import FieldSurvey
from conftest import rows

SLICE_HEADER = (
    "Site,Site_Core,Treatment,Depth_from,Depth_to,C_perc,Dry_bulk_density_gcm3,"
    "Lab_Compaction_Correction_Value,Carbon_stock_in_section_Mg_Cha,Depth_Range"
)
SITE_HEADER = (
    "Site,SiteYear,SiteYearNumeric,Site_short,SiteOldName,SiteRenamed,"
    "DepthTo_SinceRehabilitated_cm,SiteRenamed_25y"
)
PLOT_HEADER = "Site,Site_short,Subplot_Name,Treatment2,Total_Aboveground_Biomass_kg_100m2"


def csv(path, header, data):
    lines = [",".join("NA" if v is None else str(v) for v in row) for row in data]
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def survey(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    soil = [
        (*r, f"{r.depth_from:g}to{r.depth_to:g}") for r in D.slices(spark).collect()
    ] + [("MNDC", "MNDC_9", "Saltmarsh_natural", 0.0, 5.0, 50.0, 1.0, 1.0, 99.0, "0to5")]
    dim = {s[0]: s for s in D.SITES}
    seen = {}
    plots = []
    for site, carbon_value in D.plant_values() + [(s, 0.0) for s in ("MDBP", "MDSD", "MDTUCK")]:
        seen[site] = seen.get(site, 0) + 1
        plots.append((site, dim[site][3], f"{site}_{seen[site]}", dim[site][4], carbon_value / 0.0464))
    return FieldSurvey.from_csv(
        spark,
        csv(folder / "soil.csv", SLICE_HEADER, soil),
        csv(folder / "plant.csv", PLOT_HEADER, plots),
        csv(folder / "sites.csv", SITE_HEADER, D.SITES),
    )


def catalog():
    for module in (elements, summaries, carbon, statistics):
        for name, fn in vars(module).items():
            if callable(fn) and getattr(fn, "__module__", "") == module.__name__:
                code = fn.__code__
                if code.co_varnames[: code.co_argcount] == ("s",):
                    yield pytest.param(fn, id=f"{module.__name__.split('.')[-1]}-{name}")


@pytest.mark.parametrize("fn", list(catalog()))
def test_runs_on_files(survey, fn):
    out = fn(survey)
    frames = [v[0] for v in out.values()] if isinstance(out, dict) else [out]
    for df in frames:
        df.collect()
        assert len(df.columns) == len(set(df.columns))


def test_excluded_habitat_is_left_out(survey):
    assert survey.raw_slices().count() == survey.slices().count() + 1
    assert "MNDC_9" not in {r.site_core for r in carbon.core_totals(survey).collect()}


def test_plant_model_from_files(survey):
    got = {(r.model, r.term): r for r in statistics.lmm_random_intercept(survey).collect()}
    r = got["plant", "site_typeEstablished"]
    # Recorded estimate, SE, df
    assert r.estimate == pytest.approx(96.444, rel=2e-3)
    assert r.se == pytest.approx(28.740, rel=2e-3)
    assert r.df == pytest.approx(7.002, rel=2e-3)


def test_rehabilitated_plant_mean_from_files(survey):
    got = summaries.global_mean_se(survey).collect()[0]
    # Recorded mean, SD, N, SE of rehabilitated plots
    assert got.n == 23
    assert got.av == pytest.approx(50.32934, rel=5e-3)
    assert got.sd == pytest.approx(27.41857, rel=5e-3)
    assert got.se == pytest.approx(5.717167, rel=5e-3)


def test_reference_plant_mean_from_files(survey):
    got = {r["site_type_25y"]: r for r in rows(carbon.plot_carbon_by_type(survey), "level_idx")}
    r = got["Established"]
    # Recorded mean, SD, N, SE of established plots
    assert (r["n"], r["level_idx"]) == (12, 2)
    assert r["av"] == pytest.approx(145.8572, rel=5e-3)
    assert r["sd"] == pytest.approx(64.0, rel=5e-3)
    assert r["se"] == pytest.approx(18.5, rel=5e-3)


def test_accumulation_rows(survey):
    got = {r.site: r for r in carbon.accumulation_table(survey).collect()}
    assert set(got) == {"MR1991", "MR1992", "MRAP", "MRCH1", "MRCH2", "MRPL"}
    # no dated horizon, so no soil rate
    assert got["MRCH1"].soil_carbon_per_year == "NA ± NA"
    assert got["MRCH1"].plant_carbon_per_year == "0.5 ± 0.1"


def test_cores_per_site(survey):
    got = rows(elements.join_rates(survey), "site")
    assert len(got) == 12 and all(r["cores"] == 2 for r in got)
    assert got[8]["site"] == "MRAP" and got[8]["mar"] == 0.32
