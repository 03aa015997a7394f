from pathlib import Path


from coreline.runtime import cut_lineage, new_path, shared_folder
from coreline.sources import tables
from conftest import rows

SOIL = """Site,Site_Core,Extra,Treatment,Depth_from,Depth_to,C_perc,Dry_bulk_density_gcm3,Lab_Compaction_Correction_Value
MNDC,MNDC_1,x,Mangrove,0,5,4.5,0.6,0.95
MNDC,MNDC_1,x,Mangrove,5,10,NA,0.6,0.95
MNDC,MNDC_2,x,Saltmarsh_natural,0,5,oops,0.6,1
"""


def test_csv_columns_are_found_by_name_and_cast(spark, tmp_path):
    path = tmp_path / "soil.csv"
    path.write_text(SOIL)
    df = tables.read_slices(spark, str(path))
    assert dict(df.dtypes)["c_perc"] == "double" and "site_short" not in df.columns
    got = rows(df, "site_core", "depth_from")
    assert [r["c_perc"] for r in got] == [4.5, None, None]
    assert got[2]["treatment"] == "Saltmarsh_natural" and got[0]["compaction"] == 0.95


def test_site_dimension_csv(spark, tmp_path):
    path = tmp_path / "sites.csv"
    path.write_text(
        "Site,SiteYear,SiteYearNumeric,DepthTo_SinceRehabilitated_cm\nMRCH1,1980A,1980,NA\nMNDC,1917,1917,50\n"
    )
    got = rows(tables.read_sites(spark, str(path)), "site")
    assert got == [
        {"site": "MNDC", "site_year": "1917", "site_year_numeric": 1917, "horizon_cm": 50.0},
        {"site": "MRCH1", "site_year": "1980A", "site_year_numeric": 1980, "horizon_cm": None},
    ]


def test_csv_round_trip_keeps_missing_values(spark):
    df = spark.createDataFrame([("a", 0.1, None), ("b", None, 3)], "site string, x double, n int")
    path = tables.write_csv(df, new_path(spark, "trip"))
    fields = {"site": ("site", "string"), "x": ("x", "double"), "n": ("n", "int")}
    assert rows(tables.read_csv(spark, path, fields), "site") == rows(df, "site")
    kept = tables.materialise(df, new_path(spark, "kept"))
    assert rows(kept, "site") == rows(df, "site")


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == named and new_path(spark, "x").startswith(named)
    before = set(Path(named.removeprefix("file:")).rglob("part-*"))
    out = cut_lineage(spark.range(5).filter("id > 1"))
    assert out.count() == 3 and "Range" not in out._jdf.queryExecution().executedPlan().toString()
    assert set(Path(named.removeprefix("file:")).rglob("part-*")) > before


def test_depth_filter_reaches_the_scan(spark):

    import survey_data as D
    from coreline.plans import cores as C

    df = tables.materialise(D.slices(spark), new_path(spark, "slices"))
    out = C.core_stock(C.slice_carbon(df), "site_core", "strict", 50.0)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(depth_to,50.0)" in text
    assert "section_stock" not in text and "treatment" not in text


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_site_partitions_are_pruned(spark):
    import survey_data as D

    df = tables.materialise(D.slices(spark), new_path(spark, "by-site"), partition_by=("site",))
    text = plan(df.filter("site = 'MNDC'").select("c_perc"))
    assert "PartitionFilters: [isnotnull(site" in text
    assert df.count() == D.slices(spark).count()


def test_bucketed_slices_are_grouped_by_core_without_a_shuffle(spark):
    import survey_data as D
    from coreline.plans import cores as C

    df = tables.save_by_core(D.slices(spark), "slices_by_core", "site_core", 4)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        totals = C.core_stock(C.slice_carbon(df), "site_core", "strict", 100.0)
        assert "Exchange" not in plan(totals)
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    plain = C.core_stock(C.slice_carbon(D.slices(spark)), "site_core", "strict", 100.0)
    got, want = rows(totals, "site_core"), rows(plain, "site_core")
    assert [r["site_core"] for r in got] == [r["site_core"] for r in want]
    for a, b in zip(got, want):
        assert a["total"] == b["total"] or abs(a["total"] - b["total"]) < 1e-9


def test_tables_with_a_hot_core_are_saved_plain(spark):
    many = spark.createDataFrame([(k % 3 if k < 30 else 7, float(k)) for k in range(200)] + [(None, 0.5)], "k long, x double")
    one = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c"), (9, "d")], "k long, name string")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        for name, least, bucketed in (("hot_core", 50, False), ("cool_core", 500, True)):
            slices, names = tables.save_together(many, one, "k", 3, name, new_path(spark, name), least)
            met = slices.join(names.hint("merge"), "k")
            assert ("Bucketed: true" in plan(met)) is bucketed and ("Exchange" in plan(met)) is not bucketed
            want = many.join(one, "k")
            assert sorted(map(tuple, met.collect())) == sorted(map(tuple, want.collect()))
            assert slices.count() == 201 and names.count() == 4
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_files_of_several_headers_are_read_by_name(spark, tmp_path):
    import pytest

    fields = {"low": ("Depth_from", "double"), "high": ("Depth_to", "double")}
    for name, text in (("a", "Depth_from,Depth_to\n0,5\n"), ("b", "Depth_to,Depth_from\n10,5\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.csv").write_text(text)
    both = tables.read_csv(spark, [str(tmp_path / "a"), str(tmp_path / "b")], fields)
    assert rows(both, "low") == [{"low": 0.0, "high": 5.0}, {"low": 5.0, "high": 10.0}]
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    for name in ("a", "b"):
        (mixed / f"{name}.csv").write_text((tmp_path / name / "x.csv").read_text())
    (mixed / "c.csv").write_text("Depth_to,Note,Depth_from\n15,x,10\nNA,y,15\n")
    (mixed / "empty.csv").write_text("")
    got = tables.read_csv(spark, str(mixed), fields)
    assert rows(got, "low") == [
        {"low": 0.0, "high": 5.0}, {"low": 5.0, "high": 10.0}, {"low": 10.0, "high": 15.0}, {"low": 15.0, "high": None},
    ]
    assert len(tables.header_groups(spark, str(mixed))) == 3
    # a required column that one of the files lacks
    (mixed / "d.csv").write_text("Depth_from\n99\n")
    with pytest.raises(tables.MissingColumns, match="Depth_to"):
        tables.read_csv(spark, str(mixed), fields)
    kept = tables.read_csv(spark, str(mixed), fields, optional=["high"])
    assert kept.columns == ["low", "high"] and kept.where("low = 99 AND high IS NULL").count() == 1


def test_a_folder_of_one_header_is_one_scan(spark, tmp_path):
    fields = {"low": ("Depth_from", "double")}
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(f"Depth_from\n{k}\n")
    df = tables.read_csv(spark, str(tmp_path), fields)
    assert plan(df).count("FileScan csv") == 1 and [r["low"] for r in rows(df, "low")] == [0.0, 1.0, 2.0]


def test_absent_columns_raise(spark, tmp_path):
    import pytest

    path = tmp_path / "x.csv"
    path.write_text("Depth_from\n0\n")
    fields = {"low": ("Depth_from", "double"), "high": ("Depth_to", "double")}
    with pytest.raises(tables.MissingColumns, match="Depth_to"):
        tables.read_csv(spark, str(path), fields)
    assert tables.read_csv(spark, str(path), fields, optional=["high"]).columns == ["low"]


def test_checkpoint_files_can_go(spark):
    from coreline.runtime import _CHECKPOINTS, drop_checkpoint

    kept = cut_lineage(spark.range(3))
    place = Path(_CHECKPOINTS[kept].removeprefix("file:"))
    assert place.exists()
    drop_checkpoint(kept)
    assert not place.exists()
