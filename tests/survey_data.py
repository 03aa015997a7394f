"""Small fixed inputs shared by tests."""

# Site dimension
# (site, year text, year, short, old class, type, horizon cm, four-way type)
SITES = [
    ("MDBP", "0", 0, "BP", "Disturbed", "Converted", 1000.0, "Converted"),
    ("MDSD", "0", 0, "SD", "Disturbed", "Converted", 1000.0, "Converted"),
    ("MDTUCK", "0", 0, "TUCK", "Disturbed", "Converted", 1000.0, "Converted"),
    ("MNDC", "1917", 1917, "DC", "Remnant", "Established", 50.0, "Established"),
    ("MNND", "1917", 1917, "ND", "Remnant", "Established", 50.0, "Established"),
    ("MNPL", "1917", 1917, "PL", "Remnant", "Established", 50.0, "Established"),
    ("MR1991", "1991", 1991, "1991", "Rehabilitated", "Rehabilitated", 9.0, "Rehabilitated_old"),
    ("MR1992", "1992", 1992, "1992", "Rehabilitated", "Rehabilitated", 10.5, "Rehabilitated_young"),
    ("MRAP", "1997", 1997, "AP", "Rehabilitated", "Rehabilitated", 20.0, "Rehabilitated_young"),
    ("MRCH1", "1980A", 1980, "CH1", "Rehabilitated", "Rehabilitated", None, "Rehabilitated_old"),
    ("MRCH2", "1980", 1980, "CH2", "Rehabilitated", "Rehabilitated", 6.5, "Rehabilitated_old"),
    ("MRPL", "2000", 2000, "PL", "Rehabilitated", "Rehabilitated", None, "Rehabilitated_young"),
]
SITE_SCHEMA = (
    "site string, site_year string, site_year_numeric int, site_short string, "
    "site_old_name string, site_type string, horizon_cm double, site_type_25y string"
)

# Plant carbon per site (site, mean, n, SD)
PLANT = [
    ("MNDC", 215.0, 4, 57.8),
    ("MNND", 93.5, 4, 32.8),
    ("MNPL", 129.0, 4, 12.7),
    ("MR1991", 36.2, 4, 15.7),
    ("MR1992", 84.9, 4, 13.1),
    ("MRAP", 25.4, 3, 2.33),
    ("MRCH1", 20.0, 4, 8.31),
    ("MRCH2", 51.0, 4, 10.8),
    ("MRPL", 78.2, 4, 12.8),
]


def plant_values():
    """Rows with exactly the stated n, mean and SD per site."""
    out = []
    for site, mean, n, sd in PLANT:
        if n == 4:
            step = sd * 3 ** 0.5 / 2
            out += [(site, mean + s * step) for s in (1, 1, -1, -1)]
        else:
            out += [(site, mean), (site, mean - sd), (site, mean + sd)]
    return out


def sites(spark):
    return spark.createDataFrame(SITES, SITE_SCHEMA)


SLICE_SCHEMA = (
    "site string, site_core string, treatment string, depth_from double, depth_to double, "
    "c_perc double, dry_bulk_density double, compaction double, section_stock double"
)


def slices(spark):
    """Two cores per site with slices 0-5, 5-10, 10-30, 30-60, 60-120 cm."""
    cuts = [0.0, 5.0, 10.0, 30.0, 60.0, 120.0]
    out = []
    for i, (site, *_rest) in enumerate(SITES):
        for core in (1, 2):
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                carbon = float((i + core + k) % 5)  # 0 appears
                density = None if (i, core, k) == (4, 2, 1) else 0.3 + 0.05 * k + 0.01 * i
                out.append(
                    (site, f"{site}_{core}", "Mangrove", a, b, carbon, density,
                     1.0 - 0.02 * core, 10.0 + i + k)
                )
    return spark.createDataFrame(out, SLICE_SCHEMA)
