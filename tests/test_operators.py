"""Edge rules on tiny hand-computed tables."""

from __future__ import annotations

import datetime as dt
import gzip
import math

import pytest
from pyspark.sql import functions as F

from gasflow.operators import association, cleaning, outliers, profiling, proximity, quality, relational
from gasflow.operators import operations
from gasflow.plans import analyses
from gasflow.sources.files import html_payload_scan, read_profile, read_table, rejected_lines, write_profile


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


@pytest.fixture(scope="module")
def small(spark):
    """Three observations in three states."""
    day = [dt.datetime(2024, 1, i) for i in (1, 2, 3)]
    data = [
        ("Pipeline_A", "Location_1", "TX", 1000.0, day[0], "LNG", 29.7604, -95.3698),
        ("Pipeline_B", "Location_2", "LA", 2000.0, day[1], "GAS", 30.2241, -92.0198),
        ("Pipeline_C", "Location_3", "OK", 1500.0, day[2], "LNG", 35.4676, -97.5164),
    ]
    return spark.createDataFrame(
        data,
        "pipeline_name string, loc_name string, state_abb string, scheduled_quantity double, eff_gas_day timestamp, "
        "category_short string, latitude double, longitude double",
    )


@pytest.fixture(scope="module")
def mixed(spark):
    data = [
        (1, "TX ", 1.0, None, True),
        (2, "tx", 2.0, None, False),
        (3, "TX", None, None, None),
        (4, None, 4.0, 9.0, True),
        (4, None, 4.0, 9.0, True),
    ]
    return spark.createDataFrame(data, "id long, state_abb string, b double, c double, flag boolean")


def test_small_example(small):
    found = analyses.clean(small).orderBy("pipeline_name")
    assert rows(found, "quantity_category") == [("Low",), ("Very High",), ("Medium",)]
    assert rows(found, "geographic_quadrant") == [("SE",), ("NE",), ("NW",)]
    assert rows(found, "year", "month", "day_of_week", "quarter")[0] == (2024, 1, 0, 1)
    described = profiling.describe_numeric(small, ["scheduled_quantity"]).first()
    assert described.asDict() == {
        "column": "scheduled_quantity", "count": 3, "mean": 1500.0, "std": 500.0, "min": 1000.0,
        "q25": 1250.0, "q50": 1500.0, "q75": 1750.0, "max": 2000.0,
    }


def test_sparse_columns_go_at_the_threshold(spark):
    table = spark.createDataFrame([(1, None, 1), (2, None, 2), (3, None, 3), (4, 1, 4), (5, 1, None)], "a int, b int, c int")
    assert cleaning.drop_sparse_columns(table, 0.6).columns == ["a", "c"]
    assert cleaning.drop_sparse_columns(table, 0.61).columns == ["a", "b", "c"]


def test_imputation_rules(spark):
    monday, tuesday = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    data = [
        ("p", monday, 1.0), ("p", monday, 3.0), ("p", monday, None), ("p", tuesday, None), (None, monday, None), ("q", tuesday, 10.0),
    ]
    table = spark.createDataFrame(data, "pipeline_name string, eff_gas_day timestamp, scheduled_quantity double")
    filled = cleaning.impute_group_median(table)
    got = sorted(rows(filled.filter("scheduled_quantity_missing"), "pipeline_name", "scheduled_quantity"), key=str)
    assert got == [("p", 2.0), ("p", 3.0), (None, 3.0)]  # group median 2, overall median 3
    alone = cleaning.impute_group_median(table.drop("eff_gas_day"))
    assert {r[0] for r in rows(alone.filter("scheduled_quantity_missing"), "scheduled_quantity")} == {3.0}
    named = spark.createDataFrame([(None, "x"), ("TX", "y")], "state_abb string, category_short string")
    result = cleaning.impute_categories(named)
    assert result.columns == ["state_abb", "category_short", "state_abb_missing"]
    assert rows(result, "state_abb") == [("UNK",), ("TX",)]
    full = spark.createDataFrame([("a",)], "connecting_pipeline string")
    assert cleaning.impute_connecting(full).columns == ["connecting_pipeline", "connecting_pipeline_missing"]


def test_equal_quartiles_and_nulls(spark):
    table = spark.createDataFrame([(i, v) for i, v in enumerate([5.0, 5.0, 5.0, 5.0, 9.0, None])], "obs_id long, scheduled_quantity double")
    got = rows(cleaning.quantity_bins(table).orderBy("obs_id"), "quantity_category")
    assert got == [("Low",)] * 4 + [("Very High",), (None,)]


def test_coercion(spark):
    text = spark.createDataFrame([("2024-02-03", "1.5"), ("never", "many"), (None, None)], "eff_gas_day string, latitude string")
    got = rows(cleaning.coerce_numeric(cleaning.parse_dates(text)))
    assert got == [(dt.datetime(2024, 2, 3), 1.5), (None, None), (None, None)]


def test_column_names(spark):
    table = spark.createDataFrame([(1, 2, 3)], ["Gas Day (UTC)", "__Loc--Name", "a  b"])
    assert cleaning.clean_column_names(table).columns == ["gas_day_utc", "locname", "a_b"]
    with pytest.raises(ValueError, match="several columns"):
        cleaning.clean_column_names(spark.createDataFrame([(1, 2)], ["A", "a!"]))


def test_validation(spark):
    table = spark.createDataFrame([("A", 100, "TX", "X")], "pipeline_name string, scheduled_quantity int, state_abb string, extra_column string")
    got = {r["column"]: r for r in cleaning.validate_columns(table).collect()}
    assert [r["status"] for r in got.values()].count("missing") == 10
    assert got["extra_column"]["status"] == "extra" and not got["latitude"]["is_valid"]
    close = spark.createDataFrame([(1,)], ["gas_day"])
    assert {r["column"]: r["suggestion"] for r in cleaning.validate_columns(close, ["eff_gas_day"]).collect()}["eff_gas_day"] == "gas_day"


def test_filter_precedence_and_nulls(mixed):
    assert relational.apply_filters(mixed, {"b": {"less_than": 3, "greater_than": 1.5}}).count() == 3
    assert relational.apply_filters(mixed, {"b": {"equals": 4.0, "in": [1.0]}, "nowhere": 1}).count() == 2
    assert relational.apply_filters(mixed, {"b": {"unknown": 1}}).count() == 5
    assert relational.apply_filters(mixed, {"b": {"between": [1, 2]}}).count() == 2
    assert relational.apply_filters(mixed, None).count() == 5


def test_aggregates(mixed):
    assert rows(relational.aggregate(mixed, "sum", ["c"])) == [(18.0,)]
    assert rows(relational.aggregate(mixed.filter("id < 3"), "sum", ["c"])) == [(0.0,)]
    assert relational.aggregate(mixed, "median").columns == ["id_median", "b_median", "c_median"]
    assert rows(relational.aggregate(mixed, "median", ["b"])) == [(3.0,)]
    assert relational.aggregate(mixed, "mode", ["b"]).count() == 0
    with pytest.raises(ValueError, match="missing column"):
        relational.aggregate(mixed, "mean", ["nowhere"])


def test_profiles(mixed):
    assert rows(profiling.value_counts(mixed, "state_abb")) == [("TX", 1), ("TX ", 1), ("tx", 1)]
    kinds = dict(rows(profiling.infer_column_kind(mixed), "column", "kind"))
    assert kinds == {"id": "numeric", "state_abb": "text", "b": "numeric", "c": "numeric", "flag": "text"}
    spark = mixed.sparkSession
    other = spark.createDataFrame([(i, "ABACB"[i], "x") for i in range(5)], "n long, t string, lon_label string")
    kinds = dict(rows(profiling.infer_column_kind(other.withColumn("lon_label", F.concat("lon_label", "n"))), "column", "kind"))
    assert kinds == {"n": "identifier", "t": "text", "lon_label": "unknown"}
    flags = spark.createDataFrame([(True,), (False,), (True,)], "flag boolean")
    assert rows(profiling.infer_column_kind(flags), "kind") == [("numeric",)]
    figures = profiling.column_profile(flags).first()
    assert (figures["is_numeric"], figures["min"], figures["max"], figures["median"]) == (True, 0.0, 1.0, 1.0)
    gap = profiling.column_profile(mixed).filter("column = 'flag'").first()
    assert (gap["is_numeric"], gap["mean"], gap["median"]) == (False, None, None)
    table = {r["state_abb"]: r.asDict() for r in profiling.crosstab(mixed, "state_abb", "flag").collect()}
    assert table["tx"] == {"state_abb": "tx", "false": 1, "true": 0}
    week = rows(profiling.weekly_pattern(spark.createDataFrame([(0,), (6,), (6,), (None,)], "day_of_week int")), "weekday", "count")
    assert week[0] == ("Monday", 1) and week[6] == ("Sunday", 2) and week[3] == ("Thursday", 0)


def test_quality(mixed):
    issues = {(r["issue"], r["column"]): r["count"] for r in quality.quality_issues(mixed).collect()}
    assert issues == {
        ("missing", "state_abb"): 2, ("missing", "b"): 1, ("missing", "c"): 3, ("missing", "flag"): 1,
        ("duplicate_rows", None): 1, ("mixed_case", "state_abb"): 1, ("outer_spaces", "state_abb"): 1,
    }
    fixes = {(r["issue"], r["column"]): r["suggestion"] for r in quality.suggest_fixes(quality.quality_issues(mixed)).collect()}
    assert fixes["missing", "c"] == "remove the column" and fixes["missing", "b"] == "impute the column"
    empty = mixed.filter("id > 9")
    assert rows(quality.duplicate_rows(empty)) == [(0, 0, 0.0)]
    assert quality.insights(empty).count() > 0
    tab = mixed.sparkSession.createDataFrame([("\ta",)], "t string")
    assert quality.quality_issues(tab).first()["issue"] == "outer_spaces"


def test_outliers(spark):
    values = [0.0] * 20 + [100.0]
    table = spark.createDataFrame([(i, v, 3.0) for i, v in enumerate(values)], "id long, v double, constant double")
    z = {r["column"]: r["count"] for r in outliers.zscore_outliers(table, ["v", "constant"]).collect()}
    assert z == {"v": 1, "constant": 0}
    assert rows(outliers.zscore_outlier_rows(table, "v", "id"), "id") == [(20,)]
    fences = {r["column"]: (r["lower_bound"], r["upper_bound"], r["count"]) for r in outliers.iqr_outliers(table, ["v", "constant"]).collect()}
    assert fences == {"v": (0.0, 0.0, 1), "constant": (3.0, 3.0, 0)}


def test_association(spark):
    data = [(1.0, 1.0, "a", 7.0), (2.0, 4.0, "a", 7.0), (3.0, 9.0, "b", 7.0), (4.0, 16.0, "b", 7.0), (None, 1.0, "b", 7.0)]
    table = spark.createDataFrame(data, "x double, y double, g string, k double")
    pearson = {(r[0], r[1]): r[2] for r in rows(association.pearson_matrix(table))}
    assert pearson["x", "k"] is None and abs(pearson["x", "y"] - 0.984374) < 1e-6
    spearman = {(r[0], r[1]): r[2] for r in rows(association.spearman_matrix(table, ["x", "y"]))}
    assert abs(spearman["x", "y"] - 1.0) < 1e-12
    f = {(r["category"], r["variable"]): r["f_statistic"] for r in association.anova_f(table, ["g"], ["x", "k"]).collect()}
    assert abs(f["g", "x"] - 8.0) < 1e-9 and f["g", "k"] is None
    tested = association.anova(table, ["g"], ["x"]).first()
    assert tested["p_value"] == 0.106 and tested["significant"] is False
    scaled = rows(association.scale_features(table, ["x", "k"]).orderBy("x"))
    assert abs(scaled[0][0] + 3 / math.sqrt(5)) < 1e-12 and {r[1] for r in scaled} == {0.0}
    with pytest.raises(ValueError, match="at least two"):
        association.pearson_matrix(table, ["x"])


@pytest.mark.parametrize(
    "f, between, within",
    [(1.0, 2, 10.0), (20.0, 4, 5.0), (1e-3, 2, 1.0), (1e9, 4, 3.0), (1.05, 400, 1e7), (1.3, 200, 1e12), (0.3, 10, 1e12), (5.0, 2, 1e12)],
)
def test_f_tail(f, between, within):
    """Against the finite sum that even numerator degrees have, up to 10^12 denominator degrees."""
    a, y = within / 2, between * f / (within + between * f)
    term = total = 1.0
    for i in range(1, between // 2):
        term *= (a + i - 1) / i * y
        total += term
    wanted = math.exp(-a * math.log1p(between * f / within)) * total
    assert abs(association.f_tail(f, float(between), within) / wanted - 1) < 1e-9


@pytest.mark.parametrize("degrees", [1.0, 3.0, 1e3, 1e6, 1e12])
def test_f_tail_mirrored(degrees):
    assert abs(association.f_tail(1.0, degrees, degrees) - 0.5) < 1e-9
    assert abs(association.f_tail(1.000001, degrees, 2 * degrees) + association.f_tail(1 / 1.000001, 2 * degrees, degrees) - 1) < 1e-9
    assert association.f_tail(0.0, degrees, 5.0) == 1.0 and association.f_tail(1e300, 7.0, degrees) < 1e-100


def test_utilization_edges(spark):
    data = [(i, "p", 100.0) for i in range(3)] + [(3, "zero", 0.0), (4, "none", None), (5, None, 5.0)]
    table = spark.createDataFrame(data, "obs_id long, pipeline_name string, scheduled_quantity double")
    capacity = operations.infer_capacity(table)
    assert dict(rows(capacity)) == {"p": 100.0, "zero": 0.0, "none": None}
    used = {r["obs_id"]: r["utilization"] for r in operations.utilization(table, capacity).collect()}
    assert used == {0: 1.0, 1: 1.0, 2: 1.0, 3: None, 4: None, 5: None}
    nothing = operations.capacity_summary(capacity.filter("pipeline_name = 'nowhere'"))
    assert rows(nothing) == [(0, 0.0, 0.0, 0.0)]


def test_bottleneck_edges(spark):
    """Nine high rows are too few, ten are enough; rows that are not high extend the dates; one pipeline works."""
    start = dt.datetime(2024, 1, 1)

    def table(high):
        return spark.createDataFrame(
            [(i, "p", "l", start + dt.timedelta(days=2 * i), 0.9 if i < high else 0.85) for i in range(14)],
            "obs_id long, pipeline_name string, loc_name string, eff_gas_day timestamp, utilization double",
        )

    assert operations.detect_bottlenecks(table(9)).count() == 0
    found = operations.detect_bottlenecks(table(10)).first()
    assert found["high_util_days"] == 1 and found["peak_utilization"] == 0.9
    assert found["first_bottleneck_date"] == start + dt.timedelta(days=18)
    assert found["last_bottleneck_date"] == start + dt.timedelta(days=26)
    by_day = operations.rolling_high_util(table(14), window=5, calendar_days=True)
    assert max(r["rolling_high_count"] for r in by_day.collect()) == 3


def test_near_locations(spark):
    radius = 20 / 111
    places = spark.createDataFrame(
        [("a", 30.0, -90.0), ("a", 30.0, -90.0), ("b", 30.0 + radius * 1.5, -90.0), ("c", None, -90.0)],
        "loc_name string, latitude double, longitude double",
    )
    at = [(1, 30.0, -90.0), (2, 30.0 + radius * 0.8, -90.0), (3, 30.0, -90.0 + radius * 0.99), (4, 30.0, -90.0 + radius * 1.01), (5, None, 0.0)]
    vessels = spark.createDataFrame(at, "mmsi long, latitude double, longitude double")
    near = proximity.vessels_near_locations(vessels, proximity.locations_of(places))
    assert sorted(rows(near, "mmsi", "loc_name")) == [(1, "a"), (2, "a"), (2, "b"), (3, "a")]
    assert rows(proximity.vessel_summary(vessels, near)) == [(5, 4, 2)]


def test_sources(spark, tmp_path):
    text = "a,b\n1,x\n2,\n"
    (tmp_path / "t.csv").write_text(text)
    (tmp_path / "t.csv.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "page.csv").write_text("\n  <!DOCTYPE html><html></html>\n")
    (tmp_path / "t.xyz").write_text(text)
    for name in ("t.csv", "t.csv.gz"):
        assert rows(read_table(spark, str(tmp_path / name))) == [(1, "x"), (2, None)]
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "nowhere.parquet"))
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "nowhere.csv"))
    with pytest.raises(ValueError, match="unsupported"):
        read_table(spark, str(tmp_path / "t.xyz"))
    with pytest.raises(ValueError, match="HTML"):
        read_table(spark, str(tmp_path / "page.csv"))
    found = {r["path"].rsplit("/", 1)[1]: r["is_html"] for r in html_payload_scan(spark, str(tmp_path)).collect()}
    assert found == {"t.csv": False, "t.csv.gz": False, "page.csv": True, "t.xyz": False}
    nans = spark.createDataFrame([(1, float("nan"))], "a int, b double")
    profile = str(tmp_path / "profile")
    write_profile({"first": nans, "second": nans.select("a")}, profile)
    broken = nans.select(F.raise_error(F.lit("broken")).cast("string").alias("b"))
    with pytest.raises(Exception, match="broken"):
        write_profile({"first": nans.limit(0), "second": broken}, profile)
    assert {n: s.count() for n, s in read_profile(spark, profile).items()} == {"first": 1, "second": 1}
    write_profile({"third": nans}, profile)
    assert list(read_profile(spark, profile)) == ["third"]


def test_lines_of_too_many_fields(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text('a,b,_line\n1,x,p\n2\n3,"y,z",q,9\n4,w,r,\n5,"v,v",s\n')
    good = [(1, "x", "p"), (2, None, None), (4, "w", "r"), (5, "v,v", "s")]
    table = read_table(spark, path, malformed="leave")
    assert table.columns == ["a", "b", "_line"] and rows(table) == good and table.count() == 4
    assert [r.line for r in rejected_lines(spark, path).collect()] == ['3,"y,z",q,9']
    for read in (lambda t: t.count(), lambda t: t.select("b").collect()):
        with pytest.raises(Exception, match="too many fields"):
            read(read_table(spark, path))
    with pytest.raises(ValueError):
        read_table(spark, path, malformed="ignore")


def test_first_bytes_of_long_files(spark, tmp_path):
    (tmp_path / "long page").write_bytes(b"\n<html>" + b"x" * 70_000_000)
    (tmp_path / "empty").write_bytes(b"")
    found = {r["path"].rsplit("/", 1)[1]: (r["length"], r["is_html"]) for r in html_payload_scan(spark, str(tmp_path)).collect()}
    assert found == {"long page": (70_000_007, True)}  # Spark lists no empty files


def test_composites(spark, small):
    with pytest.raises(ValueError, match="complete rows"):
        analyses.detect_anomalies(small.withColumn("id", F.monotonically_increasing_id()), "id")
    sections = analyses.simple_query(small, {"state_abb": "TX"}, aggregation="count")
    assert rows(sections["size"]) == [(1, 8)] and rows(sections["aggregation"]) == [(1,) * 9]
    factors = analyses.factor_analysis(cleaning.date_parts(small))
    assert rows(factors["quantity_by_state"])[0] == ("LA", 2000.0, 2000.0, None, 1)
    general = analyses.general_analysis(small, "pipeline_name")
    assert "anomalies" not in general and general["insights"].count() > 0
