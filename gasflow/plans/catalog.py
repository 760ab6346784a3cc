"""The registered queries, each beside SQL for the same result on the driver's tables.

Queries run over whole tables. Doubles are rounded on both sides; a query without SQL is iterative or
randomised and is tested against brute force instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gasflow.functions.sizing import scratch_folder
from gasflow.operators import association, cleaning, dbscan as density, forest, kmeans, matching, operations
from gasflow.operators import outliers, profiling, proximity, quality, relational
from gasflow.plans import analyses
from gasflow.sources.files import html_payload_rows, read_profile, read_table, rejected_lines, write_profile
from gasflow.sources.views import gas_obs, load, vessel_messages, vessels
from gasflow.streaming.vessels import collect_vessels, decode_vessels, tag_vessels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

GAS = """gas_obs AS (
  SELECT o_orderkey AS obs_id, n_name AS pipeline_name, c_mktsegment AS loc_name,
    CASE WHEN o_orderkey % 4 = 0 THEN c_name END AS connecting_pipeline,
    CASE WHEN o_orderkey % 5 <> 0 THEN c_name END AS connecting_entity,
    o_orderstatus AS rec_del_sign, o_orderpriority AS category_short, r_name AS country_name, n_name AS state_abb,
    CAST(25 AS DOUBLE) + CAST(c_custkey % 200 AS DOUBLE) / CAST(10 AS DOUBLE) AS latitude,
    CAST(-125 AS DOUBLE) + CAST(c_custkey * 7 % 600 AS DOUBLE) / CAST(10 AS DOUBLE) AS longitude,
    CAST(o_orderdate AS TIMESTAMP) AS eff_gas_day,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS scheduled_quantity
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)"""
DATED = (
    GAS
    + """, dated AS (
  SELECT *, CAST(year(eff_gas_day) AS INT) AS year, CAST(month(eff_gas_day) AS INT) AS month,
    CAST(isodow(eff_gas_day) - 1 AS INT) AS day_of_week, CAST(quarter(eff_gas_day) AS INT) AS quarter
  FROM gas_obs)"""
)
VESSELS = """vessels AS (
  SELECT event_id, user_id AS mmsi, ts AS timestamp,
    CAST(25 AS DOUBLE) + CAST(event_id * 13 % 2000 AS DOUBLE) / CAST(100 AS DOUBLE) AS latitude,
    CAST(-125 AS DOUBLE) + CAST(event_id * 29 % 6000 AS DOUBLE) / CAST(100 AS DOUBLE) AS longitude,
    CAST(60 + event_id % 30 AS INT) AS vessel_type
  FROM events)"""
CAPACITY = """capacity AS (
  SELECT pipeline_name, quantile_cont(scheduled_quantity, 0.95) AS capacity FROM gas_obs GROUP BY 1)"""
USED = (
    CAPACITY
    + """, used AS (
  SELECT g.*, capacity, scheduled_quantity / NULLIF(capacity, 0) AS utilization
  FROM gas_obs g LEFT JOIN capacity USING (pipeline_name))"""
)
ROLLED = """rolled AS (
  SELECT *, COALESCE(utilization > 0.85, false) AS high_util,
    CAST(SUM(CASE WHEN utilization > 0.85 THEN 1 ELSE 0 END) OVER (PARTITION BY pipeline_name
      ORDER BY eff_gas_day NULLS LAST, obs_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling_high_count
  FROM used)"""
NEAR = """locations AS (
  SELECT DISTINCT loc_name, latitude AS loc_latitude, longitude AS loc_longitude FROM gas_obs
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
near AS (
  SELECT v.*, loc_name, loc_latitude, loc_longitude FROM vessels v JOIN locations
  ON (latitude - loc_latitude) * (latitude - loc_latitude) + (longitude - loc_longitude) * (longitude - loc_longitude)
     < (CAST(20 AS DOUBLE) / 111) * (CAST(20 AS DOUBLE) / 111))"""

OBS_COLUMNS = [
    "obs_id", "pipeline_name", "loc_name", "connecting_pipeline", "connecting_entity", "rec_del_sign",
    "category_short", "country_name", "state_abb", "latitude", "longitude", "eff_gas_day", "scheduled_quantity",
]
OBS_TEXT = [
    "pipeline_name", "loc_name", "connecting_pipeline", "connecting_entity", "rec_del_sign", "category_short",
    "country_name", "state_abb",
]
PARTS = ["year", "month", "day_of_week", "quarter"]
DATED_NUMBERS = ["obs_id", "latitude", "longitude", "scheduled_quantity", *PARTS]
FEATURES = ["scheduled_quantity", "month", "day_of_week"]
ITEM_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, places) for c in doubles})


def dated(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.date_parts(gas_obs(spark, folder))


def with_utilization(spark: SparkSession, folder: str) -> DataFrame:
    obs = gas_obs(spark, folder)
    return operations.utilization(obs, operations.infer_capacity(obs))


def each(columns: list[str], template: str) -> str:
    """One SELECT per column, put together."""
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


# Sources


@query("read_table", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def _(spark, folder):
    return read_table(spark, f"{folder}/part.parquet")


@query(
    "html_payload_rows",
    r"""SELECT page_id, starts_with(regexp_replace(html[:512], '^\s+', ''), '<!DOCTYPE html')
    OR starts_with(regexp_replace(html[:512], '^\s+', ''), '<html') AS is_html FROM pages""",
)
def _(spark, folder):
    return html_payload_rows(load(spark, folder, "pages"), "html").select("page_id", "is_html")


def _orders_as_csv(spark: SparkSession, folder: str) -> str:
    """The orders as CSV lines without quotes; every 97th has a field too many and every 89th of the others ends early."""
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("string").alias("price"))
    key, line = F.col("o_orderkey"), F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", "price")
    cut = F.concat_ws(",", key.cast("string"), "o_orderstatus")
    path = scratch_folder(spark, "orders") + ".csv"
    orders.select(F.when(key % 97 == 0, F.concat(line, F.lit(",surplus"))).when(key % 89 == 0, cut).otherwise(line).alias("value")).write.text(path)
    return path


_ORDER_LINES = T.StructType([T.StructField("key", T.LongType()), T.StructField("status", T.StringType()), T.StructField("price", T.DoubleType())])


@query(
    "read_table_csv",
    """SELECT o_orderkey AS key, o_orderstatus AS status, CASE WHEN o_orderkey % 89 <> 0 THEN ROUND(CAST(o_totalprice AS DOUBLE), 4) END AS price
    FROM orders WHERE o_orderkey % 97 <> 0""",
)
def _(spark, folder):
    table = read_table(spark, _orders_as_csv(spark, folder), _ORDER_LINES, malformed="leave", header=False)
    return table.withColumn("price", F.round("price", 4))


@query("rejected_lines", "SELECT o_orderkey AS key, 4 AS fields FROM orders WHERE o_orderkey % 97 = 0")
def _(spark, folder):
    fields = F.split("line", ",")
    return rejected_lines(spark, _orders_as_csv(spark, folder), _ORDER_LINES, header=False).select(fields[0].cast("long").alias("key"), F.size(fields).alias("fields"))


@query("write_profile", "SELECT 'orders' AS section, COUNT(*) AS row_count FROM orders UNION ALL SELECT 'customers', COUNT(*) FROM customer")
def _(spark, folder):
    path = scratch_folder(spark, "profile")
    write_profile({"orders": load(spark, folder, "orders"), "customers": load(spark, folder, "customer")}, path)
    counted = [s.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("section"), "row_count") for name, s in read_profile(spark, path).items()]
    return counted[0].unionByName(counted[1])


# Cleaning

_TYPES = {"obs_id": "bigint", "latitude": "double", "longitude": "double", "eff_gas_day": "timestamp", "scheduled_quantity": "double"}


@query(
    "missing_report",
    f"WITH {GAS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS missing_count,
        ROUND((COUNT(*) - COUNT({c})) / COUNT(*), 6) AS missing_rate, COUNT({c}) AS non_missing_count,
        '{_TYPES.get(c, "string")}' AS data_type FROM gas_obs"""
        for c in OBS_COLUMNS
    ),
)
def _(spark, folder):
    return rounded(cleaning.missing_report(gas_obs(spark, folder)), 6)


_MISSING_CELLS = " + ".join(f"COUNT(*) - COUNT({c})" for c in OBS_COLUMNS)
_MISSING_COLUMNS = " + ".join(f"CASE WHEN COUNT({c}) < COUNT(*) THEN 1 ELSE 0 END" for c in OBS_COLUMNS)


@query(
    "missing_summary",
    f"""WITH {GAS} SELECT COUNT(*) AS total_rows, CAST(13 AS BIGINT) AS total_columns, COUNT(*) * 13 AS total_cells,
    {_MISSING_CELLS} AS total_missing_values, CAST({_MISSING_COLUMNS} AS BIGINT) AS columns_with_missing,
    ROUND(({_MISSING_CELLS}) / (COUNT(*) * 13), 6) AS overall_missing_rate FROM gas_obs""",
)
def _(spark, folder):
    return rounded(cleaning.missing_summary(gas_obs(spark, folder)), 6)


@query(
    "drop_sparse_columns",
    f"WITH {GAS} SELECT {', '.join(c for c in OBS_COLUMNS if c != 'connecting_pipeline')} FROM gas_obs",
)
def _(spark, folder):
    return cleaning.drop_sparse_columns(gas_obs(spark, folder))


@query("drop_unusable_geo", f"WITH {GAS} SELECT obs_id, pipeline_name FROM gas_obs")
def _(spark, folder):
    obs = gas_obs(spark, folder).select("obs_id", "pipeline_name", "latitude", "longitude")
    never = F.col("obs_id") < 0
    blank = obs.withColumns({c: F.when(never, F.col(c)) for c in ("latitude", "longitude")})
    return cleaning.drop_unusable_geo(blank)


@query(
    "impute_connecting",
    f"""WITH {GAS} SELECT obs_id, COALESCE(connecting_pipeline, 'None') AS connecting_pipeline,
    connecting_pipeline IS NULL AS connecting_pipeline_missing FROM gas_obs""",
)
def _(spark, folder):
    return cleaning.impute_connecting(gas_obs(spark, folder).select("obs_id", "connecting_pipeline"), threshold=0.8)


@query(
    "impute_categories",
    f"""WITH {GAS} SELECT obs_id, COALESCE(connecting_entity, 'Unknown') AS connecting_entity,
    connecting_entity IS NULL AS connecting_entity_missing, category_short, state_abb FROM gas_obs""",
)
def _(spark, folder):
    obs = gas_obs(spark, folder).select("obs_id", "connecting_entity", "category_short", "state_abb")
    return cleaning.impute_categories(obs)


@query(
    "drop_missing_quantity",
    f"WITH {GAS} SELECT obs_id, scheduled_quantity FROM gas_obs WHERE scheduled_quantity IS NOT NULL",
)
def _(spark, folder):
    return cleaning.drop_missing_quantity(gas_obs(spark, folder)).select("obs_id", "scheduled_quantity")


@query(
    "impute_group_median",
    f"""WITH {DATED}, medians AS (SELECT pipeline_name, day_of_week, median(scheduled_quantity) AS m FROM dated GROUP BY ALL)
    SELECT obs_id, ROUND(COALESCE(scheduled_quantity, m, (SELECT median(scheduled_quantity) FROM dated)), 4) AS scheduled_quantity,
    scheduled_quantity IS NULL AS scheduled_quantity_missing
    FROM dated LEFT JOIN medians USING (pipeline_name, day_of_week)""",
)
def _(spark, folder):
    filled = cleaning.impute_group_median(gas_obs(spark, folder))
    return rounded(filled.select("obs_id", "scheduled_quantity", "scheduled_quantity_missing"))


@query(
    "parse_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS day
    FROM orders""",
)
def _(spark, folder):
    text = F.when(F.col("o_orderkey") % 3 == 0, "no day").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return cleaning.parse_dates(load(spark, folder, "orders").select("o_orderkey", text.alias("day")), "day")


@query(
    "coerce_numeric",
    """SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE CAST(p_retailprice AS VARCHAR) END AS DOUBLE)
    AS price FROM part""",
)
def _(spark, folder):
    price = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_retailprice").cast("string"))
    return cleaning.coerce_numeric(load(spark, folder, "part").select("p_partkey", price.alias("price")), ["price"])


@query("date_parts", f"WITH {DATED} SELECT obs_id, year, month, day_of_week, quarter FROM dated")
def _(spark, folder):
    return dated(spark, folder).select("obs_id", *PARTS)


_BINNED = """binned AS (SELECT *, CASE WHEN scheduled_quantity <= q[1] THEN 'Low' WHEN scheduled_quantity <= q[2] THEN 'Medium'
    WHEN scheduled_quantity <= q[3] THEN 'High' WHEN scheduled_quantity IS NOT NULL THEN 'Very High' END AS quantity_category
    FROM dated, (SELECT quantile_cont(scheduled_quantity, [0.25, 0.5, 0.75]) AS q FROM dated))"""
_PLACED = """placed AS (SELECT *, CASE WHEN latitude >= la AND longitude >= lo THEN 'NE' WHEN latitude >= la AND longitude < lo THEN 'NW'
    WHEN latitude < la AND longitude >= lo THEN 'SE' WHEN latitude < la AND longitude < lo THEN 'SW' ELSE 'Unknown' END AS geographic_quadrant
    FROM dated, (SELECT median(latitude) AS la, median(longitude) AS lo FROM dated WHERE latitude IS NOT NULL AND longitude IS NOT NULL))"""


@query("quantity_bins", f"WITH {DATED}, {_BINNED} SELECT obs_id, quantity_category FROM binned")
def _(spark, folder):
    return cleaning.quantity_bins(gas_obs(spark, folder)).select("obs_id", "quantity_category")


@query("geo_quadrant", f"WITH {DATED}, {_PLACED} SELECT obs_id, geographic_quadrant FROM placed")
def _(spark, folder):
    return cleaning.geo_quadrant(gas_obs(spark, folder)).select("obs_id", "geographic_quadrant")


@query("clean_column_names", "SELECT p_partkey AS part_key, p_name AS name_of_part, p_size AS size FROM part")
def _(spark, folder):
    part = load(spark, folder, "part")
    odd = part.select(F.col("p_partkey").alias("Part  Key!"), F.col("p_name").alias("_Name of_Part_"), F.col("p_size").alias("(Size)"))
    return cleaning.clean_column_names(odd)


_OBS_TYPES = {"obs_id": "bigint", "latitude": "double", "longitude": "double", "eff_gas_day": "timestamp", "scheduled_quantity": "double"}


@query(
    "validate_columns",
    f"WITH {GAS} SELECT 'county_name' AS \"column\", 'missing' AS status, CAST(NULL AS VARCHAR) AS suggestion, "
    "CAST(NULL AS VARCHAR) AS data_type, CAST(NULL AS BIGINT) AS non_null, true AS is_valid"
    + "".join(
        f" UNION ALL SELECT '{c}', '{'extra' if c == 'obs_id' else 'present'}', NULL, '{_OBS_TYPES.get(c, 'string')}', COUNT({c}), true FROM gas_obs"
        for c in OBS_COLUMNS
    ),
)
def _(spark, folder):
    return cleaning.validate_columns(gas_obs(spark, folder))


@query(
    "fuzzy_match_top1",
    r"""WITH l AS (SELECT DISTINCT p_name || ' ' || p_brand AS left_name FROM part),
    r AS (SELECT p_name || '_' || p_type AS right_name FROM part UNION SELECT p_type FROM part),
    pairs AS (SELECT left_name, right_name, lower(left_name) AS a, lower(right_name) AS b,
      list_distinct(string_split_regex(lower(left_name), '[_\s]+')) AS wa,
      list_distinct(string_split_regex(lower(right_name), '[_\s]+')) AS wb FROM l, r),
    scored AS (SELECT left_name, right_name, CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.8
      ELSE len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) END AS score FROM pairs)
    SELECT left_name, right_name, ROUND(CAST(score AS DOUBLE), 6) AS score FROM scored WHERE score >= 0.6
    QUALIFY row_number() OVER (PARTITION BY left_name ORDER BY score DESC, right_name) = 1""",
)
def _(spark, folder):
    part = load(spark, folder, "part")
    left = part.select(F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    right = part.select(F.concat_ws("_", "p_name", "p_type").alias("name")).union(part.select("p_type"))
    return rounded(matching.fuzzy_match_top1(left, right), 6)


@query(
    "clean",
    f"""WITH {DATED}, kept AS (SELECT * FROM dated WHERE scheduled_quantity IS NOT NULL),
    {_BINNED.replace("dated", "kept")}, {_PLACED.replace("dated", "kept")}
    SELECT b.obs_id, b.pipeline_name, b.loc_name, COALESCE(b.connecting_entity, 'Unknown') AS connecting_entity, b.rec_del_sign,
    b.category_short, b.country_name, b.state_abb, ROUND(b.latitude, 4) AS latitude, ROUND(b.longitude, 4) AS longitude,
    b.eff_gas_day, b.scheduled_quantity, b.connecting_entity IS NULL AS connecting_entity_missing, b.year, b.month, b.day_of_week,
    b.quarter, quantity_category, geographic_quadrant FROM binned b JOIN placed p USING (obs_id)""",
)
def _(spark, folder):
    return rounded(analyses.clean(gas_obs(spark, folder)))


# Relational


def _filtered(name, where, filters):
    @query(name, f"WITH {DATED} SELECT obs_id, state_abb, eff_gas_day, scheduled_quantity FROM dated WHERE {where}")
    def _(spark, folder):
        kept = relational.apply_filters(dated(spark, folder), filters)
        return kept.select("obs_id", "state_abb", "eff_gas_day", "scheduled_quantity")


_filtered("filter_equals", "state_abb = 'NATION_7'", {"state_abb": "NATION_7", "no_such_column": 1})
_filtered("filter_in", "state_abb IN ('NATION_1', 'NATION_2') AND year = 1998", {"state_abb": {"in": ["NATION_1", "NATION_2"]}, "year": {"equals": 1998}})
_filtered("filter_greater_than", "scheduled_quantity > 400000", {"scheduled_quantity": {"greater_than": 400000}})
_filtered("filter_less_than", "scheduled_quantity < 20000", {"scheduled_quantity": {"less_than": 20000}})
_filtered("filter_between", "year BETWEEN 1996 AND 1997", {"year": {"between": [1996, 1997]}})


@query("select_columns", f"WITH {GAS} SELECT pipeline_name, scheduled_quantity FROM gas_obs")
def _(spark, folder):
    return relational.select_columns(gas_obs(spark, folder), ["pipeline_name", "scheduled_quantity"])


@query("sample_rows", f"WITH {GAS} SELECT {', '.join(OBS_COLUMNS)} FROM gas_obs ORDER BY obs_id LIMIT 20")
def _(spark, folder):
    return relational.sample_rows(gas_obs(spark, folder), "obs_id")


@query("unique_values", "SELECT DISTINCT CAST(c_name AS VARCHAR) AS value FROM customer WHERE c_name IS NOT NULL ORDER BY 1 LIMIT 50")
def _(spark, folder):
    return relational.unique_values(load(spark, folder, "customer"), "c_name")


@query(
    "drop_incomplete",
    f"""WITH {GAS} SELECT obs_id, connecting_entity, scheduled_quantity FROM gas_obs
    WHERE connecting_entity IS NOT NULL AND scheduled_quantity IS NOT NULL""",
)
def _(spark, folder):
    obs = gas_obs(spark, folder).select("obs_id", "connecting_entity", "scheduled_quantity")
    return relational.drop_incomplete(obs, ["connecting_entity", "scheduled_quantity"])


@query(
    "top_k",
    f"""WITH {GAS} SELECT obs_id, pipeline_name, scheduled_quantity FROM gas_obs
    ORDER BY scheduled_quantity DESC NULLS LAST, obs_id LIMIT 10""",
)
def _(spark, folder):
    return relational.top_k(gas_obs(spark, folder).select("obs_id", "pipeline_name", "scheduled_quantity"), "scheduled_quantity", "obs_id")


@query(
    "aggregate_count_all",
    f"WITH {GAS} SELECT COUNT(*) AS total_count, " + ", ".join(f"COUNT({c}) AS {c}_count" for c in OBS_COLUMNS) + " FROM gas_obs",
)
def _(spark, folder):
    return relational.aggregate(gas_obs(spark, folder), "count")


@query(
    "aggregate_count",
    f"""WITH {GAS} SELECT COUNT(*) AS total_count, COUNT(connecting_entity) AS connecting_entity_count,
    COUNT(scheduled_quantity) AS scheduled_quantity_count FROM gas_obs""",
)
def _(spark, folder):
    return relational.aggregate(gas_obs(spark, folder), "count", ["connecting_entity", "scheduled_quantity"])


def _aggregated(how, function):
    parts = ", ".join(f"ROUND({function}({c}), 2) AS {c}_{how}" for c in ITEM_NUMBERS)

    @query(f"aggregate_{how}", f"SELECT {parts} FROM lineitem")
    def _(spark, folder):
        return rounded(relational.aggregate(load(spark, folder, "lineitem"), how, ITEM_NUMBERS), 2)


for _how, _function in {"sum": "SUM", "mean": "AVG", "median": "median", "max": "MAX", "min": "MIN"}.items():
    _aggregated(_how, _function)


# Profiling

_DESCRIBE = """SELECT '{c}' AS "column", COUNT({c}) AS count, ROUND(CAST(AVG({c}) AS DOUBLE), 4) AS mean, ROUND(stddev_samp({c}), 4) AS std,
    ROUND(CAST(MIN({c}) AS DOUBLE), 4) AS min, ROUND(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 4) AS q25,
    ROUND(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 4) AS q50, ROUND(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 4) AS q75,
    ROUND(CAST(MAX({c}) AS DOUBLE), 4) AS max"""


@query("describe_numeric", f"WITH {DATED} " + each(DATED_NUMBERS, _DESCRIBE + " FROM dated"))
def _(spark, folder):
    return rounded(profiling.describe_numeric(dated(spark, folder)))


_MOMENTS = """SELECT '{c}' AS "column", ROUND(AVG(POWER(x, 3)) / POWER(AVG(x * x), 1.5), 4) AS skewness,
    ROUND(AVG(POWER(x, 4)) / POWER(AVG(x * x), 2) - 3, 4) AS kurtosis
    FROM (SELECT CAST({c} AS DOUBLE) - (SELECT AVG({c}) FROM lineitem) AS x FROM lineitem)"""


@query("moments", each(ITEM_NUMBERS, _MOMENTS))
def _(spark, folder):
    return rounded(profiling.moments(load(spark, folder, "lineitem"), ITEM_NUMBERS), 4)


@query(
    "value_counts",
    f"""WITH {GAS} SELECT connecting_entity AS value, COUNT(*) AS count FROM gas_obs WHERE connecting_entity IS NOT NULL
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _(spark, folder):
    return profiling.value_counts(gas_obs(spark, folder), "connecting_entity")


_CATEGORY = """SELECT '{c}' AS "column", (SELECT COUNT(DISTINCT {c}) FROM gas_obs) AS unique_count,
    (SELECT COUNT(*) - COUNT({c}) FROM gas_obs) AS missing_count,
    ROUND((SELECT COUNT(DISTINCT {c}) / COUNT(*) FROM gas_obs), 6) AS diversity_index, CAST(position AS INT) AS position, value, count
    FROM (SELECT {c} AS value, COUNT(*) AS count, row_number() OVER (ORDER BY COUNT(*) DESC, {c}) AS position
      FROM gas_obs WHERE {c} IS NOT NULL GROUP BY 1) WHERE position <= 10"""


@query("category_summary", f"WITH {GAS} " + each(OBS_TEXT, _CATEGORY))
def _(spark, folder):
    return rounded(profiling.category_summary(gas_obs(spark, folder)), 6)


_STATS = """SELECT {k}, ROUND(AVG(scheduled_quantity), 4) AS mean, ROUND(median(scheduled_quantity), 4) AS median,
    {std} COUNT(scheduled_quantity) AS count FROM dated WHERE {k} IS NOT NULL GROUP BY {k}"""
_STD = "ROUND(stddev_samp(scheduled_quantity), 4) AS std,"


@query(
    "group_stats_by_state",
    f"WITH {DATED} " + _STATS.replace("{k}", "state_abb").replace("{std}", _STD) + " ORDER BY AVG(scheduled_quantity) DESC, state_abb LIMIT 10",
)
def _(spark, folder):
    return rounded(profiling.group_stats(gas_obs(spark, folder), "state_abb", top=10))


@query("group_stats_by_category", f"WITH {DATED} " + _STATS.replace("{k}", "category_short").replace("{std}", _STD))
def _(spark, folder):
    return rounded(profiling.group_stats(gas_obs(spark, folder), "category_short"))


@query("group_stats_by_month", f"WITH {DATED} " + _STATS.replace("{k}", "month").replace("{std}", ""))
def _(spark, folder):
    return rounded(profiling.group_stats(dated(spark, folder), "month", with_std=False))


def _by_period(part):
    @query(f"count_by_{part}", f"WITH {DATED} SELECT {part}, COUNT(*) AS count FROM dated WHERE {part} IS NOT NULL GROUP BY 1 ORDER BY 1")
    def _(spark, folder):
        return profiling.count_by_period(dated(spark, folder), part)


for _part in ("year", "month", "day_of_week"):
    _by_period(_part)


@query(
    "weekly_pattern",
    f"""WITH {DATED}, week(day_number, weekday) AS (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'),
    (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday'))
    SELECT day_number, weekday, COUNT(obs_id) AS count FROM week
    LEFT JOIN dated ON day_of_week = day_number GROUP BY ALL""",
)
def _(spark, folder):
    return profiling.weekly_pattern(dated(spark, folder))


_SPAN = """SELECT strftime(MIN(eff_gas_day), '%Y-%m-%d') AS start, strftime(MAX(eff_gas_day), '%Y-%m-%d') AS "end",
    CAST(FLOOR(epoch(MAX(eff_gas_day) - MIN(eff_gas_day)) / 86400) AS BIGINT) AS span_days FROM dated"""


@query("date_span", f"WITH {DATED} {_SPAN}")
def _(spark, folder):
    return profiling.date_span(gas_obs(spark, folder))


_PLACES = """SELECT * FROM (SELECT 'state' AS level, state_abb AS value, COUNT(*) AS count FROM placed GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'country', country_name, COUNT(*) FROM placed GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
    UNION ALL SELECT 'quadrant', geographic_quadrant, COUNT(*) FROM placed GROUP BY 2"""


@query("geographic_counts", f"WITH {DATED}, {_PLACED} {_PLACES}")
def _(spark, folder):
    return profiling.geographic_counts(cleaning.geo_quadrant(gas_obs(spark, folder)))


@query(
    "diversity_index",
    f"""WITH {GAS} SELECT 'connecting_entity' AS "column", COUNT(DISTINCT connecting_entity) AS unique_count, COUNT(*) AS total_rows,
    ROUND(COUNT(DISTINCT connecting_entity) / COUNT(*), 6) AS diversity_index FROM gas_obs""",
)
def _(spark, folder):
    return rounded(profiling.diversity_index(gas_obs(spark, folder), "connecting_entity"), 6)


_STATUS = ("F", "O", "P")


@query(
    "crosstab_category_direction",
    f"WITH {GAS} SELECT category_short, "
    + ", ".join(f"COUNT(*) FILTER (rec_del_sign = '{s}') AS \"{s}\"" for s in _STATUS)
    + " FROM gas_obs GROUP BY 1",
)
def _(spark, folder):
    return profiling.crosstab(gas_obs(spark, folder), "category_short", "rec_del_sign")


@query("crosstab_state_category", f"WITH {GAS} SELECT state_abb, category_short, COUNT(*) AS count FROM gas_obs GROUP BY 1, 2")
def _(spark, folder):
    return profiling.crosstab_long(gas_obs(spark, folder), "state_abb", "category_short")


def _profile_sql():
    selects = []
    for c in OBS_COLUMNS:
        kind = _TYPES.get(c, "string")
        number = kind in ("bigint", "double")
        figures = (
            f"ROUND(CAST(MIN({c}) AS DOUBLE), 4), ROUND(CAST(MAX({c}) AS DOUBLE), 4), ROUND(AVG({c}), 4), ROUND(stddev_samp({c}), 4), ROUND(CAST(median({c}) AS DOUBLE), 4)"
            if number
            else "NULL, NULL, NULL, NULL, NULL"
        )
        selects.append(
            f"SELECT '{c}', '{kind}', COUNT({c}), COUNT(*) - COUNT({c}), COUNT(DISTINCT {c}), {number}, {kind == 'string'}, {kind == 'timestamp'}, {figures} FROM gas_obs"
        )
    names = '"column", dtype, non_null_count, null_count, unique_count, is_numeric, is_categorical, is_datetime, min, max, mean, std, median'
    return f"WITH {GAS}, found({names}) AS ({' UNION ALL '.join(selects)}) SELECT * FROM found"


@query("column_profile", _profile_sql())
def _(spark, folder):
    return rounded(profiling.column_profile(gas_obs(spark, folder)))


_FEW = [c for c in OBS_TEXT if c in ("loc_name", "rec_del_sign", "category_short", "country_name")]


@query(
    "profile_values",
    f"WITH {GAS} "
    + each(
        _FEW,
        """SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY COUNT(*) DESC, {c}) AS INT) AS position, {c} AS value, COUNT(*) AS count
        FROM gas_obs WHERE {c} IS NOT NULL GROUP BY {c}""",
    ),
)
def _(spark, folder):
    return profiling.profile_values(gas_obs(spark, folder))


def _kind_sql():
    dates = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}|\d{4}/\d{2}/\d{2})"
    columns = {"obs_id": "number", "scheduled_quantity": "number", "connecting_pipeline": "text", "country_name": "text",
               "eff_gas_day": "date", "day_text": "text", "latitude_text": "place", "note": "text", "nothing": "text"}
    selects = []
    for c, form in columns.items():
        rule = f"CASE WHEN COUNT({c}) = 0 THEN 'empty' "
        if form == "number":
            rule += f"WHEN COUNT(DISTINCT {c}) = COUNT({c}) THEN 'identifier' ELSE 'numeric' END"
        elif form == "date":
            rule += "ELSE 'datetime' END"
        else:
            rule += f"WHEN AVG(CAST(regexp_matches(CAST({c} AS VARCHAR), '{dates}') AS INT)) > 0.5 THEN 'date_string' "
            rule += f"WHEN COUNT(DISTINCT {c}) < COUNT({c}) * 0.5 THEN 'categorical' "
            rule += f"WHEN COUNT(TRY_CAST({c} AS DOUBLE)) > 0 THEN 'coordinate' ELSE 'unknown' END" if form == "place" else "ELSE 'text' END"
        selects.append(
            f"""SELECT '{c}' AS "column", {rule} AS kind, COUNT(*) - COUNT({c}) AS null_count,
            ROUND((COUNT(*) - COUNT({c})) / COUNT(*) * 100, 6) AS null_percentage, COUNT(DISTINCT {c}) AS unique_count FROM t"""
        )
    return f"""WITH {GAS}, t AS (SELECT obs_id, scheduled_quantity, connecting_pipeline, country_name, eff_gas_day,
      strftime(eff_gas_day, '%Y-%m-%d') AS day_text, CAST(latitude * 10 + obs_id AS VARCHAR) AS latitude_text,
      pipeline_name || '/' || obs_id AS note, CAST(NULL AS VARCHAR) AS nothing FROM gas_obs) {' UNION ALL '.join(selects)}"""


@query("infer_column_kind", _kind_sql())
def _(spark, folder):
    obs = gas_obs(spark, folder).select(
        "obs_id", "scheduled_quantity", "connecting_pipeline", "country_name", "eff_gas_day",
        F.date_format("eff_gas_day", "yyyy-MM-dd").alias("day_text"),
        (F.col("latitude") * 10 + F.col("obs_id")).cast("string").alias("latitude_text"),
        F.concat_ws("/", "pipeline_name", F.col("obs_id").cast("string")).alias("note"),
        F.lit(None).cast("string").alias("nothing"),
    )
    return rounded(profiling.infer_column_kind(obs), 6)


# Quality


@query(
    "duplicate_rows",
    """WITH g AS (SELECT (SELECT COUNT(*) FROM lineitem) AS n, (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM lineitem)) AS kinds)
    SELECT n AS total_rows, n - kinds AS duplicate_rows, ROUND((n - kinds) / n * 100, 6) AS duplicate_percentage FROM g""",
)
def _(spark, folder):
    return rounded(quality.duplicate_rows(load(spark, folder, "lineitem")), 6)


@query(
    "completeness",
    f"""WITH {GAS} SELECT {_MISSING_CELLS} AS total_missing_values, CAST({_MISSING_COLUMNS} AS BIGINT) AS columns_with_missing,
    ROUND(1 - ({_MISSING_CELLS}) / (COUNT(*) * 13), 6) AS completeness_score FROM gas_obs""",
)
def _(spark, folder):
    return rounded(quality.completeness(gas_obs(spark, folder)), 6)


_FLAWED = """flawed AS (SELECT o_orderkey % 5000 AS k,
    CASE WHEN o_orderkey % 7 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS category_short,
    CASE WHEN o_orderkey % 11 = 0 THEN ' ' || o_orderstatus ELSE o_orderstatus END AS sign,
    CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 101 = 0 THEN 9e9 ELSE CAST(o_orderkey % 50 AS DOUBLE) END END AS quantity
    FROM orders)"""
_ISSUES = (
    _FLAWED
    + """, copies AS (SELECT COUNT(*) AS n FROM flawed GROUP BY k, category_short, sign, quantity),
  far AS (SELECT quantile_cont(quantity, 0.25) AS a, quantile_cont(quantity, 0.75) AS b FROM flawed),
  issues AS (
  SELECT 'missing' AS issue, 'quantity' AS "column", COUNT(*) - COUNT(quantity) AS count, (COUNT(*) - COUNT(quantity)) / COUNT(*) * 100 AS percentage FROM flawed
  UNION ALL SELECT 'duplicate_rows', NULL, CAST(SUM(n - 1) AS BIGINT), SUM(n - 1) / SUM(n) * 100 FROM copies HAVING SUM(n - 1) > 0
  UNION ALL SELECT 'mixed_case', 'category_short', COUNT(*), NULL FROM (SELECT upper(category_short) FROM flawed GROUP BY 1 HAVING COUNT(DISTINCT category_short) > 1)
  UNION ALL SELECT 'outer_spaces', 'sign', COUNT(*) FILTER (sign <> trim(sign)), COUNT(*) FILTER (sign <> trim(sign)) / COUNT(sign) * 100 FROM flawed
  UNION ALL SELECT 'far_outliers', 'quantity', COUNT(*) FILTER (quantity < a - 3 * (b - a) OR quantity > b + 3 * (b - a)),
    COUNT(*) FILTER (quantity < a - 3 * (b - a) OR quantity > b + 3 * (b - a)) / COUNT(quantity) * 100 FROM flawed, far)"""
)


def _flawed(spark, folder):
    key = F.col("o_orderkey")
    return load(spark, folder, "orders").select(
        (key % 5000).alias("k"),
        F.when(key % 7 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("category_short"),
        F.when(key % 11 == 0, F.concat(F.lit(" "), "o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("sign"),
        F.when(key % 3 != 0, F.when(key % 101 == 0, 9e9).otherwise((key % 50).cast("double"))).alias("quantity"),
    )


@query("quality_issues", f'WITH {_ISSUES} SELECT issue, "column", count, ROUND(percentage, 6) AS percentage FROM issues')
def _(spark, folder):
    return rounded(quality.quality_issues(_flawed(spark, folder)), 6)


@query(
    "suggest_fixes",
    f"""WITH {_ISSUES} SELECT issue, "column", count, ROUND(percentage, 6) AS percentage,
    CASE WHEN issue = 'missing' AND percentage > 50 THEN 'remove the column' WHEN issue = 'missing' AND percentage > 10 THEN 'impute the column'
    WHEN issue = 'duplicate_rows' THEN 'remove the duplicate rows' WHEN issue IN ('mixed_case', 'outer_spaces') THEN 'standardize the format'
    WHEN issue = 'far_outliers' THEN 'investigate the outliers' END AS suggestion FROM issues""",
)
def _(spark, folder):
    return rounded(quality.suggest_fixes(quality.quality_issues(_flawed(spark, folder))), 6)


@query(
    "dataset_summary",
    f"""WITH {GAS} SELECT COUNT(*) AS rows, CAST(13 AS INT) AS columns, '{",".join(OBS_COLUMNS)}' AS names,
    '{",".join(_TYPES.get(c, "string") for c in OBS_COLUMNS)}' AS types, {_MISSING_CELLS} AS missing_values,
    strftime(MIN(eff_gas_day), '%Y-%m-%d') || ' to ' || strftime(MAX(eff_gas_day), '%Y-%m-%d') AS date_range,
    true AS geo_features_available FROM gas_obs""",
)
def _(spark, folder):
    return quality.dataset_summary(gas_obs(spark, folder))


_INSIGHTS = f"""all_insights AS (SELECT 1 AS position, 'rows' AS rule, CAST(COUNT(*) AS VARCHAR) AS value FROM gas_obs
    UNION ALL SELECT 2, 'columns', '13'
    UNION ALL SELECT 3, 'missing_percent', CASE WHEN m > 10 OR m < 1 THEN printf('%.1f', m) END
      FROM (SELECT ({_MISSING_CELLS}) / (COUNT(*) * 13) * 100 AS m FROM gas_obs)
    UNION ALL SELECT 4, 'states', CAST(COUNT(DISTINCT state_abb) AS VARCHAR) FROM gas_obs
    UNION ALL SELECT 5, 'largest_state', (SELECT state_abb FROM gas_obs GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)
    UNION ALL SELECT 6, 'days', CAST(CAST(FLOOR(epoch(MAX(eff_gas_day) - MIN(eff_gas_day)) / 86400) AS BIGINT) AS VARCHAR) FROM gas_obs
    UNION ALL SELECT 7, 'quantity_varies', CASE WHEN stddev_samp(scheduled_quantity) / AVG(scheduled_quantity) > 1 THEN 'true' END FROM gas_obs)"""


@query("insights", f"WITH {GAS}, {_INSIGHTS} SELECT position, rule, value FROM all_insights WHERE value IS NOT NULL")
def _(spark, folder):
    return quality.insights(gas_obs(spark, folder))


# Outliers, association, clustering

@query(
    "zscore_outliers",
    """SELECT 'value' AS "column", COUNT(value) AS non_null, COUNT(*) FILTER (ABS(value - m) > s * 3) AS count,
    ROUND(COUNT(*) FILTER (ABS(value - m) > s * 3) / COUNT(value) * 100, 6) AS percentage
    FROM events, (SELECT AVG(value) AS m, stddev_pop(value) AS s FROM events)""",
)
def _(spark, folder):
    return rounded(outliers.zscore_outliers(load(spark, folder, "events"), ["value"]), 6)


@query(
    "zscore_outlier_rows",
    """SELECT event_id, value FROM events, (SELECT AVG(value) AS m, stddev_pop(value) AS s FROM events)
    WHERE ABS(value - m) > s * 3 ORDER BY event_id LIMIT 10""",
)
def _(spark, folder):
    return outliers.zscore_outlier_rows(load(spark, folder, "events").select("event_id", "value"), "value", "event_id")


@query("isolation_forest")
def _(spark, folder):
    return forest.isolation_forest(gas_obs(spark, folder), "obs_id", ["scheduled_quantity", "latitude", "longitude"])


_FENCE = """SELECT '{c}' AS "column", COUNT({c}) AS non_null, ROUND(CAST(MAX(a - 1.5 * (b - a)) AS DOUBLE), 4) AS lower_bound,
    ROUND(CAST(MAX(b + 1.5 * (b - a)) AS DOUBLE), 4) AS upper_bound,
    COUNT(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS count,
    ROUND(COUNT(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) / COUNT({c}) * 100, 4) AS percentage
    FROM {t}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {t})"""


@query(
    "iqr_outliers",
    f"WITH {GAS} " + each(["scheduled_quantity", "latitude"], _FENCE.replace("{t}", "gas_obs")) + " UNION ALL "
    + each(["value"], _FENCE.replace("{t}", "events")),
)
def _(spark, folder):
    obs = outliers.iqr_outliers(gas_obs(spark, folder), ["scheduled_quantity", "latitude"])
    return rounded(obs.unionByName(outliers.iqr_outliers(load(spark, folder, "events"), ["value"])))


@query(
    "iqr_outlier_rows",
    """SELECT event_id, value FROM events, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
    WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) ORDER BY event_id LIMIT 10""",
)
def _(spark, folder):
    return outliers.iqr_outlier_rows(load(spark, folder, "events").select("event_id", "value"), "value", "event_id")


@query("detect_anomalies")
def _(spark, folder):
    return analyses.detect_anomalies(gas_obs(spark, folder), "obs_id")["summary"]


_FIRST_ROWS = """SELECT * FROM (SELECT '{section}' AS section, '{c}' AS "column", event_id, {c} AS value FROM (
    SELECT *, {flag} AS flagged FROM kept) WHERE flagged ORDER BY event_id LIMIT 10)"""
_FIRST_ROWS_SQL = " UNION ALL ".join(
    _FIRST_ROWS.replace("{section}", section).replace("{flag}", flag).replace("{c}", c)
    for section, flag in (
        ("z_score", "ABS({c} - AVG({c}) OVER ()) > 3 * stddev_pop({c}) OVER ()"),
        ("iqr", """{c} < (SELECT 2.5 * quantile_cont({c}, 0.25) - 1.5 * quantile_cont({c}, 0.75) FROM kept)
          OR {c} > (SELECT 2.5 * quantile_cont({c}, 0.75) - 1.5 * quantile_cont({c}, 0.25) FROM kept)"""),
    )
    for c in ("value", "square")
)


@query("anomaly_rows", f"WITH kept AS (SELECT event_id, value, value * value AS square FROM events WHERE value IS NOT NULL) {_FIRST_ROWS_SQL}")
def _(spark, folder):
    events = load(spark, folder, "events").select("event_id", "value", (F.col("value") * F.col("value")).alias("square")).filter("value IS NOT NULL")
    found = [("z_score", outliers.first_zscore_rows), ("iqr", outliers.first_iqr_rows)]
    one, other = [first(events, "event_id", ["value", "square"]).select(F.lit(name).alias("section"), "*") for name, first in found]
    return one.unionByName(other)


_PATTERN = """SELECT '{c}' AS "column", ROUND(AVG(v), 4) AS mean, ROUND(CAST(median(v) AS DOUBLE), 4) AS median, ROUND(stddev_samp(v), 4) AS std,
    ROUND(AVG(POWER(v - m, 3)) / POWER(AVG((v - m) * (v - m)), 1.5), 4) AS skewness,
    ROUND(AVG(POWER(v - m, 4)) / POWER(AVG((v - m) * (v - m)), 2) - 3, 4) AS kurtosis,
    ROUND(COUNT(*) FILTER (ABS(v - m) > 2 * s) / COUNT(v) * 100, 4) AS outlier_percentage
    FROM (SELECT CAST({c} AS DOUBLE) AS v FROM dated), (SELECT AVG({c}) AS m, stddev_pop({c}) AS s FROM dated)"""
_PATTERN_COLUMNS = ["scheduled_quantity", "latitude", "longitude", "month", "day_of_week"]


@query("numeric_patterns", f"WITH {DATED} " + each(_PATTERN_COLUMNS, _PATTERN))
def _(spark, folder):
    return rounded(outliers.numeric_patterns(dated(spark, folder), _PATTERN_COLUMNS))


def _pairs_sql(columns, template):
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return " UNION ALL ".join(template.replace("{a}", a).replace("{b}", b) for a, b in pairs)


_CORRELATED = ["obs_id", "scheduled_quantity", *PARTS]
_COMPLETE = "complete AS (SELECT * FROM dated WHERE scheduled_quantity IS NOT NULL)"
_RANKED = "ranked AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in _CORRELATED
) + " FROM complete)"


@query(
    "pearson_matrix",
    f"WITH {DATED}, {_COMPLETE} "
    + _pairs_sql(_CORRELATED, "SELECT '{a}' AS variable1, '{b}' AS variable2, ROUND(corr({a}, {b}), 6) AS pearson FROM complete"),
)
def _(spark, folder):
    return rounded(association.pearson_matrix(dated(spark, folder)), 6)


@query(
    "spearman_matrix",
    f"WITH {DATED}, {_COMPLETE}, {_RANKED} "
    + _pairs_sql(_CORRELATED, "SELECT '{a}' AS variable1, '{b}' AS variable2, ROUND(corr({a}, {b}), 6) AS spearman FROM ranked"),
)
def _(spark, folder):
    return rounded(association.spearman_matrix(dated(spark, folder)), 6)


@query(
    "strong_correlations",
    f"WITH {DATED}, {_COMPLETE}, {_RANKED}, both_ways AS ("
    + _pairs_sql(
        _CORRELATED,
        "SELECT '{a}' AS variable1, '{b}' AS variable2, (SELECT corr({a}, {b}) FROM complete) AS p, (SELECT corr({a}, {b}) FROM ranked) AS s",
    )
    + """) SELECT variable1, variable2, ROUND(p, 3) AS pearson_correlation, ROUND(s, 3) AS spearman_correlation,
    CASE WHEN greatest(ABS(p), ABS(s)) >= 0.7 THEN 'strong' ELSE 'moderate' END AS strength
    FROM both_ways WHERE greatest(ABS(p), ABS(s)) >= 0.005""",
)
def _(spark, folder):
    return association.strong_correlations(dated(spark, folder), threshold=0.005, k=100)


_ANOVA = """SELECT '{a}' AS category, '{b}' AS variable, COUNT(*) AS groups, CAST(SUM(n) AS BIGINT) AS rows,
    ROUND((SUM(n * (m - g) * (m - g)) / (COUNT(*) - 1)) / (SUM(n * v) / (SUM(n) - COUNT(*))), 4) AS f_statistic
    FROM (SELECT COUNT({b}) AS n, AVG({b}) AS m, var_pop({b}) AS v FROM dated WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}),
    (SELECT AVG({b}) AS g FROM dated WHERE {a} IS NOT NULL)"""
_ANOVA_CATEGORIES = ["pipeline_name", "loc_name", "connecting_entity"]
_ANOVA_NUMBERS = ["scheduled_quantity", "latitude", "month"]


@query(
    "anova_f",
    f"WITH {DATED} " + " UNION ALL ".join(_ANOVA.replace("{a}", a).replace("{b}", b) for a in _ANOVA_CATEGORIES for b in _ANOVA_NUMBERS),
)
def _(spark, folder):
    return rounded(association.anova_f(dated(spark, folder), _ANOVA_CATEGORIES, _ANOVA_NUMBERS))


@query("anova")
def _(spark, folder):
    return association.anova(dated(spark, folder))


@query(
    "scale_features",
    f"WITH {DATED}, {_COMPLETE} SELECT obs_id, "
    + ", ".join(f"ROUND(({c} - AVG({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in FEATURES)
    + " FROM complete",
)
def _(spark, folder):
    return rounded(association.scale_features(dated(spark, folder), FEATURES, keep=["obs_id"]), 6)


def _features(spark, folder):
    return association.scale_features(dated(spark, folder), FEATURES, keep=["obs_id"])


@query("dbscan")
def _(spark, folder):
    features = association.scale_features(gas_obs(spark, folder), ["scheduled_quantity", "latitude"], keep=["obs_id"])
    return density.dbscan(features, "obs_id")


@query("kmeans_best")
def _(spark, folder):
    return kmeans.kmeans_best(_features(spark, folder), "obs_id")


_SCALED = "scaled AS (SELECT obs_id, " + ", ".join(
    f"({c} - AVG({c}) OVER ()) / stddev_pop({c}) OVER () AS x{i}" for i, c in enumerate(FEATURES)
) + " FROM complete)"
_CENTERS = [[-1.0, -0.9, 0.1], [1.1, -0.8, -0.7], [0.3, 1.0, -0.6], [-0.4, 0.7, 1.2]]


def _square_sql(center):
    return " + ".join(f"(x{i} - {c}) * (x{i} - {c})" for i, c in enumerate(center))


@query(
    "kmeans_labels",
    f"WITH {DATED}, {_COMPLETE}, {_SCALED}, squares AS (SELECT obs_id, [{', '.join(_square_sql(c) for c in _CENTERS)}] AS d FROM scaled) "
    "SELECT obs_id, CAST(list_position(d, list_min(d)) - 1 AS INT) AS cluster FROM squares",
)
def _(spark, folder):
    """Rows under given centres; ``kmeans_best`` fits its own."""
    models = spark.createDataFrame([(True, _CENTERS)], "is_best boolean, centers array<array<double>>")
    return kmeans.kmeans_labels(_features(spark, folder), "obs_id", models)


@query(
    "silhouette",
    f"""WITH {DATED}, {_COMPLETE}, {_SCALED}, halves AS (SELECT *, x0 > 0 AS half, x0 * x0 + x1 * x1 + x2 * x2 AS norm FROM scaled),
    sums AS (SELECT half, COUNT(*) AS n, SUM(norm) AS q, SUM(x0) AS s0, SUM(x1) AS s1, SUM(x2) AS s2 FROM halves GROUP BY 1),
    far AS (SELECT h.half = s.half AS inside, obs_id, n, n * norm + q - 2 * (x0 * s0 + x1 * s1 + x2 * s2) AS total FROM halves h CROSS JOIN sums s),
    means AS (SELECT obs_id, MAX(total / (n - 1)) FILTER (inside) AS own, MAX(total / n) FILTER (NOT inside) AS other FROM far GROUP BY 1)
    SELECT ROUND(AVG((other - own) / greatest(own, other)), 6) AS silhouette FROM means""",
)
def _(spark, folder):
    features = _features(spark, folder)
    halves = features.withColumn("cluster", F.when(F.col("scheduled_quantity") > 0, 1).otherwise(0))
    return rounded(spark.createDataFrame([(kmeans.silhouette(halves, FEATURES),)], "silhouette double"), 6)


@query(
    "cluster_profile",
    f"""WITH {GAS}, labels AS (SELECT obs_id, CAST(obs_id % 3 AS INT) AS cluster FROM gas_obs WHERE scheduled_quantity IS NOT NULL),
    sizes AS (SELECT cluster, COUNT(*) AS size, ROUND(COUNT(*) / (SELECT COUNT(*) FROM gas_obs) * 100, 6) AS percentage FROM labels GROUP BY 1),
    long AS (SELECT cluster, 'pipeline_name' AS "column", pipeline_name AS value FROM labels JOIN gas_obs USING (obs_id)
      UNION ALL SELECT cluster, 'loc_name', loc_name FROM labels JOIN gas_obs USING (obs_id)
      UNION ALL SELECT cluster, 'connecting_pipeline', connecting_pipeline FROM labels JOIN gas_obs USING (obs_id) WHERE connecting_pipeline IS NOT NULL),
    ranked AS (SELECT cluster, "column", value, COUNT(*) AS count,
      CAST(row_number() OVER (PARTITION BY cluster, "column" ORDER BY COUNT(*) DESC, value) AS INT) AS position FROM long GROUP BY cluster, "column", value)
    SELECT cluster, size, percentage, "column", position, value, count FROM sizes JOIN ranked USING (cluster) WHERE position <= 5""",
)
def _(spark, folder):
    obs = gas_obs(spark, folder)
    labels = obs.filter("scheduled_quantity IS NOT NULL").select("obs_id", (F.col("obs_id") % 3).cast("int").alias("cluster"))
    return rounded(kmeans.cluster_profile(obs, labels, "obs_id"), 6)


# Operations


@query("infer_capacity", f"WITH {GAS}, {CAPACITY} SELECT pipeline_name, ROUND(capacity, 4) AS capacity FROM capacity")
def _(spark, folder):
    return rounded(operations.infer_capacity(gas_obs(spark, folder)))


@query(
    "capacity_summary",
    f"""WITH {GAS}, {CAPACITY} SELECT COUNT(*) AS pipelines_analyzed, ROUND(AVG(capacity), 4) AS avg_capacity,
    ROUND(MIN(capacity), 4) AS min_capacity, ROUND(MAX(capacity), 4) AS max_capacity FROM capacity""",
)
def _(spark, folder):
    return rounded(operations.capacity_summary(operations.infer_capacity(gas_obs(spark, folder))))


@query("utilization", f"WITH {GAS}, {USED} SELECT obs_id, ROUND(capacity, 4) AS capacity, ROUND(utilization, 4) AS utilization FROM used")
def _(spark, folder):
    return rounded(with_utilization(spark, folder).select("obs_id", "capacity", "utilization"))


@query(
    "high_utilization",
    f"""WITH {GAS}, {USED} SELECT obs_id, pipeline_name, loc_name, eff_gas_day, scheduled_quantity, ROUND(capacity, 4) AS capacity,
    ROUND(utilization, 4) AS utilization FROM used WHERE utilization > 0.85""",
)
def high_utilization(spark: SparkSession, folder: str) -> DataFrame:
    """Which pipelines run above 85 % of their inferred capacity, and when?"""
    high = operations.high_utilization(with_utilization(spark, folder))
    return rounded(high.select("obs_id", "pipeline_name", "loc_name", "eff_gas_day", "scheduled_quantity", "capacity", "utilization"))


@query("rolling_high_util", f"WITH {GAS}, {USED}, {ROLLED} SELECT obs_id, high_util, rolling_high_count FROM rolled")
def _(spark, folder):
    return operations.rolling_high_util(with_utilization(spark, folder)).select("obs_id", "high_util", "rolling_high_count")


@query(
    "rolling_high_util_days",
    f"""WITH {GAS}, {USED} SELECT obs_id, CAST(SUM(CASE WHEN utilization > 0.85 THEN 1 ELSE 0 END) OVER (PARTITION BY pipeline_name
    ORDER BY CAST(eff_gas_day AS DATE) RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling_high_count FROM used""",
)
def _(spark, folder):
    rolled = operations.rolling_high_util(with_utilization(spark, folder), calendar_days=True)
    return rolled.select("obs_id", "rolling_high_count")


_BOTTLENECKS = """SELECT pipeline_name, loc_name, ROUND(MAX(utilization), 4) AS peak_utilization,
    COUNT(*) FILTER (high_util) AS high_util_days, MIN(eff_gas_day) AS first_bottleneck_date, MAX(eff_gas_day) AS last_bottleneck_date
    FROM rolled WHERE rolling_high_count >= 10 GROUP BY 1, 2"""


@query("detect_bottlenecks", f"WITH {GAS}, {USED}, {ROLLED} {_BOTTLENECKS}")
def _(spark, folder):
    return rounded(operations.detect_bottlenecks(with_utilization(spark, folder)))


@query(
    "flow_direction_changes",
    f"""WITH {GAS}, seen AS (SELECT pipeline_name, rec_del_sign, lag(rec_del_sign) OVER (PARTITION BY pipeline_name
    ORDER BY eff_gas_day NULLS LAST, obs_id) AS before FROM gas_obs WHERE pipeline_name IS NOT NULL)
    SELECT pipeline_name, COUNT(*) AS direction_changes FROM seen
    WHERE before IS NULL OR rec_del_sign IS NULL OR before <> rec_del_sign GROUP BY 1""",
)
def _(spark, folder):
    return operations.flow_direction_changes(gas_obs(spark, folder))


@query("vessels_near_locations", f"WITH {GAS}, {VESSELS}, {NEAR} SELECT event_id, mmsi, loc_name, ROUND(loc_latitude, 4) AS loc_latitude, ROUND(loc_longitude, 4) AS loc_longitude FROM near")
def _(spark, folder):
    near = proximity.vessels_near_locations(vessels(spark, folder), proximity.locations_of(gas_obs(spark, folder)))
    return rounded(near.select("event_id", "mmsi", "loc_name", "loc_latitude", "loc_longitude"))


@query(
    "vessel_summary",
    f"""WITH {GAS}, {VESSELS}, {NEAR} SELECT (SELECT COUNT(*) FROM vessels) AS vessels_collected, COUNT(*) AS vessels_assigned,
    COUNT(DISTINCT loc_name) AS locations_with_vessels FROM near""",
)
def _(spark, folder):
    positions = vessels(spark, folder)
    return proximity.vessel_summary(positions, proximity.vessels_near_locations(positions, proximity.locations_of(gas_obs(spark, folder))))


# Streaming

_DECODED = """SELECT event_id, mmsi, CAST(epoch(date_trunc('second', timestamp)) AS BIGINT) AS epoch, ROUND(latitude, 6) AS latitude,
    ROUND(longitude, 6) AS longitude, vessel_type FROM vessels WHERE vessel_type BETWEEN 70 AND 79"""


@query("decode_vessels", f"WITH {VESSELS} {_DECODED}")
def _(spark, folder):
    decoded = decode_vessels(vessel_messages(spark, folder))
    return rounded(decoded.select("event_id", "mmsi", F.unix_timestamp("timestamp").alias("epoch"), "latitude", "longitude", "vessel_type"), 6)


@query(
    "vessel_stream_near_locations",
    f"WITH {GAS}, {VESSELS}, {NEAR} SELECT event_id, mmsi, loc_name FROM near WHERE vessel_type BETWEEN 70 AND 79",
)
def _(spark, folder):
    """The event table as a stream of messages, tagged on arrival, written out and read back."""
    schema = load(spark, folder, "events").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    tagged = tag_vessels(decode_vessels(vessel_messages(spark, folder, arriving)), proximity.locations_of(gas_obs(spark, folder)))
    target = scratch_folder(spark, "vessel-stream")
    collect_vessels(tagged.select("event_id", "mmsi", "loc_name"), f"{target}/positions", f"{target}/progress").awaitTermination()
    return spark.read.schema("event_id long, mmsi long, loc_name string").parquet(f"{target}/positions")


# Composites: the sections in one long table


def stacked(sections: dict[str, DataFrame]) -> DataFrame:
    """``section, label, measure, value``: the numbers of every section, labelled by its other columns."""
    parts = []
    for name, section in sections.items():
        numbers = [f.name for f in section.schema if isinstance(f.dataType, T.NumericType)]
        labels = [c for c in section.columns if c not in numbers]
        label = F.concat_ws("|", *[F.col(c).cast("string") for c in labels]) if labels else F.lit("")
        wide = section.select(label.alias("label"), *[F.col(c).cast("double").alias(c) for c in numbers])
        parts.append(wide.unpivot(["label"], numbers, "measure", "value").select(F.lit(name).alias("section"), "label", "measure", F.round("value", 4).alias("value")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _long_sql(section, source, label, measures):
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {label} AS label, '{m}' AS measure, ROUND(CAST({m} AS DOUBLE), 4) AS value FROM ({source})" for m in measures
    )


def _counted_sql(section, key, measure_key=False):
    source = f"SELECT {key}, COUNT(*) AS count FROM dated GROUP BY 1"
    return _long_sql(section, source, "''" if measure_key else key, [key, "count"] if measure_key else ["count"])


@query(
    "simple_query",
    f"WITH {DATED}, kept AS (SELECT state_abb, category_short, scheduled_quantity FROM dated WHERE year BETWEEN 1996 AND 1998) "
    + _long_sql("size", "SELECT COUNT(*) AS row_count, 3 AS column_count FROM kept", "''", ["row_count", "column_count"])
    + " UNION ALL " + _long_sql("aggregation", "SELECT AVG(scheduled_quantity) AS scheduled_quantity_mean FROM kept", "''", ["scheduled_quantity_mean"])
    + " UNION ALL "
    + _long_sql("numeric", each(["scheduled_quantity"], _DESCRIBE) + " FROM kept", '"column"', ["count", "mean", "std", "min", "q25", "q50", "q75", "max"])
    + " UNION ALL "
    + _long_sql("categorical", each(["state_abb", "category_short"], _CATEGORY.replace("gas_obs", "kept")), "\"column\" || '|' || value",
                ["unique_count", "missing_count", "diversity_index", "position", "count"])
    + " UNION ALL "
    + _long_sql("sample", "SELECT * FROM kept ORDER BY state_abb, category_short, scheduled_quantity NULLS FIRST LIMIT 20", "state_abb || '|' || category_short", ["scheduled_quantity"]),
)
def _(spark, folder):
    sections = analyses.simple_query(
        dated(spark, folder), {"year": {"between": [1996, 1998]}}, ["state_abb", "category_short", "scheduled_quantity"], "mean"
    )
    return stacked(sections)


_ITEM_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}
_ITEM_MEASURED = [c for c, kind in _ITEM_TYPES.items() if kind not in ("string", "timestamp_ntz")]
_ITEM_CELLS = " + ".join(f"COUNT(*) - COUNT({c})" for c in _ITEM_TYPES)
_ITEM_GAPS = " + ".join(f"CASE WHEN COUNT({c}) < COUNT(*) THEN 1 ELSE 0 END" for c in _ITEM_TYPES)


@query(
    "statistical_summary",
    _long_sql("basic", f"""SELECT COUNT(*) AS total_rows, 11 AS total_columns, COUNT(*) * 11 AS total_cells, {_ITEM_CELLS} AS total_missing_values,
      {_ITEM_GAPS} AS columns_with_missing, ({_ITEM_CELLS}) / (COUNT(*) * 11) AS overall_missing_rate FROM lineitem""", "''",
              ["total_rows", "total_columns", "total_cells", "total_missing_values", "columns_with_missing", "overall_missing_rate"])
    + " UNION ALL "
    + " UNION ALL ".join(
        _long_sql("types", f"""SELECT COUNT(*) - COUNT({c}) AS missing_count, (COUNT(*) - COUNT({c})) / COUNT(*) AS missing_rate,
          COUNT({c}) AS non_missing_count FROM lineitem""", f"'{c}|{kind}'", ["missing_count", "missing_rate", "non_missing_count"])
        for c, kind in _ITEM_TYPES.items()
    )
    + " UNION ALL "
    + _long_sql("numeric", each(_ITEM_MEASURED, "SELECT * FROM (" + _DESCRIBE + " FROM lineitem) JOIN (" + _MOMENTS + ') USING ("column")'),
                '"column"', ["count", "mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis"])
    + " UNION ALL "
    + _long_sql("categorical", each(["l_returnflag", "l_linestatus"], _CATEGORY.replace("gas_obs", "lineitem")), "\"column\" || '|' || value",
                ["unique_count", "missing_count", "diversity_index", "position", "count"])
    + " UNION ALL "
    + _long_sql("completeness", f"""SELECT {_ITEM_CELLS} AS total_missing_values, {_ITEM_GAPS} AS columns_with_missing,
      1 - ({_ITEM_CELLS}) / (COUNT(*) * 11) AS completeness_score FROM lineitem""", "''",
                ["total_missing_values", "columns_with_missing", "completeness_score"])
    + " UNION ALL "
    + _long_sql("duplicates", """SELECT SUM(n) AS total_rows, SUM(n - 1) AS duplicate_rows, SUM(n - 1) / SUM(n) * 100 AS duplicate_percentage
      FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY ALL)""".replace("COUNT(*) AS n FROM", ", ".join([*_ITEM_TYPES, "COUNT(*) AS n FROM"])),
                "''", ["total_rows", "duplicate_rows", "duplicate_percentage"]),
)
def _(spark, folder):
    return stacked(analyses.statistical_summary(load(spark, folder, "lineitem")))


@query(
    "pattern_analysis",
    f"WITH {DATED}, {_PLACED} "
    + _long_sql("date_span", _SPAN, "start || '|' || \"end\"", ["span_days"])
    + " UNION ALL " + _counted_sql("by_month", "month", True)
    + " UNION ALL " + _counted_sql("by_day_of_week", "day_of_week", True)
    + " UNION ALL " + _long_sql("geography", _PLACES, "level || '|' || value", ["count"])
    + " UNION ALL "
    + _long_sql("categories", each(["pipeline_name", "loc_name", "rec_del_sign", "category_short", "country_name"], _CATEGORY.replace("gas_obs", "placed")),
                "\"column\" || '|' || value", ["unique_count", "missing_count", "diversity_index", "position", "count"])
    + " UNION ALL "
    + _long_sql("numbers", each(["latitude", "longitude", "scheduled_quantity", "year", "month"], _PATTERN), '"column"',
                ["mean", "median", "std", "skewness", "kurtosis", "outlier_percentage"]),
)
def _(spark, folder):
    obs = cleaning.geo_quadrant(dated(spark, folder).drop("obs_id", "connecting_pipeline", "connecting_entity"))
    return stacked(analyses.pattern_analysis(obs))


@query(
    "factor_analysis",
    f"WITH {DATED} "
    + _long_sql("quantity_by_state", _STATS.replace("{k}", "state_abb").replace("{std}", _STD) + " ORDER BY AVG(scheduled_quantity) DESC, state_abb LIMIT 10",
                "state_abb", ["mean", "median", "std", "count"])
    + " UNION ALL "
    + _long_sql("quantity_by_category", _STATS.replace("{k}", "category_short").replace("{std}", _STD), "category_short", ["mean", "median", "std", "count"])
    + " UNION ALL "
    + _long_sql("quantity_by_month", _STATS.replace("{k}", "month").replace("{std}", ""), "''", ["month", "mean", "median", "count"])
    + " UNION ALL "
    + _long_sql("states", "SELECT state_abb, COUNT(*) AS count FROM dated GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "state_abb", ["count"])
    + " UNION ALL "
    + _long_sql("state_diversity", "SELECT COUNT(DISTINCT state_abb) AS unique_count, COUNT(*) AS total_rows, COUNT(DISTINCT state_abb) / COUNT(*) AS diversity_index FROM dated",
                "'state_abb'", ["unique_count", "total_rows", "diversity_index"])
    + " UNION ALL "
    + _long_sql("state_category", "SELECT state_abb, category_short, COUNT(*) AS count FROM dated GROUP BY 1, 2", "state_abb || '|' || category_short", ["count"])
    + " UNION ALL " + _counted_sql("by_year", "year", True) + " UNION ALL " + _counted_sql("by_month", "month", True)
    + " UNION ALL "
    + _long_sql("by_weekday", "SELECT day_of_week AS day_number, strftime(eff_gas_day, '%A') AS weekday, COUNT(*) AS count FROM dated GROUP BY 1, 2",
                "weekday", ["day_number", "count"])
    + " UNION ALL " + _counted_sql("categories", "category_short")
    + " UNION ALL "
    + _long_sql("category_direction", "SELECT category_short, rec_del_sign, COUNT(*) AS count FROM dated GROUP BY 1, 2", "category_short || '|' || rec_del_sign", ["count"]),
)
def _(spark, folder):
    sections = analyses.factor_analysis(dated(spark, folder))
    return stacked({name: section for name, section in sections.items() if name != "disclaimer"})


@query(
    "pipeline_operations",
    f"WITH {GAS}, {VESSELS}, {USED}, {ROLLED}, {NEAR} "
    + _long_sql("capacity", "SELECT * FROM capacity", "pipeline_name", ["capacity"])
    + " UNION ALL "
    + _long_sql("utilization", "SELECT * FROM used", "CAST(obs_id AS VARCHAR)", ["capacity", "utilization"])
    + " UNION ALL "
    + _long_sql("vessels_near", "SELECT * FROM near", "event_id || '|' || mmsi || '|' || loc_name", ["loc_latitude", "loc_longitude"])
    + " UNION ALL "
    + _long_sql("capacity_summary", "SELECT COUNT(*) AS pipelines_analyzed, AVG(capacity) AS avg_capacity, MIN(capacity) AS min_capacity, MAX(capacity) AS max_capacity FROM capacity",
                "''", ["pipelines_analyzed", "avg_capacity", "min_capacity", "max_capacity"])
    + " UNION ALL "
    + _long_sql("bottlenecks", _BOTTLENECKS, "concat_ws('|', pipeline_name, loc_name, strftime(first_bottleneck_date, '%Y-%m-%d %H:%M:%S'), strftime(last_bottleneck_date, '%Y-%m-%d %H:%M:%S'))",
                ["peak_utilization", "high_util_days"])
    + " UNION ALL "
    + _long_sql("flow_changes", """SELECT pipeline_name, COUNT(*) AS direction_changes FROM (SELECT pipeline_name, rec_del_sign, lag(rec_del_sign)
      OVER (PARTITION BY pipeline_name ORDER BY eff_gas_day, obs_id) AS before FROM gas_obs) WHERE before IS NULL OR before <> rec_del_sign GROUP BY 1""",
                "pipeline_name", ["direction_changes"])
    + " UNION ALL "
    + _long_sql("vessel_summary", "SELECT (SELECT COUNT(*) FROM vessels) AS vessels_collected, COUNT(*) AS vessels_assigned, COUNT(DISTINCT loc_name) AS locations_with_vessels FROM near",
                "''", ["vessels_collected", "vessels_assigned", "locations_with_vessels"]),
)
def _(spark, folder):
    sections = analyses.pipeline_operations(gas_obs(spark, folder), vessels(spark, folder))
    key = F.col("obs_id").cast("string").alias("obs_id")
    sections["utilization"] = sections["utilization"].select(key, "capacity", "utilization")
    met = [F.col(c).cast("string").alias(c) for c in ("event_id", "mmsi")]
    sections["vessels_near"] = sections["vessels_near"].select(*met, "loc_name", "loc_latitude", "loc_longitude")
    return stacked(sections)


_CORRELATION_VALUES = _pairs_sql(
    _CORRELATED,
    "SELECT '{a}' AS variable1, '{b}' AS variable2, (SELECT corr({a}, {b}) FROM complete) AS pearson, (SELECT corr({a}, {b}) FROM ranked) AS spearman",
)


@query(
    "correlation_analysis",
    f"WITH {DATED}, {_COMPLETE}, {_RANKED}, both_ways AS ({_CORRELATION_VALUES}) "
    + _long_sql("pearson", "SELECT * FROM both_ways", "variable1 || '|' || variable2", ["pearson"])
    + " UNION ALL "
    + _long_sql("spearman", "SELECT * FROM both_ways", "variable1 || '|' || variable2", ["spearman"])
    + " UNION ALL "
    + _long_sql("strong", """SELECT variable1, variable2, ROUND(pearson, 3) AS pearson_correlation, ROUND(spearman, 3) AS spearman_correlation,
      CASE WHEN greatest(ABS(pearson), ABS(spearman)) >= 0.7 THEN 'strong' ELSE 'moderate' END AS strength
      FROM both_ways WHERE greatest(ABS(pearson), ABS(spearman)) >= 0.5""", "concat_ws('|', variable1, variable2, strength)",
                ["pearson_correlation", "spearman_correlation"])
    + " UNION ALL "
    + _long_sql("by_category", " UNION ALL ".join(
        _ANOVA.replace("4) AS f_statistic", "3) AS f_statistic").replace("{a}", a).replace("{b}", b)
        for a in ["pipeline_name", "loc_name", "connecting_pipeline"] for b in ["obs_id", "scheduled_quantity", "year"]
    ), "category || '|' || variable", ["f_statistic"]),
)
def _(spark, folder):
    """All sections; the p-values, for which SQL has no function, are tested apart."""
    sections = analyses.correlation_analysis(dated(spark, folder))
    sections["by_category"] = sections["by_category"].drop("p_value", "significant")
    return stacked(sections)


@query("data_profile")
def _(spark, folder):
    return stacked({n: s for n, s in analyses.data_profile(gas_obs(spark, folder)).items() if n != "dates"})


@query("general_analysis")
def _(spark, folder):
    return stacked(analyses.general_analysis(gas_obs(spark, folder), "obs_id"))


@query("cluster")
def _(spark, folder):
    sections = analyses.cluster(dated(spark, folder), "obs_id", columns=["scheduled_quantity", "latitude"])
    return stacked({name: sections[name] for name in ("dbscan_summary", "dbscan_silhouette", "kmeans_models", "kmeans_profile")})
