"""The same answers in DuckDB SQL, for checking the Spark queries on the test tables."""

from __future__ import annotations

from oracle.contract import (
    ALL_COLUMNS, ANOMALY_FEATURES, BLEND, CORRELATION_COLUMNS, CRITICAL_COLUMNS, FILLED_WEATHER, HOURS, MODEL_FEATURES, PRIORITY_RANK,
    RULES, SCENARIOS, WHOLE_NUMBERS, is_double,
)

W = "PARTITION BY building_id, meter ORDER BY timestamp"


def r(expr: str, digits: int = 6) -> str:
    """Rounded, with negative zero made positive."""
    return f"(round({expr}, {digits}) + 0.0)"


def cols(names, prefix: str = "") -> str:
    """Columns with doubles rounded."""
    out = []
    for c in names:
        out.append(f"{r(prefix + c)} AS {c}" if is_double(c) else f"{prefix}{c}")
    return ", ".join(out)


RAW = f"""readings_raw AS (
  SELECT l_orderkey // {HOURS} AS building_id, CAST((l_linenumber - 1) % 4 AS BIGINT) AS meter,
         TIMESTAMP '2024-01-01' + to_hours(CAST(l_orderkey % {HOURS} AS INT)) AS timestamp,
         CASE WHEN l_tax = 0 THEN 0.0 ELSE l_quantity + 40 END AS meter_reading
  FROM lineitem)"""
READINGS = RAW + """,
readings AS (
  SELECT building_id, meter, timestamp, round(sum(meter_reading), 2) AS meter_reading
  FROM readings_raw WHERE meter_reading > 0 GROUP BY 1, 2, 3)"""
META = """building_meta AS (
  SELECT CASE WHEN c_nationkey <> 16 THEN CAST(c_nationkey % 4 AS BIGINT) END AS site_id, c_custkey AS building_id,
         c_mktsegment AS primary_use, 1000 + c_custkey * 7 AS square_feet,
         CASE WHEN c_custkey % 2 = 0 THEN CAST(1950 + c_custkey % 60 AS DOUBLE) END AS year_built,
         CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 9 + 1 AS VARCHAR) END AS floor_count
  FROM customer)"""
WEATHER_RAW = f"""weather_lines AS (
  SELECT CAST(l_suppkey % 4 AS BIGINT) AS site_id, CAST(l_orderkey % {HOURS} AS INT) AS h, * FROM lineitem),
weather_raw AS (
  SELECT site_id, TIMESTAMP '2024-01-01' + to_hours(h) AS timestamp,
         max(CASE WHEN h % 5 <> 0 AND h >= 3 THEN l_quantity - 10 END) AS air_temperature,
         max(round(l_discount * 100, 0)) AS cloud_coverage,
         max(CASE WHEN h % 7 <> 0 THEN l_quantity - 20 END) AS dew_temperature,
         CAST(NULL AS DOUBLE) AS precip_depth_1_hr,
         max(CASE WHEN site_id <> 3 AND h % 6 <> 0 THEN l_quantity + 1000 END) AS sea_level_pressure,
         CAST(NULL AS DOUBLE) AS wind_direction,
         max(CASE WHEN h % 11 <> 0 THEN round(l_tax * 100, 0) END) AS wind_speed
  FROM weather_lines GROUP BY site_id, h)"""


def _fill(c: str) -> str:
    return (f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY timestamp "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER "
            f"(PARTITION BY site_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}")


WEATHER = WEATHER_RAW + f""",
weather_near AS (
  SELECT site_id, timestamp, cloud_coverage, precip_depth_1_hr, wind_direction,
         {", ".join(_fill(c) for c in FILLED_WEATHER)} FROM weather_raw),
weather_mid AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in FILLED_WEATHER)} FROM weather_near),
weather AS (
  SELECT site_id, timestamp, cloud_coverage, precip_depth_1_hr, wind_direction,
         {", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in FILLED_WEATHER)} FROM weather_near, weather_mid)"""
DENSE = """span AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM readings),
spine AS (SELECT building_id, meter, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS timestamp
          FROM (SELECT DISTINCT building_id, meter FROM readings), span),
dense AS (SELECT s.building_id, s.meter, s.timestamp, coalesce(x.meter_reading, 60.0) AS meter_reading
          FROM spine s LEFT JOIN readings x USING (building_id, meter, timestamp))"""
CLEAN = """limits AS (SELECT meter, round(quantile_cont(meter_reading, 0.999), 9) AS cut
           FROM readings WHERE meter_reading > 0 GROUP BY meter),
cleaned AS (SELECT x.* FROM readings x JOIN limits USING (meter) WHERE meter_reading > 0 AND meter_reading <= cut)"""


def merged(source: str) -> str:
    return f"""merged AS (
  SELECT x.building_id, x.meter, x.timestamp, x.meter_reading, b.site_id, b.primary_use, b.square_feet, b.year_built,
         b.floor_count, w.air_temperature, w.cloud_coverage, w.dew_temperature, w.precip_depth_1_hr,
         w.sea_level_pressure, w.wind_direction, w.wind_speed, ln(1 + x.meter_reading) AS meter_reading_log
  FROM {source} x LEFT JOIN building_meta b ON x.building_id = b.building_id
  LEFT JOIN weather w ON b.site_id = w.site_id AND x.timestamp = w.timestamp)"""


def calendar(ts: str, last_hour: int = 17) -> dict[str, str]:
    dow, hour, month = f"(isodow({ts}) - 1)", f"hour({ts})", f"month({ts})"
    return {
        "hour": hour, "dayofweek": dow, "month": month, "dayofyear": f"dayofyear({ts})",
        "is_weekend": f"CAST({dow} >= 5 AS BIGINT)",
        "is_business_hours": f"CAST({dow} < 5 AND {hour} BETWEEN 8 AND {last_hour} AS BIGINT)",
        "hour_sin": f"sin(2 * pi() * {hour} / 24.0)", "hour_cos": f"cos(2 * pi() * {hour} / 24.0)",
        "month_sin": f"sin(2 * pi() * {month} / 12.0)", "month_cos": f"cos(2 * pi() * {month} / 12.0)",
    }


_CAL = ", ".join(f"{e} AS {c}" for c, e in calendar("timestamp").items())
_FRAME = lambda n: f"OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
_WINDOWS = ", ".join([
    *[f"lag(meter_reading_log, {n}) OVER ({W}) AS raw_lag_{n}" for n in (1, 24, 168)],
    *[f"avg(meter_reading_log) {_FRAME(n)} AS rolling_mean_{n}hr" for n in (6, 24, 168)],
    f"coalesce(stddev_samp(meter_reading_log) {_FRAME(24)}, 0.0) AS rolling_std_24hr",
])
FEATURES = f"""windowed AS (SELECT *, {_CAL}, {_WINDOWS} FROM merged),
temp_mid AS (SELECT median(air_temperature) AS m_temp FROM merged),
features AS (
  SELECT *, raw_lag_1 AS lag_1hr, raw_lag_24 AS lag_24hr, coalesce(raw_lag_168, rolling_mean_24hr) AS lag_168hr,
         coalesce(air_temperature, m_temp) * hour AS temp_x_hour,
         coalesce(air_temperature, m_temp) * is_weekend AS temp_x_weekend,
         is_business_hours * rolling_mean_6hr AS occupancy_proxy
  FROM windowed, temp_mid)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


MERGED = (READINGS, META, WEATHER, merged("readings"))
FEATURED = (*MERGED, FEATURES)
DENSE_MERGED = (READINGS, META, WEATHER, DENSE, merged("dense"))
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in MODEL_FEATURES)


# ---- anomalies -------------------------------------------------------------

def residual(source: str, actual: str, expected: str, name: str = "scored") -> str:
    """CTEs that add residual, ratios, severity, flag and direction."""
    return f"""{name}_sides AS (SELECT *, greatest({actual}, 0.0) AS actual_kwh, greatest({expected}, 0.0) AS expected_kwh FROM {source}),
{name}_ratio AS (SELECT *, actual_kwh - expected_kwh AS residual,
    (actual_kwh - expected_kwh) / greatest(expected_kwh, 0.001) AS deviation_ratio FROM {name}_sides),
{name} AS (SELECT *, abs(deviation_ratio) AS abs_deviation_ratio,
    CASE WHEN abs(deviation_ratio) > 0.5 THEN 'CRITICAL' WHEN abs(deviation_ratio) > 0.25 THEN 'WARNING' ELSE 'NORMAL' END AS severity,
    CAST(abs(deviation_ratio) > 0.25 AS BIGINT) AS is_anomaly,
    CASE WHEN abs(deviation_ratio) <= 0.25 THEN 'NOMINAL' WHEN residual > 0 THEN 'HIGH_DEMAND' ELSE 'LOW_DEMAND' END AS anomaly_direction
  FROM {name}_ratio)"""


MEAN6_EXPECTED = "CASE WHEN rolling_mean_6hr > 0 THEN exp(rolling_mean_6hr) - 1 ELSE meter_reading END"
SCORED = residual("features", "meter_reading", MEAN6_EXPECTED)


def streak(source: str = "scored", name: str = "streaked") -> str:
    return f"""{name}_marks AS (SELECT *, row_number() OVER ({W}) AS rn,
    CASE WHEN is_anomaly = 1 AND residual > 0 THEN 1 ELSE 0 END AS hit FROM {source}),
{name} AS (SELECT *, rn - coalesce(max(CASE WHEN hit = 0 THEN rn END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS streak_hours
  FROM {name}_marks)"""


def typed(source: str, mean6: str, mean24: str, name: str = "typed") -> str:
    return f"""{name}_kind AS (SELECT *, CASE
    WHEN severity = 'NORMAL' THEN 'NORMAL'
    WHEN residual < 0 THEN 'LOW_DEMAND'
    WHEN {mean6} > 0 AND (actual_kwh - {mean6}) / greatest({mean6}, 0.001) > 0.35 AND deviation_ratio > 0.35 THEN 'RAPID_SPIKE'
    WHEN streak_hours >= 3 THEN 'PERSISTENT_HIGH'
    WHEN {mean24} > 0 AND {mean24} > 1.25 * expected_kwh AND deviation_ratio > 0.25 THEN 'PERSISTENT_HIGH'
    ELSE 'HIGH_DEMAND' END AS anomaly_type FROM {source}),
{name} AS (SELECT *, CAST(CASE anomaly_type WHEN 'NORMAL' THEN 1 WHEN 'LOW_DEMAND' THEN 2 WHEN 'RAPID_SPIKE' THEN 3
    WHEN 'PERSISTENT_HIGH' THEN 4 ELSE 5 END AS BIGINT) AS priority_rank FROM {name}_kind)"""


def reason(mean6: str, mean24: str) -> str:
    """The sentence that says why a row has its type; numbers with one decimal, halves away from zero."""
    one = lambda e: f"printf('%.1f', round({e}, 1))"
    pct, kwh = lambda e: f"{one(f'({e}) * 100.0')} || '%'", lambda e: f"{one(e)} || ' kWh'"
    surge = f"(actual_kwh - {mean6}) / greatest({mean6}, 0.001)"
    act, exp, ratio = kwh("actual_kwh"), kwh("expected_kwh"), pct("deviation_ratio")
    return f"""CASE
    WHEN severity = 'NORMAL' THEN 'Within the normal range, deviation ' || {ratio} || '.'
    WHEN residual < 0 THEN 'Demand of ' || {act} || ' is ' || {pct('abs(deviation_ratio)')} || ' below the expected ' || {exp} || '.'
    WHEN {mean6} > 0 AND {surge} > 0.35 AND deviation_ratio > 0.35 THEN 'Demand jumped to ' || {act} || ', ' || {pct(surge)}
      || ' over the six-hour mean of ' || {kwh(mean6)} || ' and ' || {ratio} || ' over the expected level.'
    WHEN streak_hours >= 3 THEN 'Demand stayed high for ' || streak_hours || ' readings in a row (' || {act} || ' against ' || {exp} || ' expected).'
    WHEN {mean24} > 0 AND {mean24} > 1.25 * expected_kwh AND deviation_ratio > 0.25 THEN 'The day mean of ' || {kwh(mean24)} || ' is high against the expected '
      || {exp} || coalesce(' by ' || {pct(f'({mean24} - expected_kwh) / nullif(expected_kwh, 0)')}, '') || '; demand is now ' || {ratio} || ' over it.'
    ELSE 'Demand of ' || {act} || ' exceeds the expected ' || {exp} || ' by ' || {ratio} || '.' END"""


TYPED = typed("streaked", "(exp(rolling_mean_6hr) - 1)", "(exp(rolling_mean_24hr) - 1)")
_KEYS = "building_id, meter, timestamp"
_RES = ", ".join([*[f"{r(c)} AS {c}" for c in (
    "actual_kwh", "expected_kwh", "residual", "deviation_ratio", "abs_deviation_ratio")],
    "severity", "is_anomaly", "anomaly_direction"])


# ---- forecasts -------------------------------------------------------------

def _score() -> str:
    return " + ".join([repr(BLEND["intercept"]), *[
        f"{c} * ({BLEND[c]!r})" for c in MODEL_FEATURES if BLEND.get(c)]])


def forecast(temps: str, source: str, back: int = 24) -> str:
    """Recursive CTE over the series of ``merged``; ``temps`` is the CTE text of the temperatures."""
    cal = ", ".join(f"{e} AS {c}" for c, e in calendar("timestamp", 18).items())
    rest = """buf[-1] AS lag_1hr, buf[-24] AS lag_24hr, buf[-168] AS lag_168hr, list_avg(buf[-6:]) AS rolling_mean_6hr,
      list_avg(buf[-24:]) AS rolling_mean_24hr, list_stddev_samp(buf[-24:]) AS rolling_std_24hr,
      list_avg(buf[-168:]) AS rolling_mean_168hr, temps[step] AS air_temperature, area AS square_feet"""
    carried = ", ".join(MODEL_FEATURES)
    empty = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in MODEL_FEATURES)
    return f"""cutoffs AS (SELECT building_id, meter, max(timestamp) - INTERVAL {back} HOUR AS cutoff FROM merged GROUP BY 1, 2),
past AS (SELECT building_id, meter, cutoff, list(meter_reading_log ORDER BY timestamp) AS buf, any_value(CAST(square_feet AS DOUBLE)) AS area
  FROM merged JOIN cutoffs USING (building_id, meter)
  WHERE timestamp <= cutoff AND timestamp > cutoff - INTERVAL 168 HOUR GROUP BY 1, 2, 3 HAVING count(*) = 168),
{temps},
roll AS (
  SELECT building_id, meter, cutoff, temps, area, buf, 0 AS step, CAST(NULL AS TIMESTAMP) AS timestamp,
         CAST(NULL AS DOUBLE) AS predicted_log, {empty}
  FROM past JOIN temps USING (building_id, meter)
  UNION ALL
  SELECT building_id, meter, cutoff, temps, area, list_append(buf, predicted_log), step, timestamp, predicted_log, {carried}
  FROM (SELECT *, {_score()} AS predicted_log FROM (
    SELECT *, air_temperature * hour AS temp_x_hour, air_temperature * is_weekend AS temp_x_weekend,
           is_business_hours * rolling_mean_6hr AS occupancy_proxy FROM (
      SELECT *, {cal}, {rest} FROM (
        SELECT building_id, meter, cutoff, temps, area, buf, step + 1 AS step, cutoff + to_hours(step + 1) AS timestamp
        FROM roll WHERE step < 24))))),
forecast AS (SELECT *, greatest(exp(predicted_log) - 1, 0.0) AS predicted_kwh, '{source}' AS weather_source
             FROM roll WHERE step > 0)"""


OBSERVED = """temps AS (SELECT building_id, meter, list(air_temperature ORDER BY timestamp) AS temps
  FROM merged JOIN cutoffs USING (building_id, meter) WHERE timestamp > cutoff
  GROUP BY 1, 2 HAVING count(air_temperature) = 24)"""
GIVEN = """temps AS (SELECT building_id, meter, list_transform(range(24), lambda i: 18.5 + i % 5) AS temps FROM cutoffs)"""
TABLE_WEATHER = """given AS (SELECT site_id, timestamp, air_temperature FROM weather_raw WHERE air_temperature IS NOT NULL OR site_id = 2),
coming AS (SELECT c.building_id, c.meter, w.air_temperature, w.timestamp,
    row_number() OVER (PARTITION BY c.building_id, c.meter ORDER BY w.timestamp) AS k
  FROM cutoffs c JOIN building_meta b ON b.building_id = c.building_id JOIN given w ON w.site_id = b.site_id AND w.timestamp > c.cutoff),
temps AS (SELECT building_id, meter, list(air_temperature ORDER BY timestamp) AS temps FROM coming WHERE k <= 24
  GROUP BY 1, 2 HAVING count(air_temperature) = 24)"""
FORECAST = (*DENSE_MERGED, forecast(OBSERVED, "dataset_observed"))
_FC_COLS = "building_id, meter, timestamp, CAST(step AS BIGINT) AS step, weather_source, " + ", ".join(
    f"{r(c)} AS {c}" for c in ("predicted_log", "predicted_kwh")) + ", " + ", ".join(
    f"CAST({c} AS BIGINT) AS {c}" if c in WHOLE_NUMBERS and c != "square_feet" else f"{r(c)} AS {c}"
    for c in MODEL_FEATURES)
IMPACT = """impact AS (SELECT *, predicted_kwh * 8.0 AS hourly_cost, predicted_kwh * 0.7 AS hourly_carbon_kg FROM forecast)"""
_IMPACT_SUM = """impact_sum AS (SELECT building_id, meter, sum(predicted_kwh) AS total_kwh, sum(hourly_cost) AS total_cost,
    sum(hourly_carbon_kg) AS total_carbon_kg, avg(hourly_cost) AS average_hourly_cost,
    avg(hourly_carbon_kg) AS average_hourly_carbon_kg, first(timestamp ORDER BY hourly_cost DESC, step) AS peak_cost_hour,
    first(timestamp ORDER BY hourly_carbon_kg DESC, step) AS peak_carbon_hour FROM impact GROUP BY 1, 2)"""

SWEEP = f"""scenarios(scenario_type, scenario_value) AS (VALUES {", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in SCENARIOS)}),
crossed AS (SELECT f.*, s.*, predicted_kwh AS baseline_kwh, CASE scenario_type
    WHEN 'ENERGY_REDUCTION' THEN predicted_kwh * (1 - scenario_value)
    WHEN 'FIXED_KWH_ADDITION' THEN predicted_kwh + scenario_value
    WHEN 'OCCUPANCY_CHANGE' THEN predicted_kwh * (1 + scenario_value * 0.4 * is_business_hours)
    WHEN 'TEMPERATURE_CHANGE' THEN predicted_kwh * greatest(least(1 + scenario_value * 0.025, 3.0), 0.1)
    ELSE predicted_kwh * scenario_value END AS simulated_kwh FROM forecast f, scenarios s),
allowed AS (SELECT building_id, meter, scenario_type, scenario_value FROM crossed GROUP BY 1, 2, 3, 4 HAVING min(simulated_kwh) >= 0),
sweep AS (SELECT *, simulated_kwh - baseline_kwh AS delta_kwh,
    CASE WHEN baseline_kwh > 0 THEN (simulated_kwh - baseline_kwh) / baseline_kwh * 100 ELSE 0.0 END AS delta_percent
  FROM crossed JOIN allowed USING (building_id, meter, scenario_type, scenario_value)),
sweep_sum AS (SELECT building_id, meter, scenario_type, scenario_value,
    {", ".join(f"sum({s}_kwh) AS {s}_total_kwh, max({s}_kwh) AS {s}_peak_kwh, first(timestamp ORDER BY {s}_kwh DESC, step) AS {s}_peak_hour" for s in ("baseline", "simulated"))}
  FROM sweep GROUP BY 1, 2, 3, 4)"""

# ---- isolation forest ----------------------------------------------------------

def isolation_forest(trees: int = 100, rows: int = 256, depth: int = 8, seed: int = 42) -> str:
    """CTEs that draw and grow the forest on the complete rows of ``model_rows``, walk the rows of ``features`` and ``model_rows``
    down it, and cut at the 5 % quantile: ``forest_nodes``, ``forest_cut``, ``forest_scored``."""
    f = [f"CAST({c} AS DOUBLE)" for c in ANOMALY_FEATURES]
    whole = " AND ".join(f"{c} IS NOT NULL" for c in ANOMALY_FEATURES)
    path = lambda n: f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329) - 2.0 * ({n} - 1) / {n} WHEN {n} = 2 THEN 1.0 ELSE 0.0 END"
    width = range(1, len(f) + 1)
    ctes = [f"""pool AS (SELECT x, row_number() OVER (ORDER BY d, building_id, meter, timestamp) - 1 AS place FROM (
    SELECT *, [{", ".join(f)}] AS x, md5('{seed}|' || building_id || '|' || meter || '|' || strftime(timestamp, '%Y-%m-%d %H:%M:%S')) AS d
    FROM model_rows WHERE {whole}) QUALIFY row_number() OVER (ORDER BY d, building_id, meter, timestamp) <= {trees * rows})""",
            f"""level0 AS (SELECT CAST(t AS BIGINT) AS tree, CAST(0 AS BIGINT) AS node, x FROM range({trees}) a(t), range({rows}) b(i), (SELECT count(*) AS p FROM pool) c
    JOIN pool ON place = (t * least({rows}, p) + i) % p WHERE i < p)"""]
    for k in range(depth + 1):
        ctes.append(f"""size{k} AS (SELECT tree, node, count(*) AS n, [{", ".join(f"min(x[{i}])" for i in width)}] AS lo,
    [{", ".join(f"max(x[{i}])" for i in width)}] AS hi, md5('{seed}|' || tree || '|' || node) AS d FROM level{k} GROUP BY 1, 2)""")
        ctes.append(f"""usable{k} AS (SELECT *, list_filter(range(1, {len(f) + 1}), lambda i: hi[i] > lo[i]) AS u FROM size{k}),
pick{k} AS (SELECT *, CASE WHEN len(u) > 0 AND n > 1 AND {k} < {depth} THEN u[CAST(('0x' || d[1:8])::BIGINT % len(u) + 1 AS BIGINT)] END AS j FROM usable{k}),
node{k} AS (SELECT tree, node, {k} AS depth, n, CASE WHEN cut < hi[j] THEN j END AS j, cut, {k} + {path("n")} AS value
    FROM (SELECT *, lo[j] + ('0x' || d[9:16])::BIGINT / 4294967296.0::DOUBLE * (hi[j] - lo[j]) AS cut FROM pick{k}))""")
        if k < depth:
            ctes.append(f"""level{k + 1} AS (SELECT tree, CASE WHEN x[j] <= cut THEN 2 * node + 1 ELSE 2 * node + 2 END AS node, x
    FROM level{k} JOIN node{k} USING (tree, node) WHERE j IS NOT NULL)""")
    ctes.append("forest_nodes AS (" + " UNION ALL ".join(f"SELECT * FROM node{k}" for k in range(depth + 1)) + ")")
    ctes.append(f"""asked AS (SELECT 'features' AS side, building_id, meter, timestamp, [{", ".join(f)}] AS x FROM features WHERE {whole}
  UNION ALL SELECT 'model', building_id, meter, timestamp, [{", ".join(f)}] FROM model_rows WHERE {whole}),
walk0 AS (SELECT side, building_id, meter, timestamp, x, CAST(t AS BIGINT) AS tree, CAST(0 AS BIGINT) AS node FROM asked, range({trees}) a(t))""")
    for k in range(depth):
        ctes.append(f"""walk{k + 1} AS (SELECT side, building_id, meter, timestamp, x, w.tree,
    CASE WHEN j IS NULL THEN w.node WHEN x[j] <= cut THEN 2 * w.node + 1 ELSE 2 * w.node + 2 END AS node
  FROM walk{k} w JOIN forest_nodes f ON f.tree = w.tree AND f.node = w.node)""")
    ctes.append(f"""most AS (SELECT max(n) AS m FROM forest_nodes WHERE node = 0),
depths AS (SELECT side, building_id, meter, timestamp, sum(value) / {trees} AS deep FROM walk{depth} JOIN forest_nodes USING (tree, node) GROUP BY 1, 2, 3, 4),
judged AS (SELECT side, building_id, meter, timestamp, round(-pow(2.0, -deep / greatest({path("m")}, 1e-9)), 9) AS score FROM depths, most),
forest_cut AS (SELECT quantile_cont(score, 0.05) AS cut FROM judged WHERE side = 'model'),
forest_scored AS (SELECT building_id, meter, timestamp, score AS isoforest_score, coalesce(score < cut, FALSE) AS isolated
  FROM (SELECT building_id, meter, timestamp FROM features) LEFT JOIN (SELECT * FROM judged WHERE side = 'features') USING (building_id, meter, timestamp), forest_cut)""")
    return ",\n".join(ctes)


# ---- states ------------------------------------------------------------------

_STATE_WINDOW = """refs AS (SELECT building_id, meter, max(timestamp) AS reference FROM features GROUP BY 1, 2),
recent AS (SELECT f.*, reference FROM features f JOIN refs USING (building_id, meter)
           WHERE timestamp >= reference - INTERVAL 24 HOUR)"""
STATE = (
    *DENSE_MERGED, FEATURES, _STATE_WINDOW, residual("recent", "meter_reading", MEAN6_EXPECTED), streak(), TYPED,
    forecast(OBSERVED, "dataset_observed"), IMPACT, _IMPACT_SUM,
    """fc_part AS (SELECT building_id, meter, count(*) AS horizon, sum(predicted_kwh) AS total, max(predicted_kwh) AS peak,
    first(timestamp ORDER BY predicted_kwh DESC, step) AS peak_hour, any_value(weather_source) AS weather_source
  FROM forecast GROUP BY 1, 2)""",
    """states AS (SELECT r.building_id, r.reference AS timestamp, r.meter, t.actual_kwh, t.expected_kwh,
    t.residual AS residual_kwh, t.deviation_ratio, t.severity, t.anomaly_type, f.horizon AS forecast_horizon_hours,
    f.total AS forecast_total_kwh, f.peak AS forecast_peak_kwh, f.peak_hour AS forecast_peak_hour,
    i.total_cost AS forecast_total_cost, i.total_carbon_kg AS forecast_total_carbon_kg, f.weather_source,
    coalesce(t.severity, 'UNAVAILABLE') AS state_status
  FROM refs r LEFT JOIN typed t ON r.building_id = t.building_id AND r.meter = t.meter AND r.reference = t.timestamp
  LEFT JOIN fc_part f ON r.building_id = f.building_id AND r.meter = f.meter
  LEFT JOIN impact_sum i ON r.building_id = i.building_id AND r.meter = i.meter)""",
)
_STATE_DOUBLES = ["actual_kwh", "expected_kwh", "residual_kwh", "deviation_ratio", "forecast_total_kwh",
                  "forecast_peak_kwh", "forecast_total_cost", "forecast_total_carbon_kg"]
_STATE_COLS = "building_id, timestamp, meter, severity, anomaly_type, forecast_horizon_hours, forecast_peak_hour, " \
    "weather_source, state_status, " + ", ".join(f"{r(c)} AS {c}" for c in _STATE_DOUBLES)

_FIRES = {
    "CRIT": "severity = 'CRITICAL'", "ANOM": "anomaly_type = 'HIGH_DEMAND'", "SPIKE": "anomaly_type = 'RAPID_SPIKE'",
    "PERS": "anomaly_type = 'PERSISTENT_HIGH'", "LOW": "anomaly_type = 'LOW_DEMAND'",
    "COST": "forecast_total_cost > 13000", "CARB": "forecast_total_carbon_kg > 1000", "SIM": "delta_total_kwh < 0",
}


def _recommendations() -> str:
    rules = " UNION ALL ".join(
        f"SELECT building_id, meter, {i} AS place, '{code}' AS code, '{prio}' AS priority, '{cat}' AS category, "
        f"CAST({PRIORITY_RANK[prio]} AS BIGINT) AS priority_rank FROM ctx WHERE {_FIRES[code]}"
        for i, (code, prio, cat, *_rest) in enumerate(RULES) if code != "NORM")
    return with_(
        *STATE, SWEEP,
        """ctx AS (SELECT s.*, simulated_total_kwh - baseline_total_kwh AS delta_total_kwh FROM states s
  LEFT JOIN (SELECT * FROM sweep_sum WHERE scenario_type = 'FIXED_KWH_ADDITION' AND scenario_value = -60.0) d
  USING (building_id, meter))""",
        f"fired AS ({rules})",
        """everything AS (SELECT * FROM fired UNION ALL
  SELECT building_id, meter, 8, 'NORM', 'INFO', 'ENERGY', CAST(5 AS BIGINT) FROM ctx c WHERE state_status = 'NORMAL'
  AND NOT EXISTS (SELECT 1 FROM fired f WHERE f.building_id = c.building_id AND f.meter = c.meter))""",
        """numbered AS (SELECT *, row_number() OVER (PARTITION BY building_id, meter ORDER BY place) AS number,
    row_number() OVER (PARTITION BY building_id, meter ORDER BY priority_rank, place) AS rank FROM everything)""",
        recursive=True) + """SELECT building_id, meter, rank, priority, category, priority_rank, number,
    'REC-' || code || '-' || lpad(CAST(number AS VARCHAR), 3, '0') AS recommendation_id FROM numbered"""


def _validate() -> str:
    nulls = lambda names: " + ".join(f"count_if({c} IS NULL)" for c in names)
    m = {
        ("required_columns", "TRUE"): {"missing": "''", "found_count": "37", "required_count": "37"},
        ("timestamps", "count_if(timestamp IS NULL) = 0"): {
            "null_count": "count_if(timestamp IS NULL)", "min_timestamp": "min(timestamp)", "max_timestamp": "max(timestamp)"},
        ("building_ids", "count_if(building_id IS NULL) = 0 AND min(building_id) >= 0"): {
            "null_count": "count_if(building_id IS NULL)", "unique_buildings": "count(DISTINCT building_id)",
            "min_building_id": "min(building_id)"},
        ("meters", "count_if(meter NOT IN (0, 1, 2, 3)) = 0 AND count(*) > 0"): {
            "unexpected_rows": "count_if(meter NOT IN (0, 1, 2, 3))", "null_count": "count_if(meter IS NULL)"},
        ("target", "count_if(meter_reading IS NULL OR meter_reading <= 0) = 0"): {
            "null_raw": "count_if(meter_reading IS NULL)", "null_log": "count_if(meter_reading_log IS NULL)",
            "non_positive_count": "count_if(meter_reading <= 0)",
            "max_log1p_diff": "round(max(abs(meter_reading_log - ln(1 + meter_reading))), 6)"},
        ("model_features", f"{nulls(MODEL_FEATURES)} = 0"): {"total_features": "22", "null_values": nulls(MODEL_FEATURES)},
        ("anomaly_features", f"{nulls(ANOMALY_FEATURES)} = 0"): {
            "total_features": "8", "null_values": nulls(ANOMALY_FEATURES)},
        ("missing_values", f"{nulls(CRITICAL_COLUMNS)} = 0"): {"critical_nulls": nulls(CRITICAL_COLUMNS)},
        ("unique_timestamps", "count(*) = count(DISTINCT (building_id, meter, timestamp))"): {
            "duplicate_timestamp_count": "count(*) - count(DISTINCT (building_id, meter, timestamp))"},
    }
    parts = [f"SELECT '{check}' AS \"check\", {ok} AS passed, '{k}' AS metric, CAST({v} AS VARCHAR) AS value FROM features HAVING count(*) > 0"
             for (check, ok), metrics in m.items() for k, v in metrics.items()]
    return with_(*FEATURED) + " UNION ALL ".join(parts)


def _pairs() -> str:
    wide = ", ".join(f"corr({a}, {b}) AS c_{i}_{j}" for i, a in enumerate(CORRELATION_COLUMNS)
                     for j, b in enumerate(CORRELATION_COLUMNS))
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS row_feature, '{b}' AS col_feature, {r(f'c_{i}_{j}')} AS corr FROM wide"
        for i, a in enumerate(CORRELATION_COLUMNS) for j, b in enumerate(CORRELATION_COLUMNS))
    whole = " AND ".join(f"{c} IS NOT NULL" for c in CORRELATION_COLUMNS)
    return with_(*FEATURED, f"wide AS (SELECT {wide} FROM features WHERE {whole})") + rows


_POINTS = """points AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + 40 AS a, CAST(50 + l_suppkey % 40 AS DOUBLE) AS e,
    40 + l_discount * 500 AS rolling_mean_6hr_kwh, 40 + l_tax * 1000 AS rolling_mean_24hr_kwh,
    CAST(l_linenumber AS BIGINT) AS streak_hours FROM lineitem)"""
_CHECK_STATES = """candidates AS (SELECT CASE WHEN c_acctbal < 0 THEN -c_custkey - 1 ELSE c_custkey END AS building_id,
    CAST(c_nationkey % 6 - 1 AS BIGINT) AS meter,
    CASE WHEN c_nationkey % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 720 AS INT)) END AS timestamp,
    CASE WHEN c_nationkey = 3 THEN 'nan'::DOUBLE WHEN c_nationkey = 4 THEN 'infinity'::DOUBLE ELSE c_acctbal END AS actual_kwh,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'ODD' ELSE 'NORMAL' END AS state_status FROM customer)"""


def oracle_sql() -> dict[str, str]:
    full = cols(ALL_COLUMNS)
    month = lambda m: f"month(timestamp) = {m}"
    flat_counts = ", ".join(
        [f"count_if(severity = '{s}') AS n_{s.lower()}" for s in ("NORMAL", "WARNING", "CRITICAL")]
        + [f"count_if(anomaly_type = '{t}') AS t_{t.lower()}" for t in (
            "NORMAL", "LOW_DEMAND", "RAPID_SPIKE", "PERSISTENT_HIGH", "HIGH_DEMAND")])
    sum_cols = "building_id, meter, " + ", ".join(f"{r(c)} AS {c}" for c in (
        "total_kwh", "total_cost", "total_carbon_kg", "average_hourly_cost", "average_hourly_carbon_kg")) + \
        ", peak_cost_hour, peak_carbon_hour, 8.0::DOUBLE AS tariff_per_kwh, 0.7::DOUBLE AS carbon_intensity_kg_per_kwh"
    slice_cols = "building_id, meter, timestamp, meter_reading"
    week = (*FEATURED, """refs AS (SELECT building_id, meter, max(timestamp) AS reference FROM features GROUP BY 1, 2),
recent AS (SELECT f.*, reference FROM features f JOIN refs USING (building_id, meter) WHERE timestamp >= reference - INTERVAL 167 HOUR)""",
            residual("recent", "meter_reading", MEAN6_EXPECTED), streak(), TYPED)
    model_merged = merged("cleaned").replace("merged AS", "model_merged AS", 1)
    model_features = FEATURES
    for name in ("windowed", "temp_mid", "features", "merged"):
        model_features = model_features.replace(f"FROM {name}", f"FROM model_{name}").replace(f"{name} AS (", f"model_{name} AS (")
    model_features = model_features.replace("FROM model_windowed, temp_mid", "FROM model_windowed, model_temp_mid")
    forest_parts = (*FEATURED, CLEAN, model_merged, model_features, """model_rows AS (SELECT * FROM model_features
  WHERE lag_1hr IS NOT NULL AND lag_24hr IS NOT NULL AND rolling_mean_6hr IS NOT NULL)""", isolation_forest())
    forested = with_(*forest_parts)
    return {
        "load_slice": with_(READINGS) + f"""SELECT {slice_cols} FROM readings WHERE building_id = 1 AND meter = 0
  AND timestamp >= TIMESTAMP '2024-01-10' AND timestamp <= TIMESTAMP '2024-01-20 23:00:00' ORDER BY timestamp LIMIT 150""",
        "load_slice_inlist": with_(READINGS) + f"""SELECT {slice_cols} FROM readings WHERE building_id IN (0, 2, 5) AND meter IN (0, 1)""",
        "parse_timestamps": """SELECT event_id, date_trunc('second', ts) AS strict_time,
  CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS lenient_time FROM events""",
        "scan_csv_roundtrip": with_(RAW) + f"SELECT {slice_cols} FROM readings_raw",
        "sample_extract": with_(READINGS) + f"SELECT {slice_cols} FROM readings WHERE building_id IN (0, 1, 2, 20, 100, 500)",
        "building_metadata": with_(READINGS, META) + """SELECT DISTINCT b.building_id, site_id, primary_use, square_feet, year_built, floor_count
  FROM building_meta b JOIN readings USING (building_id)""",
        "buildings_list": with_(READINGS) + """SELECT 'building' AS kind, building_id AS id, CAST(NULL AS VARCHAR) AS name FROM readings GROUP BY building_id
  UNION ALL SELECT 'meter', meter, CASE meter WHEN 0 THEN 'Electricity' WHEN 1 THEN 'Chilled Water' WHEN 2 THEN 'Steam' WHEN 3 THEN 'Hot Water' ELSE 'Meter ' || meter END FROM readings GROUP BY meter
  UNION ALL SELECT 'total', count(DISTINCT building_id), CAST(NULL AS VARCHAR) FROM readings""",
        "latest_timestamps": with_(READINGS) + "SELECT building_id, meter, max(timestamp) AS latest FROM readings GROUP BY 1, 2",
        "reject_unknown_series": with_(READINGS, """requests AS (SELECT c_custkey - 3 AS building_id, CAST(c_nationkey % 6 - 1 AS BIGINT) AS meter FROM customer)""")
        + """SELECT building_id, meter, CASE WHEN building_id < 0 OR meter < 0 THEN 'negative id' ELSE 'unknown series' END AS reason
  FROM requests q WHERE building_id < 0 OR meter < 0 OR NOT EXISTS (SELECT 1 FROM readings x WHERE x.building_id = q.building_id AND x.meter = q.meter)""",
        "dataset_overview": with_(RAW) + """SELECT min(timestamp) AS first_time, max(timestamp) AS last_time, count(DISTINCT building_id) AS buildings,
  count(*) AS readings, (SELECT string_agg(CAST(meter AS VARCHAR), ',' ORDER BY meter) FROM (SELECT DISTINCT meter FROM readings_raw)) AS meters FROM readings_raw""",
        "null_profile": with_(*MERGED) + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS null_count FROM merged" for c in ALL_COLUMNS[:17]),
        "value_counts": with_(READINGS, META, WEATHER, CLEAN, merged("cleaned"), FEATURES) + """
  SELECT 'meter' AS field, CAST(meter AS VARCHAR) AS value, count(*) AS n FROM readings_raw GROUP BY meter
  UNION ALL (SELECT 'primary_use', primary_use, count(*) AS n FROM building_meta GROUP BY 2 ORDER BY n DESC, primary_use LIMIT 8)
  UNION ALL SELECT 'month', CAST(month AS VARCHAR), count(*) FROM features
    WHERE meter = 0 AND lag_1hr IS NOT NULL AND lag_24hr IS NOT NULL AND rolling_mean_6hr IS NOT NULL GROUP BY month""",
        "validate_all": _validate(),
        "validation_verdict": f"""SELECT bool_and(passed) AS passed, count(*) AS total_checks, count_if(passed) AS passed_checks
  FROM (SELECT DISTINCT "check", passed FROM ({_validate()}))""",
        "clean_readings": with_(READINGS, CLEAN) + f"SELECT {slice_cols} FROM cleaned",
        "fill_weather": with_(WEATHER) + """SELECT site_id, timestamp, air_temperature, cloud_coverage, dew_temperature,
  precip_depth_1_hr, sea_level_pressure, wind_direction, wind_speed FROM weather""",
        "merge_sources": with_(*MERGED) + f"SELECT {cols(ALL_COLUMNS[:17])} FROM merged",
        "calendar_features": with_(READINGS) + f"SELECT {slice_cols}, {', '.join(r(e) + ' AS ' + c if c[-4:] in ('_sin', '_cos') else e + ' AS ' + c for c, e in calendar('timestamp').items())} FROM readings",
        "lag_features": with_(*MERGED, FEATURES) + f"SELECT {_KEYS}, {r('raw_lag_1')} AS lag_1hr, {r('raw_lag_24')} AS lag_24hr, {r('raw_lag_168')} AS lag_168hr FROM features",
        "rolling_features": with_(*MERGED, FEATURES) + f"SELECT {_KEYS}, " + ", ".join(
            f"{r(c)} AS {c}" for c in ("rolling_mean_6hr", "rolling_mean_24hr", "rolling_std_24hr", "rolling_mean_168hr")) + " FROM features",
        "interactions": with_(*MERGED, FEATURES) + f"SELECT {_KEYS}, " + ", ".join(
            f"{r(c)} AS {c}" for c in ("temp_x_hour", "temp_x_weekend", "occupancy_proxy")) + " FROM features",
        "feature_table": with_(*FEATURED) + f"SELECT {full} FROM features",
        "model_table": with_(READINGS, META, WEATHER, CLEAN, merged("cleaned"), FEATURES) + f"""SELECT {full} FROM features
  WHERE lag_1hr IS NOT NULL AND lag_24hr IS NOT NULL AND rolling_mean_6hr IS NOT NULL""",
        "monthly_summary": with_(READINGS) + f"""SELECT month(timestamp) AS month, {r('sum(meter_reading)')} AS total, {r('avg(meter_reading)')} AS avg,
  max(meter_reading) AS peak, strftime(min(timestamp), '%b') AS month_name FROM readings WHERE meter = 0 GROUP BY 1""",
        "median_by_timestamp": with_(READINGS) + f"SELECT timestamp, {r('median(meter_reading)')} AS median FROM readings WHERE meter = 0 GROUP BY 1",
        "median_week": with_(READINGS) + f"""SELECT timestamp, {r('median(meter_reading)')} AS median FROM readings WHERE meter = 0
  AND timestamp >= TIMESTAMP '2024-01-08' AND timestamp <= TIMESTAMP '2024-01-14' GROUP BY 1""",
        "median_patterns": with_(READINGS) + " UNION ALL ".join(
            f"SELECT '{n}' AS pattern, {e} AS bucket, {r('median(meter_reading)')} AS median FROM readings WHERE meter = 0 GROUP BY {e}"
            for n, e in (("hour", "hour(timestamp)"), ("dayofweek", "isodow(timestamp) - 1"), ("month", "month(timestamp)"))),
        "hourly_pattern": with_(READINGS) + f"SELECT building_id, hour(timestamp) AS hour, {r('median(meter_reading)')} AS median FROM readings GROUP BY 1, 2",
        "available_months": with_(READINGS) + """SELECT building_id, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS months,
  CAST(CASE WHEN bool_or(m = 5) THEN 5 ELSE min(m) END AS BIGINT) AS default_month
  FROM (SELECT DISTINCT building_id, month(timestamp) AS m FROM readings) GROUP BY 1""",
        "correlation_matrix": _pairs(),
        "band_baseline": with_(READINGS) + f"""SELECT {_KEYS}, {r('b')} AS baseline, {r('b * 1.5')} AS upper_band, {r('b * 0.5')} AS lower_band,
  meter_reading > b * 1.5 AS above_band FROM (SELECT *, avg(meter_reading) OVER ({W} ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS b FROM readings)""",
        "temporal_split": with_(*FEATURED) + f"""SELECT {_KEYS}, CASE WHEN timestamp < TIMESTAMP '2024-03-01' THEN 'train' ELSE 'test' END AS part
  FROM features WHERE meter = 0""",
        "forecast_eligibility": with_(READINGS, DENSE, """both_tables AS (SELECT 'gappy' AS source, * FROM readings UNION ALL SELECT 'dense', * FROM dense),
cut AS (SELECT source, building_id, meter, max(timestamp) - INTERVAL 24 HOUR AS cutoff FROM both_tables GROUP BY 1, 2, 3),
counted AS (SELECT c.source, c.building_id, c.meter, cutoff, count(b.timestamp) AS n FROM cut c LEFT JOIN both_tables b ON b.source = c.source
  AND b.building_id = c.building_id AND b.meter = c.meter AND b.timestamp <= cutoff AND b.timestamp > cutoff - INTERVAL 168 HOUR GROUP BY 1, 2, 3, 4)""")
        + """SELECT source, building_id, meter, cutoff, n AS history_rows, n AS history_hours, n = 168 AS eligible,
  CASE WHEN n = 168 THEN '' ELSE 'fewer than 168 readings' END AS reason FROM counted""",
        "forecast_24h": with_(*FORECAST, recursive=True) + f"SELECT {_FC_COLS} FROM forecast",
        "forecast_rejects": with_(*DENSE_MERGED, """cut AS (SELECT building_id, meter, max(timestamp) - INTERVAL 24 HOUR AS cutoff FROM merged GROUP BY 1, 2),
around AS (SELECT building_id, meter, count_if(timestamp <= cutoff AND timestamp > cutoff - INTERVAL 168 HOUR) AS before,
  count_if(timestamp > cutoff) AS after, count_if(timestamp > cutoff AND air_temperature IS NOT NULL) AS warm
  FROM merged JOIN cut USING (building_id, meter) GROUP BY 1, 2)""") + """SELECT building_id, meter, CASE WHEN before < 168 THEN 'fewer than 168 readings'
  WHEN after < 24 THEN 'weather does not cover the horizon' ELSE 'weather is missing' END AS reason
  FROM around WHERE before < 168 OR after < 24 OR warm < 24""",
        "forecast_given_weather": with_(*DENSE_MERGED, forecast(GIVEN, "provided"), recursive=True) + f"SELECT {_FC_COLS} FROM forecast",
        "forecast_table_weather": with_(*DENSE_MERGED, forecast(TABLE_WEATHER, "provided", 72), recursive=True) + f"SELECT {_FC_COLS} FROM forecast",
        "forecast_table_weather_rejects": with_(*DENSE_MERGED, """cutoffs AS (SELECT building_id, meter, max(timestamp) - INTERVAL 72 HOUR AS cutoff FROM merged GROUP BY 1, 2),
past AS (SELECT building_id, meter, count_if(timestamp <= cutoff AND timestamp > cutoff - INTERVAL 168 HOUR) AS before FROM merged JOIN cutoffs USING (building_id, meter) GROUP BY 1, 2)""",
            TABLE_WEATHER, "ahead AS (SELECT building_id, meter, count(*) AS n, count(air_temperature) AS known FROM coming WHERE k <= 24 GROUP BY 1, 2)")
        + """SELECT building_id, meter, CASE WHEN before < 168 THEN 'fewer than 168 readings' WHEN coalesce(n, 0) < 24 THEN 'weather does not cover the horizon'
  ELSE 'weather is missing' END AS reason FROM past LEFT JOIN ahead USING (building_id, meter) WHERE before < 168 OR coalesce(n, 0) < 24 OR known < 24""",
        "forecast_summary": with_(*FORECAST, recursive=True) + f"""SELECT building_id, meter, count(*) AS horizon_hours, {r('sum(predicted_kwh)')} AS total_kwh,
  {r('avg(predicted_kwh)')} AS average_kwh, {r('max(predicted_kwh)')} AS peak_kwh, first(timestamp ORDER BY predicted_kwh DESC, step) AS peak_hour,
  {r('min(predicted_kwh)')} AS low_kwh, first(timestamp ORDER BY predicted_kwh, step) AS low_hour FROM forecast GROUP BY 1, 2""",
        "forecast_band": with_(*FORECAST, recursive=True) + f"""SELECT {_KEYS}, {r('predicted_kwh')} AS predicted_kwh,
  {r('predicted_kwh * 0.85')} AS lower, {r('predicted_kwh * 1.15')} AS upper FROM forecast""",
        "model_eval": with_(*FEATURED, f"""test AS (SELECT meter_reading_log AS y, {_score()} AS p FROM features
  WHERE meter = 0 AND timestamp >= TIMESTAMP '2024-03-01' AND {COMPLETE})""",
                            """err AS (SELECT count(*) AS n, sqrt(avg(pow(y - p, 2))) AS rmse,
  avg(abs(exp(y) - exp(p)) / greatest(abs(exp(y) - 1), 2.220446049250313e-16)) * 100 AS mape FROM test)""")
        + f"SELECT n, {r('rmse')} AS rmse_log, {r('mape')} AS mape, {r('100 - mape')} AS accuracy_proxy FROM err",
        "anomaly_residual": with_(*FEATURED, SCORED) + f"SELECT {_KEYS}, {_RES} FROM scored",
        "anomaly_streak": with_(*FEATURED, SCORED, streak()) + f"SELECT {_KEYS}, is_anomaly, streak_hours FROM streaked",
        "anomaly_classify": with_(*FEATURED, SCORED, streak(), TYPED) + f"SELECT {_KEYS}, {_RES}, streak_hours, anomaly_type, priority_rank FROM typed",
        "anomaly_points": with_(_POINTS, residual("points", "a", "e"), typed("scored", "rolling_mean_6hr_kwh", "rolling_mean_24hr_kwh"))
        + f"SELECT l_orderkey, l_linenumber, l_partkey, {_RES}, anomaly_type, priority_rank FROM typed",
        "anomaly_model": with_(*FEATURED, f"""ready AS (SELECT *, {COMPLETE} AS whole, bool_and({COMPLETE}) OVER (PARTITION BY building_id, meter) AS all_whole,
    greatest(exp({_score()}) - 1, 0.0) AS model, {MEAN6_EXPECTED} AS mean6 FROM features),
sides AS (SELECT 'row' AS rule, *, CASE WHEN whole THEN model ELSE mean6 END AS e FROM ready
  UNION ALL SELECT 'frame', *, CASE WHEN all_whole THEN model ELSE mean6 END FROM ready
  UNION ALL SELECT 'complete frame', *, model FROM ready WHERE whole)""", residual("sides", "meter_reading", "e")) + f"SELECT rule, {_KEYS}, {_RES} FROM scored",
        "monthly_kpis_model": with_(*FEATURED, f"""in_month AS (SELECT *, greatest(exp({_score()}) - 1, 0.0) AS model, {COMPLETE} AS whole,
    bool_and({COMPLETE}) OVER (PARTITION BY building_id, meter) AS all_whole FROM features WHERE meter = 0 AND {month(2)}),
expecting AS (SELECT *, CASE WHEN all_whole THEN model ELSE {MEAN6_EXPECTED} END AS e FROM in_month)""", residual("expecting", "meter_reading", "e"), """panel AS (
  SELECT building_id, arg_max(exp(meter_reading_log) - 1, timestamp) AS current_kwh, arg_max(model, timestamp) AS predicted_kwh,
    avg(exp(meter_reading_log) - 1) AS average_kwh, sum(exp(meter_reading_log) - 1) AS total_kwh FROM in_month WHERE whole GROUP BY 1),
flags AS (SELECT building_id, CAST(sum(is_anomaly) AS BIGINT) AS anomaly_count FROM scored GROUP BY 1)""")
        + f"""SELECT building_id, {", ".join(f"{r(c)} AS {c}" for c in ("current_kwh", "predicted_kwh", "average_kwh", "total_kwh"))}, anomaly_count,
  {r('total_kwh * 0.7')} AS co2_kg, {r('(current_kwh - predicted_kwh) / predicted_kwh * 100')} AS delta_percent FROM panel LEFT JOIN flags USING (building_id)""",
        "month_alerts_model": with_(*FEATURED, f"""in_month AS (SELECT *, greatest(exp({_score()}) - 1, 0.0) AS model,
    bool_and({COMPLETE}) OVER (PARTITION BY building_id, meter) AS all_whole FROM features WHERE {month(2)}),
expecting AS (SELECT *, CASE WHEN all_whole THEN model ELSE {MEAN6_EXPECTED} END AS e FROM in_month)""", residual("expecting", "meter_reading", "e"))
        + f"""SELECT {_KEYS}, place, more, severity, {r('residual')} AS residual, strftime(timestamp, '%d %b %H:%M') AS shown_time
  FROM (SELECT *, row_number() OVER ({W}) AS place, greatest(count(*) OVER (PARTITION BY building_id, meter) - 8, 0) AS more
        FROM scored WHERE is_anomaly = 1) WHERE place <= 8""",
        "unexpected_meters": """SELECT DISTINCT CAST(c_nationkey % 9 - 2 AS BIGINT) AS meter FROM customer WHERE c_nationkey % 9 - 2 NOT IN (0, 1, 2, 3)""",
        "anomaly_reason": with_(*FEATURED, SCORED, streak(), TYPED) + f"""SELECT {_KEYS}, anomaly_type,
  {reason("(exp(rolling_mean_6hr) - 1)", "(exp(rolling_mean_24hr) - 1)")} AS classification_reason FROM typed""",
        "isoforest_fit": forested + f"""SELECT tree AS tree_id, max(CASE WHEN node = 0 THEN n END) AS sample_rows, count(*) AS nodes,
  {r('sum(CASE WHEN j IS NULL THEN value END)')} AS leaf_depths, (SELECT {r('cut')} FROM forest_cut) AS cut FROM forest_nodes GROUP BY 1""",
        "isoforest_score": forested + f"""SELECT {_KEYS}, {r('isoforest_score')} AS isoforest_score, CAST(CASE WHEN isolated THEN -1 ELSE 1 END AS BIGINT) AS anomaly_score,
  CAST(isolated AS BIGINT) AS isoforest_anomaly FROM forest_scored""",
        "isoforest_persist": forested + f"SELECT {_KEYS} FROM forest_scored WHERE isolated",
        "isoforest_summary": forested + f"""SELECT building_id, meter, CAST(sum(CAST(isolated AS BIGINT)) AS BIGINT) AS flags, {r('avg(isoforest_score)')} AS mean_score
  FROM forest_scored GROUP BY 1, 2""",
        "anomaly_detect": with_(*forest_parts, SCORED, streak(), TYPED) + f"""SELECT {_KEYS}, {_RES}, anomaly_type, CAST(isolated AS BIGINT) AS isoforest_anomaly,
  {r('isoforest_score')} AS isoforest_score, CAST(CASE WHEN isolated THEN -1 ELSE 1 END AS BIGINT) AS anomaly_score
  FROM typed JOIN forest_scored USING (building_id, meter, timestamp)""",
        "anomaly_report": with_(*week) + f"""SELECT building_id, meter, count(*) AS total_records, CAST(sum(is_anomaly) AS BIGINT) AS anomaly_count, CAST(0 AS BIGINT) AS forest_count, {flat_counts}
  FROM typed GROUP BY 1, 2""",
        "anomaly_flagged": with_(*week) + f"SELECT {_KEYS}, {_RES}, anomaly_type FROM typed WHERE is_anomaly = 1",
        "anomaly_overlay": with_(*FEATURED, SCORED) + f"""SELECT {_KEYS}, {r('exp(meter_reading_log) - 1')} AS marker_kwh, severity,
  CASE WHEN {COMPLETE} THEN {r('exp(meter_reading_log) - 1')} END AS actual FROM scored WHERE is_anomaly = 1 AND meter = 0 AND {month(2)}""",
        "top_anomalies": with_(*FEATURED, SCORED) + f"""SELECT {_KEYS}, place, more, severity, {r('residual')} AS residual, strftime(timestamp, '%d %b %H:%M') AS shown_time
  FROM (SELECT *, row_number() OVER ({W}) AS place, greatest(count(*) OVER (PARTITION BY building_id, meter) - 8, 0) AS more
        FROM scored WHERE is_anomaly = 1 AND {month(2)}) WHERE place <= 8""",
        "monthly_kpis": with_(*FEATURED, SCORED, f"""clean AS (SELECT *, exp(meter_reading_log) - 1 AS actual, greatest(exp({_score()}) - 1, 0.0) AS predicted
  FROM scored WHERE meter = 0 AND {month(2)} AND {COMPLETE}),
panel AS (SELECT building_id, arg_max(actual, timestamp) AS current_kwh, arg_max(predicted, timestamp) AS predicted_kwh,
  avg(actual) AS average_kwh, sum(actual) AS total_kwh FROM clean GROUP BY 1),
flags AS (SELECT building_id, CAST(sum(is_anomaly) AS BIGINT) AS anomaly_count FROM scored WHERE meter = 0 AND {month(2)} GROUP BY 1)""")
        + f"""SELECT building_id, {", ".join(f"{r(c)} AS {c}" for c in ("current_kwh", "predicted_kwh", "average_kwh", "total_kwh"))}, anomaly_count,
  {r('total_kwh * 0.7')} AS co2_kg, {r('(current_kwh - predicted_kwh) / predicted_kwh * 100')} AS delta_percent FROM panel LEFT JOIN flags USING (building_id)""",
        "explain_target": with_(*FEATURED, SCORED, f"""in_month AS (SELECT *, ({COMPLETE}) AS whole FROM scored WHERE meter = 0 AND {month(2)}),
hit AS (SELECT building_id, min(timestamp) AS t FROM in_month WHERE is_anomaly = 1 GROUP BY 1),
best AS (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY (timestamp = t) DESC,
    CASE WHEN t IS NULL THEN meter_reading END DESC, timestamp) AS place FROM in_month LEFT JOIN hit USING (building_id) WHERE whole)""")
        + f"SELECT {_KEYS}, {r('meter_reading')} AS meter_reading, {r('rolling_mean_6hr')} AS rolling_mean_6hr FROM best WHERE place = 1",
        "impact_hourly": with_(*FORECAST, IMPACT, recursive=True) + f"""SELECT {_KEYS}, {r('predicted_kwh')} AS predicted_kwh,
  {r('hourly_cost')} AS hourly_cost, {r('hourly_carbon_kg')} AS hourly_carbon_kg FROM impact""",
        "impact_points": f"""SELECT l_orderkey, l_linenumber, l_partkey, {r('greatest(l_quantity - 10, 0.0)')} AS predicted_kwh,
  {r('greatest(l_quantity - 10, 0.0) * 12.5')} AS hourly_cost, {r('greatest(l_quantity - 10, 0.0) * 0.5')} AS hourly_carbon_kg FROM lineitem""",
        "impact_summary": with_(*FORECAST, IMPACT, _IMPACT_SUM, recursive=True) + f"SELECT {sum_cols} FROM impact_sum",
        "scenario_sweep": with_(*FORECAST, SWEEP, recursive=True) + f"""SELECT {_KEYS}, scenario_type, scenario_value, {", ".join(
            f"{r(c)} AS {c}" for c in ("baseline_kwh", "simulated_kwh", "delta_kwh", "delta_percent"))} FROM sweep""",
        "scenario_rejects": with_(*FORECAST, SWEEP, recursive=True) + """SELECT building_id, meter, scenario_type, scenario_value,
  'energy would fall below zero' AS reason FROM crossed GROUP BY 1, 2, 3, 4 HAVING min(simulated_kwh) < 0""",
        "scenario_summary": with_(*FORECAST, SWEEP, recursive=True) + "SELECT building_id, meter, scenario_type, scenario_value, " + ", ".join(
            f"{r(f'{s}_total_kwh')} AS {s}_total_kwh, {r(f'{s}_peak_kwh')} AS {s}_peak_kwh, {s}_peak_hour, "
            f"{r(f'{s}_total_kwh * 8.0')} AS {s}_total_cost, {r(f'{s}_total_kwh * 0.7')} AS {s}_total_carbon_kg"
            for s in ("baseline", "simulated")) + f""", {r('simulated_total_kwh - baseline_total_kwh')} AS delta_total_kwh,
  {r('(simulated_total_kwh - baseline_total_kwh) * 8.0')} AS delta_total_cost, {r('(simulated_total_kwh - baseline_total_kwh) * 0.7')} AS delta_total_carbon_kg,
  {r('CASE WHEN baseline_total_kwh > 0 THEN (simulated_total_kwh - baseline_total_kwh) / baseline_total_kwh * 100 ELSE 0.0 END')} AS delta_total_percent
  FROM sweep_sum""",
        "twin_state": with_(*STATE, recursive=True) + f"SELECT {_STATE_COLS} FROM states",
        "twin_state_json": with_(*STATE, recursive=True) + f"""SELECT building_id, meter, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp,
  {r('actual_kwh')} AS actual_kwh, severity, anomaly_type, {r('forecast_total_kwh')} AS forecast_total_kwh,
  strftime(forecast_peak_hour, '%Y-%m-%dT%H:%M:%S') AS forecast_peak_hour, state_status FROM states""",
        "twin_state_checks": with_(_CHECK_STATES) + """SELECT building_id, meter, timestamp, fault FROM (
  SELECT *, 'building_id is missing or negative' AS fault, building_id < 0 AS bad FROM candidates UNION ALL
  SELECT *, 'meter is missing or negative', meter < 0 FROM candidates UNION ALL
  SELECT *, 'timestamp is missing', timestamp IS NULL FROM candidates UNION ALL
  SELECT *, 'state_status is unknown', state_status = 'ODD' FROM candidates UNION ALL
  SELECT *, 'actual_kwh is not finite', NOT isfinite(actual_kwh) FROM candidates) WHERE bad""",
        "recommendations": _recommendations(),
        "recommendation_lists": f"""SELECT s.building_id, s.meter, s.timestamp, s.state_status, coalesce(l.ids, '') AS ids, coalesce(l.n, 0) AS total_count
  FROM ({with_(*STATE, recursive=True)} SELECT * FROM states) s LEFT JOIN (
    SELECT building_id, meter, string_agg(recommendation_id, ',' ORDER BY rank) AS ids, count(*) AS n FROM ({_recommendations()}) GROUP BY 1, 2) l
  ON s.building_id = l.building_id AND s.meter = l.meter""",
    }
