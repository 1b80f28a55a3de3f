"""Rule-based recommendations from state rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattfleet.functions.scalars import number
from wattfleet.schema import CATEGORIES, PRIORITY_RANK, SERIES_KEYS

# fixed values
COST_THRESHOLD = 10000.0
CARBON_THRESHOLD = 1000.0

# code, priority, category, title, action, reason; the order numbers the recommendations
RULES = [
    ("CRIT", "CRITICAL", "ANOMALY", "Critical reading",
     "Send someone to the meter's loads today.", "The severity of the latest reading is CRITICAL."),
    ("ANOM", "HIGH", "ANOMALY", "This hour is typed HIGH_DEMAND",
     "Compare the hour with the same weekday of earlier weeks and list what ran in addition.",
     "The reading lies over the warning ratio and neither a spike nor a streak explains it."),
    ("SPIKE", "HIGH", "ANOMALY", "This hour is typed RAPID_SPIKE",
     "Find out what was switched on within the last six hours.",
     "The reading lies over its six-hour mean by more than the spike ratio."),
    ("PERS", "HIGH", "OPERATIONS", "The type is PERSISTENT_HIGH",
     "Plot the run of flagged hours against the night level and see where it began.",
     "Flagged readings follow each other, or the day's mean is itself high."),
    ("LOW", "MEDIUM", "OPERATIONS", "Demand has dropped",
     "Ask for planned closures first, then test the sensor.",
     "The latest reading was typed LOW_DEMAND."),
    ("COST", "MEDIUM", "COST", "Tomorrow's bill is high",
     "List loads that can run at cheaper times.", "The 24-hour cost is over the limit given."),
    ("CARB", "MEDIUM", "CARBON", "Tomorrow's carbon is over its limit",
     "Rank the 24 hours by their kilograms and start with the largest.", "The sum of hourly kilograms is over the limit given."),
    ("SIM", "LOW", "ENERGY", "A what-if run saves energy or money",
     "Try its change on one day and compare.", "Its total of energy or cost is negative against the baseline."),
    ("NORM", "INFO", "ENERGY", "Nothing to do",
     "Look again with the next reading.", "No other rule fired and the state is NORMAL."),
]
assert all(r[1] in PRIORITY_RANK and r[2] in CATEGORIES for r in RULES)


def _evidence(cost: float, carbon: float) -> dict[str, Column]:
    num = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = F.format_string("actual %.1f kWh, expected %.1f kWh, deviation %+.1f%%",
                           num("actual_kwh"), num("expected_kwh"), num("deviation_ratio") * 100)
    when = F.concat(F.lit("Building "), F.col("building_id").cast("string"), F.lit(" at "),
                    F.col("timestamp").cast("string"), F.lit(": "), both)
    return {
        **{code: when for code in ("CRIT", "ANOM", "SPIKE", "PERS", "LOW", "NORM")},
        "COST": F.format_string("24-hour cost %,.2f over the threshold %,.2f", num("forecast_total_cost"), F.lit(cost)),
        "CARB": F.format_string("24-hour carbon %,.2f kg over the threshold %,.2f kg",
                                num("forecast_total_carbon_kg"), F.lit(carbon)),
        "SIM": F.format_string("%s at %s: %.1f kWh and %,.2f cost saved (estimate)",
                               F.coalesce("scenario_type", F.lit("SIMULATION")),
                               F.coalesce(F.col("scenario_value").cast("string"), F.lit("0.0")),
                               F.abs(num("delta_total_kwh")), F.abs(num("delta_total_cost"))),
    }


def _saves() -> Column:
    return (F.coalesce("delta_total_kwh", F.lit(0.0)) < 0) | (F.coalesce("delta_total_cost", F.lit(0.0)) < 0)


def _best_scenario(scenarios: DataFrame, fields: list[str]) -> DataFrame:
    """One row per series: a scenario that saves before one that does not, the largest saving first."""
    rank = F.struct(~_saves(), F.coalesce("delta_total_kwh", F.lit(0.0)), F.coalesce("delta_total_cost", F.lit(0.0)),
                    "scenario_type", "scenario_value")
    best = scenarios.groupBy(*SERIES_KEYS).agg(F.min_by(F.struct(*fields), rank).alias("__s"))
    return best.select(*SERIES_KEYS, *[F.col(f"__s.{c}").alias(c) for c in fields])


def recommendations(
    states: DataFrame, scenarios: DataFrame | None = None,
    cost_threshold: float = COST_THRESHOLD, carbon_threshold: float = CARBON_THRESHOLD,
) -> DataFrame:
    """Recommendations per state, most urgent first within ``rank``.

    Of several scenario summary rows of a series the one that saves most energy counts (then most
    cost, then the first type and value). Ids are numbered in rule order before sorting. A
    (category, title, action) occurs once per state.
    """
    cost = number(cost_threshold, "cost_threshold", 0.0)
    carbon = number(carbon_threshold, "carbon_threshold", 0.0)
    wanted = {"scenario_type": "string", "scenario_value": "double",
              "delta_total_kwh": "double", "delta_total_cost": "double"}
    if scenarios is None:
        rows = states.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items()})
    else:
        rows = states.join(_best_scenario(scenarios, list(wanted)), SERIES_KEYS, "left")
    kind = F.col("anomaly_type")
    fires = {
        "CRIT": F.col("severity") == "CRITICAL",
        "ANOM": kind == "HIGH_DEMAND", "SPIKE": kind == "RAPID_SPIKE",
        "PERS": kind == "PERSISTENT_HIGH", "LOW": kind == "LOW_DEMAND",
        "COST": F.col("forecast_total_cost") > cost, "CARB": F.col("forecast_total_carbon_kg") > carbon,
        "SIM": _saves(),
    }
    any_fired = F.greatest(*[F.coalesce(c, F.lit(False)) for c in fires.values()])
    fires["NORM"] = (F.col("state_status") == "NORMAL") & ~any_fired
    evidence = _evidence(cost, carbon)
    rule = lambda r: F.when(fires[r[0]], F.struct(
        F.lit(PRIORITY_RANK[r[1]]).alias("priority_rank"), F.lit(r[0]).alias("code"), F.lit(r[1]).alias("priority"),
        F.lit(r[2]).alias("category"), F.lit(r[3]).alias("title"), F.lit(r[4]).alias("action"),
        F.lit(r[5]).alias("reason"), evidence[r[0]].alias("evidence")))
    fired = F.filter(F.array(*[rule(r) for r in RULES]), lambda x: x.isNotNull())
    numbered = F.transform(fired, lambda x, i: F.struct(
        x["priority_rank"].alias("priority_rank"), (i + 1).alias("number"),
        F.format_string("REC-%s-%03d", x["code"], i + 1).alias("recommendation_id"),
        *[x[c].alias(c) for c in ("code", "priority", "category", "title", "action", "reason", "evidence")]))
    same = lambda a, b: (a["category"] == b["category"]) & (a["title"] == b["title"]) & (a["action"] == b["action"])
    once = F.aggregate(
        F.array_sort(numbered), F.slice(numbered, 1, 0),
        lambda kept, x: F.when(F.exists(kept, lambda k: same(k, x)), kept).otherwise(F.concat(kept, F.array(x))))
    return (
        rows.select(*SERIES_KEYS, "timestamp", "state_status", F.posexplode(once).alias("place", "r"))
        .select(*SERIES_KEYS, "timestamp", "state_status", (F.col("place") + 1).cast("long").alias("rank"), "r.*")
        .withColumns({"priority_rank": F.col("priority_rank").cast("long"), "number": F.col("number").cast("long")})
    )


def recommendation_lists(states: DataFrame, recs: DataFrame, stamp: bool = True) -> DataFrame:
    """One row per state (series and time): its ordered list of recommendations and their number (at most nine)."""
    item = F.struct("rank", "recommendation_id", "priority", "category", "title", "action", "reason", "evidence")
    keys = [*SERIES_KEYS, "timestamp"]
    lists = recs.groupBy(*[F.col(c).alias(f"__r_{c}") for c in keys]).agg(
        F.array_sort(F.collect_list(item)).alias("recommendations"))
    same = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in keys]
    out = states.select(*keys, "state_status").join(lists, same, "left").drop(*[f"__r_{c}" for c in keys]).withColumns({
        "recommendations": F.coalesce("recommendations", F.array().cast(lists.schema["recommendations"].dataType)),
    }).withColumn("total_count", F.size("recommendations").cast("long"))
    return out.withColumn("generated_at", F.current_timestamp()) if stamp else out
