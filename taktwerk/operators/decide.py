"""From an inferred constraint to an action, a job and a chained record of it, as ordered rules over columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of actions and priorities, owners, response times and what is asked back.
INSPECT, QUALITY, SUPPLY, MONITOR, ESCALATE = "INSPECT_STATION", "TARGETED_QUALITY_CHECK", "CHECK_INBOUND_MATERIAL", "MONITOR", "ESCALATE_AMBIGUOUS"
OWNERS = {INSPECT: "Maintenance technician (line-side)", QUALITY: "Quality technician", SUPPLY: "Material handler / logistics lead", MONITOR: "Shift supervisor (watch only)", ESCALATE: "Shift supervisor + process engineer"}
RESPONSE_MIN = {"HIGH": 15, "MEDIUM": 60, "LOW": 240}
STATE_TAXONOMY = {"NORMAL": "ALLOW", "RECOVERING": "ALLOW", "DEGRADING": "WATCH", "WATCH": "WATCH", "PREDICTED": "INVESTIGATE", "ACTIVE": "INVESTIGATE"}
VERIFY = {INSPECT: "condition found", QUALITY: "predicted defect found", SUPPLY: "material flowing"}


@dataclass(frozen=True)
class Limits:
    """When a station is named and when a job is urgent."""

    min_confidence: float = 0.45
    high_confidence: float = 0.75
    min_units: float = 1.5
    high_units: float = 4.0
    supply: float = 0.25
    max_named: int = 3
    head_of_line: int = 1
    upstream_blocking: float = 0.04


def lookup(key: Column, table: dict[str, object], default: object = None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def flow_recommendation(alerts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``alerts`` with action, priority, abstained, n_targets and taxonomy.

    Needs top_station, group_prob, group_size, confident, p_supply, upstream_blocked (largest blocking of the nearest observed stations before it, null if there is none),
    binding and units_lost (null without forecast). The first rule that holds decides: head of line without blocking before it, late supply, ambiguous, inside takt, small, inspect.
    """
    c = F.col
    head = (c("top_station") <= limits.head_of_line) & (F.coalesce(c("upstream_blocked"), F.lit(-1.0)) < limits.upstream_blocking)
    supply, vague = c("p_supply") >= limits.supply, ~c("confident") | (c("group_prob") < limits.min_confidence)
    idle = F.coalesce(~c("binding"), F.lit(False))
    small = F.coalesce(c("units_lost") < limits.min_units, F.lit(False))
    urgent = (c("group_prob") >= limits.high_confidence) & (F.coalesce(c("units_lost"), F.lit(0.0)) >= limits.high_units)
    pick = lambda a, b, v, m, i: F.when(head, a).when(supply, b).when(vague, v).when(idle | small, m).otherwise(i)
    action = pick(F.lit(SUPPLY), F.lit(SUPPLY), F.lit(ESCALATE), F.lit(MONITOR), F.lit(INSPECT))
    priority = pick(F.lit("MEDIUM"), F.lit("MEDIUM"), F.lit("LOW"), F.lit("LOW"), F.when(urgent, "HIGH").otherwise("MEDIUM"))
    targets = pick(c("group_size"), F.lit(0), c("group_size"), c("group_size"), F.least(c("group_size"), F.lit(limits.max_named)))
    d = alerts.withColumns({"action": action, "priority": priority, "abstained": head | (~supply & vague), "n_targets": targets.cast("int")})
    return d.withColumn("taxonomy", taxonomy(c("action"), c("abstained")))


def taxonomy(action: Column, abstained: Column) -> Column:
    return F.when(abstained & (action == ESCALATE), "ESCALATE").when(abstained, "ABSTAIN").when(action == MONITOR, "WATCH").when(action.isin(INSPECT, QUALITY, SUPPLY), "INVESTIGATE").otherwise("ALLOW")


def quality_recommendation(ranked: DataFrame, least_m: float = 1.8) -> DataFrame:
    """``ranked`` (station, m_hat, rank, at_risk) with action, priority and abstained: a targeted check for ranks 1 to 3 with a rate of ``least_m`` or more."""
    weak = (F.col("rank") > 3) | (F.col("m_hat") < least_m)
    priority = F.when(weak, "LOW").when((F.col("at_risk") >= 3) & (F.col("rank") == 1), "HIGH").otherwise("MEDIUM")
    return ranked.withColumns({"action": F.when(weak, ESCALATE).otherwise(QUALITY), "priority": priority, "abstained": weak, "confidence": 1.0 / F.greatest(F.lit(1), F.col("rank"))})


def waiting_cost(df: DataFrame, minutes: float = 120.0, horizon_min: float = 60.0, small: float = 2.0) -> DataFrame:
    """``df`` (binding, units_lost over the horizon) with units_per_hour, units_if_deferred and defer_is_reasonable; null where nothing binds."""
    per_hour = F.when(F.col("binding"), F.col("units_lost") * (60.0 / horizon_min))
    lost = per_hour * (minutes / 60.0)
    return df.withColumns({"units_per_hour": per_hour, "units_if_deferred": lost, "defer_is_reasonable": lost < small})


def work_orders(recommended: DataFrame) -> DataFrame:
    """One job a recommendation but for those to monitor, which raise none: owner, minutes to respond, escalation and what is asked back. An abstention has 240 minutes at least."""
    d = recommended.where(F.col("action") != MONITOR)
    within = lookup(F.col("priority"), RESPONSE_MIN, 60)
    within = F.when(F.col("abstained"), F.greatest(within, F.lit(RESPONSE_MIN["LOW"]))).otherwise(within)
    d = d.withColumns({"owner": lookup(F.col("action"), OWNERS, "Shift supervisor"), "respond_min": within, "verify": lookup(F.col("action"), VERIFY, "anything observed")})
    return d.withColumns({"escalate_min": F.col("respond_min") * 2, "escalate_to": F.when(F.col("priority") == "HIGH", "Process engineer").otherwise("Shift supervisor")})


def chained(rows: DataFrame, keys: list[str], order: str, body: str, genesis: str) -> DataFrame:
    """``rows`` of (keys, order, body) with prev_hash and entry_hash: each entry's SHA-256 covers the hash before it and its own content. One fold a chain."""
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(body).alias("body"))))
    step = lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat(F.element_at(acc, -1), x["body"]), 256)))
    chains = rows.groupBy(*keys).agg(items.alias("items")).withColumn("hashes", F.aggregate("items", F.array(F.lit(genesis)), step))
    d = chains.select(*keys, "hashes", F.posexplode("items").alias("i", "item"))
    return d.select(*keys, F.col("item.at").alias(order), F.col("item.body").alias(body), F.col("hashes")[F.col("i")].alias("prev_hash"), F.col("hashes")[F.col("i") + 1].alias("entry_hash"))
