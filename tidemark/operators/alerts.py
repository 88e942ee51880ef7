"""Alerts and subscriptions: rule evaluation, escalation, flapping, state over ticks, event matching."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import at, half_even, seconds_before
from tidemark.operators.latest import drop_known
from tidemark.operators.ordered import latest_before, placed_in_order, previous_in_key


def evaluate_rules(rules: DataFrame, current: DataFrame, previous: DataFrame) -> DataFrame:
    """Rules against metric values now and one window ago.

    rules: alert_id, tenant_id, metric, window, condition, threshold; current and previous: the metric matrix.
    A change from zero is undefined: it fires by direction.
    """
    keys = ["tenant_id", "metric", "window"]
    now = current.select(*keys, F.col("value").alias("cur"))
    before = previous.select(*keys, F.col("value").alias("prev"))
    zero = F.lit(0.0)
    joined = rules.join(now, keys, "left").join(before, keys, "left").withColumns(
        {"cur": F.coalesce("cur", zero), "prev": F.coalesce("prev", zero)})
    change = F.when(F.col("prev") != 0, (F.col("cur") - F.col("prev")) / F.abs("prev") * 100.0).when(F.col("cur") == 0, 0.0)
    limit = F.col("threshold")
    reached = F.when(limit >= 0, F.col("change") >= limit).otherwise(F.col("change") <= limit)
    direction = F.when(limit >= 0, F.col("cur") > 0).otherwise(F.col("cur") < 0)
    relative = F.col("condition") == "change_pct"
    fired = (F.when(F.col("condition") == "above", F.col("cur") > limit).when(F.col("condition") == "below", F.col("cur") < limit)
             .when(F.col("change").isNotNull(), reached).otherwise(direction))
    return joined.withColumn("change", F.when(relative, change)).select(
        "alert_id", *keys, "condition", "threshold", fired.alias("triggered"), half_even("cur", 4).alias("current_value"),
        half_even(F.when(relative, F.col("prev")), 4).alias("previous_value"), half_even("change", 4).alias("change_pct"))


def due_steps(alerts: DataFrame, as_of: datetime) -> DataFrame:
    """Next escalation step of each firing alert: the lowest level above the reached one whose delay has passed.

    An alert with a single step repeats it after its cooldown. `escalation` is array<struct<level, after_minutes>>.
    """
    minutes = lambda c: (F.unix_micros(at(as_of)) - F.unix_micros(F.col(c))) / 60e6
    due = F.filter("escalation", lambda s: (s["level"] > F.col("last_escalation_level")) & (F.col("_elapsed") >= s["after_minutes"]))
    lowest = F.array_min(F.transform("_due", lambda s: s["level"]))
    only = F.get("escalation", F.lit(0))
    cooled = F.col("last_triggered_at").isNull() | (minutes("last_triggered_at") >= F.col("cooldown_minutes"))
    repeat = (F.size("escalation") == 1) & (F.col("last_escalation_level") == only["level"]) & cooled
    rows = alerts.filter(F.col("fired_at").isNotNull()).withColumn("_elapsed", minutes("fired_at")).withColumn("_due", due)
    level = F.when(F.size("_due") > 0, lowest).when(repeat, only["level"])
    return rows.withColumn("next_level", level).filter(F.col("next_level").isNotNull()).drop("_elapsed", "_due")


def flap_counts(ticks: DataFrame, window_minutes: int, max_changes: int) -> DataFrame:
    """Per tick, state changes of its alert within the last minutes, and whether that suppresses it.

    Previous states come from range-placed rows. The count needs only one window of the past, so ticks are cut
    into time slices, each with the window before it as a halo; no slice grows with an alert's history.
    """
    micros = window_minutes * 60_000_000
    slice_micros = max(micros * 16, 3_600_000_000)
    rows = previous_in_key(ticks, ["alert_id"], ["tick_at"], ["triggered"])
    changed = F.coalesce(F.col("triggered") != F.col("prev.triggered"), F.col("triggered"))
    rows = rows.withColumn("changed", changed.cast("int")).drop("prev").withColumn("_t", F.unix_micros("tick_at"))
    home = F.floor(F.col("_t") / slice_micros)
    near_end = (home + 1) * slice_micros - F.col("_t") <= micros
    rows = rows.withColumn("_home", home).withColumn("_slice", F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))))
    last = Window.partitionBy("alert_id", "_slice").orderBy("_t").rangeBetween(-micros, 0)
    counted = rows.withColumn("changes", F.sum("changed").over(last)).filter(F.col("_slice") == F.col("_home"))
    return counted.select("alert_id", "tick_at", "triggered", "changes", (F.col("changes") > max_changes).alias("suppressed"))


STATE_COLUMNS = ["alert_id", "tick_at", "triggered", "state", "notification", "level", "fired_at", "changes"]
STATE_DDL = ("alert_id string, tick_at timestamp, triggered boolean, state string, notification string, level int, "
             "fired_at timestamp, changes int")


class AlertMachine:
    """State of one alert between ticks. Deliveries are taken as successful."""

    def __init__(self, rule: dict):
        self.steps = sorted((int(s["level"]), float(s["after_minutes"])) for s in rule["escalation"]) or [(1, 0.0)]
        self.flap = (float(rule["flap_minutes"]), int(rule["flap_max"])) if rule["flap_enabled"] else None
        self.cooldown = float(rule["cooldown_minutes"])
        self.state, self.fired_at, self.level, self.last_at = "ok", None, 0, None
        self.last_on, self.changes = False, []

    def _minutes(self, now, then) -> float:
        return (now - then).total_seconds() / 60.0

    def _next_level(self, now):
        elapsed = self._minutes(now, self.fired_at)
        ready = [level for level, after in self.steps if level > self.level and elapsed >= after]
        if ready:
            return min(ready)
        cooled = self.last_at is None or self._minutes(now, self.last_at) >= self.cooldown
        return self.steps[0][0] if len(self.steps) == 1 and self.level == self.steps[0][0] and cooled else None

    def tick(self, now, on: bool) -> str | None:
        """Advance to `now`; returns the notification to send, if any."""
        if self.flap:
            self.changes = [c for c in self.changes if self._minutes(now, c) <= self.flap[0]]
        if self.state == "suppressed" and (not self.flap or len(self.changes) <= self.flap[1]):
            self.state, self.fired_at, self.level, self.last_on = "ok", None, 0, False
        if on != self.last_on and self.flap:
            self.changes.append(now)
            if len(self.changes) > self.flap[1]:
                self.state, self.fired_at, self.level = "suppressed", None, 0
        self.last_on = on
        if self.state == "suppressed":
            return None
        if on and self.fired_at is None:
            self.state, self.fired_at, self.level, self.last_at = "firing", now, 1, now
            return "firing"
        if on:
            self.state = "sustained"
            step = self._next_level(now)
            if step is None:
                return None
            note = "escalated" if step > self.level else "sustained"
            self.last_at, self.level = now, max(self.level, step)
            return note
        if self.fired_at is not None:
            self.state, self.fired_at, self.level, self.last_at = "resolved", None, 0, now
            return "resolved"
        if self.state == "resolved":
            self.state = "ok"
        return None


RULE_FIELDS = ("escalation", "flap_enabled", "flap_minutes", "flap_max", "cooldown_minutes")


def advance(machines: dict, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Feed (alert_id, tick_at, triggered, rule...) rows, in tick order per alert, to their machines."""
    for alert_id, tick_at, triggered, *rule in rows:
        machine = machines.get(alert_id)
        if machine is None:
            machine = machines[alert_id] = AlertMachine(dict(zip(RULE_FIELDS, rule, strict=True)))
        note = machine.tick(tick_at, bool(triggered))
        yield (alert_id, tick_at, bool(triggered), machine.state, note, machine.level, machine.fired_at, len(machine.changes))


def quiet_segments(ticks: DataFrame) -> DataFrame:
    """`ticks` with `segment`: the last tick before it at which the machine of its alert was as new.

    It is so at a tick without condition if there was one before it in the same pause, and the pause began longer ago than
    changes are counted: what has fired is resolved, changes are forgotten, a suppressed alert is awake again. An alert that
    never pauses is one segment.
    """
    key, order = ["alert_id"], ["tick_at"]
    rows = previous_in_key(ticks, key, order, ["triggered"])
    begins = F.when(~F.col("triggered") & F.coalesce(F.col("prev.triggered"), F.lit(True)), F.col("tick_at"))
    placed = placed_in_order(rows.withColumn("_begins", begins).drop("prev"), key, order)
    paused = latest_before(placed, key, order, F.col("_begins"), "_since", True)
    forgotten = ~F.col("flap_enabled") | (F.unix_micros("tick_at") - F.unix_micros("_since") > F.col("flap_minutes") * 60e6)
    quiet = ~F.col("triggered") & (F.col("tick_at") > F.col("_since")) & forgotten
    return latest_before(paused, key, order, F.when(quiet, F.col("tick_at")), "segment", False).drop("_begins", "_since", "_part")


def alert_states(ticks: DataFrame) -> DataFrame:
    """State after every tick of every alert.

    The history of an alert falls apart at its quiet ticks, and its segments run in tasks of their own, each with a new machine.
    Ticks of a segment arrive sorted as a stream of Arrow batches: memory holds one machine, not the history.
    """
    columns = ["alert_id", "tick_at", "triggered", *RULE_FIELDS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machines: dict = {}
        for batch in batches:
            out = []
            named = batch[columns].assign(alert_id=list(zip(batch["alert_id"], batch["segment"].astype(str), strict=True)))
            for key, *row in advance(machines, named.itertuples(index=False, name=None)):
                # in place, as the loop goes on with this very dictionary
                for other in [k for k in machines if k != key]:
                    del machines[other]
                out.append((key[0], *row))
            yield pd.DataFrame(out, columns=STATE_COLUMNS)

    ordered = quiet_segments(ticks.select(*columns)).repartition("alert_id", "segment").sortWithinPartitions("alert_id", "segment", "tick_at")
    return ordered.mapInPandas(run, STATE_DDL)


# --- subscriptions ---------------------------------------------------------------------------------

ID_COLUMNS = ("entity_id", "order_id", "user_id", "product_id", "session_id")  # fixed: ids a filter may name


def matches(event: str = "e", hook: str = "s", ids: tuple[str, ...] = ID_COLUMNS) -> Column:
    """Filter of a subscription: type equal or dotted prefix, any id listed, least amount (order events only)."""
    kind = F.col(f"{event}.event_type")
    types, wanted, least = F.col(f"{hook}.event_types"), F.col(f"{hook}.entity_ids"), F.col(f"{hook}.min_amount")
    none = lambda c: c.isNull() | (F.size(c) == 0)
    by_type = none(types) | F.exists(types, lambda t: (kind == t) | kind.startswith(F.concat(t, F.lit("."))))
    by_id = none(wanted) | F.arrays_overlap(wanted, F.array(*[F.coalesce(F.col(f"{event}.{c}"), F.lit("")) for c in ids]))
    by_amount = least.isNull() | (kind.startswith("order") & F.coalesce(F.col(f"{event}.amount") >= least, F.lit(False)))
    return by_type & by_id & by_amount


def hook_atoms(hooks: DataFrame) -> DataFrame:
    """One row for each atom of a hook: a value that an event must have for the hook to match it.

    Ids name the fewest events, so they are the atoms of a hook that lists any; else its event types; else one atom for all events.
    """
    some = lambda c: F.size(F.coalesce(F.col(c), F.array())) > 0
    atoms = lambda kind, values: F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    listed = (F.when(some("entity_ids"), atoms("id", F.col("entity_ids"))).when(some("event_types"), atoms("type", F.col("event_types")))
              .otherwise(atoms("any", F.array(F.lit("")))))
    return hooks.withColumn("atom", F.explode(listed))


def event_atoms(ids: tuple[str, ...]) -> Column:
    """The values under which an event is looked up: its ids, its type and every dotted prefix of that, and the one all have."""
    named = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    parts = F.split("event_type", "[.]")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    own = F.array_distinct(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in ids]))
    typed = F.when(F.col("event_type").isNotNull(), F.array_distinct(prefixes)).otherwise(F.array().cast("array<string>"))
    return F.concat(named("id", own), named("type", typed), named("any", F.array(F.lit(""))))


FEW_ATOMS = 100_000


def match_subscriptions(events: DataFrame, hooks: DataFrame, ids: tuple[str, ...] = ("entity_id",), salts: int = 64, few: int = FEW_ATOMS) -> DataFrame:
    """(webhook_id, event_id) of all matches, once each.

    Hooks are indexed by atoms; an event meets only hooks that share one with it, and the whole filter is checked on those. A
    pair that shares several is taken at the hook's first one. Up to `few` atoms go to every task, and events do not move. More
    are dealt with the events by tenant, atom and salt: a tenant or type with most events, or most hooks, is spread over `salts`.
    """
    wanted = ["tenant_id", "event_types", "entity_ids", "min_amount", "webhook_id"]
    atoms = hook_atoms(hooks.select(*wanted))
    elements = F.size(F.coalesce("event_types", F.array())) + F.size(F.coalesce("entity_ids", F.array())) + 1
    size = atoms.agg(F.sum(elements).alias("n")).first()["n"] or 0
    probes = events.withColumn("_atom", F.explode(event_atoms(ids)))
    same = (F.col("e.tenant_id") == F.col("s.tenant_id")) & (F.col("e._atom.kind") == F.col("s.atom.kind")) & (F.col("e._atom.value") == F.col("s.atom.value"))
    if size <= few:
        joined = probes.alias("e").join(F.broadcast(atoms).alias("s"), same & matches(ids=ids))
    else:
        probes = probes.withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int"))
        atoms = atoms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = probes.alias("e").join(atoms.alias("s"), same & (F.col("e._salt") == F.col("s._salt")) & matches(ids=ids))
    kind = F.col("e.event_type")
    own = F.array(*[F.coalesce(F.col(f"e.{c}"), F.lit("")) for c in ids])
    first = (F.when(F.col("s.atom.kind") == "id", F.get(F.filter("s.entity_ids", lambda i: F.array_contains(own, i)), F.lit(0)))
             .when(F.col("s.atom.kind") == "type", F.get(F.filter("s.event_types", lambda x: (kind == x) | kind.startswith(F.concat(x, F.lit(".")))), F.lit(0))).otherwise(""))
    return joined.filter(F.col("s.atom.value") == first).select("s.webhook_id", "e.tenant_id", "e.event_id", "e.event_type", "e.processed_at")


def settle_violations(journal: DataFrame, delivered: DataFrame, frontier: tuple[datetime, str], band_seconds: int) -> DataFrame:
    """Rows strictly behind the delivery frontier, inside a band before it, that were never handed out."""
    ts, event_id = frontier
    behind = journal.filter((F.col("processed_at") >= seconds_before(at(ts), band_seconds)) & (
        (F.col("processed_at") < at(ts)) | ((F.col("processed_at") == at(ts)) & (F.col("event_id") < event_id))))
    return drop_known(behind, delivered, ["tenant_id", "event_id"])
