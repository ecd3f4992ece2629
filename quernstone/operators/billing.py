"""Entitlements through parents, and subscriptions folded from provider events."""

from __future__ import annotations

import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: States of a subscription that grant its tier, and those that end it.
LIVE, ENDED = ("active", "trialing", "past_due"), ("cancelled", "expired", "completed")


def entitlements(users: DataFrame, subscriptions: DataFrame, now: Column, grace_days: int = 3) -> DataFrame:
    """user, tier, expires of users(user, account_type, parent, tier): a child is entitled by its parent's live subscription, the one
    updated last. It runs to the end of the period or of the trial; past due to the end of the grace since then, if that is sooner;
    without a subscription, or without an end, to the end of a grace from now. The free tier ends now.

    subscriptions: user, status, period_end, trial_end, past_due_since, updated_at. Several updated at once: the latest end."""
    grace = F.make_dt_interval(days=F.lit(grace_days))
    columns = ("updated_at", "period_end", "trial_end", "past_due_since", "status")
    live = subscriptions.filter(F.col("status").isin(*LIVE)).groupBy(F.col("user").alias("anchor")).agg(F.max(F.struct(*columns)).alias("s"))
    anchor = F.when((F.col("account_type") == "child") & F.col("parent").isNotNull(), F.col("parent")).otherwise(F.col("user"))
    rows = users.withColumn("anchor", anchor).join(live, "anchor", "left")
    end = F.coalesce("s.period_end", "s.trial_end")
    dunning = F.coalesce("s.past_due_since", now) + grace
    paid = F.when(F.col("s.status") == "past_due", F.least(F.coalesce(end, dunning), dunning)).otherwise(end)
    free = F.coalesce(F.col("tier"), F.lit("free")) == "free"
    return rows.select("user", F.when(free, "free").otherwise(F.col("tier")).alias("tier"), F.when(free, now).otherwise(F.coalesce(paid, now + grace)).alias("expires"))


SETTLED = "user {user}, event {event}, handled boolean, reason string, status string, tier string"


def settled(events: DataFrame, intents: DataFrame) -> DataFrame:
    """user, event, handled, reason, status, tier: what each provider event does, in order of at, and what the user's subscription is after it.

    events: event, at, ref (of the provider's subscription), intent, user, status (null: as the intent says), from_client, pays_only.
    intents: intent, user, ref, status (pending, paid, failed, expired), tier, trial_days.
    An event belongs to the user of its intent, else of the intent that was issued for its ref, else to the one it names; without any it is unhandled
    (unresolved). It updates the subscription of its ref; one that has none needs an intent that is pending, by id or the user's
    last one. A settled intent opens nothing (intent_<status>), only an expired one does, and only for a provider's event that names its own
    ref. A user has one live subscription; an ending event for one that never began settles the intent alone. Payments
    do not revive what has ended. A user's history goes to one task and is a person's, hundreds of events."""
    known = intents.filter("user is not null")
    by_id = known.groupBy("intent").agg(F.min("user").alias("_by_intent"))
    by_ref = known.filter("ref is not null").groupBy("ref").agg(F.min("user").alias("_by_ref"))
    rows = events.join(by_id, "intent", "left").join(by_ref, "ref", "left").withColumn("owner", F.coalesce("_by_intent", "_by_ref", "user"))
    kinds = dict(events.dtypes)
    schema = SETTLED.format(user=kinds["user"], event=kinds["event"])
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    lost = rows.filter("owner is null").select(F.lit(None).cast(kinds["user"]).alias("user"), "event", F.lit(False).alias("handled"), F.lit("unresolved").alias("reason"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("tier"))

    def fold(user: tuple, mine: pa.Table, offers: pa.Table) -> pa.Table:
        open_ = {r["intent"]: dict(r) for r in sorted(offers.to_pylist(), key=lambda r: str(r["intent"]))}
        subs: dict[str, dict] = {}
        out: dict[str, list] = {name: [] for name in arrow.names}
        for e in sorted(mine.to_pylist(), key=lambda r: (r["at"] or datetime.datetime.min, str(r["event"]))):
            handled, reason = _apply(e, open_, subs)
            live = next((s for s in subs.values() if s["status"] in LIVE), None)
            shown = subs.get(e["ref"]) or live or {}
            values = (user[0].as_py(), e["event"], handled, reason, shown.get("status"), live["tier"] if live else "free")
            for column, v in zip(out.values(), values, strict=True):
                column.append(v)
        return pa.table(out, schema=arrow)

    left = rows.filter("owner is not null").select(F.col("owner").alias("_u"), "event", "at", "ref", "intent", "status", "from_client", "pays_only")
    right = known.select(F.col("user").alias("_u"), "intent", "ref", "status", "tier", "trial_days")
    return left.groupBy("_u").cogroup(right.groupBy("_u")).applyInArrow(fold, schema).unionByName(lost)


def _apply(e: dict, intents: dict, subs: dict[str, dict]) -> tuple[bool, str | None]:
    sub = subs.get(e["ref"]) if e["ref"] else None
    if sub:
        if sub["status"] in ENDED and (e["pays_only"] or e["status"] in LIVE):
            return False, "ended"
        sub["status"] = e["status"] or sub["status"]
        return True, None
    offer = intents.get(e["intent"]) or next((i for i in reversed(intents.values()) if i["status"] == "pending"), None)
    if offer is None and e["ref"]:
        offer = next((i for i in intents.values() if i["ref"] == e["ref"]), None)
    if offer is None:
        return False, "unresolved"
    late = not e["from_client"] and offer["status"] == "expired" and e["ref"] and offer["ref"] == e["ref"]
    if offer["status"] != "pending" and not late:
        return False, f"intent_{offer['status']}"
    if any(s["status"] in LIVE for s in subs.values()):
        return False, "has_live_subscription"
    if e["status"] in ENDED:
        offer["status"] = "failed"
        return True, "intent_failed"
    offer["status"] = "paid"
    subs[e["ref"] or f"intent:{offer['intent']}"] = {"status": e["status"] or ("trialing" if (offer["trial_days"] or 0) > 0 else "active"), "tier": offer["tier"]}
    return True, None
