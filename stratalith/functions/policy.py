"""Activation, promotion and expiry as aggregates over an association table and predicates over its results.

``associations`` has ``item_id, session_id, turn, at, weight, verified`` and, if given, ``workspace_turn``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalith.config import Config

#: Kinds of record that may enter the bank (fixed values).
STABLE_TYPES = ("preference", "commitment", "decision", "verified-fact", "workflow", "project-constraint")


def distinct_uses(associations: DataFrame) -> DataFrame:
    """One use per item, session and turn, the earliest; a use without a turn is refused."""
    keys = ["item_id", "session_id", "turn"]
    rest = [c for c in associations.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(F.col("at"), F.xxhash64(*rest)))
    return associations.filter("turn is not null").groupBy(*keys).agg(first.alias("u")).select(*keys, "u.*")


def hours(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3.6e9


def activation(now: Column, turn: Column) -> Column:
    """Aggregate: ln of the sum of weight * (1 + turns)^-0.5 * 2^(-hours / 24); minus infinity for 0."""
    weight = F.greatest(F.lit(0.0), F.coalesce("weight", F.lit(0.0)).cast("double"))
    turns = F.greatest(F.lit(0.0), F.coalesce(turn - F.col("turn"), F.lit(0)).cast("double"))
    age = F.greatest(F.lit(0.0), F.coalesce(hours(now, F.col("at")), F.lit(0.0)))
    total = F.sum(F.when(weight > 0, weight * F.pow(1 + turns, F.lit(-0.5)) * F.pow(F.lit(2.0), -age / 24)).otherwise(0.0))
    return F.when(total > 0, F.log(total)).otherwise(F.lit(float("-inf")))


def use_facts(uses: DataFrame, now: Column, turn: Column, config: Config = Config()) -> DataFrame:
    """Per item: activation, strong uses within the turn window and in all, sessions, last turn and time."""
    strong = F.coalesce("verified", F.lit(True)) & (F.coalesce("weight", F.lit(0.0)) > 0)
    near = F.coalesce(turn - F.col("turn"), F.lit(0)) <= config.semi_association_turns
    return uses.groupBy("item_id").agg(
        activation(now, turn).alias("activation"),
        F.count_if(strong & near).alias("strong_recent"),
        F.count_if(strong).alias("strong"),
        F.countDistinct(F.when(strong, F.col("session_id"))).alias("sessions"),
        F.max("turn").alias("last_turn"),
        F.max("at").alias("last_at"),
    )


def to_sensory(sealed: Column, open_task: Column, pinned: Column, pressure: Column) -> Column:
    return sealed.isNotNull() & ~F.coalesce(open_task, F.lit(False)) & ~F.coalesce(pinned, F.lit(False)) & pressure


def to_semi(verified: Column, quality: Column, durability: Column, importance: Column, strong_recent: Column, config: Config = Config()) -> Column:
    used = (F.coalesce(strong_recent, F.lit(0)) >= config.semi_association_count) | (importance >= config.semi_importance)
    return F.coalesce(verified & (quality >= config.evidence_quality_threshold) & (durability >= config.semi_durability) & used, F.lit(False))


def to_bank(verified: Column, kind: Column, strong: Column, sessions: Column, importance: Column, durability: Column, approved: Column, config: Config = Config()) -> Column:
    used = (F.coalesce(strong, F.lit(0)) >= config.bank_association_count) & (F.coalesce(sessions, F.lit(0)) >= config.bank_session_count)
    weighty = (importance >= config.bank_importance) & (durability >= config.bank_durability) & F.coalesce(approved, F.lit(False))
    return F.coalesce(verified & kind.isin(*STABLE_TYPES) & (used | weighty), F.lit(False))


def expires(pinned: Column, open_task: Column, turns: Column, idle_hours: Column, level: Column, config: Config = Config()) -> Column:
    idle = (turns >= config.semi_inactive_turns) | (idle_hours >= config.semi_inactive_hours)
    kept = F.coalesce(pinned, F.lit(False)) | F.coalesce(open_task, F.lit(False))
    return ~kept & F.coalesce(idle, F.lit(False)) & (F.coalesce(level, F.lit(float("-inf"))) < config.semi_activation_floor)
