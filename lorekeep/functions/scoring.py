"""Scores of memories as column expressions: value, decay, modulation, bounds, credit."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the value score, its decay shapes and the modulation.
WEIGHTS = {"reliability": 0.15, "user": 0.15, "task": 0.25, "usage": 0.20, "recency": 0.15, "surprise": 0.10}
DECAY_SHAPES = {
    "warning": 0.5, "guardrail": 0.5, "profile": 0.4, "preference": 0.5, "peer_card": 0.6, "strategy": 0.7,
    "case": 0.7, "insight": 0.7, "fact": 0.85, "decision": 1.0, "event": 1.3, "request": 1.5,
}
#: Shape and scale (hours) of the hour-scaled survival curve by memory type.
WEIBULL_HOURS = {
    "profile": (0.3, 8760.0), "preference": (0.4, 4380.0), "relationship": (0.35, 8760.0), "learning": (0.7, 1440.0),
    "fact": (0.8, 720.0), "entity": (0.5, 4380.0), "setup": (0.6, 2160.0), "pattern": (0.6, 1680.0),
    "context": (0.85, 360.0), "observation": (0.9, 480.0), "artifact": (0.75, 2160.0), "project": (0.85, 1080.0),
    "goal": (0.9, 720.0), "decision": (1.0, 336.0), "commitment": (1.0, 240.0), "event": (1.2, 168.0),
    "instruction": (0.9, 480.0), "error": (1.1, 336.0), "issue": (1.1, 336.0), "request": (1.5, 72.0),
}
UNKNOWN_TYPE_HOURS = 168.0
TRUST_ORDER = ("owner", "agent", "known_user", "tool", "untrusted")
Z95 = 1.959963984540054


def by_key(key: Column, values: dict, default) -> Column:
    """A lookup in a small fixed table as one ``case``."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def age_days(since: Column, now: Column) -> Column:
    """Days from ``since`` to ``now``, never below 0, 0 where unknown."""
    micros = F.unix_micros(now) - F.unix_micros(since)
    return F.coalesce(F.greatest(F.lit(0.0), micros / F.lit(86400e6)), F.lit(0.0))


def halflife_survival(age: Column, half_life: Column, shape: Column) -> Column:
    """exp(-(t / (H / ln 2))^k): half is left at the half-life for every shape."""
    return F.exp(-F.pow(age / (half_life / math.log(2)), shape))


def weibull_hours(age_hours: Column, kind: Column) -> Column:
    """Survival by memory type; unknown types decay exponentially, ages below 0 count as fresh."""
    shape = by_key(kind, {k: v[0] for k, v in WEIBULL_HOURS.items()}, 1.0)
    scale = by_key(kind, {k: v[1] for k, v in WEIBULL_HOURS.items()}, UNKNOWN_TYPE_HOURS)
    return F.when(age_hours <= 0, F.lit(1.0)).otherwise(F.exp(-F.pow(F.greatest(age_hours, F.lit(0.0)) / scale, shape)))


def value_score(now: Column) -> Column:
    """The weighted value of a memory row, 1 for pinned ones."""
    c = F.col
    reliability = F.least(F.lit(1.0), F.log1p(F.greatest(c("verifications"), F.lit(0))) / math.log1p(10))
    user = F.when(c("scope_user").isNull(), 0.0).when(c("recalls") > 0, 1.0).otherwise(0.4)
    signal = (c("helpful") > 0) | (c("harmful") > 0)
    task = F.when(signal, F.lit(1.0) / (F.lit(1.0) + F.exp((c("harmful") - c("helpful")).cast("double")))).otherwise(0.0)
    volume = F.least(F.lit(1.0), F.log1p(c("recalls")) / math.log1p(20))
    recent = F.when(c("last_recalled_at").isNull(), 0.0).otherwise(F.pow(F.lit(0.5), age_days(c("last_recalled_at"), now) / 90))
    age = age_days(c("valid_from"), now)
    shape = by_key(c("kind"), DECAY_SHAPES, 1.0)
    recency = F.when(c("half_life_days") > 0, halflife_survival(age, c("half_life_days"), shape)).otherwise(F.exp(-age / 365))
    surprise = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c("surprise"), F.lit(0.0))))
    parts = {
        "reliability": reliability, "user": user, "task": task, "usage": volume * 0.5 + recent * 0.5,
        "recency": recency, "surprise": surprise,
    }
    total = sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.when(c("pinned"), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def modulated(base: Column, now: Column) -> Column:
    """A retrieval score changed by decay, failures, warnings, feedback and pins."""
    c = F.col
    decay = F.when(
        c("half_life_days") > 0, F.greatest(F.lit(0.3), F.pow(F.lit(0.5), age_days(c("valid_from"), now) / c("half_life_days")))
    ).otherwise(1.0)
    feedback = F.lit(1.0) + F.least(c("helpful"), F.lit(5)) * 0.1 - F.least(c("harmful"), F.lit(5)) * 0.15
    return (
        base
        * decay
        * F.when(c("outcome") == "failed", 1.5).otherwise(1.0)
        * F.when(c("kind") == "warning", 1.2).otherwise(1.0)
        * F.least(F.lit(2.0), F.greatest(F.lit(0.2), feedback))
        * F.when(c("pinned"), 1.3).otherwise(1.0)
    )


def wilson_bounds(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper Wilson bound of a rate; 0 and 1 without trials."""
    n = n.cast("double")
    p = F.least(F.greatest(successes.cast("double"), F.lit(0.0)), n) / n
    centre = p + z * z / (2 * n)
    spread = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z
    scale = z * z / n + 1
    low = F.when(n > 0, F.greatest(F.lit(0.0), (centre - spread) / scale)).otherwise(0.0)
    high = F.when(n > 0, F.least(F.lit(1.0), (centre + spread) / scale)).otherwise(1.0)
    return low, high


def trust_rank(tier: Column) -> Column:
    """0 for the most trusted tier; unknown tiers rank last."""
    return by_key(tier, {t: i for i, t in enumerate(TRUST_ORDER)}, len(TRUST_ORDER) - 1)


def lowest_trust(tiers: Column) -> Column:
    """The least trusted tier of an array."""
    ranks = F.transform(tiers, trust_rank)
    return F.element_at(F.array(*[F.lit(t) for t in TRUST_ORDER]), F.coalesce(F.array_max(ranks), F.lit(4)) + 1)


def credit(outcome: Column, feedback: Column) -> Column:
    """harmful for negative feedback or failed turns, else helpful for verified or praised ones, else neutral."""
    return (
        F.when((feedback == "thumbs_down") | outcome.isin("failed", "blocked"), "harmful")
        .when((outcome == "verified") | (feedback == "positive"), "helpful")
        .otherwise("neutral")
    )


def verdict(outcome: Column, feedback: Column) -> Column:
    """Feedback decides both ways; without it the outcome does."""
    return (
        F.when(feedback == "thumbs_down", "failure")
        .when(feedback == "positive", "success")
        .when(outcome.isin("failed", "blocked"), "failure")
        .when(outcome == "verified", "success")
        .otherwise("unknown")
    )
