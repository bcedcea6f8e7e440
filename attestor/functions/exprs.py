"""Column functions of the scoring model: rounding, guarded arithmetic, dates, decay, bands."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, functions as F

from attestor.model import DEFAULT, HALF_LIVES, MENTION_CAP, RANK_WEIGHTS, SPAM_CUTOFF, Model

DAY_MICROS = 86_400_000_000.0
#: Products are summed as whole billionths, so sums do not depend on their order.
NANO = 1_000_000_000


def half_up(value: Column, places: int) -> Column:
    """floor(x * 10^p + 0.5) / 10^p: halves go up, also below zero."""
    scale = F.lit(float(10**places))
    return F.floor(value.cast("double") * scale + F.lit(0.5)) / scale


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Into [low, high]; null and NaN give low."""
    value = F.when(F.isnan(value), F.lit(None)).otherwise(value)
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.coalesce(value, F.lit(float(low)))))


def safe_div(a: Column, b: Column, default: float | None = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default).cast("double"))


def scaled(value: Column) -> Column:
    """The value as whole billionths."""
    return F.floor(value * F.lit(float(NANO)) + F.lit(0.5)).cast("long")


def unscaled(value: Column) -> Column:
    return value / F.lit(float(NANO))


def mean_at_least(value: Column, floor: str) -> Column:
    """Aggregate: whether the mean of the values as they are written (0.07 is seven hundredths) is at least floor.

    A sum of doubles depends on the order of its rows, and a mean that equals floor falls on either side of it.  Values that
    18 places do not hold (over 10^10, infinite, NaN) have their group compared by doubles.
    """
    exact, n = value.try_cast("decimal(28,18)"), F.count(value)
    by_digits = F.sum(exact) >= F.lit(Decimal(floor)) * n.cast("decimal(18,0)")
    return F.when(F.count(exact) == n, by_digits).otherwise(F.avg(value) >= F.lit(float(floor)))


def normalise_within(value: Column, largest: Column) -> Column:
    return F.when(largest > 0, clamp(value / largest) * 100).otherwise(F.lit(0.0))


def age_days(ts: Column, now: Column) -> Column:
    """Days from ts to now, at least 0; null without a date."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return F.when(ts.isNotNull(), F.greatest(F.lit(0.0), micros / F.lit(DAY_MICROS)))


def days_before(now: Column, days: float) -> Column:
    return now - F.make_dt_interval(F.lit(int(days)), F.lit(0), F.lit(0), F.lit((days - int(days)) * 86400).cast("decimal(18,6)"))


def human_age(days: Column) -> Column:
    """today, n days below 45, n months below 545 days, then years (one place below ten)."""
    count = lambda n, unit: F.concat(n.cast("long").cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"))
    years = days / 365.25
    return (
        F.when(days.isNull(), None).when(days < 1, "today").when(days < 45, count(half_up(days, 0), "day")).when(days < 545, count(half_up(days / 30.44, 0), "month"))
        .when(years < 10, F.concat(F.format_number(years, 1), F.lit(" years"))).otherwise(F.concat(half_up(years, 0).cast("long").cast("string"), F.lit(" years")))
    )


def parse_date(text: Column, now: Column) -> Column:
    """ISO text, or 'YYYY-MM-DD hh:mm:ss +00:00', as a timestamp; null if invalid or more than two days after now."""
    repaired = F.regexp_replace(F.trim(text), r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2}) ([+-]\d{2}:\d{2})$", "$1T$2$3")
    found = F.try_to_timestamp(repaired)
    return F.when(found <= now.cast("timestamp") + F.expr("INTERVAL 2 DAYS"), found)


def period_start(now: Column, group: str) -> Column:
    return F.date_trunc(group, now)


def proximity(distance: Column, boundary: Column, model: Model = DEFAULT) -> Column:
    blend = model["proximity"]["blend"]
    decay = F.coalesce(F.exp(-distance.cast("double") / model["proximity"]["token_decay"]), F.lit(0.5))
    levels = model["boundary"]
    score = reduce(lambda acc, kv: acc.when(boundary == kv[0], kv[1]), levels.items(), F.when(F.lit(False), 0.0)).otherwise(levels["different_paragraph"])
    return half_up(clamp(F.lit(blend) * decay + F.lit(1 - blend) * score), 4)


def recency(ts: Column, now: Column, half_life: float | None = None, model: Model = DEFAULT) -> Column:
    half_life = half_life or model["recency"]["half_life_days"]
    return F.when(ts.isNull(), F.lit(model["recency"]["undated"])).otherwise(half_up(F.power(F.lit(0.5), age_days(ts, now) / F.lit(float(half_life))), 4))


def classify_domain(rank: Column, spam: Column | None = None, major: Column | None = None) -> Column:
    spam, major = F.lit(None).cast("double") if spam is None else spam, F.lit(False) if major is None else major
    return (
        F.when(spam >= SPAM_CUTOFF, "spam").when(major, "major").when(rank.isNull(), "unknown").when(rank >= 80, "major").when(rank >= 60, "specialist")
        .when(rank >= 35, "ordinary").when(rank >= 10, "blog").otherwise("unknown")
    )


def reliability(domain_rank: Column, url_rank: Column, prominence: Column, kind: Column, override: Column | None = None, model: Model = DEFAULT) -> Column:
    """Weighted mean of the signals that are known; an override wins, spam is 0."""
    weights, classes = model["reliability_weights"], model["classification"]
    of_kind = reduce(lambda acc, kv: acc.when(kind == kv[0], kv[1]), classes.items(), F.when(F.lit(False), 0.0)).otherwise(classes["unknown"])
    parts = [(domain_rank / 100, weights["domain_rank"]), (url_rank / 100, weights["url_rank"]), (prominence, weights["prominence"]), (of_kind, weights["classification"])]
    total = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), clamp(v) * w).otherwise(0.0) for v, w in parts])
    mass = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), w).otherwise(0.0) for v, w in parts])
    found = F.when(kind == "spam", 0.0).otherwise(half_up(clamp(total / mass), 4))
    return found if override is None else F.when(override.isNotNull(), half_up(clamp(override), 4)).otherwise(found)


def percentile_rank(value: Column, over) -> Column:
    """Share of values below among n - 1; 1 for a single value; null for null.  ``over``: a window partition."""
    n = F.count(value).over(over)
    return F.when(value.isNull(), None).when(n == 1, 1.0).otherwise((F.rank().over(over.orderBy(value.asc_nulls_last())) - 1) / (n - 1))


def mention_weight(index: Column) -> Column:
    """Weight of the occurrence with this index (from 0) within a document."""
    return reduce(lambda acc, iw: acc.when(index == iw[0], iw[1]), enumerate(MENTION_CAP), F.when(F.lit(False), 0.0)).otherwise(0.0)


def rank_weight(rank: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, RANK_WEIGHTS)), rank.cast("int") - 1), F.lit(0.0))


def evidence_score(*factors: Column) -> Column:
    """Product of the factors to six places; 0 if one is unknown."""
    return half_up(F.coalesce(reduce(lambda a, b: a * b, factors), F.lit(0.0)), 6)


def band(score: Column, model: Model = DEFAULT) -> Column:
    b = model["bands"]
    return F.when(score.isNull(), None).when(score >= b["dominant"], "dominant").when(score >= b["strong"], "strong").when(score >= b["present"], "present").otherwise("marginal")


def independence(kind: Column, same_domain: Column, ordinal: Column, model: Model = DEFAULT) -> Column:
    w = model["independence"]
    return (
        F.when(kind == "exact", w["exact"]).when((kind == "near") & same_domain, w["near_same_domain"]).when(kind == "near", w["syndicated"])
        .when(ordinal == 0, w["first"]).otherwise(w["additional"])
    )


def momentum_fields(current: Column, previous: Column, total_now: Column, total_before: Column, model: Model = DEFAULT) -> dict[str, Column]:
    """Raw and relative change of two adjacent periods and the bucket; an infinite change is null beside its bucket."""
    t = model["momentum"]
    raw = F.when(previous > 0, (current - previous) / previous).when(current > 0, F.lit(None)).otherwise(F.lit(0.0))
    related = (total_now > 0) & (total_before > 0)
    share_now, share_before = F.try_divide(current.cast("double"), total_now.cast("double")), F.try_divide(previous.cast("double"), total_before.cast("double"))
    relative = F.when(share_before > 0, share_now / share_before - 1).when(share_now > 0, F.lit(None)).otherwise(F.lit(0.0))
    basis = F.when(related, relative).otherwise(raw)
    bucket = (
        F.when(basis.isNull(), F.when(current > 0, "rapid_up").otherwise("stable")).when(basis >= t["rapid_up"], "rapid_up").when(basis >= t["up"], "up")
        .when(basis <= t["rapid_down"], "rapid_down").when(basis <= t["down"], "down").otherwise("stable")
    )
    return {"raw_change": half_up(raw, 4), "relative_change": F.when(related, half_up(relative, 4)), "basis": half_up(basis, 4), "bucket": bucket}


def conditional_score(together: Column, documents: Column) -> Column:
    return half_up(F.try_divide(together.cast("double"), documents.cast("double")), 6)


def jaccard_score(together: Column, documents: Column, association: Column) -> Column:
    return F.when(association > 0, half_up(F.try_divide(together.cast("double"), (documents + association - together).cast("double")), 6))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def noisy_or(base: Column, strengths: Column) -> Column:
    """strengths: array<struct<strength, polarity>> in order.  Positive ones shrink what remains, negative ones restore it."""
    step = lambda r, s: F.when(s["polarity"] > 0, r * (1 - s["strength"])).otherwise(r + (1 - r) * F.least(s["strength"], F.lit(0.95)))
    return half_up(1 - F.aggregate(strengths, 1 - base, step), 3)


def verdict(confidence: Column, model: Model = DEFAULT) -> Column:
    e = model["entity_confidence"]
    return F.when(confidence >= e["accept"], "accept").when(confidence >= e["review"], "review").otherwise("reject")


def checked_half_life(days: int | None) -> int | None:
    """None or one of the half-lives a user may ask for."""
    if days is not None and days not in HALF_LIVES:
        raise ValueError(f"half life must be one of {HALF_LIVES}")
    return days


# Query parameters that only track, by how they begin; suffixes under which names are registered third-level.
TRACKING = ("utm_", "fbclid", "gclid", "mc_", "ref", "ref_src", "source", "cmpid", "icid", "ito", "CMP", "spm")
TWO_PART_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "net.uk", "sch.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "co.za", "co.jp", "ne.jp", "or.jp",
    "co.in", "net.in", "org.in", "com.br", "com.mx", "com.ar", "com.sg", "com.hk", "com.tr", "com.cn", "gov.in", "ac.in", "edu.hk", "ac.nz", "org.nz", "gov.au",
)


def canonical_url(url: Column) -> Column:
    """One form for all addresses of a page: https, no www., no tracking or fragment, sorted parameters, no AMP mark, index
    page or closing slash.  What is no URL is lower-cased; empty gives null."""
    trimmed = F.trim(url)
    host = F.regexp_replace(F.lower(F.try_parse_url(trimmed, F.lit("HOST"))), r"^www\.", "")
    path = F.coalesce(F.try_parse_url(trimmed, F.lit("PATH")), F.lit(""))
    for pattern, to in ((r"/amp/?$", "/"), (r"\.amp$", ""), (r"/index\.(html?|php)$", "/"), (r"/+$", "")):
        path = F.regexp_replace(path, pattern, to)
    pairs = F.filter(F.split(F.coalesce(F.try_parse_url(trimmed, F.lit("QUERY")), F.lit("")), "&"), lambda p: (p != "") & ~p.rlike("(?i)^(" + "|".join(TRACKING) + ")"))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(pairs), "&"))).otherwise("")
    protocol = F.lower(F.try_parse_url(trimmed, F.lit("PROTOCOL")))
    scheme = F.when(protocol == "http", "https").otherwise(protocol)
    return F.when(F.coalesce(trimmed, F.lit("")) == "", None).when(host.isNull(), F.lower(trimmed)).otherwise(F.concat(scheme, F.lit("://"), host, path, query))


def root_domain(host: Column) -> Column:
    labels = F.split(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when(F.size(labels) <= 2, F.array_join(labels, ".")).when(last(2).isin(*TWO_PART_SUFFIXES), last(3)).otherwise(last(2))
