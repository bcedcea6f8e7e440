import datetime as dt

import pytest
from pyspark.sql import functions as F

from attestor.functions import exprs as X
from attestor.model import DEFAULT
from attestor.operators import insight as I
from attestor.operators import scoring as S

def now():
    return F.lit("2026-09-01 00:00:00").cast("timestamp")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def sum_in_turn(values):
    total = 0.0
    for v in values:
        total += v
    return total


@pytest.mark.parametrize("days,want", [(0, 1.0), (365, 0.5), (730, 0.25), (None, 0.35)])
def test_half_life(spark, days, want):
    ts = F.lit(None).cast("timestamp") if days is None else X.days_before(now(), days)
    assert value(spark, X.recency(ts, now())) == want


def test_rounding_goes_half_up(spark):
    assert value(spark, X.half_up(F.lit(1.005), 2)) == 1.0 and value(spark, X.half_up(F.lit(-0.00005), 4)) == 0.0 and value(spark, X.half_up(F.lit(2.5), 0)) == 3.0


def test_a_mean_at_the_floor_does_not_mind_order(spark, tmp_path):
    """d14_having: the mean is 0.045, a sum of doubles row by row gives less, backwards too."""
    from attestor.plans.relational_queries import having

    hundredths = [9, 0, 6, 3, 0, 9, 1, 8, 4, 5] * 20
    assert sum(hundredths) == 45 * len(hundredths) // 10 and sum_in_turn([h / 100 for h in hundredths]) / len(hundredths) < 0.045
    for name, rows in (("on", hundredths), ("back", hundredths[::-1]), ("sorted", sorted(hundredths)), ("under", [*hundredths[1:], 8])):
        at = str(tmp_path / name)
        spark.createDataFrame([(1, k, h / 100, "R") for k, h in enumerate(rows)], "l_suppkey long, l_orderkey long, l_discount double, l_returnflag string").coalesce(1).write.parquet(f"{at}/lineitem.parquet")
        assert [(r.l_suppkey, r.orders) for r in having(spark, at).collect()] == ([] if name == "under" else [(1, 200)])


@pytest.mark.parametrize("values,want", [([0.04, 0.05, None], True), ([0.04], False), ([float("nan"), 0.0], True), ([1e300, -1e300, 0.0], False), ([float("-inf"), 1.0], False), ([None], None)])
def test_means_of_odd_values(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.agg(X.mean_at_least(F.col("v"), "0.045").alias("v")).first().v is want


def test_proximity(spark):
    assert value(spark, X.proximity(F.lit(0.0), F.lit("same_clause"))) == 1.0
    assert value(spark, X.proximity(F.lit(None).cast("double"), F.lit("nowhere"))) == 0.35


def test_reliability(spark):
    none = F.lit(None).cast("double")
    assert value(spark, X.reliability(F.lit(90.0), none, none, F.lit("major"))) == round((0.9 * 0.4 + 0.2) / 0.6, 4)
    assert value(spark, X.reliability(F.lit(90.0), none, none, F.lit("spam"))) == 0.0
    assert value(spark, X.reliability(F.lit(90.0), none, none, F.lit("spam"), F.lit(0.7))) == 0.7


def test_product_veto(spark):
    parts = [F.lit(x) for x in (0.9, 0.8, 0.7, 0.6, 1.0, 0.5, 1.0)]
    assert value(spark, X.evidence_score(*parts)) == 0.1512
    assert value(spark, X.evidence_score(*parts, F.lit(0.0))) == 0.0 and value(spark, X.evidence_score(*parts, F.lit(None).cast("double"))) == 0.0


def pairs(spark, rows):
    full = [("e", "a", i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "entity_id string, association_id string, document_id long, root_domain string, cluster_id long, cluster_kind string, is_primary boolean, reliability double")


def test_a_cluster_of_five_exact_copies_counts_once(spark):
    got = S.assign_independence(pairs(spark, [(f"d{i}", 1, "exact", i == 0, 0.5) for i in range(5)])).collect()
    assert sum(r.independence for r in got) == 1.0


def test_weights_on_one_domain(spark):
    got = S.assign_independence(pairs(spark, [("d", None, None, False, 0.9 - i / 10) for i in range(3)])).orderBy("document_id").collect()
    assert [r.independence for r in got] == [1.0, 0.35, 0.35] and [r.ordinal for r in got] == [0, 1, 2]


def test_near_copies(spark):
    got = S.assign_independence(pairs(spark, [("d", 1, "near", True, 0.5), ("d", 1, "near", False, 0.5), ("x", 1, "near", False, 0.5)])).orderBy("document_id").collect()
    assert [r.independence for r in got] == [1.0, 0.05, 0.2]


@pytest.mark.parametrize("current,before,want", [(10, 4, "rapid_up"), (13, 10, "up"), (10, 10, "stable"), (7, 10, "down"), (4, 10, "rapid_down"), (3, 0, "rapid_up"), (0, 0, "stable")])
def test_momentum_buckets(spark, current, before, want):
    fields = X.momentum_fields(F.lit(float(current)), F.lit(float(before)), F.lit(None).cast("double"), F.lit(None).cast("double"))
    assert value(spark, fields["bucket"]) == want


def test_momentum_is_relative_to_the_entity(spark):
    fields = X.momentum_fields(F.lit(10.0), F.lit(5.0), F.lit(100.0), F.lit(50.0))
    assert value(spark, fields["bucket"]) == "stable" and value(spark, fields["raw_change"]) == 1.0


def test_retrieval_scores(spark):
    """Two associations on a page of ten: weights in tenths of the page's whole."""
    rows = [("e", rank, rank, a) for rank in range(1, 13) for a in ([1] if rank <= 3 else [2] if rank == 4 else [None])]
    got = {r.association_id: r for r in I.retrieval_scores(spark.createDataFrame(rows, "entity_id string, rank int, document_id long, association_id long")).collect()}
    assert got[1].grs == round(27 / 55 * 100, 1) and got[1].results == 3 and got[2].grs == round(7 / 55 * 100, 1)


@pytest.mark.parametrize("score,want", [(75.0, "dominant"), (74.9, "strong"), (25.0, "present"), (0.0, "marginal"), (None, None)])
def test_bands(spark, score, want):
    assert value(spark, X.band(F.lit(score).cast("double"))) == want


@pytest.mark.parametrize("days,want", [(0.4, "today"), (1.2, "1 day"), (44.0, "44 days"), (60.0, "2 months"), (800.0, "2.2 years"), (4000.0, "11 years")])
def test_human_age(spark, days, want):
    assert value(spark, X.human_age(F.lit(days))) == want


def test_dates(spark):
    parse = lambda t: value(spark, X.parse_date(F.lit(t), now()))
    assert parse("2026-08-01 09:00:00 +00:00") == dt.datetime(2026, 8, 1, 9) and parse("2026-09-02T00:00:00Z") is not None
    assert parse("2026-10-01T00:00:00Z") is None and parse("soon") is None


@pytest.mark.parametrize("url,want", [
    ("http://WWW.Example.com/a/index.html?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2"), ("https://example.com/story/amp/", "https://example.com/story"),
    ("https://example.com/", "https://example.com"), ("Not a URL", "not a url"), ("", None),
])
def test_canonical_urls(spark, url, want):
    assert value(spark, X.canonical_url(F.lit(url))) == want


@pytest.mark.parametrize("host,want", [("www.bbc.co.uk", "bbc.co.uk"), ("a.b.example.com", "example.com"), ("example.com", "example.com")])
def test_root_domains(spark, host, want):
    assert value(spark, X.root_domain(F.lit(host))) == want


def test_noisy_or_minds_order(spark):
    def run(*pairs):
        return value(spark, X.noisy_or(F.lit(0.05), F.array(*(F.struct(F.lit(s).alias("strength"), F.lit(p).alias("polarity")) for s, p in pairs))))

    assert run((0.9, 1)) == 0.905 and run((0.9, 1), (0.5, -1)) != run((0.5, -1), (0.9, 1))


def test_leaderboard_is_repeatable(spark):
    from attestor.plans import registry

    one, two = (sorted(map(tuple, registry.QUERIES["m32_leaderboard"](spark, "/root/testdata/sf0.001").collect())) for _ in range(2))
    assert one == two and one


def test_overrides():
    changed = DEFAULT.override({"pias": {"recency": 0.5}}, current_window_days=90)
    assert changed["pias"]["recency"] == 0.5 and changed["pias"]["authority"] == 0.25 and DEFAULT["pias"]["recency"] == 0.2 and changed.current_window_days == 90
