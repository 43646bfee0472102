"""Planted signals must be found, their negative twins must not."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import agriculture, analytics, business, explore, marketing, modelling, roles


def test_planted_basket(spark):
    rows = []
    for i in range(160):
        rows += [(f"o{i}", "bread"), (f"o{i}", "butter")] if i < 80 else [(f"o{i}", f"solo{i % 9}"), (f"o{i}", f"other{i % 7}")]
    result = business.market_basket(spark.createDataFrame(rows, "order_id string, product string").repartition(3), "order_id", "product")
    best = result.rules.where(F.col("antecedent") == F.array(F.lit("bread"))).first()
    assert (best["consequent"], best["support"], best["confidence"], best["lift"]) == (["butter"], 0.5, 1.0, 2.0)


def test_basket_counts_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    baskets = [sorted(set(rng.choice(12, rng.integers(1, 6)))) for _ in range(300)]
    df = spark.createDataFrame([(i, f"p{int(x):02d}") for i, b in enumerate(baskets) for x in b], "t int, p string")
    patterns, items = business.basket_patterns(df.repartition(5), "t", "p")
    got = {(r["a"], r["b"]): r["n"] for r in business.pair_support(patterns, len(items)).collect()}
    want = {}
    for b in baskets:
        for x in b:
            for y in b:
                if x <= y:
                    want[x, y] = want.get((x, y), 0) + 1
    assert got == want
    triples = business.triple_support(patterns, len(items), [k for k in want if k[0] < k[1]]).collect()
    assert all(r["n"] == sum({r["a"], r["b"], r["c"]} <= set(b) for b in baskets) for r in triples) and triples


def test_single_item_orders_are_no_baskets(spark):
    result = business.market_basket(spark.createDataFrame([(i, "x") for i in range(50)], "t int, p string"), "t", "p")
    assert result.rules is None and "single-item" in result.reason


def test_rules_of_chance_are_told(spark):
    rows = [(i, p) for i in range(40) for p in ("a", "b")]
    result = business.market_basket(spark.createDataFrame(rows, "t int, p string"), "t", "p")
    assert result.rules is None and result.reason == "every rule has lift <= 1"


def test_left_out_items_are_told(spark):
    rows = [(i, f"p{j}") for i in range(60) for j in range(3 + i % 2)] + [(0, "rare")]
    result = business.market_basket(spark.createDataFrame(rows, "t int, p string"), "t", "p", max_items=3)
    assert (result.items, result.dropped) == (5, 1)
    whole = business.market_basket(spark.createDataFrame(rows, "t int, p string"), "t", "p")
    assert whole.dropped == 0


def test_baskets_packed_first_equal_counted_pairs(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(int(t), f"p{int(p):03d}") for t, p in zip(rng.integers(0, 400, 3000), np.minimum(rng.geometric(0.12, 3000), 90))]
    df = spark.createDataFrame([*rows, *rows[:50], (None, "p001"), (1, None)], "t int, p string").repartition(4)

    def found(**limits):
        b = business.market_basket(df, "t", "p", 0.05, 0.1, **limits)
        return b.reason, b.transactions, round(b.mean_size, 9), b.items, b.dropped, sorted(map(repr, b.rules.collect()))

    packed = found(), found(max_items=6)
    monkeypatch.setattr(business, "FEW_ITEMS", 0)
    assert packed == (found(), found(max_items=6))
    assert len(packed[0][5]) > len(packed[1][5]) > 0 and packed[1][4] > 0


def test_triples_in_several_passes(spark, monkeypatch):
    rows = [(i, f"p{j}") for i in range(60) for j in range(5) if (i + j) % 3]
    patterns, items = business.basket_patterns(spark.createDataFrame(rows, "t int, p string"), "t", "p")
    pairs = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    once = business.triple_support(patterns, len(items), pairs).collect()
    monkeypatch.setattr(business, "PAIRS_A_PASS", 3)
    assert sorted(business.triple_support(patterns, len(items), pairs).collect()) == sorted(once)


def test_nothing_above_zero_has_a_reason(spark):
    totals = business.entity_totals(spark.createDataFrame([("a", -1.0), ("b", 0.0)], "c string, v double"), "c", F.col("v"))
    assert business.abc_pareto(totals).reason


def test_netting_entities_are_held_out(spark):
    rows = [("a", 100.0), ("b", 50.0), ("b", -50.0), ("c", 30.0), ("c", -100.0), ("d", 40.0), ("e", 5.0), ("e", 5.0)]
    totals = business.entity_totals(spark.createDataFrame(rows, "customer string, amount double"), "customer", F.col("amount"))
    pareto = business.abc_pareto(totals)
    held = pareto.non_contributing.first()
    assert (held["entity_count"], held["zero_net_count"], held["negative_net_count"], held["net_value_total"]) == (2, 1, 1, -70.0)
    assert pareto.bands.where("band = 'A'").first()["top_entities"] == ["a"]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 37])
def test_scores_equal_rank_then_cut(spark, n):
    rng = np.random.default_rng(n)
    frame = pd.DataFrame({"entity": np.arange(n), "recency_days": rng.integers(0, 9, n).astype(float), "frequency": rng.integers(1, 4, n).astype(float),
                          "monetary": rng.random(n), "lifespan_days": 0.0})
    got = business.rfm_scores(spark.createDataFrame(frame).repartition(3)).toPandas().sort_values("entity")

    def expected(series, ascending):
        ranked = series.rank(method="first", ascending=ascending)
        levels = min(5, n)
        if levels == 1:
            return [5] * n
        cut = pd.qcut(ranked, levels, labels=False, duplicates="drop")
        return (1 + cut / cut.max() * 4).round().astype(int).tolist()

    assert got["r_score"].tolist() == expected(frame["recency_days"], False)
    assert got["f_score"].tolist() == expected(frame["frequency"], True)
    assert got["m_score"].tolist() == expected(frame["monetary"], True)


def test_cohorts_leave_the_future_blank(spark):
    rows = [("a", "2024-01-05"), ("a", "2024-02-05"), ("b", "2024-01-09"), ("c", "2024-02-20")]
    df = spark.createDataFrame(rows, "e string, d string").withColumn("d", F.to_date("d"))
    cells = {(r["cohort_label"], r["offset"]): r["retained_share"] for r in business.cohort_retention(df, "e", "d").matrix.collect()}
    assert cells == {("2024-01", 0): 1.0, ("2024-01", 1): 0.5, ("2024-02", 0): 1.0, ("2024-02", 1): None}


def test_gaps_of_a_hot_entity(spark):
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=30 * i) for i in range(200)]
    df = spark.createDataFrame([("hot", t) for t in times + times[:5]] + [("cold", times[0])], "e string, t timestamp").repartition(6)
    got = {r["gap"]: r["n"] for r in business.gap_counts(df, "e", "t").collect()}
    assert got == {1: 199, 0: 5}


def test_gaps_equal_neighbours_in_order(spark):
    rng = np.random.default_rng(3)
    # seconds around the epoch: several events a day, the same instant twice, midnights, years without any
    seconds = [*rng.integers(-400_000, 400_000, 300).tolist(), *[86_400 * int(d) for d in rng.integers(-9, 9, 40)], 2_000_000_000, -2_000_000_000]
    rows = [(f"e{i % 3}", dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s, microseconds=int(rng.integers(2)))) for i, s in enumerate(seconds)]
    want = {}
    for e in ("e0", "e1", "e2"):
        at = sorted(t for who, t in rows if who == e)
        for earlier, later in zip(at, at[1:]):
            want[(later - earlier).days] = want.get((later - earlier).days, 0) + 1
    df = spark.createDataFrame([*rows, (None, rows[0][1]), ("e0", None)], "e string, t timestamp_ntz").repartition(5)
    gaps = business.gap_counts(df, "e", "t")
    assert {r["gap"]: r["n"] for r in gaps.collect()} == want
    # events are grouped, not laid out by range, which takes another reading of them
    assert "rangepartitioning" not in gaps._jdf.queryExecution().toString()


def test_value_basis():
    assert business.value_basis("unit_price", "qty").label == "unit_price x qty"
    assert business.value_basis("line_total", "qty").label == "line_total"
    assert business.value_basis("mystery", "qty").quantity is None


# -- exploration ---------------------------------------------------------------------------------------

def test_seasonal_trend_is_found(spark):
    days = 420
    rng = np.random.default_rng(1)
    rows = [(dt.datetime(2023, 1, 1) + dt.timedelta(days=i), 5.0 * i + 400 * (i % 7 == 0) + float(rng.normal(0, 5))) for i in range(days)]
    found, _ = explore.trends(spark.createDataFrame(rows, "t timestamp, y double").repartition(4))
    row = found.first()
    assert row["seasonality_period"] == 7 and row["frequency"] == "D" and row["slope"] * 86400 == pytest.approx(5.0, rel=0.05)


def test_correlation_needs_enough_rows(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)], "a double, b double")
    found, skipped = explore.correlations(df)
    assert found.count() == 0 and "n=20" in skipped.first()["reason"]


def test_spearman_reported_only_when_clearly_stronger(spark):
    df = spark.createDataFrame([(float(i), float(np.exp(i / 6))) for i in range(100)], "a double, b double")
    methods = {r["method"]: r["coefficient"] for r in explore.correlations(df)[0].collect()}
    assert methods["spearman"] == pytest.approx(1.0) and methods["pearson"] < 0.9
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(100)], "a double, b double")
    assert {r["method"] for r in explore.correlations(line)[0].collect()} == {"pearson"}


@pytest.mark.parametrize("counts, verdict", [
    ([0, 9, 1, 0, 8, 0, 0, 0, 0, 0, 0, 0], "multimodal_suspected"),
    ([1, 2, 5, 9, 8, 9, 5, 3, 2, 1, 0, 0], "unimodal"),
    ([0, 3, 2, 9, 2, 3, 0, 0, 0, 0, 0, 0], "unimodal"),  # 2 is more than 0.4 of 3
    ([5, 1, 9, 0, 0, 0, 0, 0, 0, 0, 0, 4], "multimodal_suspected"),
    ([0, 100, 0, 4, 0, 0, 0, 0, 0, 0, 0, 0], "unimodal"),  # below a twentieth of the highest bin
    ([7] * 12, "unimodal"),
    ([12], "unimodal"),
])
def test_modality(spark, counts, verdict):
    assert spark.createDataFrame([(counts,)], "c array<long>").select(explore.modality_hint(F.col("c"))).first()[0] == verdict


def test_monthly_and_hourly_frequencies(spark):
    months = [(dt.datetime(2024, m, 1), dt.datetime(2024, 1, 1, m)) for m in range(1, 13)]
    got = {r["column"]: r["frequency"] for r in explore.frequencies(spark.createDataFrame(months, "m timestamp, h timestamp"), ["m", "h"]).collect()}
    assert got == {"m": "MS", "h": "h"}


# -- roles and packs -------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def ads(spark):
    rows = []
    for day in range(28):
        for i, name in enumerate(("Prospecting", "Retargeting", "Brand")):
            clicks = 40 if day < 21 else 15
            rows.append((dt.date(2024, 3, 1) + dt.timedelta(days=day), name, f"${(100 + 60 * i) * 1.5:,.2f}", 2000, clicks, 2.0 + (day / 10 if i == 1 else 0), 5 if i < 2 else 1, 260.0))
    rows.append((dt.date(2024, 3, 28), "Total", "$9,999.00", 1, 1, 1.0, 1, 1.0))
    schema = "`Reporting starts` date, `Ad set name` string, `Amount spent (USD)` string, Impressions long, `Link clicks` long, Frequency double, Results long, `Purchase conversion value` double"
    return spark.createDataFrame(rows, schema)


def test_ad_export_is_recognised(ads):
    detection = roles.detect(ads)
    assert marketing.qualification(detection).applies
    assert detection.assigned["spend"] == "Amount spent (USD)" and detection.assigned["campaign_id"] == "Ad set name"


def test_ad_rules(ads):
    detection = roles.detect(ads)
    prepared = marketing.prepare(ads, detection.assigned)
    assert prepared.frame.count() == 84 and prepared.notes.where("note = 'summary_row_excluded'").first()["value"] == 1
    found, skipped = marketing.run(prepared.frame)
    rules = {r["rule"] for r in found.collect()}
    assert {"account_totals", "ctr_decline", "roas_below_target", "adset_underperforming", "adset_fatigue_trend"} <= rules
    assert "budget_mispacing" in {r["rule"] for r in skipped.collect()}


def test_sales_are_no_ad_export(spark):
    df = spark.createDataFrame([(f"c{i % 9}", 10.0 + i * 1.5) for i in range(60)], "customer string, revenue double")
    verdict = marketing.qualification(roles.detect(df))
    assert not verdict.applies and "spend" in verdict.reason


@pytest.fixture(scope="module")
def crops(spark):
    rng = np.random.default_rng(11)
    rows = []
    for d in ("Wayanad", "Palakkad", "Idukki"):
        for c in ("Rice", "Pepper"):
            for year in range(2015, 2023):
                area = float(90 + rng.integers(0, 20))
                per = 0.5 if (d, c, year) == ("Wayanad", "Rice", 2022) else 2.5
                rows.append((d, year, "Kharif   " if c == "Rice" else "rabi", c, area, area * per, float(2000 + rng.integers(0, 100))))
    return spark.createDataFrame(rows, "District_Name string, Crop_Year int, Season string, Crop string, Area double, Production double, Rainfall_mm double")


def test_planted_collapse_and_nothing_else(crops):
    detection = roles.detect(crops)
    assert agriculture.qualification(detection).applies
    prepared = agriculture.prepare(crops, detection.assigned)
    assert {r["season"] for r in prepared.frame.select("season").distinct().collect()} == {"Kharif", "Rabi"}
    found, _ = agriculture.run(prepared.frame)
    assert [r["scope"] for r in found.where("rule = 'yield_collapse'").collect()] == ["Wayanad / Rice"]


def test_zero_area_has_no_yield(spark, crops):
    detection = roles.detect(crops)
    odd = crops.withColumn("Area", F.when(F.col("Crop_Year") == 2016, 0.0).otherwise(F.col("Area")))
    prepared = agriculture.prepare(odd, detection.assigned)
    assert prepared.undefined.where("reason = 'zero area cultivated'").first()["n"] == 6
    assert prepared.frame.where("year = 2016 and yield is not null").count() == 0


def test_run_all_says_why_not(spark):
    df = spark.createDataFrame([(f"c{i % 9}", 10.0 + i * 1.5) for i in range(60)], "customer string, revenue double")
    findings, status = analytics.run_all(df)
    told = {r["analysis"]: r for r in status.collect()}
    assert told["abc_pareto"]["ran"] and not told["rfm"]["ran"] and "event_date" in told["rfm"]["reason"]
    assert findings.where("analysis = 'abc_pareto'").count() > 0


def test_run_all_reads_its_table_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(value):
        read.add(1)
        return value

    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=7 * (i % 11) + i // 40 * 90) for i in range(120)]
    df = spark.createDataFrame([(f"c{i // 14}", f"o{i // 3}", f"p{i % 4}", d, 10.0 + i * 1.5) for i, d in enumerate(days)], "customer string, order_id string, product string, order_date timestamp, amount double")
    findings, status = analytics.run_all(df.withColumn("amount", seen("amount")), {"transaction_id": "order_id", "item_id": "product"})
    ran = {r["analysis"] for r in status.collect() if r["ran"]}
    assert {"abc_pareto", "rfm", "cohort_retention", "retention_churn", "historical_clv"} <= ran and findings.count()
    assert read.value == 120


# -- modelling -------------------------------------------------------------------------------------------

def test_learnable_class_beats_the_majority(spark):
    rng = np.random.default_rng(5)
    rows = [(float(x), "ab"[int(x > 0.5)], "red" if rng.random() < 0.5 else None) for x in rng.random(200)]
    df = spark.createDataFrame(rows, "x double, y string, noise string")
    outcome = modelling.predict(df, "y", config=modelling.Config(trees=5, depth=3, splits=2))
    assert outcome.status == "answered" and outcome.associations.first()["column"] == "x"


def test_noise_is_escalated(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(150, 2))], "x double, y double")
    outcome = modelling.predict(df, "y", config=modelling.Config(trees=5, depth=3, splits=2))
    assert outcome.status == "escalated" and "baseline" in outcome.reason


def test_forward_folds_never_look_ahead():
    folds = modelling.forward_folds(24, 5)
    assert folds == [(4, 8), (8, 12), (12, 16), (16, 20), (20, 24)]


def test_registered_models_run_the_default_config(monkeypatch):
    from types import SimpleNamespace

    from tidegauge.workload import models

    class Frame:
        def __getattr__(self, name):
            return lambda *a, **b: self

    seen = []
    for name in ("read", "document_features", "filled"):
        monkeypatch.setattr(models, name, lambda *a, **b: Frame())
    monkeypatch.setattr(models.F, "lit", lambda x: x)
    monkeypatch.setattr(models.modelling, "predict", lambda *a, config=None, **b: seen.append(config) or SimpleNamespace(scores=Frame(), status="", reason="", winner=""))
    models.quality_model(None, "")
    models.price_model(None, "")
    assert all(c is None or c == models.modelling.Config() for c in seen) and len(seen) == 2


def test_a_table_without_rules_gives_no_rows(spark, tmp_path):
    from tidegauge.workload import analyses

    # every order holds every brand, so no pair meets more often than chance
    spark.createDataFrame([(i, f"Brand#{i}") for i in range(4)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(o, p) for o in range(30) for p in range(4)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = analyses.association_rules(spark, str(tmp_path))
    assert found.collect() == [] and found.columns == ["antecedent", "consequent", "support", "confidence", "lift"]


def test_item_candidates_count_pairs(spark):
    """One column open by its floor (few orders hold many values), one of the order itself, one with a value a line, one empty."""
    cells = [(o, o % 7 if o >= 4 else None, i, f"v{i}" if o == 0 else None, None, float(i) if o % 2 else None, o * 0.5, f"v{i}" if o == 0 and i < 4 else None) for o in range(12) for i in range(14)]
    df = spark.createDataFrame(cells + [(None, 1, 2, "x", None, 1.0, 2.0, "x")], "t long, own long, line long, few string, empty string, half double, name_of double, rare string")
    facts = roles.hold(roles.column_facts(df))
    got = {r["column"]: r["score"] for r in roles.item_candidates(df, facts, "t").collect()}
    want = {}
    for i, c in enumerate(df.columns[1:], 1):
        pairs = len({(r[0], r[i]) for r in cells if r[i] is not None})
        want[c] = pairs / 12 > 1
    assert {c: s > 0 for c, s in got.items()} == want
    assert want == {"own": False, "line": True, "few": True, "empty": False, "half": True, "name_of": False, "rare": False}
    floors = roles._pair_floors(df.where("t is not null"), "t", df.columns[1:])
    assert floors == {"own": 8, "line": 24, "few": 2, "empty": 0, "half": 12, "name_of": 12, "rare": 2}


def test_a_spread_input_has_bounded_tasks(spark, monkeypatch):
    from tidegauge import session

    df = spark.range(1000)
    monkeypatch.setattr(session, "TASK_BYTES", 500)
    assert session.spread(df).rdd.getNumPartitions() == 16
