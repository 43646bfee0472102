"""Files, pages, the store, personal data, texts, questions, streams and comparisons."""

import re
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidegauge.functions.numeric import number_from_text
from tidegauge.functions.text import label
from tidegauge.operators import compare, history, normalise, privacy, query, textchecks
from tidegauge.operators.profile import profile
from tidegauge.session import rows
from tidegauge.sources import files
from tidegauge.sources.store import SCHEMAS, BaselineRefused, Store
from tidegauge.streaming.validation import stream_outcomes, validate_stream


@pytest.mark.parametrize("text,value", [("$1,234.56", 1234.56), ("1.234,56", 1234.56), ("2.3%", 2.3), ("10 000", 10000.0), ("abc", None), ("-", None), ("-7", -7.0), (None, None)])
def test_numbers_in_text(spark, text, value):
    assert spark.createDataFrame([(text,)], "s string").select(number_from_text("s")).first()[0] == value


def test_labels(spark):
    assert spark.sql("select 1").select(label(F.lit("  o'brien-x \t ST "))).first()[0] == "O'Brien-X St"


def test_partial_dates_are_reported_not_coerced(spark):
    df = spark.createDataFrame([("2024-01-01", "12:30"), ("2024-01-02", "13:00"), ("soon 3", "14:00")], "maybe string, clock string")
    found = normalise.datetimes(df)
    row = {r["column"]: r for r in found.attempts.collect()}
    assert not row["maybe"]["coerced"] and row["maybe"]["parse_rate"] == pytest.approx(2 / 3)
    assert "clock" not in row and dict(found.data.dtypes)["maybe"] == "string"


def test_latin1_file_with_semicolons(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("id;city;day\n1;a,b;2024-01-02\n2;Málaga;2024-01-03\n".encode("latin-1"))
    loaded = files.read_delimited(spark, str(path))
    assert loaded.delimiter == ";" and loaded.arrival.encoding_used == "latin-1" and loaded.arrival.warnings
    assert {r["city"] for r in loaded.data.collect()} == {"a,b", "Málaga"}


def test_nested_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"data": {"items": [{"id": 1, "u": {"n": "a"}}, {"id": 2, "u": {"n": "b"}}]}}))
    got = files.read_pages(spark, str(tmp_path / "p.json"), "data.items")
    assert sorted(got.columns) == ["id", "u.n"] and got.count() == 2


def test_too_large_is_refused(spark):
    with pytest.raises(files.TableTooLarge):
        files.check_size(spark.range(11), max_rows=10)
    assert files.check_size(spark.range(10), max_rows=10).count() == 10


def test_store_decisions_and_baselines(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.decide("s", "role", "entity_id", "customer", "me", dt.datetime(2024, 1, 1))
    store.decide("s", "role", "item_id", "sku", "me", dt.datetime(2024, 1, 1))
    store.decide("s", "role", "entity_id", None, "me", dt.datetime(2024, 1, 2))
    assert [r["key"] for r in store.decisions("s", "role").collect()] == ["item_id"]
    good = profile(spark.range(50).select((F.col("id") * 1.5).alias("x")))
    store.save_baseline("s", "b1", good, dt.datetime(2024, 1, 1))
    store.save_baseline("s", "b2", good, dt.datetime(2024, 1, 2))
    assert store.active_baselines().collect()[0]["baseline_id"] == "b2"
    assert store.load_baseline("s").histogram.count() == 10
    with pytest.raises(BaselineRefused):
        store.save_baseline("s", "b3", profile(spark.range(50).select(F.lit(1.0).alias("x"))), dt.datetime(2024, 1, 3))


PII = {
    "email": ["a@b.com", "x.y@z.org", "q@w.co.uk", "n@m.io", "k@l.dev"],
    "payment_card": ["4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009", "6011000000000004", "4012888888881881"],
    "ip_address": ["10.0.0.1", "192.168.1.255", "8.8.8.8", "1.2.3.4", "2001:db8:0:0:0:0:0:1"],
    "phone_number": ["+14155550100", "(415) 555-0101", "415-555-0102", "+44 20 7946 0958", "020 7946 0000"],
    "government_id": ["123-45-6789"] * 5,
}


def test_each_kind_is_recognised(spark):
    df = spark.createDataFrame(list(zip(*PII.values())), ", ".join(f"{k} string" for k in PII))
    got = {r["column"]: r["kind"] for r in privacy.classify(df).collect()}
    assert got == {k: k for k in PII}


def test_dates_and_bad_cards_are_not_personal(spark):
    values = [("2024-01-01", "4111 1111 1111 1112", "999.1.1.1")] * 6
    assert privacy.classify(spark.createDataFrame(values, "d string, c string, i string")).where("kind != 'phone_number'").count() == 0


def test_verified_data_outranks_a_clearance(spark):
    df = spark.createDataFrame([(e,) for e in PII["email"]], "contact string")
    cleared = spark.createDataFrame([("contact", "not_personal")], "column string, decision string")
    assert privacy.classify(df, cleared).first()["confidence"] == "high"


def test_masking_is_stable_and_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "b@x.com"), (2, "a@x.com"), (3, None), (4, "b@x.com")], "k int, email string")
    verdict = spark.createDataFrame([("email", "email", "high")], "column string, kind string, confidence string")
    got = {r["k"]: r["email"] for r in privacy.mask(df.repartition(3), verdict, key="k").data.collect()}
    assert got == {1: "<EMAIL_1>", 2: "<EMAIL_2>", 3: None, 4: "<EMAIL_1>"}


def test_causal_terms_with_position_and_snippet(spark):
    text = "Sales rose because of ads. It was due to rain, and due to sun."
    df = spark.createDataFrame([(1, text), (2, "nothing here")], "id int, t string")
    got = sorted((r["position"], r["term"]) for r in textchecks.causal_matches(df, "id", "t").collect())
    assert got == [(11, "because"), (34, "due to"), (51, "due to")]
    assert all(text[p:].startswith(t) for p, t in got)


def test_unsupported_numbers_equal_brute_force(spark):
    texts = spark.createDataFrame([(1, "Revenue rose 12.5% to 1,200 and 77 more."), (2, "We saw 3 of A4-10.")], "id int, t string")
    claims = spark.createDataFrame([(1, [0.125], "about 1200 units"), (2, [3.0], "")], "id int, values array<double>, claim_text string")
    assert [(r["id"], r["token"]) for r in textchecks.unsupported_numbers(texts, claims, "id", "t").collect()] == [(1, "77")]


def test_claims(spark):
    texts = spark.createDataFrame([(1, "Margins fell.")], "id int, t string")
    claims = spark.createDataFrame([("c0", 1, ["f1"], [4.0], "margins fell sharply"), ("c1", 1, ["f9"], [9.0], "costs doubled")],
                                   "claim_id string, id int, finding_ids array<string>, values array<double>, claim_text string")
    assert [r["claim_id"] for r in textchecks.uncovered_claims(claims, texts, "id", "t").collect()] == ["c1"]
    kept, rejected = textchecks.grounded_claims(claims, spark.createDataFrame([("f1",)], "finding_id string"))
    assert [r["claim_id"] for r in kept.collect()] == ["c0"] and rejected.first()["unknown_ids"] == ["f9"]


@pytest.mark.parametrize("sql", ["DROP VIEW asked", "SELECT * FROM asked; SELECT 1", "SELECT * FROM other_table", "SELECT * FROM parquet.`/tmp/x`", "INSERT INTO asked SELECT 1", "SELECT nope FROM asked"])
def test_only_a_select_over_the_view(spark, sql):
    with pytest.raises(query.QueryRefused):
        query.ask(spark.range(5), "asked", sql)


def test_cap_and_truncation(spark):
    answered = query.answer(spark.range(30), "asked", "SELECT id FROM asked ORDER BY id", cap=10)
    assert answered.truncated and answered.rows.count() == 10
    assert not query.answer(spark.range(30), "asked", "SELECT id FROM asked LIMIT 4", cap=10).truncated


def test_stream_outcomes_are_the_same_after_a_replay(spark, tmp_path):
    source, sink = tmp_path / "in", str(tmp_path / "out")
    for i in range(2):
        spark.range(i * 100, i * 100 + 100, numPartitions=1).select((F.col("id") * 1.0).alias("x")).write.mode("append").parquet(str(source))
    baseline = profile(spark.range(100).select((F.col("id") * 1.0).alias("x")))
    for attempt in range(2):
        stream = spark.readStream.schema("x double").option("maxFilesPerTrigger", 1).parquet(str(source))
        validate_stream(stream, baseline, sink, str(tmp_path / f"state{attempt}")).awaitTermination()
        got = stream_outcomes(spark, sink)
        assert got.select("batch_id").distinct().count() == 2
        assert got.count() == got.select("batch_id", "rule_id").distinct().count()


def test_comparison_refusals_and_relative_from_zero(spark):
    at = dt.datetime(2024, 1, 1)
    runs = rows(spark, [("a", 1, "s", "completed", at, at, 10, "v"), ("b", 2, "t", "completed", at, at, 10, "v"), ("c", 3, "s", "failed", at, None, 1, "v")], SCHEMAS["runs"])
    assert "itself" in compare.blocked_reason(runs, "a", "a")
    assert "different sources" in compare.blocked_reason(runs, "a", "b")
    assert "did not complete" in compare.blocked_reason(runs, "a", "c")
    row = spark.createDataFrame([(0.0, 5.0)], "before double, after double").select("*", *[e.alias(k) for k, e in compare.delta("before", "after").items()]).first()
    assert (row["absolute"], row["relative"], row["changed"]) == (5.0, None, True)


def test_analytics_need_one_value_basis_and_one_baseline(spark):
    def run(i, basis):
        return (f"r{i}", i, "s", "completed", dt.datetime(2024, 1, i), dt.datetime(2024, 1, i), 10, basis)

    findings = rows(spark, [(f"r{i}", "s", "analytics", "f", "t", ["c"], "k", None, {"m": 1.0}, None) for i in (1, 2)], SCHEMAS["findings"])
    none = rows(spark, [], SCHEMAS["baselines"])
    between = rows(spark, [("b", "s", False, 1, dt.datetime(2024, 1, 1, 12))], SCHEMAS["baselines"])
    same, other = rows(spark, [run(1, "v"), run(2, "v")], SCHEMAS["runs"]), rows(spark, [run(1, "v"), run(2, "w")], SCHEMAS["runs"])
    assert compare.analytics_comparability(findings, same, none, "r1", "r2")[0] == compare.COMPARABLE
    assert compare.analytics_comparability(findings, other, none, "r1", "r2")[0] == compare.NOT_COMPARABLE
    assert "superseded" in compare.analytics_comparability(findings, same, between, "r1", "r2")[1]


def test_previous_run(spark):
    at = [dt.datetime(2024, 1, i) for i in (1, 2, 3)]
    runs = rows(spark, [("a", 1, "s", "completed", at[0], at[0], 1, "v"), ("b", 2, "s", "failed", at[1], None, 1, "v"), ("c", 3, "s", "completed", at[2], at[2], 1, "v")], SCHEMAS["runs"])
    assert {r["run_id"]: r["previous_run_id"] for r in history.previous_runs(runs).collect()} == {"a": None, "c": "a"}
    assert history.find_run(runs, "#3").first()["run_id"] == "c"


def test_lexicon_is_looked_for_by_its_letters(spark):
    letters = {p: textchecks._letters(p) for p in textchecks.CAUSAL_LEXICON}
    assert letters[r"\bthe\s+reason\s+(for|why|behind|that)\b"] == ["the", "reason"] and letters[r"\bresults?\s+in\b"] == ["result", "in"]
    assert all(letters.values())
    # what is no plain word is not narrowed
    assert [textchecks._letters(p) for p in ("a|b", "[ab]c", "ab*", "a{2}", "(a(b)c)d", r"\d+x", "a.b")] == [[]] * 7
    texts = ["The CAUSE led   to effects; causes, because. thus THUS", "nothing", "the\treason WHY results in result in", None, "", "reasoned thelead to due\u00a0to", "\u212a influences"]
    got = {r["pattern"]: (r["texts"], r["hits"]) for r in textchecks.causal_counts(spark.createDataFrame([(t,) for t in texts], "body string"), "body", (*textchecks.CAUSAL_LEXICON, "a|e", r"\bthus\b")).collect()}
    for p in (*textchecks.CAUSAL_LEXICON, "a|e"):
        n = [len(re.findall(p, t or "", re.I | re.A)) for t in texts]
        assert got[p] == (sum(x > 0 for x in n), sum(n)), p
    none = textchecks.causal_counts(spark.createDataFrame([], "body string"), "body").collect()
    assert len(none) == len(textchecks.CAUSAL_LEXICON) and {(r["texts"], r["hits"]) for r in none} == {(0, 0)}
