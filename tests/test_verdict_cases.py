"""Cases that once went wrong: quoted CSV, rules that fail while running, queries that reach other tables, hidden limits."""

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import business, explore, packs, query, textchecks
from tidegauge.sources import files


def test_quoted_fields_keep_commas_quotes_and_line_ends(spark, tmp_path):
    wanted = [("a", 'x "y", z'), ("b", "two\nlines"), ("c", "plain")]
    folder = str(tmp_path / "csv")
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "one.csv").write_text("k,v\n" + "".join('{},"{}"\n'.format(k, v.replace('"', '""')) for k, v in wanted))
    loaded = files.read_delimited(spark, folder, "k string, v string")
    assert sorted(tuple(r) for r in loaded.data.collect()) == sorted(wanted)


def test_a_rule_that_fails_while_running_is_left_out(spark):
    def breaks(frame, config):
        return frame.select(F.raise_error(F.lit("late")).alias("rule")), packs.none_skipped(frame)

    def works(frame, config):
        return packs.nothing(frame), packs.none_skipped(frame)

    found, left_out = packs.run_rules([works, breaks], spark.range(3), None)
    assert found.count() == 0 and [r[0] for r in left_out.collect()] == ["breaks"]


@pytest.mark.parametrize("sql", ["SELECT * FROM other.secret", "SELECT reflect('java.lang.System', 'getProperty', 'user.name')", "SELECT * FROM range(3)", "SELECT * FROM hidden", "SELECT a FROM t WHERE a IN (SELECT id FROM hidden)", "DROP TABLE t"])
def test_queries_stay_inside_their_table(spark, sql):
    spark.range(2).createOrReplaceTempView("hidden")
    with pytest.raises(query.QueryRefused):
        query.ask(spark.range(3).withColumnRenamed("id", "a"), "t", sql)


def test_a_view_name_in_quotes_is_text(spark):
    spark.range(2).createOrReplaceTempView("hidden")
    answered = query.answer(spark.range(3).withColumnRenamed("id", "a"), "t", "WITH c AS (SELECT a FROM t) SELECT 'hidden' AS label, a FROM c")
    assert answered.rows.count() == 3 and not answered.truncated


def test_cohorts_are_whole_and_limits_are_told(spark):
    events = spark.range(60).select((F.col("id") % 60).alias("who"), F.add_months(F.lit("2010-01-01").cast("date"), F.col("id").cast("int")).cast("timestamp").alias("at"))
    whole = business.cohort_retention(events, "who", "at")
    assert whole.matrix.select("cohort").distinct().count() == 60
    cut = business.cohort_retention(events, "who", "at", max_cohorts=5)
    assert tuple(cut.scope.first())[:2] == (60, 5) and cut.matrix.select("cohort").distinct().count() == 5


def test_row_cap_needs_a_key(spark):
    with pytest.raises(ValueError):
        explore.explore(spark.range(10), row_cap=5)


def test_causal_terms_and_places(spark):
    texts = spark.createDataFrame([(1, "It fell because of rain, because it rained."), (2, "Nothing here.")], "k int, text string")
    found = textchecks.causal_matches(texts, "k", "text", lexicon=["because", "rain(?:ed)?"]).collect()
    assert sorted((r.position, r.term) for r in found) == [(8, "because"), (19, "rain"), (25, "because"), (36, "rained")]


