"""Cleaning operators on the cases where tools differ."""

import csv
import io
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.functions.values import strip, to_double, to_long
from starloom.operators import clean as ops
from starloom.operators import gold, keys, stats
from starloom.operators.quantiles import _histogram, _octave, group_quantiles, quantiles
from starloom.plans.profile import ColumnSpec, DropRule, TargetSpec, parse_profile, snake
from starloom.sources.delimited import read_delimited, read_text_columns, sniff_delimiter
from starloom.sources.quoted import ends_inside
from starloom.streaming.incremental import append_stream

TEXT, NUMBER = T.StringType(), T.DoubleType()


def values(spark, rows, column, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, v {kind}").select("i", column.alias("x")).orderBy("i").select("x").collect()]


def test_guarded_casts(spark):
    texts = ["12d", "1e3", " 12 ", "NaN", "inf", "-Infinity", "1_000", None, "", ".5", "0x1"]
    assert values(spark, texts, to_double(F.col("v"), TEXT)) == [None, 1000.0, 12.0, None, float("inf"), float("-inf"), None, None, None, 0.5, None]
    assert values(spark, ["Unknown", "1", "1.0", " -7 "], to_long(F.col("v"), TEXT)) == [None, 1, None, -7]
    assert values(spark, [0.9, -1.9, float("nan"), None], to_long(F.col("v"), NUMBER), "double") == [0, -1, None, None]
    assert values(spark, ["\tyes ", " no", " x "], strip(F.col("v"))) == ["yes", "no", "x"]


@pytest.mark.parametrize(
    ("rule", "kept"),
    [
        (DropRule("v", "equals", "other", True), [None, "m", "X"]),
        (DropRule("v", "equals", "Other"), [None, "m", "other", "X"]),
        (DropRule("v", "in", ["Other", "x"], True), [None, "m"]),
        (DropRule("v", "equals", 5), [None, "Other", "m", "other", "X"]),
        (DropRule("absent", "equals", 5), [None, "Other", "m", "other", "X"]),
    ],
)
def test_drop_rules(spark, rule, kept):
    df = spark.createDataFrame([(0, None), (1, "Other"), (2, "m"), (3, "other"), (4, "X")], "i int, v string")
    assert [r.v for r in ops.drop_rows(df, rule).orderBy("i").collect()] == kept


def test_drop_rules_on_numbers(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    assert ops.drop_rows(df, DropRule("v", "lt", 2)).count() == 2 and ops.drop_rows(df, DropRule("v", "gt", 1)).count() == 2
    assert ops.drop_rows(df, DropRule("v", "in", 1)).count() == 2
    with pytest.raises(ValueError, match="like"):
        ops.drop_rows(df, DropRule("v", "like", 1))


def test_mapping_matches_by_kind(spark):
    assert values(spark, [1, 2, 3], ops.map_values(F.col("v"), T.LongType(), {1: 0, 2: 1}), "long") == [0, 1, 3]
    assert values(spark, [1.0, 2.5], ops.map_values(F.col("v"), NUMBER, {1: 0}), "double") == [0.0, 2.5]
    assert values(spark, ["1", "Yes"], ops.map_values(F.col("v"), TEXT, {1: 0, "Yes": 1})) == ["1", "1"]
    assert values(spark, [1.0, 3.0], ops.map_values(F.col("v"), NUMBER, {1: "one"}), "double") == ["one", "3.0"]


def test_bands(spark):
    age = gold.age_bracket(to_double(F.col("v"), TEXT))
    assert values(spark, ["17.9", "18", "80", "1e9", None, "?"], age) == ["0-17", "18-39", "80+", "80+", None, None]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=30))
def test_bands_are_total_and_monotone(spark, xs):
    order = ["0-17", "18-39", "40-59", "60-79", "80+"]
    got = values(spark, sorted(xs), gold.age_bracket(F.col("v")), "double")
    assert [order.index(b) for b in got] == sorted(order.index(b) for b in got)


def test_grouped_median_keeps_values_without_a_group(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, None), (2, None, None), (3, None, 4.0)], "i int, k double, v double")
    rule = {"group_source_column": "k", "group_bands": [{"label": "a", "upper_exclusive": 5}, {"label": "b", "upper_exclusive": ".inf"}]}
    out, report = ops.impute_grouped_median(df, "v", rule)
    assert [r.v for r in out.orderBy("i").collect()] == [1.0, 1.0, None, 4.0]
    assert report == [{"band": "a", "median": 1.0, "missing": 1}, {"band": "b", "median": None, "missing": 0}]
    out, _ = ops.impute_grouped_median(df, "v", rule | {"fallback": "global_median"})
    assert [r.v for r in out.orderBy("i").collect()] == [1.0, 1.0, 1.0, 4.0]


def test_label_and_gender(spark):
    assert values(spark, ["Positive", "Negative", "2", "odd"], ops.encode_label(F.col("v"), TEXT, TargetSpec("v", "Positive", "Negative"))) == [1, 0, 2, None]
    assert values(spark, [2, 1], ops.encode_label(F.col("v"), T.LongType(), TargetSpec("v", 1, 2)), "long") == [0, 1]
    assert values(spark, ["0", "1", "2", None, "x"], gold.clamp_gender(F.col("v"), TEXT)) == [0, 1, -1, -1, -1]


def test_domain(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "z"), (None, None)], "n double, s string")
    assert ops.domain_violations(df, [ColumnSpec("n", "ordinal", domain=[1, 2]), ColumnSpec("s", "nominal", domain=["a"])]) == {"s": ["z"]}


def test_statistics(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0), (2, float("nan"))], "a long, b double")
    assert stats.duplicate_rows(df).first()[0] == 1 and stats.missing_cells(df).first()[:] == (4, 2, 3)
    assert stats.column_counts(df)["b"] == {"rows": 4, "nulls": 3, "distinct": 1, "whole": True}
    assert stats.numeric_stats(df, "b").first()["std"] is None
    assert stats.missing_cells(df.filter("a > 9")).first()[:] == (0, 2, 0)


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "label int")
    assert gold.summary({"x": empty}).first()[:] == ("x", 0, None, None)


def test_row_numbers(spark):
    got = keys.with_row_number(spark.range(0, 1000, 1, 5), "n", 11).collect()
    assert [r.n for r in got] == list(range(11, 1011)) and [r.id for r in got] == list(range(1000))
    assert [r.n for r in keys.numbered_by(spark.range(50).select((50 - F.col("id")).alias("k")), "n", "k").orderBy("k").collect()] == list(range(1, 51))
    assert keys.with_row_number(spark.range(0), "n").collect() == []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shuffled = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("k"), F.lit("x" * 50).alias("wide"))
        many = keys.numbered_by(shuffled, "n", "k")
        assert many.rdd.getNumPartitions() > 1 and [r.n for r in many.orderBy("k").collect()] == list(range(1, 3001))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('﻿i;d;s;e;A/G Ratio;b\n1;1.5;"a;b";;\t?;True\n2;?;"";;?;False\n', encoding="utf-8")
    df = read_delimited(spark, str(path), ";", ["?"])
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields] == [("i", "bigint"), ("d", "double"), ("s", "string"), ("e", "double"), ("A/G Ratio", "string"), ("b", "boolean")]
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, "a;b", None, "\t?", True), (2, None, None, None, None, False)]
    assert sniff_delimiter(spark, str(path)) == (";", "HIGH")


def test_names_and_yaml(tmp_path):
    assert [snake(x) for x in ("A/G Ratio", "MDVP:Jitter(%)", "  ", "a__b")] == ["a_g_ratio", "mdvp_jitter", "col", "a_b"]
    import yaml

    from starloom import load_profile

    path = tmp_path / "p.yaml"
    path.write_text("name: p\nsource: {path: x}\ntarget: {column: t}\ncolumns:\n- {source: a, type: binary, mapping: {Yes: 1, No: 0}}\n- {source: f, type: binary, mapping: {true: 1, false: 0}}\n")
    profile = load_profile(path)
    assert profile.columns[0].mapping == {"Yes": 1, "No": 0} and profile.columns[1].mapping == {True: 1, False: 0, "Yes": 1, "No": 0}
    assert parse_profile({"name": "p", "source": {"path": "x", "delimiter": "\t"}, "target": {"column": "t"}, "columns": []}).delimiter == "\t"
    with pytest.raises(KeyError, match="path"):
        parse_profile({"name": "p", "source": {}, "target": {"column": "t"}})
    assert yaml.safe_load("a: yes") == {"a": True}
    with pytest.raises(ValueError, match="odd"):
        ColumnSpec("a", "odd")
    with pytest.raises(TypeError, match="wrong"):
        parse_profile({"name": "p", "source": {"path": "x"}, "target": {"column": "t"}, "columns": [{"source": "a", "type": "binary", "wrong": 1}]})
    with pytest.raises(ValueError, match="collide"):
        parse_profile({"name": "p", "source": {"path": "x"}, "target": {"column": "t"}, "columns": [{"source": "a b", "type": "binary"}, {"source": "a-b", "type": "binary"}]})


def test_stream(spark, tmp_path):
    profile = parse_profile({"name": "p", "source": {"path": "x"}, "target": {"column": "y", "positive_value": "yes", "negative_value": "no"}, "columns": [{"source": "a", "type": "numeric", "scale_factor": 2}, {"source": "y", "type": "binary"}], "cleaning": {"drop_rows_where": [{"column": "a", "operator": "lt", "value": 0}]}, "hierarchies": [{"source_column": "a", "new_column": "b", "bands": [{"label": "l", "upper_exclusive": 5}, {"label": "h", "upper_exclusive": ".inf"}]}]})
    spark.createDataFrame([(1.0, " yes"), (-1.0, "no"), (9.0, "no"), (3.0, "?")], "a double, y string").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("a double, y string").parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        append_stream(rows, profile, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("a", "b", "label").collect())) == [(2.0, "l", 1), (18.0, "h", 0)]


def test_quantiles(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice([None, float(rng.randrange(40)), rng.random()])) for _ in range(500)] + [("c", None), ("d", 2.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    some = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    want = {k: np.quantile([v for x, v in rows if x == k and v is not None], some).tolist() for k in "abd"}
    for cells in (65536, 16):
        got = group_quantiles(df, "k", "v", some, cells)
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert quantiles(df.filter("k = 'c'"), {"x": F.col("v")}, [0.5]) == {"x": [None]} and quantiles(df, {}, [0.5]) == {}


def test_domain_violations_of_several_columns(spark):
    df = spark.createDataFrame([(f"a{i:02}", f"b{i}") for i in range(40)], "a string, b string")
    found = ops.domain_violations(df, [ColumnSpec("a", "nominal", domain=["a00"]), ColumnSpec("b", "nominal", domain=[f"b{i}" for i in range(39)])])
    assert found == {"a": [f"a{i:02}" for i in range(1, 21)], "b": ["b39"]}


def test_first_values(spark):
    rows = [(None if i < 3 else i, "x" if i % 2 else None, float("nan")) for i in range(20)]
    got = stats.first_values(spark.createDataFrame(rows, "a int, b string, c double"), ["a", "b", "c"])
    assert got == {"a": [3, 4, 5, 6, 7], "b": ["x"] * 5, "c": []}


def exact(xs, p):
    xs, place = sorted(xs), p * (len(xs) - 1)
    low, high = xs[math.floor(place)], xs[math.ceil(place)]
    return low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high


def test_quantiles_of_hard_doubles(spark):
    """All magnitudes, infinities, zeros of both signs, neighbours in the last bit: the very values come out."""
    rng = random.Random(3)
    data = {
        "wide": [rng.gauss(0, 1) * 10.0 ** rng.randint(-320, 300) for _ in range(800)],
        "near": [1 + rng.randrange(1 << 30) * 2.0**-52 for _ in range(400)],
        "tiny": [5e-324 * rng.randrange(400) for _ in range(200)],
        None: [0.0, -0.0, float("inf"), float("-inf"), 1.5, -3.0] * 9,
        "skew": [7.0] * 900 + [8.0],
    }
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("wide", float("nan")), ("wide", None)]
    some = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = group_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(3), "k", "v", some)
    for k, vs in data.items():
        np.testing.assert_array_equal(got[k], [exact(vs, p) for p in some])


def test_quantiles_shuffle_counters_only(spark):
    """The first pass of a hundred thousand values sends some thousand counters."""
    df = spark.range(0, 100_000, 1, 4).select(F.lit("k").alias("key"), F.rand(1).alias("v"), F.lit(0.0).alias("low"), F.lit(0).cast("long").alias("before"))
    assert _histogram(df, _octave(F.col("v"))).count() < 2000


def test_distinct_and_duplicate_counts_survive_collisions(spark, monkeypatch):
    """Hashes of three values only: nearly all values collide, and the counts are still exact."""
    rows = [(i % 50, None if i % 7 == 0 else f"t{i % 11}", -0.0 if i % 2 else 0.0) for i in range(300)] + [(1, None, 0.0), (None, "t1", 0.0), (None, None, float("nan"))] * 2
    df = spark.createDataFrame(rows, "a int, b string, c double")
    want = {"a": len({r[0] for r in rows} - {None}), "b": len({r[1] for r in rows} - {None}), "c": 1}
    same = [tuple(None if x != x else x for x in r) for r in rows]
    plan = df.select(F.explode(F.array("a")).alias("x"))
    assert {c: r["distinct"] for c, r in stats.column_counts(df).items()} == want and plan is not None
    assert stats.duplicate_rows(df).first()[0] == len(rows) - len(set(same))
    real = stats.hashes
    monkeypatch.setattr(stats, "hashes", lambda *cs: (F.pmod(real(*cs)[0], F.lit(3)), real(*cs)[1]))
    assert {c: r["distinct"] for c, r in stats.column_counts(df).items()} == want
    assert stats.duplicate_rows(df).first()[0] == len(rows) - len(set(same))
    monkeypatch.setattr(stats, "hashes", lambda *cs: (F.lit(1).cast("long"), F.lit(1).cast("long")))
    assert stats.duplicate_rows(df).first()[0] == len(rows) - len(set(same))


def test_first_of_each_keeps_few_rows(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2]), rng.randrange(100), i) for i in range(3000)]
    got = stats.first_of_each(spark.createDataFrame(rows, "k int, v int, i int").repartition(5), "k", ["v", "i"], 4)
    want = [(k, v, i, at) for key in (None, 1, 2) for at, (k, v, i) in enumerate(sorted([r for r in rows if r[0] == key], key=lambda r: r[1:])[:4], 1)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert stats.first_of_each(spark.createDataFrame([], "k int, v int"), "k", ["v"], 4).collect() == []


def test_first_values_of_sparse_columns(spark):
    df = spark.range(0, 5000, 1, 4).select(F.when(F.col("id") % 900 == 899, F.col("id")).alias("rare"), F.when(F.col("id") == 4000, F.lit("x")).alias("once"), "id")
    assert stats.first_values(df, df.columns, head=50) == {"rare": [899, 1799, 2699, 3599, 4499], "once": ["x"], "id": [0, 1, 2, 3, 4]}


def test_describe_runs_as_many_jobs_for_many_columns(spark):
    """Statistics of 3 and of 24 columns take equally many passes, and no aggregate multiplies the rows."""
    from starloom.inference.engine import describe

    df = spark.range(0, 400, 1, 2)
    jobs = []
    for n in (3, 24):
        wide = df.select(*[(F.col("id") * (i + 1) % (5 if i % 3 == 0 else 90)).alias(f"c{i}") if i % 3 < 2 else F.concat(F.lit("t"), F.col("id")).alias(f"c{i}") for i in range(n)])
        spark.sparkContext.setJobGroup(f"describe {n}", "")
        found = describe(wide)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"describe {n}")))
        assert found["c0"].listed == [0, 1, 2, 3, 4] and found["c1"].distinct == 45 and (found["c1"].min, found["c1"].max) == (0, 88) and len(found["c2"].samples) == 12
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 12  # a pass more for percentiles at most, not one for each column


def test_numbers_do_not_depend_on_ranges(spark):
    """Ranges of a composite key with nulls and texts; any number of them gives the order of the keys."""
    rng = random.Random(2)
    keys_ = sorted({(rng.choice([None, 1, 2]), rng.choice([None, "a", 'q"\\', "é", ""]), rng.randrange(300)) for _ in range(900)}, key=lambda k: (k[0] is not None, k[0] or 0, k[1] is not None, (k[1] or "").encode(), k[2]))
    rows = [(*k, i) for i, k in enumerate(keys_, 1)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "part int, b string, c long, want int").repartition(5)
    for ranges in (1, 3, 8, 20):
        got = keys.numbered_by(df, "n", "part", "b", "c", ranges=ranges)
        assert got.columns == [*df.columns, "n"] and all(r["n"] == r["want"] for r in got.collect())


def test_orphans(spark):
    """Rows are told by the filter or by the parent itself, whatever the filter's size."""
    rng = random.Random(4)
    child = [(rng.choice([None, rng.randrange(400)]), i, "w") for i in range(2000)]
    parent = [(rng.randrange(300),) for _ in range(250)] + [(None,)]
    known = {p[0] for p in parent}
    df = spark.createDataFrame(child, "k int, i int, word string")
    want = sorted(c for c in child if c[0] is not None and c[0] not in known)
    for words in (1, 1 << 20):
        gold_words, gold.MOST_WORDS = gold.MOST_WORDS, words
        try:
            assert sorted(map(tuple, gold.orphans(df, spark.createDataFrame(parent, "p long"), "k", "p").collect())) == want
        finally:
            gold.MOST_WORDS = gold_words
    assert gold.orphans(df, spark.createDataFrame([], "k int"), "k").count() == sum(c[0] is not None for c in child)


@pytest.mark.parametrize(("split", "eol", "long"), [(200, "\n", 0), (500, "\r\n", 0), (300, "\n", 900)])
def test_quoted_breaks_by_splits(spark, tmp_path, split, eol, long):
    """Many tasks give the rows and the order of one: quotes, delimiters and breaks in cells, records over many splits."""
    rng, text = random.Random(split), io.StringIO()
    out = csv.writer(text, lineterminator=eol)
    out.writerow(["a", "b c", "d"])
    cell = lambda: "x\n" * rng.randint(1, long) if long and rng.random() < 0.02 else "".join(rng.choices("ab ,\"\n'", k=rng.randrange(9))) if rng.random() < 0.5 else str(rng.randrange(99))
    for i in range(250):
        out.writerow([i, cell(), cell()])
    (tmp_path / "x.csv").write_text(text.getvalue(), newline="")
    (tmp_path / "plain.csv").write_text("a,b\n1,x\n2,\"y,z\"\n")
    settings_ = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1"}
    for k, v in settings_.items():
        spark.conf.set(k, v)
    try:
        got = read_text_columns(spark, str(tmp_path / "x.csv"), ",", True)
        one = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(str(tmp_path / "x.csv"))
        assert got.columns == one.columns and got.rdd.getNumPartitions() > 5 and one.rdd.getNumPartitions() == 1
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in one.collect()]
        assert [tuple(r) for r in read_text_columns(spark, str(tmp_path / "plain.csv"), ",", True).collect()] == [("1", "x"), ("2", "y,z")]
    finally:
        for k in settings_:
            spark.conf.unset(k)


def test_states_of_lines():
    assert ends_inside('1,"a', False, ",") and not ends_inside('b",2', True, ",") and ends_inside('b"",2', True, ",")
    assert not ends_inside('5" pipe,x', False, ",") and not ends_inside('"a""b"', False, ",") and ends_inside('x;"', False, ";") and not ends_inside('x,"', False, ";")


def shuffled(spark):
    """Bytes that the session's tasks have written to shuffles."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    told = context.statusStore().executorList(False)
    return sum(told.apply(i).totalShuffleWrite() for i in range(told.size()))


def test_only_hashes_are_shuffled(spark, monkeypatch, tmp_path):
    """Duplicate rows move a hash a row, distinct counts a hash a value, and stored tables nothing."""
    n = 30_000
    df = spark.range(n).select("id", (F.col("id") * 7).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("a"), F.sha2((-F.col("id")).cast("string"), 512).alias("b"))
    for dealt in (False, True):
        if dealt:
            monkeypatch.setattr(stats, "IN_A_TASK", 1000)
        before = shuffled(spark)
        assert stats.duplicate_rows(df).first()[0] == 0
        assert 0 < shuffled(spark) - before < 30 * n
        before = shuffled(spark)
        assert {c: r["distinct"] for c, r in stats.column_counts(df, ["id", "k"]).items()} == {"id": n, "k": n}
        assert 0 < shuffled(spark) - before < 2 * 34 * n
    before = shuffled(spark)
    gold.stored_by_key(df, "stored_where_it_is", str(tmp_path / "stored"), "id", 4)
    assert shuffled(spark) == before and spark.table("stored_where_it_is").count() == n
    joined = spark.table("stored_where_it_is").hint("merge").join(spark.table("stored_where_it_is").select("id", F.col("k").alias("l")), "id")
    before = shuffled(spark)
    assert joined.agg(F.count_if(F.col("k") == F.col("l"))).first()[0] == n and shuffled(spark) - before < 10_000


def test_values_that_are_dealt_count_the_same(spark, monkeypatch):
    """Columns of many values are dealt by hash but for their frequent values; counts, extremes and duplicates stay exact."""
    rows = [(i, float(i % 700), f"t{i if i % 3 else 0}", i if i % 2 else None) for i in range(2000)] + [(5, 5.0, "t5", 5)] * 300
    df = spark.createDataFrame(rows, "a long, b double, c string, d int")
    plain, repeated = stats.column_records(df), stats.duplicate_rows(df).first()[0]
    assert repeated == len(rows) - len(set(rows))
    assert {c: r["distinct"] for c, r in plain.items()} == {c: len({r[j] for r in rows} - {None}) for j, c in enumerate("abcd")}
    monkeypatch.setattr(stats, "IN_A_TASK", 100)
    monkeypatch.setattr(stats, "SAMPLED", 1000)
    assert stats.column_records(df) == plain and stats.duplicate_rows(df).first()[0] == repeated
