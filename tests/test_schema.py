"""Names, labels, missing values, scaling and encoding."""

import math

import pytest
from pyspark.sql import functions as F

from silolens.operators import scale, schema


def test_first_alias_in_column_order_wins(spark):
    df = spark.createDataFrame([(1.0, 0, 2.0)], ["a", " Machine failure ", "target"])
    out = schema.normalize_columns(df)
    assert out.columns == ["a", "target"]
    assert out.first()["target"] == 0 and dict(out.dtypes)["target"] == "int"
    with pytest.raises(ValueError, match="no label column"):
        schema.normalize_columns(spark.createDataFrame([(1,)], ["a"]))


def test_flag_names_the_type_even_without_label(spark):
    df = spark.createDataFrame([(0, 0, 1), (1, 1, 1), (0, 0, 0)], ["target", "HDF", "PWF"])
    got = [r["Failure Type"] for r in schema.derive_failure_type(df).collect()]
    assert got == ["Power Failure", "Heat Dissipation Failure", "No Failure"]
    plain = spark.createDataFrame([(1,), (0,)], ["target"])
    assert [r["Failure Type"] for r in schema.derive_failure_type(plain).collect()] == ["Failure", "No Failure"]


def test_missing_counts_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, t string")
    assert schema.missing_counts(df, ["x", "t"]).first().asDict() == {"x": 2, "t": 1}
    with pytest.raises(ValueError, match="missing values"):
        schema.assert_no_missing(df, ["x", "t"])


def test_normalize_schema_end_to_end(spark):
    df = spark.createDataFrame([(1, "L1", "L", 3.0, 1, 0)], ["UDI", "Product ID", " Type", "x ", "Target", "TWF"])
    out = schema.normalize_schema(df, ["x", "Type"])
    assert out.columns == ["Type", "x", "target", "TWF", "Failure Type"]


def test_constant_column_and_round_trip(spark):
    df = spark.createDataFrame([(1.0, 5.0, "a"), (3.0, 5.0, "c"), (5.0, 5.0, "b")], "x double, k double, t string")
    fitted = scale.fit(df, ["x", "k"], ["t"])
    assert fitted.numeric["k"] == (5.0, 1.0)
    assert fitted.numeric["x"] == (3.0, pytest.approx(math.sqrt(8 / 3)))
    assert fitted.feature_names == ["x", "k", "t_b", "t_c"]
    assert scale.Preprocessor.from_table(fitted.to_table(spark), ["x", "k", "t"]) == fitted
    scaled = scale.transform(df, fitted, ["t"])
    back = scale.inverse_transform(scaled, fitted, ["t"]).orderBy("t").collect()
    want = [("a", 1.0, 5.0, 0.0, 0.0), ("b", 5.0, 5.0, 1.0, 0.0), ("c", 3.0, 5.0, 0.0, 1.0)]
    assert [r["t"] for r in back] == ["a", "b", "c"]
    assert [list(r)[1:] for r in back] == [pytest.approx(list(w)[1:]) for w in want]


def test_unseen_category_fails(spark):
    fitted = scale.fit(spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, t string"), ["x"], ["t"])
    new = spark.createDataFrame([(1.0, "z")], "x double, t string")
    with pytest.raises(Exception, match="unseen category"):
        scale.transform(new, fitted, []).collect()


def test_too_many_categories(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("t"))
    with pytest.raises(ValueError, match="distinct values"):
        scale.sorted_categories(df, "t", limit=10)


def test_snapping_prefers_the_first_pattern_on_ties(spark):
    fitted = scale.Preprocessor({}, {"t": ["a", "b", "c"]})
    df = spark.createDataFrame([(1, 0.5, 0.2), (2, 0.9, 0.9), (3, 0.1, 0.8)], "id int, t_b double, t_c double")
    got = [tuple(r) for r in scale.inverse_transform(df, fitted, ["id"]).orderBy("id").collect()]
    assert got == [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 1.0)]


def test_moments_merge_to_the_whole(spark):
    rows = [(float(i * i % 17), None if i % 5 == 0 else float(i), "abc"[i % 3], "xy"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "p double, q double, s string, t string")
    fitted = scale.fit(df, ["p", "q"], ["s", "t"])
    want = {r["feature"]: (r["mean"], r["std"]) for r in scale.scaler_stats(df, ["p", "q"]).collect()}
    assert fitted.categories == {"s": ["a", "b", "c"], "t": ["x", "y"]}
    for c in ("p", "q"):
        assert fitted.numeric[c] == pytest.approx(want[c])
    with pytest.raises(ValueError, match="no values"):
        scale.fit(df.where("false"), ["p"], ["s"])
