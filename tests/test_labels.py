"""Labels and numbers, one column at a time."""

import pytest
from pyspark.sql import functions as F

from axonspark.functions import labels as L
from axonspark.functions.numeric import number, shown


def one(spark, f, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(f(F.col("v"))).collect()]


def test_regions(spark):
    assert one(spark, L.region, ["AL_R", "al(L)", "LH", "MB(+ACA)(R)", "GNG", "", None]) == ["AL", "AL", "LH", "MB", "", "", ""]


def test_hemispheres_treat_underscores_as_wildcards(spark):
    values = ["AL_R", "AL(L)", "AL", "LH", "MB", "ALR-DC3(L)", "MB_CA_R", "x_L_y", None]
    assert one(spark, L.hemisphere, values) == ["R", "L", "L", "", "", "R", "R", "L", ""]


def test_classes(spark):
    values = ["ORN_DM1", "DM1_lPN", "lLN1", "KCg", "MBON01", "APL", "PAM05", "Kenyon cell", "xKC", "projection neuron", None]
    assert one(spark, L.cell_class, values) == ["ORN", "PN", "LN", "KC", "MBON", "APL", "DAN", "KC", "", "PN", ""]


def test_glomeruli(spark):
    values = ["ORN_DM1_R", "ORN_DM1", "DM1_lPN_R", "x DM2_ORN", "DM1_adPN", "PN_VA1", "KCg", "DM1; DM4_lPN"]
    assert one(spark, L.glomerulus, values) == ["DM1", "DM1", "DM1", "DM2", "", "VA1", "", "DM4"]


def test_sides(spark):
    values = ["ORN_DM1_R", "a-L", "R", "the RIGHT one", "left", "left side", "L;x_R", "none", None]
    assert one(spark, L.side, values) == ["R", "L", "R", "R", "L", "", "R", "", ""]


def test_relation(spark):
    df = spark.createDataFrame([("R", "R"), ("R", "L"), ("", "L"), ("R", "")], "a string, b string")
    assert [r[0] for r in df.select(L.relation(F.col("a"), F.col("b"))).collect()] == ["ipsi", "contra", "unknown", "unknown"]


def test_numbers_follow_the_float_grammar(spark):
    values = ["1", " 2.5 ", "1e3", "1_000", "-.5", "+3.", "", None, "x", "1d", "2f", "0x10", "1,000", "1__0", "_1", "inf", "-Infinity", "5\t"]
    assert one(spark, number, values) == [1.0, 2.5, 1000.0, 1000.0, -0.5, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, float("inf"), float("-inf"), 5.0]
    assert one(spark, number, ["nan"])[0] != one(spark, number, ["nan"])[0]


@pytest.mark.parametrize(("value", "text"), [(5.0, "5"), (0.1, "0.1"), (1 / 3, "0.333333333333"), (1e15, "1000000000000000"), (-2.0, "-2")])
def test_shown(value, text):
    assert shown(value) == text


def test_variants_by_token(spark):
    assert one(spark, L.cell_class_loose, ["a_KC", "KCg", "xKC", "ORN_KC", None]) == ["KC", "KC", "", "ORN", ""]
    assert one(spark, L.glomerulus_by_token, ["x; orn_DM1", "(DM2_orn)", "DM1_lPN_R", "PN_VA1", "DM1_adPN", None]) == ["DM1", "DM2", "DM1", "VA1", "", ""]
    assert one(spark, L.side_by_token, ["a_L b_R", "R", "(x-l)", "Right arm", "upright", None]) == ["L", "R", "L", "R", "", ""]
