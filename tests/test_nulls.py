"""Rules about missing values that differ between the source pipeline's language and SQL."""

from pyspark.sql import functions as F

from isoreach.functions import naming, nulls, text
from isoreach.operators import joins, reshape, stats
from isoreach.operators.lookup import fill_from_lookup
from isoreach.operators.ordering import exact_quantiles
from isoreach.plans import metrics, services
from isoreach.schemas import schema
from isoreach.sources import readers


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def words(spark, values):
    return spark.createDataFrame([(v,) for v in values], "t string")


def test_null_keys_match(spark):
    left = spark.createDataFrame([("walk", None, 1), ("pt", "am", 2)], "mode string, tod string, a int")
    right = spark.createDataFrame([("walk", None, 10), ("pt", "pm", 20)], "mode string, tod string, b int")
    assert rows(joins.null_safe_join(left, right, ["mode", "tod"]), "mode") == [("pt", "am", 2, None), ("walk", None, 1, 10)]
    full = rows(joins.null_safe_join(left, right, ["mode", "tod"], "full"), "mode", "tod")
    assert full == [("pt", "am", 2, None), ("pt", "pm", None, 20), ("walk", None, 1, 10)]


def test_untyped_null_is_cast_before_matching(spark):
    left = spark.createDataFrame([(1,)], "a int").withColumn("tod", nulls.typed_null("string"))
    right = spark.createDataFrame([(None, 5)], "tod string, b int")
    assert joins.null_safe_join(left, right, ["tod"]).select("b").first()[0] == 5


def test_matrix_slices_without_time_of_day_get_a_typed_null(spark):
    walk = spark.createDataFrame([(1, 2, 9)], "from_id int, to_id int, travel_time_p50 int")
    matrix = metrics.normalise_matrix({"walk": (walk, "travel_time_p50")})
    assert matrix.schema["time_of_day"].dataType.simpleString() == "string"


def test_deny_list_keeps_missing_names(spark):
    df = words(spark, ["Day Hospital", None, "General"])
    assert df.filter(nulls.lacks("t", nulls.any_of(["day (hospital|care)"]))).count() == 2


def test_membership_of_missing_is_false(spark):
    df = words(spark, ["a", None])
    assert [r[0] for r in df.select(nulls.is_in("t", ["a"])).collect()] == [True, False]


def test_not_equal_drops_missing(spark):
    assert words(spark, ["a", "b", None]).filter(F.col("t") != "a").count() == 1


def test_condition_on_missing_stays_missing(spark):
    df = spark.createDataFrame([("Secondary", None, 18), ("Secondary", 11, 18), (None, None, 18), ("Primary", None, 18)], "p string, lo int, hi int")
    primary, secondary = services.england_flags("p", "lo", "hi")
    got = [tuple(r) for r in df.select(primary, secondary).collect()]
    assert got == [(False, None), (False, True), (False, False), (True, False)]


def test_paste_writes_missing_text(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(nulls.paste(" | ", "x", "y")).first()[0] == "a | NA"
    assert df.select(nulls.paste(" | ", "x", "y", na_text=None)).first()[0] == "a"


def test_ratio_by_zero_and_bad_number_are_null(spark):
    df = spark.createDataFrame([(1.0, 0.0, "x"), (1.0, 2.0, "7")], "a double, b double, t string")
    assert [tuple(r) for r in df.select(nulls.ratio("a", "b"), nulls.to_int("t")).collect()] == [(None, None), (0.5, 7)]


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(0.00005,), (0.00015,)], "v double")
    assert [r[0] for r in df.select(F.bround("v", 4)).collect()] == [0.0, 0.0002]


def test_statistics_skip_and_count_missing(spark):
    df = spark.createDataFrame([("k", 1.0), ("k", None), ("k", 3.0), ("empty", None)], "k string, v double")
    got = {r["k"]: r for r in stats.distribution(df, ["k"], "v", "s").collect()}
    assert (got["k"]["s_mean"], got["k"]["s_median"], got["k"]["s_n_null"]) == (2.0, 2.0, 1)
    assert (got["empty"]["s_mean"], got["empty"]["s_median"], got["empty"]["s_n_null"]) == (None, None, 1)


def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([], "a int")
    assert stats.column_totals(df, ["a"]).first()[0] == 0


def test_count_keeps_the_missing_group(spark):
    got = {r[0]: r[1] for r in stats.count_by(words(spark, ["a", None, None]), "t").collect()}
    assert got == {"a": 1, None: 2}


def test_reader_trims_and_knows_na(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n  x ,1\nNA,NA\n"",\n')
    read = readers.read_csv(spark, str(tmp_path), schema("k string, v double"))
    assert sorted([tuple(r) for r in read.collect()], key=str) == [("x", 1.0), (None, None), (None, None)]
    blanks = readers.read_keeping_blanks(spark, str(tmp_path), schema("k string, v double"))
    assert blanks.filter(F.col("k") == "").count() == 2


def test_blank_is_missing_empty_or_spaces(spark):
    assert [r[0] for r in words(spark, [None, "", "  ", "a"]).select(nulls.is_blank("t")).collect()] == [True, True, True, False]


def test_letter_test_splits_rows_exactly(spark):
    df = words(spark, ["E01", "123", None, "_", ""])
    assert df.filter(nulls.has_letter("t")).count() + df.filter(~nulls.has_letter("t")).count() == 5
    assert df.filter(nulls.has_letter("t")).count() == 1


def test_first_character(spark):
    assert words(spark, ["S010"]).select(text.first_letter("t")).first()[0] == "S"


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 10)], "k string, v double")
    assert tuple(exact_quantiles(df, ["k"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).first()) == ("a", 1.75, 2.5, 4.75)


def test_repeated_lookup_keys(spark):
    """Plain lookups repeat rows for repeated keys; the tiered lookup keeps one entry per code."""
    facts = spark.createDataFrame([("A",), ("B",)], "postcode string")
    codes = spark.createDataFrame(
        [("A", "E1", 1.0, 1.0, None, "E"), ("A", "E2", 2.0, 2.0, "2020", "E"), ("B", "W1", 3.0, 3.0, "2019", "W")],
        "pcds string, lsoa11 string, lat double, long double, doterm string, oscty string",
    )
    assert fill_from_lookup(facts, codes, "postcode", "pcds", ["lsoa11"]).count() == 3
    assert rows(services.locate(facts, codes).select("postcode", "lsoa11"), "postcode") == [("A", "E1"), ("B", "W1")]


def test_live_code_without_coordinates_falls_back(spark):
    facts = spark.createDataFrame([("A",)], "postcode string")
    codes = spark.createDataFrame(
        [("A", "E1", None, None, None, "E"), ("A", "E2", 2.0, 2.0, "2020", "E")],
        "pcds string, lsoa11 string, lat double, long double, doterm string, oscty string",
    )
    assert services.locate(facts, codes).select("lsoa11").first()[0] == "E2"


def test_clean_names():
    raw = ["PracticeCode", "2023 Balance (%)", "a.b", "a b", "LSOA11CD", "Type of Establishment (name)", "DataZone"]
    cleaned = naming.unique_names([naming.snake_case(c) for c in raw])
    assert cleaned == ["practice_code", "x2023_balance_percent", "a_b", "a_b_2", "lsoa11cd", "type_of_establishment_name", "data_zone"]


def test_sentence_case_and_labels(spark):
    assert words(spark, ["gp_practices"]).select(text.service_label("t")).first()[0] == "Gp\npractices"
    assert words(spark, ["main bua CITY"]).select(text.sentence_case("t")).first()[0] == "Main bua city"


def test_numbers_as_text(spark):
    df = spark.createDataFrame([(1234567.0,), (0.00001,), (120618.5,)], "v double")
    assert [r[0] for r in df.select(text.fixed_point("v", 12)).collect()] == ["1234567", "0.00001", "120618.5"]
    assert df.select(text.spaced_thousands("v")).first()[0] == "1 234 567"


def test_names_split_at_the_last_underscore():
    assert naming.split_access_name("access_employment_mining_2_105_pct") == ("employment_mining_2", 105)


def test_unpivot_of_measures(spark):
    df = spark.createDataFrame([("z", 1.0, 2.0, 3.0)], "geo_code string, access_a_1_15 double, access_a_1_15_pct double, nearest_a_1 double")
    assert rows(reshape.access_to_long(df, ["geo_code"]), "service") == [("z", "a_1", 15, 1.0)]
    assert rows(reshape.access_to_long(df, ["geo_code"], pct=True), "service") == [("z", "a_1", 15, 2.0)]
    assert rows(reshape.nearest_to_long(df, ["geo_code"]), "service") == [("z", "a_1", 3.0)]
