"""Golden prompt texts for the risk-table specs (values from FIXTURES.md §2.4)."""

from riskloom.datasets import CCFRAUD, CCFRAUD_DDL, GERMAN, GERMAN_DDL, TRAVEL, TRAVEL_DDL, prompt_records

GERMAN_ROW1 = ("A11", 6, "A34", "A43", 1169, "A65", "A75", 4, "A93", "A101", 4, "A121", 67, "A143", "A152", 2,
               "A173", 1, "A192", "A201", 1)


def test_ccfraud_row_text(spark):
    df = spark.createDataFrame([(2, 15, 1, 3000, 23, 1, 2, 0)], CCFRAUD_DDL)
    r = prompt_records(df, CCFRAUD).first()
    assert r.text == ("The client is a female, the state number is 15, the number of cards is 1, the credit balance "
                      "is 3000, the number of transactions is 23, the number of international transactions is 1, "
                      "the credit limit is 2.")
    assert (r.answer, r.gold, list(r.choices)) == ("good", 0, ["good", "bad"])
    assert r.normal_query.endswith("'" + r.text + "' \nAnswer:")
    assert r.chat_query.startswith("Human: \n") and r.chat_query.endswith(" \nAnswer:\n\nAssistant: \n")


def test_travel_row_text(spark):
    df = spark.createDataFrame([("EPX", "Travel Agency", "Online", "2 way Comprehensive Plan", "No", 6, "CHINA", 33.0, 0.0, 35)],
                               TRAVEL_DDL)
    r = prompt_records(df, TRAVEL).first()
    assert r.text == ("The insurance company has attributes: Agency: EPX, Agency Type: Travel Agency, Distribution "
                      "Channel: Online, Product Name: 2 way Comprehensive Plan, Duration: 6, Destination: CHINA, Net "
                      "Sales: 33.0, Commission: 0.0, Age: 35.")
    assert (r.answer, r.gold) == ("no", 1)


def test_german_row_text_and_notes(spark):
    df = spark.createDataFrame([GERMAN_ROW1], GERMAN_DDL)
    r = prompt_records(df, GERMAN, add_debias=True, add_counter_factual=True).first()
    assert r.text.startswith(
        "The state of Status of existing checking account is smaller than 0 DM. The state of Duration in month is 6. "
        "The state of Credit history is critical account or other credits existing (not at this bank). The state of "
        "Purpose is radio or television. The state of Credit amount is 1169. ")
    assert r.text.endswith("The state of foreign worker is yes. ")
    assert (r.answer, r.gold) == ("good", 0)
    assert " \nNote: " + GERMAN.prompt.debias_prompt in r.normal_query
    assert r.normal_query.endswith(GERMAN.prompt.counter_factual_prompt + " \nAnswer:")


def test_unknown_label_falls_into_negative_answer(spark):
    row = list(GERMAN_ROW1)
    row[20] = 7
    r = prompt_records(spark.createDataFrame([tuple(row)], GERMAN_DDL), GERMAN).first()
    assert (r.answer, r.gold) == ("bad", 1)


def test_unknown_code_raises(spark):
    import pytest
    row = list(GERMAN_ROW1)
    row[0] = "A19"
    with pytest.raises(Exception, match="unknown code"):
        prompt_records(spark.createDataFrame([tuple(row)], GERMAN_DDL), GERMAN).collect()


def _german_rows(n):
    import random
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        row = list(GERMAN_ROW1)
        row[8] = rnd.choice(["A91", "A92", "A93", "A94"])
        row[12] = rnd.randint(19, 75)
        row[19] = "A201" if rnd.random() < 0.95 else "A202"
        row[20] = 1 if rnd.random() < 0.7 else 2
        rows.append(tuple(row) + (i,))
    return rows


def test_prompt_dataset_german_sizes(spark):
    from pyspark.sql import functions as F
    from riskloom.datasets import prompt_dataset
    df = spark.createDataFrame(_german_rows(1000), GERMAN_DDL + ", row_key LONG")
    ds = prompt_dataset(df, GERMAN, "row_key")
    sizes = {r.split: r.n for r in ds.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {"train": 700, "dev": 100, "test": 300}
    ids = {r.split: (r.lo, r.hi) for r in ds.groupBy("split").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}
    assert ids == {"train": (0, 699), "dev": (0, 99), "test": (0, 299)}


def test_bias_slices_first_n_per_group(spark):
    from pyspark.sql import functions as F
    from riskloom.datasets import bias_slices, german_groups
    rows = _german_rows(300)
    df = german_groups(spark.createDataFrame(rows, GERMAN_DDL + ", row_key LONG"))
    sl = bias_slices(df, {"gender": F.col("gender_grp"), "age": F.col("age_grp"), "foreign": F.col("foreign_grp")}, ["row_key"], 50)
    got = {}
    for r in sl.collect():
        got.setdefault((r.slice, r.slice_group), []).append(r.row_key)
    recode = {"A91": 0, "A92": 1, "A93": 0, "A94": 0, "A95": 1}
    exp_gender = {}
    for r in rows:
        exp_gender.setdefault(str(recode[r[8]]), []).append(r[21])
    for g, keys in exp_gender.items():
        assert sorted(got[("gender", g)]) == keys[:50]
    foreign = [r[21] for r in rows if r[19] == "A202"]
    assert sorted(got[("foreign", "A202")]) == foreign[:50]
    assert len(got[("age", "<= 45")]) == 50


def test_australian_text_and_query(spark):
    from riskloom.datasets import AUSTRALIAN, AUSTRALIAN_DDL
    row = (*map(float, (0, 21.67, 11.5, 1, 5, 3, 0, 1, 1, 11, 1, 2, 0, 1)), 1)
    r = prompt_records(spark.createDataFrame([row], AUSTRALIAN_DDL), AUSTRALIAN).first()
    assert r.text == ("The client has attributes: A1: 0.0, A2: 21.67, A3: 11.5, A4: 1.0, A5: 5.0, A6: 3.0, A7: 0.0, A8: 1.0, "
                      "A9: 1.0, A10: 11.0, A11: 1.0, A12: 2.0, A13: 0.0, A14: 1.0.")
    assert r.normal_query == AUSTRALIAN.prompt.instruction + " \nText: " + r.text + " \n Answer:"
    assert (r.answer, r.gold) == ("good", 0)


def test_lending_text_with_percent_and_nan(spark):
    from riskloom.datasets import LENDING, LENDING_DDL
    vals = [123.45, "debt_consolidation", "Individual", 13.56, 500.0, 10000.0, 2500.0, 0.0, 1.0, None, "C", 9.0, 45.2,
            20.0, 690.0, 694.0, "CA", "10+ years", "RENT", "Verified", 55000.0, "Charged Off"]
    r = prompt_records(spark.createDataFrame([tuple(vals)], LENDING_DDL), LENDING).first()
    assert r.text.startswith("The client has attributes as follows: The state of Installment is 123.45. The state of "
                             "Loan Purpose is debt_consolidation. The state of Loan Application Type is Individual. "
                             "The state of Interest Rate is 13.56%. ")
    assert "The state of Mortgage Accounts is nan. " in r.text
    assert "The state of Revolving Utilization Rate is 45.2%. " in r.text
    assert r.text.endswith("The state of Annual Income is 55000.0.")
    assert (r.answer, r.gold) == ("bad", 1)


def test_header_spec_fixed_precision(spark):
    from riskloom.datasets import header_spec
    df = spark.createDataFrame([(1, 0.4991, 1.0)], "target int, `ROA(C)` double, `Net Income Flag` double")
    spec = header_spec(df, "target", (0,), ("no", "yes"), "Predict bankruptcy.", "The client has attributes: ", kind="fixed3")
    r = prompt_records(df, spec).first()
    assert r.text == "The client has attributes: ROA(C): 0.499, Net Income Flag: 1.000."
    assert (r.answer, r.gold) == ("yes", 1)


def test_creditcard_fixed_precision_text(spark):
    from riskloom.datasets import CREDITCARD, CREDITCARD_DDL
    row = tuple([0.144, -0.273] + [0.0] * 26 + [6.99, 0])
    r = prompt_records(spark.createDataFrame([row], CREDITCARD_DDL), CREDITCARD).first()
    assert r.text.startswith("The client has attributes: V1: 0.144, V2: -0.273, V3: 0.000, ")
    assert r.text.endswith("V28: 0.000, Amount: 6.990.")
    assert (r.answer, r.gold, list(r.choices)) == ("no", 0, ["no", "yes"])


def test_porto_conditional_precision(spark):
    from riskloom.datasets import porto_spec
    df = spark.createDataFrame([(7, 1, 2.0, 0.61237, -1.0)], "id int, target int, ps_ind_01 double, ps_reg_03 double, ps_car_11 double")
    r = prompt_records(df, porto_spec(df)).first()
    assert r.text == "The client has attributes: ps_ind_01: 2.0, ps_reg_03: 0.61, ps_car_11: -1.0."
    assert (r.answer, r.gold) == ("yes", 0)


def test_travel_prose_variant(spark):
    from riskloom.datasets import TRAVEL_DDL, travel_desc_records
    df = spark.createDataFrame([("CWT", "Travel Agency", "Online", "Rental Vehicle Excess Insurance", "No", 79, "ITALY",
                                 -19.8, 11.88, 41)], TRAVEL_DDL)
    r = travel_desc_records(df).first()
    from riskloom.datasets import TRAVEL_DESC_EXAMPLE
    assert r.text == TRAVEL_DESC_EXAMPLE
    assert r.query.endswith(" \nText: " + r.text + " \nAnswer:")
    assert (r.answer, r.gold) == ("No", 1)


def test_customs_header_spec(spark):
    from riskloom.datasets import customs_spec
    df = spark.createDataFrame([(97061800, "2020-01-01", 30, 372254.4, 2, 1)],
                               "`Declaration ID` long, `Date` string, `Office ID` int, `Item Price` double, Fraud int, `Critical Fraud` int")
    r = prompt_records(df, customs_spec(df)).first()
    assert r.text == ("This customs import declaration has attributes: Declaration ID: 97061800, Date: 2020-01-01, "
                      "Office ID: 30, Item Price: 372254.4.")
    assert (r.answer, r.gold, list(r.choices)) == ("yes", 1, ["no", "yes"])


def test_polish_from_arff(spark, tmp_path):
    from riskloom.datasets import POLISH, POLISH_NAMES
    from riskloom.sources import readers as rd
    header = ["@relation polish"] + [f"@attribute Attr{i} numeric" for i in range(1, 65)] + ["@attribute class {0,1}", "@data"]
    vals = ["-0.046186"] + ["?"] + ["1.5"] * 62
    p = tmp_path / "1year.arff"
    p.write_text("\n".join(header + [",".join(vals + ["1"])]) + "\n")
    df = rd.arff(spark, [str(p)], rd.arff_ddl(header))
    r = prompt_records(df, POLISH).first()
    assert len(POLISH_NAMES) == 64
    assert r.text.startswith("The client has attributes: net profit / total assets: -0.046186, "
                             "total liabilities / total assets: None, working capital / total assets: 1.5, ")
    assert r.text.endswith("sales / fixed assets: 1.5.")
    assert (r.answer, r.gold) == ("yes", 1)


def test_travel_prompt_and_cleaning(spark):
    from riskloom import datasets as ds
    rows = [("EPX", "Travel Agency", "Online", "2 way Comprehensive Plan", "No", 6, "CHINA", 33.0, 0.0, None, 35),
            ("C2B", "Airlines", "Online", "Bronze Plan", "Yes", 4000, "SINGAPORE", 60.0, 15.0, "F", 118),
            ("CWT", "Travel Agency", "Online", "Rental", "No", -1, "ITALY", -19.8, 11.88, "M", 41),
            ("CWT", "Travel Agency", "Online", "Rental", "No", 0, "ITALY", -19.8, 11.88, "M", 41)]
    clean = ds.travel_clean(spark.createDataFrame(rows, ds.TRAVEL_RAW_DDL))
    assert clean.columns == [c.split()[0] for c in ds.TRAVEL_DDL.split(", ")]
    got = {r.agency + str(i): r for i, r in enumerate(clean.orderBy("age", "duration").collect())}
    mean = int((6 + 731 - 1 + 0) / 4)
    assert sorted((r.duration, r.age) for r in got.values()) == sorted([(6, 35), (731, 99), (mean, 41), (mean, 41)])
    r = prompt_records(clean, ds.TRAVEL, add_debias=True).where("text LIKE '%EPX%'").first()
    assert r.text == ("The insurance company has attributes: Agency: EPX, Agency Type: Travel Agency, Distribution Channel: Online, "
                      "Product Name: 2 way Comprehensive Plan, Duration: 6, Destination: CHINA, Net Sales: 33.0, Commission: 0.0, Age: 35.")
    head = r.normal_query[:r.normal_query.index("For instance")]
    assert head.startswith("Identify the claim status") and head.endswith("Age: Age of insured (numerical). \n") and head.count("(categorical). \n") == 5
    assert "should be classified as 'no'. \nText: '" + r.text + "' \nNote: When evaluating" in r.normal_query and r.normal_query.endswith(" \nAnswer:")
    assert (r.answer, r.gold, r.task, r.example.example2.output) == ("no", 1, "fraudulent claim status", "yes")


def test_bias_study_specs(spark):
    from riskloom import datasets as ds
    from riskloom.operators import fairness as fa
    cc = spark.createDataFrame([(g, 0 if i < n else 1) for g, n in ((2, 64), (1, 66)) for i in range(70)], "gender int, fraudRisk int")
    travel = spark.createDataFrame([(a, "No" if i < 58 else "Yes") for a in (30, 60) for i in range(60)], "age int, target string")
    assert round(cc.agg(fa.disparate_impact(cc, "fraudRisk", ds.CCFRAUD_FAIRNESS[0])).first()[0], 6) == 0.969697
    travel = ds.travel_groups(travel)
    assert travel.agg(fa.disparate_impact(travel, "target", ds.TRAVEL_FAIRNESS[0])).first()[0] == 1.0
    assert [s.protected_col for s in ds.GERMAN_FAIRNESS] == ["foreign_grp", "age_grp", "gender_grp"]
