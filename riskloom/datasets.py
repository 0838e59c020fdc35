"""Dataset specs for the risk tables (German credit, ccFraud, Travel insurance)
and the prompt-record builder that turns any such table into instruction
prompts with gold labels.

``prompt_records(df, spec)`` is one lazy projection: text rendering, answer,
gold index, choices, few-shot example, task and the two bias notes.  The
split-local ``id`` is attached at the sink with ``sampling.local_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import features as ft
from .operators import prompts as pr
from .specs import GERMAN_PROMPT, DatasetSpec, FairnessSpec, FieldSpec, PromptSpec, RenderSpec

# German credit feature names (display text, in column order).
GERMAN_NAMES = (
    "Status of existing checking account", "Duration in month", "Credit history", "Purpose",
    "Credit amount", "Savings account or bonds", "Present employment since",
    "Installment rate in percentage of disposable income", "Personal status and sex",
    " Other debtors or guarantors", "Present residence since", "Property", "Age in years",
    "Other installment plans", "Housing", "Number of existing credits at this bank", "Job",
    "Number of people being liable to provide maintenance for", "Telephone", "foreign worker",
)

# German credit code book (column position -> code -> phrase).
GERMAN_CODEBOOK = {
    0: {"A11": "smaller than 0 DM", "A12": "bigger than 0 DM but smaller than 200 DM",
        "A13": "bigger than 200 DM OR salary assignments for at least 1 year", "A14": "no checking account"},
    2: {"A30": "no credits taken or all credits paid back duly", "A31": "all credits at this bank paid back duly",
        "A32": "existing credits paid back duly till now", "A33": "delay in paying off in the past",
        "A34": "critical account or other credits existing (not at this bank)"},
    3: {"A40": "car (new)", "A41": "car (used)", "A42": "furniture or equipment", "A43": "radio or television",
        "A44": "domestic appliances", "A45": "repairs", "A46": "education", "A47": "vacation", "A48": "retraining",
        "A49": "business", "A410": "others"},
    5: {"A61": "smaller than 100 DM", "A62": "bigger than 100 smaller than  500 DM",
        "A63": "bigger than 500 smaller than 1000 DM", "A64": "bigger than 1000 DM",
        "A65": "unknown or no savings account"},
    6: {"A71": "unemployed", "A72": "smaller than 1 year", "A73": "bigger than 1  smaller than 4 years",
        "A74": "bigger than 4  smaller than 7 years", "A75": "bigger than 7 years"},
    8: {"A91": "male: divorced or separated", "A92": "female: divorced or separated or married",
        "A93": "male and single", "A94": "male and married or widowed", "A95": "female and single"},
    9: {"A101": "none", "A102": "co-applicant", "A103": "guarantor"},
    11: {"A121": "real estate", "A122": "building society savings agreement or life insurance",
         "A123": "car or other", "A124": "unknown or no property"},
    13: {"A141": "bank", "A142": "stores", "A143": "none"},
    14: {"A151": "rent", "A152": "own", "A153": "for free"},
    16: {"A171": "unemployed or unskilled or non-resident", "A172": "unskilled or resident",
         "A173": "skilled employee or official",
         "A174": "management or self-employed or highly qualified employee or officer"},
    18: {"A191": "none", "A192": "yes, registered under the customers name"},
    19: {"A201": "yes", "A202": "no"},
}

# Positional schema of the German rows (c0..c19 features, c20 target 1 good / 2 bad).
GERMAN_DDL = ", ".join(
    f"c{i} {'STRING' if i in GERMAN_CODEBOOK else 'INT'}" for i in range(20)
) + ", c20 INT"

GERMAN = DatasetSpec(
    name="german",
    fields=tuple(
        FieldSpec(f"c{i}", GERMAN_NAMES[i], "str" if i in GERMAN_CODEBOOK else "int", codebook=GERMAN_CODEBOOK.get(i))
        for i in range(20)
    ),
    label_col="c20",
    positive_labels=(1,),
    render=RenderSpec(template="The state of {name} is {value}", sep=". ", end=". "),
    prompt=GERMAN_PROMPT,
    test_plus_dev=True,
)

# ccFraud field texts and prompt texts.
CCFRAUD_DDL = "gender INT, state INT, cardholder INT, balance INT, numTrans INT, numIntlTrans INT, creditLine INT, fraudRisk INT"
CCFRAUD_TEXTS = ("male or female", "state number", "number of cards", "credit balance", "number of transactions",
                 "number of international transactions", "credit limit")
CCFRAUD_EXAMPLE1 = ("The client is a female, the state number is 25, the number of cards is 1, the credit balance is 7000, "
                    "the number of transactions is 16, the number of international transactions is 0, the credit limit is 6.")
CCFRAUD_EXAMPLE2 = ("The client is a male, the state number is 3, the number of cards is 4, the credit balance is 150, "
                    "the number of transactions is 320, the number of international transactions is 45, the credit limit is 12.")
CCFRAUD = DatasetSpec(
    name="ccfraud",
    fields=(FieldSpec("gender", "", decode=("1", "is a male", "is a female")),)
    + tuple(FieldSpec(c.split()[0], t, "int") for c, t in zip(CCFRAUD_DDL.split(", ")[1:7], CCFRAUD_TEXTS[1:])),
    label_col="fraudRisk",
    positive_labels=(0,),
    render=RenderSpec(template="the {name} is {value}", sep=", ", end=".", prefix="The client "),
    prompt=PromptSpec(
        instruction=("Detect the credit card fraud with the following financial profile. Respond with only 'good' or "
                     "'bad', and do not provide any additional information. For instance, '" + CCFRAUD_EXAMPLE1
                     + "' should be classified as 'good'."),
        choices=("good", "bad"),
        task="credit card fraud risk",
        debias_prompt=("When evaluating credit card fraud risk, please ensure that your assessment is free from any "
                       "biases related to gender. Focus solely on the financial profile provided."),
        counter_factual_prompt=("Your assessment must stay the same even if gender changes. Stay neutral and base "
                                "your fraud risk assessment only on clear financial evidence."),
        example1=(CCFRAUD_EXAMPLE1, "good"),
        example2=(CCFRAUD_EXAMPLE2, "bad"),
    ),
)

# Travel insurance columns, display names, descriptions and prompt
# text (the spelling of the examples is part of the text).
TRAVEL_RAW_DDL = ("agency STRING, agency_type STRING, channel STRING, product STRING, target STRING, duration INT, "
                  "destination STRING, net_sales DOUBLE, commission DOUBLE, gender STRING, age INT")
TRAVEL_DDL = ("agency STRING, agency_type STRING, channel STRING, product STRING, target STRING, duration INT, "
              "destination STRING, net_sales DOUBLE, commission DOUBLE, age INT")
TRAVEL_NAMES = (("agency", "Agency"), ("agency_type", "Agency Type"), ("channel", "Distribution Channel"),
                ("product", "Product Name"), ("duration", "Duration"), ("destination", "Destination"),
                ("net_sales", "Net Sales"), ("commission", "Commission"), ("age", "Age"))
TRAVEL_DESCRIPTIONS = ("Name of agency", "Type of travel insurance agencies", "Distribution channel of travel insurance agencies",
                       "Name of the travel insurance products", "Duration of travel", "Destination of travel",
                       "Amount of sales of travel insurance policies", "Commission received for travel insurance agency",
                       "Age of insured")
TRAVEL_EXAMPLE_NO = ("The insurance company has attributes: Agency: CBH, Agency Type: Travel Agency, Distribution Chanel: "
                     "Offline, Product Name: Comprehensive Plan, Duration: 186, Destination: MALAYSIA, Net Sales: -29, "
                     "Commision: 9.57, Age: 81.")
TRAVEL_EXAMPLE_YES = ("The insurance company has attributes: Agency: C2B, Agency Type: Airlines, Distribution Channel: Online, "
                      "Product Name: Bronze Plan, Duration: 18, Destination: SINGAPORE, Net Sales: 60.0, Commission: 15.0, "
                      "Age: 36.")
TRAVEL_INTRO = ("Identify the claim status of insurance companies using the following table attributes for travel insurance "
                "status. Respond with only 'yes' or 'no', and do not provide any additional information. And the table "
                "attributes including 5 categorical attributes and 4 numerical attributes are as follows: \n")
TRAVEL_MOST_DAYS, TRAVEL_LEAST_DAYS, TRAVEL_MOST_AGE, TRAVEL_AGE_THRESHOLD = 731, 1, 99, 45
_TRAVEL_KINDS = {"duration": "int", "age": "int", "net_sales": "float", "commission": "float"}
_TRAVEL_FIELDS = tuple(FieldSpec(c, n, _TRAVEL_KINDS.get(c, "str"), description=d, type_tag="numerical" if c in _TRAVEL_KINDS else "categorical")
                       for (c, n), d in zip(TRAVEL_NAMES, TRAVEL_DESCRIPTIONS, strict=True))
TRAVEL = DatasetSpec(
    name="travel",
    fields=_TRAVEL_FIELDS,
    label_col="target",
    positive_labels=("Yes",),
    render=RenderSpec(template=" {name}: {value}", sep=",", end=".", prefix="The insurance company has attributes:"),
    prompt=PromptSpec(
        instruction=pr.field_header(_TRAVEL_FIELDS, TRAVEL_INTRO) + f"For instance, '{TRAVEL_EXAMPLE_NO}' should be classified as 'no'.",
        choices=("yes", "no"),
        task="fraudulent claim status",
        debias_prompt=("When evaluating the claim status of insurance companies, please ensure that your assessment is free "
                       "from any biases related to age. Focus solely on the insurance attributes provided."),
        counter_factual_prompt=("Your assessment must stay the same even if age changes. Stay neutral and base your claim "
                                "status judgment only on the insurance attributes provided."),
        example1=(TRAVEL_EXAMPLE_NO, "no"),
        example2=(TRAVEL_EXAMPLE_YES, "yes"),
    ),
)


def travel_clean(df: DataFrame) -> DataFrame:
    """Cleaning in front of the Travel prompts: durations over 731 days become
    731, those below 1 the truncated mean of all (capped) durations, ages over 99
    become 99, and the gender column goes."""
    t = ft.impute_clip(df, "duration", TRAVEL_MOST_DAYS, TRAVEL_LEAST_DAYS, "_days")
    t = t.withColumn("duration", F.col("_days").cast("int")).withColumn("age", F.least("age", F.lit(TRAVEL_MOST_AGE)))
    return t.select(*[c for c in df.columns if c != "gender"])


# Protected groups of the three bias studies: label, favourable value, group
# column (see ``*_groups``), privileged and unprivileged value.
GERMAN_FAIRNESS = (
    FairnessSpec("label", 1, "foreign_grp", "A202", "A201"),
    FairnessSpec("label", 1, "age_grp", "<= 45", "> 45"),
    FairnessSpec("label", 1, "gender_grp", 0, 1),
)
CCFRAUD_FAIRNESS = (FairnessSpec("fraudRisk", 0, "gender", 1, 2),)
TRAVEL_FAIRNESS = (FairnessSpec("target", "No", "age_grp", f"<= {TRAVEL_AGE_THRESHOLD}", f"> {TRAVEL_AGE_THRESHOLD}"),)


def travel_groups(df: DataFrame) -> DataFrame:
    return df.withColumn("age_grp", ft.threshold_bucket("age", TRAVEL_AGE_THRESHOLD))


def prompt_records(df: DataFrame, spec: DatasetSpec, add_debias: bool = False, add_counter_factual: bool = False,
                   row_key: str | None = None, keep: tuple = ()) -> DataFrame:
    """Prompt record per row: ``text``, ``normal_query``, ``chat_query``,
    ``answer``, ``choices``, ``gold``, ``example``, ``task`` and bias notes
    (plus ``row_key`` when given).  Unknown labels fall into the negative
    answer, as a plain if/else does."""
    text = pr.render_fields(spec.fields, spec.render)
    out = pr.prompt_columns(df, text, spec.prompt, add_debias, add_counter_factual)
    answer, choices, gold = ft.answer_gold(spec.label_col, spec.positive_labels, spec.prompt.choices)
    out = out.withColumn("answer", answer).withColumn("gold", gold)
    keep_cols = ["text", "normal_query", "chat_query", "answer", "choices", "gold", "example", "task",
                 "debias_prompt", "counter_factual_prompt"]
    cols = ([row_key] if row_key else []) + list(keep) + keep_cols
    return out.select(*cols)


def german_groups(df: DataFrame) -> DataFrame:
    """Protected-group columns of the German rows: gender recode, age
    threshold, foreign worker."""
    from .specs import GERMAN_AGE_THRESHOLD, GERMAN_GENDER_RECODE
    return df.withColumn("gender_grp", ft.recode("c8", GERMAN_GENDER_RECODE)) \
        .withColumn("age_grp", ft.threshold_bucket("c12", GERMAN_AGE_THRESHOLD)) \
        .withColumn("foreign_grp", F.col("c19"))


def prompt_dataset(df: DataFrame, spec: DatasetSpec, key: str, add_debias: bool = False,
                   add_counter_factual: bool = False) -> DataFrame:
    """Table -> prompt dataset in one lazy plan: exact seeded split
    (``spec.split_ratios``), the German "test := test + dev" option, split-local
    ids (0-based in key order) and the prompt record columns.  Write it with
    ``sources.readers.write_jsonl(..., partition_by=["split"])``."""
    from .operators import sampling as sp
    ratios = spec.split_ratios[:2]
    split = sp.split_exact(df, key, seed=spec.seed, ratios=ratios)
    if spec.test_plus_dev:
        split = split.unionByName(split.where(F.col("split") == "dev").withColumn("split", F.lit("test")))
    split = sp.local_id(split, "split", [key])
    return prompt_records(split, spec, add_debias, add_counter_factual, row_key=key, keep=("split", "id"))


def bias_slices(df: DataFrame, groups: dict, order: list, n: int = 50) -> DataFrame:
    """First ``n`` rows per group for several protected groupings (``{slice
    name: group Column}``), tagged with the slice name; rows with no group
    are dropped.  Each slice is a per-group limit applied before the shuffle."""
    from .operators import sampling as sp
    out = None
    for name, grp in groups.items():
        part = sp.group_head_n(df.withColumn("_slice_grp", grp), "_slice_grp", order, n) \
            .withColumn("slice", F.lit(name)).withColumnRenamed("_slice_grp", "slice_group")
        part = part.withColumn("slice_group", F.col("slice_group").cast("string"))
        out = part if out is None else out.unionByName(part)
    return out


# Australian credit: attribute names are the rule "A1".."A14"; the rows pass
# through one numeric matrix, so every value prints as a float ("0.0").
AUSTRALIAN_DDL = ", ".join(f"A{i} DOUBLE" for i in range(1, 15)) + ", label INT"
# Australian prompt text.
AUSTRALIAN = DatasetSpec(
    name="australian",
    fields=tuple(FieldSpec(f"A{i}", f"A{i}", "float") for i in range(1, 15)),
    label_col="label",
    positive_labels=(1,),
    render=RenderSpec(template=" {name}: {value}", sep=",", end=".", prefix="The client has attributes:"),
    prompt=PromptSpec(
        instruction=("Assess the creditworthiness of a customer using the following table attributes for financial "
                     "status. Respond with either 'good' or 'bad'. And all the table attribute names including 8 "
                     "categorical attributes and 6 numerical attributes and values have been changed to meaningless "
                     "symbols to protect confidentiality of the data. For instance, 'The client has attributes: A1: 0, "
                     "A2: 21.67, A3: 11.5, A4: 1, A5: 5, A6: 3, A7: 0, A8: 1, A9: 1, A10: 11, A11: 1, A12: 2, A13: 0, "
                     "A14: 1.', should be classified as 'good'."),
        choices=("good", "bad"), quote_text=False, answer_cue=" \n Answer:"),
)

# Lending Club columns (in order) and display names.
LENDING_COLUMNS = ("installment", "purpose", "application_type", "int_rate", "last_pymnt_amnt", "loan_amnt",
                   "revol_bal", "delinq_2yrs", "inq_last_6mths", "mort_acc", "grade", "open_acc", "revol_util",
                   "total_acc", "fico_range_low", "fico_range_high", "addr_state", "emp_length", "home_ownership",
                   "verification_status", "annual_inc")
LENDING_NAMES = ("Installment", "Loan Purpose", "Loan Application Type", "Interest Rate", "Last Payment Amount",
                 "Loan Amount", "Revolving Balance", "Delinquency In 2 years", "Inquiries In 6 Months",
                 "Mortgage Accounts", "Grade", "Open Accounts", "Revolving Utilization Rate", "Total Accounts",
                 "Fico Range Low", "Fico Range High", "Address State", "Employment Length", "Home Ownership",
                 "Verification Status", "Annual Income")
_LENDING_STRINGS = {"purpose", "application_type", "grade", "addr_state", "emp_length", "home_ownership",
                    "verification_status"}
LENDING_DDL = ", ".join(f"{c} {'STRING' if c in _LENDING_STRINGS else 'DOUBLE'}" for c in LENDING_COLUMNS) + ", loan_status STRING"
LENDING = DatasetSpec(
    name="lending",
    fields=tuple(FieldSpec(c, n, "str" if c in _LENDING_STRINGS else "float", suffix="%" if i in (3, 12) else "",
                           null_as="nan")
                 for i, (c, n) in enumerate(zip(LENDING_COLUMNS, LENDING_NAMES))),
    label_col="loan_status",
    positive_labels=("Fully Paid",),
    render=RenderSpec(template="The state of {name} is {value}", sep=". ", end=".",
                      prefix="The client has attributes as follows: "),
    prompt=PromptSpec(
        instruction=("Assess the client's loan status based on the following loan records from Lending Club. Respond "
                     "with only 'good' or 'bad', and do not provide any additional information. For instance, 'The "
                     "client has a stable income, no previous debts, and owns a property.' should be classified as "
                     "'good'."),
        choices=("good", "bad")),
)
LENDING_CLASSES = ("Fully Paid", "Charged Off")


def header_spec(df: DataFrame, label_col: str, positive: tuple, choices: tuple, instruction: str, prefix: str,
                kind: str | None = None, exclude: tuple = (), name: str = "table") -> DatasetSpec:
    """Spec whose feature names are the table header (``name: value`` list,
    ``, `` separated, ending ``.``), as for header-named risk tables; ``kind``
    forces one number rendering (``fixed3``, ``short4_fixed2``) for numeric
    columns, otherwise the declared type decides."""
    fields = []
    for f in pr.header_fields(df, exclude=(label_col,) + tuple(exclude)):
        k = kind if (kind and f.kind in ("int", "float")) else f.kind
        fields.append(FieldSpec(f.col, f.display, k))
    return DatasetSpec(name=name, fields=tuple(fields), label_col=label_col, positive_labels=positive,
                       render=RenderSpec(template="{name}: {value}", sep=", ", end=".", prefix=prefix),
                       prompt=PromptSpec(instruction=instruction, choices=choices))


# Credit-card fraud: V1..V28 (by rule) and Amount, rendered "name: %.3f".
CREDITCARD_COLUMNS = tuple(f"V{i}" for i in range(1, 29)) + ("Amount",)
CREDITCARD_DDL = ", ".join(f"{c} DOUBLE" for c in CREDITCARD_COLUMNS) + ", Class INT"
# Credit-card fraud prompt text.
CREDITCARD_EXAMPLE = ("The client has attributes: V1: 0.144, V2: 0.358, V3: 1.220, V4: 0.331, V5: -0.273, V6: 0.429, "
                      "V7: -0.307, V8: -0.577, V9: 0.116, V10: -0.337, V11: 1.016, V12: 1.043, V13: -0.527, V14: 0.160, "
                      "V15: -0.951, V16: -0.452, V17: 0.166, V18: -0.446, V19: 0.036, V20: -0.275, V21: 0.768, "
                      "V22: -0.051, V23: -0.180, V24: 0.067, V25: 0.741, V26: 0.477, V27: 0.152, V28: 0.201, Amount: 6.990.")
CREDITCARD = DatasetSpec(
    name="creditcard",
    fields=tuple(FieldSpec(c, c, "fixed3") for c in CREDITCARD_COLUMNS),
    label_col="Class",
    positive_labels=(0,),
    render=RenderSpec(template="{name}: {value}", sep=", ", end=".", prefix="The client has attributes: "),
    prompt=PromptSpec(
        instruction=("Detect the credit card fraud using the following financial table attributes. Respond with only "
                     "'yes' or 'no', and do not provide any additional information. Therein, the data contains 28 "
                     "numerical input variables V1, V2, ..., and V28 which are the result of a PCA transformation and "
                     "1 input variable Amount which has not been transformed with PCA. The feature 'Amount' is the "
                     "transaction Amount, this feature can be used for example-dependant cost-sensitive learning. "
                     "For instance, '" + CREDITCARD_EXAMPLE + "' should be classified as 'no'."),
        choices=("no", "yes")),
)

# Instruction texts of the header-named risk tables.
TAIWAN_INSTRUCTION = (
    "Predict whether the company will face bankruptcy based on the financial profile attributes provided in the "
    "following text. Respond with only 'no' or 'yes', and do not provide any additional information. \nFor "
    "instance, 'The client has attributes:  ROA(C) before interest and depreciation before interest: 0.499, ..., "
    "Net Income Flag: 1.000,  Equity to Liability: 0.044.' should be classified as 'no'.")
PORTO_INSTRUCTION = (
    "Identify whether or not to files a claim for the auto insurance policy holder using the following table "
    "attributes about individual financial profile. Respond with only 'yes' or 'no', and do not provide any "
    "additional information. And the table attributes that belong to similar groupings are tagged as such in the "
    "feature names (e.g., ind, reg, car, calc). In addition, feature names include the postfix bin to indicate "
    "binary features and cat to indicate categorical features. Features without these designations are either "
    "continuous or ordinal. Values of -1 indicate that the feature was missing from the observation. For instance, "
    "'The client has attributes: ps_ind_01: 1.0, ps_ind_02_cat: 2.0, ps_ind_03: 0.0, ..., ps_calc_18_bin: 0.0, "
    "ps_calc_19_bin: 0.0, ps_calc_20_bin: 0.0.' should be classified as 'no'.")


def taiwan_spec(df: DataFrame, label_col: str = "target") -> DatasetSpec:
    """Bankruptcy table: header names, ``%.3f`` values, label 0 -> 'no'."""
    return header_spec(df, label_col, (0,), ("no", "yes"), TAIWAN_INSTRUCTION, "The client has attributes: ",
                       kind="fixed3", name="taiwan")


def porto_spec(df: DataFrame, label_col: str = "target", exclude: tuple = ("id",)) -> DatasetSpec:
    """Auto-insurance claims: header names, short values kept, others
    ``%.2f``; label 1 -> 'yes' (choices yes, no)."""
    return header_spec(df, label_col, (1,), ("yes", "no"), PORTO_INSTRUCTION, "The client has attributes: ",
                       kind="short4_fixed2", exclude=exclude, name="porto")


# Travel insurance prose variant (free text with re-ordered
# fields; the channel quote is left open as in the source).
TRAVEL_DESC_TEMPLATE = (
    "A policyholder aged {age} chosen product '{product}' of the insurance company '{agency}' through sales channel "
    "'{channel} to travel to destination '{destination}'. The type of insurance is '{agency_type}', with an effective "
    "period of {duration}, and the company recorded the net sales and commission of the insurance as {net_sales} "
    "and {commission}.")
TRAVEL_DESC_EXAMPLE = (
    "A policyholder aged 41 chosen product 'Rental Vehicle Excess Insurance' of the insurance company 'CWT' through "
    "sales channel 'Online to travel to destination 'ITALY'. The type of insurance is 'Travel Agency', with an "
    "effective period of 79, and the company recorded the net sales and commission of the insurance as -19.8 and 11.88.")
TRAVEL_DESC_INSTRUCTION = (
    "Identify the claim status of insurance companies using the records of travel insurance attributes. Respond with "
    "either 'Yes' or 'No' (Do not return 'Good' or 'Bad'). For instance: '" + TRAVEL_DESC_EXAMPLE
    + "', should be classified as 'No'.")


def travel_desc_records(df: DataFrame) -> DataFrame:
    """Travel prose prompts: the raw label is the answer (choices Yes, No),
    the text is appended unquoted and followed by `` \\nAnswer:``."""
    from .functions.text import py_str
    kinds = dict((c, k) for c, k in (("duration", "int"), ("age", "int"), ("net_sales", "float"), ("commission", "float")))
    values = {c: py_str(c, kinds.get(c, "str")) for c, _ in TRAVEL_NAMES}
    text = pr.prose(TRAVEL_DESC_TEMPLATE, values)
    query = F.concat(F.lit(TRAVEL_DESC_INSTRUCTION + " \nText: "), text, F.lit(" \nAnswer:"))
    gold = F.when(F.col("target") == "Yes", F.lit(0)).otherwise(F.lit(1))
    return df.select(text.alias("text"), query.alias("query"), F.col("target").alias("answer"),
                     F.array(F.lit("Yes"), F.lit("No")).alias("choices"), gold.alias("gold"))


# Customs declaration instruction text.
CUSTOMS_INSTRUCTION = (
    "Identify the provided customs import declaration information to determine whether it constitutes customs fraud "
    "that attempts to reduce customs duty or not. The answer must be 'no' or 'yes', and do not provide any additional "
    "information. This Import Declaration consists of 20 data attributes, including Declaration ID, Date, Office ID, "
    "Process type, Import type, Import use, Payment type, Mode of transport, Declarant ID, Importer ID, Seller ID, "
    "Courier ID, HS6 code, Country of departure, Country of origin, Tax rate, Tax type, Country of origin indicator, "
    "Net mass and Item price. For instance, 'This customs import declaration has attributes: Declaration ID: "
    "97061800, Date: 2020-01-01, Office ID: 30, Process Type: B, ..., Item Price: 372254.4.' should be categorized "
    "as 'no'.")


def customs_spec(df: DataFrame, label_col: str = "Fraud", exclude: tuple = ("Critical Fraud",)) -> DatasetSpec:
    """Customs declarations: header names, values as Python prints them,
    label 0 -> 'no', any other value -> 'yes' (choices no, yes)."""
    return header_spec(df, label_col, (0,), ("no", "yes"), CUSTOMS_INSTRUCTION,
                       "This customs import declaration has attributes: ", exclude=exclude, name="customs")


# Polish bankruptcy attribute names (Attr1..Attr64, in order;
# one name appears twice in the source list and is kept as is).
POLISH_NAMES = (
    "net profit / total assets", "total liabilities / total assets", "working capital / total assets",
    "current assets / short-term liabilities",
    "[(cash + short-term securities + receivables - short-term liabilities) / (operating expenses - depreciation)] * 365",
    "retained earnings / total assets", "EBIT / total assets", "book value of equity / total liabilities",
    "sales / total assets", "equity / total assets",
    "(gross profit + extraordinary items + financial expenses) / total assets",
    "gross profit / short-term liabilities", "(gross profit + depreciation) / sales",
    "(gross profit + interest) / total assets",
    "(total liabilities * 365) / (gross profit + depreciation)",
    "(gross profit + depreciation) / total liabilities",
    "total assets / total liabilities", "gross profit / total assets", "gross profit / sales",
    "(inventory * 365) / sales",
    "sales (n) / sales (n-1)", "profit on operating activities / total assets", "net profit / sales",
    "gross profit (in 3 years) / total assets",
    "(equity - share capital) / total assets", "(net profit + depreciation) / total liabilities",
    "profit on operating activities / financial expenses", "working capital / fixed assets",
    "logarithm of total assets",
    "(total liabilities - cash) / sales", "(total liabilities - cash) / sales",
    "(current liabilities * 365) / cost of products sold", "operating expenses / short-term liabilities",
    "operating expenses / total liabilities", "profit on sales / total assets", "total sales / total assets",
    "(current assets - inventories) / long-term liabilities", "constant capital / total assets",
    "profit on sales / sales",
    "(current assets - inventory - receivables) / short-term liabilities",
    "total liabilities / ((profit on operating activities + depreciation) * (12/365))",
    "profit on operating activities / sales",
    "rotation receivables + inventory turnover in days", "(receivables * 365) / sales",
    "net profit / inventory",
    "(current assets - inventory) / short-term liabilities", "(inventory * 365) / cost of products sold",
    "EBITDA (profit on operating activities - depreciation) / total assets",
    "EBITDA (profit on operating activities - depreciation) / sales", "current assets / total liabilities",
    "short-term liabilities / total assets", "(short-term liabilities * 365) / cost of products sold)",
    "equity / fixed assets", "constant capital / fixed assets", "working capital",
    "(sales - cost of products sold) / sales",
    "(current assets - inventory - short-term liabilities) / (sales - gross profit - depreciation)",
    "total costs /total sales", "long-term liabilities / equity", "sales / inventory", "sales / receivables",
    "(short-term liabilities *365) / sales", "sales / short-term liabilities", "sales / fixed assets",
)
POLISH_INSTRUCTION = (
    "Predict whether the company will face bankruptcy based on the financial profile attributes provided in the "
    "following text. Respond with only 'no' or 'yes', and do not provide any additional information. \nFor instance, "
    "'The client has attributes: net profit / total assets: -0.046186, ..., sales / short-term liabilities: 5.7063, "
    "sales / fixed assets: 1.3882.' should be classified as 'no'.")
POLISH = DatasetSpec(
    name="polish",
    # ARFF '?' is read as a missing value and printed as None
    fields=tuple(FieldSpec(f"Attr{i + 1}", n, "float", null_as="None") for i, n in enumerate(POLISH_NAMES)),
    label_col="class",
    positive_labels=("0",),
    render=RenderSpec(template="{name}: {value}", sep=", ", end=".", prefix="The client has attributes: "),
    prompt=PromptSpec(instruction=POLISH_INSTRUCTION, choices=("no", "yes")),
)
