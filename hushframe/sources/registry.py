"""Dataset registry: explicit schema, cleaning steps, target and task per name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.scalars import col, label_contains, label_map, log1p_target
from hushframe.operators import clean
from hushframe.session import stage


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    path: str
    schema: T.StructType
    clean: Callable[[DataFrame], DataFrame]
    target: str
    task: str = "classification"
    header: bool = True
    null_value: str | None = None
    smote: bool = False
    quasi_identifiers: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()


def _schema(text: Sequence[str] = (), long: Sequence[str] = (), double: Sequence[str] = (), order: Sequence[str] | None = None) -> T.StructType:
    kinds = {**{c: T.StringType() for c in text}, **{c: T.LongType() for c in long}, **{c: T.DoubleType() for c in double}}
    return T.StructType([T.StructField(c, kinds[c]) for c in (order or kinds)])


# Column names of the input files, in file order.
ADULT = (
    "age", "workclass", "fnlwgt", "education", "education.num", "marital.status", "occupation", "relationship",
    "race", "sex", "capital.gain", "capital.loss", "hours.per.week", "native.country", "income",
)
ADULT_NUMBERS = ("age", "fnlwgt", "education.num", "capital.gain", "capital.loss", "hours.per.week")
CELL_MEASURES = (
    "radius", "texture", "perimeter", "area", "smoothness", "compactness", "concavity", "concave points",
    "symmetry", "fractal_dimension",
)
CERVICAL = (
    "Age", "Number of sexual partners", "First sexual intercourse", "Num of pregnancies", "Smokes", "Smokes (years)",
    "Smokes (packs/year)", "Hormonal Contraceptives", "Hormonal Contraceptives (years)", "IUD", "IUD (years)", "STDs",
    "STDs (number)", "STDs:condylomatosis", "STDs:cervical condylomatosis", "STDs:vaginal condylomatosis",
    "STDs:vulvo-perineal condylomatosis", "STDs:syphilis", "STDs:pelvic inflammatory disease", "STDs:genital herpes",
    "STDs:molluscum contagiosum", "STDs:AIDS", "STDs:HIV", "STDs:Hepatitis B", "STDs:HPV", "STDs: Number of diagnosis",
    "STDs: Time since first diagnosis", "STDs: Time since last diagnosis", "Dx:Cancer", "Dx:CIN", "Dx:HPV", "Dx",
    "Hinselmann", "Schiller", "Citology", "Biopsy",
)
COMPAS = (
    "id", "name", "first", "last", "compas_screening_date", "sex", "dob", "age", "age_cat", "race", "juv_fel_count",
    "decile_score", "juv_misd_count", "juv_other_count", "priors_count", "days_b_screening_arrest", "c_jail_in",
    "c_jail_out", "c_case_number", "c_offense_date", "c_arrest_date", "c_days_from_compas", "c_charge_degree",
    "c_charge_desc", "is_recid", "r_case_number", "r_charge_degree", "r_days_from_arrest", "r_offense_date",
    "r_charge_desc", "r_jail_in", "r_jail_out", "violent_recid", "is_violent_recid", "vr_case_number",
    "vr_charge_degree", "vr_offense_date", "vr_charge_desc", "type_of_assessment", "decile_score.1", "score_text",
    "screening_date", "v_type_of_assessment", "v_decile_score", "v_score_text", "v_screening_date", "in_custody",
    "out_custody", "priors_count.1", "start", "end", "event", "two_year_recid",
)
COMPAS_NUMBERS = (
    "age", "juv_fel_count", "juv_misd_count", "juv_other_count", "priors_count", "days_b_screening_arrest", "is_recid",
    "two_year_recid",
)
COMPAS_KEPT = (
    "sex", "age", "age_cat", "race", "juv_fel_count", "juv_misd_count", "juv_other_count", "priors_count",
    "c_charge_degree", "two_year_recid",
)
HEART = (
    "Age", "Sex", "ChestPainType", "RestingBP", "Cholesterol", "FastingBS", "RestingECG", "MaxHR", "ExerciseAngina",
    "Oldpeak", "ST_Slope", "HeartDisease",
)
HEART_TEXT = ("Sex", "ChestPainType", "RestingECG", "ExerciseAngina", "ST_Slope")
CRIME_COLUMNS = 128
CRIME_KEYS = 5
CRIME_TARGET = "ViolentCrimesPerPop"


def _adult(df: DataFrame) -> DataFrame:
    df = clean.null_tokens(df)
    df = clean.dedup(clean.drop_columns(df, ["education", "fnlwgt"], missing_ok=False))
    return df.withColumn("income", label_contains("income", ">50K"))


def _cells(df: DataFrame) -> DataFrame:
    df = clean.drop_columns(clean.dedup(df), ["id", "Unnamed: 32"])
    return df.withColumn("diagnosis", label_map("diagnosis", {"M": 1, "B": 0}))


def _cervical(df: DataFrame) -> DataFrame:
    return clean.coerce_numeric(clean.drop_sparse_columns(clean.null_tokens(df)))


def _compas(df: DataFrame) -> DataFrame:
    return clean.arrest_window(df, "days_b_screening_arrest", "is_recid", "c_charge_degree", COMPAS_KEPT)


def _insurance(df: DataFrame) -> DataFrame:
    return clean.dedup(df).withColumn("charges", log1p_target("charges"))


def _crime(df: DataFrame) -> DataFrame:
    df = clean.drop_sparse_columns(df).drop(*[f"c{i}" for i in range(CRIME_KEYS)])
    return clean.rename_last(df, CRIME_TARGET)


SPECS: dict[str, DatasetSpec] = {
    s.name: s
    for s in (
        DatasetSpec(
            "adult", "classification/adult.csv",
            _schema([c for c in ADULT if c not in ADULT_NUMBERS], ADULT_NUMBERS, order=ADULT), _adult, "income",
            quasi_identifiers=("age", "education.num", "hours.per.week", "capital.gain", "capital.loss"),
            extra=("workclass", "occupation", "marital.status", "sex", "race"),
        ),
        DatasetSpec(
            "data", "classification/data.csv",
            _schema(
                ["diagnosis", "Unnamed: 32"], ["id"], [f"{m}_{s}" for s in ("mean", "se", "worst") for m in CELL_MEASURES],
                order=["id", "diagnosis", *[f"{m}_{s}" for s in ("mean", "se", "worst") for m in CELL_MEASURES], "Unnamed: 32"],
            ),
            _cells, "diagnosis",
        ),
        DatasetSpec(
            "cervical", "classification/kag_risk_factors_cervical_cancer.csv", _schema(CERVICAL), _cervical, "Biopsy", smote=True
        ),
        DatasetSpec(
            "compas", "classification/compas-scores-two-years.csv",
            _schema([c for c in COMPAS if c not in COMPAS_NUMBERS], (), COMPAS_NUMBERS, order=COMPAS), _compas, "two_year_recid",
        ),
        DatasetSpec(
            "creditcard", "classification/creditcard.csv",
            _schema((), ["Class"], ["Time", *[f"V{i}" for i in range(1, 29)], "Amount"],
                    order=["Time", *[f"V{i}" for i in range(1, 29)], "Amount", "Class"]),
            lambda df: clean.drop_columns(df, ["Time"], missing_ok=False), "Class",
        ),
        DatasetSpec(
            "heart", "classification/heart.csv",
            _schema(HEART_TEXT, (), [c for c in HEART if c not in HEART_TEXT], order=HEART), lambda df: df, "HeartDisease",
        ),
        DatasetSpec(
            "insurance", "regression/insurance.csv",
            _schema(["sex", "smoker", "region"], ["age", "children"], ["bmi", "charges"],
                    order=["age", "sex", "bmi", "children", "smoker", "region", "charges"]),
            _insurance, "charges", "regression",
            quasi_identifiers=("age", "bmi", "children"), extra=("sex", "smoker", "region"),
        ),
        DatasetSpec(
            "communities", "regression/communities.data",
            _schema(["c3"], (), [f"c{i}" for i in range(CRIME_COLUMNS) if i != 3], order=[f"c{i}" for i in range(CRIME_COLUMNS)]),
            _crime, CRIME_TARGET, "regression", header=False, null_value="?",
        ),
    )
}


def read_table(spark: SparkSession, spec: DatasetSpec, path: str) -> DataFrame:
    """Scan a CSV (or parquet) file with the spec's explicit schema.

    Quoted identifiers with dots stay single columns.  Parquet keeps its own types.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.schema(spec.schema).option("header", spec.header).option("mode", "PERMISSIVE")
    reader = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if spec.null_value is not None:
        reader = reader.option("nullValue", spec.null_value)
    return reader.csv(path)


def read_checked(spark: SparkSession, spec: DatasetSpec, path: str) -> tuple[DataFrame, DataFrame]:
    """Typed rows of a CSV file, and every cell or line that the schema does not fit.

    The text is read and written once, so both frames see the same bytes.  A cell that
    does not parse is null in the rows and a row (file, column, text, line) of the
    rejects; a line with too few or too many cells keeps what it has, and its own reject
    has no column.  The null token is no reject.
    """
    names = spec.schema.fieldNames()
    cells, whole = [f"_c{i}" for i in range(len(names))], "_whole"
    text = T.StructType([*[T.StructField(c, T.StringType()) for c in cells], T.StructField(whole, T.StringType())])
    reader = spark.read.schema(text).option("header", spec.header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", whole)
    # names in the header are the spec's business, not the reader's
    reader = reader.option("enforceSchema", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if spec.null_value is not None:
        reader = reader.option("nullValue", spec.null_value)
    raw = stage(reader.csv(path).select("*", F.col("_metadata.file_path").alias("_file")))
    typed = {c: F.expr(f"try_cast({c} as {f.dataType.simpleString()})") for c, f in zip(cells, spec.schema)}
    rows = raw.select(*[typed[c].alias(n) for c, n in zip(cells, names)])
    line = F.coalesce(F.col(whole), F.to_csv(F.struct(*cells)))
    bad = [
        F.when(F.col(c).isNotNull() & typed[c].isNull(), F.struct(F.lit(n).alias("column"), F.col(c).alias("text"))) for c, n in zip(cells, names)
    ]
    short = F.when(F.col(whole).isNotNull(), F.struct(F.lit(None).cast("string").alias("column"), F.col(whole).alias("text")))
    found = raw.select("_file", line.alias("line"), F.explode(F.array_compact(F.array(short, *bad))).alias("r"))
    return rows, found.select(F.col("_file").alias("file"), "r.column", "r.text", "line")


def load(spark: SparkSession, name: str, root: str) -> tuple[DataFrame, DatasetSpec]:
    """Cleaned rows with a known target."""
    if name not in SPECS:
        raise ValueError(f"no dataset is registered as {name}")
    spec = SPECS[name]
    rows = spec.clean(read_table(spark, spec, f"{root}/{spec.path}"))
    return clean.drop_null_target(rows, spec.target), spec


def with_row_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """Content key for tables without one; full copies get the same key and so the same split."""
    return df.withColumn(name, F.md5(F.to_json(F.struct(*[col(c).alias(c) for c in df.columns]))))
