"""Registry of dirty-table datasets: where each lies, how it is read, what is derived."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.numeric import parse_percent, parse_thousands, safe_ln
from lexiloom.operators.prep import clean_names, composite_key, derive_boolean, join_required, recode
from lexiloom.roles import ColumnRoles
from lexiloom.sources.delimited import scan_csv, scan_csv_skip, scan_tagged_files
from lexiloom.sources.derived import materialize

# Dwelling types by code.
DWELLING_TYPES = {
    20: "1-STORY 1946 & NEWER ALL STYLES",
    30: "1-STORY 1945 & OLDER",
    40: "1-STORY W/FINISHED ATTIC ALL AGES",
    45: "1-1/2 STORY - UNFINISHED ALL AGES",
    50: "1-1/2 STORY FINISHED ALL AGES",
    60: "2-STORY 1946 & NEWER",
    70: "2-STORY 1945 & OLDER",
    75: "2-1/2 STORY ALL AGES",
    80: "SPLIT OR MULTI-LEVEL",
    85: "SPLIT FOYER",
    90: "DUPLEX - ALL STYLES AND AGES",
    120: "1-STORY PUD (Planned Unit Development) - 1946 & NEWER",
    150: "1-1/2 STORY PUD - ALL AGES",
    160: "2-STORY PUD - 1946 & NEWER",
    180: "PUD - MULTILEVEL - INCL SPLIT LEV/FOYER",
    190: "2 FAMILY CONVERSION - ALL STYLES AND AGES",
}
# Datasets sampled to 100,000 rows.
SAMPLED = (
    "open_payments", "traffic_violations", "federal_election", "medical_charge", "beer_reviews",
    "road_safety", "public_procurement", "crime_data", "met_objects", "drug_directory",
    "consumer_complaints", "intrusion_detection", "kickstarter_projects", "building_permits",
    "wine_reviews", "firefighter_interventions",
)
SAMPLE_ROWS = 100_000
# Name of a file's first column where it numbers the rows and is no feature.
ROW_ID = "row_id"
# Columns of the payments tables.
COMPANY = "Applicable_Manufacturer_or_Applicable_GPO_Making_Payment_Name"
AMOUNT = "Total_Amount_of_Payment_USDollars"
DISPUTE = "Dispute_Status_for_Publication"
PAYMENT_COLUMNS = [
    "Physician_Specialty", "Name_of_Associated_Covered_Drug_or_Biological1",
    "Name_of_Associated_Covered_Device_or_Medical_Supply1", COMPANY, AMOUNT, DISPUTE,
]
PAYMENT_ROLES = ColumnRoles(
    {"Physician_Specialty": "Delete", "Name_of_Associated_Covered_Drug_or_Biological1": "Delete",
     "Name_of_Associated_Covered_Device_or_Medical_Supply1": "Delete", COMPANY: "Special",
     AMOUNT: "Numerical", DISPUTE: "OneHotEncoderDense-1", "status": "y"},
    "binary", {COMPANY: "Synonyms; Overlap"})

Loader = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Dataset:
    name: str
    load: Loader
    roles: ColumnRoles | None = None

    @property
    def n_rows(self) -> int:
        return SAMPLE_ROWS if self.name in SAMPLED else -1


def plain(path: str, **options) -> Loader:
    """A delimited file without derived columns."""
    return lambda spark, root: scan_csv(spark, f"{root}/{path}", **options)


def open_payments(spark: SparkSession, root: str) -> DataFrame:
    def build() -> DataFrame:
        return scan_tagged_files(
            spark, [f"{root}/docs_payments/raw/*RSRCH_PGYR2013*.csv", f"{root}/docs_payments/raw/*GNRL_PGYR2013*.csv"],
            PAYMENT_COLUMNS, {"RSRCH": "allowed", "GNRL": "disallowed"})

    tagged = materialize(spark, f"{root}/docs_payments/output/payments", build)
    return derive_boolean(tagged, "status", "allowed")


def road_safety(spark: SparkSession, root: str) -> DataFrame:
    def keyed(file: str) -> DataFrame:
        table = scan_csv(spark, f"{root}/road_safety/raw/{file}")
        return table.withColumn("Vehicle_Index", composite_key("Accident_Index", "Vehicle_Reference"))

    joined = join_required(keyed("Casualties_2015.csv"), keyed("2015_Make_Model.csv"), "Vehicle_Index", "make",
                           "_cas", "_model")
    known = joined.filter(~F.col("Sex_of_Driver").isin(3, -1))
    return known.withColumn("Sex_of_Driver", F.col("Sex_of_Driver") - 1)


def consumer_complaints(spark: SparkSession, root: str) -> DataFrame:
    table = scan_csv(spark, f"{root}/consumer_complaints/raw/Consumer_Complaints.csv")
    return derive_boolean(table.na.drop(subset=["`Consumer disputed?`"]), "Consumer disputed?", "Yes")


def federal_election(spark: SparkSession, root: str) -> DataFrame:
    base = f"{root}/federal_election"
    names = [r[0] for r in scan_csv(spark, f"{base}/data_dict.csv").select("Column Name").collect()]
    table = scan_csv(spark, f"{base}/raw/itcont.txt", sep="|", encoding="ISO-8859-1", header=False, names=names)
    logged = table.withColumn("TRANSACTION_AMT", safe_ln(F.abs("TRANSACTION_AMT")))
    return logged.filter(F.col("TRANSACTION_AMT") > 0)


def cacao_flavors(spark: SparkSession, root: str) -> DataFrame:
    table = scan_csv(spark, f"{root}/cacao_flavors/raw/flavors_of_cacao.csv", multiline=True)
    return table.withColumn("Cocoa\nPercent", parse_percent(F.col("`Cocoa\nPercent`")))


def house_prices(spark: SparkSession, root: str) -> DataFrame:
    table = scan_csv(spark, f"{root}/house_prices/raw/train.csv", index_name=ROW_ID)
    return recode(table, "MSSubClass", DWELLING_TYPES)


def kickstarter_projects(spark: SparkSession, root: str) -> DataFrame:
    table = scan_csv(spark, f"{root}/kickstarter_projects/raw/ks-projects-201612.csv", encoding="ISO-8859-1", index_name=ROW_ID)
    ended = table.filter(F.col("`state `").isin("failed", "successful"))
    pledged = F.col("`usd pledged `").cast("string").try_cast("double")
    return derive_boolean(ended, "state ", "successful").withColumn("usd pledged ", safe_ln(pledged, 1e-10))


def building_permits(spark: SparkSession, root: str) -> DataFrame:
    table = clean_names(scan_csv(spark, f"{root}/building_permits/raw/building-permits.csv"))
    cost = F.col("ESTIMATED_COST").cast("string").try_cast("double")
    return table.withColumn("ESTIMATED_COST", safe_ln(cost, 1e-10))


def vancouver_employee(spark: SparkSession, root: str) -> DataFrame:
    table = scan_csv_skip(spark, f"{root}/vancouver_employee/raw/2017StaffRemunerationOver75KWithExpenses.csv", 3)
    return table.withColumn("Remuneration", safe_ln(parse_thousands(F.col("Remuneration"))))


_REGISTRY: dict[str, Dataset] = {}


def register(name: str, load: Loader, roles: ColumnRoles | None = None) -> None:
    """Add a dataset, or replace one."""
    _REGISTRY[name] = Dataset(name, load, roles)


def names() -> list[str]:
    return sorted(_REGISTRY)


def dataset(name: str) -> Dataset:
    if name not in _REGISTRY:
        raise ValueError(f"unknown dataset {name}, known are {names()}")
    return _REGISTRY[name]


def roles_from_json(text: str) -> ColumnRoles:
    """Roles from a configuration with col_action, clf_type and dirtiness_type."""
    config = json.loads(text)
    return ColumnRoles(config["col_action"], config["clf_type"], config.get("dirtiness_type") or {})


register("indultos_espana", plain("bigml/Indultos_en_Espana_1996-2013/raw/Indultos_en_Espana_1996-2013.csv"))
register("open_payments", open_payments, PAYMENT_ROLES)
register("road_safety", road_safety)
register("consumer_complaints", consumer_complaints)
register("product_relevance", plain("product_relevance/raw/train.csv", encoding="ISO-8859-1"))
register("federal_election", federal_election)
register("drug_directory", plain("drug_directory/raw/product.txt", sep="\t", encoding="ISO-8859-1"))
register("dating_profiles", plain("dating_profiles/raw/profiles.csv", multiline=True))
register("cacao_flavors", cacao_flavors)
register("wine_reviews", plain("wine_reviews/raw/winemag-data_first150k.csv", multiline=True))
register("house_prices", house_prices)
register("kickstarter_projects", kickstarter_projects)
register("building_permits", building_permits)
register("california_housing", plain("california_housing/raw/housing.csv"))
register("house_sales", plain("house_sales/raw/kc_house_data.csv", index_name=ROW_ID))
register("vancouver_employee", vancouver_employee)
register("firefighter_interventions", plain("firefighter_interventions/raw/interventions-hebdo-2010-2017.csv", sep=";"))
register("criteo", plain("criteo/raw/data.txt", sep="\t", header=False))
