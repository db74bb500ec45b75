"""Enumerations, named feature sets, options and the three final model configurations."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any


class Outcome(Enum):
    """Predicted outcomes; the value is the name of the probability column."""

    MORTALITY = "mortality_proba"
    PROLONGED_STAY = "prolonged_LOS_proba"
    READMISSION = "readmission_proba"


class Learner(Enum):
    FOREST = "balanced_forest"
    BOOSTED = "balanced_boosted_bags"


WINDOW_HOURS = 42
PROLONGED_HOURS = 7 * 24
FOLLOW_UP_DAYS = 30

# ---------------------------------------------------------------------------------------------
# Names and lists that results depend on.
# ---------------------------------------------------------------------------------------------

# Subjects whose second admission overlaps the first.
OVERLAPPING_STAY_SUBJECTS = (9896, 9998, 13890, 14219, 17964, 23843, 26690, 29175, 30940)

ETHNICITY_GROUPS = ("asian", "black", "hispanic", "other", "white")
INSURANCE_TYPES = ("Government", "Medicaid", "Medicare", "Private", "Self Pay")
FIRST_CARE_UNITS = ("CCU", "CSRU", "MICU", "SICU", "TSICU")
ADMISSION_TYPES = ("ELECTIVE", "EMERGENCY", "URGENT")

SEVERITY_SCORES = ("sirs", "sapsii", "apsiii", "sofa", "lods", "oasis")

INTERVENTIONS = (
    "vent", "vaso", "adenosine", "dobutamine", "dopamine", "epinephrine", "isuprel", "milrinone",
    "norepinephrine", "phenylephrine", "vasopressin", "colloid_bolus", "crystalloid_bolus", "nivdurations",
)

CATEGORICAL_FEATURES = (
    "gender", "dnr",
    "eth_asian", "eth_black", "eth_hispanic", "eth_other", "eth_white",
    "insurance_Government", "insurance_Medicaid", "insurance_Medicare", "insurance_Private", "insurance_Self Pay",
    "first_careunit_CCU", "first_careunit_CSRU", "first_careunit_MICU", "first_careunit_SICU",
    "first_careunit_TSICU",
    "admission_type_ELECTIVE", "admission_type_EMERGENCY", "admission_type_URGENT",
    "emergency_or_urgent_admission", "high_level_of_hemoglobin", "underweight", "overweight", "aki_42hr",
)

# Dropped from the static extract once encoded: outcomes, leakage, bookkeeping, unusable codes.
STATIC_DROP = (
    "admittime", "dischtime", "deathtime", "discharge_location", "mort_icu", "mort_hosp",
    "hospital_expire_flag", "hospstay_seq", "readmission_30", "max_hours", "intime", "outtime", "los_icu",
    "cmo_first", "cmo_last", "cmo", "diagnosis_at_admission", "fullcode_first", "fullcode",
)
ADMISSION_DROP = ("admittime", "dischtime", "deathtime", "los_hosp_hr", "dob", "dod")

READMISSION_FEATURES = (
    "gender", "age", "insurance_Self Pay", "emergency_or_urgent_admission", "sirs", "sapsii", "apsiii", "sofa",
    "lods", "oasis", "meld", "dnr",
)
READMISSION_FEATURES_EXTENDED = READMISSION_FEATURES + (
    "aki_42hr", "underweight", "overweight", "high_level_of_hemoglobin", "sodium_mean", "heart rate_std",
    "glucose_std",
)

SEPSIS_MORTALITY_FEATURES = (
    "age", "gender", "eth_asian", "eth_black", "eth_hispanic", "eth_other", "eth_white",
    "heart rate_mean", "heart rate_min", "heart rate_max",
    "temperature_mean", "temperature_min", "temperature_max",
    "respiratory rate_mean", "respiratory rate_min", "respiratory rate_max",
    "oxygen saturation_mean", "oxygen saturation_min", "oxygen saturation_max",
    "blood urea nitrogen_mean", "diastolic blood pressure_mean", "mean blood pressure_mean",
    "red blood cell count_mean", "red blood cell count csf_mean", "red blood cell count ascites_mean",
    "red blood cell count pleural_mean", "red blood cell count urine_mean", "systolic blood pressure_mean",
    "white blood cell count_mean", "white blood cell count urine_mean",
    "blood urea nitrogen_min", "diastolic blood pressure_min", "mean blood pressure_min",
    "red blood cell count_min", "red blood cell count csf_min", "red blood cell count ascites_min",
    "red blood cell count pleural_min", "red blood cell count urine_min", "systolic blood pressure_min",
    "white blood cell count_min", "white blood cell count urine_min",
    "blood urea nitrogen_max", "diastolic blood pressure_max", "mean blood pressure_max",
    "red blood cell count_max", "red blood cell count csf_max", "red blood cell count ascites_max",
    "red blood cell count pleural_max", "red blood cell count urine_max", "systolic blood pressure_max",
    "white blood cell count_max", "white blood cell count urine_max",
    "glucose_mean", "glucose_min", "glucose_max",
)

PHYSIOLOGY_MORTALITY_FEATURES = (
    "age", "gender", "eth_asian", "eth_black", "eth_hispanic", "eth_other", "eth_white",
    "heart rate_min", "heart rate_max", "heart rate_mean",
    "systolic blood pressure_min", "systolic blood pressure_mean", "systolic blood pressure_max",
    "diastolic blood pressure_min", "diastolic blood pressure_mean", "diastolic blood pressure_max",
    "mean blood pressure_mean", "mean blood pressure_min", "mean blood pressure_max",
    "respiratory rate_mean", "respiratory rate_min", "respiratory rate_max",
    "tidal volume spontaneous_mean", "tidal volume spontaneous_min", "tidal volume spontaneous_max",
    "glucose_min", "glucose_mean", "glucose_max",
    "temperature_max", "temperature_min", "temperature_mean",
    "anion gap_mean", "albumin_mean", "bicarbonate_mean", "bilirubin_mean", "creatinine_mean", "chloride_mean",
    "hematocrit_mean", "hemoglobin_mean", "lactate_mean", "magnesium_mean", "phosphate_mean", "platelets_mean",
    "potassium_mean", "blood urea nitrogen_mean", "prothrombin time inr_mean", "prothrombin time pt_mean",
    "partial thromboplastin time_mean", "sodium_mean", "white blood cell count_mean", "weight_mean",
)

# Age groups as [low, high) with their labels; "40_41" is the published spelling of 40 to 49.
AGE_GROUPS = (
    (18, 30, "18_29"), (30, 40, "30_39"), (40, 50, "40_41"), (50, 60, "50_59"),
    (60, 70, "60_69"), (70, 80, "70_79"), (80, 200, "80p"),
)

DEFAULT_GRIDS = {
    Learner.FOREST: {
        "max_depth": [6, 8, 10, 12], "min_samples_split": [2, 4], "max_features": [7, 15], "n_estimators": [100],
    },
    Learner.BOOSTED: {
        "max_iter": [100], "max_leaf_nodes": [5, 10, 30, 50], "learning_rate": [0.01, 0.1, 1],
    },
}

BOOTSTRAP_DRAWS = 20
BOOTSTRAP_SHARE = 0.2
CURVE_GRID_POINTS = 1000


# ---------------------------------------------------------------------------------------------
# Options
# ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class CohortOptions:
    """Inclusion and exclusion criteria that can be switched."""

    cap_los: bool = True
    drop_in_hospital_death: bool = False
    first_stay_mode: str = "nonnull"


@dataclass(frozen=True)
class FeatureOptions:
    """How one feature row per stay is built."""

    cohort: CohortOptions = field(default_factory=CohortOptions)
    aggregate: bool = True
    minimal: bool = False
    extended: bool = False
    select: tuple[str, ...] | None = None
    window_hours: int = WINDOW_HOURS

    def __post_init__(self) -> None:
        if self.minimal and self.extended:
            raise ValueError("extended features need the encoded columns: minimal and extended exclude each other")
        if self.extended and not self.aggregate:
            raise ValueError("extended features need aggregated measurements")


@dataclass(frozen=True)
class ModelConfig:
    outcome: Outcome
    features: FeatureOptions
    learner: Learner
    params: dict[str, Any]
    seed: int = 0
    bags: int = 100


FINAL_MODELS = {
    Outcome.MORTALITY: ModelConfig(
        Outcome.MORTALITY,
        FeatureOptions(),
        Learner.BOOSTED,
        {"learning_rate": 0.1, "max_leaf_nodes": 50, "max_iter": 100},
    ),
    Outcome.PROLONGED_STAY: ModelConfig(
        Outcome.PROLONGED_STAY,
        FeatureOptions(extended=True),
        Learner.FOREST,
        {"max_depth": 10, "min_samples_split": 4, "max_features": 15, "n_estimators": 100},
    ),
    Outcome.READMISSION: ModelConfig(
        Outcome.READMISSION,
        FeatureOptions(
            cohort=CohortOptions(drop_in_hospital_death=True), extended=True, select=READMISSION_FEATURES
        ),
        Learner.BOOSTED,
        {"learning_rate": 0.1, "max_depth": 2, "l2_regularization": 0.25},
    ),
}
