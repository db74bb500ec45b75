"""SQL for every registered query that SQL can express, written independently of the operators."""

from __future__ import annotations

from clinspark.catalog.standin_sql import LINEAR_SCORE, days, hours, with_views

Step = tuple[str, str]


def num(expr: str, name: str) -> str:
    return f'ROUND(CAST({expr} AS DOUBLE), 6) + 0.0 AS "{name}"'


def big(expr: str, name: str | None = None) -> str:
    return f'CAST({expr} AS BIGINT) AS "{name or expr}"'


# --- cohort and labels ------------------------------------------------------------------------

_HOSP_COLUMNS = (
    "hadm_id", "admittime", "dischtime", "deathtime", "ethnicity", "gender", "dob", "dod", "age", "los_hosp_hr",
)
_HOSP_OUT = ", ".join(["subject_id", *_HOSP_COLUMNS])
_DIED_IN_STAY = "COALESCE(deathtime BETWEEN admittime AND dischtime, FALSE)"


def first_nonnull(source: str, columns: tuple[str, ...] = _HOSP_COLUMNS) -> str:
    picks = ", ".join(f"first_value({c} IGNORE NULLS) OVER w AS f_{c}" for c in columns)
    names = ", ".join(f"f_{c} AS {c}" for c in columns)
    return f"""
SELECT subject_id, {names} FROM (
  SELECT subject_id, {picks},
    row_number() OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) AS rn
  FROM {source}
  WINDOW w AS (PARTITION BY subject_id ORDER BY admittime, hadm_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
) WHERE rn = 1"""


def cohort_steps(
    hosps: str = "hosps", allowed: str = "cohort", name: str = "chosen", no_death: bool = False,
    columns: tuple[str, ...] = _HOSP_COLUMNS, cap: bool = True,
) -> list[Step]:
    los = "los_hosp_hr BETWEEN 48 AND 240" if cap else "los_hosp_hr >= 48"
    death = f"AND NOT {_DIED_IN_STAY}" if no_death else ""
    return [
        (f"{name}_in", f"SELECT * FROM {hosps} WHERE subject_id IN (SELECT subject_id FROM {allowed})"),
        (f"{name}_first", first_nonnull(f"{name}_in", columns)),
        (name, f"""SELECT * FROM {name}_first WHERE age BETWEEN 18 AND 89 AND {los}
          AND NOT (COALESCE(dod BETWEEN admittime AND dischtime, FALSE) AND los_hosp_hr < 48) {death}"""),
    ]


_MORTALITY = f"""CASE WHEN {_DIED_IN_STAY} OR COALESCE({days('dischtime', 'dod')} BETWEEN 0 AND 30, FALSE)
  THEN 1 ELSE 0 END"""
_EXCLUDED = "(9896, 9998, 13890, 14219, 17964, 23843, 26690, 29175, 30940)"


def target_steps(
    label: str, hosps: str = "hosps", allowed: str = "cohort", name: str = "chosen", no_death: bool = False
) -> list[Step]:
    if label == "mortality":
        labelled = [("labelled", f"SELECT *, {_MORTALITY} AS target FROM {hosps}")]
    elif label == "prolonged":
        labelled = [("labelled", f"SELECT *, CASE WHEN los_hosp_hr > 168 THEN 1 ELSE 0 END AS target FROM {hosps}")]
    else:
        labelled = [("labelled", f"""
SELECT h.*, CASE WHEN rn > 1 THEN NULL WHEN back IS NULL THEN 0
  WHEN {days('dischtime', 'back')} <= 30 THEN 1 ELSE 0 END AS target
FROM (SELECT *, row_number() OVER o AS rn, lead(admittime) OVER o AS back FROM {hosps}
      WINDOW o AS (PARTITION BY subject_id ORDER BY admittime, hadm_id)) h""")]
    return labelled + cohort_steps("labelled", allowed, name, no_death, (*_HOSP_COLUMNS, "target")) + [
        ("target_rows", f"SELECT subject_id, hadm_id, CAST(target AS BIGINT) AS target FROM {name} WHERE subject_id NOT IN {_EXCLUDED}")
    ]


_AGE_GROUP = """CASE WHEN age >= 18 AND age < 30 THEN '18_29' WHEN age >= 30 AND age < 40 THEN '30_39'
  WHEN age >= 40 AND age < 50 THEN '40_41' WHEN age >= 50 AND age < 60 THEN '50_59' WHEN age >= 60 AND age < 70 THEN '60_69'
  WHEN age >= 70 AND age < 80 THEN '70_79' WHEN age >= 80 AND age < 200 THEN '80p' END"""


def _funnel(no_death: bool) -> str:
    c1, c2 = "age BETWEEN 18 AND 89", "los_hosp_hr BETWEEN 48 AND 240"
    c3 = "NOT (COALESCE(dod BETWEEN admittime AND dischtime, FALSE) AND los_hosp_hr < 48)"
    c4 = f"NOT {_DIED_IN_STAY}"
    named = [("age_18_89", c1), ("los_48_240", c2), ("not_dead_within_48h", c3), ("no_in_hospital_death", c4)]
    rows = ["SELECT CAST(0 AS BIGINT) AS step, 'initial_cohort' AS criterion, COUNT(*) AS n FROM chosen_in",
            "SELECT 1, 'first_admission', COUNT(*) FROM chosen_first"]
    for i in range(1, 5 if no_death else 4):
        where = " AND ".join(c for _, c in named[:i])
        rows.append(f"SELECT {i + 1}, '{named[i - 1][0]}', COUNT(*) FROM chosen_first WHERE {where}")
    return with_views(["hosps", "cohort"], cohort_steps()[:2], "\nUNION ALL\n".join(rows))


# --- encodings --------------------------------------------------------------------------------

_ETH = """CASE WHEN regexp_matches(lower(ethnicity), '^white') THEN 'white'
  WHEN regexp_matches(lower(ethnicity), '^black') THEN 'black'
  WHEN regexp_matches(lower(ethnicity), '^hisp') OR regexp_matches(lower(ethnicity), '^latin') THEN 'hispanic'
  WHEN regexp_matches(lower(ethnicity), '^asia') THEN 'asian'
  WHEN NOT regexp_matches(lower(ethnicity), 'white|black|hispanic|asian') THEN 'other' END"""


def flags(expr: str, prefix: str, values: tuple[str, ...]) -> str:
    return ", ".join(
        f"CAST(CASE WHEN {expr} = '{v}' THEN 1 ELSE 0 END AS BIGINT) AS \"{prefix}_{v}\"" for v in values
    )


_ETH_FLAGS = flags(_ETH, "eth", ("asian", "black", "hispanic", "other", "white"))
_GENDER = big("CASE WHEN gender = 'M' THEN 1 ELSE 0 END", "gender")
_ADMISSION_FLAGS = ", ".join([
    flags("insurance", "insurance", ("Government", "Medicaid", "Medicare", "Private", "Self Pay")),
    flags("first_careunit", "first_careunit", ("CCU", "CSRU", "MICU", "SICU", "TSICU")),
    flags("admission_type", "admission_type", ("ELECTIVE", "EMERGENCY", "URGENT")),
])
_DNR = big(
    f"CASE WHEN COALESCE({hours('admittime', 'dnr_first_charttime')} <= 42 AND dnr <> 0, FALSE) THEN 1 ELSE 0 END", "dnr"
)
_STATIC_FEATURES = f"{big('age')}, {_GENDER}, {_DNR}, {_ETH_FLAGS}, {_ADMISSION_FLAGS}"

# --- measurements -----------------------------------------------------------------------------

_IN_WINDOW = "m.charttime BETWEEN a.admittime AND a.admittime + INTERVAL '42' HOUR"


def _window_sql(error_test: bool) -> str:
    test = "AND m.error IS DISTINCT FROM 1" if error_test else ""
    return with_views(["meas", "adm_ev", "meta"], [], f"""
SELECT m.subject_id, m.hadm_id, m.event_id, m.charttime, CAST(m.itemid AS BIGINT) AS itemid,
  {num('m.valuenum', 'valuenum')}, a.admittime
FROM meas m JOIN adm_ev a ON m.subject_id = a.subject_id AND m.hadm_id = a.hadm_id AND {_IN_WINDOW}
WHERE m.itemid IN (SELECT itemid FROM meta) {test}""")


def clean_step(source: str) -> str:
    return f"""
SELECT m.subject_id, m.hadm_id, m.event_id, CASE WHEN t.feature_name = 'TempF' THEN 'TempC' ELSE t.feature_name END AS feature_name,
  CASE WHEN t.feature_name = 'TempF' THEN (m.valuenum - 32) / 1.8 ELSE m.valuenum END AS valuenum
FROM {source} m JOIN meta t ON m.itemid = t.itemid WHERE m.valuenum BETWEEN t.min_v AND t.max_v"""


_WINDOWED_CLEAN = [
    ("windowed", f"""SELECT m.* FROM meas m JOIN adm_ev a ON m.subject_id = a.subject_id AND m.hadm_id = a.hadm_id
       AND {_IN_WINDOW} WHERE m.itemid IN (2, 3, 5) OR (m.itemid IN (1, 4) AND m.error IS DISTINCT FROM 1)"""),
    ("cleaned", clean_step("windowed")),
]
_EVENT_NAMES = ("heart rate", "sodium", "glucose", "TempC", "hemoglobin")


def pivot_columns(names: tuple[str, ...] = _EVENT_NAMES) -> str:
    return ", ".join(
        num(f"{f}(CASE WHEN feature_name = '{n}' THEN valuenum END)", f"{label}_{n}")
        for label, f in (("min", "MIN"), ("max", "MAX"), ("mean", "AVG")) for n in names
    )


_HOURLY_NAMES = ("heart_rate", "sodium", "glucose", "temperature", "hemoglobin", "weight", "height")
_STATS = {"mean": "AVG({0})", "min": "MIN({0})", "max": "MAX({0})"}
_MORE_STATS = {**_STATS, "std": "stddev_samp({0})", "spread": "MAX({0}) - MIN({0})"}


def stay_columns(stats: dict[str, str]) -> str:
    return ", ".join(num(s.format(c), f"{c}_{k}") for c in _HOURLY_NAMES for k, s in stats.items())


def stay_names(stats: dict[str, str], prefix: str) -> str:
    return ", ".join(f'{prefix}."{c}_{k}"' for c in _HOURLY_NAMES for k in stats)


_KEYS3 = "subject_id, hadm_id, icustay_id"
_TREATED = ", ".join(big(f"MAX({c})", c) for c in ("vent", "vaso"))


def extract_steps(stats: dict[str, str], source: str = "") -> list[Step]:
    return [
        ("vit", f"SELECT {_KEYS3}, {stay_columns(stats)} FROM hourly WHERE hours_in <= 42 {source} GROUP BY {_KEYS3}"),
        ("itv", f"SELECT {_KEYS3}, {_TREATED} FROM interv WHERE hours_in <= 42 {source} GROUP BY {_KEYS3}"),
    ]


_BMI = """CASE WHEN height_mean IS NULL OR weight_mean IS NULL OR height_mean = 0 THEN NULL
  ELSE LEAST(GREATEST(weight_mean / ((height_mean / 100.0) * (height_mean / 100.0)), 10.0), 300.0) END"""
_BMI_FLAGS = f"""{num(_BMI, 'bmi')},
  CAST(CASE WHEN hemoglobin_mean > 12 THEN 1 ELSE 0 END AS BIGINT) AS high_level_of_hemoglobin,
  CAST(CASE WHEN {_BMI} < 18 THEN 1 ELSE 0 END AS BIGINT) AS underweight,
  CAST(CASE WHEN {_BMI} > 25 THEN 1 ELSE 0 END AS BIGINT) AS overweight"""

# --- scores -----------------------------------------------------------------------------------

_SCORES = ("sirs", "sapsii", "apsiii", "sofa", "lods", "oasis", "meld")


def severity_steps(view: str) -> list[Step]:
    single = f"""SELECT subject_id, hadm_id, score_no, score FROM (
      SELECT *, row_number() OVER (PARTITION BY subject_id, hadm_id, score_no ORDER BY seq) AS rn FROM {view}) WHERE rn = 1"""
    columns = ", ".join(f"CAST(max(CASE WHEN score_no = {i} THEN score END) AS BIGINT) AS {n}" for i, n in enumerate(_SCORES, 1))
    return [
        ("single", single),
        ("sev", f"SELECT subject_id, hadm_id, {columns} FROM single GROUP BY subject_id, hadm_id HAVING count(*) = 7"),
    ]


_CROSSED = "date_diff('hour', ie.intime, k.charttime) > -6 AND date_diff('hour', ie.intime, k.charttime) <= 42"
_AKI_STEPS = [
    ("in_window", f"SELECT k.* FROM stay ie JOIN kdigo k ON ie.icustay_id = k.icustay_id WHERE {_CROSSED}"),
    ("cr", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY icustay_id
       ORDER BY aki_stage_creat DESC NULLS LAST, creat DESC NULLS LAST, charttime) AS rn FROM in_window
       WHERE aki_stage_creat IS NOT NULL) WHERE rn = 1"""),
    ("uo", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY icustay_id
       ORDER BY aki_stage_uo DESC NULLS LAST, uo_rt_24hr DESC NULLS LAST, uo_rt_12hr DESC NULLS LAST,
       uo_rt_6hr DESC NULLS LAST, charttime) AS rn FROM in_window WHERE aki_stage_uo IS NOT NULL) WHERE rn = 1"""),
    ("aki", f"""SELECT ie.icustay_id, ie.subject_id, ie.hadm_id, cr.charttime AS charttime_creat, {num('cr.creat', 'creat')},
       {big('cr.aki_stage_creat', 'aki_stage_creat')}, uo.charttime AS charttime_uo, {num('uo.uo_rt_6hr', 'uo_rt_6hr')},
       {num('uo.uo_rt_12hr', 'uo_rt_12hr')}, {num('uo.uo_rt_24hr', 'uo_rt_24hr')},
       {big('uo.aki_stage_uo', 'aki_stage_uo')},
       {big('GREATEST(COALESCE(cr.aki_stage_creat, 0), COALESCE(uo.aki_stage_uo, 0))', 'aki_stage_42hr')},
       {big('CASE WHEN cr.aki_stage_creat > 0 OR uo.aki_stage_uo > 0 THEN 1 ELSE 0 END', 'aki_42hr')}
       FROM stay ie LEFT JOIN cr ON ie.icustay_id = cr.icustay_id LEFT JOIN uo ON ie.icustay_id = uo.icustay_id"""),
]

# --- composites -------------------------------------------------------------------------------

_EV_CHOSEN = cohort_steps("ev_hosps", "ev_cohort")
_IN_CHOSEN = "AND subject_id IN (SELECT subject_id FROM chosen)"
_STATIC_STEP = ("stat", f"""SELECT subject_id, hadm_id, {_STATIC_FEATURES} FROM ext_static
  WHERE subject_id IN (SELECT subject_id FROM chosen)""")
_STATIC_NAMES = """st.age, st.gender, st.dnr, st.eth_asian, st.eth_black, st.eth_hispanic, st.eth_other, st.eth_white,
  st."insurance_Government", st."insurance_Medicaid", st."insurance_Medicare", st."insurance_Private", st."insurance_Self Pay",
  st."first_careunit_CCU", st."first_careunit_CSRU", st."first_careunit_MICU", st."first_careunit_SICU",
  st."first_careunit_TSICU", st."admission_type_ELECTIVE", st."admission_type_EMERGENCY", st."admission_type_URGENT\""""
_EXTRACT_VIEWS = ["ev_hosps", "ev_cohort", "ext_static", "hourly", "interv"]
_ALIGN = """FROM stat st LEFT JOIN vit v ON st.subject_id = v.subject_id AND st.hadm_id = v.hadm_id
  LEFT JOIN itv i ON st.subject_id = i.subject_id AND st.hadm_id = i.hadm_id"""


# The same with admissions of two ICU stays, aligned on the ICU stay.
_SPLIT_VIEWS = ["ev_hosps", "ev_cohort", "static2", "hourly2", "interv2"]
_SPLIT_STATIC = ("stat", f"""SELECT {_KEYS3}, {_STATIC_FEATURES} FROM static2
  WHERE subject_id IN (SELECT subject_id FROM chosen)""")
_SPLIT_ALIGN = " ".join(f"LEFT JOIN {t} {a} ON " + " AND ".join(f"st.{k} = {a}.{k}" for k in ("subject_id", "hadm_id", "icustay_id"))
                        for t, a in (("vit", "v"), ("itv", "i")))


def _extended(final: str, no_death: bool = False, hours_of: str = "") -> str:
    # The exact means ride along for the BMI and its flags.
    means = {"weight_mean": "wm", "height_mean": "hm", "hemoglobin_mean": "gm"}
    exact = ", ".join(f"AVG({c.removesuffix('_mean')}) AS {a}" for c, a in means.items())
    vit, itv = extract_steps(_MORE_STATS, f"{_IN_CHOSEN} {hours_of}")
    vit = (vit[0], vit[1].replace(" FROM hourly", f", {exact} FROM hourly"))
    bmi_flags = _BMI_FLAGS
    for column, alias in means.items():
        bmi_flags = bmi_flags.replace(column, alias)
    joined = f"""SELECT st.subject_id, st.hadm_id, {_STATIC_NAMES}, {stay_names(_MORE_STATS, 'v')}, v.wm, v.hm, v.gm, i.vent, i.vaso,
      {', '.join(f'sev.{s}' for s in _SCORES)}, aki.aki_42hr {_ALIGN}
      JOIN sev ON st.subject_id = sev.subject_id AND st.hadm_id = sev.hadm_id
      LEFT JOIN aki ON st.subject_id = aki.subject_id AND st.hadm_id = aki.hadm_id"""
    steps = (
        cohort_steps("ev_hosps", "ev_cohort", no_death=no_death) + [_STATIC_STEP]
        + [vit, itv] + severity_steps("ev_severity") + _AKI_STEPS
        + [("joined", joined), ("extended", f"""SELECT * EXCLUDE (wm, hm, gm), {bmi_flags}, {big('CASE WHEN "admission_type_EMERGENCY" = 1 OR "admission_type_URGENT" = 1 THEN 1 ELSE 0 END', 'emergency_or_urgent_admission')} FROM joined""")]
    )
    return with_views(_EXTRACT_VIEWS + ["stay", "kdigo", "ev_severity"], steps, final)


# --- preparation ------------------------------------------------------------------------------

_NUMERIC = ("age", "qty", "disc", "price", "empty_col", "const_col")
_FILLED = ("qty", "disc", "price", "empty_col", "const_col")
_GROUP_MEAN_STEPS = [
    ("g", f"SELECT *, {_AGE_GROUP} AS age_group FROM feat"),
    ("gm", "SELECT age_group, gender, " + ", ".join(f"AVG({c}) AS m_{c}" for c in _FILLED) + " FROM g GROUP BY age_group, gender"),
    ("filled", "SELECT g.row_id, g.gender, g.age, g.vent, g.y, "
     + ", ".join(f"COALESCE(g.{c}, gm.m_{c}) AS {c}" for c in _FILLED)
     + " FROM g LEFT JOIN gm ON g.age_group = gm.age_group AND g.gender = gm.gender"),
]


def median_steps(source: str, name: str) -> list[Step]:
    columns = (*_NUMERIC, "gender")
    return [
        (f"{name}_m", "SELECT " + ", ".join(f"COALESCE(median(CAST({c} AS DOUBLE)), 0.0) AS m_{c}" for c in columns) + f" FROM {source}"),
        (name, "SELECT s.row_id, s.vent, s.y, " + ", ".join(f"COALESCE(CAST(s.{c} AS DOUBLE), t.m_{c}) AS {c}" for c in columns)
         + f" FROM {source} s CROSS JOIN {name}_m t"),
    ]


def scale_steps(source: str, name: str, columns: tuple[str, ...]) -> list[Step]:
    return [(f"{name}_s", "SELECT " + ", ".join(
        f"AVG({c}) AS a_{c}, CASE WHEN COALESCE(stddev_pop({c}), 0) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}" for c in columns
    ) + f" FROM {source}")]


def scaled(columns: tuple[str, ...]) -> str:
    return ", ".join(num(f"(s.{c} - COALESCE(t.a_{c}, 0)) / t.s_{c}", c) for c in columns)


# --- sampling ---------------------------------------------------------------------------------

_SPLIT = with_views(["scored"], [
    ("r", "SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('7:' || CAST(row_id AS VARCHAR))) AS rn, COUNT(*) OVER (PARTITION BY y) AS n FROM scored")],
    f"SELECT row_id, {big('y')}, CAST(CASE WHEN rn <= floor(0.2 * n + 0.5) THEN 1 ELSE 0 END AS BIGINT) AS is_holdout FROM r")
_FOLDS = with_views(["scored"], [], f"SELECT row_id, {big('y')}, CAST(ntile(5) OVER (PARTITION BY y ORDER BY row_id) AS BIGINT) AS fold FROM scored")
_BALANCED = with_views(["scored"], [
    ("b", "SELECT s.*, bag FROM scored s CROSS JOIN (VALUES (0), (1), (2)) AS t(bag)"),
    ("r", "SELECT *, row_number() OVER (PARTITION BY bag, y ORDER BY md5('7:' || bag || ':' || CAST(row_id AS VARCHAR))) AS rn FROM b"),
    ("q", "SELECT MIN(n) AS quota FROM (SELECT COUNT(*) AS n FROM scored GROUP BY y)")],
    f"SELECT {big('bag')}, row_id, {big('y')} FROM r CROSS JOIN q WHERE rn <= quota")

# --- evaluation -------------------------------------------------------------------------------

_CURVE = [
    ("dist", "SELECT score, CAST(SUM(y) AS DOUBLE) AS pos, CAST(SUM(1 - y) AS DOUBLE) AS neg FROM scored GROUP BY score"),
    ("run", """SELECT score, pos, neg, SUM(pos) OVER (ORDER BY score DESC) AS tp, SUM(neg) OVER (ORDER BY score DESC) AS fp,
       (SELECT SUM(pos) FROM dist) AS n_pos, (SELECT SUM(neg) FROM dist) AS n_neg FROM dist"""),
]
_METRICS = with_views(["scored"], _CURVE + [
    ("c", """SELECT CAST(SUM(CASE WHEN y = 1 AND score > 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
       CAST(SUM(CASE WHEN y = 0 AND score > 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
       CAST(SUM(CASE WHEN y = 1 AND score <= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
       CAST(SUM(CASE WHEN y = 0 AND score <= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS tn FROM scored""")], f"""
SELECT 'acc' AS metric, 'test' AS subset, {num('(tp + tn) / (tp + fp + fn + tn)', 'value')} FROM c
UNION ALL SELECT 'balanced_acc', 'test', {num('(tp / (tp + fn) + tn / (tn + fp)) / 2', 'value')} FROM c
UNION ALL SELECT 'f1_score', 'test', {num('2 * tp / (2 * tp + fp + fn)', 'value')} FROM c
UNION ALL SELECT 'PR80', 'test', {num('COALESCE(MAX(CASE WHEN tp / (tp + fp) >= 0.8 THEN tp / n_pos END), 0)', 'value')} FROM run
UNION ALL SELECT 'ap', 'test', {num('SUM((tp - lag_tp) / n_pos * tp / (tp + fp))', 'value')}
  FROM (SELECT *, COALESCE(LAG(tp) OVER (ORDER BY score DESC), 0) AS lag_tp FROM run)""")

_HISTOGRAM = with_views(["scored"], [
    ("v", "SELECT 'False' AS series, 1.0 - score AS v FROM scored UNION ALL SELECT 'True', score FROM scored"),
    ("lim", "SELECT MIN(v) AS lo, MAX(v) AS hi, (MAX(v) - MIN(v)) / 100 AS w FROM v"),
    ("g", "SELECT v.*, lim.*, LEAST(CAST(floor((v - lo) / w) AS BIGINT), 99) AS b FROM v CROSS JOIN lim"),
    ("h", "SELECT *, CASE WHEN v < lo + b * w THEN b - 1 WHEN v >= lo + (b + 1) * w AND b < 99 THEN b + 1 ELSE b END AS bin FROM g")],
    f"SELECT series, bin, {num('lo + bin * w', 'bin_start')}, COUNT(*) AS n FROM h GROUP BY series, bin, lo, w")

_BIN = " + ".join(f"CAST(score > {i}/10.0::DOUBLE AS INT)" for i in range(1, 10))

_BANDS = with_views(["scored"], [
    ("rows_", "SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS row_no, COUNT(*) OVER () AS n FROM scored"),
    ("size_", "SELECT COUNT(*) AS n, CAST(floor(COUNT(*) * 0.2) AS BIGINT) AS m FROM scored"),
    ("picks", """SELECT draw, ('0x' || substr(md5('5:' || draw || ':' || pos), 1, 15))::BIGINT % n AS row_no
       FROM (SELECT unnest(range(20)) AS draw) d CROSS JOIN (SELECT unnest(range(m)) AS pos, n FROM size_) p"""),
    ("dist", """SELECT draw, score, CAST(SUM(y) AS DOUBLE) AS pos, CAST(SUM(1 - y) AS DOUBLE) AS neg
       FROM picks JOIN rows_ USING (row_no) GROUP BY draw, score"""),
    ("run", """SELECT draw, score, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY draw) AS n_pos,
       SUM(neg) OVER (PARTITION BY draw) AS n_neg FROM dist WINDOW w AS (PARTITION BY draw ORDER BY score DESC)"""),
    ("pts", """SELECT 'roc' AS curve, draw, score, fp / n_neg AS x, tp / n_pos AS y FROM run WHERE n_neg > 0 AND n_pos > 0
       UNION ALL SELECT 'roc', draw, 2.0, 0.0, 0.0 FROM run WHERE n_neg > 0 AND n_pos > 0 GROUP BY draw
       UNION ALL SELECT 'pr', draw, score, CASE WHEN n_pos = 0 THEN 1.0 ELSE tp / n_pos END, tp / (tp + fp) FROM run
       UNION ALL SELECT 'pr', draw, 2.0, 0.0, 1.0 FROM run GROUP BY draw"""),
    ("grid", "SELECT i AS grid_index, CASE WHEN i = 999 THEN 1.0 ELSE i * (1.0::DOUBLE / 999) END AS g FROM (SELECT unnest(range(1000)) AS i)"),
    ("seg", "SELECT *, LEAD(x) OVER o AS nx, LEAD(y) OVER o AS ny FROM pts WINDOW o AS (PARTITION BY curve, draw ORDER BY score DESC)"),
    ("vals", """SELECT curve, draw, grid_index, g, CASE WHEN curve = 'roc' AND grid_index = 0 THEN 0.0
         WHEN nx IS NULL OR g = x THEN y ELSE y + (ny - y) / (nx - x) * (g - x) END AS v
       FROM seg JOIN grid ON x <= g AND (nx IS NULL OR nx > g)"""),
    ("band", "SELECT curve, grid_index, g, AVG(v) AS mean, stddev_pop(v) AS deviation FROM vals GROUP BY curve, grid_index, g")],
    f"""SELECT curve, grid_index, {num('g', 'grid')}, {num('mean', 'mean')}, {num('deviation', 'deviation')},
      {num('GREATEST(mean - deviation, 0)', 'lower')}, {num('LEAST(mean + deviation, 1)', 'upper')} FROM band""")

_TOP_K = with_views(["feat"], [
    ("z", "SELECT " + ", ".join(f"AVG({c}) AS a_{c}, CASE WHEN COALESCE(stddev_pop({c}), 0) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
                                for c in ("qty", "disc", "price", "const_col", "age", "gender")) + " FROM feat"),
    ("imp", " UNION ALL ".join(f"SELECT '{c}' AS feature, AVG(ABS(({c} - a_{c}) / s_{c})) AS importance FROM feat CROSS JOIN z"
                               for c in ("qty", "disc", "price", "const_col", "age", "gender"))),
    ("rk", "SELECT *, row_number() OVER (ORDER BY ROUND(importance, 9) DESC, feature) AS r FROM imp"),
    ("ch", "SELECT *, CASE WHEN r <= 2 THEN r WHEN feature = 'gender' THEN 3 ELSE 4 END AS p FROM rk WHERE r <= 2 OR feature IN ('gender', 'age')")],
    f"SELECT CAST(row_number() OVER (ORDER BY p) AS BIGINT) AS position, feature, {num('importance', 'importance')} FROM ch")


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    hosp = ["hosps", "cohort"]
    sql["base_admissions"] = with_views(["hosps"], [], f"SELECT {_HOSP_OUT} FROM hosps")
    sql["cohort_select"] = with_views(hosp, cohort_steps(), f"SELECT {_HOSP_OUT} FROM chosen")
    sql["cohort_select_no_death"] = with_views(hosp, cohort_steps(no_death=True), f"SELECT {_HOSP_OUT} FROM chosen")
    sql["cohort_select_uncapped"] = with_views(hosp, cohort_steps(cap=False), f"SELECT {_HOSP_OUT} FROM chosen")
    sql["cohort_funnel"] = _funnel(True)
    sql["first_stay_nonnull"] = with_views(["hosps"], [("f", first_nonnull("hosps"))], f"SELECT {_HOSP_OUT} FROM f")
    sql["first_stay_row"] = with_views(["hosps"], [("f", "SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) AS rn FROM hosps")],
                                       f"SELECT {_HOSP_OUT} FROM f WHERE rn = 1")
    for label in ("mortality", "prolonged", "readmission"):
        sql[f"label_{label}"] = with_views(hosp, target_steps(label), "SELECT * FROM target_rows")
    sql["mortality_by_age_group"] = with_views(hosp, target_steps("mortality"), f"""
SELECT {_AGE_GROUP} AS age_group, COUNT(*) AS n, CAST(SUM(target) AS BIGINT) AS deaths, {num('AVG(target)', 'mortality_rate')}
FROM chosen WHERE subject_id NOT IN {_EXCLUDED} GROUP BY 1""")
    sql["sources_roundtrip"] = with_views(["hourly", "ev_cohort"], [], f"""
SELECT {_KEYS3}, CAST(hours_in AS BIGINT) AS hours_in, {', '.join(num(c, c) for c in _HOURLY_NAMES)}
FROM hourly WHERE subject_id IN (SELECT subject_id FROM ev_cohort)""")

    sql["vitals_window"], sql["labs_window"] = _window_sql(True), _window_sql(False)
    sql["clean_measurements"] = with_views(["meas", "meta"], [("cleaned", clean_step("meas"))],
                                           f"SELECT subject_id, hadm_id, event_id, feature_name, {num('valuenum', 'valuenum')} FROM cleaned")
    sql["hours_in_violations"] = with_views(["meas", "adm_ev"], [("h", f"""SELECT m.event_id, {hours('a.admittime', 'm.charttime')} AS hours_in
      FROM meas m JOIN adm_ev a ON m.subject_id = a.subject_id AND m.hadm_id = a.hadm_id""")],
                                            "SELECT event_id, hours_in FROM h WHERE hours_in > 42")
    sql["pivot_measurements"] = with_views(["meas", "adm_ev", "meta"], _WINDOWED_CLEAN,
                                           f"SELECT subject_id, hadm_id, {pivot_columns()} FROM cleaned GROUP BY subject_id, hadm_id")
    sql["hourly_to_stay"] = with_views(["hourly"], [], f"SELECT {_KEYS3}, {stay_columns(_STATS)} FROM hourly WHERE hours_in <= 42 GROUP BY {_KEYS3}")
    sql["hourly_to_stay_extended"] = with_views(["hourly"], [], f"SELECT {_KEYS3}, {stay_columns(_MORE_STATS)} FROM hourly WHERE hours_in <= 42 GROUP BY {_KEYS3}")
    sql["hourly_to_stay_long_form"] = sql["hourly_to_stay_extended"]
    sql["interventions_max"] = with_views(["interv"], [], f"SELECT {_KEYS3}, {_TREATED} FROM interv WHERE hours_in <= 42 GROUP BY {_KEYS3}")
    sql["align_features"] = with_views(["adm_ev", "hourly", "interv"], extract_steps(_STATS), f"""
SELECT st.subject_id, st.hadm_id, st.admittime, {stay_names(_STATS, 'v')}, i.vent, i.vaso
FROM adm_ev st LEFT JOIN vit v ON st.subject_id = v.subject_id AND st.hadm_id = v.hadm_id
  LEFT JOIN itv i ON st.subject_id = i.subject_id AND st.hadm_id = i.hadm_id""")

    sql["encode_ethnicity"] = with_views(["adm"], [], f"SELECT subject_id, hadm_id, {_GENDER}, {_ETH_FLAGS} FROM adm")
    sql["encode_admission"] = with_views(["adm"], [], f"SELECT subject_id, hadm_id, {_ADMISSION_FLAGS} FROM adm")
    sql["encode_static"] = with_views(["ext_static"], [], f"SELECT {_KEYS3}, {_STATIC_FEATURES} FROM ext_static")
    sql["bmi_flags"] = with_views(["hourly"], [
        ("vit", f"SELECT {_KEYS3}, AVG(weight) AS weight_mean, AVG(height) AS height_mean, AVG(hemoglobin) AS hemoglobin_mean FROM hourly WHERE hours_in <= 42 GROUP BY {_KEYS3}")],
        f"SELECT subject_id, hadm_id, {_BMI_FLAGS} FROM vit")
    sql["features_with_target"] = with_views(hosp, target_steps("mortality"), f"""
SELECT h.subject_id, h.hadm_id, {big('h.age', 'age')}, {num('h.los_hosp_hr', 'los_hosp_hr')},
  {_GENDER.replace("gender = 'M'", "h.gender = 'M'")}, {_ETH_FLAGS.replace('ethnicity', 'h.ethnicity')}, t.target
FROM hosps h JOIN target_rows t ON h.subject_id = t.subject_id AND h.hadm_id = t.hadm_id""")
    sql["severity_merge"] = with_views(["severity"], severity_steps("severity"), "SELECT * FROM sev")
    sql["aki_42h"] = with_views(["stay", "kdigo"], _AKI_STEPS, "SELECT * EXCLUDE (subject_id, hadm_id) FROM aki")
    sql["aki_by_stay"] = with_views(["stay", "kdigo"], _AKI_STEPS, "SELECT subject_id, hadm_id, aki_42hr FROM aki")

    sql["features_events"] = with_views(["ev_hosps", "ev_cohort", "meas", "adm_ev", "meta"], _EV_CHOSEN + _WINDOWED_CLEAN + [
        ("piv", f"SELECT subject_id, hadm_id, {pivot_columns()} FROM cleaned GROUP BY subject_id, hadm_id")], f"""
SELECT h.subject_id, h.hadm_id, {big('h.age', 'age')}, {_GENDER}, {_ETH_FLAGS},
  {', '.join(f'p."{k}_{n}"' for k in ('min', 'max', 'mean') for n in _EVENT_NAMES)}
FROM ev_hosps h LEFT JOIN piv p ON h.subject_id = p.subject_id AND h.hadm_id = p.hadm_id
WHERE h.subject_id IN (SELECT subject_id FROM chosen)""")
    sql["features_extract"] = with_views(_EXTRACT_VIEWS, _EV_CHOSEN + [_STATIC_STEP] + extract_steps(_STATS, _IN_CHOSEN),
                                         f"SELECT st.subject_id, st.hadm_id, {_STATIC_NAMES}, {stay_names(_STATS, 'v')}, i.vent, i.vaso {_ALIGN}")
    sql["features_extract_hourly"] = with_views(_EXTRACT_VIEWS, _EV_CHOSEN + [
        _STATIC_STEP, ("vit", f"SELECT * FROM hourly WHERE hours_in <= 42 {_IN_CHOSEN}"), ("itv", f"SELECT * FROM interv WHERE hours_in <= 42 {_IN_CHOSEN}")], f"""
SELECT st.subject_id, st.hadm_id, {_STATIC_NAMES}, {big('v.hours_in', 'hours_in')}, {', '.join(num('v.' + c, c) for c in _HOURLY_NAMES)},
  {big('i.vent', 'vent')}, {big('i.vaso', 'vaso')} {_ALIGN} AND v.hours_in = i.hours_in""")
    split_stats = [(n, q.replace("FROM hourly", "FROM hourly2").replace("FROM interv", "FROM interv2"))
                   for n, q in extract_steps(_STATS, _IN_CHOSEN)]
    sql["features_extract_two_stays"] = with_views(_SPLIT_VIEWS, _EV_CHOSEN + [_SPLIT_STATIC] + split_stats, f"""
SELECT st.subject_id, st.hadm_id, {_STATIC_NAMES}, {stay_names(_STATS, 'v')}, i.vent, i.vaso FROM stat st {_SPLIT_ALIGN}""")
    sql["features_extract_hourly_two_stays"] = with_views(_SPLIT_VIEWS, _EV_CHOSEN + [
        _SPLIT_STATIC, ("vit", f"SELECT * FROM hourly2 WHERE hours_in <= 42 {_IN_CHOSEN}"),
        ("itv", f"SELECT * FROM interv2 WHERE hours_in <= 42 {_IN_CHOSEN}")], f"""
SELECT st.subject_id, st.hadm_id, {_STATIC_NAMES}, {big('v.hours_in', 'hours_in')}, {', '.join(num('v.' + c, c) for c in _HOURLY_NAMES)},
  {big('i.vent', 'vent')}, {big('i.vaso', 'vaso')} FROM stat st {_SPLIT_ALIGN} AND v.hours_in = i.hours_in""")
    # The first ICU stay of an admission is the one before hour 30.
    sql["features_extract_extended_two_stays"] = _extended("SELECT * FROM extended", hours_of="AND NOT (hadm_id % 3 = 0 AND hours_in >= 30)")
    sql["features_extract_extended"] = _extended("SELECT * FROM extended")
    sql["features_extract_selected"] = _extended("""SELECT subject_id, hadm_id, gender, age, "insurance_Self Pay",
      emergency_or_urgent_admission, sirs, sapsii, apsiii, sofa, lods, oasis, meld, dnr FROM extended""", no_death=True)

    sql["group_means"] = with_views(["feat"], _GROUP_MEAN_STEPS[:2], "SELECT age_group, " + big("gender") + ", "
                                    + ", ".join(num(f"m_{c}", c) for c in _FILLED) + " FROM gm")
    sql["impute_group_mean"] = with_views(["feat"], _GROUP_MEAN_STEPS, f"SELECT row_id, {big('gender')}, {big('age')}, "
                                          + ", ".join(num(c, c) for c in _FILLED) + f", {big('vent')}, {big('y')} FROM filled")
    sql["impute_median"] = with_views(["feat"], median_steps("feat", "med"), "SELECT row_id, "
                                      + ", ".join(num(c, c) for c in (*_NUMERIC, "gender")) + f", {big('vent')}, {big('y')} FROM med")
    sql["impute_median_large"] = sql["impute_median"]
    scale_columns = ("age", "qty", "disc", "price", "empty_col", "const_col")
    sql["scale"] = with_views(["feat"], scale_steps("feat", "sc", scale_columns), f"""
SELECT s.row_id, {big('s.gender', 'gender')}, {scaled(scale_columns)} FROM feat s CROSS JOIN sc_s t""")
    sql["prepare"] = with_views(["feat"], _GROUP_MEAN_STEPS + median_steps("filled", "med") + scale_steps("med", "sc", scale_columns), f"""
SELECT s.row_id, {big('s.y', 'y')}, {scaled(scale_columns)}, {num('s.gender', 'gender')}, {big('s.vent', 'vent')} FROM med s CROSS JOIN sc_s t""")

    cohorts = (cohort_steps(name="c0") + cohort_steps(name="c1", cap=False) + cohort_steps(name="c2", no_death=True))
    sql["join_predictions"] = with_views(hosp, cohorts, f"""
SELECT COALESCE(c0.subject_id, c1.subject_id, c2.subject_id) AS subject_id, {num('c0.subject_id * 3 % 100 / 100.0', 'mortality_proba')},
  {num('c1.subject_id * 7 % 100 / 100.0', 'prolonged_LOS_proba')}, {num('c2.subject_id * 11 % 100 / 100.0', 'readmission_proba')}
FROM c0 FULL OUTER JOIN c1 ON c0.subject_id = c1.subject_id
  FULL OUTER JOIN c2 ON c2.subject_id = COALESCE(c0.subject_id, c1.subject_id)""")

    sql["strat_split"], sql["strat_folds"], sql["balanced_sample"] = _SPLIT, _FOLDS, _BALANCED
    sql["confusion"] = with_views(["scored"], [("cells", "SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(y, predicted)")], """
SELECT CAST(c.y AS BIGINT) AS y, CAST(c.predicted AS BIGINT) AS predicted, COUNT(s.row_id) AS n
FROM cells c LEFT JOIN scored s ON s.y = c.y AND CAST(s.score > 0.5 AS INT) = c.predicted GROUP BY 1, 2""")
    sql["metric_report"] = _METRICS
    sql["pr_points"] = with_views(["scored"], _CURVE, f"""
SELECT {num('score', 'threshold')}, {num('tp / (tp + fp)', 'precision')}, {num('tp / n_pos', 'recall')} FROM run
UNION ALL SELECT NULL, 1.0, 0.0""")
    sql["roc_points"] = with_views(["scored"], _CURVE, f"""
SELECT {num('score', 'threshold')}, {num('fp / n_neg', 'fpr')}, {num('tp / n_pos', 'tpr')} FROM run UNION ALL SELECT NULL, 0.0, 0.0""")
    sql["calibration_bins"] = with_views(["scored"], [], f"""
SELECT CAST({_BIN} AS BIGINT) AS bin, {num('AVG(score)', 'mean_score')}, {num('AVG(y)', 'fraction_positive')}, COUNT(*) AS n FROM scored GROUP BY 1""")
    sql["score_histogram"] = _HISTOGRAM
    sql["bootstrap_bands"] = _BANDS
    sql["top_k_features"] = _TOP_K

    # Isotonic fit by its closed form: the largest, over all starts, of the smallest mean of a run that covers the score.
    sql["isotonic_calibration"] = with_views(["scored"], [
        ("dist", "SELECT score, CAST(SUM(y) AS DOUBLE) AS s, CAST(COUNT(*) AS DOUBLE) AS n FROM scored GROUP BY score"),
        ("run", "SELECT score, s, n, SUM(s) OVER (ORDER BY score) AS cs, SUM(n) OVER (ORDER BY score) AS cn FROM dist"),
        ("spans", """SELECT a.score AS low, b.score AS high, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS mean
           FROM run a JOIN run b ON a.score <= b.score"""),
        ("least", """SELECT d.score, p.low, MIN(p.mean) AS mean FROM dist d JOIN spans p ON p.low <= d.score AND p.high >= d.score
           GROUP BY d.score, p.low"""),
        ("iso", "SELECT score, MAX(mean) AS probability FROM least GROUP BY score")], f"""
SELECT row_id, {num('s.score', 'score')}, {num('i.probability', 'probability')} FROM scored s JOIN iso i ON s.score = i.score""")
    # A linear score has w * (x - baseline) as its attribution, whatever the permutations.
    sql["attributions_linear"] = with_views(["feat"], [], " UNION ALL ".join(
        f"SELECT row_id, '{c}' AS feature, {num(f'{w} * (COALESCE({c}, 0) - {b})', 'attribution')} FROM feat"
        for c, (w, b) in LINEAR_SCORE.items()))
    # Subjects outside the cohort that have the features of each outcome; extended features need a row of scores.
    others = ("others", "SELECT DISTINCT subject_id FROM ev_hosps WHERE subject_id NOT IN (SELECT subject_id FROM ev_cohort)")
    cohorts = cohort_steps("ev_hosps", "others", name="c0") + cohort_steps("ev_hosps", "others", name="c2", no_death=True)
    with_scores = "FROM ext_static JOIN sev USING (subject_id, hadm_id)"
    sql["unseen_coverage"] = with_views(_EXTRACT_VIEWS + ["ev_severity"], [others, *cohorts, *severity_steps("ev_severity")], f"""
SELECT subject_id, CAST(1 AS BIGINT) AS mortality_proba,
  CASE WHEN subject_id IN (SELECT subject_id {with_scores}) THEN CAST(1 AS BIGINT) END AS "prolonged_LOS_proba",
  CASE WHEN subject_id IN (SELECT subject_id {with_scores} WHERE subject_id IN (SELECT subject_id FROM c2)) THEN CAST(1 AS BIGINT) END AS readmission_proba
FROM (SELECT DISTINCT subject_id FROM ext_static WHERE subject_id IN (SELECT subject_id FROM c0))""")
    # Labels that follow from the columns are learnt exactly.
    exact = f"SELECT row_id, {big('gender * vent', 'y')}, {num('gender * vent', 'probability')}, {big('gender * vent', 'predicted')} FROM feat"
    sql["train_score_forest_exact"] = sql["train_score_boosted_exact"] = with_views(["feat"], [], exact)
    sql["grid_search_exact"] = """
SELECT '{"max_depth": ' || d || ', "max_features": ' || f || ', "min_samples_split": ' || s || ', "n_estimators": 100}' AS params,
  CAST(fold AS BIGINT) AS fold, CAST(1 AS DOUBLE) AS score
FROM (SELECT unnest([6, 8, 10, 12]) AS d) CROSS JOIN (SELECT unnest([7, 15]) AS f) CROSS JOIN (SELECT unnest([2, 4]) AS s)
CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS fold)"""
    sql["forest_importance_exact"] = with_views(["feat"], [], """
SELECT feature, CAST(feature = 'vent' AS DOUBLE) AS importance, 0.0::DOUBLE AS deviation
FROM (SELECT unnest(['age', 'gender', 'vent']) AS feature) WHERE EXISTS (SELECT 1 FROM feat WHERE vent = 1)""")
    return sql
