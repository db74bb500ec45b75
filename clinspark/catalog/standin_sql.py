"""The stand-in tables as SQL text over the given tables, for checking results outside Spark."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}
# Columns of the view ``feat`` with weight and baseline of a linear score.
LINEAR_SCORE = {"age": (2.0, 50.0), "qty": (0.5, 100.0), "price": (0.25, 1000.0), "gender": (-3.0, 0.0), "vent": (4.0, 1.0)}


def _view(name: str, needs: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (needs, sql.strip())


_view("adm", (), """
SELECT CAST(o.o_custkey AS BIGINT) AS subject_id, o.o_orderkey AS hadm_id, o.admittime, o.dischtime,
  CASE WHEN (o.o_custkey % 10 = 0 AND o.rn_last = 1) OR (o.o_custkey % 10 = 7 AND o.rn_first = 1)
       THEN o.dischtime - INTERVAL '1' HOUR END AS deathtime,
  CASE o.o_orderkey % 9 WHEN 0 THEN 'WHITE' WHEN 1 THEN 'WHITE - RUSSIAN' WHEN 2 THEN 'BLACK/AFRICAN AMERICAN'
    WHEN 3 THEN 'HISPANIC OR LATINO' WHEN 4 THEN 'LATIN AMERICAN' WHEN 5 THEN 'ASIAN - CHINESE'
    WHEN 6 THEN 'PORTUGUESE' WHEN 7 THEN 'AMERICAN WHITE' END AS ethnicity,
  CASE WHEN o.o_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
  TIMESTAMP '1905-01-01 00:00:00' + ((o.o_custkey * 7919) % 36000) * INTERVAL '1' DAY AS dob,
  CASE WHEN o.o_custkey % 5 = 0 THEN CAST(CAST(o.last_disch AS DATE) AS TIMESTAMP)
       + (o.o_custkey % 60) * INTERVAL '1' DAY
       WHEN o.o_custkey % 5 = 1 THEN CAST(CAST(o.first_disch AS DATE) AS TIMESTAMP)
       + (o.o_custkey % 61 - 5) * INTERVAL '1' DAY END AS dod,
  CASE WHEN o.o_orderkey % 20 = 0 THEN 0 ELSE 1 END AS has_chartevents_data,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'URGENT' WHEN '2-HIGH' THEN 'EMERGENCY'
    WHEN '3-MEDIUM' THEN 'ELECTIVE' WHEN '4-NOT SPECIFIED' THEN 'NEWBORN' END AS admission_type,
  CASE o.o_orderkey % 6 WHEN 0 THEN 'CCU' WHEN 1 THEN 'CSRU' WHEN 2 THEN 'MICU' WHEN 3 THEN 'SICU'
    WHEN 4 THEN 'TSICU' END AS first_careunit,
  CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Government' WHEN 'BUILDING' THEN 'Medicaid'
    WHEN 'FURNITURE' THEN 'Medicare' WHEN 'HOUSEHOLD' THEN 'Private' ELSE 'Self Pay' END AS insurance
FROM (SELECT *, MAX(dischtime) OVER (PARTITION BY o_custkey) AS last_disch,
             ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY admittime DESC, o_orderkey DESC) AS rn_last,
             ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY admittime, o_orderkey) AS rn_first,
             FIRST_VALUE(dischtime) OVER (PARTITION BY o_custkey ORDER BY admittime, o_orderkey) AS first_disch
      FROM (SELECT *, admittime0 + ((o_orderkey * 37) % 400) * INTERVAL '1' HOUR
                      + (o_orderkey % 60) * INTERVAL '1' MINUTE AS dischtime, admittime0 AS admittime
            FROM (SELECT *, o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR AS admittime0 FROM orders) a) b) o
JOIN customer c ON o.o_custkey = c.c_custkey
""")

AGE = """CASE WHEN admittime < dob THEN 0 ELSE year(admittime) - year(dob)
  - CAST((month(admittime) * 100 + day(admittime)) < (month(dob) * 100 + day(dob)) AS INT) END"""


def hours(start: str, end: str) -> str:
    return f"CAST(floor((epoch_us({end}) - epoch_us({start})) / 3600000000.0) AS BIGINT)"


def days(start: str, end: str) -> str:
    return f"CAST(floor((epoch_us({end}) - epoch_us({start})) / 86400000000.0) AS BIGINT)"


_HOSPS = f"""
SELECT subject_id, hadm_id, admittime, dischtime, deathtime, ethnicity, gender, dob, dod,
  CAST({AGE} AS BIGINT) AS age, CAST({hours('admittime', 'dischtime')} AS DOUBLE) AS los_hosp_hr
FROM {{source}}"""

_view("hosps", ("adm",), _HOSPS.format(source="adm WHERE has_chartevents_data = 1"))
_view("cohort", (), "SELECT c_custkey AS subject_id FROM customer WHERE c_custkey % 4 <> 0")

_view("severity", ("adm",), """
SELECT a.subject_id, a.hadm_id, k.score_no, d.seq, CAST((a.hadm_id * k.score_no + d.seq) % 20 AS INTEGER) AS score
FROM adm a CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7)) AS k(score_no) CROSS JOIN (VALUES (0),(1)) AS d(seq)
WHERE (a.hadm_id + k.score_no) % 11 <> 0 AND (d.seq = 0 OR a.hadm_id % 4 = 0)
""")

_view("meas", (), """
SELECT user_id AS subject_id, user_id * 3 + blk AS hadm_id, event_id, ts AS charttime, itemid,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS valuenum,
  CASE WHEN event_id % 11 = 0 THEN 1 WHEN event_id % 13 = 0 THEN NULL ELSE 0 END AS error
FROM (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-11 00:00:00' THEN 0
                     WHEN ts < TIMESTAMP '2024-01-21 00:00:00' THEN 1 ELSE 2 END AS blk,
  CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS itemid
  FROM events) e
""")

_view("adm_ev", (), """
SELECT user_id AS subject_id, user_id * 3 + b.blk AS hadm_id, user_id * 3 + b.blk AS icustay_id,
  TIMESTAMP '2024-01-01 00:00:00' + (b.blk * 10) * INTERVAL '1' DAY + (user_id % 24) * INTERVAL '1' HOUR AS admittime
FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES (0),(1),(2)) AS b(blk)
""")

_view("meta", (), """
SELECT * FROM (VALUES (1,'heart rate',1.0,150.0),(2,'sodium',2.0,120.0),(3,'glucose',0.5,200.0),
  (4,'TempF',10.0,110.0),(5,'hemoglobin',1.0,90.0)) AS t(itemid, feature_name, min_v, max_v)
""")

_view("stay", ("adm_ev",), """
SELECT subject_id, hadm_id, icustay_id,
  admittime + (subject_id % 7) * INTERVAL '1' HOUR + INTERVAL '30' MINUTE AS intime FROM adm_ev
""")

_view("kdigo", ("meas",), """
SELECT hadm_id AS icustay_id, charttime, CASE WHEN itemid = 1 THEN valuenum END AS creat,
  CASE WHEN itemid = 1 THEN CASE WHEN valuenum > 100 THEN 3 WHEN valuenum > 60 THEN 2 WHEN valuenum > 30 THEN 1 ELSE 0 END END AS aki_stage_creat,
  CASE WHEN itemid = 2 THEN CASE WHEN valuenum > 120 THEN 3 WHEN valuenum > 80 THEN 2 WHEN valuenum > 40 THEN 1 ELSE 0 END END AS aki_stage_uo,
  valuenum / 6.0 AS uo_rt_6hr, valuenum / 12.0 AS uo_rt_12hr, valuenum / 24.0 AS uo_rt_24hr
FROM meas
""")

_view("hourly", ("meas",), """
SELECT subject_id, hadm_id, hadm_id AS icustay_id, CAST(event_id % 60 AS INTEGER) AS hours_in,
  AVG(CASE WHEN itemid = 1 THEN valuenum END) AS heart_rate, AVG(CASE WHEN itemid = 2 THEN valuenum END) AS sodium,
  AVG(CASE WHEN itemid = 3 THEN valuenum END) AS glucose, AVG(CASE WHEN itemid = 4 THEN valuenum END) AS temperature,
  AVG(CASE WHEN itemid = 5 THEN valuenum END) AS hemoglobin,
  AVG(CASE WHEN itemid = 1 THEN 50 + valuenum END) AS weight, AVG(CASE WHEN itemid = 2 THEN valuenum * 3 END) AS height
FROM meas GROUP BY subject_id, hadm_id, event_id % 60
""")

_view("interv", ("meas",), """
SELECT subject_id, hadm_id, hadm_id AS icustay_id, CAST(event_id % 60 AS INTEGER) AS hours_in,
  MAX(CASE WHEN itemid = 3 THEN 1 ELSE 0 END) AS vent, MAX(CASE WHEN itemid = 4 THEN 1 ELSE 0 END) AS vaso
FROM meas GROUP BY subject_id, hadm_id, event_id % 60
""")

_view("ext_static", ("adm_ev", "stay"), """
SELECT subject_id, hadm_id, icustay_id, CAST(20 + subject_id % 65 AS BIGINT) AS age,
  CASE WHEN subject_id % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
  CASE subject_id % 5 WHEN 0 THEN 'WHITE' WHEN 1 THEN 'BLACK' WHEN 2 THEN 'HISPANIC OR LATINO' WHEN 3 THEN 'ASIAN'
    ELSE 'OTHER' END AS ethnicity,
  CASE subject_id % 5 WHEN 0 THEN 'Government' WHEN 1 THEN 'Medicaid' WHEN 2 THEN 'Medicare' WHEN 3 THEN 'Private'
    ELSE 'Self Pay' END AS insurance,
  CASE subject_id % 6 WHEN 0 THEN 'CCU' WHEN 1 THEN 'CSRU' WHEN 2 THEN 'MICU' WHEN 3 THEN 'SICU' WHEN 4 THEN 'TSICU'
    END AS first_careunit,
  CASE subject_id % 4 WHEN 0 THEN 'ELECTIVE' WHEN 1 THEN 'EMERGENCY' WHEN 2 THEN 'URGENT' END AS admission_type,
  a.admittime, a.admittime + (50 + subject_id * 13 % 180) * INTERVAL '1' HOUR AS dischtime,
  CASE WHEN subject_id % 6 = 0 THEN a.admittime + INTERVAL '49' HOUR END AS deathtime,
  CASE WHEN subject_id % 4 = 0 THEN 1 WHEN subject_id % 4 = 1 THEN 0 END AS dnr,
  a.admittime + (subject_id % 90) * INTERVAL '1' HOUR + INTERVAL '59' MINUTE AS dnr_first_charttime
FROM adm_ev a JOIN (SELECT icustay_id, intime FROM stay) s USING (icustay_id)
""")

_view("static2", ("ext_static",), """
SELECT * FROM ext_static
UNION ALL SELECT * REPLACE (icustay_id + 1000000 AS icustay_id) FROM ext_static WHERE hadm_id % 3 = 0
""")

for _hours in ("hourly", "interv"):
    _view(f"{_hours}2", (_hours,), f"""
SELECT * REPLACE (CASE WHEN hadm_id % 3 = 0 AND hours_in >= 30 THEN hadm_id + 1000000 ELSE icustay_id END AS icustay_id)
FROM {_hours}
""")

_view("ev_patients", ("ext_static",), """
SELECT subject_id, gender, TIMESTAMP '2000-01-01 00:00:00' - age * INTERVAL '365' DAY AS dob,
  CASE WHEN subject_id % 7 = 0 THEN leave + (subject_id % 60) * INTERVAL '1' DAY END AS dod
FROM (SELECT subject_id, MIN(gender) AS gender, MIN(age) AS age, MIN(dischtime) AS leave FROM ext_static GROUP BY subject_id)
""")

_view("ev_hosps", ("ext_static", "ev_patients"), _HOSPS.format(source="""(
  SELECT e.subject_id, e.hadm_id, e.admittime, e.dischtime, e.deathtime, e.ethnicity, p.gender, p.dob, p.dod
  FROM ext_static e JOIN ev_patients p ON e.subject_id = p.subject_id)"""))

_view("ev_cohort", (), "SELECT DISTINCT user_id AS subject_id FROM events WHERE user_id % 4 <> 3")

_view("ev_severity", ("adm_ev",), """
SELECT a.subject_id, a.hadm_id, k.score_no, d.seq, CAST((a.hadm_id * k.score_no + d.seq) % 20 AS INTEGER) AS score
FROM adm_ev a CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7)) AS k(score_no) CROSS JOIN (VALUES (0),(1)) AS d(seq)
WHERE (a.hadm_id + k.score_no) % 11 <> 0 AND (d.seq = 0 OR a.hadm_id % 4 = 0)
""")

_view("scored", (), """
SELECT l.doc_id AS row_id, l.quality AS y,
  ROUND(CAST((d.n_chars * 7 + l.quality * 300 + d.doc_id % 50) % 997 AS DOUBLE) / 997.0, 2) AS score
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
""")

_view("feat", (), """
SELECT o.o_orderkey AS row_id, CAST(o.o_custkey % 2 AS INTEGER) AS gender, CAST(18 + o.o_custkey % 72 AS INTEGER) AS age,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE l.qty END AS qty, CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE l.disc END AS disc,
  o.o_totalprice AS price, CAST(NULL AS DOUBLE) AS empty_col, CAST(1.0 AS DOUBLE) AS const_col,
  CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS vent,
  CASE WHEN l.qty > 120 OR o.o_orderkey % 10 = 3 THEN 1 ELSE 0 END AS y
FROM orders o LEFT JOIN (SELECT l_orderkey, SUM(l_quantity) AS qty, AVG(l_discount) AS disc FROM lineitem GROUP BY l_orderkey) l
  ON o.o_orderkey = l.l_orderkey
""")


def with_views(names: list[str], steps: list[tuple[str, str]], final: str) -> str:
    """A query over the named views and their own views, extra named steps, and a final SELECT."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in VIEWS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in ordered] + [f"{n} AS ({sql.strip()})" for n, sql in steps]
    return "WITH " + ",\n".join(parts) + "\n" + final.strip()
