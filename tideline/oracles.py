"""For each query the SQL that gives the same rows in DuckDB, relational where the operators use arrays."""

from __future__ import annotations

_TIME = r"'\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}'"

#: Each step reads those before it.
_STEPS: dict[str, str] = {
    "f0": "SELECT event_id AS e, user_id AS u, date_trunc('hour', ts) AS h, event_type, value, props FROM events",
    "raw": """SELECT CASE WHEN e % 2 = 0 THEN 'monitor' ELSE 'wearable' END AS source_file, CASE WHEN e % 2 = 0 THEN 'VITAL' ELSE 'WEARABLE' END AS domain,
      CASE WHEN e % 199 = 0 THEN '' ELSE CAST(e AS VARCHAR) END AS record_id, CASE WHEN e % 211 = 0 THEN '' ELSE 'U' || u END AS patient_id,
      CASE WHEN e % 2 = 0 THEN 'D1' END AS device_id, CASE WHEN e % 223 = 0 THEN 'soon' ELSE strftime(h, '%Y-%m-%d %H:%M:%S') END AS event_time,
      CASE WHEN e % 229 = 0 THEN 'later' WHEN e % 227 = 0 THEN strftime(h - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') ELSE strftime(h + to_minutes((e * 7) % 31), '%Y-%m-%d %H:%M:%S') END AS available_time,
      event_type AS variable_code,
      CASE WHEN e % 233 = 0 THEN '' WHEN e % 31 = 0 THEN 'LOW' WHEN e % 5 = 0 THEN CAST(CAST(value * 10 AS DECIMAL(18,4)) AS VARCHAR)
        WHEN e % 5 = 1 THEN CAST(CAST(value - 5 AS DECIMAL(18,4)) AS VARCHAR) ELSE CAST(CAST(value AS DECIMAL(18,4)) AS VARCHAR) END AS value,
      CASE WHEN e % 239 = 0 THEN 'zz' WHEN e % 5 = 0 THEN 'x10' WHEN e % 5 = 1 THEN 'shift' ELSE 'raw' END AS unit,
      CASE WHEN e % 37 = 0 THEN 'LOW_SIGNAL' ELSE 'OK' END AS quality_flag, CASE WHEN e % 41 = 0 THEN 'RETRANSMIT' ELSE 'DIRECT' END AS source_system,
      CASE WHEN event_type IN ('signup', 'view') AND e % 7 <> 0 THEN e % 4 + 3 END AS ref_low, CASE WHEN event_type IN ('signup', 'view') AND e % 13 <> 0 THEN e % 11 + 75 END AS ref_high
      FROM f0""",
    "units(unit_code, factor, unit_offset)": "VALUES ('raw', 1.0::DOUBLE, 0.0::DOUBLE), ('x10', 0.1, 0.0), ('shift', 1.0, 5.0)",
    "vars(variable_code, lo, hi)": "VALUES ('click', 0.0::DOUBLE, 224.0::DOUBLE), ('error', 0.0, 224.0), ('purchase', 0.0, 224.0), ('signup', 0.0, 224.0), ('view', 0.0, NULL)",
    "typed0": f"""SELECT r.*, unit_code, factor, unit_offset, lo, hi, CASE WHEN regexp_full_match(event_time, {_TIME}) THEN CAST(event_time AS TIMESTAMP) END AS et,
      CASE WHEN regexp_full_match(available_time, {_TIME}) THEN CAST(available_time AS TIMESTAMP) END AS av, TRY_CAST(nullif(value, '') AS DOUBLE) AS number
      FROM raw r LEFT JOIN units ON unit = unit_code LEFT JOIN vars USING (variable_code)""",
    "typed": """SELECT *, CASE WHEN record_id = '' THEN 'NO_RECORD_ID' WHEN patient_id = '' THEN 'NO_PATIENT' WHEN et IS NULL THEN 'BAD_EVENT_TIME' WHEN av IS NULL THEN 'BAD_AVAILABLE_TIME'
      WHEN av < et THEN 'TIME_ORDER' WHEN unit_code IS NULL THEN 'UNIT_UNKNOWN' WHEN value = '' THEN 'NO_VALUE' END AS reason FROM typed0""",
    "acc": """SELECT source_file, record_id, domain, patient_id, device_id, variable_code, et, av, number * factor + unit_offset AS v, CASE WHEN number IS NULL THEN value END AS value_text, number AS value_raw, unit,
      quality_flag, ref_low, ref_high, CASE WHEN number * factor + unit_offset IS NULL OR lo IS NULL OR hi IS NULL THEN TRUE ELSE number * factor + unit_offset BETWEEN lo AND hi END AS ok, source_system = 'RETRANSMIT' AS re
      FROM typed WHERE reason IS NULL""",
    "iv0": f"""SELECT CAST(e AS VARCHAR) AS record_id, 'U' || u AS patient_id, CASE event_type WHEN 'purchase' THEN 'CONTEXT' ELSE 'CONNECTIVITY' END AS kind,
      CASE WHEN event_type = 'error' THEN 'LINK_LOSS' WHEN e % 4 = 0 THEN 'RECOVERY_PHASE' ELSE 'PHYSICAL_ACTIVITY' END AS subtype, ['LOW', 'MODERATE', 'HIGH'][e % 3 + 1] AS value_text,
      CASE WHEN e % 223 <> 0 THEN h END AS st, h + to_hours(CASE WHEN e % 53 = 0 THEN -1 ELSE 6 END) AS en, '{{"delayed_records":' || coalesce('"' || json_extract_string(props, '$.k') || '"', 'null') || '}}' AS extra_json
      FROM f0 WHERE event_type IN ('purchase', 'error')""",
    "iv1": "SELECT *, CASE WHEN st IS NULL THEN 'BAD_EVENT_TIME' WHEN en < st THEN 'TIME_ORDER' END AS reject_reason FROM iv0",
    "iv": "SELECT * FROM iv1 WHERE reject_reason IS NULL",
    "links": "SELECT a.source_file, a.record_id, max(i.en) AS link_end FROM acc a JOIN iv i ON i.patient_id = a.patient_id AND i.kind = 'CONNECTIVITY' AND a.et BETWEEN i.st AND i.en WHERE a.re GROUP BY ALL",
    "known": "SELECT a.* REPLACE (greatest(a.av, coalesce(l.link_end, a.av)) AS av), NOT a.re OR l.link_end IS NOT NULL AS known FROM acc a LEFT JOIN links l ON a.re AND l.source_file = a.source_file AND l.record_id = a.record_id",
    "obs": "SELECT *, row_number() OVER (PARTITION BY patient_id, variable_code, et ORDER BY av, re, record_id) > 1 AS dup FROM known",
    "enc": "SELECT patient_id, min(et) AS st, max(et) AS en, min(et) + INTERVAL 576 HOUR AS first FROM obs GROUP BY patient_id",
    "grid": "SELECT patient_id, k, first + to_hours(24 * k) AS t FROM (SELECT *, unnest(range(0, CAST(floor(epoch(en - first) / 86400) AS BIGINT) + 1)) AS k FROM enc WHERE first <= en)",
    "vis": "SELECT g.t, o.* FROM obs o JOIN grid g ON o.patient_id = g.patient_id AND o.et <= g.t AND o.av <= g.t AND o.et >= g.t - INTERVAL 576 HOUR WHERE NOT dup AND known",
    "fc": "SELECT 'F' || c_custkey AS record_id, 'U' || c_custkey AS patient_id, c_mktsegment AS category, CASE WHEN c_custkey % 17 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 28 AS INT)) END AS av FROM customer",
    "last": "SELECT patient_id, max(t) AS t FROM grid GROUP BY patient_id",
    "ch(variable_code, place, direction, weight)": "VALUES ('click', 0, 1, 1.0::DOUBLE), ('error', 1, 1, 1.0), ('purchase', 2, 1, 1.0), ('signup', 3, -1, 0.5), ('view', 4, -1, 0.5)",
    "bl": "SELECT patient_id, t, variable_code, median(v) AS centre, count(*) AS n_baseline FROM vis WHERE ok AND v IS NOT NULL AND et <= t - INTERVAL 192 HOUR GROUP BY ALL HAVING count(*) >= 3",
    "sc": """SELECT b.patient_id, b.t, b.variable_code, any_value(centre) AS centre, any_value(n_baseline) AS n_baseline, greatest(median(abs(v - centre)) * 1.4826, 12.0) AS scale
      FROM bl b JOIN vis x ON x.patient_id = b.patient_id AND x.t = b.t AND x.variable_code = b.variable_code WHERE ok AND v IS NOT NULL AND et <= b.t - INTERVAL 192 HOUR GROUP BY b.patient_id, b.t, b.variable_code""",
    "ev0": "SELECT patient_id, t, variable_code, et, av, record_id, source_file, v, count(*) OVER w AS n_evidence, row_number() OVER (w ORDER BY et, record_id) AS i FROM vis WHERE ok AND v IS NOT NULL AND et >= t - INTERVAL 192 HOUR WINDOW w AS (PARTITION BY patient_id, t, variable_code)",
    "ev": "SELECT e.*, s.centre, s.scale, s.n_baseline, (v - s.centre) / s.scale * c.direction AS z FROM ev0 e JOIN sc s USING (patient_id, t, variable_code) JOIN ch c USING (variable_code) WHERE n_evidence >= 3",
    "lv": "SELECT patient_id, t, variable_code, median(z) AS level FROM ev WHERE i > n_evidence - greatest(1, n_evidence // 3) GROUP BY ALL",
    "sl": """SELECT a.patient_id, a.t, a.variable_code, median((b.z - a.z) / (epoch(b.et - a.et) / 3600)) * 192 AS slope FROM ev a JOIN ev b
      ON a.patient_id = b.patient_id AND a.t = b.t AND a.variable_code = b.variable_code AND b.i > a.i AND b.et <> a.et WHERE a.n_evidence >= 5 GROUP BY ALL""",
    "run": "SELECT patient_id, t, variable_code, max(n) AS streak FROM (SELECT patient_id, t, variable_code, i - j AS island, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, t, variable_code ORDER BY i) AS j FROM ev WHERE z > 0.5) GROUP BY ALL) GROUP BY ALL",
    "bad": "SELECT patient_id, t, variable_code, count(*) AS bad FROM vis WHERE NOT ok AND et >= t - INTERVAL 192 HOUR GROUP BY ALL",
    "m0": """SELECT patient_id, t, variable_code, any_value(n_evidence) AS n_evidence, any_value(n_baseline) AS n_baseline, any_value(centre) AS centre, any_value(scale) AS scale, max(av) AS newest FROM ev GROUP BY ALL""",
    "m1": """SELECT m0.*, level, coalesce(slope, 0.0) AS slope, coalesce(streak, 0) AS streak, least(1.0, coalesce(streak, 0) / 2.0) AS persistence, least(1.0, n_evidence / 4.0) AS coverage, coalesce(bad, 0) AS bad, weight, place
      FROM m0 JOIN ch USING (variable_code) LEFT JOIN lv USING (patient_id, t, variable_code) LEFT JOIN sl USING (patient_id, t, variable_code) LEFT JOIN run USING (patient_id, t, variable_code) LEFT JOIN bad USING (patient_id, t, variable_code)""",
    "mm": "SELECT *, CASE WHEN n_evidence >= 5 THEN greatest(0.0, least((0.5 * level + 0.5 * slope) * persistence, 6.0)) ELSE greatest(0.0, least(level * persistence, 3.0)) END AS score FROM m1",
    "lab0": "SELECT *, row_number() OVER (PARTITION BY patient_id, t, variable_code ORDER BY et DESC, record_id) AS newest FROM vis WHERE ok AND v IS NOT NULL AND et >= t - INTERVAL 192 HOUR AND variable_code IN ('signup', 'view')",
    "lab": "SELECT patient_id, t, variable_code, record_id, coalesce(ref_low IS NOT NULL AND ref_high IS NOT NULL AND (v < ref_low OR v > ref_high), FALSE) AS abnormal FROM lab0 WHERE newest = 1",
    "ctx": """SELECT DISTINCT g.patient_id, g.t FROM grid g JOIN iv i ON i.patient_id = g.patient_id AND i.kind = 'CONTEXT' AND i.st <= g.t AND least(i.en, g.t) >= g.t - INTERVAL 192 HOUR
      WHERE subtype = 'RECOVERY_PHASE' OR value_text IN ('HIGH', 'MODERATE')""",
    "ln": "SELECT patient_id, t, least(2, count(*) FILTER (abnormal)) AS lab_n FROM lab GROUP BY ALL",
    "a0": """SELECT patient_id, t, count(*) FILTER (score >= 1) AS k, sum(weight * score) AS weighted, sum(score) AS score_sum, coalesce(sum(score) FILTER (variable_code = 'click'), 0) AS lead_score,
      max(persistence) FILTER (score > 0) AS pmax, CAST(sum(bad) AS BIGINT) AS bad, CAST(sum(n_evidence) AS BIGINT) AS good, max(newest) AS newest, avg(coverage) AS coverage, coalesce(avg(coverage) FILTER (score > 0), avg(coverage)) AS live_coverage FROM mm GROUP BY ALL""",
    "a1": """SELECT a0.*, coalesce(lab_n, 0) AS lab_n, c.t IS NOT NULL AS active, weighted * [0.0, 0.40, 0.80, 1.15, 1.40, 1.40][k + 1] + CASE WHEN k >= 1 THEN coalesce(lab_n, 0) ELSE 0 END AS raw,
      CASE WHEN score_sum > 0 THEN lead_score / score_sum ELSE 0 END AS share, bad / (bad + good) AS bad_share
      FROM a0 LEFT JOIN ln USING (patient_id, t) LEFT JOIN ctx c ON c.patient_id = a0.patient_id AND c.t = a0.t""",
    "ru": """SELECT patient_id, t, rule, strength, n FROM (
      SELECT patient_id, t, 1 AS n, CASE WHEN share >= 0.55 THEN 'activity' ELSE 'activity_considered' END AS rule, CASE WHEN share >= 0.55 THEN 0.7 ELSE 0.0 END::DOUBLE AS strength FROM a1 WHERE active
      UNION ALL SELECT patient_id, t, 2, CASE WHEN bad_share >= 0.3 THEN 'quality' ELSE 'quality_noted' END, CASE WHEN bad_share >= 0.3 THEN 0.9 ELSE 0.0 END FROM a1 WHERE bad > 0
      UNION ALL SELECT patient_id, t, 3, 'transient', 0.8 FROM a1 WHERE pmax < 0.5 UNION ALL SELECT patient_id, t, 4, 'coverage', 0.0 FROM a1 WHERE live_coverage < 0.5)""",
    "rs": "SELECT patient_id, t, string_agg(rule, ',' ORDER BY n) AS names, product(1 - strength) AS kept, bool_or(strength > 0 OR rule = 'coverage') AS held FROM ru GROUP BY ALL",
    "a2": "SELECT a1.*, names, raw * coalesce(kept, 1) AS final, coalesce(held, FALSE) AS held, least(1.0, greatest(0.0, coverage * (good / (good + bad)) * greatest(0.3, least(1.0, 1 - epoch(a1.t - newest) / 60 / 2880)))) AS confidence FROM a1 LEFT JOIN rs USING (patient_id, t)",
    "a3": "SELECT *, CASE WHEN final > 0 THEN 1 - exp(-final / 12) ELSE 0.0 END AS risk, CASE WHEN raw > 0 THEN 1 - exp(-raw / 12) ELSE 0.0 END AS raw_risk FROM a2",
    "a4": """SELECT *, CASE WHEN risk >= 0.85 AND k >= 3 AND coalesce(pmax, 0) >= 0.6 AND coverage >= 0.7 AND NOT held THEN 3 WHEN risk >= 0.65 AND k >= 2 THEN 2 WHEN risk >= 0.4 THEN 1 ELSE 0 END AS band,
      CASE WHEN raw_risk >= 0.85 THEN 3 WHEN raw_risk >= 0.65 THEN 2 WHEN raw_risk >= 0.4 THEN 1 ELSE 0 END AS raw_band, CASE WHEN risk >= 0.85 THEN 3 WHEN risk >= 0.65 THEN 2 WHEN risk >= 0.4 THEN 1 ELSE 0 END AS risk_band FROM a3""",
    "ass": "SELECT *, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][band + 1] AS priority, row_number() OVER (PARTITION BY patient_id ORDER BY t) AS rn FROM a4",
    "fold": """SELECT patient_id, rn, t, CASE WHEN band >= 1 THEN band > 0 ELSE names IS NOT NULL AND raw > 0 AND raw_band >= 1 END AS emit, band < 1 AS demoted,
        CASE WHEN band >= 1 THEN greatest(0, band) ELSE band END AS state, CASE WHEN band >= 1 OR (names IS NOT NULL AND raw > 0 AND raw_band >= 1) THEN t END AS last_t, CASE WHEN band >= 1 OR (names IS NOT NULL AND raw > 0 AND raw_band >= 1) THEN risk ELSE 0.0 END AS last_risk
      FROM ass WHERE rn = 1
      UNION ALL
      SELECT patient_id, rn, t, emit, demoted, CASE WHEN demoted THEN band ELSE greatest(old, band) END, CASE WHEN emit THEN t ELSE last_t END, CASE WHEN emit THEN risk ELSE last_risk END
      FROM (SELECT a.patient_id, a.rn, a.t, a.band, a.risk, f.state AS old, f.last_t, f.last_risk, a.band < 1 AS demoted,
          CASE WHEN a.band >= 1 THEN a.band > f.state OR (a.band = f.state AND f.last_t IS NOT NULL AND a.t - f.last_t >= INTERVAL 72 HOUR AND a.risk - f.last_risk >= 0.10)
            ELSE a.names IS NOT NULL AND a.raw > 0 AND a.raw_band > a.band AND a.raw_band >= 1 AND (f.last_t IS NULL OR a.t - f.last_t >= INTERVAL 72 HOUR) END AS emit
        FROM fold f JOIN ass a ON a.patient_id = f.patient_id AND a.rn = f.rn + 1)""",
    "sig": """SELECT 'HS-' || a.patient_id || '-' || strftime(a.t, '%Y%m%dT%H%M') AS signal_id, a.*, f.demoted, coalesce(a.names, '') AS suppressions, a.t - INTERVAL 192 HOUR AS es FROM ass a JOIN fold f USING (patient_id, rn) WHERE f.emit""",
    "rk": "SELECT *, row_number() OVER (PARTITION BY patient_id, t ORDER BY score DESC, place) AS rank FROM mm WHERE score > 0",
    "zx": "SELECT *, first_value(i) OVER (PARTITION BY patient_id, t, variable_code ORDER BY z DESC, i) AS top FROM ev",
    "ci": """SELECT z.patient_id, z.t, z.record_id, z.source_file, z.variable_code, z.et, z.av, CASE WHEN rank = 1 THEN 'PRIMARY' ELSE 'SUPPORTING' END AS role, round(score, 4) AS contribution, rank
      FROM zx z JOIN rk r USING (patient_id, t, variable_code) WHERE i = 1 OR i = z.n_evidence OR i = top OR (z.n_evidence >= 6 AND i = z.n_evidence // 2 + 1)""",
    "nr": """SELECT a.*, coalesce(c.names_, []) AS names_, coalesce(c.directions, []) AS directions, coalesce(r.refs, []) AS refs FROM ass a LEFT JOIN (
        SELECT patient_id, t, list(variable_code ORDER BY rank) AS names_, list(CASE WHEN last_v >= centre THEN 'rise' ELSE 'fall' END ORDER BY rank) AS directions
        FROM rk JOIN (SELECT patient_id, t, variable_code, arg_max(v, i) AS last_v FROM ev GROUP BY ALL) USING (patient_id, t, variable_code) WHERE rank <= 5 GROUP BY ALL) c USING (patient_id, t)
      LEFT JOIN (SELECT patient_id, t, list(record_id ORDER BY rank, i) AS refs FROM ev JOIN rk USING (patient_id, t, variable_code) WHERE rank <= 5 GROUP BY ALL) r USING (patient_id, t)""",
    "evd": """SELECT DISTINCT * FROM (
        SELECT signal_id, patient_id, ci.source_file, ci.record_id, ci.role FROM sig JOIN ci USING (patient_id, t)
        UNION ALL SELECT signal_id, sig.patient_id, o.source_file, o.record_id, CASE WHEN abnormal THEN 'SUPPORTING' ELSE 'CONTEXT' END FROM sig JOIN lab USING (patient_id, t) JOIN obs o ON o.record_id = lab.record_id
        UNION ALL SELECT signal_id, sig.patient_id, 'intervals', i.record_id, 'CONTEXT' FROM sig JOIN iv i ON i.patient_id = sig.patient_id AND i.kind = 'CONTEXT' AND i.st <= sig.t AND least(i.en, sig.t) >= sig.es AND (i.subtype = 'RECOVERY_PHASE' OR i.value_text IN ('HIGH', 'MODERATE'))
        UNION ALL SELECT signal_id, patient_id, v.source_file, v.record_id, 'QUALITY' FROM sig JOIN vis v USING (patient_id, t) JOIN mm USING (patient_id, t, variable_code) WHERE NOT v.ok AND v.et >= sig.es
        UNION ALL SELECT signal_id, patient_id, ci.source_file, ci.record_id, 'QUALITY' FROM sig JOIN ru USING (patient_id, t) JOIN ci USING (patient_id, t) WHERE rule = 'transient' AND ci.role = 'PRIMARY'
        UNION ALL SELECT signal_id, sig.patient_id, 'intervals', i.record_id, 'QUALITY' FROM sig JOIN ru USING (patient_id, t) JOIN iv i ON i.patient_id = sig.patient_id AND i.kind = 'CONNECTIVITY' AND i.st <= sig.t AND least(i.en, sig.t) >= sig.es WHERE rule = 'coverage'
        UNION ALL SELECT signal_id, sig.patient_id, 'customers', f.record_id, 'CONTEXT' FROM sig JOIN ru USING (patient_id, t) JOIN fc f ON f.patient_id = sig.patient_id AND f.av <= sig.t AND f.category IN ('BUILDING', 'MACHINERY') WHERE rule = 'known_condition'
        UNION ALL SELECT signal_id, sig.patient_id, o.source_file, o.record_id, 'QUALITY' FROM sig JOIN obs o ON o.patient_id = sig.patient_id WHERE (o.dup OR NOT o.known) AND o.av <= sig.t AND o.et BETWEEN sig.es AND sig.t)""",
}


def _sql(select: str, changed: dict[str, str] | None = None) -> str:
    """``select`` over the steps, some of them ``changed``."""
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({body})" for name, body in (_STEPS | (changed or {})).items()) + "\n" + select


def _t(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def _r(column: str) -> str:
    return f"round({column}, 6) + 0.0::DOUBLE"


_CHANNEL = f"SELECT patient_id, {_t('t')} AS t, variable_code, "
_RULE = f"SELECT patient_id, {_t('t')} AS t, rule, strength FROM ru WHERE rule IN "

_VARIANT = """
SELECT '{name}' AS variant, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][band + 1] AS priority, count(*) AS n, round(max(risk), 6) + 0.0::DOUBLE AS risk_max FROM (
  SELECT *, CASE WHEN risk >= 0.85 AND k >= 3 AND coalesce(pmax, 0) >= 0.6 AND coverage >= 0.7 THEN 3 WHEN risk >= 0.65 AND k >= 2 THEN 2 WHEN risk >= 0.4 THEN 1 ELSE 0 END AS band FROM (
    SELECT *, CASE WHEN raw > 0 THEN 1 - exp(-raw / 12) ELSE 0.0 END AS risk FROM (
      SELECT q.*, weighted * {factor} + CASE WHEN k >= 1 THEN coalesce(lab_n, 0) ELSE 0 END AS raw FROM (
        SELECT patient_id, t, count(*) FILTER (s >= 1) AS k, sum(weight * s) AS weighted, max(p) FILTER (s > 0) AS pmax, avg(coverage) AS coverage FROM (
          SELECT *, CASE WHEN n_evidence >= 5 THEN greatest(0.0, least((0.5 * level + 0.5 * slope) * p, {top})) ELSE greatest(0.0, least(level * p, {top} / 2)) END AS s FROM (SELECT *, {persistence} AS p FROM m1)) GROUP BY ALL) q
      LEFT JOIN ln USING (patient_id, t)))) GROUP BY ALL"""
_FACTORS = "[0.0, 0.40, 0.80, 1.15, 1.40, 1.40][k + 1]"
_FLAT, _ALL = "CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END", "least(1.0, n_evidence / 2.0)"
_ABLATION = " UNION ALL ".join(
    "(" + _VARIANT.format(name=n, factor=f, top=top, persistence=p) + ")"
    for n, f, top, p in (("0_magnitude", _FLAT, "1e9", _ALL), ("1_ceiling", _FLAT, "6.0", _ALL), ("2_persistence", _FLAT, "6.0", "persistence"), ("3_concordance", _FACTORS, "6.0", "persistence"))
) + " UNION ALL SELECT '4_suppression', priority, count(*), round(max(risk), 6) + 0.0::DOUBLE FROM ass GROUP BY ALL"

_MARKERS = {
    "activity": "EXISTS (SELECT 1 FROM iv i WHERE i.patient_id = s.patient_id AND i.kind = 'CONTEXT' AND i.subtype = 'PHYSICAL_ACTIVITY' AND i.value_text IN ('HIGH', 'MODERATE') AND i.st <= s.t AND i.en >= s.es)",
    "recovery": "EXISTS (SELECT 1 FROM iv i WHERE i.patient_id = s.patient_id AND i.kind = 'CONTEXT' AND i.subtype = 'RECOVERY_PHASE' AND i.st <= s.t AND i.en >= s.es)",
    "connectivity": "EXISTS (SELECT 1 FROM iv i WHERE i.patient_id = s.patient_id AND i.kind = 'CONNECTIVITY' AND i.st <= s.t AND i.en >= s.es)",
    "low_signal": "EXISTS (SELECT 1 FROM obs o WHERE o.patient_id = s.patient_id AND o.quality_flag = 'LOW_SIGNAL' AND o.et BETWEEN s.es AND s.t)",
    "implausible": "EXISTS (SELECT 1 FROM obs o WHERE o.patient_id = s.patient_id AND NOT o.ok AND o.et BETWEEN s.es AND s.t)",
    "retransmission": "EXISTS (SELECT 1 FROM obs o WHERE o.patient_id = s.patient_id AND o.dup AND o.et BETWEEN s.es AND s.t)",
}

_ANY = " OR ".join(_MARKERS.values())
_URGENT = f"""SELECT '{{name}}' AS variant, count(*) AS urgent, count(*) FILTER (k <= 1) AS single, count(*) FILTER (marked AND suppressions = '') AS silent, count(DISTINCT patient_id) AS patients
  FROM (SELECT s.*, {_ANY} AS marked FROM sig s WHERE band >= 2)"""


def _changed(factor: str = _FACTORS, top: str = "6.0", persistence: bool = True, rules: bool = True) -> dict[str, str]:
    """The steps of a variant, as those of the full profile with the switched parts replaced."""
    out = {"a1": _STEPS["a1"].replace(_FACTORS, factor), "mm": _STEPS["mm"].replace("6.0", top).replace("3.0", f"{top} / 2")}
    if not persistence:
        out["m1"] = _STEPS["m1"].replace("least(1.0, coalesce(streak, 0) / 2.0)", _ALL)
    if not rules:
        out["ru"] = f"SELECT * FROM ({_STEPS['ru']}) WHERE FALSE"
    return out


_LADDER = {
    "0_magnitude": _changed(_FLAT, "1e9", False, False), "1_ceiling": _changed(_FLAT, "6.0", False, False), "2_persistence": _changed(_FLAT, "6.0", True, False), "3_concordance": _changed(rules=False), "4_suppression": {},
}

#: Faults of the planted submission: a rule and which signals (u, once and the repeated ones) or citations (n, with the signal's u) break it.
_FAULTS = {"signal_id": "u % 13 = 0", "risk": "u % 7 = 0", "priority": "u % 10 = 0", "confidence": "u % 3 <> 0 AND u % 11 = 0", "times": "u % 5 = 0", "time_order": "u % 4 = 0", "explanation": "u % 6 = 0", "model_version": "u % 8 = 0"}
_CITED = {"role": "n % 10 = 0", "source_file": "n % 6 = 0", "late_evidence": "n % 8 = 0 AND n % 17 <> 0 AND u % 13 <> 0 AND u % 5 <> 0", "contribution": "n % 9 = 0", "no_signal": "n % 17 = 0 OR u % 13 = 0"}
_SUBMISSION = (
    "SELECT rule, count(*) AS n FROM (WITH s0 AS (SELECT signal_id, CAST(substr(patient_id, 2) AS INT) AS u FROM sig), s AS (SELECT * FROM s0 UNION ALL SELECT * FROM s0 WHERE u % 9 = 0 AND u % 29 <> 0),"
    " c AS (SELECT signal_id, CAST(substr(patient_id, 2) AS INT) AS u, CAST(ci.record_id AS INT) AS n FROM sig JOIN ci USING (patient_id, t) WHERE CAST(substr(patient_id, 2) AS INT) % 14 <> 0) "
    + " UNION ALL ".join([f"SELECT '{rule}' AS rule FROM s WHERE {test}" for rule, test in _FAULTS.items()] + [f"SELECT '{rule}' FROM c WHERE {test}" for rule, test in _CITED.items()])
    + " UNION ALL SELECT 'unknown_patient' FROM s WHERE u % 29 = 0 UNION ALL SELECT 'repeated_id' FROM s0 WHERE u % 9 = 0 AND u % 29 <> 0 AND u % 13 <> 0"
    " UNION ALL SELECT 'no_evidence' FROM s0 WHERE u % 13 <> 0 AND NOT EXISTS (SELECT 1 FROM c WHERE c.signal_id = s0.signal_id AND n % 17 <> 0)) GROUP BY rule"
)

_SELECTS: dict[str, str] = {
    "early_warning": f"SELECT patient_id, {_t('t')} AS t, k, {_r('raw')} AS raw, {_r('final')} AS final, {_r('risk')} AS risk, {_r('confidence')} AS confidence, priority FROM ass",
    "csv_adapter_union": "SELECT source_file, domain, record_id, patient_id, device_id, event_time, available_time, variable_code, value, unit FROM raw",
    "unit_conversion": f"SELECT record_id, unit AS unit_raw, {_r('value_raw')} AS value_raw, {_r('v')} AS value_num, value_text FROM acc",
    "plausibility_gate": f"SELECT variable_code, ok AS is_plausible, count(*) AS n, {_r('max(v)')} AS greatest FROM acc GROUP BY ALL",
    "reject_ladder": "SELECT source_file, record_id, patient_id, reason AS reject_reason, concat_ws(' | ', 'event=' || event_time, 'available=' || available_time, 'value=' || value, 'unit=' || unit) AS detail FROM typed WHERE reason IS NOT NULL",
    "read_loaded_quarantined": "SELECT source_file, count(*) AS n_read, count(*) FILTER (reason IS NULL) AS n_loaded, count(reason) AS n_quarantined FROM typed GROUP BY ALL",
    "interval_validity": "SELECT kind, subtype, reject_reason, count(*) AS n, min(extra_json) AS extra_json FROM iv1 GROUP BY ALL",
    "availability_resolution": f"SELECT record_id, {_t('av')} AS available_time, known AS is_availability_known FROM known WHERE re",
    "availability_unknown_anti": "SELECT record_id FROM acc a WHERE re AND NOT EXISTS (SELECT 1 FROM iv i WHERE i.patient_id = a.patient_id AND i.kind = 'CONNECTIVITY' AND a.et BETWEEN i.st AND i.en)",
    "dedupe_row_number": "SELECT source_file, record_id, variable_code FROM obs WHERE dup",
    "decision_grid": f"SELECT patient_id, k, {_t('t')} AS t FROM grid",
    "asof_snapshot": f"SELECT patient_id, {_t('t')} AS t, count(*) AS n, {_t('max(av)')} AS newest, {_t('min(et)')} AS oldest FROM vis GROUP BY patient_id, vis.t",
    "hidden_at_t": f"SELECT o.patient_id, {_t('t')} AS t, record_id FROM obs o JOIN grid g ON o.patient_id = g.patient_id WHERE et <= t AND av > t AND NOT dup",
    "baseline_median_mad": _CHANNEL + f"n_baseline, {_r('centre')} AS centre, {_r('scale')} AS scale FROM mm",
    "last_third_level": _CHANNEL + f"n_evidence, {_r('level')} AS level FROM mm",
    "theil_sen": _CHANNEL + f"{_r('slope')} AS slope FROM mm",
    "longest_streak": _CHANNEL + f"streak, {_r('persistence')} AS persistence FROM mm",
    "coverage": _CHANNEL + f"{_r('coverage')} AS coverage FROM mm",
    "channel_score": _CHANNEL + f"{_r('score')} AS score FROM mm",
    "participation_gate": "SELECT variable_code, count(*) AS instants, CAST(sum(n_evidence) AS BIGINT) AS evidence, CAST(sum(n_baseline) AS BIGINT) AS baseline FROM mm GROUP BY ALL",
    "concordance_risk": f"SELECT k, count(*) AS n, {_r('max(risk)')} AS risk_max, {_r('max(weighted)')} AS weighted_max FROM ass GROUP BY ALL",
    "confidence": f"SELECT patient_id, {_t('t')} AS t, bad, good, {_r('coverage')} AS coverage, {_r('confidence')} AS confidence FROM ass",
    "priority_gate": "SELECT priority, count(*) AS n, count(DISTINCT patient_id) AS patients FROM ass GROUP BY ALL",
    "lab_corroboration": f"SELECT patient_id, {_t('t')} AS t, variable_code, record_id, abnormal FROM lab",
    "rule_activity": _RULE + "('activity', 'activity_considered')",
    "rule_quality": _RULE + "('quality', 'quality_noted')",
    "citations_topk": f"SELECT patient_id, {_t('t')} AS t, record_id, variable_code, role, contribution + 0.0::DOUBLE AS contribution FROM ci",
    "eventize": f"SELECT signal_id, patient_id, priority, {_r('round(risk, 6)')} AS risk, suppressions, demoted FROM sig",
    "history_peak_transitions": f"""SELECT patient_id, asked, asked - coalesce(ev_n, 0) AS skipped, n_low, n_medium, n_high, n_critical, transitions, peak_priority, {_t('peak_t')} AS peak_t, {_t('first_t')} AS first_evaluable
      FROM (SELECT patient_id, count(*) AS asked FROM grid GROUP BY ALL) LEFT JOIN (
        SELECT patient_id, count(*) AS ev_n, count(*) FILTER (band = 0) AS n_low, count(*) FILTER (band = 1) AS n_medium, count(*) FILTER (band = 2) AS n_high, count(*) FILTER (band = 3) AS n_critical,
          count(*) FILTER (before IS NULL OR before <> priority) AS transitions, min(t) AS first_t, arg_max(priority, (band, risk, t)) AS peak_priority, arg_max(t, (band, risk, t)) AS peak_t
        FROM (SELECT *, lag(priority) OVER (PARTITION BY patient_id ORDER BY t) AS before FROM ass) GROUP BY ALL) USING (patient_id)""",
    "signals_ranking": f"SELECT signal_id, priority, {_r('round(risk, 6)')} AS risk FROM sig WHERE band > 0 ORDER BY round(sig.risk, 6) DESC, signal_id LIMIT 50",
    "patients_rollup": f"SELECT c_custkey, c_name, (SELECT count(*) FROM sig s WHERE s.patient_id = 'U' || c_custkey) AS signals, (SELECT {_r('max(round(risk, 6))')} FROM sig s WHERE s.patient_id = 'U' || c_custkey) AS risk FROM customer",
    "timeline_asof": f"""SELECT patient_id, variable_code, record_id, {_t('et')} AS at, {_r('v')} AS value FROM obs WHERE NOT dup AND av <= TIMESTAMP '2024-01-15' AND et >= TIMESTAMP '2024-01-03'
      UNION ALL SELECT patient_id, kind, record_id, {_t('st')}, NULL FROM iv""",
    "nearest_sample": f"""SELECT patient_id, record_id, other_id, CAST(away / 60 AS BIGINT) AS minutes, {_r('other_value')} AS other_value FROM (
      SELECT a.patient_id, a.record_id, b.record_id AS other_id, b.v AS other_value, abs(epoch(a.et - b.et)) AS away, row_number() OVER (PARTITION BY a.record_id ORDER BY abs(epoch(a.et - b.et)), b.et, b.record_id) AS n
      FROM obs a JOIN obs b ON a.patient_id = b.patient_id AND abs(epoch(a.et - b.et)) <= 10800
      WHERE a.variable_code = 'click' AND b.variable_code = 'view' AND NOT a.dup AND a.known AND a.v IS NOT NULL AND NOT b.dup AND b.known AND b.v IS NOT NULL) WHERE n = 1""",
    "distractor_markers": " UNION ALL ".join(f"SELECT '{n}' AS marker, count(*) AS met, count(*) FILTER (suppressions = '') AS silent FROM sig s WHERE {test} HAVING count(*) > 0" for n, test in _MARKERS.items()),
    "anticipation_quantiles": f"""SELECT {_r('quantile_cont(hours, 0.25)')} AS p25, {_r('median(hours)')} AS p50, {_r('quantile_cont(hours, 0.75)')} AS p75, count(*) AS n FROM (
      SELECT signal_id, epoch(arg_max(o.et, (o.v * ch.direction, -epoch(o.et))) - s.t) / 3600 AS hours FROM sig s JOIN rk r ON r.patient_id = s.patient_id AND r.t = s.t AND r.rank = 1 JOIN ch ON ch.variable_code = r.variable_code
      JOIN obs o ON o.patient_id = s.patient_id AND o.variable_code = r.variable_code AND o.ok AND NOT o.dup AND o.v IS NOT NULL AND o.et > s.t AND o.et <= s.t + INTERVAL 192 HOUR GROUP BY signal_id, s.t)""",
    "multisource_counts": """SELECT sources, count(*) AS signals FROM (SELECT signal_id, count(DISTINCT source_file) AS sources FROM (
        SELECT signal_id, ci.source_file FROM sig JOIN ci USING (patient_id, t) UNION ALL
        SELECT signal_id, o.source_file FROM sig JOIN lab USING (patient_id, t) JOIN obs o ON o.record_id = lab.record_id WHERE lab.abnormal) GROUP BY signal_id) GROUP BY sources""",
    "rule_explode_counts": "SELECT rule, count(*) AS signals, count(*) FILTER (band >= 2) AS urgent FROM sig JOIN ru USING (patient_id, t) GROUP BY rule",
    "ablation_variants": _ABLATION,
    "causality_audit": "SELECT role, count(*) AS cited, 0::BIGINT AS late, 0::BIGINT AS future FROM evd GROUP BY role",
    "submission_validation": _SUBMISSION,
    "latency_by_domain": f"SELECT domain, count(*) AS n, {_r('median(minutes)')} AS median, {_r('quantile_cont(minutes, 0.95)')} AS p95, {_r('max(minutes)')} AS most FROM (SELECT domain, epoch(av - et) / 60 AS minutes FROM acc) GROUP BY ALL",
    "set_ops": """SELECT part, count(*) AS n FROM (
      (SELECT 'both' AS part, patient_id FROM ((SELECT patient_id FROM typed WHERE patient_id <> '' AND reason IS NOT NULL) INTERSECT (SELECT patient_id FROM typed WHERE patient_id <> '' AND value = 'LOW')))
      UNION ALL (SELECT 'rejected_only', patient_id FROM ((SELECT patient_id FROM typed WHERE patient_id <> '' AND reason IS NOT NULL) EXCEPT (SELECT patient_id FROM typed WHERE patient_id <> '' AND value = 'LOW')))
      UNION ALL (SELECT 'low_only', patient_id FROM ((SELECT patient_id FROM typed WHERE patient_id <> '' AND value = 'LOW') EXCEPT (SELECT patient_id FROM typed WHERE patient_id <> '' AND reason IS NOT NULL)))) GROUP BY part""",
    "population_mad_p05": f"""SELECT variable_code, count(*) AS windows, {_r('quantile_cont(scale, 0.05)')} AS floor FROM (SELECT variable_code, patient_id, w, median(abs(v - m)) * 1.4826 AS scale FROM (
      SELECT variable_code, patient_id, v, CAST(floor(epoch(et) / 691200) AS BIGINT) AS w, median(v) OVER (PARTITION BY variable_code, patient_id, CAST(floor(epoch(et) / 691200) AS BIGINT)) AS m FROM obs WHERE NOT dup AND known AND ok AND v IS NOT NULL) GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL""",
    "score_percentiles": f"SELECT raw FROM (SELECT {_r('raw')} AS raw, row_number() OVER (ORDER BY raw) - 1 AS i, count(*) OVER () AS n FROM ass) WHERE i = least(CAST(floor(n * 0.9) AS BIGINT), n - 1)",
    "csv_scan": "SELECT source_file, domain, record_id, patient_id, event_time, variable_code, value, coalesce(CAST(ref_low AS VARCHAR), '') AS ref_low, coalesce(CAST(ref_high AS VARCHAR), '') AS ref_high FROM raw",
    "facts_validity": f"SELECT category, CASE WHEN av IS NULL THEN 'BAD_AVAILABLE_TIME' END AS reject_reason, count(*) AS n, {_t('max(av)')} AS newest FROM fc GROUP BY ALL",
    "snapshot_counts": f"""SELECT patient_id, {_t('t')} AS t, (SELECT count(*) FROM vis v WHERE v.patient_id = l.patient_id AND v.t = l.t) AS observations,
      (SELECT count(*) FROM iv i WHERE i.patient_id = l.patient_id AND i.st <= l.t AND i.en >= l.t - INTERVAL 576 HOUR) AS intervals, (SELECT count(*) FROM fc f WHERE f.patient_id = l.patient_id AND f.av <= l.t) AS facts,
      (SELECT count(*) FROM obs o WHERE o.patient_id = l.patient_id AND (o.dup OR NOT o.known) AND o.av <= l.t AND o.et BETWEEN l.t - INTERVAL 576 HOUR AND l.t) AS set_aside FROM last l""",
    "out_of_reference": "SELECT variable_code, coalesce(ref_low IS NOT NULL AND ref_high IS NOT NULL AND (v < ref_low OR v > ref_high), FALSE) AS outside, count(*) AS n, count(ref_low) AS with_low, count(ref_high) AS with_high FROM obs GROUP BY ALL",
    "distractor_impact": f"""SELECT count(*) AS urgent, count(*) FILTER (marked) AS marked, count(*) FILTER (marked AND suppressions = '') AS silent, {_r("count(*) FILTER (marked AND suppressions = '') / greatest(count(*), 1)")} AS share
      FROM (SELECT s.*, {_ANY} AS marked FROM sig s WHERE band >= 2)""",
    "signal_rank": f"""SELECT signal_id, {_r('round(risk, 6)')} AS risk, rank() OVER (ORDER BY round(risk, 6) DESC) AS place, count(*) OVER () AS "of" FROM sig""",
    "cohort_prefix": f"SELECT patient_id, count(*) AS assessments, {_r('max(risk)')} AS risk FROM ass WHERE patient_id IN (SELECT DISTINCT patient_id FROM obs ORDER BY patient_id LIMIT 25) GROUP BY patient_id",
    "patients_ranking": f"SELECT patient_id, count(signal_id) AS signals, {_r('max(round(risk, 6))')} AS risk FROM (SELECT DISTINCT patient_id FROM obs) LEFT JOIN sig USING (patient_id) GROUP BY patient_id ORDER BY max(round(sig.risk, 6)) DESC NULLS LAST, patient_id LIMIT 1000",
    "evidence_by_role": "SELECT signal_id, role, string_agg(DISTINCT source_file || ':' || record_id, ',' ORDER BY source_file || ':' || record_id) AS records FROM evd GROUP BY ALL",
    "service_health": "SELECT name, n AS rows, 'tideline-2' AS model_version FROM (SELECT 'observations' AS name, count(*) AS n FROM obs UNION ALL SELECT 'intervals', count(*) FROM iv UNION ALL SELECT 'signals', count(*) FROM sig)",
    "service_sources": "SELECT DISTINCT source_file FROM obs UNION SELECT 'intervals' FROM iv UNION SELECT 'customers' FROM fc WHERE av IS NOT NULL",
    "service_signals": f"SELECT signal_id, patient_id, priority, {_r('round(risk, 6)')} AS risk FROM sig WHERE band = 1 ORDER BY round(sig.risk, 6) DESC, signal_id LIMIT 50",
    "outside_encounter": "SELECT variable_code, count(*) AS n FROM obs o JOIN enc USING (patient_id) WHERE NOT o.et BETWEEN st AND en - INTERVAL 240 HOUR GROUP BY ALL",
    "category_counter": "SELECT variable_code, value_text, count(*) AS seen, count(DISTINCT patient_id) AS patients FROM vis WHERE ok AND value_text IS NOT NULL AND et >= t - INTERVAL 192 HOUR GROUP BY ALL",
    "report_units": "SELECT variable_code, unit AS unit_raw, count(*) AS n, round(min(v), 2) + 0.0::DOUBLE AS least, round(max(v), 2) + 0.0::DOUBLE AS most FROM obs WHERE v IS NOT NULL GROUP BY ALL",
    "report_implausible": "SELECT variable_code, coalesce(quality_flag, '<null>') AS flag, count(*) AS n FROM obs WHERE NOT ok GROUP BY ALL",
    "report_retransmissions": "SELECT CASE WHEN re THEN 'RETRANSMIT' ELSE 'DIRECT' END AS source_system, quality_flag, dup AS is_duplicate, known AS is_availability_known, count(*) AS n, count(DISTINCT patient_id) AS patients FROM obs WHERE dup OR NOT known GROUP BY ALL",
    "report_volume": "SELECT domain, variable_code, count(*) AS n, count(DISTINCT patient_id) AS patients FROM obs WHERE ok AND NOT dup GROUP BY ALL UNION ALL SELECT 'INTERVAL', kind, count(*), count(DISTINCT patient_id) FROM iv GROUP BY kind",
    "report_study_window": f"SELECT 'observations' AS \"table\", {_t('min(et)')} AS first, {_t('max(et)')} AS last FROM obs UNION ALL SELECT 'intervals', {_t('min(st)')}, {_t('max(en)')} FROM iv",
    "narratives": f"""SELECT patient_id, {_t('t')} AS t, CASE WHEN k >= 2 THEN 'Several channels move together away from their own baseline: ' || array_to_string(names_, ', ') || '.'
        WHEN len(names_) > 0 THEN 'One pattern stands out against its own baseline: ' || names_[1] || '.' ELSE 'No channel leaves its own baseline.' END AS summary,
      array_to_string(list_concat(list_transform(names_, lambda n: 'Review the course of ' || n || '.'), CASE WHEN lab_n > 0 THEN ['Review the laboratory values out of range.'] ELSE [] END,
        CASE WHEN names IS NOT NULL THEN ['Consider what was noted: ' || replace(names, ',', ', ') || '.'] ELSE [] END)[1:3], ' ') AS review,
      array_to_string(refs[1:6], ',') AS refs, array_to_string(directions, ',') AS directions
      FROM nr""",
    "narrative_checks": """SELECT fault, source, refs, count(*) AS n, count(DISTINCT said) AS summaries FROM (
      SELECT u, CASE u WHEN 0 THEN 'number' WHEN 1 THEN 'forbidden' WHEN 3 THEN 'reference' WHEN 5 THEN CASE WHEN len(refs) > 6 THEN 'references' END END AS fault,
        CASE WHEN u IN (0, 1, 3) OR u = 5 AND len(refs) > 6 THEN 'plain' ELSE 'generated' END AS source, CASE WHEN u = 4 THEN least(1, len(refs)) ELSE least(6, len(refs)) END AS refs,
        CASE WHEN u = 2 THEN 'SpO2' WHEN u = 4 OR u = 5 AND len(refs) <= 6 THEN 'course' WHEN k >= 2 THEN 'several' || array_to_string(names_, ',') WHEN len(names_) > 0 THEN 'one' || names_[1] ELSE 'none' END AS said
      FROM (SELECT *, CAST(substr(patient_id, 2) AS INT) % 6 AS u FROM nr)) GROUP BY ALL""",
    "sweep_stats": "SELECT k, risk_band AS band_by_risk, count(*) AS n, count(*) FILTER (names IS NOT NULL) AS ruled, count(*) FILTER (lab_n > 0) AS with_labs FROM ass GROUP BY ALL",
}

#: The steps under a profile with thin windows and a long goal for runs, and under one with a fifth rule.
_THIN = {"ev": _STEPS["ev"].replace("n_evidence >= 3", "n_evidence >= 1"), "m1": _STEPS["m1"].replace("coalesce(streak, 0) / 2.0)", "coalesce(streak, 0) / 5.0)")}
_CONDITION = "SELECT 1 FROM fc f WHERE f.patient_id = a1.patient_id AND f.av <= a1.t AND f.category IN ('BUILDING', 'MACHINERY')"
_FIFTH = {"ru": f"SELECT * FROM ({_STEPS['ru']}) UNION ALL SELECT patient_id, t, 'known_condition', 0.25, 5 FROM a1 WHERE EXISTS ({_CONDITION})"}
_ORPHANS = """WITH s AS (SELECT signal_id FROM sig WHERE CAST(substr(patient_id, 2) AS INT) % 5 <> 0), e AS (SELECT * FROM evd WHERE CAST(substr(patient_id, 2) AS INT) % 7 <> 0), l AS (
    SELECT CASE source_file WHEN 'customers' THEN CAST(substr(record_id, 2) AS INT) % 2 = 0 WHEN 'intervals' THEN FALSE ELSE CAST(record_id AS INT) % 3 = 0 END AS lost, source_file FROM evd)
  SELECT 'signal' AS what, '' AS source_file, count(*) AS n FROM s WHERE signal_id NOT IN (SELECT signal_id FROM e) HAVING count(*) > 0
  UNION ALL SELECT 'evidence', '', count(*) FROM e WHERE signal_id NOT IN (SELECT signal_id FROM s) HAVING count(*) > 0 UNION ALL SELECT 'untraceable', source_file, count(*) FROM l WHERE lost GROUP BY source_file"""

ORACLES: dict[str, str] = {name: _sql(select) for name, select in _SELECTS.items()} | {
    "signals_by_variant": " UNION ALL ".join(f"SELECT * FROM ({_sql(_URGENT.format(name=name), changed)})" for name, changed in _LADDER.items()),
    "rule_transient": _sql(_RULE + "('transient')", _THIN),
    "rule_coverage": _sql(_RULE + "('coverage')", _THIN),
    "rule_registered": _sql(f"SELECT patient_id, {_t('t')} AS t, names AS rules, {_r('final')} AS final, priority FROM ass WHERE contains(names, 'known_condition')", _FIFTH),
    "rule_registered_evidence": _sql("""SELECT signal_id, record_id, role, explained FROM (SELECT signal_id, record_id, role FROM evd WHERE source_file = 'customers')
      FULL JOIN (SELECT signal_id, TRUE AS explained FROM sig WHERE contains(suppressions, 'known_condition')) USING (signal_id)""", _FIFTH),
    "fk_orphans": _sql(f"SELECT * FROM ({_ORPHANS})", _FIFTH),
    "declared_constraints": _sql("""SELECT * FROM (SELECT 'observations' AS "table", 'key' AS rule, count(*) AS n FROM obs WHERE CAST(record_id AS INT) % 50 = 0
      UNION ALL SELECT 'intervals', 'time_order', count(*) FROM iv WHERE CAST(record_id AS INT) % 40 = 0 UNION ALL SELECT 'clinical_facts', 'patient_id', count(*) FROM fc WHERE av IS NOT NULL AND CAST(substr(record_id, 2) AS INT) % 9 = 0
      UNION ALL SELECT 'signals', 'risk', count(*) FROM sig WHERE CAST(substr(patient_id, 2) AS INT) % 5 <> 0 AND CAST(substr(patient_id, 2) AS INT) % 3 = 0
      UNION ALL SELECT 'evidence', 'signal_id of signals', count(*) FROM evd WHERE CAST(substr(patient_id, 2) AS INT) % 5 = 0) WHERE n > 0""", _FIFTH),
    "integrity_verdicts": """WITH c AS (SELECT c_custkey AS u, 'f' || c_custkey AS source_file, 100 + c_custkey % 7 AS bytes, sha256('v' || c_custkey % 5 || '-' || c_custkey) AS sha, sha256('old-' || c_custkey) AS old FROM customer),
      p AS (SELECT *, CASE WHEN u % 8 = 0 THEN sha WHEN u % 4 = 0 THEN sha256('other') WHEN u % 11 <> 0 THEN old END AS was, CASE WHEN u % 4 = 0 THEN 105 WHEN u % 11 <> 0 THEN 98 END AS had, CASE u % 6 WHEN 0 THEN sha WHEN 1 THEN sha256('listed') END AS official FROM c)
      SELECT source_file, CASE WHEN was IS NULL THEN 'NEW' WHEN sha = was THEN 'IDENTICAL' WHEN bytes > had AND u % 3 = 0 AND old = was THEN 'APPENDED' WHEN sha = official THEN 'NEW_VERSION' ELSE 'MODIFIED' END AS verdict,
        sha IS NOT DISTINCT FROM official AS listed, CAST(had AS BIGINT) AS previous_bytes FROM p""",
    "unique_keys": """SELECT name, count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT 'orders' AS name, count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1
      UNION ALL SELECT 'lineitem', count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) GROUP BY name""",
    "time_order_violations": "SELECT l_shipdate < o_orderdate AS violates, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
}
