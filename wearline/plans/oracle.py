"""DuckDB oracle SQL for the registered queries.

The SQL is written independently from the Spark operators: it states the
same semantics with plain window functions and aggregates over the
driver's views, so a Spark result and its oracle meet only in the output.
Doubles are rounded on both sides (6 digits; 4 for raw prices; 2 for sums
of 2-decimal prices, which are then exact).
"""

from __future__ import annotations

import math

# ---- fixture CTEs ------------------------------------------------------------

L = """L AS (
  SELECT CAST(l_suppkey AS BIGINT) AS unit_number,
         CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey,
              l_linenumber, l_partkey, l_extendedprice) AS BIGINT) AS time_in_cycles,
         CAST(l_linenumber AS DOUBLE) AS operational_setting_1,
         CAST(l_tax AS DOUBLE) AS operational_setting_2,
         CAST(100.0 AS DOUBLE) AS operational_setting_3,
         CAST(l_quantity AS DOUBLE) AS sensor_measurement_4,
         CAST(l_extendedprice AS DOUBLE) AS sensor_measurement_7,
         CAST(l_discount AS DOUBLE) AS sensor_measurement_11,
         CAST(NULL AS DOUBLE) AS sensor_measurement_22
  FROM lineitem)"""

E = """E AS (
  SELECT CAST(user_id AS BIGINT) AS unit_number,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS time_in_cycles,
         CAST(value AS DOUBLE) AS sensor_measurement_4
  FROM events)"""

L_VALUES = ["operational_setting_1", "operational_setting_2", "operational_setting_3",
            "sensor_measurement_4", "sensor_measurement_7", "sensor_measurement_11",
            "sensor_measurement_22"]
L_DEGR = ["sensor_measurement_4", "sensor_measurement_7", "sensor_measurement_11"]


def rnd(expr: str, d: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {d})"


def ema_k(span: int = 5) -> int:
    decay = (span - 1.0) / (span + 1.0)
    return int(math.ceil(math.log(1e-17) / math.log(decay)))


def win(frame: str = "", part: str = "unit_number", order: str = "time_in_cycles") -> str:
    return f"OVER (PARTITION BY {part} ORDER BY {order} {frame})"


def feature_select(cols, degr, windows=(3, 5), history=None, include_rolling=True,
                   include_degradation=True, passthrough=(), digits=6, cum_digits=6):
    """Select list computing the feature set over a source with columns
    unit_number, time_in_cycles, <cols>, <passthrough>."""
    out = ["unit_number", "time_in_cycles"]
    fill = (lambda c: f"coalesce({c}, 0)") if include_rolling else (lambda c: c)
    for p in passthrough:
        out.append(f"{fill(p)} AS {p}")
    for c in cols:
        out.append(f"{rnd(fill(c), digits)} AS {c}")
    if include_rolling:
        for n in windows:
            fr = f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
            for c in cols:
                ok = history is None or n <= history
                m = (f"CASE WHEN count({c}) {win(fr)} = {n} THEN avg({c}) {win(fr)} END"
                     if ok else "NULL")
                s = (f"CASE WHEN count({c}) {win(fr)} = {n} THEN stddev_samp({c}) {win(fr)} END"
                     if ok else "NULL")
                out.append(f"{rnd(f'coalesce({m}, 0)', digits)} AS {c}_rolling_mean_{n}")
                out.append(f"{rnd(f'coalesce({s}, 0)', digits)} AS {c}_rolling_std_{n}")
        k = ema_k() if history is None else history - 1
        fr = f"ROWS BETWEEN {k} PRECEDING AND CURRENT ROW"
        for c in cols:
            e = (f"list_reduce(list({c}) {win(fr)}, "
                 f"lambda a, v: a * CAST(2.0/3 AS DOUBLE) + v * CAST(1.0/3 AS DOUBLE))")
            out.append(f"{rnd(f'coalesce({e}, 0)', digits)} AS {c}_ema")
    if include_degradation:
        if history is None:
            mx = f"max(time_in_cycles) {win('ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING')}"
            out.append(f"CASE WHEN {mx} > 0 THEN CAST(time_in_cycles AS DOUBLE) / {mx} "
                       f"ELSE 0.0 END AS cycle_norm")
        else:
            out.append("CASE WHEN time_in_cycles > 0 THEN 1.0 ELSE 0.0 END AS cycle_norm")
        for c in degr:
            b = fill(c)
            out.append(f"{rnd(f'coalesce({b} - lag({b}) {win()}, 0)', digits)} AS {c}_rate_of_change")
        fr = ("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW" if history is None
              else f"ROWS BETWEEN {history - 1} PRECEDING AND CURRENT ROW")
        for c in degr:
            s = f"sum({fill(c)}) {win(fr)}"
            if not include_rolling:
                s = f"CASE WHEN {c} IS NOT NULL THEN {s} END"
            out.append(f"{rnd(s, cum_digits)} AS {c}_cumsum")
    return ",\n  ".join(out)


# ---- per-query SQL ------------------------------------------------------------

def build() -> dict[str, str]:
    q: dict[str, str] = dict(build_more())
    q.update(build_policy())
    q.update(build_sampling())
    q.update(build_sources())
    q.update(build_ranking())
    q.update(build_extra())
    q["artifact_roundtrip"] = q["scaler_fit"]
    q["policy_roundtrip"] = q["policy_values"]
    sf_names = [n for n in feature_names(L_VALUES, L_DEGR) if n != "cycle_norm"]
    raw = feature_select(L_VALUES, L_DEGR, digits=4, cum_digits=2)
    q["stream_features"] = f"WITH {L}, F AS (SELECT {raw} FROM L)\nSELECT unit_number, time_in_cycles, {', '.join(sf_names)} FROM F"
    q["stream_latest_risk"] = f"""WITH {L}, LR AS (SELECT unit_number, time_in_cycles, least(1.0, sensor_measurement_4 / 50.0) AS probability
  FROM L WHERE unit_number >= 1 QUALIFY row_number() OVER (PARTITION BY unit_number ORDER BY time_in_cycles DESC) = 1)
SELECT unit_number, time_in_cycles, probability, {RISK.format(p='probability')} AS risk_level,
  CAST(2 * (SELECT count(DISTINCT unit_number) FROM L) + (SELECT count(*) FROM L WHERE unit_number < 1) AS BIGINT)
  AS quarantined_rows FROM LR"""
    kept = [c for c in L_VALUES if c != "operational_setting_3"]
    ef = feature_select(kept, L_DEGR, passthrough=["RUL", "failure"], digits=6, cum_digits=6)
    q["engineer_features"] = (f"WITH {L}, {R_CTE}, {B_CTE}, {scaler_cte('B', L_VALUES)},\n"
                              f"SB AS (SELECT {scaled_select(L_VALUES, L_ALL + ['RUL', 'failure'])} FROM B, SP)\n"
                              f"SELECT {ef} FROM SB")
    q["rul_compute"] = f"""WITH {L}
SELECT unit_number, time_in_cycles,
  CAST(max(time_in_cycles) OVER (PARTITION BY unit_number) - time_in_cycles AS BIGINT) AS RUL
FROM L"""
    q["failure_label"] = f"""WITH {L}, R AS (
  SELECT unit_number, time_in_cycles,
    CAST(max(time_in_cycles) OVER (PARTITION BY unit_number) - time_in_cycles AS BIGINT) AS RUL FROM L)
SELECT unit_number, time_in_cycles, RUL, CAST(coalesce(RUL <= 90, false) AS BIGINT) AS failure FROM R"""
    q["failure_label_events"] = f"""WITH {E}, R AS (
  SELECT unit_number, time_in_cycles,
    CAST(max(time_in_cycles) OVER (PARTITION BY unit_number) - time_in_cycles AS BIGINT) AS RUL FROM E)
SELECT unit_number, time_in_cycles, RUL, CAST(coalesce(RUL <= 20, false) AS BIGINT) AS failure FROM R"""
    raw = feature_select(L_VALUES, L_DEGR, digits=4, cum_digits=2)
    q["raw_features"] = f"WITH {L}\nSELECT {raw}\nFROM L"
    F = f"WITH {L}, F AS (SELECT {raw} FROM L)"
    subsets = {"rolling_mean": ["_rolling_mean_3", "_rolling_mean_5"],
               "rolling_std": ["_rolling_std_3", "_rolling_std_5"], "ema": ["_ema"],
               "rate_of_change": ["_rate_of_change"], "cumulative_sum": ["_cumsum"],
               "cycle_norm": ["cycle_norm"]}
    names = feature_names(L_VALUES, L_DEGR)
    for key, suf in subsets.items():
        keep = [n for n in names if any(n.endswith(x) for x in suf)]
        q[key] = f"{F}\nSELECT unit_number, time_in_cycles, {', '.join(keep)} FROM F"
    ev = feature_select(["sensor_measurement_4"], [], include_degradation=False, digits=6)
    q["ema_events"] = (f"WITH {E}, F AS (SELECT {ev} FROM E)\nSELECT unit_number, time_in_cycles, "
                       "sensor_measurement_4_ema, sensor_measurement_4_rolling_mean_5, "
                       "sensor_measurement_4_rolling_std_5 FROM F")
    deg = feature_select(L_VALUES, L_DEGR, include_rolling=False, digits=4, cum_digits=2)
    q["degradation_only"] = f"WITH {L}\nSELECT {deg}\nFROM L"
    tr = feature_select(L_VALUES, L_DEGR, history=10, digits=4, cum_digits=2)
    q["trailing_features"] = f"WITH {L}\nSELECT {tr}\nFROM L"
    lr = feature_select(L_VALUES, L_DEGR, digits=4, cum_digits=2, passthrough=["RUL"])
    q["latest_per_unit"] = f"""WITH {L}, R AS (SELECT *, CAST(max(time_in_cycles) OVER (PARTITION BY unit_number)
   - time_in_cycles AS BIGINT) AS RUL FROM L), F AS (SELECT {lr} FROM R)
SELECT unit_number, time_in_cycles, RUL, sensor_measurement_4_rolling_mean_3, sensor_measurement_7_ema,
  sensor_measurement_11_cumsum
FROM F QUALIFY row_number() OVER (PARTITION BY unit_number ORDER BY time_in_cycles DESC) = 1"""
    q["timeline_points"] = f"""WITH {L}, P AS (SELECT unit_number, time_in_cycles, sensor_measurement_4,
  row_number() OVER (PARTITION BY unit_number ORDER BY time_in_cycles) AS pos FROM L)
SELECT unit_number, time_in_cycles, sensor_measurement_4 FROM P WHERE pos >= 5 AND (pos - 5) % 5 = 0"""
    lf = feature_select(L_VALUES, L_DEGR, digits=4, cum_digits=2)
    q["feature_select"] = f"WITH {L}\nSELECT {lf}\nFROM L"
    q["fillna_zero"] = f"""WITH {L}
SELECT unit_number, time_in_cycles, {', '.join(f'coalesce({c}, 0) AS {c}' for c in L_VALUES)} FROM L"""
    q["horizon_report"] = f"""WITH {L}, R AS (SELECT *, CAST(max(time_in_cycles) OVER (PARTITION BY unit_number)
   - time_in_cycles AS BIGINT) AS RUL FROM L),
B AS (SELECT *, CAST(coalesce(RUL <= 90, false) AS BIGINT) AS failure FROM R)
SELECT unit_number, time_in_cycles, RUL, failure,
  {rnd("coalesce(CASE WHEN count(sensor_measurement_4) " + win("ROWS BETWEEN 2 PRECEDING AND CURRENT ROW") + " = 3 THEN avg(sensor_measurement_4) " + win("ROWS BETWEEN 2 PRECEDING AND CURRENT ROW") + " END, 0)", 4)} AS sensor_measurement_4_rolling_mean_3,
  {rnd("coalesce(CASE WHEN count(sensor_measurement_7) " + win("ROWS BETWEEN 2 PRECEDING AND CURRENT ROW") + " = 3 THEN avg(sensor_measurement_7) " + win("ROWS BETWEEN 2 PRECEDING AND CURRENT ROW") + " END, 0)", 4)} AS sensor_measurement_7_rolling_mean_3
FROM B QUALIFY row_number() OVER (PARTITION BY unit_number ORDER BY time_in_cycles DESC) = 1"""
    return q


def feature_names(cols, degr, windows=(3, 5)):
    out = []
    for n in windows:
        for c in cols:
            out += [f"{c}_rolling_mean_{n}", f"{c}_rolling_std_{n}"]
    out += [f"{c}_ema" for c in cols]
    out.append("cycle_norm")
    out += [f"{c}_rate_of_change" for c in degr] + [f"{c}_cumsum" for c in degr]
    return out


# ---- step 3 / 4 SQL ---------------------------------------------------------------

R_CTE = """R AS (SELECT *, CAST(max(time_in_cycles) OVER (PARTITION BY unit_number) - time_in_cycles AS BIGINT)
  AS RUL FROM L)"""
B_CTE = """B AS (SELECT *, CAST(coalesce(RUL <= 90, false) AS BIGINT) AS failure FROM R)"""
ONE = "CAST(1.0 AS DOUBLE)"
ZERO = "CAST(0.0 AS DOUBLE)"


def scaler_cte(src: str, cols, name="SP") -> str:
    parts = []
    for i, c in enumerate(cols):
        rng = f"(max({c}) - min({c}))"
        sc = f"CASE WHEN {rng} = 0 THEN {ONE} ELSE {ONE} / {rng} END"
        parts.append(f"{sc} AS s{i}, {ZERO} - min({c}) * ({sc}) AS o{i}")
    return f"{name} AS (SELECT {', '.join(parts)} FROM {src})"


def scaled_select(cols, all_cols, sp="SP") -> str:
    out = []
    for c in all_cols:
        if c in cols:
            i = cols.index(c)
            out.append(f"{c} * {sp}.s{i} + {sp}.o{i} AS {c}")
        else:
            out.append(c)
    return ", ".join(out)


L_ALL = ["unit_number", "time_in_cycles"] + L_VALUES
S_CTE = f"""{L}, {R_CTE}, {B_CTE},
SS AS (SELECT CASE WHEN max(sensor_measurement_7) - min(sensor_measurement_7) = 0 THEN {ONE}
   ELSE {ONE} / (max(sensor_measurement_7) - min(sensor_measurement_7)) END AS s,
   min(sensor_measurement_7) AS m FROM B),
SS2 AS (SELECT s, {ZERO} - m * s AS o FROM SS),
S AS (SELECT unit_number, time_in_cycles, RUL, failure, sensor_measurement_4 / 50.0 AS p_qty,
   sensor_measurement_7 * s + o AS p_price,
   CAST(sensor_measurement_4 / 50.0 >= 0.5 AS BIGINT) AS prediction FROM B, SS2)"""

COUNTS = """C AS (SELECT
  CAST(coalesce(sum(CASE WHEN failure = 1 AND prediction = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS tp,
  CAST(coalesce(sum(CASE WHEN failure <> 1 AND prediction = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS fp,
  CAST(coalesce(sum(CASE WHEN failure = 1 AND prediction <> 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS fn,
  CAST(coalesce(sum(CASE WHEN failure <> 1 AND prediction <> 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS tn
  FROM S)"""


def div(a, b):
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


def groups_cte(score: str) -> str:
    return f"""G0 AS (SELECT CAST({score} AS DOUBLE) AS score,
   sum(CASE WHEN failure = 1 THEN 1.0 ELSE 0.0 END) AS pos,
   sum(CASE WHEN failure = 1 THEN 0.0 ELSE 1.0 END) AS neg FROM S WHERE {score} IS NOT NULL GROUP BY 1),
G AS (SELECT score, pos, neg, row_number() OVER (ORDER BY score DESC) AS rank,
   sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps,
   sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps FROM G0),
T AS (SELECT sum(pos) AS P, sum(neg) AS N, count(*) AS m FROM G0)"""


def auc_expr() -> str:
    return "(SELECT sum(pos * (N - fps + neg / 2)) / max(P * N) FROM G, T)"


def build_more() -> dict[str, str]:
    q: dict[str, str] = {}
    sc_rows = []
    for i, c in enumerate(L_VALUES):
        rng = f"(max({c}) - min({c}))"
        sc = f"CASE WHEN {rng} = 0 THEN {ONE} ELSE {ONE} / {rng} END"
        sc_rows.append(f"SELECT '{c}' AS \"column\", min({c}) AS min, max({c}) AS max, {sc} AS scale, "
                       f"{ZERO} - min({c}) * ({sc}) AS \"offset\", CAST({i} AS BIGINT) AS ordinal FROM L")
    q["scaler_fit"] = f"WITH {L}\n" + "\nUNION ALL ".join(sc_rows)
    q["scale_features"] = (f"WITH {L}, {scaler_cte('L', L_VALUES)}\n"
                           f"SELECT {scaled_select(L_VALUES, L_ALL)} FROM L, SP")
    b_all = L_ALL + ["RUL", "failure"]
    scaled_b = f"SB AS (SELECT {scaled_select(L_VALUES, b_all)} FROM B, SP)"
    var_rows = []
    for c in b_all:
        var_rows.append(f"SELECT '{c}' AS \"column\", round(var_samp(CAST({c} AS DOUBLE)), 4) AS variance FROM SB")
    prot = "('unit_number', 'time_in_cycles', 'RUL', 'failure')"
    q["variance_report"] = (f"WITH {L}, {R_CTE}, {B_CTE}, {scaler_cte('B', L_VALUES)}, {scaled_b},\n"
                            f"V AS ({' UNION ALL '.join(var_rows)})\n"
                            f"SELECT \"column\", variance, CAST(coalesce(variance < 0.01, false) AND \"column\" NOT IN {prot} AS BIGINT) AS removed FROM V")
    kept = [c for c in b_all if c != "operational_setting_3"]
    q["drop_low_variance"] = (f"WITH {L}, {R_CTE}, {B_CTE}, {scaler_cte('B', L_VALUES)}, {scaled_b}\n"
                              f"SELECT {', '.join(kept)} FROM SB")
    q["unit_life"] = f"""WITH {L}
SELECT unit_number, CAST(max(time_in_cycles) AS BIGINT) AS max_cycle, CAST(count(*) AS BIGINT) AS n_cycles
FROM L GROUP BY unit_number"""
    q["failure_rate"] = f"""WITH {L}, {R_CTE}, {B_CTE}
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(failure) AS BIGINT) AS n_failures,
  avg(CAST(failure AS DOUBLE)) AS failure_rate FROM B"""
    q["class_distribution"] = f"""WITH {L}, {R_CTE}, {B_CTE}, C AS (SELECT failure, CAST(count(*) AS BIGINT) AS count FROM B GROUP BY failure)
SELECT failure, count, count / sum(count) OVER () AS share FROM C"""
    d_rows = []
    for c in L_ALL:
        x = f"CAST({c} AS DOUBLE)"
        d_rows.append(f"""SELECT '{c}' AS "column", CAST(count({x}) AS BIGINT) AS count, round(avg({x}), 4) AS mean,
  round(stddev_samp({x}), 4) AS std, round(min({x}), 4) AS min, round(quantile_cont({x}, 0.25), 4) AS p25,
  round(quantile_cont({x}, 0.5), 4) AS p50, round(quantile_cont({x}, 0.75), 4) AS p75, round(max({x}), 4) AS max
  FROM L""")
    q["describe_columns"] = f"WITH {L}\n" + "\nUNION ALL ".join(d_rows)
    prof = []
    for i, c in enumerate(L_ALL + ["RUL"]):
        t = "bigint" if c in ("unit_number", "time_in_cycles", "RUL") else "double"
        prof.append(f"SELECT CAST((SELECT count(*) FROM R) AS BIGINT) AS n_rows, '{c}' AS \"column\", '{t}' AS dtype, "
                    f"CAST(count({c}) AS BIGINT) AS non_null, CAST({i} AS BIGINT) AS ordinal FROM R")
    q["column_profile"] = f"WITH {L}, {R_CTE}\n" + "\nUNION ALL ".join(prof)
    q["rul_histogram"] = f"""WITH {L}, {R_CTE}, M AS (SELECT CAST(min(RUL) AS DOUBLE) AS mn, CAST(max(RUL) AS DOUBLE) AS mx FROM R),
H AS (SELECT CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((RUL - mn) * 50 / (mx - mn)), 49) END AS BIGINT) AS bin,
   count(*) AS c FROM R, M WHERE RUL IS NOT NULL GROUP BY 1),
GR AS (SELECT range AS bin FROM range(50))
SELECT GR.bin AS bin, round(mn + GR.bin * ((mx - mn) / 50), 6) AS lo, round(mn + (GR.bin + 1) * ((mx - mn) / 50), 6) AS hi,
  CAST(coalesce(c, 0) AS BIGINT) AS count FROM GR CROSS JOIN M LEFT JOIN H ON GR.bin = H.bin"""
    q["rul_density"] = f"""WITH {L}, {R_CTE},
ST AS (SELECT count(*) AS n, stddev_samp(CAST(RUL AS DOUBLE)) AS sd, CAST(min(RUL) AS DOUBLE) AS mn,
   CAST(max(RUL) AS DOUBLE) AS mx FROM R),
ST2 AS (SELECT n, sd * pow(CAST(n AS DOUBLE), -0.2) AS sigma, mn, (mx - mn) / 199 AS step FROM ST),
V AS (SELECT CAST(RUL AS DOUBLE) AS v, count(*) AS w FROM R GROUP BY 1),
GR AS (SELECT range AS i FROM range(200))
SELECT CAST(i AS BIGINT) AS point, round(mn + i * step, 4) AS x,
  round(sum(w * exp(-pow(mn + i * step - v, 2) / (2 * sigma * sigma))) / (n * sigma * sqrt(2 * pi())), 10) AS density
FROM GR, V, ST2 GROUP BY i, mn, step, n, sigma"""
    q["rul_test_offset"] = f"""WITH {L}, T AS (SELECT unit_number, time_in_cycles,
  CAST((unit_number * 37) % 146 + max(time_in_cycles) OVER (PARTITION BY unit_number) - time_in_cycles AS BIGINT) AS RUL FROM L)
SELECT unit_number, time_in_cycles, RUL, CAST(coalesce(RUL <= 90, false) AS BIGINT) AS failure FROM T"""
    q["prepare_data"] = f"""WITH {L}, {R_CTE}, {B_CTE}, {scaler_cte('B', L_VALUES)},
T0 AS (SELECT L.*, CAST((unit_number * 37) % 146 + max(time_in_cycles) OVER (PARTITION BY unit_number) - time_in_cycles AS BIGINT) AS RUL FROM L),
T1 AS (SELECT *, CAST(coalesce(RUL <= 90, false) AS BIGINT) AS failure FROM T0)
SELECT {scaled_select(L_VALUES, b_all)}, 'train' AS split FROM B, SP
UNION ALL SELECT {scaled_select(L_VALUES, b_all)}, 'test' AS split FROM T1, SP"""

    # ---- evaluation on the scored fixture ----
    q["confusion_matrix"] = f"""WITH {S_CTE}, {COUNTS}
SELECT CAST(0 AS BIGINT) AS actual, CAST(0 AS BIGINT) AS predicted, tn AS count FROM C
UNION ALL SELECT 0, 1, fp FROM C UNION ALL SELECT 1, 0, fn FROM C UNION ALL SELECT 1, 1, tp FROM C"""
    q["binary_metrics"] = f"""WITH {S_CTE}, {COUNTS}, {groups_cte('p_qty')}
SELECT tp, fp, fn, tn, {div('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {div('tp', 'tp + fp')} AS precision,
  {div('tp', 'tp + fn')} AS recall, {div('2 * tp', '2 * tp + fp + fn')} AS f1_score,
  round({auc_expr()}, 12) AS roc_auc FROM C"""
    p1, r1 = div('tp', 'tp + fp'), div('tp', 'tp + fn')
    p0, r0 = div('tn', 'tn + fn'), div('tn', 'tn + fp')
    f1, f0 = div('2 * tp', '2 * tp + fp + fn'), div('2 * tn', '2 * tn + fn + fp')
    n = "(tp + fp + fn + tn)"
    q["classification_report"] = f"""WITH {S_CTE}, {COUNTS}
SELECT '0' AS label, {p0} AS precision, {r0} AS recall, {f0} AS f1_score, CAST(tn + fp AS BIGINT) AS support FROM C
UNION ALL SELECT '1', {p1}, {r1}, {f1}, CAST(tp + fn AS BIGINT) FROM C
UNION ALL SELECT 'accuracy', NULL, NULL, {div('tp + tn', n)}, CAST({n} AS BIGINT) FROM C
UNION ALL SELECT 'macro avg', ({p0} + {p1}) / 2, ({r0} + {r1}) / 2, ({f0} + {f1}) / 2, CAST({n} AS BIGINT) FROM C
UNION ALL SELECT 'weighted avg', {div(f'{p0} * (tn + fp) + {p1} * (tp + fn)', n)}, {div(f'{r0} * (tn + fp) + {r1} * (tp + fn)', n)},
  {div(f'{f0} * (tn + fp) + {f1} * (tp + fn)', n)}, CAST({n} AS BIGINT) FROM C"""
    for key, score in (("roc_curve", "p_price"), ("roc_curve_ties", "p_qty")):
        q[key] = f"""WITH {S_CTE}, {groups_cte(score)},
K AS (SELECT G.*, lead(pos) OVER (ORDER BY rank) AS pos_n, lead(neg) OVER (ORDER BY rank) AS neg_n FROM G)
SELECT CAST('Infinity' AS DOUBLE) AS threshold, 0.0 / N AS fpr, 0.0 / P AS tpr FROM T
UNION ALL SELECT score, fps / N, tps / P FROM K, T
WHERE m <= 2 OR rank = 1 OR rank = m OR neg_n <> neg OR pos_n <> pos"""
    q["roc_auc"] = f"""WITH {S_CTE}, {groups_cte('p_qty')}, A1 AS (SELECT round({auc_expr()}, 12) AS auc_qty),
{groups_cte('p_price').replace('G0 AS', 'H0 AS').replace('FROM G0', 'FROM H0').replace('G AS (', 'H AS (').replace('T AS (', 'U AS (')}
SELECT auc_qty, round((SELECT sum(pos * (N - fps + neg / 2)) / max(P * N) FROM H, U), 12) AS auc_price FROM A1"""
    for key, score in (("pr_curve", "p_qty"), ("pr_curve_price", "p_price")):
        q[key] = f"""WITH {S_CTE}, {groups_cte(score)}
SELECT score AS threshold, CASE WHEN tps + fps > 0 THEN tps / (tps + fps) ELSE 0.0 END AS precision,
  tps / P AS recall FROM G, T
UNION ALL SELECT NULL, 1.0, 0.0"""
    for key, score, t0 in (("optimal_threshold", "p_price", 0.4), ("optimal_threshold_fallback", "p_qty", 0.99)):
        q[key] = f"""WITH {S_CTE}, {groups_cte(score)},
PR AS (SELECT score AS threshold, CASE WHEN tps + fps > 0 THEN tps / (tps + fps) ELSE 0.0 END AS precision,
  tps / P AS recall FROM G, T UNION ALL SELECT 1.0, 1.0, 0.0),
F AS (SELECT *, 2 * (precision * recall) / (precision + recall + 1e-10) AS f1,
  CASE WHEN recall >= 0.6 AND threshold >= {t0} THEN 1 WHEN recall >= 0.6 THEN 2 END AS tier FROM PR),
BEST AS (SELECT * FROM F WHERE tier IS NOT NULL ORDER BY (tier = 1) DESC, f1 DESC, threshold ASC LIMIT 1)
SELECT coalesce(BEST.threshold, 0.5) AS threshold, BEST.precision, BEST.recall, BEST.f1 AS f1_score,
  CAST(coalesce((SELECT min(tier) FROM F), 3) AS BIGINT) AS tier
FROM (SELECT 1) d LEFT JOIN BEST ON true"""
    q["cost_benefit"] = f"""WITH {S_CTE}, {COUNTS}, D AS (SELECT CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn FROM C)
SELECT (tp + fp) * 10000.0 AS scheduled_maintenance_cost, fn * 100000.0 AS unexpected_failure_cost,
  (tp + fp) * 10000.0 + fn * 100000.0 AS total_cost, tp * (100000.0 - 10000.0) AS avoided_failure_cost,
  tp * (100000.0 - 10000.0) - fp * 10000.0 AS net_benefit,
  CASE WHEN (tp + fp) * 10000.0 > 0 THEN (tp * (100000.0 - 10000.0) - fp * 10000.0) / ((tp + fp) * 10000.0) * 100 ELSE 0.0 END AS roi_percent
FROM D"""
    q["prediction_summary"] = f"""WITH {S_CTE}
SELECT CAST(count(*) AS BIGINT) AS n_records, CAST(sum(prediction) AS BIGINT) AS predicted_failures,
  round(avg(CAST(prediction AS DOUBLE)), 12) AS predicted_share, round(avg(p_qty), 12) AS mean_probability FROM S"""
    q["class_weights"] = f"""WITH {L}, {R_CTE}, {B_CTE}, C AS (SELECT failure, count(*) AS n_c FROM B GROUP BY failure)
SELECT failure, CAST(n_c AS BIGINT) AS count, sum(n_c) OVER () / (count(*) OVER () * n_c) AS weight FROM C"""
    q["scale_pos_weight"] = f"""WITH {L}, {R_CTE}, {B_CTE}
SELECT CAST(sum(CASE WHEN failure = 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives,
  CAST(sum(CASE WHEN failure = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives,
  CAST(sum(CASE WHEN failure = 0 THEN 1 ELSE 0 END) AS DOUBLE) / CAST(sum(CASE WHEN failure = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS scale_pos_weight FROM B"""
    q["metric_delta"] = f"""WITH {S_CTE}, {COUNTS}, {groups_cte('p_qty')},
O AS (SELECT 'precision' AS metric, 'binary' AS average, {p1} AS value FROM C
  UNION ALL SELECT 'recall', 'binary', {r1} FROM C UNION ALL SELECT 'f1_score', 'binary', {f1} FROM C
  UNION ALL SELECT 'precision', 'weighted', {div(f'{p0} * (tn + fp) + {p1} * (tp + fn)', n)} FROM C
  UNION ALL SELECT 'recall', 'weighted', {div(f'{r0} * (tn + fp) + {r1} * (tp + fn)', n)} FROM C
  UNION ALL SELECT 'f1_score', 'weighted', {div(f'{f0} * (tn + fp) + {f1} * (tp + fn)', n)} FROM C
  UNION ALL SELECT 'accuracy', 'binary', {div('tp + tn', n)} FROM C
  UNION ALL SELECT 'accuracy', 'weighted', {div('tp + tn', n)} FROM C
  UNION ALL SELECT 'roc_auc', 'binary', {auc_expr()}),
BL AS (SELECT * FROM (VALUES ('recall', 'weighted', 0.9520464263897374), ('precision', 'weighted', 0.9948470096735572),
  ('f1_score', 'weighted', 0.9729762531629744), ('roc_auc', 'binary', 0.47297479116356866),
  ('accuracy', 'weighted', 0.9520464263897374)) v(metric, average, baseline))
SELECT O.metric, O.average, round(value, 12) AS value, round(CAST(baseline AS DOUBLE), 12) AS baseline,
  round(value - baseline, 12) AS delta FROM O LEFT JOIN BL ON O.metric = BL.metric AND O.average = BL.average"""
    return q


# ---- step 5 SQL ----------------------------------------------------------------------

def wear(r: str) -> str:
    return (f"CASE WHEN {r} > 100 THEN 'healthy' WHEN {r} > 50 THEN 'moderate_wear' "
            f"WHEN {r} > 20 THEN 'severe_wear' ELSE 'failed' END")


def reward_sql(s: str, a: str, n: str) -> str:
    return f"""CAST(CASE WHEN {n} = 'failed' THEN -100
  WHEN {a} = 'immediate_maintenance' THEN CASE WHEN {s} IN ('severe_wear', 'failed') THEN 10 ELSE -20 END
  WHEN {a} = 'schedule_maintenance' THEN CASE WHEN {s} = 'moderate_wear' THEN 0 WHEN {s} = 'severe_wear' THEN -10 ELSE -15 END
  WHEN {a} = 'no_maintenance' THEN CASE WHEN {s} = 'healthy' THEN 5 WHEN {s} = 'moderate_wear' THEN -1 ELSE -50 END
  ELSE -1 END AS DOUBLE)"""


RISK = ("CASE WHEN {p} IS NULL THEN NULL WHEN {p} < 0.3 THEN 'LOW' WHEN {p} < 0.5 THEN 'MEDIUM' "
        "WHEN {p} < 0.75 THEN 'HIGH' ELSE 'CRITICAL' END")

STEPS = f"""ST AS (SELECT unit_number, time_in_cycles, RUL, {wear('RUL')} AS state,
  lead({wear('RUL')}) OVER (PARTITION BY unit_number ORDER BY time_in_cycles) AS next_state,
  'no_maintenance' AS action FROM R)"""

ACTIONS = ["no_maintenance", "immediate_maintenance", "schedule_maintenance"]
POLICY_ACTIONS = [*ACTIONS, "maintenance"]
INTERVALS = {"immediate_maintenance": (20.0, 50.0), "schedule_maintenance": (10.0, 30.0)}
BANDS = [("healthy", 100.0, None), ("moderate_wear", 50.0, 100.0), ("severe_wear", 20.0, 50.0),
         ("failed", None, 20.0)]


def transitions_cte(actions=ACTIONS) -> str:
    parts = []
    for a in actions:
        lo_d, hi_d = INTERVALS.get(a, (-10.0, -1.0))
        for ns, blo, bhi in BANDS:
            lo = f"(r + {lo_d})" if blo is None else f"greatest(r + {lo_d}, {blo})"
            hi = f"(r + {hi_d})" if bhi is None else f"least(r + {hi_d}, {bhi})"
            parts.append(f"SELECT w, {wear('r')} AS state, '{a}' AS action, '{ns}' AS next_state, "
                         f"greatest({hi} - {lo}, 0.0) / {hi_d - lo_d} AS p FROM RV")
    return f"""RV AS (SELECT CAST(RUL AS DOUBLE) AS r, count(*) AS w FROM R WHERE RUL IS NOT NULL GROUP BY 1),
EX AS ({' UNION ALL '.join(parts)}),
TR AS (SELECT state, action, next_state, sum(w * p) / sum(w) AS probability,
  {reward_sql('state', 'action', 'next_state')} AS reward FROM EX GROUP BY state, action, next_state)"""


def values_cte(actions=ACTIONS) -> str:
    place = " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(actions))
    return f"""{transitions_cte(actions)},
QV(k, state, action, q) AS (
  SELECT 0, state, action, CAST(0.0 AS DOUBLE) FROM (SELECT DISTINCT state, action FROM TR)
  UNION ALL
  SELECT any_value(KK.k) + 1, TR.state, TR.action, sum(TR.probability * (TR.reward + 0.9 * coalesce(M.mq, 0.0)))
  FROM TR LEFT JOIN (SELECT state, max(q) AS mq FROM QV GROUP BY state) M ON TR.next_state = M.state
  JOIN (SELECT max(k) AS k FROM QV) KK ON true
  WHERE KK.k < 300 GROUP BY TR.state, TR.action),
Q AS (SELECT state, action, q FROM QV WHERE k = 300),
GP AS (SELECT state, action AS recommended_action, q AS value FROM Q
  QUALIFY row_number() OVER (PARTITION BY state ORDER BY q DESC,
    CASE action {place} END) = 1)"""


QV = values_cte()

TIMELINE = f"""TS AS (SELECT unit_number, time_in_cycles,
  least(1.0, coalesce(CASE WHEN count(sensor_measurement_4) OVER w5 = 5 THEN avg(sensor_measurement_4) OVER w5 END, 0) / 50.0) AS probability,
  max(time_in_cycles) OVER (PARTITION BY unit_number) AS total_cycles,
  row_number() OVER (PARTITION BY unit_number ORDER BY time_in_cycles) AS pos
  FROM L WINDOW w5 AS (PARTITION BY unit_number ORDER BY time_in_cycles ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
TP AS (SELECT unit_number, time_in_cycles, total_cycles, probability,
  printf('%.1f', probability * 100) || '%' AS probability_text, {RISK.format(p='probability')} AS risk_level,
  printf('%.1f', CAST(time_in_cycles AS DOUBLE) / total_cycles * 100) || '%' AS lifecycle_text
  FROM TS WHERE pos >= 5 AND (pos - 5) % 5 = 0)"""


def build_policy() -> dict[str, str]:
    q: dict[str, str] = {}
    q["threshold_decision"] = f"WITH {S_CTE}\nSELECT unit_number, time_in_cycles, p_price, CAST(p_price >= 0.5 AS BIGINT) AS decision FROM S"
    q["risk_band"] = f"WITH {S_CTE}\nSELECT unit_number, time_in_cycles, p_price, {RISK.format(p='p_price')} AS risk_level FROM S"
    q["risk_recommendation"] = f"""WITH {S_CTE},
RT AS (SELECT * FROM (VALUES ('LOW', '#28a745', 'Continue normal operations.'),
  ('MEDIUM', '#ffc107', 'Schedule maintenance inspection.'), ('HIGH', '#fd7e14', 'Schedule immediate maintenance.'),
  ('CRITICAL', '#dc3545', 'URGENT: Emergency maintenance required!')) v(risk_level, color, recommendation)),
SR AS (SELECT unit_number, time_in_cycles, CAST(p_price >= 0.5 AS BIGINT) AS prediction, {RISK.format(p='p_price')} AS risk_level FROM S)
SELECT unit_number, time_in_cycles, prediction, SR.risk_level, color, recommendation FROM SR LEFT JOIN RT ON SR.risk_level = RT.risk_level"""
    q["wear_state"] = f"WITH {L}, {R_CTE}\nSELECT unit_number, time_in_cycles, RUL, {wear('RUL')} AS state FROM R"
    q["policy_reward"] = f"""WITH {L}, {R_CTE}, {STEPS}
SELECT unit_number, time_in_cycles, RUL, state, next_state, action, {reward_sql('state', 'action', 'next_state')} AS reward FROM ST"""
    q["wear_transitions"] = f"""WITH {L}, {R_CTE}, {STEPS}
SELECT state, action, next_state, CAST(count(*) AS BIGINT) AS count,
  round(avg({reward_sql('state', 'action', 'next_state')}), 9) AS mean_reward
FROM ST WHERE next_state IS NOT NULL GROUP BY state, action, next_state"""
    q["action_transitions"] = f"""WITH {L}, {R_CTE}, {transitions_cte()}
SELECT state, action, next_state, round(probability, 12) AS probability, round(reward, 12) AS reward FROM TR"""
    q["policy_values"] = f"WITH RECURSIVE {L}, {R_CTE}, {QV}\nSELECT state, action, round(q, 6) AS q FROM Q"
    q["greedy_policy"] = f"WITH RECURSIVE {L}, {R_CTE}, {QV}\nSELECT state, recommended_action, round(value, 6) AS value FROM GP"
    q["policy_reward_maintenance"] = q["policy_reward"].replace("'no_maintenance' AS action", "'maintenance' AS action")
    q["action_transitions_all"] = f"""WITH {L}, {R_CTE}, {transitions_cte(POLICY_ACTIONS)}
SELECT state, action, next_state, round(probability, 12) AS probability, round(reward, 12) AS reward FROM TR"""
    q["policy_values_all"] = f"WITH RECURSIVE {L}, {R_CTE}, {values_cte(POLICY_ACTIONS)}\nSELECT state, action, round(q, 6) AS q FROM Q"
    q["q_table_all"] = f"""WITH RECURSIVE {L}, {R_CTE}, {values_cte(POLICY_ACTIONS)}
SELECT state, {', '.join(f"round(max(CASE WHEN action = '{a}' THEN q END), 6) AS {a}" for a in POLICY_ACTIONS)} FROM Q GROUP BY state"""
    q["greedy_policy_config"] = f"""WITH RECURSIVE {L}, {R_CTE}, {values_cte(("no_maintenance", "maintenance"))}
SELECT state, recommended_action, round(value, 6) AS value FROM GP"""
    q["q_table_wide"] = f"""WITH RECURSIVE {L}, {R_CTE}, {QV}
SELECT state, {', '.join(f"round(max(CASE WHEN action = '{a}' THEN q END), 6) AS {a}" for a in ACTIONS)} FROM Q GROUP BY state"""
    q["maintenance_schedule"] = f"""WITH RECURSIVE {L}, {R_CTE}, {QV}
SELECT unit_number, time_in_cycles, RUL, {wear('RUL')} AS state, GP.recommended_action FROM R LEFT JOIN GP ON {wear('RUL')} = GP.state"""
    q["schedule_merge"] = f"""WITH RECURSIVE {S_CTE}, {QV},
SC AS (SELECT unit_number, time_in_cycles, {wear('RUL')} AS state, GP.recommended_action FROM S LEFT JOIN GP ON {wear('RUL')} = GP.state)
SELECT S.unit_number, S.time_in_cycles, RUL, failure, p_qty, prediction, SC.state, SC.recommended_action
FROM S LEFT JOIN SC ON S.unit_number = SC.unit_number AND S.time_in_cycles = SC.time_in_cycles"""
    q["block_average"] = f"""WITH {L}, {R_CTE}, {STEPS}
SELECT unit_number, CAST(floor((time_in_cycles - 1) / 100) AS BIGINT) AS block,
  round(avg({reward_sql('state', 'action', 'next_state')}), 9) AS average_reward, CAST(count(*) AS BIGINT) AS steps
FROM ST WHERE next_state IS NOT NULL GROUP BY 1, 2"""
    q["timeline_table"] = f"WITH {L}, {TIMELINE}\nSELECT * FROM TP"
    q["timeline_summary"] = f"""WITH {L}, {TIMELINE}
SELECT unit_number, arg_min(probability, time_in_cycles) AS initial_risk, arg_max(probability, time_in_cycles) AS final_risk,
  max(probability) AS peak_risk, min(CASE WHEN probability > 0.5 THEN time_in_cycles END) AS first_cycle_above_half
FROM TP GROUP BY unit_number"""
    q["ground_truth_check"] = f"""WITH {L}, {TIMELINE},
G AS (SELECT unit_number, time_in_cycles, CAST(total_cycles - time_in_cycles + (unit_number * 37) % 146 AS BIGINT) AS rem,
  CAST(total_cycles + (unit_number * 37) % 146 AS BIGINT) AS failure_cycle, CAST(probability >= 0.5 AS BIGINT) AS prediction FROM TP)
SELECT unit_number, time_in_cycles, failure_cycle, rem AS cycles_remaining, CAST(rem < 90 AS BIGINT) AS actually_failing, prediction,
  CAST(prediction = CAST(rem < 90 AS BIGINT) AS BIGINT) AS correct FROM G"""
    return q


# ---- step 6 SQL ----------------------------------------------------------------------

def h(*parts: str) -> str:
    inner = " || '|' || ".join(["'42'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"CAST(('0x' || substr(md5({inner}), 1, 8)) AS BIGINT)"


VEC = "V AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS features, CAST(label AS BIGINT) AS label FROM embeddings)"
KNN_V = """NN AS (SELECT a.vec_id AS q_id, b.vec_id AS s_id, list_distance(a.features, b.features) AS distance,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.features, b.features), b.vec_id) AS rank
  FROM {src} a JOIN {src} b ON a.vec_id <> b.vec_id QUALIFY rank <= 5)"""


def build_sampling() -> dict[str, str]:
    q: dict[str, str] = {}
    q["distinct_units"] = f"WITH {L}\nSELECT DISTINCT unit_number FROM L"
    units = f"""U AS (SELECT unit_number, row_number() OVER (ORDER BY {h('unit_number')}, unit_number) AS rn
  FROM (SELECT DISTINCT unit_number FROM L)),
NV AS (SELECT greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) AS n FROM U),
VU AS (SELECT unit_number FROM U, NV WHERE rn <= n)"""
    q["unit_split_val"] = f"WITH {L}, {units}\nSELECT unit_number, time_in_cycles, sensor_measurement_4 FROM L WHERE unit_number IN (SELECT unit_number FROM VU)"
    q["unit_split_train"] = f"WITH {L}, {units}\nSELECT unit_number, time_in_cycles, sensor_measurement_4 FROM L WHERE unit_number NOT IN (SELECT unit_number FROM VU)"
    q["row_split"] = f"""WITH {L}, RS AS (SELECT unit_number, time_in_cycles,
  row_number() OVER (ORDER BY {h('unit_number', 'time_in_cycles')}, unit_number, time_in_cycles) AS rn FROM L)
SELECT unit_number, time_in_cycles, CASE WHEN rn <= ceil((SELECT count(*) FROM L) * 0.2) THEN 'test' ELSE 'train' END AS split FROM RS"""
    q["undersample"] = f"""WITH {L}, {R_CTE}, {B_CTE}, NM AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM B GROUP BY failure)),
US AS (SELECT unit_number, time_in_cycles, failure, row_number() OVER (PARTITION BY failure
  ORDER BY {h('unit_number', 'time_in_cycles')}, unit_number, time_in_cycles) AS rn FROM B)
SELECT unit_number, time_in_cycles, failure FROM US, NM WHERE rn <= n"""
    smote = f"""{VEC}, BV AS (SELECT vec_id, features, CAST(label = 3 AS BIGINT) AS minority FROM V),
MI AS (SELECT vec_id, features, row_number() OVER (ORDER BY vec_id) AS b FROM BV WHERE minority = 1),
CN AS (SELECT count(*) FILTER (WHERE minority = 1) AS n_min, count(*) FILTER (WHERE minority = 0) AS n_maj FROM BV),
{KNN_V.format(src='MI')},
SY AS (SELECT range AS syn_id, (({h("'b'", 'range')}) % n_min) + 1 AS b,
  (({h("'n'", 'range')}) % least(5, n_min - 1)) + 1 AS r,
  CAST({h("'g'", 'range')} AS DOUBLE) / 4294967296.0 AS gap FROM CN, range(n_maj - n_min)),
SR AS (SELECT syn_id, MI.vec_id AS base_id, NN.s_id AS neighbor_id, gap,
  list_transform(list_zip(MI.features, NB.features), lambda x: x[1] + gap * (x[2] - x[1])) AS features
  FROM SY JOIN MI ON SY.b = MI.b JOIN NN ON NN.q_id = MI.vec_id AND NN.rank = SY.r JOIN MI NB ON NB.vec_id = NN.s_id)"""
    q["smote_rows"] = f"""WITH {smote}
SELECT syn_id, base_id, neighbor_id, round(gap, 9) AS gap, round(list_sum(features), 6) AS feature_sum,
  round(features[1], 6) AS feature_1, CAST(1 AS BIGINT) AS minority FROM SR"""
    q["smote_counts"] = f"""WITH {VEC}, BV AS (SELECT CAST(label = 3 AS BIGINT) AS minority FROM V),
CN AS (SELECT count(*) FILTER (WHERE minority = 1) AS n_min, count(*) FILTER (WHERE minority = 0) AS n_maj FROM BV)
SELECT CAST(0 AS BIGINT) AS minority, CAST(n_maj AS BIGINT) AS count FROM CN UNION ALL SELECT 1, CAST(n_maj AS BIGINT) FROM CN"""
    q["rebalance_counts"] = f"""WITH {L}, {R_CTE}, {B_CTE}, C AS (SELECT failure, count(*) AS n FROM B GROUP BY failure),
M AS (SELECT min(n) AS mn, max(n) AS mx, sum(n) AS tot, count(*) AS k FROM C)
SELECT 'none' AS method, failure, CAST(n AS BIGINT) AS count, CAST(n AS DOUBLE) AS weight_sum FROM C
UNION ALL SELECT 'undersample', failure, CAST(mn AS BIGINT), CAST(mn AS DOUBLE) FROM C, M
UNION ALL SELECT 'smote', failure, CAST(mx AS BIGINT), CAST(mx AS DOUBLE) FROM C, M
UNION ALL SELECT 'cost_sensitive', failure, CAST(n AS BIGINT), round(tot / (k * n) * n, 6) FROM C, M"""
    q["knn_join"] = f"""WITH {VEC}, {KNN_V.format(src='V')}
SELECT q_id AS vec_id, s_id AS neighbor_id, CAST(rank AS BIGINT) AS rank, round(distance, 6) AS distance FROM NN"""
    q["knn_classify"] = f"""WITH {VEC}, {KNN_V.format(src='V')},
VO AS (SELECT q_id, V.label AS lab, count(*) AS votes FROM NN JOIN V ON NN.s_id = V.vec_id GROUP BY 1, 2),
BE AS (SELECT q_id, lab, votes, sum(votes) OVER (PARTITION BY q_id) AS n FROM VO
  QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY votes DESC, lab ASC) = 1)
SELECT q_id AS vec_id, lab AS predicted, CAST(votes AS BIGINT) AS votes, round(votes / n, 9) AS probability FROM BE"""
    return q


# ---- step 7/8 SQL ----------------------------------------------------------------------

L_OUT = ["unit_number", "time_in_cycles", "operational_setting_1", "operational_setting_2", "operational_setting_3",
         "sensor_measurement_4", "sensor_measurement_7", "sensor_measurement_11", "sensor_measurement_22"]
VALUE_COLS = ([f"operational_setting_{i}" for i in range(1, 4)] + [f"sensor_measurement_{i}" for i in range(1, 27)])


def req_values() -> list[str]:
    have = set(L_VALUES)
    return [f"coalesce({c}, 0.0)" if c in have else "0.0" for c in VALUE_COLS]


LAST5 = f"""L5 AS (SELECT unit_number, time_in_cycles, {', '.join(f'{v} AS v{i}' for i, v in enumerate(req_values()))},
  row_number() OVER (PARTITION BY unit_number ORDER BY time_in_cycles DESC) AS rn,
  least(5, count(*) OVER (PARTITION BY unit_number)) AS nu FROM L QUALIFY rn <= 5)"""
REQ = f"""{LAST5},
RQ AS (SELECT unit_number AS unit_id, list([{', '.join(f'v{i}' for i in range(29))}] ORDER BY time_in_cycles) AS ts
  FROM L5 GROUP BY unit_number)"""


def roc_ctes(score: str, p: str) -> str:
    g = groups_cte(score).replace("G0 AS", f"{p}G0 AS").replace("FROM G0", f"FROM {p}G0") \
        .replace("G AS (", f"{p}G AS (").replace("T AS (", f"{p}T AS (")
    return f"""{g},
{p}K AS (SELECT {p}G.*, lead(pos) OVER (ORDER BY rank) AS pos_n, lead(neg) OVER (ORDER BY rank) AS neg_n FROM {p}G),
{p}R AS (SELECT CAST('Infinity' AS DOUBLE) AS threshold, 0.0 / N AS fpr, 0.0 / P AS tpr FROM {p}T
  UNION ALL SELECT score, fps / N, tps / P FROM {p}K, {p}T
  WHERE m <= 2 OR rank = 1 OR rank = m OR neg_n <> neg OR pos_n <> pos)"""


def build_sources() -> dict[str, str]:
    q: dict[str, str] = {}
    q["read_telemetry_text"] = f"WITH {L}\nSELECT {', '.join(L_OUT)} FROM L"
    q["read_csv_telemetry"] = q["read_telemetry_text"]
    q["read_final_rul"] = f"""WITH {L}, U AS (SELECT DISTINCT unit_number FROM L)
SELECT CAST(row_number() OVER (ORDER BY unit_number) AS BIGINT) AS unit_number, CAST((unit_number * 37) % 146 AS BIGINT) AS RUL FROM U"""
    q["read_csv_without_unit"] = f"""WITH {L}
SELECT CAST(1 AS BIGINT) AS unit_number, CAST(row_number() OVER (ORDER BY unit_number, time_in_cycles) AS BIGINT) AS time_in_cycles,
  sensor_measurement_4, sensor_measurement_7 FROM L"""
    q["request_explode"] = f"""WITH {L}, {LAST5}
SELECT unit_number, CAST(nu - rn + 1 AS BIGINT) AS time_in_cycles, {', '.join(f'CAST(v{i} AS DOUBLE) AS {c}' for i, c in enumerate(VALUE_COLS))} FROM L5"""
    bad_w = "len(list_filter(ts, lambda s: len(s) <> 29)) > 0"
    bad_v = "len(list_filter(ts, lambda s: len(list_filter(s, lambda v: v IS NULL OR isnan(v) OR isinf(v))) > 0)) > 0"
    q["request_validate"] = f"""WITH {L}, {REQ},
VA AS (SELECT unit_id, ts, 'ok' AS variant FROM RQ
  UNION ALL SELECT unit_id, ts[2:5], 'short' FROM RQ
  UNION ALL SELECT unit_id, list_transform(ts, lambda s, i: CASE WHEN i = 1 THEN s[1:28] ELSE s END), 'narrow' FROM RQ
  UNION ALL SELECT unit_id, list_transform(ts, lambda s, i: CASE WHEN i = 1 THEN list_concat([CAST('nan' AS DOUBLE)], s[2:29]) ELSE s END), 'nan' FROM RQ
  UNION ALL SELECT 0, ts, 'unit0' FROM RQ),
CH AS (SELECT unit_id, variant, CASE WHEN unit_id IS NULL OR unit_id < 1 THEN 'unit_id'
  WHEN ts IS NULL OR len(ts) < 5 THEN 'too_few_steps' WHEN {bad_w} THEN 'step_width'
  WHEN {bad_v} THEN 'non_finite' END AS reason FROM VA)
SELECT CAST(unit_id AS BIGINT) AS unit_id, variant, CAST(reason IS NULL AS BIGINT) AS valid, reason FROM CH"""
    vsum = "round(0.0 + " + " + ".join(f"v{i}" for i in range(29)) + ", 4)"
    q["parse_manual_rows"] = f"""WITH {L}, {LAST5}
SELECT unit_number AS unit_id, CAST(nu - rn AS BIGINT) AS step, 'ok' AS variant, CAST(1 AS BIGINT) AS valid,
  CAST(29 AS BIGINT) AS n_values, {vsum} AS value_sum FROM L5
UNION ALL SELECT unit_number, CAST(nu - rn AS BIGINT), 'junk', CAST(0 AS BIGINT), CAST(30 AS BIGINT), {vsum} FROM L5"""
    q["latest_report"] = f"""WITH {S_CTE}, {COUNTS}
SELECT {div('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {div('tp', 'tp + fp')} AS precision,
  {div('tp', 'tp + fn')} AS recall, {div('2 * tp', '2 * tp + fp + fn')} AS f1_score, 'second' AS model FROM C"""
    q["write_read_predictions"] = f"WITH {S_CTE}\nSELECT unit_number, time_in_cycles, failure, p_qty, p_price, prediction FROM S"
    q["unit_filter"] = f"""WITH {L}, LF AS (SELECT unit_number AS u, max(time_in_cycles) AS m FROM L GROUP BY 1),
PICK AS (SELECT u FROM LF ORDER BY m DESC, u ASC LIMIT 1)
SELECT * FROM L WHERE unit_number = (SELECT u FROM PICK)"""
    q["preview_rows"] = f"WITH {L}\nSELECT * FROM L ORDER BY unit_number, time_in_cycles LIMIT 10"
    q["curve_union"] = f"""WITH {S_CTE}, {roc_ctes('p_qty', 'XA')}, {roc_ctes('p_price', 'XB')}
SELECT *, 'qty' AS model FROM XAR UNION ALL SELECT *, 'price' AS model FROM XBR"""
    return q


def metric_rows_sql(tag: str, pred: str, score: str) -> str:
    cnt = COUNTS.replace("C AS (", f"{tag}C AS (").replace("prediction", pred)
    g = groups_cte(score).replace("G0 AS", f"{tag}G0 AS").replace("FROM G0", f"FROM {tag}G0") \
        .replace("G AS (", f"{tag}G AS (").replace("T AS (", f"{tag}T AS (")
    p1, r1 = div('tp', 'tp + fp'), div('tp', 'tp + fn')
    p0, r0 = div('tn', 'tn + fn'), div('tn', 'tn + fp')
    f1, f0 = div('2 * tp', '2 * tp + fp + fn'), div('2 * tn', '2 * tn + fn + fp')
    n = "(tp + fp + fn + tn)"
    return f"""{cnt}, {g},
{tag}O AS (SELECT 'precision' AS metric, 'binary' AS average, {p1} AS value FROM {tag}C
  UNION ALL SELECT 'recall', 'binary', {r1} FROM {tag}C UNION ALL SELECT 'f1_score', 'binary', {f1} FROM {tag}C
  UNION ALL SELECT 'precision', 'weighted', {div(f'{p0} * (tn + fp) + {p1} * (tp + fn)', n)} FROM {tag}C
  UNION ALL SELECT 'recall', 'weighted', {div(f'{r0} * (tn + fp) + {r1} * (tp + fn)', n)} FROM {tag}C
  UNION ALL SELECT 'f1_score', 'weighted', {div(f'{f0} * (tn + fp) + {f1} * (tp + fn)', n)} FROM {tag}C
  UNION ALL SELECT 'accuracy', 'binary', {div('tp + tn', n)} FROM {tag}C
  UNION ALL SELECT 'accuracy', 'weighted', {div('tp + tn', n)} FROM {tag}C
  UNION ALL SELECT 'roc_auc', 'binary', (SELECT sum(pos * (N - fps + neg / 2)) / max(P * N) FROM {tag}G, {tag}T))"""


def build_ranking() -> dict[str, str]:
    s2 = S_CTE + ",\nS2 AS (SELECT *, CAST(p_price >= 0.5 AS BIGINT) AS prediction2 FROM S)"
    a = metric_rows_sql("XA", "prediction", "p_qty")
    b = metric_rows_sql("XB", "prediction2", "p_price").replace("FROM S)", "FROM S2)").replace("FROM S WHERE", "FROM S2 WHERE")
    return {"model_ranking": f"""WITH {s2}, {a}, {b},
ALLR AS (SELECT *, 'qty' AS model FROM XAO UNION ALL SELECT *, 'price' AS model FROM XBO)
SELECT metric, average, round(value, 12) AS value, model,
  CAST(row_number() OVER (PARTITION BY metric, average ORDER BY value DESC, model) AS BIGINT) AS rank FROM ALLR"""}


def build_extra() -> dict[str, str]:
    q: dict[str, str] = {}
    ef = feature_select(["sensor_measurement_4"], ["sensor_measurement_4"], passthrough=["RUL", "failure"],
                        digits=6, cum_digits=6)
    q["engineer_features_events"] = f"""WITH {E}, ER AS (SELECT *, CAST(max(time_in_cycles) OVER (PARTITION BY unit_number)
   - time_in_cycles AS BIGINT) AS RUL FROM E), EB AS (SELECT *, CAST(coalesce(RUL <= 20, false) AS BIGINT) AS failure FROM ER)
SELECT {ef} FROM EB"""
    q["action_distribution"] = f"""WITH RECURSIVE {L}, {R_CTE}, {QV},
SCH AS (SELECT GP.recommended_action FROM R LEFT JOIN GP ON {wear('RUL')} = GP.state),
C AS (SELECT recommended_action, CAST(count(*) AS BIGINT) AS count FROM SCH GROUP BY 1)
SELECT recommended_action, count, count / sum(count) OVER () AS share FROM C"""
    cnt_a = COUNTS.replace("C AS (", "CA AS (")
    cnt_b = COUNTS.replace("C AS (", "CB AS (").replace("prediction", "prediction2").replace("FROM S)", "FROM S2)")
    q["best_recall"] = f"""WITH {S_CTE},
S2 AS (SELECT *, CAST(p_price >= 0.5 AS BIGINT) AS prediction2 FROM S), {cnt_a}, {cnt_b},
RR AS (SELECT {div('tp', 'tp + fn')} AS value, 'qty' AS model FROM CA UNION ALL SELECT {div('tp', 'tp + fn')}, 'price' FROM CB)
SELECT max(value) AS best_recall, arg_max(model, value) AS model FROM RR"""
    return q
