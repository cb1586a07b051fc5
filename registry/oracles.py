"""Each registered query in plain SQL, written against the same tables."""

from __future__ import annotations

FACT = """
fact AS (
  SELECT *, amp_price * 1.03 AS nadac_price, (asp_price - actual_price) / asp_price * 100 AS margin_percent FROM (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                     CAST(round(l_extendedprice * 100) AS BIGINT)) AS txn_id,
      l_partkey AS drug_id, p_name AS drug_name, 'NDC-' || l_partkey AS ndc_code, p_brand AS manufacturer,
      p_type AS drug_class, l_suppkey AS pharmacy_id, s_name AS pharmacy_name, r_name AS pharmacy_chain,
      n_name AS state, wac AS wac_price, wac * (0.92 + 1.5 * l_discount) AS asp_price,
      wac * (0.82 + 0.6 * l_tax) AS amp_price, wac * (0.67 + 0.6 * l_discount) AS price_340b,
      wac * (0.75 - 4 * l_discount) AS gtn_price, l_extendedprice / l_quantity AS actual_price,
      CAST(l_shipdate AS DATE) AS transaction_date, CAST(l_quantity AS BIGINT) AS volume_units,
      l_returnflag = 'R' AS is_anomaly, CASE WHEN l_returnflag = 'R' THEN 'returned' END AS label_type
    FROM (SELECT *, p_retailprice * 2.2 AS wac FROM lineitem JOIN part ON l_partkey = p_partkey
          JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
          JOIN region ON n_regionkey = r_regionkey)))"""

ZSCORE = """
zstats AS (
  SELECT avg(actual_price) AS ma, stddev_samp(actual_price) AS sa, avg(margin_percent) AS mm,
    stddev_samp(margin_percent) AS sm, avg(gtn_price) AS mg, stddev_samp(gtn_price) AS sg FROM fact),
zed AS (
  SELECT *, greatest(za, zm, zg) AS z_max,
    CASE WHEN za >= zm AND za >= zg THEN 'actual_price' WHEN zm >= zg THEN 'margin_percent' ELSE 'gtn_price' END
      AS z_feature
  FROM (SELECT txn_id, abs((actual_price - ma) / sa) AS za, abs((margin_percent - mm) / sm) AS zm,
          abs((gtn_price - mg) / sg) AS zg FROM fact, zstats))"""

IQR = """
quart AS (
  SELECT 'actual_price' AS f, 1 AS pos, quantile_cont(actual_price, 0.25) AS q1, quantile_cont(actual_price, 0.75) AS q3
  FROM fact
  UNION ALL SELECT 'wac_price', 2, quantile_cont(wac_price, 0.25), quantile_cont(wac_price, 0.75) FROM fact
  UNION ALL SELECT 'margin_percent', 3, quantile_cont(margin_percent, 0.25), quantile_cont(margin_percent, 0.75)
  FROM fact),
fence AS (SELECT *, q1 - 2.5 * (q3 - q1) AS lo, q3 + 2.5 * (q3 - q1) AS hi, q3 - q1 AS iqr FROM quart),
outside AS (
  SELECT txn_id, f, pos, greatest(abs(v - lo), abs(v - hi)) / (iqr + 1e-9) AS dist
  FROM (SELECT txn_id, 'actual_price' AS f, actual_price AS v FROM fact
        UNION ALL SELECT txn_id, 'wac_price', wac_price FROM fact
        UNION ALL SELECT txn_id, 'margin_percent', margin_percent FROM fact) JOIN fence USING (f)
  WHERE v < lo OR v > hi),
fenced AS (
  SELECT txn_id, f AS iqr_feature, dist AS iqr_distance
  FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY dist DESC, pos) AS r FROM outside) WHERE r = 1)"""

MOM = """
seq AS (
  SELECT txn_id, actual_price, lag(actual_price) OVER (
    PARTITION BY drug_id, pharmacy_id ORDER BY transaction_date, txn_id) AS previous_price FROM fact),
moves AS (SELECT *, actual_price / previous_price - 1 AS price_change FROM seq),
jumps AS (
  SELECT txn_id, CASE WHEN price_change > 0.25 THEN 'mom_spike' ELSE 'mom_drop' END AS mom_type,
    least(abs(price_change) / CASE WHEN price_change > 0.25 THEN 1.0 ELSE 0.8 END, 1.0) AS mom_score
  FROM moves WHERE price_change > 0.25 OR price_change < -0.20)"""

RULES = """
ruled AS (
  SELECT txn_id, actual_price > wac_price * 2.5 AS is_wac_breach, asp_price > wac_price * 1.05 AS is_asp_wac_violation,
    price_340b > amp_price * 0.855 AS is_340b_ceiling_breach, gtn_price < wac_price * 0.45 AS is_gtn_floor_breach,
    margin_percent < -20.0 AS is_margin_critical FROM fact)"""

FLAGS = """
flags AS (
  SELECT txn_id, t, priority, detector, method, score FROM (
    SELECT txn_id, 'zscore_outlier' AS t, 1 AS priority, 1 AS detector, 'Z-Score' AS method,
      least(z_max / 9.0, 1.0) AS score FROM zed WHERE z_max > 3
    UNION ALL SELECT txn_id, 'iqr_outlier', 1, 2, 'IQR Fence', least(iqr_distance / 10, 1.0) FROM fenced
    UNION ALL SELECT txn_id, mom_type, CASE mom_type WHEN 'mom_spike' THEN 3 ELSE 2 END, 3, 'MoM Change', mom_score
    FROM jumps
    UNION ALL SELECT txn_id, 'wac_breach', 10, 6, 'Regulatory Rules', 1.0 FROM ruled WHERE is_wac_breach
    UNION ALL SELECT txn_id, 'asp_wac_violation', 9, 6, 'Regulatory Rules', 1.0 FROM ruled WHERE is_asp_wac_violation
    UNION ALL SELECT txn_id, '340b_ceiling_breach', 8, 6, 'Regulatory Rules', 1.0 FROM ruled
    WHERE is_340b_ceiling_breach
    UNION ALL SELECT txn_id, 'gtn_floor_breach', 7, 6, 'Regulatory Rules', 1.0 FROM ruled WHERE is_gtn_floor_breach
    UNION ALL SELECT txn_id, 'margin_critical', 6, 6, 'Regulatory Rules', 1.0 FROM ruled WHERE is_margin_critical))"""

MERGED = """
primaries AS (
  SELECT txn_id, t AS anomaly_type FROM (
    SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY priority DESC, detector) AS r FROM flags) WHERE r = 1),
labels AS (SELECT DISTINCT txn_id, method, detector FROM flags),
methods AS (
  SELECT txn_id, string_agg(method, ' | ' ORDER BY detector) AS detection_method, count(*) AS n_methods
  FROM labels GROUP BY txn_id),
tops AS (SELECT txn_id, max(score) AS anomaly_score, bool_or(priority >= 6) AS has_rule FROM flags GROUP BY txn_id),
found AS (
  SELECT *, CASE WHEN has_rule THEN 'regulatory_review' WHEN severity = 'high' THEN 'escalate'
    WHEN severity = 'medium' THEN 'investigate' ELSE 'monitor' END AS recommended_action
  FROM (SELECT *, CASE WHEN n_methods >= 3 OR has_rule THEN 'high' WHEN n_methods = 2 THEN 'medium' ELSE 'low' END
          AS severity FROM primaries JOIN methods USING (txn_id) JOIN tops USING (txn_id))),
res AS (SELECT * FROM fact JOIN found USING (txn_id)),
ann AS (SELECT * FROM fact LEFT JOIN found USING (txn_id)),
ranks AS (SELECT *, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS rank FROM res)"""

# What counts as white space around a chunk.
WHITESPACE = '\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000'

CHUNKS = f"""
docs AS (SELECT doc_id, trim(text, '{WHITESPACE}') AS t, lang, source FROM documents),
cuts AS (SELECT doc_id, lang, source, s, trim(substring(t, CAST(s + 1 AS INT), 400), '{WHITESPACE}') AS text
         FROM (SELECT *, unnest(range(0, length(t), 320)) AS s FROM docs)),
chunks AS (SELECT doc_id, lang, source, text, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index
           FROM cuts WHERE text <> '')"""

CATALOG = """
catalog AS (SELECT drug_name, min(drug_class) AS drug_class, min(manufacturer) AS manufacturer,
  min(drug_id) AS drug_id, min(wac_price) AS wac_min, max(wac_price) AS wac_max, avg(wac_price) AS wac_mean
  FROM fact GROUP BY drug_name)"""

HISTORY = """
history AS (SELECT *, round(amp * (1.0 - 0.2302), 4) AS ceiling_340b,
    (wac_per_unit - net_price) / wac_per_unit AS gross_to_net_pct
  FROM (SELECT drug_id AS ndc, strftime(transaction_date, '%Y-%m') AS period, min(drug_name) AS brand_name,
    avg(wac_price) AS wac_per_unit, avg(asp_price) AS asp, avg(amp_price) AS amp, min(actual_price) AS best_price,
    avg(gtn_price) AS net_price FROM fact GROUP BY ALL))"""

ORACLES: dict[str, str] = {}


def decimal(sql: str) -> str:
    """``round(e, digits)`` taken in decimals, where a half is a half in every engine."""
    out, rest = "", sql
    while "round(" in rest:
        head, rest = rest.split("round(", 1)
        depth, comma, end = 0, None, 0
        for end, ch in enumerate(rest):
            if ch == ")" and depth == 0:
                break
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                comma = end
        inside, rest = rest[:end], rest[end + 1:]
        if comma is None:
            out += f"{head}round({decimal(inside)})"
        else:
            out += f"{head}CAST(round(CAST({decimal(inside[:comma])} AS DECIMAL(38, 10)),{inside[comma + 1:]}) AS DOUBLE)"
    return out + rest


def on(*parts: str, **queries: str) -> None:
    prefix = "WITH " + ",".join(parts) + "\n" if parts else ""
    ORACLES.update({name: decimal(prefix + sql) for name, sql in queries.items()})


def rounded(names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names.split())


DAY = "strftime(transaction_date, '%Y-%m-%d') AS transaction_date"
MONTH = "strftime(transaction_date, '%Y-%m')"
PRICES = "wac_price asp_price amp_price price_340b gtn_price nadac_price actual_price margin_percent"
PCT = "(wac_price - gtn_price) / wac_price"
WIDE = f"""txn_id, drug_id, drug_name, ndc_code, manufacturer, drug_class, pharmacy_id, pharmacy_name, pharmacy_chain,
  state, {rounded(PRICES)}, {DAY}, volume_units, is_anomaly, label_type AS anomaly_type"""

on(
    FACT,
    scan_pricing=f"SELECT {WIDE} FROM fact",
    anomaly_extract=f"SELECT {WIDE} FROM fact WHERE is_anomaly",
    roundtrip_parquet=f"SELECT txn_id, drug_name, {rounded('actual_price')}, {DAY} FROM fact",
    star_drugs="""SELECT drug_id, min(drug_name) AS drug_name, min(ndc_code) AS ndc_code,
        min(manufacturer) AS manufacturer, min(drug_class) AS drug_class, round(min(wac_price), 6) AS wac_low,
        round(max(wac_price), 6) AS wac_high FROM fact GROUP BY drug_id""",
    star_pharmacies="SELECT DISTINCT pharmacy_id, pharmacy_name, pharmacy_chain, state FROM fact",
    star_anomalies=f"""SELECT txn_id AS tx_id, drug_id, pharmacy_id, label_type AS anomaly_type,
        {rounded('actual_price wac_price margin_percent gtn_price')}, volume_units, {DAY} FROM fact WHERE is_anomaly""",
    star_join=f"""SELECT txn_id AS tx_id, drug_id, drug_name, drug_class, pharmacy_id, pharmacy_name, state,
        {rounded('actual_price')} FROM fact""",
    price_trend_90d="""SELECT drug_id, strftime(transaction_date, '%Y-%m-%d') AS day, round(actual_price, 2)
          AS actual_price
        FROM (SELECT *, max(transaction_date) OVER (PARTITION BY drug_id) AS newest, row_number() OVER (
            PARTITION BY drug_id, transaction_date ORDER BY txn_id DESC) AS r FROM fact)
        WHERE r = 1 AND transaction_date >= newest - INTERVAL 90 DAYS""",
    gtn_discount=f"""SELECT txn_id, round(least(greatest({PCT}, 0), 1), 6) AS fraction_clipped,
        round({PCT}, 6) AS fraction, round({PCT} * 100, 6) AS percent,
        round(least(greatest({PCT} * 100, 0), 100), 6) AS percent_clipped FROM fact""",
    margin="SELECT txn_id, round((asp_price - actual_price) / asp_price * 100, 4) AS margin FROM fact",
    validate_contract=f"""SELECT 'negative_wac' AS check_name, count(*) FILTER (wac_price < 0) AS bad_rows FROM fact
        UNION ALL SELECT 'gtn_out_of_range', count(*) FILTER ({PCT} < 0 OR {PCT} > 1) FROM fact
        UNION ALL SELECT 'missing_key', count(*) FILTER (drug_id IS NULL OR pharmacy_id IS NULL) FROM fact""",
    null_counts="\nUNION ALL ".join(
        f"SELECT '{name}' AS column_name, count(*) - count({column}) AS nulls FROM fact"
        for name, column in [(c, c) for c in (
            "txn_id drug_id drug_name ndc_code manufacturer drug_class pharmacy_id pharmacy_name pharmacy_chain state "
            "transaction_date volume_units is_anomaly " + PRICES).split()] + [("anomaly_type", "label_type")]),
    format_cols="""SELECT txn_id, format('${:,.2f}', actual_price) AS usd,
        format('{:.1f}%', volume_units / 1000 * 100) AS pct, strftime(transaction_date, '%Y-%m-%d') AS day,
        CASE WHEN is_anomaly THEN 'Anomaly' ELSE 'Normal' END AS status FROM fact""",
    summary_stats=f"""SELECT count(*) AS total_records, count(*) FILTER (is_anomaly) AS anomaly_count,
        round(count(*) FILTER (is_anomaly) / count(*), 4) AS anomaly_rate, round(avg(margin_percent), 4) AS avg_margin,
        round(avg({PCT}), 4) AS avg_gtn_discount_pct, (SELECT string_agg(drug_name, ',' ORDER BY n DESC, drug_name) FROM (
          SELECT drug_name, count(*) AS n FROM fact WHERE is_anomaly GROUP BY drug_name ORDER BY n DESC, drug_name LIMIT 5))
          AS top_5_anomalous_drugs FROM fact""",
    wac_range_by_class="""SELECT drug_class, round(min(wac_price), 2) AS wac_min, round(max(wac_price), 2) AS wac_max,
        round(avg(wac_price), 2) AS wac_mean FROM fact GROUP BY drug_class""",
    wac_trend_top8=f"""SELECT {MONTH} AS month, drug_name, round(avg(wac_price), 4) AS wac_price FROM fact
        WHERE drug_name IN (SELECT drug_name FROM fact GROUP BY drug_name ORDER BY count(*) DESC, drug_name LIMIT 8)
        GROUP BY ALL""",
    gtn_quarter=f"""SELECT drug_class, year(transaction_date) || 'Q' || quarter(transaction_date) AS quarter,
        round(avg({PCT} * 100), 4) AS gtn_pct FROM fact GROUP BY ALL""",
    gtn_month_pivot=f"""SELECT drug_class, month, round(coalesce(avg(pct), 0), 4) AS gtn_pct
        FROM (SELECT drug_class, month FROM (SELECT DISTINCT drug_class FROM fact)
              CROSS JOIN (SELECT DISTINCT {MONTH} AS month FROM fact))
        LEFT JOIN (SELECT drug_class, {MONTH} AS month, least(greatest({PCT} * 100, 0), 100) AS pct FROM fact)
        USING (drug_class, month) GROUP BY ALL""",
    benchmarks_long="\nUNION ALL ".join(
        f"SELECT drug_class, '{c}' AS benchmark, round(avg({c}), 4) AS avg_price FROM fact GROUP BY drug_class"
        for c in ("wac_price", "asp_price", "amp_price", "price_340b")),
    **{name: f"""SELECT {by}, round(min({c}), 6) AS low, round(quantile_cont({c}, 0.25), 6) AS q1,
        round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, round(max({c}), 6) AS high
        FROM fact GROUP BY {by}""" for name, by, c in (
            ("margin_box", "drug_class", "margin_percent"), ("wac_box", "drug_class", "wac_price"),
            ("wac_box_by_drug", "drug_id", "actual_price"))},
    gtn_histogram=f"""SELECT bin, round(lo + bin * w, 4) AS low, round(lo + (bin + 1) * w, 4) AS high, count(v) AS n FROM
        (SELECT bin, lo, w FROM (SELECT CAST(unnest(range(30)) AS INT) AS bin),
           (SELECT lo, (hi - lo) / 30 AS w FROM (SELECT min(v) AS lo, max(v) AS hi FROM (
              SELECT least(greatest({PCT} * 100, 0), 100) AS v FROM fact)))) b
        LEFT JOIN (SELECT least(greatest({PCT} * 100, 0), 100) AS v FROM fact) f
          ON CAST(least(floor((v - lo) / w), 29) AS INT) = bin GROUP BY bin, lo, w""",
    gtn_center=f"""SELECT round(avg(v), 4) AS mean_gtn, round(quantile_cont(v, 0.5), 4) AS median_gtn
        FROM (SELECT least(greatest({PCT} * 100, 0), 100) AS v FROM fact)""",
    class_pricing="""SELECT drug_class, round(avg(wac_price), 2) AS wac_mean, round(min(wac_price), 2) AS wac_min,
        round(max(wac_price), 2) AS wac_max, round(avg(gtn_price), 2) AS gtn_mean,
        round(avg(margin_percent), 2) AS margin_mean FROM fact GROUP BY drug_class""",
    key_findings="""SELECT count(*) AS transactions, count(DISTINCT drug_name) AS drugs,
        count(DISTINCT pharmacy_name) AS pharmacies, count(*) FILTER (is_anomaly) AS anomalies,
        round(count(*) FILTER (is_anomaly) * 100.0 / count(*), 4) AS anomaly_rate, round(avg(wac_price), 4) AS avg_wac,
        round(avg(gtn_price), 4) AS avg_gtn, round(quantile_cont(margin_percent, 0.5), 4) AS median_margin,
        (SELECT drug_name FROM fact ORDER BY wac_price DESC, drug_name LIMIT 1) AS highest_wac_drug,
        round(max(wac_price), 4) AS highest_wac FROM fact""",
    top_abs_margin=f"""SELECT txn_id, drug_name, pharmacy_name, {rounded('wac_price actual_price margin_percent')}
        FROM fact WHERE is_anomaly ORDER BY abs(fact.margin_percent) DESC, txn_id LIMIT 10""",
    top5_expensive=f"""SELECT txn_id, drug_name, {DAY}, {rounded('wac_price')} FROM fact WHERE drug_name IN (
        SELECT drug_name FROM fact GROUP BY drug_name ORDER BY max(wac_price) DESC, drug_name LIMIT 5)""",
    price_corridor="\nUNION ALL ".join(
        f"SELECT txn_id, drug_name, {DAY}, '{c}' AS benchmark, round({c}, 6) AS price FROM fact"
        for c in ("wac_price", "asp_price", "amp_price", "gtn_price", "price_340b")),
    label_counts="""SELECT CASE WHEN is_anomaly THEN 'Anomaly' ELSE 'Normal' END AS status,
        label_type AS anomaly_type, count(*) AS n FROM fact GROUP BY ALL""",
    causal_summary="""SELECT drug_id, min(drug_name) AS drug_name, count(*) AS transactions,
          round(any_value(a1), 4) AS pre_actual_price, round(any_value(a2), 4) AS post_actual_price,
          round(any_value(m1), 4) AS pre_margin_percent, round(any_value(m2), 4) AS post_margin_percent,
          strftime(min(transaction_date) FILTER (rn <= mid), '%Y-%m-%d') AS pre_start,
          strftime(max(transaction_date) FILTER (rn <= mid), '%Y-%m-%d') AS pre_end,
          strftime(min(transaction_date) FILTER (rn > mid), '%Y-%m-%d') AS post_start,
          strftime(max(transaction_date) FILTER (rn > mid), '%Y-%m-%d') AS post_end,
          round(stddev_samp(actual_price), 4) AS volatility,
          round(any_value(CASE WHEN a1 = 0 THEN 0 ELSE (a2 - a1) / a1 * 100 END), 4) AS price_change_pct,
          round(any_value(CASE WHEN m1 = 0 THEN 0 ELSE (m2 - m1) / abs(m1) * 100 END), 4) AS margin_change_pct,
          any_value(CASE WHEN abs((a2 - a1) / a1 * 100) < 5 THEN 'stable' WHEN a2 > a1 THEN 'increasing'
            WHEN a2 <= a1 THEN 'decreasing' END) AS trend
        FROM (SELECT *, avg(actual_price) FILTER (rn <= mid) OVER (PARTITION BY drug_id) AS a1,
            avg(actual_price) FILTER (rn > mid) OVER (PARTITION BY drug_id) AS a2,
            avg(margin_percent) FILTER (rn <= mid) OVER (PARTITION BY drug_id) AS m1,
            avg(margin_percent) FILTER (rn > mid) OVER (PARTITION BY drug_id) AS m2
          FROM (SELECT *, row_number() OVER (PARTITION BY drug_id ORDER BY transaction_date, txn_id) AS rn,
              floor(count(*) OVER (PARTITION BY drug_id) / 2) AS mid FROM fact)) GROUP BY drug_id""",
    zscore_rolling="""SELECT txn_id, round(m, 4) AS rolling_mean,
          round(coalesce(CASE WHEN s < 1e-9 THEN 0 ELSE (actual_price - m) / s END, 0), 4) AS z,
          coalesce(CASE WHEN s < 1e-9 THEN 0 ELSE abs((actual_price - m) / s) END, 0) > 3 AS is_spike
        FROM (SELECT *, avg(actual_price) OVER w AS m, stddev_samp(actual_price) OVER w AS s FROM fact
          WINDOW w AS (PARTITION BY drug_id ORDER BY transaction_date, txn_id
            ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))""",
    volume_outlier="""SELECT txn_id, drug_id, volume_units FROM fact JOIN (
          SELECT drug_id, avg(volume_units) AS m, coalesce(stddev_samp(volume_units), 1.0) AS s FROM fact
          GROUP BY drug_id) USING (drug_id) WHERE volume_units > m + 1.5 * s""",
    robust_scale="""SELECT txn_id, round((actual_price - a[2]) / (a[3] - a[1]), 6) AS actual_price,
        round((margin_percent - m[2]) / (m[3] - m[1]), 6) AS margin_percent,
        round((volume_units - v[2]) / (v[3] - v[1]), 6) AS volume_units
        FROM fact, (SELECT quantile_cont(actual_price, [0.25, 0.5, 0.75]) AS a,
          quantile_cont(margin_percent, [0.25, 0.5, 0.75]) AS m, quantile_cont(volume_units, [0.25, 0.5, 0.75]) AS v
          FROM fact)""",
    ceiling_340b="""SELECT txn_id, round(amp_price * (1.0 - 0.2302), 4) AS innovator,
        round(amp_price * (1.0 - 0.1302), 4) AS non_innovator FROM fact""",
    gtn_waterfall="\nUNION ALL ".join(
        f"SELECT drug_id, '{name}' AS step, round(avg({e}), 4) AS amount FROM fact GROUP BY drug_id"
        for name, e in (("wac", "wac_price"), ("chargebacks", "wac_price - amp_price"),
                        ("rebates", "amp_price - gtn_price"), ("net", "gtn_price"))),
    competitive_snapshot="""SELECT drug_class AS therapeutic_area, manufacturer AS competitor_brand,
        round(w, 4) AS competitor_wac, round(n / sum(n) OVER (PARTITION BY drug_class) * 100, 4) AS market_share_pct, d AS snapshot_date
        FROM (SELECT drug_class, manufacturer, avg(wac_price) AS w, count(*) AS n,
          strftime(max(transaction_date), '%Y-%m-%d') AS d FROM fact GROUP BY ALL)""",
    lof_drugs="""
      , points AS (SELECT drug_id, round(avg(actual_price), 4) AS a, round(avg(margin_percent), 4) AS m,
          round(avg(volume_units), 4) AS v FROM fact GROUP BY drug_id),
      q AS (SELECT quantile_cont(a, [0.25, 0.5, 0.75]) AS qa, quantile_cont(m, [0.25, 0.5, 0.75]) AS qm,
          quantile_cont(v, [0.25, 0.5, 0.75]) AS qv FROM points),
      scaled AS (SELECT drug_id, (a - qa[2]) / (qa[3] - qa[1]) AS x, (m - qm[2]) / (qm[3] - qm[1]) AS y,
          (v - qv[2]) / (qv[3] - qv[1]) AS z FROM points, q),
      pairs AS (SELECT l.drug_id AS id, r.drug_id AS other,
          sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) + (l.z - r.z) * (l.z - r.z)) AS d, r.x, r.y, r.z
          FROM scaled l JOIN scaled r ON l.drug_id <> r.drug_id),
      near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, x, y, z) AS r FROM pairs)
          WHERE r <= 20),
      kd AS (SELECT id, max(d) AS kdist FROM near GROUP BY id),
      lrd AS (SELECT n.id, 1 / (avg(greatest(d, kdist)) + 1e-10) AS lrd FROM near n JOIN kd ON n.other = kd.id
          GROUP BY n.id)
      SELECT n.id AS drug_id, round(avg(o.lrd) / any_value(s.lrd), 4) AS factor
      FROM near n JOIN lrd o ON n.other = o.id JOIN lrd s ON n.id = s.id GROUP BY n.id""",
)
ORACLES["lof_drugs"] = ORACLES["lof_drugs"].replace("\n\n      ,", ",", 1)

on(FACT, """
transactions AS (SELECT * FROM fact),
drugs AS (SELECT drug_id, min(drug_class) AS drug_class FROM fact GROUP BY drug_id),
pharmacies AS (SELECT pharmacy_id, min(state) AS state FROM fact GROUP BY pharmacy_id)""",
   adhoc_sql="""SELECT drug_class, state, n, round(avg_margin, 6) AS avg_margin FROM (
     SELECT d.drug_class, p.state, count(*) AS n, avg(t.margin_percent) AS avg_margin
     FROM transactions t JOIN drugs d USING (drug_id) JOIN pharmacies p USING (pharmacy_id)
     GROUP BY d.drug_class, p.state)""")

on(
    FACT, CATALOG,
    drug_catalog=f"SELECT drug_name, drug_class, manufacturer, drug_id, {rounded('wac_min wac_max wac_mean', 4)} FROM catalog",
    describe_wac="\nUNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
        round(min({c}), 4) AS low, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median,
        round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4) AS high FROM catalog"""
        for c in ("wac_min", "wac_max", "wac_mean")),
    class_counts="SELECT drug_class, count(*) AS n FROM catalog GROUP BY drug_class",
    manufacturer_counts="""SELECT manufacturer, count(*) AS n FROM catalog GROUP BY manufacturer
        ORDER BY n DESC, manufacturer LIMIT 10""",
    wac_histogram="""SELECT bin, round(lo + bin * w, 4) AS low, round(lo + (bin + 1) * w, 4) AS high, count(wac_mean) AS n FROM
        (SELECT bin, lo, w FROM (SELECT CAST(unnest(range(20)) AS INT) AS bin),
           (SELECT lo, (hi - lo) / 20 AS w FROM (SELECT min(wac_mean) AS lo, max(wac_mean) AS hi FROM catalog))) b
        LEFT JOIN catalog ON CAST(least(floor((wac_mean - lo) / w), 19) AS INT) = bin GROUP BY bin, lo, w""",
)

on(
    FACT, HISTORY,
    price_history=f"""SELECT ndc, period, brand_name,
        {rounded('wac_per_unit asp amp best_price net_price ceiling_340b gross_to_net_pct', 4)} FROM history""",
    extra_rules="""SELECT ndc, period, reason IS NOT NULL AS anomaly, reason AS anomaly_reason,
        CAST(reason IS NOT NULL AS DOUBLE) AS anomaly_score FROM (
          SELECT *, CASE WHEN best_price > amp THEN 'bp_exceeds_amp'
            WHEN ceiling_340b < 0 THEN 'negative_340b_ceiling' END AS reason FROM history)""",
    validate_price_history="""SELECT 'missing' AS check_name, unnest(['ndc', 'brand_name', 'period', 'wac_per_unit']) AS column_name,
          0 AS bad_rows
        UNION ALL SELECT 'negative', 'wac_per_unit', count(*) FILTER (wac_per_unit < 0) FROM history
        UNION ALL SELECT 'outside_0_1', 'gross_to_net_pct', count(*) FILTER (NOT gross_to_net_pct BETWEEN 0 AND 1) FROM history""",
)

on(FACT, ZSCORE, zscore="""SELECT txn_id, z_feature, round(z_max, 6) AS z_max,
    round(least(z_max / 9.0, 1.0), 6) AS anomaly_score FROM zed WHERE z_max > 3""")
on(FACT, IQR, iqr="""SELECT txn_id, iqr_feature, round(iqr_distance, 6) AS iqr_distance,
    round(least(iqr_distance / 10, 1.0), 6) AS anomaly_score FROM fenced""")
on(
    FACT, MOM,
    mom_change=f"SELECT txn_id, {rounded('previous_price price_change')} FROM moves",
    mom="SELECT txn_id, mom_type AS anomaly_type, round(mom_score, 6) AS anomaly_score FROM jumps",
)
on(
    FACT, RULES,
    rule_flags="SELECT * FROM ruled",
    regulatory="\nUNION ALL ".join(
        f"""SELECT txn_id, '{t}' AS anomaly_type, 'Regulatory Rules' AS detection_method,
        CAST(1 AS DOUBLE) AS anomaly_score FROM ruled WHERE is_{t}"""
        for t in ("wac_breach", "asp_wac_violation", "340b_ceiling_breach", "gtn_floor_breach", "margin_critical")),
)

on(
    FACT, ZSCORE, IQR, MOM, RULES, FLAGS, MERGED,
    flags_long="SELECT txn_id, t AS anomaly_type, round(score, 6) AS anomaly_score FROM flags",
    merge_flags="""SELECT txn_id, anomaly_type, detection_method, n_methods, round(anomaly_score, 6) AS anomaly_score,
        severity, recommended_action FROM res""",
    detect_sql=f"""SELECT txn_id, drug_id, drug_name, pharmacy_id, pharmacy_name, pharmacy_chain, state, drug_class, {DAY},
        {rounded('wac_price actual_price margin_percent gtn_price anomaly_score')}, anomaly_type, detection_method, severity,
        recommended_action FROM res""",
    annotate="""SELECT txn_id, anomaly_type IS NOT NULL AS anomaly, anomaly_type AS anomaly_reason,
        round(coalesce(anomaly_score, 0), 6) AS anomaly_score FROM ann""",
    detect_summary="""SELECT count(*) AS total_rows, count(anomaly_type) AS total_anomalies,
        round(count(anomaly_type) * 100.0 / count(*), 4) AS anomaly_rate_pct,
        (SELECT string_agg(anomaly_type || '=' || n, ',' ORDER BY anomaly_type) FROM (
          SELECT anomaly_type, count(*) AS n FROM res GROUP BY anomaly_type)) AS by_reason FROM ann""",
    explorer_filter=f"""SELECT txn_id, drug_name, drug_class, pharmacy_name, state, anomaly_type, severity,
        detection_method, round(anomaly_score, 6) AS anomaly_score, recommended_action, {DAY} FROM res
        WHERE severity IN ('high', 'medium') AND anomaly_type IN ('wac_breach', 'mom_spike', 'mom_drop')""",
    scatter_bounds="""SELECT count(*) AS points, round(greatest(max(wac_price), max(actual_price)), 6) AS axis_end
        FROM res""",
    pharmacy_risk="""SELECT pharmacy_id, pharmacy_name, pharmacy_chain, state, total_anomalies, high_severity_count,
          regulatory_breach_count, risk_score, CASE WHEN risk_score <= 25 THEN 'green' WHEN risk_score <= 60 THEN 'yellow'
          ELSE 'red' END AS risk_tier
        FROM (SELECT pharmacy_id, min(pharmacy_name) AS pharmacy_name, min(pharmacy_chain) AS pharmacy_chain,
            min(state) AS state, count(anomaly_type) AS total_anomalies,
            count(*) FILTER (severity = 'high') AS high_severity_count,
            count(*) FILTER (has_rule) AS regulatory_breach_count,
            round(least((15 * count(*) FILTER (severity = 'high') + 7 * count(*) FILTER (severity = 'medium')
              + 2 * count(*) FILTER (severity = 'low') + 25 * count(*) FILTER (has_rule)) / count(*) * 500, 100), 1)
              AS risk_score FROM ann GROUP BY pharmacy_id) WHERE total_anomalies > 0""",
    class_summary=f"""SELECT drug_class, round(count(anomaly_type) / count(*), 4) AS anomaly_rate,
        round(avg(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END), 4) AS avg_severity_score,
        any_value(top) AS most_common_violation,
        round(avg(least(greatest({PCT}, 0), 1)), 4) AS avg_gtn_discount_pct
        FROM ann JOIN (SELECT drug_class, first(anomaly_type ORDER BY n DESC, anomaly_type) AS top FROM (
          SELECT drug_class, anomaly_type, count(*) AS n FROM res GROUP BY ALL) GROUP BY drug_class) USING (drug_class)
        GROUP BY drug_class""",
    drug_report="""SELECT drug_id, drug_name, anomalies, low, medium, high, coalesce(types, '') AS top_violations, price_trend,
          CASE WHEN high > 0 AND ruled THEN 'regulatory_review' WHEN high > 0 THEN 'escalate'
            WHEN medium > 0 THEN 'investigate' ELSE 'monitor' END AS recommended_action
        FROM (SELECT drug_id, min(drug_name) AS drug_name, count(anomaly_type) AS anomalies,
            count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium,
            count(*) FILTER (severity = 'high') AS high, coalesce(bool_or(has_rule), false) AS ruled
          FROM ann GROUP BY drug_id)
        LEFT JOIN (SELECT drug_id, string_agg(anomaly_type, ',' ORDER BY n DESC, anomaly_type) AS types FROM (
          SELECT *, row_number() OVER (PARTITION BY drug_id ORDER BY n DESC, anomaly_type) AS r FROM (
            SELECT drug_id, anomaly_type, count(*) AS n FROM res GROUP BY ALL)) WHERE r <= 5 GROUP BY drug_id)
        USING (drug_id)
        LEFT JOIN (SELECT drug_id, string_agg(day || '=' || printf('%.2f', price), ',' ORDER BY day) AS price_trend FROM (
          SELECT drug_id, strftime(transaction_date, '%Y-%m-%d') AS day, round(actual_price, 2) AS price, transaction_date,
            max(transaction_date) OVER (PARTITION BY drug_id) AS newest, row_number() OVER (
            PARTITION BY drug_id, transaction_date ORDER BY txn_id DESC) AS r FROM fact)
          WHERE r = 1 AND transaction_date >= newest - INTERVAL 90 DAYS GROUP BY drug_id) USING (drug_id)""",
    kpis="""SELECT count(*) AS transactions, count(DISTINCT drug_id) AS drugs,
        count(DISTINCT pharmacy_id) AS pharmacies, round(avg(wac_price), 4) AS avg_wac,
        round(avg(margin_percent), 4) AS avg_margin, round(count(anomaly_type) * 100.0 / count(*), 4) AS anomaly_rate,
        count(*) FILTER (severity = 'high') AS high_severity FROM ann""",
    anomaly_history="""SELECT drug_id, txn_id, anomaly_type, severity, detection_method, round(anomaly_score, 6) AS anomaly_score
        FROM res""",
    filter_options="SELECT DISTINCT anomaly_type FROM res",
    severity_counts="SELECT severity, count(*) AS n FROM res GROUP BY severity",
    type_counts="SELECT anomaly_type, count(*) AS n FROM res GROUP BY anomaly_type",
    top_drugs="SELECT drug_name, count(*) AS n FROM res GROUP BY drug_name ORDER BY n DESC, drug_name LIMIT 10",
    method_coverage="SELECT method, count(*) AS n FROM labels GROUP BY method",
    anomaly_timeline=f"SELECT {MONTH} AS month, severity, count(*) AS n FROM res GROUP BY ALL",
    pharmacy_profile="""SELECT pharmacy_id, min(pharmacy_name) AS pharmacy_name, min(pharmacy_chain) AS pharmacy_chain,
        min(state) AS state, count(*) AS total_anomalies, count(*) FILTER (severity = 'high') AS high_severity_count,
        count(*) FILTER (contains(anomaly_type, 'breach') OR contains(anomaly_type, 'violation'))
          AS regulatory_breach_count, any_value(top) AS most_common_violation, any_value(drugs) AS top_drugs,
        CASE WHEN count(*) FILTER (severity = 'high') > 5 THEN 'red' WHEN count(*) FILTER (severity = 'high') > 2
          THEN 'yellow' ELSE 'green' END AS risk_tier
        FROM res JOIN (SELECT pharmacy_id, first(anomaly_type ORDER BY n DESC, anomaly_type) AS top FROM (
          SELECT pharmacy_id, anomaly_type, count(*) AS n FROM res GROUP BY ALL) GROUP BY pharmacy_id)
          USING (pharmacy_id)
        JOIN (SELECT pharmacy_id, string_agg(drug_name, ',' ORDER BY r) AS drugs FROM (
          SELECT *, row_number() OVER (PARTITION BY pharmacy_id ORDER BY n DESC, drug_name) AS r FROM (
            SELECT pharmacy_id, drug_name, count(*) AS n FROM res GROUP BY ALL)) WHERE r <= 3 GROUP BY pharmacy_id)
          USING (pharmacy_id)
        GROUP BY pharmacy_id""",
    label_overlap="""SELECT is_anomaly AS labelled, anomaly_type IS NOT NULL AS found, count(*) AS n FROM ann
        GROUP BY ALL""",
    suggest_action=f"""SELECT drug_id, anomaly_type, count(*) AS findings,
        CASE min(rank) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS worst_severity,
        CASE WHEN anomaly_type = 'margin_critical' THEN 'team-b' WHEN anomaly_type IN ('wac_breach', 'asp_wac_violation',
          '340b_ceiling_breach', 'gtn_floor_breach') THEN 'team-a' ELSE 'queue' END AS action
        FROM ranks GROUP BY drug_id, anomaly_type""",
    anomaly_top5=f"""SELECT drug_id, r AS place, txn_id, drug_name, anomaly_type, severity,
        {rounded('anomaly_score wac_price actual_price margin_percent')}, recommended_action, {DAY}
        FROM (SELECT *, row_number() OVER (PARTITION BY drug_id ORDER BY rank, anomaly_score DESC, txn_id) AS r
          FROM ranks) WHERE r <= 5""",
)

on(
    CHUNKS,
    chunk_docs="""SELECT doc_id, chunk_index, substring(sha256(doc_id || '-' || chunk_index), 1, 12) AS chunk_id,
        text, source AS topic FROM chunks""",
    context_pack="""SELECT doc_id, count(*) AS passages, CAST(sum(length(body)) AS BIGINT) AS body_chars,
          string_agg('[' || source || ' — ' || lang || ']' || chr(10) || body, chr(10) || chr(10) || '---' || chr(10)
            || chr(10) ORDER BY chunk_index) AS context
        FROM (SELECT *, substring(text, 1, CAST(6000 - used AS INT)) AS body FROM (
          SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY chunk_index
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM chunks) WHERE used < 6000)
        GROUP BY doc_id""",
)

on(vector_topk="""
    WITH parts AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    means AS (SELECT label, list(m ORDER BY i) AS q FROM (
      SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM parts GROUP BY label, i) GROUP BY label),
    scored AS (SELECT means.label AS query_id, vec_id AS id,
      list_inner_product(CAST(embedding AS DOUBLE[]), q) AS s FROM embeddings, means)
    SELECT query_id, id, place, round(s, 6) AS similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS place FROM scored) WHERE place <= 4""")

on(
    conversation_summary="""SELECT conv_id, count(*) FILTER (role = 'user') AS total_turns,
        coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS last_user_message,
        coalesce(substring(arg_max(text, turn) FILTER (role = 'assistant'), 1, 100), '') AS last_assistant_preview
        FROM conversations GROUP BY conv_id""",
    history_tail="""SELECT conv_id, turn, role, text FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6""",
)

# The same answers by the routes that only large tables take.
for _name, _like in (("lof_drugs_leaves", "lof_drugs"), ("mom_hot", "mom"), ("zscore_rolling_hot", "zscore_rolling"),
                     ("vector_topk_cells", "vector_topk"), ("vector_topk_pruned", "vector_topk")):
    ORACLES[_name] = ORACLES[_like]
for _name in ("kpis", "anomaly_timeline", "gtn_quarter"):
    ORACLES[f"{_name}_stored"] = ORACLES[_name]
ORACLES["wac_trend_stored"] = ORACLES["wac_trend_top8"]
ORACLES["detect_sql_stored"] = ORACLES["detect_sql"]
