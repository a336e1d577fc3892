"""Equivalent SQL for every registered query, in the dialect of DuckDB."""

from __future__ import annotations

# Common table expressions shared by the statements; each statement gets those it names.
BASE = {
    "nat": """SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "mon": """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) d, c_nationkey nk, count(*) c,
        count(*) FILTER (o_orderstatus = 'F') f
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "panel": """SELECT d, n_name county, r_name state,
        lpad(CAST(n_regionkey + 1 AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') fips_code,
        CAST(sum(c) OVER w AS BIGINT) cases, CAST(sum(f) OVER w AS BIGINT) deaths, n_regionkey + 1 fs, n_nationkey fc
        FROM mon JOIN nat ON nk = n_nationkey WINDOW w AS (PARTITION BY nk ORDER BY d)""",
    "us": """SELECT d AS "Date", lower(county) AS "County", lower(state) AS "State", fips_code,
        cases AS "Confirmed_Cases", deaths AS "Deaths",
        CAST(cases - lag(cases, 1, 0) OVER (PARTITION BY fips_code ORDER BY d) AS BIGINT) AS "Growth_Rate",
        CAST(fs AS INTEGER) AS fips_state, CAST(fc AS INTEGER) AS fips_county FROM panel""",
    "world0": """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) d, r_name, count(*) cases,
        count(*) FILTER (o_orderstatus = 'F') deaths
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nat ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    "world": """SELECT d AS "Date", cases AS "Cases", deaths AS "Deaths", lower(r_name) AS "Country",
        substr(r_name, 1, 2) AS "Geo_id", substr(r_name, 1, 3) AS "Terr_code",
        coalesce(max(cases) OVER (PARTITION BY substr(r_name, 1, 3) ORDER BY d
            ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING), cases) AS "Max_Peak",
        row_number() OVER (PARTITION BY substr(r_name, 1, 3) ORDER BY d) - 1 AS pos FROM world0""",
    "dens": """SELECT CAST(land AS BIGINT) amount_land, lower(r_name) AS "State", lower(n_name) AS "County",
        CAST(pop AS BIGINT) AS "Population", pop * 10000.0 / land AS "Population_Density"
        FROM (SELECT c_nationkey nk, count(*) pop FROM customer GROUP BY 1)
        JOIN (SELECT s_nationkey nk, sum(s_suppkey + 1) land FROM supplier GROUP BY 1) USING (nk)
        JOIN nat ON nk = n_nationkey""",
    "mob0": """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) d, n_regionkey + 1 fs, n_nationkey fc,
        sum(CAST(l_quantity AS BIGINT)) dev, sum(l_linenumber) dist,
        sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) home,
        sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) fullw,
        sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) partw
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nat ON s_nationkey = n_nationkey GROUP BY 1, 2, 3""",
    "sd": """SELECT dens."State", dens."County", CAST(fs AS INTEGER) fips_state, CAST(fc AS INTEGER) fips_county,
        d AS "Date", CAST(home AS BIGINT) completely_home_device_count, CAST(dev AS BIGINT) device_count,
        CAST(dist AS BIGINT) distance_traveled_from_home, CAST(fullw AS BIGINT) full_time_work_behavior_devices,
        CAST(partw AS BIGINT) part_time_work_behavior_devices,
        home / nullif(dev, 0) * 100 percent_at_home, fullw / nullif(dev, 0) * 100 percent_full_time_work,
        partw / nullif(dev, 0) * 100 percent_part_time_work, "Population", "Population_Density",
        home / nullif(dev, 0) * 100 * "Population_Density" AS "Social_Dist_Factor_Home",
        fullw / nullif(dev, 0) * 100 * "Population_Density" AS "Social_Dist_Factor_Full_Work",
        partw / nullif(dev, 0) * 100 * "Population_Density" AS "Social_Dist_Factor_Part_Work"
        FROM mob0 JOIN nat ON fc = n_nationkey AND fs = n_regionkey + 1
        JOIN dens ON lower(n_name) = dens."County" AND lower(r_name) = dens."State" """,
    "clim": """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS "Date", lower(r_name) AS "State",
        sum(CAST(round(l_tax * 100) AS BIGINT)) / count(*) AS "Precipitation",
        sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*) AS "windSpeed",
        sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / count(*) / 100000 AS "temperatureHigh",
        sum(CAST(l_quantity AS BIGINT)) / count(*) AS "temperatureLow",
        "temperatureHigh" + "temperatureLow" / 2 AS "Avg_Temp"
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nat ON s_nationkey = n_nationkey
        WHERE l_linestatus = 'F' GROUP BY 1, 2""",
    "state_sums": """SELECT "Date", "State", CAST(sum("Growth_Rate") AS BIGINT) growth_rate,
        CAST(sum("Confirmed_Cases") AS BIGINT) confirmed_cases, CAST(sum("Deaths") AS BIGINT) deaths
        FROM us GROUP BY 1, 2 HAVING sum("Growth_Rate") <> 0""",
    "port": """SELECT n_nationkey nk, 'A' || n_nationkey ident, n_name, r_name, lower(r_name) country,
        CASE WHEN r_name = 'AMERICA' THEN 'US' ELSE substr(r_name, 1, 2) END iso,
        CAST(n_nationkey * 1.5 AS DOUBLE) lat, CAST(n_nationkey * -2.5 AS DOUBLE) lon FROM nat""",
    "air": """SELECT t.iso destination_iso_country, o.iso origin_iso_country, o.ident origin, t.ident destination,
        CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
        'large_airport' origin_type, o.n_name origin_airport_name, o.lat origin_latitude_deg,
        o.lon origin_longitude_deg, o.iso || '-' || lpad(CAST(o.nk AS VARCHAR), 2, '0') origin_region,
        o.country origin_country, 'large_airport' destination_type, t.n_name destination_airport_name,
        t.lat destination_latitude_deg, t.lon destination_longitude_deg,
        t.iso || '-' || lpad(CAST(t.nk AS VARCHAR), 2, '0') destination_region, t.country destination_country
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN port o ON s_nationkey = o.nk JOIN port t ON c_nationkey = t.nk""",
    "daily": """SELECT o_orderpriority k, CAST(o_orderdate AS DATE) d, count(*) v FROM orders GROUP BY 1, 2""",
    "monthly": """SELECT o_orderpriority k, CAST(date_trunc('month', o_orderdate) AS DATE) d,
        sum(o_totalprice) price, count(*) orders FROM orders GROUP BY 1, 2""",
}

# Which expressions each one builds on.
NEEDS = {
    "mon": (), "nat": (), "panel": ("nat", "mon"), "us": ("panel",), "world0": ("nat",), "world": ("world0",),
    "dens": ("nat",), "mob0": ("nat",), "sd": ("mob0", "dens", "nat"), "clim": ("nat",), "state_sums": ("us",),
    "port": ("nat",), "air": ("port",), "daily": (), "monthly": (),
}


def with_base(names: str, body: str) -> str:
    """Prefix ``body`` with the named expressions and all they need, in order of dependence."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS[name]:
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    head = ", ".join(f"{n} AS ({BASE[n]})" for n in wanted)
    return f"WITH {head} {body}" if wanted else body


def lagged_rows(max_lag: int) -> str:
    """Named window columns y0..yM, x0..xM over ``series(g, o, x, y)``."""
    columns = ", ".join(f"lag(z{c}, {k}) OVER w {c}{k}" for c in "yx" for k in range(1, max_lag + 1))
    return f"SELECT g, zy y0, {columns}, row_number() OVER w rn FROM scored WINDOW w AS (PARTITION BY g ORDER BY o)"


def granger_ctes(source: str, lags: range, dof_mode: str = "reference") -> str:
    """Test of every lag in SQL: ``tested(g, lag, n, f, p)`` from ``source`` giving (g, o, x, y).

    Gaussian elimination on the cross products, one variable per step of a recursive query:
    after the constant and the y lags the last entry is the restricted residual sum, at the
    end the full one. p comes from Simpson's rule on the F density in the angle atan(sqrt(d1 f / d2)),
    over at most 12 / sqrt(d2), beyond which the density is below exp(-72) of its peak.
    """
    top = max(lags)
    vectors = " UNION ALL ".join(
        f"SELECT g, {L} lag, [1.0, {', '.join(f'y{k}' for k in range(1, L + 1))}, "
        f"{', '.join(f'x{k}' for k in range(1, L + 1))}, y0] v FROM lagged WHERE rn > {L}" for L in lags)
    extra = 0 if dof_mode == "reference" else 1
    return f"""
    series AS ({source}),
    scored AS (SELECT g, o, (x - avg(x) OVER p) / nullif(stddev_samp(x) OVER p, 0) zx,
        (y - avg(y) OVER p) / nullif(stddev_samp(y) OVER p, 0) zy FROM series WINDOW p AS (PARTITION BY g)),
    lagged AS ({lagged_rows(top)}),
    vectors AS ({vectors}),
    sizes AS (SELECT g, lag, count(*) n FROM vectors GROUP BY 1, 2),
    gram AS (SELECT g, lag, i, j, sum(v[i] * v[j]) a
        FROM (SELECT g, lag, v, i, unnest(range(1, len(v) + 1)) j
              FROM (SELECT g, lag, v, unnest(range(1, len(v) + 1)) i FROM vectors JOIN sizes USING (g, lag)
                    WHERE n >= 2 * lag + 2)) GROUP BY 1, 2, 3, 4),
    steps AS (SELECT g, lag, 0 k, i, j, a FROM gram
        UNION ALL
        SELECT s.g, s.lag, s.k + 1, s.i, s.j, s.a - c.a * r.a / p.a
        FROM steps s JOIN steps p ON p.g = s.g AND p.lag = s.lag AND p.i = s.k + 1 AND p.j = s.k + 1
        JOIN steps c ON c.g = s.g AND c.lag = s.lag AND c.i = s.i AND c.j = s.k + 1
        JOIN steps r ON r.g = s.g AND r.lag = s.lag AND r.i = s.k + 1 AND r.j = s.j
        WHERE s.k < 2 * s.lag + 1 AND s.i > s.k + 1 AND s.j > s.k + 1),
    rss AS (SELECT g, lag, max(a) FILTER (k = lag + 1) r0, max(a) FILTER (k = 2 * lag + 1) r1
        FROM steps WHERE i = 2 * lag + 2 AND j = 2 * lag + 2 AND k IN (lag + 1, 2 * lag + 1) GROUP BY 1, 2),
    stat AS (SELECT g, lag, n, ((r0 - r1) / lag) / (r1 / (n - 2 * lag - {extra})) f, n - 2 * lag - 1 d2
        FROM rss JOIN sizes USING (g, lag)),
    angle AS (SELECT g, lag, n, f, d2, atan(sqrt(lag * f / d2)) th FROM stat),
    simpson AS (SELECT g, lag, n, f, d2, th, least(pi() / 2 - th, 12 / sqrt(d2)) width, unnest(range(0, 2001)) i
        FROM angle),
    tested AS (SELECT g, lag, n, any_value(f) f,
        sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
            * power(sin(th + width * i / 2000.0), lag - 1)
            * power(greatest(cos(th + width * i / 2000.0), 0), d2 - 1))
        * any_value(width / 2000.0) / 3 * 2
        * exp(lgamma(any_value(lag + d2) / 2.0) - lgamma(any_value(d2) / 2.0) - lgamma(any_value(lag) / 2.0)) p
        FROM simpson GROUP BY 1, 2, 3)"""


def granger(names: str, source: str, lags: range, select: str, dof_mode: str = "reference") -> str:
    body = granger_ctes(source, lags, dof_mode)
    head = with_base(names, "")
    return ("WITH RECURSIVE " + (head.removeprefix("WITH ").rstrip() + ", " if names else "") + body.strip()
            + " " + select)


ALL_LAGS = range(1, 15)
MONTHLY_SERIES = "SELECT k g, d o, price x, CAST(orders AS DOUBLE) y FROM monthly"
BEST = """best AS (SELECT * FROM tested WHERE p < 1
    QUALIFY row_number() OVER (PARTITION BY g ORDER BY p, lag) = 1)"""
SCAN = f""", {BEST} SELECT k, CAST(lag AS INTEGER) lag, CAST(n AS BIGINT) n, round(coalesce(f, 1), 6) f,
    round(coalesce(p, 1), 6) p FROM (SELECT DISTINCT k FROM monthly) LEFT JOIN best ON k = g"""
CLIMATE_PANEL = """SELECT s.*, c."Avg_Temp" FROM state_sums s JOIN clim c USING ("Date", "State")"""
DRIVERS = ("Home", "Full_Work", "Part_Work")
MOBILITY_SERIES = " UNION ALL ".join(
    f"""SELECT fips_code || '|{x}' g, "Date" o, "Social_Dist_Factor_{x}" x, CAST("Growth_Rate" AS DOUBLE) y
    FROM us JOIN sd USING ("Date", fips_state, fips_county)""" for x in DRIVERS)
MOBILITY_WIDE = f""", {BEST}, tall AS (SELECT split_part(s.g, '|', 1) fips_code, split_part(s.g, '|', 2) x,
    coalesce(f, 1) f, coalesce(p, 1) p FROM (SELECT DISTINCT g FROM series) s LEFT JOIN best ON s.g = best.g)
    SELECT fips_code, """ + ", ".join(
    f"""round(max(f) FILTER (x = '{x}'), 6) AS "Causation_Social_Dist_Factor_{x}_norm_F",
    round(max(p) FILTER (x = '{x}'), 6) AS "Causation_Social_Dist_Factor_{x}_norm_p" """
    for x in DRIVERS) + " FROM tall GROUP BY 1"

EVENT_WINDOW = "WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)"
EVENT_PEAK = f"""SELECT event_type, event_id, value, coalesce(max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
    ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING), value) peak, row_number() OVER w - 1 rn FROM events {EVENT_WINDOW}"""


def distinct_row(table: str, column: str, expression: str | None = None) -> str:
    c = expression or f'"{column}"'
    return f"""SELECT '{column}' AS "column", CAST(count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INT) AS BIGINT) AS "distinct"
    FROM {table}"""


def describe_row(table: str, column: str) -> str:
    c = f'CAST("{column}" AS DOUBLE)'
    return f"""SELECT '{column}' AS "column", count({c}) AS "count", round(avg({c}), 6) AS mean,
    round(stddev_samp({c}), 6) AS stddev, round(min({c}), 6) AS "min", round(max({c}), 6) AS "max" FROM {table}"""


def profile_row(dataset: str, table: str, column: str, type_: str) -> str:
    c = f'"{column}"'
    if type_ in ("int", "bigint", "double"):
        d = f"CAST({c} AS DOUBLE)"
        numbers = (f'count({c}) AS "count", round(avg({d}), 6) AS mean, round(stddev_samp({d}), 6) AS stddev, '
                   f'round(min({d}), 6) AS "min", round(max({d}), 6) AS "max"')
    else:
        numbers = ('CAST(NULL AS BIGINT) AS "count", CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS stddev, '
                   'CAST(NULL AS DOUBLE) AS "min", CAST(NULL AS DOUBLE) AS "max"')
    return f"""SELECT '{dataset}' AS dataset, '{column}' AS "column", '{type_}' AS type,
    CAST(count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INT) AS BIGINT) AS "distinct", {numbers} FROM {table}"""


PROFILED = (
    ("cases", "us", (("Date", "date"), ("County", "string"), ("State", "string"), ("fips_code", "string"),
                     ("Confirmed_Cases", "bigint"), ("Deaths", "bigint"), ("Growth_Rate", "bigint"),
                     ("fips_state", "int"), ("fips_county", "int"))),
    ("climate", "clim", (("Date", "date"), ("State", "string"), ("Precipitation", "double"), ("windSpeed", "double"),
                         ("temperatureHigh", "double"), ("temperatureLow", "double"), ("Avg_Temp", "double"))),
    ("orders", "orders", (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                          ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
                          ("o_orderpriority", "string"))),
)

ROUND_SD = ", ".join(f'round("{c}", 6) AS "{c}"' for c in (
    "percent_at_home", "percent_full_time_work", "percent_part_time_work", "Population_Density",
    "Social_Dist_Factor_Home", "Social_Dist_Factor_Full_Work", "Social_Dist_Factor_Part_Work"))

ORACLE: dict[str, str] = {
    "drop_nulls": "SELECT event_id, event_type AS et FROM events WHERE event_type <> 'error'",
    "filter_col_ne_col": """SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE left(o_orderpriority, 1) <> CAST(c_nationkey AS VARCHAR)""",
    "correct_labels": """SELECT c_custkey, CASE WHEN contains(l, ' county') THEN substr(l, 1, length(l) - 7)
        WHEN contains(l, ' borough') THEN substr(l, 1, length(l) - 8) ELSE l END label
        FROM (SELECT c_custkey, lower(c_name || CASE c_custkey % 4 WHEN 0 THEN ' County' WHEN 1 THEN ' Borough'
        WHEN 2 THEN ' City and Borough' ELSE ' Parish' END) l FROM customer)""",
    "split_codes": """SELECT c_custkey, TRY_CAST(substr(a, 1, 2) AS INT) st12, TRY_CAST(substr(a, 3, 3) AS INT) co12,
        TRY_CAST(left(f, greatest(length(f) - 3, 0)) AS INT) st5, TRY_CAST(right(f, 3) AS INT) co5
        FROM (SELECT c_custkey, lpad(CAST((c_custkey * 70000019) % 1000000000000 AS VARCHAR), 12, '0') a,
        CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN 'NYC'
        ELSE CAST(c_custkey * 37 AS VARCHAR) END f FROM customer)""",
    "parsed_dates": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE)
        WHEN day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) END d1,
        CAST(o_orderdate AS DATE) d2 FROM orders""",
    "array_split": """SELECT p_partkey, string_split(p_name, ' ')[1] w1, string_split(p_name, ' ')[2] w2,
        len(string_split(p_name, ' ')) n FROM part""",
    "growth": with_base("us", """SELECT fips_code, "Date" AS d, "Confirmed_Cases" AS cases, "Growth_Rate" AS growth
        FROM us"""),
    "event_growth": f"""SELECT event_type, event_id, round(value - lag(value, 1, 0) OVER w, 6) + 0.0 growth
        FROM events {EVENT_WINDOW}""",
    "next_peak_chunk": with_base("daily", """SELECT k, d, v, peak FROM (SELECT *, row_number() OVER w - 1 rn,
        coalesce(max(v) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING), v) peak
        FROM daily WINDOW w AS (PARTITION BY k ORDER BY d)) WHERE rn % 15 = 0"""),
    "next_peak_sliding": with_base("daily", """SELECT k, d, v, coalesce(max(v) OVER (PARTITION BY k ORDER BY d
        ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING), v) peak FROM daily"""),
    "event_peak_chunk": f"SELECT event_type, event_id, value, peak FROM ({EVENT_PEAK}) WHERE rn % 15 = 0",
    "event_peak_sliding": f"SELECT event_type, event_id, value, peak FROM ({EVENT_PEAK})",
    "event_peak_wide": """SELECT event_type, event_id, value, coalesce(max(value) OVER (PARTITION BY event_type
        ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 365 FOLLOWING), value) peak FROM events""",
    "lag_features": with_base("daily", """SELECT k, d, v, l1, l2, l3 FROM (SELECT *, lag(v, 1) OVER w l1,
        lag(v, 2) OVER w l2, lag(v, 3) OVER w l3, row_number() OVER w rn
        FROM daily WINDOW w AS (PARTITION BY k ORDER BY d)) WHERE rn > 3"""),
    "event_lags": f"""SELECT event_type, event_id, user_id, value, value_lag1, value_lag2, user_id_lag1, user_id_lag2
        FROM (SELECT *, lag(value, 1) OVER w value_lag1, lag(value, 2) OVER w value_lag2,
        lag(user_id, 1) OVER w user_id_lag1, lag(user_id, 2) OVER w user_id_lag2, row_number() OVER w rn
        FROM events {EVENT_WINDOW}) WHERE rn > 2""",
    "collect_series": with_base("us", """SELECT fips_code, CAST(0 AS BIGINT) segment,
        string_agg(CAST("Growth_Rate" AS VARCHAR), ',' ORDER BY "Date") series, count(*) n FROM us GROUP BY 1"""),
    "event_series": f"""SELECT event_type, CAST(rn // 300 AS BIGINT) segment,
        string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) series, count(*) n
        FROM (SELECT *, row_number() OVER w - 1 rn FROM events {EVENT_WINDOW}) GROUP BY 1, 2""",
    "minmax_normalize": """SELECT o_orderkey, round((o_totalprice - mn) / nullif(mx - mn, 0) * 1000, 6) o_totalprice_norm,
        round((o_custkey - cn) / nullif(CAST(cx - cn AS DOUBLE), 0) * 1000, 6) o_custkey_norm
        FROM orders, (SELECT min(o_totalprice) mn, max(o_totalprice) mx, min(o_custkey) cn, max(o_custkey) cx
        FROM orders)""",
    "density": with_base("dens", """SELECT * REPLACE (round("Population_Density", 6) AS "Population_Density")
        FROM dens"""),
    "us_cases": with_base("us", "SELECT * FROM us"),
    "global_cases": with_base("world", "SELECT * EXCLUDE (pos) FROM world WHERE pos % 15 = 0"),
    "global_cases_sliding": with_base("world", "SELECT * EXCLUDE (pos) FROM world"),
    "mobility_factor": with_base("sd", f"SELECT * REPLACE ({ROUND_SD}) FROM sd"),
    "weather_feature": with_base("clim", """SELECT * EXCLUDE ("Avg_Temp"), "Avg_Temp" AS avg_ref,
        ("temperatureHigh" + "temperatureLow") / 2 AS avg_mean FROM clim"""),
    "air_traffic": with_base("air", "SELECT * FROM air"),
    "flights_two_role": with_base("air", """SELECT date AS d, origin_airport_name origin_name, origin_country,
        destination_airport_name destination_name, destination_country, count(*) n FROM air GROUP BY ALL"""),
    "inbound_with_cases": with_base("world air", """SELECT world.* EXCLUDE (pos),
        air.* EXCLUDE (date) REPLACE (substr(destination_region, 4, 2) AS destination_region)
        FROM world JOIN air ON world."Date" = air.date AND origin_country = "Country"
        WHERE pos % 15 = 0 AND destination_iso_country = 'US'"""),
    "cases_by_region_nonzero": with_base("state_sums", "SELECT * FROM state_sums"),
    "cases_x_mobility": with_base("us sd", """SELECT "Date", fips_code, "Growth_Rate",
        round(percent_at_home, 6) percent_at_home, round("Social_Dist_Factor_Home", 6) AS "Social_Dist_Factor_Home"
        FROM us JOIN sd USING ("Date", fips_state, fips_county)"""),
    "normalized_panel": with_base("us sd", """, j AS (SELECT * FROM us JOIN sd USING ("Date", fips_state, fips_county))
        SELECT "Date", fips_code, """ + ", ".join(
        f'round(("{c}" - min("{c}") OVER ()) / nullif(CAST(max("{c}") OVER () - min("{c}") OVER () AS DOUBLE), 0)'
        f' * 1000, 6) AS "{c}_norm"' for c in (
            "Growth_Rate", "Social_Dist_Factor_Home", "Social_Dist_Factor_Full_Work",
            "Social_Dist_Factor_Part_Work")) + " FROM j"),
    "cases_x_climate": with_base("state_sums clim", CLIMATE_PANEL),
    "profile_distinct": " UNION ALL ".join([
        distinct_row("events", "event_id"), distinct_row("events", "ts"), distinct_row("events", "user_id"),
        distinct_row("events", "event_type", "nullif(event_type, 'error')"), distinct_row("events", "value"),
        distinct_row("events", "props")]),
    "profile_describe": " UNION ALL ".join(describe_row("events", c) for c in ("event_id", "user_id", "value")),
    "profile": with_base("us clim", " UNION ALL ".join(
        profile_row(dataset, table, column, type_)
        for dataset, table, columns in PROFILED for column, type_ in columns)),
    "unmatched_keys": "SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents) ANTI JOIN labels USING (doc_id)",
    "unmatched_labels": """SELECT DISTINCT name FROM (SELECT 'brand#' || (CAST(substr(source, 4, 9) AS INTEGER) + 16) name FROM documents)
        WHERE name NOT IN (SELECT lower(p_brand) FROM part)""",
    "unmatched_sample": """SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents) ANTI JOIN labels USING (doc_id)
        ORDER BY doc_id LIMIT 10""",
    "f_tail_closed_form": """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_suppkey + 1 AS DOUBLE) d2,
        round(l_quantity / 10, 6) f, round(power(1 + 2 * (l_quantity / 10) / (l_suppkey + 1), -(l_suppkey + 1) / 2), 6) p
        FROM lineitem""",
    "granger_lag1": """SELECT g k, CAST(any_value(n) AS BIGINT) n, round(any_value(f), 6) f,
        round(sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
            * power(greatest(cos(th + (pi() / 2 - th) * i / 2000.0), 0), d2 - 1))
        * any_value((pi() / 2 - th) / 2000.0) / 3 * 2
        * exp(lgamma((any_value(d2) + 1) / 2.0) - lgamma(any_value(d2) / 2.0)) / sqrt(pi()), 6) p
        FROM (SELECT g, n, f, d2, atan(sqrt(f / d2)) th, i FROM (SELECT g, n, (r2 - ry * ry) / ((1 - r2) / (n - 2)) f, n - 3 d2
        FROM (SELECT *, (ry * ry + rx * rx - 2 * ry * rx * rxy) / (1 - rxy * rxy) r2
        FROM (SELECT g, count(*) n, corr(y, y1) ry, corr(y, x1) rx, corr(x1, y1) rxy
        FROM (SELECT *, lag(x) OVER w x1, lag(y) OVER w y1
        FROM (SELECT o_orderpriority g, CAST(date_trunc('month', o_orderdate) AS DATE) m, sum(o_totalprice) x,
            CAST(count(*) AS DOUBLE) y FROM orders GROUP BY 1, 2) WINDOW w AS (PARTITION BY g ORDER BY m))
        WHERE y1 IS NOT NULL GROUP BY g))), range(0, 2001) t(i)) GROUP BY g""",
    "granger_all_lags": granger("monthly", MONTHLY_SERIES, ALL_LAGS, """SELECT g k, CAST(lag AS INTEGER) lag,
        CAST(n AS BIGINT) n, round(f, 6) f, round(p, 6) p FROM tested"""),
    "granger_scan": granger("monthly", MONTHLY_SERIES, ALL_LAGS, SCAN),
    "granger_scan_standard": granger("monthly", MONTHLY_SERIES, ALL_LAGS, SCAN, "standard"),
    "granger_panel": granger("us sd", MOBILITY_SERIES, ALL_LAGS, MOBILITY_WIDE),
    "granger_pooled": granger("state_sums clim", f"""SELECT 1 g, row_number() OVER (ORDER BY "State", "Date") o,
        "Avg_Temp" x, CAST(growth_rate AS DOUBLE) y FROM ({CLIMATE_PANEL})""", ALL_LAGS, """SELECT CAST(lag AS INTEGER) lag,
        CAST(n AS BIGINT) n, round(f, 6) f, round(p, 6) p FROM tested"""),
    "granger_by_state": granger("state_sums clim", f"""SELECT "State" g, "Date" o, "Avg_Temp" x,
        CAST(growth_rate AS DOUBLE) y FROM ({CLIMATE_PANEL})""", ALL_LAGS, f""", {BEST} SELECT s.g AS "State",
        CAST(lag AS INTEGER) lag, CAST(n AS BIGINT) n, round(coalesce(f, 1), 6) f, round(coalesce(p, 1), 6) p
        FROM (SELECT DISTINCT g FROM series) s LEFT JOIN best ON s.g = best.g"""),
    "granger_events": granger("", """SELECT event_type g, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) o,
        CAST(user_id AS DOUBLE) x, value y FROM events""", range(1, 4), """SELECT g event_type, CAST(lag AS INTEGER) lag,
        CAST(n AS BIGINT) n, round(f, 6) f, round(p, 6) p FROM tested"""),
}

# On running totals, with the difference of y as target: same residuals, and sums that keep their digits.
ORACLE["granger_totals"] = (
    ORACLE["granger_lag1"].replace("corr(y, y1)", "corr(y - y1, y1)").replace("corr(y, x1)", "corr(y - y1, x1)")
    .replace("FROM (SELECT o_orderpriority g, ", "FROM (SELECT g, m, sum(x) OVER s x, sum(y) OVER s y FROM (SELECT o_orderpriority g, ")
    .replace("y FROM orders GROUP BY 1, 2)", "y FROM orders GROUP BY 1, 2) WINDOW s AS (PARTITION BY g ORDER BY m))"))
ORACLE |= {
    "csv_header": "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders",
    "csv_quoted_tree": "SELECT event_id, user_id, value, props FROM events",
    "csv_positional": "SELECT c_custkey k, c_name AS name, CAST(c_nationkey AS INTEGER) nation FROM customer",
    "saved_table": """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) d, count(*) orders, o_orderpriority k
        FROM orders GROUP BY ALL""",
    "saved_files": "SELECT o_orderpriority k, CAST(o_orderdate AS DATE) d, count(*) v FROM orders GROUP BY ALL",
    "csv_density": ORACLE["density"],
    "csv_us_cases": ORACLE["us_cases"],
    "csv_global_cases": ORACLE["global_cases"],
    "csv_mobility_factor": ORACLE["mobility_factor"],
    "csv_air_traffic": ORACLE["air_traffic"],
    "csv_climate": with_base("clim", "SELECT * FROM clim"),
    "csv_climate_causality": ORACLE["granger_pooled"],
    "saved_panel_causality": ORACLE["granger_panel"],
    "run_all_causality": ORACLE["granger_panel"],
    "run_all_flights": ORACLE["inbound_with_cases"],
}
