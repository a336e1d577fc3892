"""The whole run on small CSV files, checked against plain Python."""

import math
import random
from datetime import date, timedelta

import pytest

from seriesloom.plans import analysis, ingest
from seriesloom.plans.run import load_tables, run_all
from test_causality import least_squares

FIRST = date(2020, 3, 1)
DAYS = 60
# code, county, state, population, land
PLACES = [("39001", "Adams", "Ohio", 5000, 2_500_000), ("39003", "Allen", "Ohio", 8000, 1_000_000),
          ("36001", "Albany", "New York", 20000, 4_000_000)]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("csv")
    rnd = random.Random(4)
    days = [FIRST + timedelta(days=i) for i in range(DAYS)]
    facts = {"cases": {}, "devices": {}, "weather": {}, "flights": []}

    def put(name, lines):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(lines) + "\n")
        return str(path)

    lines = []
    for code, county, state, _, _ in PLACES:
        total = 0
        for d in days:
            total += rnd.randint(0, 9)
            facts["cases"][(code, d)] = total
            lines.append(f"{d:%m/%d/%Y},{county},{state},{code},{total},{total // 10}")
    # two places without a code form one series
    lines += [f"{FIRST:%m/%d/%Y},Unknown,Ohio,,5,0", f"{FIRST:%m/%d/%Y},Unknown,New York,,7,0"]
    rnd.shuffle(lines)
    paths = {"covid_cases_us": put("us.csv", lines)}

    lines = []
    for i, d in enumerate(days):
        lines.append(f"{d:%m/%d/%Y},{d.day},{d.month},{d.year},{i * 3 % 17},1,Italy,IT,ITA")
        lines.append(f"{d:%m/%d/%Y},{d.day},{d.month},{d.year},{i * 5 % 13},2,Spain,ES,ESP")
    rnd.shuffle(lines)
    paths["covid_cases_global"] = put("global.csv", lines)

    head = ("origin_census_block_group,date_range_start,date_range_end,device_count,distance_traveled_from_home,"
            "completely_home_device_count,full_time_work_behavior_devices,part_time_work_behavior_devices,"
            "at_home_by_each_hour")
    for i, d in enumerate(days):
        lines = [head]
        for code, *_ in PLACES:
            sums = [0, 0, 0, 0, 0]
            for block in (1, 2):
                n = [rnd.randint(100, 200), rnd.randint(1, 50), rnd.randint(0, 90), rnd.randint(0, 50), rnd.randint(0, 30)]
                sums = [a + b for a, b in zip(sums, n)]
                lines.append(f'{int(code)}000000{block},{d}T00:00:00-05:00,{d}T23:00:00-05:00,'
                             + ",".join(map(str, n)) + ',"[1,2,3]"')
            facts["devices"][(code, d)] = sums
        put(f"mobility/{d:%m}/{d:%d}/part{i}.csv", lines)
    paths["social_distancing_us"] = str(root / "mobility")

    paths["area_dictionary"] = put("area.csv", ["state_fips,county_fips,state,county,class_code"] + [
        f"{int(c[:-3])},{int(c[-3:])},{s.lower()},{n.lower()},H1" for c, n, s, _, _ in PLACES])
    paths["population_data"] = put("population.csv", ["SUMLEV,STATE,COUNTY,STNAME,CTYNAME,POPESTIMATE2019"] + [
        "40,39,0,Ohio,Ohio,13000", "40,36,0,New York,New York,20000"] + [
        f"50,{int(c[:-3])},{int(c[-3:])},{s},{n} County,{p}" for c, n, s, p, _ in PLACES])
    paths["geographic_data"] = put("land.csv", ["census_block_group,amount_land,amount_water"] + [
        f"{int(c)}000000{b},{land // 2},1" for c, _, _, _, land in PLACES for b in (1, 2)])

    lines = ["time,Country/Region,Province/State,precipIntensity,windSpeed,temperatureHigh,temperatureLow"]
    for d in days:
        for state in ("Ohio", "New York"):
            high, low = round(rnd.uniform(60, 90), 1), round(rnd.uniform(30, 50), 1)
            facts["weather"][(state.lower(), d)] = high + low / 2
            lines.append(f"{d},US,{state},0.1,3.5,{high},{low}")
        lines.append(f"{d},Italy,Lazio,0.2,2.5,70,50")
    paths["climate"] = put("climate.csv", lines)

    paths["airport_codes"] = put("airports.csv", [
        "id,ident,type,name,latitude_deg,longitude_deg,iso_country,iso_region",
        '1,KJFK,large_airport,"Kennedy, NY",40.6,-73.7,US,US-NY', "2,LIRF,large_airport,Fiumicino,41.8,12.2,IT,IT-62",
        "3,LEMD,large_airport,Barajas,40.4,-3.5,ES,ES-M"])
    paths["countries_mapping"] = put("countries.csv", ["name,alpha-2", "United States,US", "Italy,IT", "Spain,ES"])
    for i in range(2):
        lines = ["callsign,origin,destination,day"]
        for d in days[i::2]:
            for _ in range(3):
                legs = rnd.choice([("LIRF", "KJFK"), ("LEMD", "KJFK"), ("KJFK", "LIRF"), ("XXXX", "KJFK"), ("", "KJFK")])
                lines.append(f"A1,{legs[0]},{legs[1]},{d}")
                facts["flights"].append((*legs, d))
        put(f"air/0{i}/flights.csv", lines)
    paths["air_traffic"] = str(root / "air")
    return paths, facts, days


@pytest.fixture(scope="module")
def results(spark, files):
    return run_all(spark, files[0])


def growth_of(facts, days, code):
    totals = [facts["cases"][(code, d)] for d in days]
    return [b - a for a, b in zip([0, *totals], totals)]


def test_population_density(results):
    found = {r["County"]: r for r in results["population_density"].collect()}
    assert results["population_density"].columns == [
        "amount_land", "State", "County", "Population", "Population_Density"]
    assert set(found) == {"adams", "allen", "albany"}
    assert found["adams"]["Population_Density"] == 20.0 and found["albany"]["State"] == "new york"


def test_us_cases(results, files):
    _, facts, days = files
    rows = results["us_cases"].where("fips_code = '39003'").orderBy("Date").collect()
    assert [r["Growth_Rate"] for r in rows] == growth_of(facts, days, "39003")
    assert (rows[0]["County"], rows[0]["State"], rows[0]["fips_state"], rows[0]["fips_county"]) == ("allen", "ohio", 39, 3)
    blank = results["us_cases"].where("fips_code IS NULL").orderBy("County", "State").collect()
    assert sorted(r["Growth_Rate"] for r in blank) == [-2, 7] and blank[0]["fips_state"] is None


def test_drop_blank_keys(spark, files):
    from seriesloom.sources import readers, schemas
    raw = readers.read_positional_csv(spark, files[0]["covid_cases_us"], schemas.CASES_US)
    assert ingest.us_cases(raw, drop_blank_keys=True).count() == 3 * DAYS


def test_global_cases(results):
    rows = results["global_cases"].where("Terr_code = 'ITA'").orderBy("Date").collect()
    values = [i * 3 % 17 for i in range(DAYS)]
    assert [r["Cases"] for r in rows] == values[::15]
    assert [r["Max_Peak"] for r in rows] == [max(values[i + 1:i + 15]) for i in range(0, DAYS, 15)]
    assert rows[0]["Country"] == "italy"


def test_social_distancing(results, files):
    _, facts, days = files
    df = results["social_distancing"]
    assert df.count() == 3 * DAYS
    r = df.where((df["Date"] == days[5]) & (df["County"] == "adams")).first()
    devices, distance, home, full, part = facts["devices"][("39001", days[5])]
    assert (r["device_count"], r["distance_traveled_from_home"]) == (devices, distance)
    assert r["percent_at_home"] == pytest.approx(home / devices * 100)
    assert r["Social_Dist_Factor_Part_Work"] == pytest.approx(part / devices * 100 * 20.0)
    assert df.columns[:5] == ["State", "County", "fips_state", "fips_county", "Date"]


def test_climate_and_air_traffic(results, files):
    _, facts, days = files
    weather = {(r["State"], r["Date"]): r["Avg_Temp"] for r in results["climate"].collect()}
    assert weather == pytest.approx(facts["weather"])
    flights = [f for f in facts["flights"] if f[0] in ("LIRF", "LEMD", "KJFK")]
    assert results["air_traffic"].count() == len(flights) and len(results["air_traffic"].columns) == 17
    r = results["air_traffic"].where("origin = 'LIRF'").first()
    assert (r["origin_country"], r["destination_airport_name"], r["destination_region"]) == ("italy", "Kennedy, NY", "US-NY")


def test_mobility_causality(results, files):
    _, facts, days = files
    found = {r["fips_code"]: r for r in results["granger_result_table"].collect()}
    assert set(found) == {p[0] for p in PLACES} and len(results["granger_result_table"].columns) == 7
    for code in found:
        y = growth_of(facts, days, code)
        for name, at in (("Home", 2), ("Full_Work", 3), ("Part_Work", 4)):
            x = [facts["devices"][(code, d)][at] / facts["devices"][(code, d)][0] for d in days]
            tests = [least_squares(x, y, lag)[::-1] for lag in range(1, 15)]
            p, f = min(tests)
            assert found[code][f"Causation_Social_Dist_Factor_{name}_norm_F"] == pytest.approx(f, rel=1e-6)
            assert found[code][f"Causation_Social_Dist_Factor_{name}_norm_p"] == pytest.approx(p, rel=1e-6)


def test_normalized_panel_spans_the_range(results):
    for c in analysis.NORMALIZED:
        low, high = results["Cases_and_SD"].selectExpr(f"min({c}_norm)", f"max({c}_norm)").first()
        assert (low, high) == (0.0, 1000.0)


def test_climate_causality(results, files):
    _, facts, days = files
    x, y = [], []
    for state in ("new york", "ohio"):
        codes = [p[0] for p in PLACES if p[2].lower() == state]
        for i, d in enumerate(days):
            growth = sum(growth_of(facts, days, c)[i] for c in codes)
            if i == 0:
                growth += 7 if state == "new york" else -2
            if growth != 0:
                x.append(facts["weather"][(state, d)])
                y.append(growth)
    assert results["Cases_and_Climate"].count() == len(x)
    for r in results["climate_causality"].collect():
        f, p = least_squares(x, y, r["lag"])
        assert r["f"] == pytest.approx(f, rel=1e-6) and r["p"] == pytest.approx(p, rel=1e-6)
    assert {r["State"] for r in results["climate_causality_by_state"].collect()} == {"ohio", "new york"}


def test_inbound_flights(results, files):
    _, facts, days = files
    kept = set(days[::15])
    expected = sum(1 for o, t, d in facts["flights"] if t == "KJFK" and o in ("LIRF", "LEMD") and d in kept)
    rows = results["Air_Traffic_Cases"].collect()
    assert len(rows) == expected > 0
    assert {r["destination_region"] for r in rows} == {"NY"}
    assert [c.lower() for c in results["Air_Traffic_Cases"].columns].count("date") == 1


def test_profile(results, files):
    found = {(r["dataset"], r["column"]): r for r in results["profile"].collect()}
    assert found[("COVID 19 cases", "fips_code")]["distinct"] == 4
    assert found[("COVID 19 cases", "Confirmed_Cases")]["count"] == 3 * DAYS + 2
    assert found[("Climate", "State")]["distinct"] == 2 and found[("Climate", "State")]["mean"] is None
    assert math.isclose(found[("Social Distancing", "Population_Density")]["max"], 80.0)


def test_tables_load_without_running(spark, files):
    assert set(load_tables(spark, files[0])) == {
        "population_density", "us_cases", "global_cases", "social_distancing", "climate", "air_traffic"}
