"""Schemas of the input files as DDL text, and the catalogue names of the sources."""

# Column names, positions and types of the sources.
# The two case files have no header; their columns are found by position.
CASES_US = "Date string, County string, State string, fips_code string, Confirmed_Cases string, Deaths string"
CASES_GLOBAL = ("Date string, day string, month string, year string, Cases string, Deaths string, "
                "Country string, Geo_id string, Terr_code string")
COUNTY_DICTIONARY = "County string"
MOBILITY = ("origin_census_block_group string, date_range_start string, date_range_end string, "
            "device_count int, distance_traveled_from_home int, completely_home_device_count int, "
            "full_time_work_behavior_devices int, part_time_work_behavior_devices int, "
            "at_home_by_each_hour string")
AREA_DICTIONARY = "state_fips int, county_fips int, state string, county string, class_code string"
POPULATION = "STATE int, COUNTY int, STNAME string, CTYNAME string, POPESTIMATE2019 long"
LAND = "census_block_group string, amount_land long"
CLIMATE = ("time string, `Country/Region` string, `Province/State` string, precipIntensity double, "
           "windSpeed double, temperatureHigh double, temperatureLow double")
AIR_TRAFFIC = "origin string, destination string, day string"
AIRPORTS = ("ident string, type string, name string, latitude_deg double, longitude_deg double, "
            "iso_country string, iso_region string")
COUNTRIES = "name string, `alpha-2` string"

# Fixed value: date format of the case files.
CASE_DATE_FORMAT = "MM/dd/yyyy"
