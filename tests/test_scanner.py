"""Numbers out of texts: what stands around them decides."""

import pytest
from pyspark.sql import functions as F

from loomstone.functions import indicators, periods, quantities, scanner

SAYS = [
    ("annual_visits", "Total visitors (2023): 812.455", 812_455, "visits/year"),
    ("annual_visits", "visits: 31.208 million visitors in 2022", 31_208_000, "visits/year"),
    ("annual_passenger_throughput", "Passengers: 7.5M/yr, told in 2021", 7_500_000, "visits/year"),
    ("annual_passenger_throughput", "traffic was 12.4m passengers in 2020", 12_400_000, "visits/year"),
    ("annual_passenger_throughput", "throughput 2.5e+06 passengers/year", 2_500_000, "visits/year"),
    ("annual_passenger_throughput", "a terminal for passengers beside runways of 1,900 m and 2,700 m", None, None),
    ("annual_passenger_throughput", "passenger flights to 4 destinations", None, None),
    ("annual_passenger_throughput", "it has 18% of all passenger traffic", None, None),
    ("daily_ridership", "3 lines, 40 stations, daily ridership of 120,500, and annual ridership of 40,000,000", 120_500, "visits/day"),
    ("daily_ridership", "peak of 90,000 riders per day in one of the summers, else 61,000 riders per day", 61_000, "visits/day"),
    ("seat_count", "total capacity 21,000; a US$9 million renovation agreement", 21_000, "seats"),
    ("seat_count", "5,000 seats. 20,000 sqm", None, None),
    ("seat_count", "a 44,000-seat stadium on 70 acres of park, far from everything else", None, None),
    ("seat_count", "a 44,000-seat stadium, which stands beside a park", 44_000, "seats"),
    ("keys", "12 meeting rooms, 310 guest rooms, 900 sq. ft. largest room", 310, "rooms"),
    ("keys", "total rooms: 400", None, None),
    ("keys", "rooms: 400", 400, "rooms"),
    ("staff_count", "a workforce of 3,100 staff", 3_100, "people"),
    ("staff_count", "opened in 2020 for 3 cities", None, None),
    ("exhibition_area", "Campus area: 90,000 sq m", None, None),
    ("exhibition_area", "Campus area: 90,000 sq m; exhibition hall area: 20,000 sq m", 90_000, "sqm"),
    ("gla", "1,000 square feet", 92.903, "sqm"),
    ("beds", "1,500+ bed capacity", 1_500, "beds"),
    ("beds", "five hospitals add 600 inpatient beds; 120 beds per facility", 120, "beds"),
    ("beds", "each modern regional hospital gets 80 beds; 400 beds in all", 80, "beds"),
    ("line_count", "line count: 7", 7, "lines"),
    ("line_count", "served by 5 metro lines and 300 lines of text", 5, "lines"),
    ("tower_height", "height of 212 m", 212, "meters"),
    ("tower_height", "a 180-metre tower", None, None),
    ("floor_count", "55 storeys", 55, "floors"),
    ("visitor_share", "about 40 %", 40, "percent"),
    ("beds", "", None, None),
    ("beds", None, None, None),
]
WORKBOOK = [
    ("annual_passengers", "2024 all passengers 8.9M; a new terminal opens with a first-stage capacity of 15 million passengers annually", 8_900_000),
    ("annual_passenger_throughput", "In 2022, the airport served 4.5 million people.", 4_500_000),
    ("passengers", "2021 international passenger numbers 200,100 plus domestic passenger numbers 300,200", 500_300),
    ("passengers", "terminal capacity 5 million passengers", None),
    ("students", "Enrollment: 640 students in 2021", 640),
    ("beds", "Beds: 1,250", 1250),
    ("room_count", "3 meeting rooms, then a long way after them 50 guest rooms", 50),
    ("gla", "45.000 m2 gross leasable area", 45_000),
    ("retail_gfa", "GLA (sqm): 30,5", 30.5),
    ("tower_height", "a 250 m tall tower", 250),
    ("visitors", "1.2 million visitors", 1_200_000),
    ("built_up_area", "gross floor area: 12,500 sqm", 12_500),
    ("brand_count", "between 5 and 12.5 thousand", 12_500),
    ("seat_count", "opened in 2001", None),
    ("beds", None, None),
]


def test_fields(spark):
    df = spark.createDataFrame([(f, t) for f, t, _, _ in SAYS], "f string, t string")
    got = [tuple(r[0]) for r in df.select(quantities.value_and_unit(F.col("f"), F.col("t"))).collect()]
    assert [(v if v is None else pytest.approx(v), u) for _, _, v, u in SAYS] == got


def test_workbook(spark):
    df = spark.createDataFrame([(k, t) for k, t, _ in WORKBOOK], "k string, t string")
    got = [r[0] for r in df.select(quantities.workbook_value(F.col("k"), F.col("t"))).collect()]
    assert got == [v if v is None else pytest.approx(v) for _, _, v in WORKBOOK]


def test_numbers_and_clauses(spark):
    text = "A380 in 2019: 12 500 seats, 3.5 million (or 4 mn). Then\n1.250.000; q1 7,5 2024 12"
    found = spark.createDataFrame([(text,), (None,)], "t string").select(quantities.numbers(F.col("t")).alias("n")).collect()
    assert [(x["value"], x["year"], x["clause"]) for x in found[0]["n"]] == [
        (2019, True, 0), (12_500, False, 0), (3_500_000, False, 0), (4_000_000, False, 0), (1_250_000, False, 2), (75, False, 3), (2024, True, 3), (12, False, 3)
    ]
    assert found[1]["n"] is None
    assert scanner.number("1.2.3") is None and scanner.number("7,5", comma_decimal=True) == 7.5 and scanner.number("1,234.5") == 1234.5


def test_periods(spark):
    fine = ("q1+q2+q3+q4, derived", "summing up the four quarterly values of Q1", "monthly mean x 12", "5000 per year", "market share 12", "annualised by a factor of Q2", "", None)
    say = [
        ("Annual visits", "Q1 2023: 5000", periods.PARTIAL), ("annual_visits", "4,100 visitors per month", periods.PARTIAL), ("annual_visits", "March: 700", periods.PARTIAL),
        ("annual_footfall", "read from a chart", periods.CHART), ("annual_footfall", "chart of the full year", None), ("annual_footfall", "ytd, chart, until 12", None), ("rooms", "Q1", None),
        *[("annual_visits", t, None) for t in fine],
    ]
    df = spark.createDataFrame(say, "f string, t string, want string")
    got = df.select("t", "want", quantities.period_issue(F.col("f"), F.col("t"), F.lit(None).cast("string")).alias("got")).collect()
    assert [(r["t"], r["got"]) for r in got] == [(r["t"], r["want"]) for r in got]


def test_indicators(spark):
    text = "A hub: 12 500 мест, 300座; 9,000 sqm of exhibition space, 9,000 SQM. 120 modern guest rooms. 4 million passengers per year. 4 MILLION passengers per year."
    assert len(indicators.KINDS) == 31
    rows = [(text, None), ("In March 900 passengers", ["annual_passenger_throughput", "passenger_throughput", "unknown"]), ("x" * 200 + " 5 beds " + "y" * 200, ["beds"]), ("7 beds and 8 beds", ["beds"]), (None, ["beds"])]
    df = spark.createDataFrame(rows, "t string, n array<string>")
    got = [r["f"] for r in quantities.with_indicators(df, "t", F.col("n"), "f").collect()]
    first = [(x["name"], x["value"]) for x in got[0]]
    assert first.count(("annual_passenger_throughput", "4 million passengers")) == 1 and ("annual_passenger_throughput", "4 MILLION passengers") not in first
    assert {("seat_count", "12 500 мест"), ("seat_count", "300座"), ("exhibition_area", "9,000 sqm of exhibition"), ("keys", "120 modern guest rooms"), ("terminal_role", "hub")} <= set(first)
    assert [(x["name"], x["value"]) for x in got[1]] == [("passenger_throughput", "900 passengers")]  # a month is no year
    assert len(got[2][0]["context"]) == 280 + len("5 beds")
    assert [[x["value"] for x in f] for f in got[3:]] == [["7 beds", "8 beds"], []]


def test_provider_decides_where_rules_cannot(spark):
    said = "struct<decision:string,reason:string,value:double,unit:string,confidence:double>"
    rows = [
        ("beds", "about 20 beds", None),
        ("beds", "up to 20 beds", ("accepted", "stated", 20.0, "beds", 1.7)),
        ("beds", "up to 20 beds", ("maybe", "?", 1.0, "x", 0.1)),
        ("beds", "none", ("accepted", "no", 1.0, "beds", 0.9)),
        ("annual_visits", "Q1: 9,000 visits", ("accepted", "no", 1.0, "beds", 0.9)),
    ]
    df = spark.createDataFrame(rows, f"f string, raw string, said {said}").withColumn("context", F.lit(None).cast("string"))
    got = [(r["decision"], r["value"], r["confidence"]) for r in quantities.cleaned(df, "f", "raw", "context", "said").collect()]
    assert got[:4] == [("accepted", 20.0, 0.72), ("accepted", 20.0, 1.0), ("needs_review", 20.0, 0.72), ("rejected", None, 0.72)]
    assert got[4][0] == "rejected"
