import datetime as dt
import random

from pyspark.sql import functions as F

from knowndate.operators import asof, macro, market

D = dt.date
DAY0 = D(2023, 1, 1)


def prices(spark, days, key="security_id"):
    return spark.createDataFrame(
        [("S", DAY0 + dt.timedelta(days=i), 100.0 + i, 1000.0 + (i % 7)) for i in range(days)],
        f"{key} string, date date, close double, volume double",
    )


def test_future_prices_do_not_change_features(spark):
    at = DAY0 + dt.timedelta(days=250)
    short = market.security_market_features(prices(spark, 300)).filter(F.col("date") == F.lit(at)).first()
    long = market.security_market_features(prices(spark, 350)).filter(F.col("date") == F.lit(at)).first()
    assert short == long and short.ret_21d is not None
    f = spark.createDataFrame([("S", at), ("S", D(2022, 1, 1)), (None, at)], "security_id string, filed date")
    out = market.attach_security_market(f, market.security_market_features(prices(spark, 300))).collect()
    assert len(out) == 3
    assert all(r.date is None or r.date <= r.filed for r in out)
    assert sum(r.date is None for r in out) == 2


def test_null_features_of_the_matched_row_stay_null(rows):
    left = rows("cik string, filed date", [("1", D(2024, 2, 1))])
    right = rows("cik string, date date, x double, y double",
                 [("1", D(2024, 1, 1), 1.0, 1.0), ("1", D(2024, 1, 15), None, 2.0)])
    r = asof.asof_backward(left, right, "filed", "date", ["cik"], ["x", "y"]).first()
    assert (r.date, r.x, r.y) == (D(2024, 1, 15), None, 2.0)


def test_macro_is_the_latest_published(rows):
    f = rows("cik string, filed date, adsh string, date date", [("1", D(2024, 2, 15), "a", None)])
    m = rows("date date, treasury_3m double, treasury_10y double",
             [(D(2024, 1, 31), 5.0, 4.0), (D(2024, 3, 31), 9.0, 9.0)])
    r = macro.attach_macro(f, macro.macro_features(m)).first()
    assert (r.treasury_3m, r.yield_curve_10y_3m, r.date_macro) == (5.0, -1.0, D(2024, 1, 31))


def test_interval_states(rows):
    f = rows("cik string, filed date", [("1", D(2020, 6, 1)), ("2", D(2020, 6, 1)), ("3", D(2020, 6, 1))])
    link = "cik string, security_id string, valid_from date, valid_to date, decision string"
    ok = "accepted_identifier"
    links = rows(link, [
        ("1", "A", D(2021, 1, 1), D(2022, 1, 1), ok),
        ("2", "B", D(2020, 1, 1), D(2020, 6, 1), ok),
        ("2", "C", D(2020, 1, 1), None, ok),
        ("2", "D", D(2020, 1, 1), D(2022, 1, 1), "review_candidate"),
        ("2", "E", D(2021, 1, 1), D(2020, 1, 1), ok),
        ("3", "F", D(2020, 1, 1), D(2022, 1, 1), ok),
        ("3", "F", D(2020, 1, 1), D(2022, 1, 1), ok),
    ])
    out = {r.cik: (r.security_id, r.security_resolution) for r in asof.attach_security(f, links).collect()}
    assert out == {"1": (None, "unresolved"), "2": ("B", "accepted"), "3": (None, "ambiguous")}


def test_interval_join_against_brute_force(spark):
    rnd = random.Random(11)
    day = lambda: DAY0 + dt.timedelta(days=rnd.randrange(60))
    f = [("hot" if i % 2 else f"c{i % 5}", f"a{i}", day()) for i in range(150)]
    links = [("hot" if i % 2 else f"c{i % 5}", f"s{i}", day(), day(), rnd.choice(["accepted_identifier", "rejected"])) for i in range(40)]
    got = asof.attach_security(
        spark.createDataFrame(f, "cik string, adsh string, filed date"),
        spark.createDataFrame(links, "cik string, security_id string, valid_from date, valid_to date, decision string"),
    )
    got = {r.adsh: (r.security_id, r.security_resolution) for r in got.collect()}
    for cik, adsh, filed in f:
        active = [s for c, s, a, b, d in links if c == cik and a <= filed <= b and d == "accepted_identifier"]
        want = (active[0], "accepted") if len(active) == 1 else (None, "ambiguous" if active else "unresolved")
        assert got[adsh] == want


def test_master_audit_and_gaps(rows):
    base = "security_id string, issuer_id string, security_name string, valid_from date, valid_to date, source string, source_identifier string"
    m = rows(base, [
        ("A", "i", "n", D(2020, 1, 1), D(2020, 12, 31), "s", "1"),
        ("A", "i", "n", D(2020, 6, 1), D(2020, 7, 1), "s", "2"),
        ("A", "i", "n", D(2020, 12, 31), D(2021, 7, 1), "s", "3"),
        ("A", "i", "n", D(2020, 12, 31), D(2021, 7, 1), "s", "4"),
    ])
    r = market.security_master_audit(m).first()
    assert (r.rows, r.securities, r.issuers, r.overlapping_intervals, r.passed) == (4, 1, 1, 3, True)
    bad = rows(base, [("A", "i", "n", D(2020, 1, 1), D(2019, 1, 1), "s", "1")])
    assert not market.security_master_audit(bad).first()["passed"]
    p = rows("security_id string, date date, close double, volume double, source string, retrieved_at string",
             [("A", D(2020, 1, 1), 1.0, 1.0, "s", "t"), ("A", D(2020, 2, 1), 1.0, 1.0, "s", "t"), ("B", D(2020, 1, 1), 1.0, 1.0, "s", "t")])
    g = {r.security_id: (r.max_calendar_gap_days, r.gaps_over_threshold) for r in market.price_gaps(p).collect()}
    assert g == {"A": (31, 1), "B": (0, 0)}


def test_missingness_and_delistings(rows):
    out = market.market_missingness(rows("id int, ret_21d double", [(1, 0.1), (2, None)]), ["ret_21d"]).orderBy("id").collect()
    assert [(r.market_data_available, r.ret_21d__missing) for r in out] == [(True, 0), (False, 1)]
    d = rows("security_id string, delist_date date, delist_code string, delist_return double, source string, source_identifier string",
             [("A", D(2020, 1, 1), "5", -0.8, "s", "1"), ("B", D(2020, 1, 1), "5", None, "s", "1")])
    got = market.delisting_observations(d).collect()
    assert [(r.security_id, r.delist_return) for r in got] == [("A", -0.8)]


def test_master_audit_query_sees_undated_links(spark, tmp_path):
    import __spark_entry__ as entry_points

    orders = [  # customer, priority, day, key; keys that 13 divides have no end
        (1, "A", D(2020, 1, 1), 1), (1, "A", D(2020, 9, 1), 2), (1, "B", D(2020, 6, 1), 13), (1, "C", D(2021, 3, 1), 3),
        (2, "A", D(2020, 1, 1), 26), (2, "B", D(2020, 2, 1), 4),
    ]
    schema = "o_custkey long, o_orderpriority string, o_orderdate date, o_orderkey long"
    spark.createDataFrame(orders, schema).write.parquet(f"{tmp_path}/orders.parquet")
    r = entry_points.queries()["w10_security_master_audit"](spark, str(tmp_path)).first()
    # five links; only the undated B of the first issuer starts within an earlier interval, and open ends reach nothing
    assert (r.rows, r.securities, r.issuers, r.overlapping_intervals, r.passed) == (5, 2, 3, 1, True)
