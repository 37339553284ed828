import datetime as dt

from knowndate.operators import cohort

D = dt.date
FACT = "adsh string, cik string, form string, period date, filed date, feature string, tag string, version string, ddate date, qtrs int, value double"


def fact(adsh, form, tag, qtrs, value, feature="revenue", day=D(2024, 6, 30)):
    return (adsh, "1", form, D(2024, 6, 30), D(2024, 8, 1), feature, tag, "v", day, qtrs, value)


def test_dates_from_ints_and_floats(rows):
    sub = rows(
        "adsh string, cik int, form string, filed int, period double",
        [("a", 1, "10-K", 20250228, 20241231.0), ("b", 1, "10-K", 20251399, 20241231.0), ("c", 1, "8-K", 20250228, 20241231.0)],
    )
    out = cohort.eligible_submissions(sub).collect()
    assert [(r.adsh, r.filed, r.period) for r in out] == [("a", D(2025, 2, 28), D(2024, 12, 31))]


def test_shortest_duration_then_tag(rows):
    facts = rows(FACT, [
        fact("a", "10-Q", "Revenues", 2, 200.0),
        fact("a", "10-Q", "SalesRevenueNet", 1, 115.0),
        fact("a", "10-Q", "Revenues", 1, 110.0),
        fact("b", "10-Q", "Revenues", 2, 200.0),
        fact("c", "10-K", "Revenues", 2, 200.0),
        fact("d", "10-K/A", "ProfitLoss", 4, 7.0, "net_income"),
        fact("d", "10-K/A", "NetIncomeLoss", 4, 5.0, "net_income"),
        fact("e", "10-K", "Assets", 0, 9.0, "assets", D(2023, 6, 30)),
    ])
    wide = {r.adsh: r for r in cohort.submission_matrix(cohort.period_correct_facts(facts)).collect()}
    assert wide["a"].revenue == 110.0 and wide["b"].revenue == 200.0 and wide["d"].net_income == 5.0
    assert "c" not in wide and "e" not in wide


def test_ratios_of_zero_and_missing(rows):
    out = cohort.add_ratios(rows("net_income double, assets double, revenue double", [(1.0, 0.0, 2.0)])).first()
    assert out.roa is None and out.net_margin == 0.5 and out.current_ratio is None


def test_later_quarter_wins(rows):
    p = rows("adsh string, cik string, filed date, source_quarter string",
             [("a", "1", D(2024, 1, 1), "2024q1"), ("a", "1", D(2024, 1, 1), "2024q2")])
    assert cohort.last_per_filing(p).first().source_quarter == "2024q2"


def test_cohort_from_raw_tables(rows):
    """One filing with an event in time, one without, one with an open window, one without usable facts."""
    from knowndate.operators.cohort import modelling_cohort

    def filing(adsh, cik, filed, period):
        return (adsh, cik, "Name", "10-K", period, filed, "2019q1")

    sub = rows(
        "adsh string, cik string, name string, form string, period int, filed int, source_quarter string",
        [filing("a", "1", 20190301, 20181231), filing("b", "2", 20200301, 20191231),
         filing("c", "1", 20240301, 20231231), filing("d", "3", 20190301, 20181231)],
    )
    fact = lambda adsh, tag, day, value: (adsh, tag, "us-gaap", day, 0, "USD", None, value)
    num = rows(
        "adsh string, tag string, version string, ddate int, qtrs int, uom string, coreg string, value double",
        [fact("a", "Assets", 20181231, 4.0), fact("a", "Liabilities", 20181231, 3.0),
         fact("b", "Assets", 20191231, 4.0), fact("c", "Assets", 20231231, 4.0), fact("d", "Assets", 20171231, 4.0)],
    )
    events = rows(
        "cik string, event_date date, event_type string",
        [("0001", dt.date(2019, 9, 1), "bankruptcy"), ("2", dt.date(2020, 3, 1), "bankruptcy")],
    )
    got = {
        r.adsh: (r.split, r.distress_12m, r.liabilities_to_assets)
        for r in modelling_cohort(sub, num, events, "2024-06-30", "2019-12-31", "2022-12-31").collect()
    }
    assert got == {"a": ("train", 1, 0.75), "b": ("validation", 0, None)}
