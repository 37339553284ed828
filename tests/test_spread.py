"""Steps whose state grows with their rows are dealt out to many tasks; price histories are read in batches."""

import datetime as dt
import math
import re
import statistics

import pytest

from knowndate.operators import asof, checks, cohort, market
from knowndate.plans import bindings
from knowndate.session import LEAST_PARTITIONS

PRICES = "security_id long, date date, close double, volume double, source string, retrieved_at string"
DAY = dt.date(2001, 1, 1)


def dealt(df, capsys):
    """(column names, partitions) of the shuffles of a plan."""
    df.explain()
    found = re.findall(r"Exchange hashpartitioning\((.*?), (\d+)\)", capsys.readouterr().out)
    return [([c.split("#")[0] for c in names.split(", ")], int(n)) for names, n in found]


@pytest.mark.parametrize("check", [checks.price_contract, checks.price_plausibility])
def test_price_checks_stay_on_the_partitioning_of_the_price_table(spark, rows, tmp_path, capsys, check):
    line = rows("l_suppkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double", [(1, dt.datetime(2001, 1, 1), 5.0, 1.0)] * 3)
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    out = check(bindings.prices(spark, str(tmp_path)))
    assert dealt(out, capsys) == [(["security_id", "date"], LEAST_PARTITIONS)]
    assert out.first().rows == 1 and out.first().passed
    twice = check(rows(PRICES, [(1, DAY, 5.0, 1.0, "s", "r")] * 2 + [(None, DAY, 5.0, 1.0, "s", "r")]))
    assert twice.first().duplicate_key_rows == 1 and not twice.first().passed


def test_funnel_is_dealt_out_by_submission(rows, capsys):
    sub = rows(
        "adsh long, cik long, form string, period int, filed int, source_quarter string",
        [(k, k, "10-K", 20001231, 20010301, "2001q1") for k in (1, 2)] + [(3, 3, "10-K", 20001231, None, "2001q1")],
    )
    num = rows("adsh long, tag string, ddate string, qtrs int, uom string, value double", [(k, "Assets", "20001231", 0, "USD", 1.0) for k in (1, 1, 2, 3)])
    out = cohort.quarter_funnel(sub, num)
    by_submission = [n for names, n in dealt(out, capsys) if "adsh" in names]
    assert by_submission == [LEAST_PARTITIONS] * 2
    row = out.first()
    assert (row.raw_submissions, row.target_submissions, row.numeric_rows, row.canonical_facts) == (3, 2, 3, 3)


def test_security_links_are_dealt_out(rows, capsys):
    day = lambda n: DAY + dt.timedelta(n)
    links = rows(
        "cik long, security_id string, valid_from date, valid_to date, decision string",
        [(1, "A", day(0), day(10), "accepted_identifier"), (1, "B", day(5), day(20), "accepted_identifier")],
    )
    filings = rows("adsh long, cik long, filed date", [(1, 1, day(2)), (2, 1, day(7)), (3, 1, day(15)), (4, 1, day(30)), (5, None, day(2))])
    out = asof.attach_security(filings, links)
    assert {n for _, n in dealt(out, capsys)} == {LEAST_PARTITIONS}
    found = {r.adsh: (r.security_id, r.security_resolution) for r in out.collect()}
    assert found[1] == ("A", "accepted") and found[3] == ("B", "accepted")
    assert found[2] == (None, "ambiguous") and found[4] == found[5] == (None, "unresolved")


def test_trailing_features_go_on_over_batches(spark, rows, capsys):
    n = 300
    close = {s: [None if i % 31 == 5 else 50 + (i * (7 + s)) % 23 for i in range(n)] for s in (1, 2)}
    data = [(s, DAY + dt.timedelta(i), float(c) if c is not None else None, 0.1, "s", "r") for s in close for i, c in enumerate(close[s])]
    features = market.security_market_features(rows(PRICES, data))
    features.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "Window" not in plan
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = {(r.security_id, (r.date - DAY).days): r for r in features.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == 2 * n
    for (s, i), r in out.items():
        c = close[s]
        daily = [c[j] / c[j - 1] - 1 if j and c[j] and c[j - 1] else None for j in range(max(i - 62, 0), i + 1)]
        daily = [x for x in daily if x is not None]
        wanted = statistics.stdev(daily) * math.sqrt(252) if len(daily) >= 21 else None
        assert r.vol_63d == (pytest.approx(wanted) if wanted is not None else None)
        base = c[i - 252] if i >= 252 else None
        assert r.ret_252d == (pytest.approx(c[i] / base - 1) if c[i] and base else None)
        year = [x for x in c[max(i - 251, 0) : i + 1] if x is not None]
        known = c[i] is not None and len(year) >= 20
        assert r.drawdown_252d == (pytest.approx(c[i] / max(year) - 1) if known else None)
        assert r.volume_z_63d is None  # a constant volume has no spread, whatever its rounding
