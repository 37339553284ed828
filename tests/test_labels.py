import datetime as dt

import pytest
from pyspark.sql import functions as F

from knowndate.operators import labels

D = dt.date


def labelled(rows, obs, events, **kw):
    o = rows("cik string, adsh string, filed date", obs)
    e = rows("cik string, event_date string, event_type string", events)
    out = labels.label_forward(o, e, **kw).orderBy("adsh").collect()
    return out


def test_next_event_counts_only_after_the_filing(rows):
    out = labelled(
        rows,
        [("1", "a", D(2025, 1, 1)), ("1", "b", D(2025, 12, 31)), ("1", "c", D(2025, 6, 1))],
        [("1", "2025-06-01", "x")],
    )
    assert [r.distress_12m for r in out] == [1, 0, 0]  # same-day events are not later


def test_keys_match_across_paddings(rows):
    out = labelled(rows, [("1234", "a", D(2025, 1, 1))], [("0000001234", "2025-06-01", "x")])
    assert out[0].distress_12m == 1 and out[0].days_to_distress == 151.0


def test_censoring_states(rows):
    out = labelled(
        rows,
        [
            ("1", "a", D(2026, 6, 30)),
            ("1", "b", D(2024, 1, 1)),
            ("2", "c", D(2026, 1, 1)),
            ("3", "d", D(2026, 1, 1)),
        ],
        [("2", "2026-06-01", "x"), ("3", "2027-06-01", "x")],
        observed_through="2026-09-25",
    )
    assert [(r.distress_12m, r.label_mature, r.label_window_complete) for r in out] == [
        (None, False, False),
        (0, True, True),
        (1, True, False),
        (None, False, False),
    ]


def test_embargo_hides_later_events_and_null_dates(rows):
    out = labelled(
        rows,
        [("1", "a", D(2025, 1, 1)), ("1", "b", None)],
        [("1", "2025-01-10", "x"), ("1", "2025-06-01", "x")],
        embargo_days=30,
    )
    assert [r.distress_12m for r in out] == [0, 0]
    late = labelled(rows, [("1", "b", None)], [("1", "2025-01-10", "x")], observed_through="2026-01-01")
    assert late[0].distress_12m is None and not late[0].label_mature


def test_population_drops_known_positives_of_open_windows(rows):
    o = rows("cik string, adsh string, filed date", [("1", "a", D(2026, 1, 1)), ("1", "b", D(2020, 1, 1))])
    e = rows("cik string, event_date string, event_type string", [("1", "2026-02-01", "x")])
    lab = labels.label_forward(o, e, observed_through="2026-09-25")
    kept = labels.modelling_population(lab).collect()
    assert [r.adsh for r in kept] == ["b"]
    inventory = labels.censoring_inventory(labels.temporal_split(lab))
    total = {r["split"]: r for r in inventory.collect()}["all"]
    assert total["rows_before"] == total["rows_after"] + total["rows_dropped"] == 2
    assert total["censored_knowable_positives"] == total["censored_with_knowable_label"] == 1
    assert labels.censoring_confined_to_test(inventory).first()[0]


def test_events_need_columns(rows):
    with pytest.raises(ValueError, match="event_type"):
        labels.normalize_events(rows("cik string, event_date string", [("1", "2020-01-01")]))


def test_split_boundaries(rows):
    days = [D(2020, 12, 31), D(2021, 1, 1), D(2022, 12, 31), D(2023, 1, 1)]
    f = labels.temporal_split(rows("filed date", [(d,) for d in days]))
    assert [r["split"] for r in f.orderBy("filed").collect()] == ["train", "validation", "validation", "test"]
    assert not labels.split_check(f.filter(F.col("split") != "test")).first()["passed"]
