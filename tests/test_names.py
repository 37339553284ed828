"""Keys, names, identifiers and matching."""

import datetime as dt
import os
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from knowndate.functions import identifiers as ids
from knowndate.functions import keys, names
from knowndate.operators import checks, evidence, identity, matching
from tests.compare import connect, differences


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_name_keys(spark, rows):
    texts = ["Acme Holdings, Inc.", "Société Générale S.A.", "A.B. & Co", "INC", "ＦＵＬＬ Ltd"]
    got = [r.k for r in rows("i int, t string", list(enumerate(texts))).select("i", names.entity_name_key(F.col("t")).alias("k")).orderBy("i").collect()]
    assert got == ["ACME HOLDINGS", "SOCIE TE GE NE RALE S A", "A B", "", "FULL"]


def test_name_keys_of_any_text(rows):
    """Random mixtures of scripts, ligatures, widths, combining marks, controls and code points beyond 16 bits."""
    import re
    import unicodedata

    rnd = random.Random(7)
    pieces = ["Acme", "inc", "L P", "plc", " ", "  ", "\t", "\n", "\x00", "é", "e\u0301", "ß", "ﬁ", "Ⅷ", "½", "ı", "İ", "ŉ", "Ａｂ１", "①", "株式会社",
              "\u00a0", "\u2003", "\u200d", "🏦", "𝐀𝟗", "㏇", "ǆ", "ΐ", "-", "&", "3"]
    texts = ["".join(rnd.choices(pieces, k=rnd.randrange(9))) for _ in range(400)] + [None]

    def plain(text):
        upper = unicodedata.normalize("NFKD", text).upper()
        return " ".join(t for t in re.sub("[^A-Z0-9 ]+", " ", upper).split() if t not in set(names.LEGAL_SUFFIXES))

    keyed = rows("i int, t string", list(enumerate(texts))).select("i", names.entity_name_key(F.col("t")).alias("k"))
    got = {r.i: r.k for r in keyed.collect()}
    assert got == {i: None if t is None else plain(t) for i, t in enumerate(texts)}


def test_list_key_width(spark):
    key = names.list_name_key(names.entity_name_key(F.lit("American Safety Insurance Holdings Ltd")))
    assert one(spark, key) == "AMERICAN SAFETY INSURANCE HL"


def test_cik_keys(spark):
    assert one(spark, keys.cik_label_key(F.lit("1e3"))) == "1000"
    assert one(spark, keys.cik_label_key(F.lit("CIK0012"))) == "12"
    assert one(spark, keys.cik_filing_key(F.lit("123.0"))) == "0000000123"
    assert one(spark, keys.cik_filing_key(F.lit("abc"))) is None
    assert one(spark, keys.cik_observation_key(F.lit("895648"))) == "0000895648"
    assert one(spark, keys.cik_observation_key(F.lit(12.0), "double")) == "0000000012"
    for bad in ("0", "1.0", "12345678901", "-5"):
        assert one(spark, keys.cik_observation_key(F.lit(bad))) == "unavailable"


def test_quarters(spark):
    q = F.transform(keys.observation_quarters(F.lit("2012-08-01").cast("date")), keys.quarter_label)
    assert one(spark, q) == ["2012Q3", "2011Q3", "2010Q3", "2009Q3"]


def test_check_digits(spark):
    for good in ("037833100", "B38564108", "G0131Y100"):
        assert one(spark, ids.valid_cusip(F.lit(good)))
    for bad in ("037833101", "03783310", None):
        assert not one(spark, ids.valid_cusip(F.lit(bad)))
    assert one(spark, ids.valid_isin(F.lit("us0378331005")))
    for bad in ("US0378331004", "FP0378331005", "US037833100"):
        assert not one(spark, ids.valid_isin(F.lit(bad)))


def test_extraction_and_context(spark, rows):
    text = "Cusip No. 037833100 and ISIN US0378331005, CUSIP 037833101"
    assert one(spark, ids.extract_cusips(F.lit(text))) == ["037833100"]
    assert one(spark, ids.extract_isins(F.lit(text))) == ["US0378331005"]
    long = "é" * 500 + " CUSIP 037833100 common stock" + "y" * 500
    d = rows("cik string, accession string, filing_date string, document_type string, source string, text string",
             [("1", "a", "2020-01-01", "EX-4.12", "u", long), ("1", "a", "2020-01-01", "EX-21", "u", long)])
    r = evidence.contextual_evidence(d).first()
    assert r.identifier_match_start == long.index("037833100") and r.security_context == "common_equity"
    assert len(r.identifier_context) == 449
    assert evidence.identifier_evidence(d).count() == 1


@pytest.mark.parametrize("text,kind", [
    ("x 7.5% senior notes due 2030", "debt"), ("Series A preferred stock", "preferred"),
    ("common stock and footnote", "ambiguous_security_type"), ("units", "unknown"),
])
def test_security_context(spark, text, kind):
    assert one(spark, ids.security_context(F.lit(text))) == kind


def test_relationships(spark):
    rel = lambda a, b: one(spark, ids.identifier_relationship(F.lit(a), F.lit(b)))
    assert rel("037833100", "037833100") == "exact"
    assert rel("037833101", "037833100") == "same_security_body_check_digit_difference"
    assert rel("037833250", "037833100") == "same_issuer_root_different_issue"
    assert rel("999999999", "037833100") == "different_issuer_root"
    assert rel("999999999", None) == "unusable"


def test_decisions(spark):
    d = lambda s, o, i: one(spark, identity.candidate_decision(F.lit(s), F.lit(o), F.lit(i)))
    assert d(1.0, True, False) == "review_exact_name"
    assert d(1.0, True, True) == "accepted_identifier"
    assert d(1.0, False, True) == "rejected"


def _score(a, n):
    x, y = set(a.split()), set(n.split())
    return max(len(x & y) / len(x | y), SequenceMatcher(None, a, n).ratio())


@pytest.mark.parametrize("threshold", [0.3, 0.45, 0.72, 0.9])
def test_similar_names_finds_every_pair(spark, threshold):
    rnd = random.Random(5)
    words = ["BLUE", "STAR", "BLUESTAR", "RING", "A", "STEEL", "WIDGET", "OIL", "GAS", "1ST"]
    make = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))
    left = sorted({make() for _ in range(25)})
    right = sorted({make() for _ in range(40)} | {"".join(rnd.sample("ABCDEFGH", 5)) for _ in range(10)})
    got = matching.similar_names(
        spark.createDataFrame([(v,) for v in left], "alias_key string"),
        spark.createDataFrame([(v,) for v in right], "name_key string"),
        threshold,
    ).collect()
    want = {(a, n): _score(a, n) for a in left for n in right if _score(a, n) >= threshold}
    assert len(got) == len(want)
    assert all(abs(want[(r.alias_key, r.name_key)] - r.score) < 1e-12 for r in got)


def _strength(rows, second_name, second_isin):
    cases = rows("cik string, first_filing date", [("0000000001", dt.date(2010, 1, 1))])
    hist = rows("cik string, historical_name string", [])
    fnames = rows("cik string, name string", [("0000000001", "ACME HOLDINGS INC")])
    universe = rows("security_id string, security_name string, isin string, is_delisted boolean, ordinal int",
                    [("A.US", "Acme Holdings", " us0378331005 ", True, 0), ("B.US", second_name, second_isin, True, 1)])
    return identity.candidate_strength(cases, hist, fnames, universe).first()


def test_candidate_strength(rows):
    r = _strength(rows, "Acme Holdings Preferred", None)
    assert r.isin == "US0378331005" and r.isin_present and r.margin > 0 and not r.top_score_tied
    t = _strength(rows, "Acme Holdings", "US5949181045")
    assert t.top_score_tied and t.top_score_near_tied and t.top_tied_candidate_count == 2
    assert t.top_tied_security_ids == ["A.US", "B.US"]


def test_name_coverage_and_lists(rows):
    cases = rows("cik string, last_filing date", [("1", dt.date(2012, 8, 1)), ("2", dt.date(2012, 8, 1))])
    aliases = rows("cik string, alias string", [("1", "Acme Holdings Inc"), ("2", "Zed")])
    official = rows("cusip string, issuer_name string, ordinal int, vintage string",
                    [("c1", "ACME HLDGS", 0, "2012Q3"), ("c2", "ACME HOLDINGS", 1, "2011Q3")])
    out = {r.cik: r for r in matching.name_coverage(cases, aliases, official).collect()}
    assert out["1"].exact_normalized_name_hit and out["1"].best_cusip == "c2" and out["1"].candidate_hit
    assert not out["2"].candidate_hit
    hits = {(r.cik, r.vintage): r.exact_discovery_hit for r in matching.list_hits(cases, aliases, official).collect()}
    assert hits[("1", "2012Q3")] and hits[("1", "2011Q3")] and not hits[("1", "2010Q3")] and len(hits) == 8
    missing = matching.missing_controls(official, official, ["ACME HOLDINGS INC", "APPLE INC"]).collect()
    assert sorted((r.vintage, r.name) for r in missing) == [("2011Q3", "APPLE INC"), ("2012Q3", "APPLE INC")]


def test_identity_master(rows):
    c = rows("cik string, filed date, distress_12m int", [("1.0", dt.date(2008, 1, 1), 1), ("2", dt.date(2010, 1, 1), None)])
    m = identity.identity_master(c, rows("cik string, ticker string", [("2", "T")]), rows("cik string, historical_name string", [("1", "A"), ("1", "B")]))
    out = {r.cik: r for r in m.collect()}
    assert out["0000000001"].identity_status == "historical_name_only" and out["0000000001"].name_count == 2
    assert out["0000000002"].identity_status == "current_ticker"
    assert [r.cik for r in identity.hard_cases(m).collect()] == ["0000000001"]
    inc = identity.incremental_names(identity.hard_cases(m), rows("cik string, historical_name string", [("1", "A")]), rows("cik string, name string", [("1.0", "New Name")])).first()
    assert inc.status == "out_of_scope" and inc.incremental_name_count == 1


def test_isin_flag_without_value(rows):
    s = rows("isin string, isin_present boolean", [(" ", True)])
    with pytest.raises(ValueError):
        checks.require(identity.isin_flag_check(s), "isin flags")


def test_ties_are_counted_over_all_securities_and_by_full_keys(spark):
    from knowndate.operators import identity

    names = ["Zürich Bau AG", "Zörich Bau AG", *["Zürich Bau AG"] * 5]
    universe = spark.createDataFrame(
        [(f"S{k}", n, None, None, k) for k, n in enumerate(names)],
        "security_id string, security_name string, isin string, is_delisted boolean, ordinal int",
    )
    cases = spark.createDataFrame([("0000000001",)], "cik string")
    hist = spark.createDataFrame([(1, "Zürich Bau AG")], "cik int, historical_name string")
    filed = spark.createDataFrame([], "cik string, name string")
    got = identity.candidate_strength(cases, hist, filed, universe).first()
    assert got.top_tied_candidate_count == 6 and len(got.top_tied_security_ids) == 5
    two = universe.filter("ordinal < 2")
    keys = [r.security_name for r in two.collect()]
    assert len(keys) == 2
    both = identity.candidate_strength(cases, hist, filed, two).first()
    assert not both.top_score_tied  # the umlauts differ in the full key


def test_best_name_is_found_at_any_score(spark):
    cases = spark.createDataFrame([("0000000001",)], "cik string")
    aliases = spark.createDataFrame([("0000000001", "Zebra Quartz")], "cik string, alias string")
    official = spark.createDataFrame([("C1", "Blue Mint Foods", 1)], "cusip string, issuer_name string, ordinal int")
    got = matching.name_coverage(cases, aliases, official).first()
    assert abs(got.best_score - 0.2222) < 1e-3 and got.best_cusip == "C1" and not got.candidate_hit


def test_hard_cases_are_not_cut(spark):
    master = spark.range(250).select(
        F.lpad(F.col("id").cast("string"), 10, "0").alias("cik"),
        F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") * 30).cast("int")).alias("first_filing"),
        F.lit(1).alias("distress_observations"), F.lit(False).alias("has_current_ticker"),
    )
    cases = identity.hard_cases(master)
    assert cases.count() == 250 and identity.hard_cases(master, 100).count() == 100
    assert sum(r.issuers for r in identity.era_decades(cases).collect()) == 250


def test_medians_of_the_reports(rows):
    strength = rows(
        "candidate_count int, top_score double, margin double, high_margin boolean, top_score_tied boolean, "
        "top_score_near_tied boolean, is_delisted boolean, isin_present boolean",
        [(1, k / 10, k / 20, False, False, False, None, False) for k in (1, 4, 6, 9)]
        + [(0, None, None, False, False, False, None, False)],
    )
    got = identity.strength_report(strength).first()
    assert got.issuers == 5 and abs(got.top_score_median - 0.5) < 1e-12 and abs(got.margin_median - 0.25) < 1e-12
    none = identity.strength_report(strength.filter("candidate_count = 0")).first()
    assert none.issuers == 1 and none.top_score_median is None and none.margin_median is None
    detail = rows("cik string, rank int, score double, margin double",
                  [("1", 1, 0.9, 0.1), ("1", 2, 0.8, None), ("2", 1, 0.6, 0.6), ("3", None, None, None)])
    got = identity.discovery_summary(detail).first()
    assert got.issuers_examined == 3 and abs(got.top_score_median - 0.75) < 1e-12 and abs(got.margin_median - 0.35) < 1e-12


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the provided tables")
@pytest.mark.parametrize("name", ["a21_era_profile", "a21_era_decades", "u04_enriched_aliases"])
def test_queries_look_at_all_hard_cases(spark, name):
    """166 hard cases."""
    sf = "/root/testdata/sf0.01"
    ours, theirs, diff = differences(entry_points.queries()[name](spark, sf), connect(sf), entry_points.oracle_sql()[name])
    assert ours == theirs and not diff[0] and not diff[1], diff


def test_ties_are_classed_over_all_securities(rows):
    schema = "security_id string, security_name string, isin string, is_delisted boolean, ordinal int"
    cases = rows("cik string", [("0000000001",), ("0000000002",)])
    hist = rows("cik int, historical_name string", [(1, "Acme Holdings"), (2, "Blue Mint"), (2, "Red Fern")])
    filed = rows("cik string, name string", [])
    acme = [(f"A{k}", "Acme Holdings", f"I{k}", None, k) for k in range(5)]
    blue = [(f"B{k}", "Blue Mint", f"J{k}", None, 20 + k) for k in range(6)]

    def of(extra):
        s = identity.candidate_strength(cases, hist, filed, rows(schema, acme + blue + extra))
        kinds = {r.cik[-1]: (r.tie_composition, r.top_tied_candidate_count) for r in identity.tie_composition(s).collect()}
        return kinds, {r.cik[-1]: r for r in identity.tie_collapse_keys(s).collect()}

    kinds, keys = of([("A1", "Acme Holdings", "I9", None, 9), ("R", "Red Fern", None, None, 30)])  # the sixth repeats an id
    assert kinds == {"1": ("duplicate_security_id", 6), "2": ("distinct_normalized_names", 7)}
    assert keys["2"].tied_count == 7 and keys["2"].unique_normalized_names == 2 and keys["2"].missing_isin_in_tie
    kinds, keys = of([("A9", "Acme Holdings", " i1 ", None, 9), ("R", "Red Fern", "J3", None, 30)])  # the sixth and seventh share ISINs
    assert kinds == {"1": ("duplicate_isin", 6), "2": ("duplicate_isin", 7)}
    assert keys["1"].all_same_name and keys["1"].has_duplicate_isin and keys["2"].different_names_shared_isin


def _made_names(n, seed):
    rnd = random.Random(seed)
    first, second = ["BLUE", "RED", "OLD", "NEW", "HOT", "COLD"], ["GEAR", "BOLT", "RING", "ROD", "PLATE", "WIDGET"]
    return [f"{rnd.choice(first)} {rnd.choice(second)} BRAND#{rnd.randint(1, 40)}" for _ in range(n)]


def test_ladder_gives_what_one_search_at_the_lowest_score_gives(spark, monkeypatch):
    universe = spark.createDataFrame(
        [(f"S{k}", n, None, k % 3 == 0, k) for k, n in enumerate(_made_names(150, 1))],
        "security_id string, security_name string, isin string, is_delisted boolean, ordinal int",
    )
    names = _made_names(20, 2) + ["Zebra Quartz", "Gear", "B", "OLDGEAR BRAND#3"]
    aliases = spark.createDataFrame([(f"{k // 2:010d}", n) for k, n in enumerate(names)], "cik string, alias string")
    found = lambda: sorted(matching.discover(aliases, universe, 0.45, 5, tie_keys=True).collect())
    ladder = found()
    monkeypatch.setattr(matching, "LADDER", ())
    assert ladder == found() and len({r.cik for r in ladder}) > 8


def test_few_pairs_meet_at_high_scores(spark):
    left = spark.createDataFrame([(n,) for n in _made_names(600, 3)], "alias_key string")
    right = spark.createDataFrame([(n,) for n in _made_names(900, 4)], "name_key string")
    b = matching._Names(right, "name_key")
    a = matching._Names(left, "alias_key", b.counts)
    met = sum(matching._meetings(a, b, kind, 0.9).count() for kind in matching.KINDS)
    assert met < 0.1 * a.table.count() * b.table.count()
    listed = matching._listed(b, "words", 0.9, a.span["words"], 2)
    assert listed.groupBy("n", "m", "token").count().agg(F.max("count")).first()[0] < 0.05 * listed.count()
