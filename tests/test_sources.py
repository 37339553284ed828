"""Landed files and list formats."""

import datetime as dt
import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from knowndate.operators import checks, cohort, evidence
from knowndate.plans import source_queries
from knowndate.sources import files, lists, readers


def line(cusip, marker, name, descr, status="", code="E"):
    return f"{cusip}{marker}{name:<28}  {descr:<16}{'':11}{status:<3}{'':9}{code}"


LINES = [
    line("B38564108", "*", "EURONAV NV", "SHS", code="N"),
    line("C00948122", " ", "AGRIFORCE GROWING SYSTEMS LT", "COM NEW"),
    line("G00350101", " ", "LOBO EV TECHNOLOGIES LTD", "SHS", "*A*"),
    line("G0131Y100", " ", "AGRICULTURE & NAT SOL ACQ CO", "SHS CL A", "*D*"),
]


def test_fixed_width(rows):
    raw = rows("vintage string, value string", [("2024Q1", v) for v in LINES])
    out = {r.cusip: r for r in lists.parse_fixed_width(raw).collect()}
    assert len(out) == 4 and out["B38564108"].marker == "*" and out["B38564108"].status == ""
    assert out["G00350101"].added_to_13f_list and out["G0131Y100"].deleted_from_13f_list
    events = {r.cusip: r for r in lists.membership_events(lists.parse_fixed_width(raw)).collect()}
    assert events["G0131Y100"].deleted_from_13f_list_quarter == "2024Q1" and len(events) == 2
    good = lists.line_fidelity_gate(lists.line_fidelity(raw, ["vintage"]), 4).first()
    short = rows("vintage string, value string", [("2024Q1", v[:79]) for v in LINES])
    bad = lists.line_fidelity_gate(lists.line_fidelity(short, ["vintage"]), 0).first()
    assert good.passed and not bad.passed


def word(text, x0, top):
    return ("d", 1, text, float(x0), top)


def test_positioned_words(rows):
    b = lists.ColumnBounds(10, 100, 300, 430)
    w = rows("doc string, page int, text string, x0 double, top double", [
        word("037833", 12, 50.0), word("10", 40, 51.0), word("0", 60, 52.4), word("*", 101, 50.0), word("APPLE", 120, 50.1), word("INC", 150, 50.0), word("COM", 310, 50.0),
        word("037833", 12, 52.6), word("100", 40, 52.6), word("APPLE", 120, 54.9), word("CALL", 310, 53.0),
    ])
    # 52.6 is more than 2.5 below the first word of the line at 50.0, though close to 52.4
    out = lists.parse_words(w, b).collect()
    assert [(r.cusip, r.issuer_name, r.issuer_description, r.added_marker) for r in out] == [("037833100", "APPLE INC", "COM", True)]
    p = lists.page_fidelity(w, b).first()
    assert (p.candidate_rows, p.option_rows, p.equity_rows, p.equity_cusip_valid) == (2, 1, 1, 1)
    assert not lists.page_row_floor(lists.parse_words(w, b), w, 2).first().passed


def test_source_index(rows):
    html = ''.join(f'<a href="{h}">x</a>' for h in [
        "/divisions/investment/13f/13flist2009q4.pdf", "/files/investment/13flist2025q3-txt.txt",
        "/files/investment/13flist2025q3.pdf", "/files/other.pdf", "/files/investment/13flist2025q3-txt.txt?x"])
    m = {r.vintage: r for r in lists.list_manifest(lists.source_index(rows("page_id int, html string", [(1, html)]))).collect()}
    assert m["2025Q3"].format == "txt" and m["2025Q3"].url == "https://www.sec.gov/files/investment/13flist2025q3-txt.txt"
    assert set(m) == {"2009Q4", "2025Q3"}


def test_evenly_spaced(rows):
    cases = rows("cik string, last_filing date", [(str(i), dt.date(2020, 1, 1 + i // 3)) for i in range(9)])
    assert sorted(r.cik for r in lists.evenly_spaced_cases(cases).collect()) == ["0", "2", "4", "6", "8"]


def test_quarter_plan(spark):
    got = [r.source_quarter for r in readers.quarter_plan(spark, 2026, 2026, 2).orderBy("source_quarter").collect()]
    assert got == ["2026q1", "2026q2"]
    with pytest.raises(ValueError):
        readers.quarter_plan(spark, 2008, 2009, 1)


def write_zip(path, sub, num):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("sub.txt", "\n".join("\t".join(r) for r in sub))
        z.writestr("num.txt", "\n".join("\t".join(r) for r in num))


def test_zip_to_cohort(spark, tmp_path):
    sub = [["adsh", "cik", "name", "form", "period", "filed"],
           ["a-1", "7", 'Quo"te', "10-K", "20231231", "20240215"], ["a-2", "8", "B", "8-K", "20231231", "20240215"]]
    num = [["adsh", "tag", "version", "ddate", "qtrs", "uom", "value", "coreg"],
           ["a-1", "Assets", "us-gaap", "20231231", "0", "USD", "50", ""],
           ["a-1", "ProfitLoss", "us-gaap", "20231231", "4", "USD", "5", ""],
           ["a-1", "Liabilities", "us-gaap", "20231231", "0", "EUR", "5", ""],
           ["a-2", "Assets", "us-gaap", "20231231", "0", "USD", "1", ""]]
    write_zip(tmp_path / "2024q1.zip", sub, num)
    write_zip(tmp_path / "2024q2.zip", sub, num)
    s = readers.submissions_of(readers.read_zip_tables(spark, str(tmp_path), "sub", sub[0]))
    n = readers.facts_from(readers.read_zip_tables(spark, str(tmp_path), "num", num[0]))
    one = s.filter("source_quarter = '2024q1'"), n.filter("source_quarter = '2024q1'").drop("source_quarter")
    panel = cohort.fundamentals(*one).collect()
    assert [(r.adsh, r.roa, r.source_quarter) for r in panel] == [("a-1", 0.1, "2024q1")]
    status = readers.source_status(readers.quarter_plan(spark, 2024, 2024, 3), readers.filing_name_source(s), s.select("cik").filter("cik = 7"))
    assert [(r.status, r.matched_rows) for r in status.orderBy("source_quarter").collect()] == [("retrieved", 1), ("retrieved", 1), ("source_not_published", 0)]
    man = files.file_manifest(spark, str(tmp_path), "*.zip")
    audit = files.cache_audit(readers.quarter_plan(spark, 2024, 2024, 3), man).orderBy("source_quarter").collect()
    assert [r.cached for r in audit] == [True, True, False]
    side = [(p, json.dumps({"sha256": hashlib.sha256((tmp_path / p).read_bytes()).hexdigest() if i == 0 else "x",
             "bytes": (tmp_path / p).stat().st_size, "acquired_utc": "2026-09-25T10:00:00+00:00"})) for i, p in enumerate(["2024q1.zip", "2024q2.zip"])]
    got = files.snapshot_check(man, spark.createDataFrame(side, "name string, value string")).orderBy("name").collect()
    assert [(r.passed, str(r.observed_through)) for r in got] == [(True, "2026-09-25"), (False, "2026-09-25")]


def test_tsv_and_schema_drift(spark, rows, tmp_path):
    (tmp_path / "2024q1").mkdir()
    (tmp_path / "2024q1" / "sub.txt").write_text("adsh\tcik\tname\tfiled\nx\t1\tACME\t20240101\n")
    raw = readers.read_tsv(spark, str(tmp_path / "2024q1" / "sub.txt"), ["adsh", "cik", "name", "filed"])
    r = readers.filing_name_source(raw).first()
    assert (r.cik, r.source_quarter, str(r.filed)) == ("0000000001", "2024q1", "2024-01-01")
    with pytest.raises(ValueError, match="name"):
        readers.filing_name_source(rows("adsh string, cik string, filed string", []))


def test_json_documents(spark, tmp_path):
    facts = {"cik": 7, "entityName": "E", "facts": {"us-gaap": {
        "StockholdersEquity": {"units": {"EUR": []}},
        "Revenues": {"units": {"USD": [{"val": 1, "filed": "2024-01-01", "end": "2023-12-31", "form": "10-K"},
                                        {"val": 2, "filed": "2025-01-01", "end": "2024-12-31", "form": "10-K"}]}},
        "RevenueFromContractWithCustomerExcludingAssessedTax": {"units": {"USD": []}}}}}
    (tmp_path / "f.json").write_text(json.dumps(facts))
    r = readers.company_fact_record(readers.read_documents(spark, str(tmp_path)), "2024-06-30").first()
    assert r.cik == "7" and r.revenue is None and r.equity is None
    del facts["facts"]["us-gaap"]["RevenueFromContractWithCustomerExcludingAssessedTax"]
    (tmp_path / "f.json").write_text(json.dumps(facts))
    assert readers.company_fact_record(readers.read_documents(spark, str(tmp_path)), "2024-06-30").first().revenue == 1.0


def test_text_lines(rows):
    got = readers.cik_names(rows("value string", [("ACME: HOLDINGS:42:",), ("NO CIK:",), ("X:abc:",)])).collect()
    assert [(r.cik, r.historical_name) for r in got] == [("0000000042", "ACME: HOLDINGS")]
    t = readers.ticker_map(rows("value string", [('{"0":{"cik_str":1,"ticker":"aapl","title":"A"}}',)])).first()
    assert (t.cik, t.ticker) == ("0000000001", "AAPL")


def test_document_selection(rows):
    names = ["main.htm", "ex4-1.htm", "ex2_1.txt", "ex21.htm", "logo.jpg", "page-index.htm"]
    d = [("1", "a", n, i, "main.htm") for i, n in enumerate(names)] + [("1", "b", n, i, None) for i, n in enumerate(names)]
    out = evidence.select_documents(rows("cik string, accession string, name string, position int, primary_document string", d)).collect()
    a = {r.name for r in out if r.accession == "a"}
    b = {r.name for r in out if r.accession == "b"}
    assert a == {"main.htm", "ex4-1.htm", "ex2_1.txt"} and b == {"main.htm", "ex4-1.htm", "ex2_1.txt", "ex21.htm"}


def test_sinks(spark, rows, tmp_path):
    f = rows("adsh string, cik string, filed date", [("a", "1", dt.date(2020, 1, 1)), ("b", "1", dt.date(2021, 1, 1))])
    files.write_partitioned(f, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.filter("filed_year = 2021").count() == 1
    files.write_csv(f, str(tmp_path / "c"))
    files.write_report(f, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, schema="adsh string, cik string, filed string").count() == 2
    assert spark.read.text(str(tmp_path / "r")).first().value.startswith('{"adsh"')


def test_contracts(rows):
    p = rows("security_id string, date string, close double, volume double, source string, retrieved_at string",
             [("A", "d", 0.0, 1.0, "s", "t"), ("A", "d", 1.0, -1.0, "s", "t")])
    c = checks.price_plausibility(p).first()
    assert (c.non_positive_close, c.negative_volume, c.duplicate_key_rows, c.passed) == (1, 1, 1, False)
    with pytest.raises(ValueError):
        checks.require(checks.price_contract(p), "prices")
    with pytest.raises(ValueError, match="volume"):
        checks.price_contract(p.drop("volume"))
    f = rows("has_market_data boolean, distress_12m int", [(True, 1), (True, 0), (False, 0)])
    assert not checks.survivorship_gate(f).first().passed
    assert not checks.same_row_count(f, f.limit(1)).first().passed


def test_archives_and_digests_are_streamed(spark, tmp_path):
    """A member of many batches, written by parts; column order and absent columns as asked for."""

    from knowndate.sources import streams

    rows = 120_000
    with zipfile.ZipFile(tmp_path / "2024q3 x%.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("NUM.tsv", "w") as out:
        out.write(b"adsh\ttag\tvalue\n")
        for k in range(rows):
            out.write(b"a%d\tT\t%s\n" % (k, b"" if k % 3 == 0 else b"%d" % k))
    got = readers.read_zip_tables(spark, str(tmp_path), "num", ["value", "nothing", "adsh"])
    assert got.columns == ["value", "nothing", "adsh", "source_quarter"]
    r = got.agg(F.count("*").alias("n"), F.count("value").alias("v"), F.count("nothing").alias("e"), F.sum("value").alias("s")).first()
    assert (r.n, r.v, r.e, r.s) == (rows, 80_000, 0, sum(k for k in range(rows) if k % 3))
    assert {x.source_quarter for x in got.select("source_quarter").distinct().collect()} == {"2024q3"}
    big = tmp_path / "big.bin"
    big.write_bytes(bytes(range(256)) * 80_000)  # more than two blocks
    (tmp_path / "small.bin").write_bytes(b"x")
    man = {m.name: m for m in files.file_manifest(spark, str(tmp_path), "*.bin").collect()}
    for name in ("big.bin", "small.bin"):
        data = (tmp_path / name).read_bytes()
        assert man[name].sha256 == hashlib.sha256(data).hexdigest() and man[name].bytes == len(data)
    assert streams.streamed_uri("viewfs://x/y") is None and streams.streamed_uri("s3a://b/k") == "s3://b/k"
    assert files.file_manifest(spark, str(tmp_path), "*.none").count() == 0


def test_list_pieces_are_computed_once_and_rows_dealt_out(spark, tmp_path, capsys):
    parts = [(k, "almond blue", "Brand#1", "T", 5, 1.0) for k in range(40)]
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame(parts, schema).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    lines = source_queries._parts(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    out = source_queries.pdf_text(spark, str(tmp_path))
    out.explain()
    plan = capsys.readouterr().out
    # eight characters, each named twice, of the made check digit and of the checked one; five references to a piece of the line
    assert plan.count("instr(") <= 32 and plan.count("regexp_extract(") <= 5
    kept = [k for k in range(40) if k % 17 and k % 31]
    assert out.count() == len(kept)
    assert {r.row_text for r in out.collect()} <= {f"{n} {d} ADDED" for n in ("ALMOND BLUE BRAND#1", "INC") for d in ("COM", "CALL", "PUT")}
