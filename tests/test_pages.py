"""A harvest that stops after any page and goes on with the same rows."""

import pytest

from lamella.streaming import pages

RECORD = '<record><header{}><identifier>oai:{}</identifier><datestamp>2026-0{}-01</datestamp></header><metadata><dc:dc xmlns:dc="d"><dc:title>Title  {}</dc:title><dc:description>about &lt;b&gt;</dc:description><dc:identifier>https://x/{}</dc:identifier></dc:dc></metadata></record>'


def page(numbers, token):
    rows = "".join(RECORD.format(' status="deleted"' if n == 3 else "", n, n % 9 + 1, n, n) for n in numbers)
    return f'<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>{rows}{token}</ListRecords></OAI-PMH>'


PAGES = [(None, page([1, 2], "<resumptionToken>a/b|1</resumptionToken>")), ("a/b|1", page([3], '<resumptionToken cursor="2">t 2</resumptionToken>')), ("t 2", page([4, 5], "<resumptionToken>last</resumptionToken>")), ("last", '<OAI-PMH><error code="noRecordsMatch">none</error><resumptionToken>stale</resumptionToken></OAI-PMH>')]


@pytest.mark.parametrize("stops", [1, 2, 3, 4])
def test_harvest_goes_on(spark, tmp_path, stops):
    root, out = tmp_path / "pages", str(tmp_path / "out")
    root.mkdir()
    run = lambda: pages.harvest(pages.records(pages.page_stream(spark, str(root), 2)), out, str(tmp_path / "ck"))
    for part in (PAGES[:stops], PAGES[stops:]):
        for token, body in part:
            open(pages.page_path(str(root), token), "w").write(body)
        run()
    got = sorted((r.page, r.record_id, r.modified, r.deleted, r.title, r.text, tuple(r.links)) for r in spark.read.parquet(out).collect())
    assert got == [(p, f"oai:{n}", f"2026-0{n + 1}-01", n == 3, f"Title {n}", "about <b>", (f"https://x/{n}",)) for p, n in ((0, 1), (0, 2), (1, 3), (2, 4), (2, 5))]
    run()
    assert spark.read.parquet(out).count() == 5


def test_pages(spark, tmp_path):
    write = lambda name, body: (tmp_path / name).write_text(body)
    write("start.xml", page([7, 2], ""))
    assert pages.read_page(str(tmp_path / "start.xml")) == (None, None) and pages.read_page(str(tmp_path / "x.xml")) is None
    write("bad.xml", '<OAI-PMH><error code="badResumptionToken"/></OAI-PMH>')
    assert pages.read_page(str(tmp_path / "bad.xml")) == (None, "badResumptionToken")
    frame = spark.createDataFrame([(0, str(tmp_path / "start.xml"), None), (1, str(tmp_path / "bad.xml"), "badResumptionToken")], "page long, path string, error string")
    assert [r.record_id for r in pages.records(frame, since="2026-05").collect()] == ["oai:7"]
