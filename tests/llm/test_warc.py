import gzip
import io
import random

import pytest

from lumenfold.llm import warc

from .helpers import write

PAGES = "page_id long, url string, html string, archive string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    r = random.Random(k)
    runs = [sorted(((r.choice("abc"), "", r.choice([None, 1, 2, 3])) for _ in range(r.randint(0, 30))), key=warc.merge_key) for _ in range(k)]
    assert [warc.merge_key(x) for x in warc.LoserTree([iter(x) for x in runs])] == sorted(warc.merge_key(x) for run in runs for x in run)


def test_url_key():
    assert warc.url_key("HTTPS://www.Example.com:443/a?b=1#c") == "com,example)/a?b=1" == warc.url_key("http://example.com/a?b=1")
    assert warc.url_key("http://x.org:8080") == "org,x:8080)/" and warc.url_key(None) == ""


def test_contract_on_awkward_pages(spark, tmp_path):
    big, tricky = "<p>" + "é" * 60 + "</p>", "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 3\r\n\r\n" * 5
    rows = [(9, "http://b.org/x", big), (3, "http://a.org/\r\nx", big), (5, None, big), (1, "http://a.org", "small"), (2, "http://a.org", "small"), (4, "u", None), (6, "u", ""), (7, "http://a.org", tricky), (8, "http://a.org", tricky), (None, "n", big), (3, "http://a.org/again", big)]
    rows += [(100 + i, f"http://hot.org/{i % 3}", "hot page " * 20) for i in range(300)]
    sf = write(tmp_path, pages=pages(spark, rows))
    import duckdb

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet/*.parquet'")
    key = lambda r: tuple(str(x) for x in r)
    ours = sorted((tuple(r) for r in warc.op1_warc(spark, sf).collect()), key=key)
    assert ours == sorted(duck.execute(warc.OP1_SQL).fetchall(), key=key)
    assert {r[0]: r[4] for r in ours if r[0] in (5, 8, 9)} == {5: 3, 8: 7, 9: 3}


def test_history_is_globally_ordered(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, f"http://h{r.randint(0, 4)}.org/{r.randint(0, 9)}", f"page {i}") for i in range(500)]
    found = warc.capture_history(pages(spark, rows)).orderBy("range_no", "position").collect()
    assert [(x.url_key, x.captured, x.page_id) for x in found] == sorted((x.url_key, x.captured, x.page_id) for x in found) and len(found) == 500


def test_one_url_without_ids_is_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 50)
    rows = [(None, "http://one.org/", f"page {i}") for i in range(600)] + [(7, "http://one.org/", "x")] * 300
    found = warc.capture_history(pages(spark, rows)).orderBy("range_no", "position").collect()
    sizes = {}
    for x in found:
        sizes[x.range_no] = sizes.get(x.range_no, 0) + 1
    assert len(found) == 900 and max(sizes.values()) < 300
    keys = [warc.merge_key((x.url_key, x.captured, x.page_id)) for x in found]
    assert keys == sorted(keys)


def test_large_pages_stand_in_archives_of_few_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 80_000)
    monkeypatch.setattr(warc, "FILE_RECORDS", 80)
    rows = [(i, "http://a.org/", f"{i} " + "y" * (50 if i % 4 else 30_000 * (1 + i % 8))) for i in range(200)]
    path = str(tmp_path / "arc")
    warc.write_archives(pages(spark, rows), path)
    found = warc.read_runs(spark, path).collect()
    held = {}
    for x in found:
        held.setdefault(x.run, []).append(x.payload_bytes)
    assert len(found) == 200 and all(len(v) == 1 or sum(v) <= 8 * 80_000 for v in held.values())


def test_damage_is_found():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: d\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 41\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nabc!\r\n\r\n"
    with pytest.raises(ValueError, match="damaged"):
        list(warc.parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(record)))), "a"))


def test_empty(spark, tmp_path):
    assert warc.op1_warc(spark, write(tmp_path, pages=pages(spark, []))).count() == 0
