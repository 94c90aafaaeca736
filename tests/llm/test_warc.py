import gzip
import hashlib

import pytest

from leadloom.llm import warc


@pytest.fixture(scope="module")
def rows():
    long, other = "<p>é</p>" * 200, "<b>x</b>" * 150
    out = [(i, f"http://www.Host.example:80/p/{i}?q=a b", long) for i in range(0, 60, 2)] + [(i, "https://other.example/hot", other) for i in range(1, 60, 2)]
    out += [(100, None, None), (101, "", "short"), (102, "http://a.example", "short"), (103, "http://a.example", None), (None, "http://n.example", long),
            (104, "http://u:p@b.example:8080/x#f", "\r\n\r\nWARC/1.1\r\n" * 100), (105, "http://x.example/\t\r\ny", "z" * 300_000), (106, "http://same.example", long + "1"), (106, "http://same.example", long + "1")]
    return out


def plain(rows):
    top = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 1000 and i is not None:
            top[html] = max(i, top.get(html, i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        last = top.get(html) if len(raw) >= 1000 and i is not None else None
        again = last is not None and i < last
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(map(str, out))


def made(df):
    return sorted(str(tuple(r)) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def test_round_trip(spark, rows, monkeypatch):
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    want = plain(rows)
    got = made(warc.archive_round_trip(pages))
    # rows equal in id and address are found once for each record
    assert got == want


def test_small_blocks_and_files(spark, rows, tmp_path, monkeypatch):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(warc, "FILE_BYTES", 4 * (4096 + max(len((h or "").encode()) for _, _, h in rows)))  # four records a file
    monkeypatch.setattr(warc, "PART", 3)
    assert warc.records_for(1 << 40) == 1 and warc.records_for(0) > 1
    warc.write_archives(pages.repartition(3), f"{tmp_path}/a")
    warc.write_index(spark, f"{tmp_path}/a", f"{tmp_path}/i", block=3)
    every = pages.select(warc.capture_of().alias("capture"))
    assert made(warc.look_up(every, f"{tmp_path}/i")) == plain(rows)
    none = spark.createDataFrame([("zz", ), ("", ), ("example,host)/p/1 x", )], "capture string")
    assert warc.look_up(none, f"{tmp_path}/i").count() == 0
    blocks = spark.read.parquet(f"{tmp_path}/i/directory")
    assert blocks.count() >= len(rows) // 3


def test_archives_are_gzip_of_whole_records(spark, rows, tmp_path):
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/a")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("a/part-*"))
    assert data.count(b"WARC-Record-ID: ") == len(rows) and data.endswith(b"\r\n\r\n")
    assert b"WARC-Refers-To: <urn:page:58>" in data


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(pages).count() == 0


def test_keys():
    assert warc.url_key("http://www.A.Example.com:80/p?q#f") == "com,example,a)/p?q"
    assert warc.url_key("https://u@h.example:8080/") == "example,h:8080)/"
    assert warc.url_key(None) == warc.url_key("") == "-"
    assert warc.url_key("h.example?x y") == "example,h)/?x%20y"
    ids = [None, -(1 << 63), -5, 0, 7, (1 << 63) - 1]
    keys = [warc._capture("k", i) for i in ids]
    assert keys == sorted(keys)
