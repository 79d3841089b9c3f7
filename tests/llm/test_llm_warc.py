import hashlib
from collections import Counter

from pageflow.llm import warc
from pageflow.llm.common import shared_path

LONG = "<p>é</p>" * 40
PAGES = [
    (1, "https://B.example.com:8080/a?x=1#f", LONG), (2, "http://a.example.com/", LONG), (3, None, None), (4, "", ""), (5, "http://x.org/\r\nWARC-Type: revisit", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20),
    (6, "http://[bad", "short"), (7, "http://x.org/", "short"), (2, "http://a.example.com/", LONG), (None, "http://n.org", LONG), (None, None, None), (0, "http://x.org/", LONG + "x"), (8, "http://x.org/", "\n" * 200),
    (9, "http://x.org/" + "p" * 5000, "🙂" * 100000),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, n int, key string")


def plain(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = first.get(h or "")
        later = len(raw) >= 100 and to is not None and to != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if later else "response", to if later else None))
    return out


def test_round_trip(spark):
    assert Counter(map(tuple, warc.captures(spark, frame(spark, PAGES)).collect())) == Counter(plain(PAGES))


def test_small_blocks_and_hot_url(spark, monkeypatch):
    rows = [(i, "http://hot.org/a" if i % 3 else f"http://h{i % 7}.org/{i}", f"body {i % 50} " * 20) for i in range(700)]
    path = warc.write_archives(frame(spark, rows), shared_path(spark, "warc"), file_records=64)
    index = warc.build_index(spark, path, block=8).cache()
    assert index.count() >= 700 / 8
    found = warc.look_up(index, frame(spark, rows[::10] + [(9999, "http://hot.org/a", "")]))
    assert sorted(r["page_id"] for r in found.collect()) == [r[0] for r in rows[::10]]
    assert warc.read_records(spark, path, found).filter("record_type = 'response' AND NOT same").count() == 0


def test_folders_that_only_spark_opens(spark, monkeypatch):
    monkeypatch.setattr(warc, "_opens", lambda path: False)
    assert Counter(map(tuple, warc.captures(spark, frame(spark, PAGES)).collect())) == Counter(plain(PAGES))


def test_archives_are_valid(spark):
    path = warc.write_archives(frame(spark, PAGES), shared_path(spark, "warc"))
    for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect():
        at = 0
        for a, n, fields in warc.records(bytes(r["content"])):
            assert a == at and fields["warc-type"] in ("response", "revisit")
            assert bytes(r["content"])[a + n : a + n + 4] == b"\r\n\r\n"
            at = a + n + 4
        assert at == len(r["content"])


def test_files_are_bounded_by_bytes(spark, monkeypatch):
    """Pages of every size in one partition: no file is much larger than the bound, unless it holds a single record."""
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)
    rows = [(k, f"http://x.org/{k}", f"{k} " * 40) for k in range(300)] + [(1000 + k, f"http://y.org/{k}", f"{k}é" * (3000 * (k + 1))) for k in range(12)] + [(2000, "http://z.org/" + "u" * 300_000, None)]
    path = warc.write_archives(frame(spark, rows).coalesce(1), shared_path(spark, "warc"), file_records=100)
    files = [(bytes(r["content"]), len(list(warc.records(bytes(r["content"]))))) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    assert sum(n for _, n in files) == len(rows) and max(n for _, n in files) == 100
    assert all(len(c) <= 300_000 or n == 1 for c, n in files)
    assert Counter(map(tuple, warc.captures(spark, frame(spark, rows)).collect())) == Counter(plain(rows))


def test_sort_keys():
    assert warc.surt("https://B.example.com:8080/a?x=1#f") == "com,example,b:8080)/a?x=1"
    assert warc.surt("http://a.org") == "org,a)/"
    assert warc.surt(None) == ""


def test_empty_table(spark):
    assert warc.captures(spark, frame(spark, PAGES).limit(0)).count() == 0
