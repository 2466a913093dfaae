from hashlib import sha256

from quern.llm import warc
from quern.llm.warc import CaptureIndex, parse_record, read_archives, url_key, write_archives

SCHEMA = "page_id long, url string, html string, digest string"
BODY = "<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 100


def rows():
    out = [(i, f"http://h{i % 3}.Example.com/p/{i}?q=1#f", f"<p>{i}</p>" + "y" * (i * 7), "d") for i in range(60)]
    out += [(100 + i, f"https://copy.example/{i}", BODY, "d") for i in range(40)]
    return out + [(200, None, None, "d"), (201, "http://a\r\nb", "", "d"), (202, "http://short/", "same", "d"), (203, "http://short/", "same", "d"), (204, "http://long/", "z" * 500_000, "d")]


def brute(data):
    first = {}
    for i, _, h, _ in data:
        if len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    out = {}
    for i, _, h, _ in data:
        b = (h or "").encode()
        refers = first[h] if h in first and first[h] != i else None
        out[i] = (len(b), sha256(b).hexdigest(), "revisit" if refers is not None else "response", refers)
    return out


def test_written_read_and_found_again(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    write_archives(df, f"file://{tmp_path}/archives")
    index = CaptureIndex.build(read_archives(spark, f"file://{tmp_path}/archives"), f"file://{tmp_path}/index")
    asked = spark.createDataFrame([*data, data[3], (900, "http://nowhere/", "", ""), (901, "http://h1.example.com/P/1?q=1", "", "")], SCHEMA)
    found = index.read_all(index.lookup_all(asked)).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found} == brute(data) and len(found) == len(data)
    for i, url, html, _ in [data[5], data[-1], data[60]]:
        entry = next(e for e in index.lookup(url) if e["page_id"] == i)
        headers, payload = index.fetch(entry)
        assert payload.decode() == html and headers["warc-type"] == "response"
    entry = next(e for e in index.lookup(data[70][1]) if e["page_id"] == 110)
    assert index.fetch(entry)[1] == b"" and entry["refers_to"] == 100
    assert {e["page_id"] for e in index.lookup("http://short/")} == {202, 203}
    assert index.lookup("http://nowhere/") == [] and index.lookup(data[5][1].replace("/p/", "/P/")) == []
    assert [e["page_id"] for e in index.lookup(None)] == [200]
    keys = [r.first_key for r in spark.read.parquet(f"file://{tmp_path}/index/directory").collect()]
    assert sorted(keys) == sorted(set(keys)) or len(keys) == 1


def test_archives_are_plain_warc(spark, tmp_path):
    write_archives(spark.createDataFrame(rows(), SCHEMA).coalesce(1), f"file://{tmp_path}/a")
    n = 0
    for path in (tmp_path / "a").glob("part-*"):
        data, at = path.read_bytes(), 0
        while at < len(data):
            headers, block, at = parse_record(data, at)
            assert len(block) == int(headers["content-length"])
            n += 1
    assert n == len(rows())


def test_keys_and_empty(spark, tmp_path):
    assert url_key("https://u@www.Example.com:80/A/b?c#d") == "com,example,www:80)/A/b?c"
    assert url_key(None) == ")" and url_key("http://x") == "x)/"
    write_archives(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/e")
    assert read_archives(spark, f"file://{tmp_path}/e").collect() == []
    index = CaptureIndex.build(read_archives(spark, f"file://{tmp_path}/e"), f"file://{tmp_path}/i")
    asked = spark.createDataFrame([(1, "http://x/", "", "")], SCHEMA)
    assert index.read_all(index.lookup_all(asked)).collect() == [] and index.lookup("http://x/") == []


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100_000)
    data = [(i, f"http://tiny/{i}", "t", "") for i in range(500)] + [(1_000 + i, f"http://large/{i}", f"{i}" + "x" * 40_000, "") for i in range(20)] + [(2_000, "http://huge/", "h" * 300_000, "")]
    write_archives(spark.createDataFrame(data, SCHEMA).coalesce(1), f"file://{tmp_path}/a")
    sizes = sorted(p.stat().st_size for p in (tmp_path / "a").glob("part-*") if p.stat().st_size)
    assert sizes[-2] <= 100_004 < sizes[-1] and len(sizes) < 20


def test_many_blocks_and_a_coarse_directory(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "DIRECTORY_ENTRIES", 12)
    data = [(i, f"http://hot/{i % 3 if i % 2 else i}", f"{i}", "") for i in range(300)]
    write_archives(spark.createDataFrame(data, SCHEMA).repartition(3), f"file://{tmp_path}/archives")
    index = CaptureIndex.build(read_archives(spark, f"file://{tmp_path}/archives"), f"file://{tmp_path}/index")
    assert index.blocks().count() > 40 and len(index.directory()[0]) <= 12
    found = index.read_all(index.lookup_all(spark.createDataFrame(data, SCHEMA))).collect()
    assert sorted(r.page_id for r in found) == list(range(300))
    assert sorted(e["page_id"] for e in index.lookup("http://hot/1")) == [i for i in range(300) if data[i][1] == "http://hot/1"]
    monkeypatch.setattr(warc, "_ranged", lambda path: (_ for _ in ()).throw(ValueError(path)))
    assert sorted(r.page_id for r in index.read_all(index.lookup_all(spark.createDataFrame(data, SCHEMA))).collect()) == list(range(300))


def test_null_and_repeated_ids(spark, tmp_path):
    data = [(None, "http://n/", BODY, "d"), (7, "http://a/", BODY, "d"), (7, "http://a/", BODY, "d"), (9, "http://b/", BODY, "d"), (None, None, "alone" * 30, "d")]
    write_archives(spark.createDataFrame(data, SCHEMA), f"file://{tmp_path}/archives")
    index = CaptureIndex.build(read_archives(spark, f"file://{tmp_path}/archives"), f"file://{tmp_path}/index")
    found = index.read_all(index.lookup_all(spark.createDataFrame(data, SCHEMA))).collect()
    told = sorted(((str(r.page_id), r.record_type, r.refers_to) for r in found), key=str)
    assert told == sorted([("None", "revisit", 7), ("7", "response", None), ("7", "response", None), ("9", "revisit", 7), ("None", "response", None)], key=str)
