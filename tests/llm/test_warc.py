import base64
import hashlib
import struct

import pytest
import zstandard
from quarry.llm import queries, warc

DATE = "2024-01-01T00:00:00Z"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(pages, least=0):
    first = {}
    for page, html in pages:
        data = (html or "").encode()
        if page is not None and len(data) >= least:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, html in pages:
        data = (html or "").encode()
        to = first.get(data, page)
        again = page is not None and to != page
        out.append((page, len(data), digest(data), "revisit" if again else "response", to if again else None))
    return sorted(out, key=repr)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_whole_table(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    assert got(queries.op1_warc(spark, sf)) == brute(pages)


@pytest.mark.parametrize("least", [0, 5])
def test_edges(spark, least):
    pages = [(3, "u", "same page"), (1, None, "same page"), (2, "a b\r\nc é", None), (9, "", ""), (None, "u", "same page"), (4, "v", "é" * 300000), (5, "v", "\r\n\r\nHTTP/1.1"), (1, "w", "same page"), (7, "x", "tiny"), (8, "x", "tiny")]
    df = spark.createDataFrame([(*p, "zz", 1) for p in pages], "page_id long, url string, html string, payload string, size int")
    read = warc.round_trip(df, min_revisit_bytes=least, archive_bytes=2000)
    assert got(read) == brute([(i, h) for i, _, h in pages], least)
    back = {r.page_id: r.payload for r in read.where("record_type = 'response' and page_id > 3").collect()}
    assert back[4].decode() == "é" * 300000 and back[5] == b"\r\n\r\nHTTP/1.1"
    assert warc.round_trip(df.limit(0)).count() == 0


def test_ids_of_any_characters(spark):
    pages = [("a\r\nWARC-Type: x", "u", "one"), (" b ", "u", "one"), ("%41", "u", "two"), ("A", "u", "two"), ("é:\t", "u", "three"), ("", "u", "three")]
    df = spark.createDataFrame(pages, "page_id string, url string, html string")
    assert got(warc.round_trip(df)) == brute([(i, h) for i, _, h in pages])


def test_stores(spark, tmp_path):
    assert warc.qualified(spark, str(tmp_path)) == f"file:{tmp_path}" and warc.filesystem(f"file:{tmp_path}")[1] == warc.filesystem(f"file://{tmp_path}")[1] == str(tmp_path)
    df = spark.createDataFrame([(i, "u", "x" * 200_000 + str(i)) for i in range(4)], "page_id long, url string, html string")
    assert warc.write_archives(df, f"{tmp_path}/a b", sample_bytes=1000) == 4
    names = list((tmp_path / "a b").glob("*.zst"))
    assert names and all(struct.unpack_from("<I", x.read_bytes())[0] == warc.DICTIONARY_MAGIC for x in names)
    assert sorted(r.page_id for r in warc.read_archives(spark, f"{tmp_path}/a b").collect()) == [0, 1, 2, 3]
    with pytest.raises(warc.ArchiveError, match="share"):  # archives of another run in the folder, or none of this one
        warc.write_archives(df.limit(1).repartition(1), f"{tmp_path}/a b")


def archive(records, dictionary=b"", compress=True):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    pack = zstandard.ZstdCompressor(dict_data=shared)
    return (warc.leading_frame(dictionary, compress) if dictionary else b"") + b"".join(pack.compress(r) for r in records)


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("dictionary", [b"", b"raw words of a dictionary " * 20])
def test_archives(dictionary, compress):
    records = [warc.record(str(i), f"http://x/{i}", b"payload %d " % i * i * 2000, digest(b"payload %d " % i * i * 2000), None, DATE) for i in range(5)]
    records.append(warc.record("9", None, b"abc", digest(b"abc"), "2", DATE))
    data = archive(records, dictionary, compress)
    read = list(warc.read_archive(data))
    assert [r["payload"] for _, r in read] == [b"payload %d " % i * i * 2000 for i in range(5)] + [None]
    assert [r["type"] for _, r in read] == ["response"] * 5 + ["revisit"]
    assert (struct.unpack_from("<I", data)[0] == warc.DICTIONARY_MAGIC) == bool(dictionary)
    for cut in (len(data) - 1, len(data) - 9, 11):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_archive(data[:cut]))


def test_broken_records():
    good = warc.record("1", "u", b"body", digest(b"body"), None, DATE)
    assert warc.parse_record(good)["payload"] == b"body"
    bad = [
        good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WORC/1.1"), good.replace(b"Content-Length: 4\r\n", b"Content-Length: 5\r\n"),
        good.replace(b"body\r\n", b"bodY\r\n"), good.replace(b"WARC-Date", b"WARC-Dote"), good.replace(b"WARC-Type: response", b"WARC-Type: revisit"),
        good + good, b"", good.replace(b"X-Page-Id: 1", b"X-Page-Id"), good.replace(b"WARC-Date", b"WARC-Type"),
    ]
    for data in bad:
        with pytest.raises(warc.ArchiveError):
            list(warc.read_archive(archive([data])))
