import base64
import gzip
import hashlib

import pytest
from helpers import key

from panelcf.llm import warc
from panelcf.llm.common import shared_path

PAGES = [(i, f"http://{'www.' if i % 2 else ''}host{i % 7}.example.com:80/p/{i % 11}?q={i % 3}#x", f"<p>payload {i % 9}</p>" * (i % 5), "extra") for i in range(80)] + [
    (500, None, "<p>no url</p>", None), (501, "http://[broken", None, None), (502, "http://host.example.com/a\r\nX: 1 ä", "", None),
    (503, "", "é漢", None), (None, "http://host1.example.com/null", "<p>payload 3</p>", None), (7, PAGE7 := "http://host0.example.com/again", "long " * 50000, None),
]
SCHEMA = "page_id long, url string, html string, file string"


def brute(pages, least=0):
    out = []
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for i, _, h, _ in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    many = [h or "" for _, _, h, _ in pages]
    for i, _, h, _ in pages:
        size = len((h or "").encode())
        to = first.get(h or "")
        revisit = i is not None and size >= least and many.count(h or "") > 1 and to != i
        out.append((i, size, digest(h), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=key)


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(3)
    got = warc.archive_and_replay(pages, least).collect()
    assert sorted(map(tuple, got), key=key) == brute(PAGES, least)


def test_lookup_reads_only_what_it_needs(spark):
    folder = "file://" + shared_path(spark, "test-warc")
    pages = spark.createDataFrame(PAGES, SCHEMA)
    captures = warc.write_archives(pages, folder)
    index = warc.write_index(captures, folder, block_lines=3)
    wanted = [PAGES[5][1], PAGE7, "http://nowhere.example.com/", None, PAGES[16][1]]
    got = warc.lookup(spark.createDataFrame([(u,) for u in wanted * 2], "url string"), index).collect()
    keys = {warc.url_key(u) for u in wanted}
    want = [(r["urlkey"], r["page_id"], r["file"], r["offset"]) for r in captures.collect() if r["urlkey"] in keys]
    assert sorted(((r["urlkey"], r["page_id"], r["file"], r["offset"]) for r in got), key=key) == sorted(want, key=key)
    one = got[0]
    with open(one["file"].removeprefix("file://"), "rb") as f:
        f.seek(one["offset"])
        raw = gzip.decompress(f.read(one["length"]))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_url_keys():
    assert warc.url_key("https://WWW.Example.com:443/A?b=1#c") == "com,example,www)/A?b=1"
    assert warc.url_key("http://example.com:8080") == "com,example:8080)/"
    assert warc.url_key(None) == warc.url_key("") == "-" and " " not in warc.url_key("http://e.com/a b\n")


def test_damage_is_noticed():
    good = warc.record("http://e.com/", 1, b"abc", warc.payload_digest(b"abc"), None)
    assert warc.read_record(good)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.read_record(warc.record("http://e.com/", 1, b"abc", warc.payload_digest(b"abd"), None))


def test_empty_table(spark):
    assert warc.archive_and_replay(spark.createDataFrame([], SCHEMA)).collect() == []
