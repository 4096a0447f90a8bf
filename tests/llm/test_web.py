"""2 and 4: URLs and archives."""

import base64
import gzip
import hashlib
import tracemalloc
import zlib

import pytest

from huespan.llm import url_filter, warc
from huespan.llm.common import shared_path

# 4


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data, least = (h or "").encode(), first.get(h or "")
        again = least is not None and i != least
        out.append((-1 if i is None else i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", least if again else None))
    return sorted(out, key=str)


def written(spark, rows, **options):
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    path = shared_path(spark, "warc")
    warc.write_archives(warc.plan_captures(pages), path, **options)
    return path


ROWS = [(3, "http://a/b?c", "<p>é</p>"), (1, "http://a/", "<p>é</p>"), (2, None, None), (7, "u", ""), (9, "x\r\ny", "body\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (None, "n", "<p>é</p>"), (4, "http://big", "z" * 200_000), (1, "http://a/", "<p>é</p>")]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, compression):
    path = written(spark, ROWS, compression=compression, piece_bytes=300, file_bytes=600)
    got = warc.capture_digest(warc.assemble(warc.read_archives(spark, path, payloads=False))).collect()
    assert sorted(((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(ROWS)
    assert sorted((str(r.page_id), r.url) for r in got) == sorted((str(i), u or "") for i, u, _ in ROWS)


def test_names_and_members(spark, tmp_path):
    rows = [*ROWS, (12, " blank ", "<p>é</p>"), (12, " blank ", "<p>é</p>"), (2, None, None)]
    path = written(spark, rows)
    records = warc.read_archives(spark, path).collect()
    names = [r.record_id for r in records]
    assert len(set(names)) == len(names) == 3 * len(rows)
    answers = {r.record_id: r for r in records if r.warc_type == "response"}
    revisits = [r for r in records if r.warc_type == "revisit"]
    assert revisits and all(answers[r.refers_to].payload_digest == r.payload_digest for r in revisits)
    files = [r.content for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    for data in map(bytes, files):  # every member is one whole record, or empty
        at = 0
        while at < len(data):
            d = zlib.decompressobj(31)
            one = d.decompress(data[at:])
            assert not one or one.startswith(b"WARC/1.1\r\n") and len(list(warc.parse_records([one]))) == 1
            at = len(data) - len(d.unused_data)


def test_large_payloads_are_read_in_steps():
    payload = bytes(range(256)) * 40_000  # 10 MB
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" % (len(payload) + 19) + payload + b"\r\n\r\n"
    data = warc.member(record) * 30
    tracemalloc.start()
    got = [r["payload_bytes"] for r in warc.parse_records(warc.unpack(data), payloads=False)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [len(payload)] * 30 and peak < 6 * len(payload)


def test_captures_are_nested_and_whole(spark):
    path = written(spark, ROWS)
    rows = warc.assemble(warc.read_archives(spark, path)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.request.concurrent_to == r.response.record_id == r.metadata.concurrent_to == r.capture_id
        assert r.request.target_uri == r.response.target_uri
        if r.response.warc_type == "response":
            assert len(r.response.payload) == r.response.payload_bytes and r.response.http_status == 200


def test_missing_parts_and_damage(spark):
    record = lambda head, block: b"WARC/1.0\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    data = record(b"WARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\n", b"x") + b"WARC/1.0\r\nbroken\r\n\r\n" + record(b"WARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Type: application/http\r\n", b"HTTP/1.1 404 No\r\n\r\nhi") + record(b"WARC-Type: request\r\nWARC-Record-ID: <b>\r\nWARC-Concurrent-To: <lost>\r\n", b"")
    cut = data + b"WARC/1.0\r\nContent-Length: 50\r\n\r\nshort"
    got = list(warc.parse_records(warc.unpack(cut, 7)))
    assert [r["warc_type"] for r in got] == ["warcinfo", "response", "request"]
    assert got[1]["http_status"] == 404 and got[1]["payload"] == b"hi"
    assert b"".join(warc.unpack(gzip.compress(data[:10]) + gzip.compress(data[10:]), 5)) == data


def test_empty_table(spark):
    path = written(spark, ROWS[:1])
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    empty = shared_path(spark, "warc")
    warc.write_archives(warc.plan_captures(pages), empty)
    assert warc.assemble(warc.read_archives(spark, empty)).count() == 0
    assert warc.assemble(warc.read_archives(spark, path)).count() == 1


def test_min_bytes_keeps_small_payloads_apart(spark):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "yyy"), (4, "d", "yyy")], "page_id long, url string, html string")
    assert {r.page_id: r.refers_to for r in warc.plan_captures(pages, min_bytes=3).collect()} == {1: None, 2: None, 3: None, 4: 3}


# 2


def judged(spark, urls, outcomes=(), **options):
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    known = spark.createDataFrame(list(outcomes), "page_id long, good int")
    return {r.page_id: r for r in url_filter.judge_urls(pages, known, **options).collect()}


def test_parts_and_rules(spark):
    urls = ["http://WWW.Example.com/en/71?x#y", "http://example.com/en/8", "https://a.b.net/de/", "http://m.example.net/de/8", "http://example.org/es/#x", "http://xcom/en/", None, "no scheme", "x://É.com?q", "ftp://h.com:80", "a://b://c.com/d"]
    got = judged(spark, urls)
    assert [(got[k].host, got[k].path, got[k].rule) for k in range(len(urls))] == [
        ("www.example.com", "/en/71", "example.com/en/7"),
        ("example.com", "/en/8", "com/en/"),
        ("a.b.net", "/de/", "net/de/"),
        ("m.example.net", "/de/8", "example.net/de/8"),
        ("example.org", "/es/", "org/es/"),
        ("xcom", "/en/", None),
        ("", "", None),
        ("", "", None),
        ("É.com", "", None),
        ("h.com:80", "", None),
        ("b:", "//c.com/d", None),
    ]
    assert [got[k].verdict for k in range(5)] == ["allow", "block", "allow", "block", "block"]


def test_bad_hosts_are_blocked_and_evidence_counts(spark):
    urls, outcomes = [], []
    for host, n, bad in [("bad.com", 40, 38), ("good.com", 40, 2), ("once.com", 1, 1), ("sub.bad.com", 0, 0), ("new.net", 0, 0)]:
        for k in range(max(n, 1)):
            if n:
                outcomes.append((len(urls), 0 if k < bad else 1))
            urls.append(f"http://{host}/{k}")
    outcomes += [(None, 1), (0, None)]
    got = {r.host: r for r in judged(spark, urls, outcomes).values()}
    assert {h: r.verdict for h, r in got.items()} == {"bad.com": "block", "good.com": "allow", "once.com": "allow", "sub.bad.com": "block", "new.net": "allow"}
    assert got["bad.com"].reputation < got["once.com"].reputation < got["good.com"].reputation


def test_two_part_suffixes_and_empty(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("b.com",), ("com",), ("",), ("u@x.y.de:8",)], "h string")
    domain, suffix = url_filter.name_levels(df.h)
    assert [tuple(r) for r in df.select(domain, suffix).collect()] == [("b.co.uk", "co.uk"), ("b.com", "com"), ("com", "com"), ("", ""), ("y.de", "de")]
    assert judged(spark, []) == {}


def test_addresses_dots_and_a_list_of_suffixes(spark, tmp_path):
    df = spark.createDataFrame([("192.168.0.1",), ("10.7.0.1:80",), ("[::1]:8080",), ("a.b.com..",), ("x.y.z.kawasaki.jp",), ("1.2.3.4.com",), ("u.blogs.co.uk",)], "h string")
    levels = lambda *x: [tuple(r) for r in df.select(*url_filter.name_levels(df.h, *x)).collect()]
    assert levels() == [("192.168.0.1",) * 2, ("10.7.0.1",) * 2, ("[::1]",) * 2, ("b.com", "com"), ("kawasaki.jp", "jp"), ("4.com", "com"), ("blogs.co.uk", "co.uk")]
    (tmp_path / "list.dat").write_text("// names\ncom\nco.uk\nz.kawasaki.jp // three labels\n*.ck\n!www.ck\nKawasaki.jp\n\n")
    suffixes = url_filter.read_suffixes(spark, str(tmp_path / "list.dat"))
    assert suffixes == ["!www.ck", "*.ck", "co.uk", "kawasaki.jp", "z.kawasaki.jp"]
    assert levels(suffixes)[4] == ("y.z.kawasaki.jp", "z.kawasaki.jp")


def test_wildcards_and_exceptions_of_suffixes(spark):
    names = ["a.b.co.ck", "b.co.ck", "co.ck", "ck", "x.www.ck", "www.ck", "p.city.kobe.jp", "q.r.other.kobe.jp", "kobe.jp", "ack", "a.notck"]
    df = spark.createDataFrame([(n,) for n in names], "h string")
    found = [tuple(r) for r in df.select(*url_filter.name_levels(df.h, ["*.ck", "!www.ck", "*.kobe.jp", "!city.kobe.jp"])).collect()]
    assert found == [("b.co.ck", "co.ck"), ("b.co.ck", "co.ck"), ("co.ck", "co.ck"), ("ck", "ck"), ("www.ck", "ck"), ("www.ck", "ck"), ("city.kobe.jp", "kobe.jp"), ("r.other.kobe.jp", "other.kobe.jp"), ("kobe.jp", "jp"), ("ack", "ack"), ("a.notck", "notck")]


def test_of_equally_long_rules_the_last_decides(spark):
    urls = ["http://ab.com/x/1", "http://sub.ab.com/x/1", "http://ab.com/y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good int")
    rules = [("ab.com", "/x/", "block"), ("sub.ab.com", "/", "allow"), ("ab.com", "/x/", "allow"), ("com", "/x/1234", "block")]
    said = lambda r: {x.page_id: (x.rule, x.verdict) for x in url_filter.judge_urls(pages, none, r).collect()}
    assert said(rules) == {0: ("ab.com/x/", "allow"), 1: ("sub.ab.com/", "allow"), 2: (None, "allow")}
    assert said(rules[::-1])[0] == ("ab.com/x/", "block")
    same = [("ab.com", "/x/", "block"), ("com", "/x/1xxx", "allow"), ("b.com", "/x/1", "allow")]
    assert said(same)[0] == ("ab.com/x/", "block")


def test_unrelated_addresses_do_not_share_a_reputation(spark):
    urls = [f"http://192.168.0.1/{k}" for k in range(30)] + ["http://10.7.0.1/", "http://fine.com/"]
    got = judged(spark, urls, [(k, 0) for k in range(30)] + [(31, 1)] * 30)
    assert got[0].verdict == "block" and got[30].verdict == "allow"


def test_null_and_repeated_page_ids_and_long_urls(spark):
    long = "http://long.com/" + "p" * 200_000
    rows = [(None, "http://a.com/x"), (None, "http://a.com/x"), (1, "http://a.com/y"), (1, "http://a.com/y"), (2, long)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    known = spark.createDataFrame([(1, 1), (None, 0)], "page_id long, good int")
    out = url_filter.judge_urls(pages, known).collect()
    assert sorted(str(r.page_id) for r in out) == ["1", "1", "2", "None", "None"] and all(r.verdict == "allow" for r in out)
    assert [len(r.path) for r in out if r.page_id == 2] == [200_001]
