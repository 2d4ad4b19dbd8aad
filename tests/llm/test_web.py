"""WARC archives, URL filters and the components under them."""

import gzip
import hashlib
import random
import time
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pytest

from lexmill.llm import url_filters, warc
from lexmill.llm.components import connected_components
from lexmill.llm.files import open_folder

RULES = [url_filters.Rule("com", "/", "allow"), url_filters.Rule("example.com", "/en/", "block"), url_filters.Rule("www.example.com", "/en/", "allow"), url_filters.Rule("net", "/es/", "block")]


def pages():
    big, other = "<p>é</p>" * 4000, "<p>x</p>" * 130
    rows = [(1, "http://a.com/1", big), (2, "http://a.com/2", None), (3, None, ""), (4, "http://b.com/\r\nX: y", other), (5, "http://b.com/5", big), (9, "http://b.com/9", big), (9, "http://b.com/9", big)]
    rows += [(6, "u", "short"), (7, "v", "short"), (None, "http://n.com/", big), (10, "http://c.com/", "y" * 1000), (11, "http://c.com/", "y" * 1000), (12, "z", "y" * 999), (13, "z", "y" * 999)]
    return rows


def test_chunked_framing():
    for n in (0, 1, 4095, 4096, 4097, 20000):
        data = random.Random(n).randbytes(n)
        assert warc.unchunked(warc.chunked(data)) == data
    for bad in (b"", b"5\r\nabc", b"3\r\nabcd\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


@pytest.mark.parametrize("segment,broadcast", [(64, 32 << 20), (1000, -1), (1 << 30, 32 << 20)])
def test_archives_round_trip(spark, monkeypatch, segment, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", broadcast)
    rows = pages() + [(20 + i, u, "odd") for i, u in enumerate(["", " ", "about:blank", "none", " http://x/ ", "http://x/%0D", "=", "é\t"])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, payload string, number int").repartition(3)
    folder, manifest = warc.write(df, segment_bytes=segment)
    got = warc.read(folder, manifest).collect()
    want = Counter()
    body = lambda t: (t or "").encode()
    for i, u, t in rows:
        same = [j for j, _, x in rows if body(x) == body(t) and j is not None]
        keeper = max(same) if i is not None and len(body(t)) >= 1000 and len(same) > 1 else None
        refers = keeper if keeper not in (None, i) else None
        want[(i, u, "revisit" if refers else "response", refers, None if refers else body(t), len(body(t)), hashlib.sha1(body(t)).hexdigest(), None)] += 1
    assert Counter((r.page_id, r.url, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload), r.payload_bytes, r.payload_digest, r.problem) for r in got) == want


def test_files_are_plain_gzip_of_records(spark, tmp_path):
    folder, manifest = warc.write(spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1), folder=f"file://{tmp_path}/w")
    text = b"".join(gzip.decompress((tmp_path / "w" / r["name"]).read_bytes()) for r in manifest.collect())
    n = sum(r.n_records for r in manifest.collect())
    assert text.count(b"WARC/1.1\r\n") == n and text.count(b"WARC-Type: continuation") > 0
    assert text.count(b"WARC-Segment-Total-Length") == text.count(b"WARC-Segment-Number: 1\r\n")
    assert open_folder(folder)[1].endswith("/w")


def test_broken_segments_are_reported_and_stop_nothing():
    blocks = [b"HTTP/1.1 200 OK\r\n\r\nab", b"cd", b"ef"]
    digest, total = hashlib.sha1(b"abcdef").hexdigest(), sum(map(len, blocks))
    rows = [(n + 1, total if n == 2 else None, 7, "response", "u", digest, None, b) for n, b in enumerate(blocks)]
    assert list(warc.assemble(rows[::-1])) == [(7, "response", "u", None, b"abcdef", 6, digest, None)]
    for broken in (rows[:2], rows[1:], [rows[0], rows[2]], [*rows[:2], (3, 5, *rows[2][2:])]):
        (row,) = warc.assemble(broken)
        assert row[4] is None and row[-1]
    twice = list(warc.assemble(rows + rows))
    assert len(twice) == 2 and twice[0] == twice[1]
    wrong = [(1, None, 7, "response", "u", "00", None, blocks[0])]
    assert "digest" in next(warc.assemble(wrong))[-1]


def test_bad_records_are_reported_and_the_others_read(spark, tmp_path):
    good = lambda i, text, segment=1 << 20: list(warc.records(i, f"http://x/{i}", text, None, None, segment))
    nameless = warc.member({"WARC-Type": "response", "X-Page-Id": 8}, b"HTTP/1.1 200 OK\r\n\r\nx")
    lettered = warc.member({"WARC-Type": "response", "WARC-Record-ID": "<x>", "X-Page-Id": "p7"}, b"HTTP/1.1 200 OK\r\n\r\nx")
    other = warc.member({"WARC-Type": "warcinfo", "WARC-Record-ID": "<i>"}, b"software: x")
    one, two = good(1, b"a" * 50), good(2, b"b" * 200, 64)
    (tmp_path / "first").write_bytes(b"".join([other, nameless, *one, gzip.compress(b"no record"), lettered, *two[:-1]]))
    (tmp_path / "second").write_bytes(b"".join([two[-1], *good(3, b"c"), good(4, b"d" * 500)[0][:-20]]))
    (tmp_path / "third").write_bytes(b"not gzip at all")
    manifest = spark.createDataFrame([("first",), ("second",), ("third",)], "name string")
    rows = warc.read(f"file://{tmp_path}", manifest).collect()
    assert {r.page_id: bytes(r.payload) for r in rows if r.problem is None} == {1: b"a" * 50, 2: b"b" * 200, 3: b"c"}  # 2 by segments of two files
    problems = [r.problem for r in rows if r.problem]
    assert len(problems) == 5 and sum("first" in p for p in problems) == 2 and sum("second" in p for p in problems) == 1 and sum("third" in p for p in problems) == 1
    assert len(rows) == 8


def test_empty_archive(spark):
    folder, manifest = warc.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read(folder, manifest).count() == 0


def union_find(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)]
    edges += [(1000, i) for i in range(1001, 1200)] + [(i + 1, i) for i in range(2000, 2060)] + [(5, 5), (None, 3), (4, None), (7, 8), (8, 7)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == union_find(edges) and got.count() == len(union_find(edges))
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_urls_are_taken_apart(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.B:80/x?y#z", "x://h?q/p", "a://b://c/d", "://h/p", "s://u@H#f"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(url_filters.host_of("u").alias("h"), url_filters.path_of("u").alias("p")).collect()
    assert [tuple(r) for r in got] == [("", ""), ("", ""), ("", ""), ("", ""), ("a.b:80", "/x"), ("h", ""), ("b:", "//c/d"), ("h", "/p"), ("u@h", "")]


def test_longest_rule_wins_inline_and_joined(spark, monkeypatch):
    urls = ["http://example.com/en/1", "http://www.example.com/en/", "http://m.www.example.com/en/x", "http://xexample.com/en/", "http://a.net/es/", "http://net/es/q", "http://a.org/", "http://example.com/", "http://example.com"]
    want = ["example.com/en/", "www.example.com/en/", "www.example.com/en/", "com/", "net/es/", "net/es/", None, "com/", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", url_filters.host_of("u").alias("host"), url_filters.path_of("u").alias("path"))
    for limit in (256, 0):
        monkeypatch.setattr(url_filters, "INLINE_RULES", limit)
        assert [r.rule for r in url_filters.match_rules(df, RULES).orderBy("i").collect()] == want
    assert url_filters.match_rules(df, []).where("rule is not null").count() == 0


def test_block_decisions_reach_aliases_and_allow_takes_precedence(spark):
    link = lambda to: f'<html><head><LINK href="{to}" rel=canonical></head>'
    fresh = lambda to: f'<meta http-equiv="refresh" content="0; url={to}">'
    rows = [
        (1, "http://a.org/1", link("http://b.net/es/1")),  # its canonical form is blocked
        (2, "http://A.org/2#top", fresh("http://a.org/1")),  # by way of page 1
        (3, "http://c.org/3", link("http://d.org/mid")), (4, "http://e.net/es/4", link("http://d.org/mid")), (5, "http://x.com/5", fresh("http://d.org/mid")),  # an allow in the class
        (6, "http://f.org/6", link("/rel")), (7, "http://f.org/7", None), (8, None, link("http://b.net/es/1")), (9, "http://g.org/9", link("relative")),
        (10, "http://h.org/10", ""), (10, "http://h.org/10", ""), (11, "http://i.org/1", None),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, host string, verdict string")
    redirects = spark.createDataFrame([("http://h.org/10", "http://hop.org/"), ("http://hop.org/", "http://b.net/es/1"), (None, "x")], "from_url string, to_url string")
    got = url_filters.judge(df, RULES, redirects)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    verdicts = [(r.page_id, r.verdict) for r in got.orderBy("page_id").collect()]
    assert verdicts == [(1, "block"), (2, "block"), (3, "allow"), (4, "block"), (5, "allow"), (6, "allow"), (7, "allow"), (8, "allow"), (9, "allow"), (10, "block"), (10, "block"), (11, "allow")]
    assert url_filters.judge(df.limit(0), RULES).count() == 0
    assert url_filters.judge(df, RULES, html_col=None).where("verdict = 'block'").count() == 1


def test_all_forms_of_link_targets(spark):
    cases = [
        ("es/home", "http://x.net/a/es/home"), ("../page.html", "http://x.net/page.html"), ("../../../p", "http://x.net/p"), ("./c/./d/..", "http://x.net/a/c/"), ("?id=1", "http://x.net/a/b?id=1"),
        ("/r/../s?u=../t", "http://x.net/s?u=../t"), ("//Y.org/z", "http://y.org/z"), ("HTTPS://Y.org/Z#top", "https://y.org/Z"), ("go?to=http://y.org/", "http://x.net/a/go?to=http://y.org/"),
        ("?a=1&amp;b=2&#38;c=&#x1F642;&eacute;&amp;lt;&none;&d", "http://x.net/a/b?a=1&b=2&c=🙂é&lt;&none;&d"), ("&#0;&#xD800;", None), ("mailto:a@b", None), ("#top", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    base = url_filters.F.lit("http://x.net/a/b?q=/1#f")
    got = [r.u for r in df.orderBy("i").select(url_filters.node_of(url_filters.resolve(base, url_filters.unescaped(df.t))).alias("u")).collect()]
    assert got == ["http://x.net/a/" + t.split("#")[0] if u is None and t.startswith("&") else u for t, u in cases]


def test_relative_escaped_and_repeated_links_carry_decisions(spark):
    link = lambda to: f'<link rel="canonical" href="{to}">'
    fresh = lambda to: f'<meta http-equiv="refresh" content="0; url={to}">'
    rows = [
        (1, "http://b.net", fresh("es/home")), (2, "http://b.net/fr/x", link("../es/")),
        (3, "http://c.org/3", link("http://c.org/none") + link("http://b.net/es/3")), (4, "http://c.org/4", fresh("#") + fresh("//b.net/es/4")),
        (5, "http://d.org/5", link("/m?a=1&amp;b=2")), (6, "http://d.org/m?a=1&b=2", link("http://b.net/es/6")), (7, "http://e.org/7", link("es/")),
    ]
    got = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES)
    assert {r.page_id: r.verdict for r in got.collect()} == {i: "block" if i < 7 else "allow" for i in range(1, 8)}


@pytest.mark.parametrize("html,want", [
    ('<link rel="canonical" data-href="http://x.net/es/1" href="http://a.org/">', ["http://a.org/"]),
    ('<link rel="alternate  CANONICAL" href=/a?b=c>', ["/a?b=c"]),
    ('<link rel="canonical-old" href="/a"><link data-rel="canonical" rel="icon" href="/b"><linked rel=canonical href=/c>', []),
    ('<!-- <link rel="canonical" href="/a"> --><link rel=canonical href=/b><!--><link rel=canonical href=/c>', ["/b", "/c"]),
    ("<script>'<link rel=canonical href=/a>'</scripted></SCRIPT ><style><link rel=canonical href=/b></style><link rel=canonical href=/c>", ["/c"]),
    ('<link rel="canonical" href="/my page">', ["/my page"]),
    ("<link title='a > b' href = '/x' href=/y rel = canonical />", ["/x"]),
    ('<meta content="0;URL=\'/my page\'" http-equiv=" Refresh ">', ["/my page"]),
    ('<meta http-equiv="refresh" content="5; /plain"><meta http-equiv="refresh" content="5"><meta http-equiv="refresh"><meta name="refresh" content="0;url=/no">', ["/plain"]),
    ('<link rel=canonical href="/a', []), ('<link rel="canonical><link rel=canonical href=/a>', []), ("<link rel=canonical href=/a", []), ("<link rel=canonical href=>", []), ("<link rel=canonical href>", []),
    ("< link rel=canonical href=/a><3<link rel=canonical href=/b>", ["/b"]),
])
def test_link_targets(html, want):
    assert url_filters.targets_of(html) == want


def test_long_pages_are_read_in_one_pass():
    start = time.perf_counter()
    for html in ("<link " * 100_000, '<link rel="canonical ' * 50_000, "<!--" * 100_000, "<script>" * 50_000, "<" * 500_000, "<a href='" * 50_000, '<link ' + 'a="b" ' * 100_000 + ">", "<link a=" + "=" * 300_000):
        assert url_filters.targets_of(html) == []
    assert time.perf_counter() - start < 10


@pytest.mark.parametrize("body", [b"1\r\na\r\n-6\r\n", b"+3\r\nabc\r\n0\r\n\r\n", b"0x3\r\nabc\r\n0\r\n\r\n", b"1_0\r\n0123456789abcdef\r\n0\r\n\r\n", b" 3\r\nabc\r\n0\r\n\r\n", b"\r\n", b"f" * 17 + b"\r\n", b"3\r\nab"])
def test_bad_chunk_sizes_end_the_read(body):
    with pytest.raises(ValueError):
        warc.unchunked(body)
    assert warc.unchunked(b"3;x=1\r\nabc\r\nA \r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"


def test_odd_numbers_in_heads_stop_nothing(spark, tmp_path):
    good = list(warc.records(5, "http://a.org/", b"x" * 50, None, None))
    odd = [{"WARC-Segment-Number": n} for n in ("99999999999", "-1", "0x1", "1" * 40)] + [{"WARC-Segment-Total-Length": "9" * 30}, {"X-Page-Id": "1" * 60}, {"X-Page-Id": "a\x00b"}]
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"y")
    bad = [warc.member({"WARC-Type": "response", "WARC-Record-ID": f"<urn:{i}>", "X-Page-Id": "7"} | h, block) for i, h in enumerate(odd)]
    (tmp_path / "f.warc.gz").write_bytes(b"".join(bad[:3] + good + bad[3:]))
    got = warc.read(f"file://{tmp_path}", spark.createDataFrame([("f.warc.gz",)], "name string")).collect()
    assert [r.payload for r in got if r.page_id == 5] == [b"x" * 50]
    assert sum(r.problem is not None and r.page_id is None for r in got) >= 5 and len(got) == 8


class Links(HTMLParser):
    """Link targets as an HTML parser sees them."""

    def __init__(self, base):
        super().__init__()
        self.base, self.found = base, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        target = None
        if tag == "link" and (a.get("rel") or "").lower() == "canonical":
            target = a.get("href")
        if tag == "meta" and (a.get("http-equiv") or "").lower() == "refresh":
            target = (a.get("content") or "").partition("url=")[2]
        if target:
            to = urldefrag(urljoin(self.base, target.strip())).url
            if target.strip().partition("#")[0] and "://" in to:
                self.found.append(to)


def test_links_as_an_html_parser_finds_them(spark):
    rng = random.Random(4)
    targets = ["es/home", "/es/1", "//b.net/fr/1", "http://b.net/es/2?q=1&amp;r=2", "?x=1", "#t", "mailto:a@b", "https://c.org/d", "deep/er/page.html#part"]
    rows = []
    for i in range(120):
        tags = []
        for _ in range(rng.randrange(4)):
            t = rng.choice(targets)
            tags.append(rng.choice([f'<link rel="canonical" href="{t}">', f"<LINK href='{t}' rel='canonical'/>", f'<meta http-equiv="refresh" content="5; url={t}">', f"<p title='{t}'>text</p>", f'<link rel="stylesheet" href="{t}">', f'<a href="{t}">x</a>']))
        rows.append((i, f"http://h{i}.org/a/b{i}", f"<html><head>{''.join(tags)}</head><body>{'<link ' * rng.randrange(3)}</body>"))
    rows += [(200, "http://long.org/", "<link " * 20_000), (201, "http://long.org/2", "x" * 200_000 + '<link rel="canonical" href="/end">')]
    got = Counter((r.a, r.b) for r in url_filters.alias_links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = Counter()
    for _, url, html in rows:
        parser = Links(url)
        parser.feed(html)
        for to in parser.found:
            want[(url, to)] += 1
    assert got == want
