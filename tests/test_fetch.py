"""robots.txt against the standard library, and batches fetched from a local server."""

from __future__ import annotations

import threading
import time
import urllib.robotparser
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contextloom.functions import text as X
from contextloom.sources import fetch as C
from contextloom.sources import robots as B
from contextloom.sources import web as W

LINE = st.one_of(
    st.sampled_from(["", " ", "# note", "User-agent: *", "user-agent: loom", "User-Agent: LO", "User-agent: other", "Allow: /", "Disallow:", "Disallow: /a # x", "Allow: /a/b", "Disallow: /a%20b", "Allow: /é", "disallow: /a?x=1", "Sitemap: /a", "nonsense", "Disallow /a"]),
    st.builds("{}: /{}".format, st.sampled_from(["Allow", "Disallow"]), st.text(st.sampled_from("ab/c"), max_size=4)),
)


@settings(max_examples=400, deadline=None)
@given(st.lists(LINE, max_size=14), st.sampled_from(["loom/1.0", "*", "otherbot/2"]), st.sampled_from(["/", "/a", "/a/b", "/a b", "/abc/a", "/é", "/a?x=1", "/c"]))
def test_rules_are_those_of_the_standard_library(lines, agent, path):
    """The library takes the first rule that fits; a longest rule is the same wherever all that fit agree."""
    parser = urllib.robotparser.RobotFileParser()
    parser.parse(lines)
    found = B.rules_for(B.groups("\n".join(lines)), agent)
    assert B.may_fetch(found, path, first_match=True) == parser.can_fetch(agent, "http://h" + path)
    fits = {allow for allow, prefix in found if B.prefix_of(path).startswith(prefix)}
    if len(fits) == 1:
        assert B.may_fetch(found, path) == fits.pop()


def test_the_longest_rule_counts(spark):
    files = spark.createDataFrame([("h", "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /a b\n"), ("e", None), ("o", "User-agent: loom\nDisallow: /")], "host string, text string")
    pages = spark.createDataFrame([(h, p) for h in "heox" for p in ("/a/x", "/a/b/x", "/z", "/a b", "/a%20b/c", "")] + [(None, "/a")], "host string, path string")
    rules = B.robots_rules(files, "loom/1")
    assert rules.where("host = 'e'").count() == 0
    got = {(r.host, r.path): r.allowed for r in B.robots_allowed(pages, rules).collect()}
    for (h, p), allowed in got.items():
        text = {r.host: r.text for r in files.collect()}.get(h)
        assert allowed == B.may_fetch(B.rules_for(B.groups(text), "loom/1"), p) or (h, p) == ("o", ""), (h, p)
    first = {(r.host, r.path): r.allowed for r in B.robots_allowed(pages, rules, first_match=True).collect()}
    assert got["h", "/a/b/x"] and not first["h", "/a/b/x"] and got["x", "/a/x"]


class Site(BaseHTTPRequestHandler):
    asked: list[tuple[float, str]] = []

    def do_GET(self):  # noqa: N802
        Site.asked.append((time.monotonic(), self.path))
        if self.path == "/robots.txt":
            return self.say(200, b"User-agent: *\nDisallow: /private\n")
        if self.path == "/long":  # a body without a length
            self.send_response(200)
            self.end_headers()
            for _ in range(200):
                try:
                    self.wfile.write(b"x" * 1000)
                except OSError:
                    return None
            return None
        if self.path == "/told":
            return self.say(200, b"y" * 60_000)
        if self.path.startswith("/page"):
            return self.say(200, f"<html><title>T {self.path}</title><p>Text of {self.path}</p></html>".encode())
        return self.say(404, b"none")

    def say(self, status, body):
        self.send_response(status)
        self.send_header("content-type", "text/html")
        self.send_header("content-length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def site():
    Site.asked = []
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def test_a_batch_from_a_server(spark, site):
    paths = ["/page1", "/private/x", "/page2", "/page1", "/gone", "/long", "/told", "/kept", "/page3"]
    rows = [(i, site + p) for i, p in enumerate(paths)] + [(9, None), (10, "http://127.0.0.1:1/refused"), (11, "no address")]
    requests = spark.createDataFrame(rows, "position long, url string").repartition(3)
    now = "2024-01-02 00:00:00"
    kept = [(W.cache_key(F.lit(site + p)), at, p) for p, at in (("/kept", "2024-01-01 00:00:01"), ("/page3", "2024-01-01 00:00:00"))]
    cache = None
    for key, at, p in kept:
        row = spark.range(1).select(key.alias("key"), F.lit(at).cast("timestamp").alias("fetched_at"), F.lit(f"old {p}").alias("title"), F.lit("old").alias("content"), F.lit("text/html").alias("content_type"), F.lit(200).alias("status"))
        cache = row if cache is None else cache.unionByName(row)
    got = C.fetch_batch(requests, cache, lambda urls: C.from_web(urls, most=50_000, spacing=0.1), F.lit(now))
    out = {r.position: r for r in got.orderBy("position").collect()}
    again = {r.position: r for r in got.collect()}  # read twice, fetched once
    assert out == again and sorted(out) == list(range(12))
    assert [out[i].source for i in range(12)] == ["web", None, "web", "web", None, None, None, "cache", "web", None, None, None]
    assert out[0].title == "T /page1" and out[3].content == out[0].content == "T /page1Text of /page1" and out[7].title == "old /kept" and out[8].title == "T /page3"
    assert out[1].error == f"Robots.txt disallows fetching {site}/private/x" and "404" in out[4].error
    assert "too large" in out[5].error and "Content too large: 60000 bytes" in out[6].error
    assert out[9].error.startswith("Error fetching null") and out[10].error.startswith("Error fetching http://127.0.0.1:1/refused: ") and out[11].error
    asked = [(t, p) for t, p in Site.asked if p != "/robots.txt"]
    assert sorted(p for _, p in asked) == sorted(["/page1", "/page2", "/page3", "/gone", "/long", "/told"]) and len(Site.asked) == len(asked) + 1
    assert all(b - a >= 0.09 for (a, _), (b, _) in zip(asked, asked[1:], strict=False))
    added = C.cache_rows(got)
    assert added.count() == 3
    later = C.fetch_batch(requests.where("position in (0, 3)"), added, lambda urls: C.from_web(urls, get=None), F.current_timestamp())
    assert {r.source for r in later.collect()} == {"cache"}


def test_a_host_that_cannot_be_asked_for_rules():
    asked, waits = [], []

    def get(url, most):
        asked.append(url)
        if url.endswith("robots.txt"):
            raise TimeoutError
        return C.Response(200, "text/html", b"x")

    times = iter([0.0, 0.0, 0.25, 0.25, 5.0, 5.0])
    hosts = C.Hosts(get, "a", True, 1.0, clock=lambda: next(times), sleep=waits.append)
    assert [hosts.fetched(f"http://h/{i}", 10).body for i in range(3)] == [b"x"] * 3
    assert asked == ["http://h/robots.txt", "http://h/0", "http://h/1", "http://h/2"] and waits == [0.75]


def test_a_crawl_with_versions_of_an_address(spark):
    """Of an address that was crawled twice, each request gets the version it asks for; titles by the reader that is given."""
    page = "<html><title>{}</title>{}</html>".format
    pages = spark.createDataFrame([(1, "http://h/a", page("one &amp", "x")), (2, "http://h/a", page("two &amp;", "y" * 100)), (3, "http://h/b", page("b", "z"))], "page_id long, url string, html string")
    rules = spark.createDataFrame([], "host string, place int, allow boolean, prefix string")
    nothing = spark.createDataFrame([], "key string, fetched_at timestamp, title string, content string, content_type string, status int")
    asked = pages.select("page_id", "url").unionByName(pages.where("page_id = 3").select("page_id", F.lit("http://h/gone").alias("url")))
    got = C.fetch_batch(asked, nothing, lambda urls: C.from_table(urls, pages, rules, 100, by=["page_id"], title=X.html_title), F.current_timestamp(), by=["page_id"])
    assert sorted(((r.page_id, r.title, r.content, r.error) for r in got.collect()), key=repr) == [
        (1, "one &amp", "one &x", None), (2, None, None, "Error fetching http://h/a: Content too large: 138 bytes"),
        (3, "b", "bz", None), (3, None, None, "Error fetching http://h/gone: HTTP Error 404: Not Found"),
    ]


def test_white_space_ends_no_group_and_odd_paths_are_rules():
    assert B.groups("User-agent: *\n \nDisallow: /a") == [(["*"], [(False, "/a")])]
    assert B.groups("User-agent: *\nDisallow: //[x\nDisallow: /a?") == [(["*"], [(False, "//%5Bx"), (False, "/a")])]
