from __future__ import annotations

import hashlib
import io
import random
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import media, url_rules
from weftgraph.llm.common import shared_folder
from weftgraph.llm.queries import OP10_SQL, RULES

RNG = np.random.default_rng(9)


def image(h, w, c=3):
    return RNG.integers(0, 256, (h, w, c)).astype(np.uint8)


@pytest.mark.parametrize("shape", [(1, 1), (7, 5), (64, 3)])
def test_round_trips(shape):
    x = image(*shape)
    assert (media.read_netpbm(media.write_netpbm(x)) == x).all()
    assert (media.read_bmp(media.write_bmp(x)) == x).all()
    g = image(*shape, 1)
    assert (media.read_netpbm(media.write_netpbm(g)) == g).all()


def test_netpbm_kinds():
    assert media.read_netpbm(b"P1\n# c\n3 1\n1 0 1\n")[..., 0].tolist() == [[0, 255, 0]]
    assert media.read_netpbm(b"P4 3 1\n\xa0")[..., 0].tolist() == [[0, 255, 0]]
    assert media.read_netpbm(b"P2 2 1 15\n0 15")[..., 0].tolist() == [[0, 255]]
    assert media.read_netpbm(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.read_netpbm(b"P5 1 1 65535\n\xff\xff")[..., 0].tolist() == [[255]]


@pytest.mark.parametrize("data", [b"", b"P6", b"P6 2 2 255\nxx", b"BM", b"P5 1 1 0\n0", b"GIF89a", b"P2 2 2 255 1"])
def test_broken_images(data):
    with pytest.raises(ValueError):
        media.read_image(data)


@pytest.mark.parametrize("target", [(8, 9), (1, 1), (3, 20), (16, 16)])
def test_area_resize(target):
    x = image(13, 11)
    h, w = target
    rows = np.repeat(np.repeat(x.astype(np.int64), h, axis=0), w, axis=1).reshape(h, 13, w, 11, 3).sum(axis=(1, 3))
    assert (media.area_resize(x, h, w) == (2 * rows + 143) // 286).all()


def brute_means(x, height, width):
    """Area means by repeating samples to a common multiple."""
    h, w, c = x.shape
    by_row = np.stack([np.repeat(x, height, axis=0)[k * h : (k + 1) * h].astype(np.int64).sum(axis=0) for k in range(height)])
    sums = np.stack([np.repeat(by_row, width, axis=1)[:, k * w : (k + 1) * w].sum(axis=1) for k in range(width)], axis=1)
    return ((2 * sums + h * w) // (2 * h * w)).astype(np.uint8)


@pytest.mark.parametrize("shape", [(1, 1), (3, 7), (16, 16), (50, 20), (200, 64)])
def test_area_means(shape):
    x = image(*shape)
    for size in ((8, 9), (16, 16), (1, 1), (31, 5)):
        assert (media.area_resize(x, *size) == brute_means(x, *size)).all()


def test_tiles(spark):
    x = image(20, 30)
    rows = [(1, media.write_netpbm(x)), (2, media.write_bmp(x)), (3, b"nothing"), (4, None), (1, b"")]
    out = media.media_tiles(spark.createDataFrame(rows, "id int, media binary"), "media", "id", 8, 8).collect()
    assert [r["error"] is None for r in out] == [True, True, False, False, False]
    assert out[0]["tile"] == out[1]["tile"] and out[0]["dhash"] == out[1]["dhash"]
    assert (np.load(io.BytesIO(out[0]["tile"])) == media.area_resize(x, 8, 8)).all()
    path = shared_folder(spark, "tiles")
    media.write_tiles(spark.createDataFrame(rows, "id int, media binary"), path, "media", "id", 8, 8)
    assert spark.read.parquet(path).where("tile is not null").count() == 2


def test_payloads(docs, corpus, none):
    got = {r["doc_id"]: r for r in media.payload_features(docs).collect()}
    for i, text in corpus:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, 64, 3)
        stored = media.write_bmp(image) if len(image) > media.TALL else media.write_netpbm(image)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        tile = io.BytesIO()
        np.save(tile, brute_means(image, 16, 16))
        assert r["feature"].split("-")[1] == hashlib.sha256(tile.getvalue()).hexdigest()
    assert media.payload_features(none).count() == 0


def test_payload_edge_cases(spark):
    long = "long text é " * 400_000
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (2, long), (3, None), (4, "")], "doc_id long, text string").withColumns({"id": F.lit(0), "media": F.lit("m")})
    got = sorted(map(tuple, media.payload_features(rows).collect()), key=str)
    assert len(got) == 6 and len({r[1:] for r in got if r[1] == 1}) == 1 and len({r[1:] for r in got if r[1] == 0}) == 1
    assert [r[2] for r in got if r[0] == 2] == [-(-len(long.encode()) // 192) * 192]


URLS = [
    ("http://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://example.org/en/15", "example.org", "/en/15", "example.org/en/1", "block"), ("https://x.org", "x.org", "", None, "allow"),
    ("https://x.org/", "x.org", "/", "org/", "allow"), ("ftp://b.com/de/?q#f", "b.com", "/de/", "com/de/", "block"), ("http://com/fr/a", "com", "/fr/a", "com/fr/", "allow"), ("http://telecom/fr/", "telecom", "/fr/", None, "allow"),
    ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("http://h.org?x=/y", "h.org", "", None, "allow"), ("http://É.COM/de/", "É.com", "/de/", "com/de/", "block"),
]


def test_rules(spark):
    rows = [(i, u[0], None) for i, u in enumerate(URLS)]
    out = url_rules.judge_urls(spark.createDataFrame(rows, "page_id int, url string, html string"), RULES)
    got = {r["page_id"]: tuple(r)[1:] for r in out.collect()}
    for i, (_, *wanted) in enumerate(URLS):
        assert got[i] == tuple(wanted), URLS[i]


def test_aliases(spark):
    page = lambda to: f'<head><link rel="canonical" href="{to}"></head>'
    rows = [
        (1, "http://a.net/1", page("https://b.net/2")), (2, "http://b.net/2#top", '<meta http-equiv="refresh" content="0; url=http://c.com/de/3">'), (3, "http://c.com/de/3", None), (4, "http://d.net/4", page("/5")),
        (5, "https://d.net/5", ""), (6, "http://e.org/6", page("http://a.net/1")), (7, "http://f.net/7", "<link href='//a.net/1' rel=canonical>"), (8, "http://g.net/8", "canonical"), (1, "http://a.net/1", None),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("host", F.lit("clash"))
    got = {(r["page_id"], r["verdict"]) for r in url_rules.judge_urls(pages, RULES).collect()}
    assert got == {(1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow"), (6, "allow"), (7, "block"), (8, "allow")}
    table = spark.createDataFrame([("http://g.net/8", "http://h.com/de/")], "a string, b string")
    assert url_rules.judge_urls(pages, RULES, edges=table).where("page_id = 8").first()["verdict"] == "block"
    assert url_rules.judge_urls(pages.limit(0), RULES).count() == 0


LINKS = {  # target on http://m.net/a/b/c?x=1: resource
    "d": "m.net/a/b/d", "./d": "m.net/a/b/d", "../d": "m.net/a/d", "../../../d": "m.net/d", "..": "m.net/a/", ".": "m.net/a/b/", "?y=2": "m.net/a/b/c?y=2", "/d/../e?z#f": "m.net/e?z", "//N.net": "n.net/", "http://n.net:80/q": "n.net/q",
    "https://n.net:443": "n.net/", "http://n.net:443/": "n.net:443/", "HTTP://n.net:80": "n.net/", "mailto:a@b": None, "#top": None, "d/./e/": "m.net/a/b/d/e/", "d?p=../x": "m.net/a/b/d?p=../x",
}


def test_targets_are_resolved(spark):
    rows = spark.createDataFrame(list(LINKS.items()), "t string, wanted string")
    found = rows.select("t", "wanted", url_rules.resource_of(url_rules.resolved(F.col("t"), F.lit("http://m.net/a/b/c?x=1"))).alias("r"))
    assert [(r["t"], r["r"]) for r in found.collect()] == list(LINKS.items())


def _link_pages():
    link = '<link rel="canonical" href="{}">'.format
    rows = [(100 + i, f"http://c.com/de/p{i}?q", link(t.replace("n.net", f"n{i}.net"))) for i, t in enumerate(LINKS)]
    rows += [(200 + i, f"http://m.net/{x}", None) for i, x in enumerate(("d", "e?z", "a/d"))] + [(300 + 3 * i + k, f"http://n{i}.net{x}", None) for i in range(len(LINKS)) for k, x in enumerate(("/", "/q", ""))]
    rows += [(1, "http://s.net/x/1", link("../y")), (2, "http://s.net/y", link("http://c.com/de/z")), (3, "http://t.net:80/q", link("http://c.com/de/z")), (4, "https://t.net:443/q", None), (5, "http://t.net:443/q", None)]
    rows += [(6, "http://u.net/1", "<!-- " + link("http://c.com/de/z") + " -->"), (7, "http://u.net/2", "<!-- open " + link("http://c.com/de/z")), (8, "http://u.net/3", "<!-- a --> <LINK\nhref=http://c.com/de/z\nREL=canonical >")]
    rows += [(9, "http://u.net/4", "<link rel=canonical href='http://c.com/de/z'" * 3), (10, "http://u.net/5", "<meta content='5;URL=/3' http-equiv=refresh>"), (11, "HTTP://v.net", link("http://c.com/de/z")), (12, "http://v.net/", None), (13, None, link("http://c.com/de/z")), (14, "v.net", link("http://c.com/de/z"))]
    bad, head = "http://c.com/de/z", "<html><head><title>a <link></title>"
    rows += [(1000 + i, f"http://w{i}.net/", html.replace("BAD", bad)) for i, (html, _) in enumerate(MARKUP)]
    rows += [(2000, "http://w.net/a/b", head + '<link rel=canonical href=z><base target=_top><base href="http://c.com/de/"><base href="/other">'), (2001, "http://w.net/c/d", '<base href="../e/"><link rel=canonical href=f>'), (2002, "http://w.net/e/f", link("http://c.com/de/q")), (2003, "http://w.net/x", '<base href="mailto:x"><link rel=canonical href=e/f>')]
    return rows


#: Pages, and whether they are aliases of a blocked url.
MARKUP = [
    ('<link rel="canonical" href="http:&#47;&#x2F;c.com&sol;de/z">', True), ('<link rel="canonical" href="http:&#47&#x2f;c.com/de/z">', True), ("<link title='a > b <c' rel=canonical href='BAD'>", True), ('<link rel="canonical" data-href="BAD">', False),
    ('<link data-href="/x" rel="canonical" href="BAD">', True), ('<link rel="not-canonical" href="BAD">', False), ('<link rel="alternate canonical" href="BAD">', True), ('<link rel="canonicals" href="BAD">', False), ('<link xrel="canonical" href="BAD">', False),
    ('<script>var x = \'<link rel="canonical" href="BAD">\'</script>', False), ('<script src="a>b">x</script ><link rel="canonical" href="BAD">', True), ('<style>a{}<link rel=canonical href=BAD></style>', False), ('<title><link rel=canonical href=BAD></title>', False),
    ('<textarea><link rel=canonical href=BAD>', False), ('<a title="<link rel=canonical href=BAD>">x</a>', False), ("<p>don't <link rel=canonical href=BAD> can't</p>", True), ('<link rel=canonical href=BAD', False), ('<LINK REL=CANONICAL HREF=BAD/>', True), ("<link/rel='canonical'/href='BAD'/>", True),
    ('<!--><link rel=canonical href=BAD>', True), ('<!-- x --!><link rel=canonical href=BAD>', True), ('<!doctype html><?xml x?></p x><link rel=canonical href=BAD>', True), ('<linkx rel=canonical href=BAD>', False), ('<link rel = "canonical"\thref\n=\n"  BAD\n ">', True),
    ('<link rel=canonical href="" href="BAD">', False), ('<link rel=canonical href>', False), ('<meta http-equiv="Refresh" content="0;BAD">', True), ("<meta http-equiv=refresh content='3.5 , URL = \"BAD\" x'>", True), ('<meta http-equiv=refresh content="0 BAD">', True), ('<meta http-equiv=refresh content="BAD">', False),
    ('<meta name="refresh" content="0;url=BAD">', False), ('<meta http-equiv=refresh content=10>', False), ('<link rel="canonical" href="http://c.com/de/z&unknown;">', True), ('<link rel=canonical href="&#0;&#xD800;&#9999999;">', False), ('<div><link rel="canonical" href=\'BAD\'><link rel="canonical" href="/own"></div>', True),
    ("<scripts><link rel=canonical href=BAD></scripts>", True), ("<script><link rel=canonical href=BAD>", False), ('<link rel="canonical" href=BAD rel="icon">', True), ('<b =x rel=canonical><link =rel=canonical href=BAD>', False),
]


class Parsed(HTMLParser):
    """Targets as the standard library's parser sees the tags."""

    RCDATA_CONTENT_ELEMENTS = ("textarea", "title")

    def __init__(self):
        super().__init__()
        self.targets = []

    def handle_starttag(self, tag, attrs):
        first = {k: v or "" for k, v in reversed(attrs)}
        if tag == "link" and "canonical" in first.get("rel", "").lower().split() and first.get("href", "").strip():
            self.targets.append(first["href"].strip())

    handle_startendtag = handle_starttag


ATTRIBUTES = ["rel=canonical", 'rel="x canonical"', "rel='CANONICAL'", "rel=icon", "href=/a", 'href="/b>c"', "href='/d<e'", "data-href=/e", "href = /f", "href", "title='<link rel=canonical href=/g>'", 'HREF="/&#47;x&amp;y&sol;z"', "a=b=c", "crossorigin"]
BETWEEN = ["text ", "</a>", "<!-- <link rel=canonical href=/h> -->", "<script>'<link rel=canonical href=/i>'</script>", "<style><link rel=canonical href=/j></style>", "&amp;", "don't ", "<br/>", "<!doctype html>", "a < b "]


def test_targets_are_those_of_a_parser(spark):
    rng = random.Random(3)

    def tag():
        return f"<{rng.choice(['link', 'LINK', 'a', 'b'])} {' '.join(rng.choices(ATTRIBUTES, k=rng.randrange(6)))}{rng.choice(['>', ' >', ' />'])}"

    pages = ["".join(rng.choice([tag, lambda: rng.choice(BETWEEN)])() for _ in range(rng.randrange(12))) for _ in range(3000)]
    tags = F.filter(F.regexp_extract_all("html", F.lit(url_rules.token_pattern()), F.lit(0)), lambda x: F.rlike(x, F.lit(url_rules.WANTED)))
    found = F.filter(F.transform(tags, url_rules.target_of), lambda x: x != "")
    got = [r["t"] for r in spark.createDataFrame(list(enumerate(pages)), "i int, html string").select("i", found.alias("t")).orderBy("i").collect()]
    for page, targets in zip(pages, got, strict=True):
        parser = Parsed()
        parser.feed(page)
        parser.close()
        assert targets == parser.targets, page
    assert sum(map(bool, got)) > 300


def test_links_and_their_sql(spark):
    rows = _link_pages()
    got = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), RULES).collect()}
    for i, (html, alias) in enumerate(MARKUP):
        assert got[1000 + i][-1] == ("block" if alias else "allow"), html
    assert [got[i][-1] for i in (2000, 2001, 2002, 2003)] == ["block"] * 4
    verdicts = {i: got[i][-1] for i in range(1, 15)}
    assert verdicts == {i: "block" if i in (1, 2, 3, 4, 8, 10, 11, 12) else "allow" for i in verdicts}
    duck = duckdb.connect()
    duck.execute("create table pages (page_id bigint, url varchar, html varchar)")
    duck.executemany("insert into pages values (?, ?, ?)", rows)
    cursor = duck.execute(OP10_SQL)
    assert [c[0] for c in cursor.description] == ["page_id", "host", "path", "rule", "verdict"]
    assert got == {r[0]: tuple(r)[1:] for r in cursor.fetchall()}


def test_long_html_takes_linear_time(spark):
    rows = [(1, "http://a.net/", "<link rel=canonical " * 100_000), (4, "http://d.net/", "<link " + "rel=x " * 300_000 + "canonical>"), (5, "http://e.net/", "canonical <a b='" * 200_000), (6, "http://f.net/", "canonical" + "<p q=\"x\">" * 200_000), (7, "http://g.net/", "canonical" + "<script>" * 200_000), (2, "http://b.net/", "<!--" * 200_000 + "canonical"), (3, "http://c.net/", '<link rel="canonical" href="http://c.com/de/1">' + "x" * 3_000_000)]
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(spark.createDataFrame(rows, "page_id int, url string, html string"), RULES).collect()}
    assert got == {i: "block" if i == 3 else "allow" for i in range(1, 8)}
