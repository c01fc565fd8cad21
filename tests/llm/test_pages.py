"""WARC archives and main text."""

import base64
import gzip
import hashlib

import pytest

from beaconry.llm import warc
from beaconry.llm.wrappers import _content, main_text, parse

SCHEMA = "page_id long, url string, html string, host string, payload string, wrapper string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://a/4\r\nX: y", ""), (5, "u", "x\r\n\r\ny"),
             (None, "http://a/6", "<p>é</p>"), (7, "u", "z" * 3_000_000), (5, "u", "x\r\n\r\ny")]
    df = spark.createDataFrame([(*p, "h", "p", "w") for p in pages], SCHEMA).repartition(3)
    files = warc.write_archives(warc.with_revisits(df), str(tmp_path / "w"), archive_bytes=400)
    got = warc.read_archives(files).collect()
    want = []
    for i, u, h in pages:
        last = max((j for j, _, x in pages if (x or "") == (h or "") and j is not None), default=None)
        revisit = last is not None and i != last
        want.append((i, len((h or "").encode()), sha(h), "revisit" if revisit else "response", last if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.payload}[7] == "z" * 3_000_000
    paths = [r.path for r in files.collect()]
    assert sum(gzip.open(p).read().count(b"WARC/1.1\r\n") for p in paths) == len(pages)


def test_members_span_chunks_and_damage_is_found():
    records = [warc.record_bytes(i, f"http://h/{i}", b"body %d" % i * 50, None, False) for i in range(5)]
    raw = b"".join(gzip.compress(r) for r in records)
    for step in (1, 7, 1000):
        assert list(warc.members(raw[i:i + step] for i in range(0, len(raw), step))) == records
    with pytest.raises(warc.BadRecord):
        list(warc.members([raw[:-3]]))
    with pytest.raises(warc.BadRecord):
        warc.parse(records[0].replace(b"body 0", b"body 1", 1))
    with pytest.raises(warc.BadRecord):
        warc.parse(records[0][:-1])


def test_warc_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.read_archives(warc.write_archives(warc.with_revisits(empty), str(tmp_path / "w"))).collect() == []


FRAME = ("<html><head><title>t</title><script>if (a < b) '<p>no</p>'</script></head><body><header>Site</header><nav><a href=/>Home</a></nav>"
         "{0}<aside>side</aside><div class='comments'><p>reader</p></div><form><p>sign up</p></form><footer>&copy; x</footer></body></html>")


def texts(spark, pages):
    df = spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in pages], SCHEMA)
    return {r.page_id: r.text for r in main_text(df).collect()}


def test_article_alone_is_kept(spark):
    pages = [(1, "http://h.example/1", FRAME.format("<article><h1>One &amp; two</h1><p>First<b>bold</b> <br> line<p>Second\n\tline</article>")),
             (2, "http://h.example/2", FRAME.format("<article><h1>Other</h1><p>a</p><p>b</p><ul><li>c<li>d</ul><div class='ad-box'>buy</div></article>")),
             (3, "http://other.example/", FRAME.format("<main><p>only page</p></main>")), (4, None, None), (5, "http://h.example/5", ""),
             (6, "http://h.example/6", "<article><p>unclosed <!-- c --><p>x &lt; y")]
    assert texts(spark, pages) == {1: "One & two\n\nFirstbold line\n\nSecond line", 2: "Other\n\na\n\nb\n\nc\n\nd", 3: "only page", 4: "", 5: "",
                                   6: "unclosed\n\nx < y"}


def test_templates_are_told_from_text_where_no_article_is_marked(spark):
    page = "<body><div><a href=1>One</a> <a href=2>Two</a></div><div>All rights kept</div><div><h2>{0}</h2><p>{0} text</p></div></body>"
    pages = [(i, f"http://t.example/{i}", page.format(f"Story {i}")) for i in range(5)]
    assert texts(spark, pages) == {i: f"Story {i}\n\nStory {i} text" for i in range(5)}


def test_pages_without_a_mark_on_a_host_with_marked_ones(spark):
    plain = "<body><div><a href=1>One</a></div><div>All rights kept</div><div><h2>{0}</h2><p>{0} text</p></div></body>"
    story = "<body><div><a href=1>One</a></div><div>All rights kept</div><article><h2>{0}</h2><p>{0} text</p></article></body>"
    pages = [(i, u, (story if i % 4 == 0 else plain).format(f"Story {i}")) for i in range(8) for u in [f"http://m.example/{i}" if i < 4 else None]]
    assert texts(spark, pages) == {i: f"Story {i}\n\nStory {i} text" for i in range(8)}


def test_names_do_not_empty_an_article(spark):
    a = "<article class='post comments-open'><p>a{0}</p><div class='social-science'><p>b{0}</p></div><div class='no-sidebar'>c{0}</div><div class='notice'>d{0}</div>{1}</article>"
    b = "<div class='sidebar-wrapper'><h1>a{0}</h1><p>b{0} and a long text of the page</p></div><div class='site-banner'>Join us</div><div class='comments'><p>me too</p></div>"
    c = "<form id='f'><main class='widget'><p>a{0} b{0}</p></main></form><div class='related'><article><p>more</p></article></div>"
    d = "<article><p>a{0}</p><div class='share'>Tell others</div><div class='comments-list'>x{0}</div><div class='ad'>y{0}</div></article>"
    pages = [(10 * k + i, f"http://{k}.example/{i}", f"<body class='has-sidebar'>{x.format(i, '')}</body>") for k, x in enumerate((a, b, c, d)) for i in range(3)]
    want = ["a{0}\n\nb{0}\n\nc{0}\n\nd{0}", "a{0}\n\nb{0} and a long text of the page", "a{0} b{0}", "a{0}"]
    assert texts(spark, pages) == {10 * k + i: x.format(i) for k, x in enumerate(want) for i in range(3)}


def test_copies_with_a_shape_of_their_own_keep_their_texts(spark):
    page = "<body><div>All rights kept</div><div><h2>{0}</h2><p>{0} text</p></div></body>"
    own = "<body><div>All rights kept</div><div><h2>Own</h2><blockquote>Said</blockquote><table><tr><td>cell</td></tr></table><p>twice</p><hr><p>twice</p></div></body>"
    pages = [(i, f"http://c.example/{i}", own if i > 5 else page.format(f"Story {i}")) for i in range(8)]
    two = [(i, f"http://d.example/{i}", own) for i in (10, 11)]
    want = {i: "Own\n\nSaid\n\ncell\n\ntwice\n\ntwice" for i in (6, 7)} | {i: f"Story {i}\n\nStory {i} text" for i in range(6)}
    alone = "All rights kept\n\nOwn\n\nSaid\n\ncell\n\ntwice\n\ntwice"
    assert texts(spark, pages + two) == want | {10: alone, 11: alone}


def test_deep_unclosed_and_long_pages(spark):
    """Nesting beyond the depth that is kept loses no text; open tags and quotes cost no more than the page's length."""
    deep = "<article>" + "<div>" * 1500 + "<p>inside</p>" + "</div>" * 1500 + "<p>after</p></article>"
    pages = [(1, "http://x.example/1", deep), (2, "http://x.example/2", "<article><p>a</p></article>" + "<a " * 100_000),
             (3, "http://x.example/3", "<article><p>b</p>" + "<a \"x" * 50_000 + "</article>"), (4, "http://x.example/4", "<div>" * 3000 + "text"),
             (5, "http://y.example/5", "<article>" + "<p>word</p>" * 200_000 + "</article>"),
             (6, "http://z.example/6", "<article><p>c</p></article><!-- open > comment < more"),
             (7, "http://z.example/7", "<article><p>1 &lt; 2 and 2 < 3</p></article>")]
    got = texts(spark, pages)
    assert got[1] == "inside\n\nafter" and got[2].startswith("a") and got[3].startswith("b") and got[4] == "text"
    assert got[5] == "\n\n".join(["word"] * 200_000) and got[6] == "c" and got[7] == "1 < 2 and 2 < 3"


def test_foreign_archive():
    """Records of another writer: no digests, other types, ids that name no page."""
    def record(kind, block, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1>", "Content-Length": str(len(block)), **more}
        return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"

    info = warc.parse(record("warcinfo", b"software: other"))
    assert info[2] == "warcinfo" and info[0] is None and info[4] == 15 and info[6] == b"software: other"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>x"
    plain = warc.parse(record("response", body, **{"WARC-Target-URI": "http://a/", "WARC-Payload-Digest": "sha256:00"}))
    assert plain[1:5] == ("http://a/", "response", None, 4) and plain[6] == b"<p>x"
    assert warc.parse(record("response", b"no http here"))[6] == b"no http here"
    assert warc.parse(record("revisit", b"", **{"WARC-Refers-To": "<urn:uuid:2>"}))[3:] == (None, None, None, None)
    assert warc.parse(record("request", b"GET / HTTP/1.1\r\n\r\n"))[2] == "request"
    with pytest.raises(warc.BadRecord):
        warc.parse(record("resource", b"x", **{"WARC-Block-Digest": "sha1:" + "A" * 32}))


def test_no_pages(spark):
    assert texts(spark, []) == {}


def test_a_slot_of_a_third_of_all_pages_is_not_the_templates(spark):
    """A text on 20 of a host's 60 pages, which are those of smallest hash: all pages are counted, not the first of them."""
    def page(line, i):
        return f"<html><body>{line}<div><p>Story {i} of the day</p></div></body></html>"

    def low(text):
        return hashlib.md5("\n".join(_content(parse(text))).encode()).hexdigest() < "8"

    line = "<section>One line</section>"
    some = [p for p in (page(line, i) for i in range(200)) if low(p)][:20]
    others = [p for p in (page("", i) for i in range(200, 600)) if not low(p)][:40]
    rows = [(i, f"http://h/{i}", p) for i, p in enumerate(some + others)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i].startswith("One line\n\nStory") for i in range(20))
    most = [(i, u, p) for i, u, p in rows if i < 35]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(most, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i].startswith("Story") for i in range(35))
