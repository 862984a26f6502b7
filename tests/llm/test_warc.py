import base64
import hashlib
from html.parser import HTMLParser

from gridspan.llm import warc_derivatives as w


class Reference(HTMLParser):
    hidden = set(w._HIDDEN.split("|"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.links = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in self.hidden:
            self.skip += 1
            self.out.append("\n")
        elif tag in w._BLOCK:
            self.out.append("\n")
        if tag == "a" and dict(attrs).get("href") and dict(attrs)["href"] not in self.links:
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        if tag in self.hidden:
            self.skip = max(0, self.skip - 1)
            self.out.append("\n")
        elif tag in w._BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data.replace("\n", " "))

    def text(self):
        lines = (" ".join(x.split()) for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


def test_text_of_pages_as_a_parser_reads_it(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        if not r.html.rstrip().endswith("</html>"):
            continue  # a page that breaks off inside a tag
        p = Reference()
        p.feed(r.html)
        p.close()
        text, links, _, _ = w.plain_text(r.html, None)
        assert text == p.text(), r.page_id
        assert links == p.links


def test_odd_markup():
    t = lambda s: w.plain_text(s, "http://h/a/b")
    assert t("a<!-- <p>x -->b<script>if (a<b) '</p>'</script>c")[0] == "ab\nc"
    assert t('<p title="a>b">x</p>y')[0] == "x\ny"
    assert t("1 < 2 & 3 &amp; 4 &eacute;&#233;&nbsp;z")[0] == "1 < 2 & 3 & 4 éé z"
    assert t("<p>cut off <b")[0] == "cut off"
    assert t("<style>x")[0] == "" and t("")[0] == ""
    assert t('<a href="../c?x=1&amp;y=2">l</a><a href=\'#f\'>m</a><a href=mailto:q>n</a>')[1] == ["http://h/c?x=1&y=2", "http://h/a/b#f"]
    assert t("<title> A\n B </title><meta charset=UTF-8>x")[2:] == ("A B", "utf-8")


def test_records_are_linked(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    responses = {r.page_id: r for r in w.responses_of_pages(pages).collect()}
    rows = w.derivatives_of_pages(pages).collect()
    assert len(rows) == 2 * len(responses) and len({r.record_id for r in rows}) == len(rows)
    by = {r.record_id: r for r in rows}
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for r in rows:
        source = responses[r.page_id]
        assert r.refers_to == source.record_id and by[r.concurrent_to].page_id == r.page_id and by[r.concurrent_to].warc_type != r.warc_type
        assert r.source_payload_digest == source.payload_digest == sha(source.payload.encode())
        assert source.block_digest == sha(source.http_headers.encode() + source.payload.encode())
        assert r.block_digest == sha(r.block.encode()) and r.content_length == len(r.block.encode())
        head = dict(line.split(": ", 1) for line in r.headers.split("\r\n")[1:])
        assert head["WARC-Refers-To"] == source.record_id and head["WARC-Target-URI"] == source.target_uri and int(head["Content-Length"]) == r.content_length
        assert head.get("WARC-Concurrent-To") == (r.concurrent_to if r.warc_type == "metadata" else None)
        if r.warc_type == "metadata":
            assert "source-header: Content-Type: text/html; charset=utf-8\r\n" in r.block and r.block.count("outlink: ") == r.n_outlinks


def test_files_round_trip(spark, sf, tmp_path):
    d = w.derivatives_of_pages(spark.read.parquet(f"{sf}/pages.parquet").limit(20))
    w.write_warc(d.coalesce(2), str(tmp_path / "w"))
    got = {(r.headers, r.block) for r in w.read_warc(spark, str(tmp_path / "w/part-*")).collect()}
    assert got == {(r.headers, r.block) for r in d.collect()}


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "http://a b/\r\nX: y", "", "x"), (2, "http://a b/\r\nX: y", "", "x"), (None, "u", "<p>" * 3000 + "t", None)], "page_id long, url string, html string, block string")
    rows = w.derivatives_of_pages(pages).collect()
    assert len(rows) == 8
    for r in rows:
        assert len(w.parse_warc((r.headers + "\r\n\r\n" + r.block + "\r\n\r\n").encode())) == 1
        assert "\r\nX: y" not in r.headers
    assert w.derivatives_of_pages(pages.limit(0)).count() == 0
