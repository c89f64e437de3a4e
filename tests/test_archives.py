"""Whole jobs over synthetic archives."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quiresmith.functions import package, sfnt
from quiresmith.operators import archive, fonts, manifest, rewrite, runner, workspace
from quiresmith.sources import epub
from quiresmith.streaming import jobs as streaming
from tests import books as B

ITEMS = [
    ("c1", "Text/a.xhtml", "application/xhtml+xml", ""), ("c2", "text/B.xhtml", "application/xhtml+xml", ""), ("css", "s/m.css", "text/css", ""),
    ("im", "i/a.png", "image/png", ' properties="cover-image"'), ("im2", "j/a.png", "image/png", ""), ("gone", "no.xhtml", "application/xhtml+xml", ""), ("ncx", "toc.ncx", "application/x-dtbncx+xml", ""),
]
BODY = '<p><a href="B.xhtml#x">b</a><img src="../i/A.png" alt="x"/><img src="../j/a.png"/><a href="http://x.y/z">e</a><a href="#l">l</a><a href="lost.xhtml">?</a></p>'
MEMBERS = [
    ("OPS/package.opf", B.opf(ITEMS, ["c1", "c9"], '<meta name="cover" content="im"/>', '<guide><reference type="toc" href="Text/a.xhtml#g"/></guide>')),
    ("OPS/Text/a.xhtml", B.xhtml(BODY, '<link rel="stylesheet" href="../s/m.css"/>')), ("OPS/Text/B.xhtml", B.xhtml("<p>b</p>")), ("OPS/s/m.css", 'p{background:url("../i/a.png")} @import "x.css";'),
    ("OPS/i/a.png", B.png()), ("OPS/j/a.png", B.png(3, 3)), ("OPS/toc.ncx", '<ncx><content src="Text/a.xhtml#t"/></ncx>'), ("OPS/1extra.html", B.xhtml("<p>loose</p>")),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("books")
    (d / "sub").mkdir()
    (d / "one.epub").write_bytes(B.epub(MEMBERS))
    (d / "sub" / "TWO.EPUB").write_bytes(B.epub(MEMBERS, first=False))
    (d / "bad.epub").write_bytes(B.epub([*MEMBERS, ("../up", "x")]))
    (d / "twice.epub").write_bytes(B.epub([("OPS/package.opf", MEMBERS[0][1]), ("OPS/./package.opf", "x")]))
    (d / "junk.epub").write_bytes(b"no archive")
    (d / "note.txt").write_text("x")
    return d


@pytest.fixture(scope="module")
def members(spark, folder):
    books = epub.books(spark, [str(folder)])
    return epub.members(books.withColumn("book_id", epub.file_name(F.col("book_id")))).cache()


def test_scan_and_quarantine(spark, folder, members):
    found = {r.book_id: r.n for r in members.where("error IS NULL").groupBy("book_id").agg(F.count("*").alias("n")).collect()}
    assert found == {"one.epub": 10, "TWO.EPUB": 10}
    bad = {r.book_id: r.error for r in members.where("error IS NOT NULL").collect()}
    assert set(bad) == {"bad.epub", "twice.epub", "junk.epub"} and "unsafe" in bad["bad.epub"] and "duplicate" in bad["twice.epub"]
    p = epub.packages(members.where("error IS NULL"))
    assert epub.manifest(p).count() == 14 and epub.spine(p).count() == 4
    m = epub.metadata(p).first()
    assert (m.opf_path, m.version, m.title, m.cover, m.toc_id, m.parse_mode) == ("OPS/package.opf", "3.0", "T", "im", "ncx", "xml")


def test_repair(spark, members):
    good = members.where("error IS NULL AND book_id = 'one.epub'")
    res = {r.id: r for r in rewrite.resources(epub.packages(good), good).collect()}
    assert set(res) == {"c1", "c2", "css", "im", "im2", "ncx", "x1extra.html"} and res["c2"].book_path == "OPS/Text/B.xhtml"
    assert res["x1extra.html"].origin == "discovered" and res["ncx"].resource_type == "toc"
    spine = epub.spine(epub.packages(good)).select("book_id", "idref")
    got = {(r.kind, r.value) for r in manifest.issues(rewrite.resources(epub.packages(good), good), spine).collect()}
    assert ("invalid_idref", "c9") in got and ("xhtml_not_in_spine", "OPS/Text/B.xhtml") in got


@pytest.mark.parametrize("policy", [rewrite.REFORMAT, rewrite.ENCRYPT])
def test_rewrite_keeps_every_link(spark, members, policy):
    done = rewrite.run(members.where("book_id <> 'TWO.EPUB'"), policy)
    packed = archive.pack(done["members"]).collect()
    assert [r.book_id for r in packed] == ["one.epub"] and packed[0].error is None
    z = zipfile.ZipFile(io.BytesIO(packed[0].content))
    names = z.namelist()
    assert names[0] == "mimetype" and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED
    assert len(names) == len(set(names)) == 10 and "OEBPS/toc.ncx" in names
    parsed = package.parse(z.read("OEBPS/content.opf").decode())
    assert len(parsed["manifest"]) == 7 and all(f"OEBPS/{i['href']}" in names for i in parsed["manifest"])
    assert package.stamped(z.read("OEBPS/content.opf").decode())
    from quiresmith.functions import paths, references

    for name in names:
        if name.endswith((".xhtml", ".ncx", ".html")):
            for ref in references.references(z.read(name).decode()):
                target = paths.resolve_reference(name, ref)
                assert target is None or target in names or "lost" in ref, (name, ref)
    issues = {(r.doc_path, r.href, r.status) for r in done["link_issues"].collect()}
    assert ("OPS/Text/a.xhtml", "../i/A.png", "corrected") in issues and ("OPS/Text/a.xhtml", "lost.xhtml", "missing") in issues
    if policy == rewrite.REFORMAT:
        assert {"OEBPS/Images/a.png", "OEBPS/Images/a_1.png", "OEBPS/Text/a.xhtml", "OEBPS/Styles/m.css"} <= set(names)
    else:
        assert all(set(n.rpartition("/")[2].partition(".")[0]) <= set("_*:") for n in names if n.startswith("OEBPS/Text/"))
        again = epub.members(spark.createDataFrame([("one.epub", bytearray(packed[0].content))], "book_id string, content binary"), validate=False)
        assert rewrite.run(again, rewrite.ENCRYPT)["skipped"].count() == 1
        back = archive.pack(rewrite.run(again, rewrite.DECRYPT)["members"]).first()
        names = zipfile.ZipFile(io.BytesIO(back.content)).namelist()
        assert {"OEBPS/Text/c1.xhtml", "OEBPS/Text/c2.xhtml", "OEBPS/Images/im.png"} <= set(names)


def test_decrypt_skips_plain_books(spark, members):
    assert rewrite.run(members, rewrite.DECRYPT)["skipped"].count() == 2


def test_jobs_end_to_end(spark, folder, tmp_path):
    files = [str(folder / "one.epub"), str(folder / "junk.epub"), str(folder / "none.epub"), str(folder / "x_reformat_epub.epub")]
    done = runner.run(spark, runner.Request("reformat_epub", files, str(tmp_path)))
    status = {os.path.basename(f["book_id"]): f["status"] for f in done["files"]}
    assert sorted(f["book_id"] for f in done["files"]) == sorted(files)
    assert status == {"one.epub": "success", "junk.epub": "failed", "none.epub": "failed", "x_reformat_epub.epub": "skipped"}
    assert done["result"]["status"] == "partial" and done["result"]["summary"] == {"total": 4, "success": 1, "failed": 2, "skipped": 1}
    assert [os.path.basename(p) for p in done["result"]["outputs"]] == ["one_reformat_epub.epub"] == os.listdir(tmp_path)
    assert done["events"][-1]["progress"] == 100.0 and done["events"][0]["event"] == "task.started"
    for task, o in (("image_compress", {"quality": True}), ("chinese_convert", {}), ("nothing", {}), ("image_to_webp", {"quality": 0}), ("replace_cover", {})):
        with pytest.raises(ValueError):
            runner.run(spark, runner.Request(task, files, str(tmp_path), options=o))
    r = runner.Request.of({"taskType": "encrypt_epub", "inputFiles": ["a"], "outputDir": "o"})
    assert (r.task_type, r.input_files, r.output_dir) == ("encrypt_epub", ["a"], "o")
    assert json.loads(runner.json_line({"a": "é\ud800"}))["a"] == "é\ufffd"


def test_files_of_one_name_stay_books_of_their_own(spark, tmp_path):
    files = []
    for d, word in (("a", "ONE"), ("b", "TWO")):
        (tmp_path / d).mkdir()
        files.append(str(tmp_path / d / "x.epub"))
        item = ("c", "c.xhtml", "application/xhtml+xml", "")
        (tmp_path / d / "x.epub").write_bytes(B.epub([("OPS/package.opf", B.opf([item], ["c"])), ("OPS/c.xhtml", B.xhtml(f"<p>{word}</p>"))]))
    done = runner.run(spark, runner.Request("reformat_epub", files, str(tmp_path / "out")))
    assert done["result"]["summary"] == {"total": 2, "success": 2, "failed": 0, "skipped": 0}
    again = epub.members(epub.books(spark, [str(tmp_path / "out")])).where("ext = 'xhtml'").collect()
    assert sorted((epub_name(r.book_id), "ONE" in bytes(r.content).decode()) for r in again) == [("x_reformat_epub.epub", True), ("x_2_reformat_epub.epub", False)][::-1]


def epub_name(path):
    return path.rpartition("/")[2]


def test_encryption_and_policies(spark):
    from quiresmith.functions import package, text

    assert package.encryption("<no") is None
    assert package.encryption("<encryption/>") == {"uris": [], "key_names": [], "algorithms": [], "text_or_css": False}
    assert package.encryption('<e><CipherReference URI="x/OEBPS/Styles/a.css"/><CipherReference/></e>')["text_or_css"]
    assert [text.policy_of(x) for x in (None, "", " EXTERNAL ", "compatible", "nonsense")] == ["strict", "strict", "compatible", "compatible", "strict"]
    assert [len(text.pool(p)) for p in ("ascii", "fullwidth", "wide")] == [62, 62, 11172]


def test_images_and_covers(spark):
    page = B.xhtml('<img src="../Images/a.webp?r=1#i" srcset="../Images/a.webp 1x, data:image/png;base64,AA,BB 2x"/>')
    items = [("p", "Text/p.xhtml", "application/xhtml+xml", ""), ("w", "Images/a.webp", "image/webp", ""), ("x", "Images/x.png", "image/png", "")]
    book = [("OPS/package.opf", B.opf(items, ["p"])), ("OPS/Text/p.xhtml", page), ("OPS/Images/a.webp", B.webp()), ("OPS/Images/a.png", B.png()), ("OPS/Images/x.png", b"\x89PNG broken")]
    df = epub.members(spark.createDataFrame([("b.epub", bytearray(B.epub(book)))], "book_id string, content binary"))
    done = workspace.convert_images(df, "webp_to_image", codec=lambda data, fmt: B.png() if fmt == "PNG" else b"")
    out = {r.path: bytes(r.content) for r in done["members"].collect()}
    assert "OPS/Images/a-2.png" in out and "OPS/Images/a.webp" not in out
    text = out["OPS/Text/p.xhtml"].decode()
    assert '"../Images/a-2.png?r=1#i"' in text and "../Images/a-2.png 1x" in text and "data:image/png;base64,AA,BB 2x" in text
    assert 'href="Images/a-2.png" media-type="image/png"' in out["OPS/package.opf"].decode()
    facts = {r.path: r for r in done["images"].collect()}
    assert facts["OPS/Images/a.webp"].has_alpha and facts["OPS/Images/a.webp"].action == "encode:PNG" and facts["OPS/Images/x.png"].action == "keep"
    small = workspace.convert_images(df, "compress")["images"].collect()
    assert all(r.bytes_out <= r.bytes_in for r in small) and {r.error for r in small if r.detected_format == "WEBP"} == {"ValueError: no encoder for WEBP"}
    covers = spark.createDataFrame([("b.epub", bytearray(B.png(5, 5)))], "book_id string, cover binary")
    out = {r.path: bytes(r.content) for r in workspace.replace_covers(df, epub.packages(df), covers).collect()}
    parsed = package.parse(out["OPS/package.opf"].decode())
    assert out["OPS/Images/cover.png"] == B.png(5, 5) and parsed["metadata"]["cover"] == "cover-image" and parsed["manifest"][-1]["properties"] == "cover-image"


def test_text_conversion(spark):
    body = '<p title="汉字">汉字们<!--汉--><script>汉</script><b class="汉">后汉书</b></p>'
    df = spark.createDataFrame([("b", 0, "a.xhtml", "xhtml", bytearray(('<?xml version="1.0" encoding="utf-16"?>' + B.xhtml(body)).encode("utf-16"))), ("b", 1, "a.css", "css", bytearray("汉".encode()))], "book_id string, ord int, path string, ext string, content binary")
    done = workspace.convert_text(df, {"汉": "漢", "汉字": "漢字", "后汉书": "後漢書"})
    out = {r.path: bytes(r.content).decode() for r in done["members"].collect()}
    assert '<p title="漢字">漢字们<!--汉--><script>汉</script><b class="汉">後漢書</b></p>' in out["a.xhtml"] and 'encoding="utf-8"' in out["a.xhtml"] and out["a.css"] == "汉"
    assert done["changed"].first().changed == 1


def font_book(spark):
    css = '@font-face{font-family:"Obf";src:url("../Fonts/f.ttf")} p{font-family:Obf, serif} .n{font-family:serif}'
    page = B.xhtml('<p>汉字A。<b class="n">汉</b>&amp;z</p><div>字</div>', '<link rel="stylesheet" href="../Styles/m.css"/>')
    data = B.font("汉字A。0", "Own Name")
    book = [("OPS/package.opf", B.opf([("p", "Text/p.xhtml", "application/xhtml+xml", ""), ("f", "Fonts/f.ttf", "font/ttf", "")], ["p"])), ("OPS/Text/p.xhtml", page), ("OPS/Styles/m.css", css), ("OPS/Fonts/f.ttf", data)]
    return epub.members(spark.createDataFrame([("b.epub", bytearray(B.epub(book)))], "book_id string, content binary")).cache()


def test_font_jobs(spark, tmp_path):
    df = font_book(spark)
    assert fonts.list_families(df).first().families == ["Obf"]
    assert [(r.font, r.chars) for r in fonts.usage(df).collect()] == [("OPS/Fonts/f.ttf", "汉字A。&z")]
    done = fonts.obfuscate(df, seed=3)
    moves = {r.src: r.dst for r in done["char_map"].collect()}
    assert set(moves) == {"汉", "字", "A"} and all(s != d for s, d in moves.items()) and len(set(moves.values())) == 3
    assert moves["A"].isascii() and moves["A"].isalnum() and all(0xAC00 <= ord(moves[c]) <= 0xD7AF for c in "汉字")
    out = {r.path: bytes(r.content) for r in done["members"].collect()}
    old, new = sfnt.read_cmap(B.font("汉字A。0")), sfnt.read_cmap(out["OPS/Fonts/f.ttf"])
    assert all(new[ord(d)] == old[ord(s)] for s, d in moves.items()) and new[ord("0")] == old[ord("0")]
    text = out["OPS/Text/p.xhtml"].decode()
    assert f'<p>{moves["汉"]}{moves["字"]}{moves["A"]}。<b class="n">汉</b>&amp;z</p><div>字</div>' in text
    low = moves["A"]
    back = fonts.recover(done["members"], lambda f, data, c: ({v: k for k, v in moves.items()}[c], 0.99 if c != low else 0.1))
    got = {r.src: (r.dst, r.status) for r in back.collect()}
    assert got[moves["汉"]] == ("汉", "ok") and got[low] == (f"[U+{ord(low):04X} OCR_LOW_CONF]", "OCR_LOW_CONF")
    none = fonts.obfuscate(df, seed=3, targets=spark.createDataFrame([("b.epub", "Other")], "book_id string, family string"))
    assert none["char_map"].count() == 0
    named = fonts.obfuscate(df, seed=3, targets=spark.createDataFrame([("b.epub", "'obf'")], "book_id string, family string"))
    assert {r.src: r.dst for r in named["char_map"].collect()} == moves
    clean = fonts.remove_references(df, spark.createDataFrame([("b.epub", "OPS/Fonts/f.ttf")], "book_id string, path string"))
    out = {r.path: bytes(r.content).decode() for r in clean.collect()}
    assert "OPS/Fonts/f.ttf" not in out and out["OPS/Styles/m.css"] == "p{font-family:serif} .n{font-family:serif}" and "f.ttf" not in out["OPS/package.opf"]
    assert fonts.failure_path("OPS", b"x", "字", "OCR_EMPTY").endswith("_U-5B57_OCR_EMPTY.png")


def test_streaming_front_end(spark, folder, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    rows = [{"task_id": "1", "task_type": "reformat_epub", "input_files": [str(folder / "one.epub")], "output_dir": str(tmp_path / "out")}, {"task_id": "2", "task_type": "nothing", "input_files": []}]
    (inbox / "r.json").write_text("\n".join(map(json.dumps, rows)))
    said = []
    q = streaming.serve(spark, str(inbox), said.append, str(tmp_path / "cp"))
    q.awaitTermination(180)
    assert {s["request_id"]: s["ok"] for s in said} == {"1": True, "2": False}
    assert os.listdir(tmp_path / "out") == ["one_reformat_epub.epub"]
    ev = tmp_path / "ev"
    spark.createDataFrame([("1", "task.file.finished", s, "2024-01-01 0%d:30:00" % h) for h, s in ((1, "success"), (1, "failed"), (2, "success"), (5, "success"))], "task_id string, event string, status string, t string").selectExpr("task_id", "event", "status", "cast(t as timestamp) ts").write.json(str(ev))
    stream = spark.readStream.schema(streaming.EVENT).json(str(ev))
    q = streaming.hourly(stream).writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.n for r in spark.table("hours").collect()) == 3
    assert streaming.new_books(spark, str(folder)).isStreaming


def visible(html, apart=("script", "style")):
    """(words of visible text, everything else) of a page, by the standard library's parser alone."""
    from html.parser import HTMLParser

    text, rest = [], []

    class Reader(HTMLParser):
        inside = None

        def handle_starttag(self, tag, attrs):
            rest.append((tag, attrs))
            self.inside = tag if tag in apart else self.inside

        def handle_endtag(self, tag):
            rest.append(tag)
            self.inside = None if tag == self.inside else self.inside

        def handle_data(self, data):
            (rest if self.inside else text).append(data)

    reader = Reader()
    reader.feed(html)
    reader.close()
    return "".join(text).split(), rest


def in_paragraphs(html):
    """Text whose nearest p or b is a p: what the books' style sheet sets in the embedded font."""
    from html.parser import HTMLParser

    text, opened = [], []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag not in ("br", "img", "meta", "link", "input", "hr"):
                opened.append(tag)

        def handle_endtag(self, tag):
            if tag in opened:
                while opened.pop() != tag:
                    pass

        def handle_data(self, data):
            if next((t for t in reversed(opened) if t in ("p", "b")), "") == "p":
                text.append(data)

    reader = Reader()
    reader.feed(html)
    reader.close()
    return "".join(text)


def test_whole_pages_converted_and_set_in_fonts(spark, sf_dir):
    from quiresmith.plans import archives

    pages = {f"OPS/Text/{r.page_id}.xhtml": r.html or "" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    scan = archives.scanned(spark, sf_dir, whole=True).where("error IS NULL")
    out = workspace.convert_text(scan, {"e": "\u00eb"})["members"].where("ext = 'xhtml'").collect()
    assert {r.path for r in out} == set(pages)
    for r in out:
        before, after = visible(pages[r.path]), visible(bytes(r.content).decode().partition("../m.css\"/>")[2])
        assert after[0] == [w.replace("e", "\u00eb") for w in before[0]] and after[1] == before[1]
    set_in = {}
    for r in fonts.pieces(scan).collect():
        if r.path in pages:
            set_in.setdefault(r.path, []).append(r)
    for path, html in pages.items():
        own = sorted(set_in[path], key=lambda r: r.pos)
        assert sorted("".join("".join(r.text.split()) for r in own if r.font)) == sorted("".join(in_paragraphs(html).split()))
        assert sorted("".join("".join(r.text.split()) for r in own)) == sorted("".join(visible(html, ("script", "style", "title"))[0]))
