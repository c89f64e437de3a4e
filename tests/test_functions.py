"""Pure functions: the cascade, package documents, fonts, images, references, names."""

import pytest
from pyspark.sql import functions as F

from quiresmith.functions import css, dom, naming, package, paths, raster, references, sfnt, text
from quiresmith.operators import fonts
from tests import books as B

FACE = '@font-face{font-family:"T";src:url(f.ttf)} '


def shown(style, body, extra=None):
    """Text set in font f.ttf."""
    files = {"m.css": style, **(extra or {})}
    page = B.xhtml(body, '<link rel="stylesheet" href="m.css"/>')
    found = fonts.effective(page, "p.xhtml", files.get, {"t": "f.ttf", "u": "g.ttf"})
    return "".join("".join(t).strip() for _, f, t in found if f == "f.ttf")


@pytest.mark.parametrize(
    ("style", "body", "want"),
    [
        ("p{font-family:T} .x{font-family:U}", "<p>a<b class='x'>b</b></p>", "a"),
        ("p{font-family:serif,T}", "<p>a</p>", ""),
        ("p{font-family:Unknown, T}", "<p>a</p>", "a"),
        ("p{font-family:T !important} #i{font-family:U}", "<p id='i'>a</p>", "a"),
        ("p{font-family:T}", "<p style='font-family:U'>a</p><p style='font: bold 12px/1 \"T\", serif'>b</p>", "b"),
        ("@media print{p{font-family:T}} @media screen{b{font-family:T}}", "<p>a<b>b</b></p>", "b"),
        ("@media not screen{p{font-family:T}}", "<p>a</p>", ""),
        ("@supports (display:none){p{font-family:T}} @supports (nope:1){b{font-family:T}} @supports not (nope:1){i{font-family:U}}", "<p>a</p><b>b</b>", "a"),
        ("@container (width>1px){p{font-family:T}}", "<p>a</p>", ""),
        ("@layer a,b; @layer b{p{font-family:T}} @layer a{p{font-family:U}}", "<p>a</p>", "a"),
        ("@layer a,b; @layer b{p{font-family:T!important}} @layer a{p{font-family:U!important}}", "<p>a</p>", ""),
        ("@layer a{p{font-family:U}} p{font-family:T}", "<p>a</p>", "a"),
        ("@layer a,b; @layer a{p{font-family:T}} @layer b{p{font-family:revert-layer}}", "<p>a</p>", "a"),
        ("@scope (.r){p{font-family:T}}", "<div class='r'><p>a</p></div><p>b</p>", "a"),
        ("@scope (.r) to (.l){p{font-family:T}}", "<div class='r'><p>a</p><div class='l'><p>b</p></div></div>", "a"),
        ("@scope (.o){p{font-family:U}} @scope (.n){p{font-family:T}}", "<div class='n'><div class='o'><p>b</p></div></div><div class='o'><div class='n'><p>a</p></div></div>", "a"),
        ("p{font-family:T} b{font-family:initial} i{font-family:inherit} u{all:unset} s{all:initial}", "<p>a<b>b</b><i>c</i><u>d</u><s>e</s></p>", "acd"),
        (":root{--f:T} p{font-family:var(--f)} b{--f:U} b p{font-family:var(--f)}", "<p>a</p><b><p>b</p></b>", "a"),
        ("p{font-family:var(--none, T)} b{font-family:var(--a)} :root{--a:var(--b);--b:var(--a)}", "<p>a<b>b</b></p>", "ab"),
        ("p:not(.x, .y){font-family:T}", "<p class='x'>b</p><p>a</p>", "a"),
        ("p:nth-child(2n+1 of .k){font-family:T}", "<p>z</p><p class='k'>a</p><p class='k'>b</p><p class='k'>c</p>", "ac"),
        (":is(p,#id) b{font-family:T} p b{font-family:U}", "<p><b>a</b></p>", "a"),
        (":where(#id,p){font-family:U} p{font-family:T}", "<p>a</p>", "a"),
        ("h1 + p, h1 ~ i{font-family:T}", "<h1>x</h1><p>a</p><i>b</i><p>c</p>", "ab"),
        ("div > p{font-family:T}", "<div><p>a</p><i><p>b</p></i></div>", "a"),
        ("[data-k^='v'][lang|=en]{font-family:T}", "<p data-k='vx' lang='en-US'>a</p><p data-k='x' lang='en'>b</p>", "a"),
        ("p::before{font-family:T} p, b:{font-family:T}", "<p>a</p>", ""),
        ("/* p{font-family:T} */ p{font-family:'T' /* ; */}", "<p>a</p>", "a"),
        ("svg|p{font-family:T}", "<p>a</p>", "a"),
    ],
)
def test_cascade(style, body, want):
    assert shown(style, body) == want


def test_imports_and_document_order():
    more = {"i.css": "p{font-family:T}", "j.css": "p{font-family:U}", "loop.css": '@import "m.css"; b{font-family:T}'}
    assert shown('@import "i.css"; b{x:y}', "<p>a</p>", more) == "a"
    assert shown('b{x:y} @import "i.css";', "<p>a</p>", more) == ""
    assert shown('@import url(i.css) print;', "<p>a</p>", more) == ""
    assert shown('@import "i.css" supports(display:none) screen;', "<p>a</p>", more) == "a"
    assert shown('@import "i.css" layer(x); p{font-family:U}', "<p>a</p>", more) == ""
    assert shown('@import "loop.css";', "<p>a<b>b</b></p>", more) == "b"
    page = B.xhtml("<p>a</p>", '<style>p{font-family:U}</style><link rel="stylesheet" href="i.css"/><link rel="alternate stylesheet" href="j.css"/><style media="print">p{font-family:U}</style>')
    assert [f for _, f, _ in fonts.effective(page, "p.xhtml", more.get, {"t": "f.ttf", "u": "g.ttf"})] == ["f.ttf"]
    assert fonts.family_files([("s/a.css", FACE + "@font-face{font-family:T;src:url(no.ttf),url('../F.TTF?x#y')}")], {"f.ttf": B.font("a", "Inner  Name")}) == {"f": "f.ttf", "inner name": "f.ttf", "t": "f.ttf"}


def test_tree_and_translate_number_alike():
    page = B.xhtml("<p>a<br>b<!--<i>--><b>c</b>&lt;d</p><script>x<y</script><i>e</i>")
    root = dom.parse(page)
    table = {e.node_id: {c: c.upper() for c in "abcde"} for e in root.walk() if e.tag in ("p", "i")}
    assert "<p>A<br>B<!--<i>--><b>c</b>&lt;D</p><script>x<y</script><i>E</i>" in fonts.translate(page, table.get)


def test_package_documents():
    bad = '<package version="2.0"><metadata/><manifest><item id="a" href="x&y.html" media-type="t"/></manifest><spine><itemref idref="a"/></spine></package>'
    assert package.parse(bad)["parse_mode"] == "sanitised" and package.parse(bad)["manifest"][0]["href"] == "x&y.html"
    worse = bad.replace("</spine>", "").replace(' version="2.0"', "")
    assert package.parse(worse)["parse_mode"] == "pattern" and package.parse(worse)["version"] == "2.0" and package.parse(worse)["spine"][0]["idref"] == "a"
    for doc in (bad, "<package><metadata>\n  <x/>\n  </metadata></package>", "<opf:package><opf:metadata></opf:metadata></opf:package>", "<package></package>"):
        once = package.stamp(doc)
        assert package.stamped(once) and package.stamp(once) == once
    assert package.rename_ids('<itemref idref="a"/><meta refines="#a"/><meta name="cover" content="a"/><meta name="x" content="a"/>', {"a": "b"}) == '<itemref idref="b"/><meta refines="#b"/><meta name="cover" content="b"/><meta name="x" content="a"/>'
    assert package.decode("é".encode("utf-16")) == package.decode("é".encode()) == package.decode('<?xml encoding="latin-1"?>é'.encode("latin-1"))[-1] == "é"
    assert package.decode("汉".encode("gb18030")) == "汉"
    assert package.as_utf8('<?xml version="1.0" encoding="gbk"?>x') == '<?xml version="1.0" encoding="utf-8"?>x'


def test_fonts_on_bytes():
    chars = "汉字Az😀\u3002"
    data = B.font(chars, "Näme")
    assert sfnt.read_cmap(data) == {ord(c): i + 1 for i, c in enumerate(chars)} == sfnt.read_cmap(B.woff(data)) and sfnt.names(data) == ["Näme"]
    moved = sfnt.remap(data, {ord("汉"): ord("字"), ord("字"): ord("汉"), ord("A"): 0xE000})
    got = sfnt.read_cmap(moved)
    assert got[ord("字")] == 1 and got[ord("汉")] == 2 and got[0xE000] == 3 and ord("A") not in got
    assert sfnt._sum(moved) == 0xB1B0AFBA
    for junk in (b"", b"wOF2....", b"\0\1\0\0\0\1" + b"x" * 30):
        with pytest.raises((sfnt.FontError, ValueError, Exception)):
            sfnt.read_cmap(junk)


def test_images_by_header():
    assert raster.facts(B.png(7, 5)) == {"format": "PNG", "width": 7, "height": 5, "has_alpha": False}
    assert raster.facts(B.webp()) == {"format": "WEBP", "width": 2, "height": 2, "has_alpha": True}
    assert raster.facts(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x05\x00\x07\x01\x00\x00\x00") == {"format": "JPEG", "width": 7, "height": 5, "has_alpha": False}
    assert raster.facts(b"GIF89a\x02\x00\x03\x00")["height"] == 3 and raster.facts(b"zz") is None and raster.facts(b"\x89PNG\r\n\x1a\n") is None
    assert raster.facts(raster.recompress_png(B.png(9, 9)))["width"] == 9


def test_references():
    up = lambda r: r.upper()
    assert references.srcset("a.png 1x, b.png 2x", up) == "A.PNG 1x, B.PNG 2x"
    assert references.rewrite_markup("<a href='x'>href='y'</a><!-- <a href='z'> --><p style=\"background:url(q)\"/>", up) == "<a href='X'>href='y'</a><!-- <a href='z'> --><p style=\"background:url(Q)\"/>"
    assert references.rewrite_css("@import 'a'; p{x:url( \"b\" )}", up) == "@import 'A'; p{x:url( \"B\" )}"
    assert paths.redirect("../I/a.webp?q#f", "OPS/T/p.xhtml", "OPS/I/a b.png") == "../I/a%20b.png?q#f"
    assert paths.resolve_reference("OPS/T/p.xhtml", "../I/%61.png#x") == "OPS/I/a.png" and paths.resolve_reference("p", "http://x/y") is None and paths.resolve_reference("p", "#x") is None
    for bad in ("../x", "/x", "", ".", "a/../../b", "C:/x"):
        with pytest.raises(ValueError):
            paths.normalise_member(bad)
    assert paths.normalise_member("a\\b/./c") == "a/b/c"


def test_columns(spark):
    one = spark.range(1)
    names = F.array(*map(F.lit, ["a", "a", "a_1", "b.x", "b.x"]))
    assert one.select(naming.unique_names(names)).first()[0] == ["a", "a_1", "a_1_1", "b.x", "b_1.x"]
    assert one.select(naming.unique_names(names, "-", 2)).first()[0] == ["a", "a-2", "a_1", "b.x", "b-2.x"]
    assert one.select(F.explode(F.array(*map(F.lit, ["A", "汉", " ", "\t", "é", "Ａ"]))).alias("c")).select(text.char_class(F.col("c"))).collect() == [(c,) for c in ("obfuscated", "obfuscated", "blank", "control", "passthrough", "obfuscated")]
    r = one.select(text.binary_name(F.lit("x")), naming.slim_base(F.lit("a~Slim.png")), naming.is_slim(F.lit("a.png"))).first()
    import hashlib

    assert r[0] == f"{int(hashlib.md5(b'x').hexdigest(), 16):b}".replace("1", "*").replace("0", ":") and r[1] == "a.png" and r[2] is False
    assert [tuple(x) for x in one.select(naming.output_suffix(F.lit("chinese_convert"), F.lit("s2t")), naming.output_suffix(F.lit("replace_cover"))).collect()] == [("_chinese_convert_tc", "_replace_cover")]
