"""The operators against brute force, exact round trips and held-out labels, on small fixtures."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiresmith.llm import chat, html, langid, licenses, mixing, neighbours, packing, quality, tokens, unigram
from quiresmith.llm import queries as registry

TEXTS = [
    None, "", "   ", "word", "a b", "A  b\tC\nd", "é É ß   x", "one two three one two three one two three", "\n\n",
    "x" * 3000, "####$$$ %% & | <b>", "line\nline\nother\nline", " lead and trail ", "tab\tand  two", "🙂 emoji 🙂 🙂", "a\x1cb \x85c",
    "Released under the MIT License.", "the MIT-license and mit  License, Apache License", "general public license " * 5,
]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "n", "m") for i, t in enumerate(texts)], "doc_id long, text string, __text string, n_words string")


EMPTY = "doc_id long, text string, lang string, spans string"


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(0)
    lengths = np.array([5, 0, 1, 7, 3])
    s = -rng.random((lengths.sum(), 3)) * 4
    path = langid.viterbi(s.astype(np.float32), lengths, 1.5)
    at = 0
    for n in lengths:
        part = s[at : at + n]
        best = -1e9
        for k in range(3**n):
            labels = [k // 3**i % 3 for i in range(n)]
            value = sum(part[i, c] for i, c in enumerate(labels)) - 1.5 * sum(a != b for a, b in zip(labels, labels[1:], strict=False))
            best = max(best, value)
        got = path[at : at + n]
        value = sum(part[i, c] for i, c in enumerate(got)) - 1.5 * (got[1:] != got[:-1]).sum()
        assert n == 0 or value == pytest.approx(best, abs=1e-4)
        at += n


def test_language_id_held_out_and_edge_cases(spark, sf_dir):
    out = registry.op1_language_id(spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").where("held_out").collect()
    assert rows and sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.collect())
    train = spark.createDataFrame([(i, "the cat and the dog", "en") for i in range(20)] + [(i + 20, "кот и собака дома", "ru") for i in range(20)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    got = model.label([None, "", "12 34", "the cat", "кот", "the cat and the dog кот и собака дома кот и собака", "漢字"])
    assert got["lang_pred"][:5] == ["und", "und", "und", "en", "ru"] and [s["lang"] for s in got["spans"][5]] == ["en", "ru"]
    assert got["spans"][5][1] == {"first_word": 5, "last_word": 11, "lang": "ru"}
    none = model.label(["漢字 مرحبا", "the cat 漢字漢字"])
    assert none["score"] == [0.0, 0.6] and none["lang_pred"] == ["en", "en"]
    assert none["spans"] == [[{"first_word": 0, "last_word": 1, "lang": "und"}], [{"first_word": 0, "last_word": 1, "lang": "en"}, {"first_word": 2, "last_word": 2, "lang": "und"}]]
    with pytest.raises(ValueError, match="more than"):
        langid.fit(spark.range(langid.MAX_LANGUAGES + 1).selectExpr("id AS doc_id", "'word' AS text", "cast(id AS string) AS lang"))
    assert langid.fit(spark.createDataFrame([], EMPTY)).label(["a"])["lang_pred"] == ["und"]
    assert langid.identify(spark.createDataFrame([], EMPTY), model).collect() == []
    assert len(langid.identify(docs(spark, TEXTS), model).collect()) == len(TEXTS)


def test_language_id_of_long_texts_and_ties(spark, monkeypatch):
    train = spark.createDataFrame([(i, "the cat and the dog", "en") for i in range(9)] + [(i + 20, "le chat et le chien", "fr") for i in range(9)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    long = "the\ncat\nand\nthe\ndog\n" * 60_000 + "le\tchat\tet\tle\tchien\t" * 20_000
    whole = model.label([long])
    monkeypatch.setattr(langid, "_PIECE", 997)
    assert "".join(langid._pieces(long)) == long and all(not (a[-1].isalpha() and b[0].isalpha()) for a, b in zip(langid._pieces(long), langid._pieces(long)[1:], strict=False))
    assert model.label([long]) == whole and whole["lang_pred"] == ["en"] and whole["spans"][0][-1]["last_word"] == 399_999
    assert langid._pieces("x" * 5000) == ["x" * 5000]
    tie = langid.Model(["aa", "bb"], np.zeros((2, langid._BUCKETS), np.float32), np.ones((langid._N_SCRIPTS, 2), bool), 8.0)
    assert tie.label(["some words"])["lang_pred"] == ["aa"]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_license_base_matches_brute_force(spark):
    texts = TEXTS + ["mit license mit license", "submit license", "the mit\x00license", "Apache, License; GENERAL public LICENSE"]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = plain_words(t)
        places = [(k, label) for p, label in licenses.BASE_PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places)), t
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan(spark.createDataFrame([], EMPTY)).collect() == []


def test_license_automata():
    a = licenses.compile_template("t", "<<beginOptional>>The <<var:2>> is<<endOptional>> licensed under <<var:1>> terms<<beginOptional>> of ours<<endOptional>>")
    ok = ["licensed under terms", "the is licensed under good terms", "the x y is licensed under terms of ours"]
    bad = ["the x y z is licensed", "licensed under two many terms", "licensed terms"]
    assert all(a.match(licenses.words_of(t), 0) == len(t.split()) for t in ok)
    assert all(a.match(licenses.words_of(t), 0) == -1 for t in bad)
    mit = next(t for n, t in licenses.TEMPLATES if n == "mit")
    text = re.sub(r"<<var:12>>", "2024 somebody else", mit)
    text = re.sub(r"<<[^>]*>>", "", text)
    scan = licenses.Scanner(licenses.TEMPLATES, licenses.BASE_PHRASES).scan
    assert "mit" in {m["label"] for m in scan("Some words before. " + text)["matches"]}
    assert scan(text.replace("free of charge", "for a charge"))["matches"] == []


def template_pattern(markup):
    """The template as a regular expression over words, each with a blank behind it."""
    out = ""
    for part in re.split(r"(<<[^>]*>>)", markup):
        if part == "<<beginOptional>>":
            out += "(?:"
        elif part == "<<endOptional>>":
            out += ")?"
        elif part.startswith("<<var:"):
            out += r"(?:[^ ]+ ){0,%s}" % part[6:-2]
        else:
            out += "".join(re.escape(w.decode("utf-8", "replace")) + " " for w in licenses.words_of(part))
    return re.compile("(?:^| )" + out)


def test_license_labels_match_brute_force(spark):
    rng = random.Random(9)
    patterns = [(label, template_pattern(t)) for label, t in licenses.TEMPLATES]

    def instance(markup):
        while "<<beginOptional>>" in markup:  # innermost regions first
            markup = re.sub(r"<<beginOptional>>((?:(?!<<beginOptional>>).)*?)<<endOptional>>", lambda m: m[1] if rng.random() < 0.5 else " ", markup, count=1, flags=re.S)
        return re.sub(r"<<var:(\d+)>>", lambda m: " ".join(rng.choice(("some", "one", "2024")) for _ in range(rng.randint(0, int(m[1])))), markup)

    texts = ["Licensed under the Apache License, Version 1.1", "Licensed under the Apache License, Version 2.0", "released under the MIT license and licensed under the GNU General Public License"]
    for _, t in licenses.TEMPLATES:
        whole = instance(t)
        words = whole.split()
        broken = list(words)
        broken[rng.randrange(len(words))] = "otherwise"
        texts += [f"before {whole} after", " ".join(broken), " ".join(words[: len(words) // 2]), whole.upper()]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    found = set()
    for i, t in enumerate(texts):
        joined = "".join(w.decode("utf-8", "replace") + " " for w in licenses.words_of(t))
        want = {label for label, p in patterns if p.search(joined)} | {label for p, label in licenses.BASE_PHRASES if f" {p} " in f" {joined}"}
        assert got[i].labels == ",".join(sorted(want)), t[:200]
        found |= want
    assert found >= {label for label, _ in licenses.TEMPLATES}
    assert got[0].labels == "apache" and got[1].labels == "apache,apache-2.0-notice"


def test_mixing_meets_targets(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = mixing.mix(table, labelled).toPandas()
    p, t, r = np.array(rows.posterior.tolist()), rows.tokens.to_numpy(float), rows.rate.to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (r >= 0).all() and (rows.gap < 5e-3).all()
    shares = (t * r) @ p / t.sum()
    assert shares == pytest.approx([mixing.TARGETS[d] for d in ("clean", "low", "toxic")], abs=5e-3)
    assert (abs(rows["copies"] - r) < 1).all()
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert {x.rate for x in mixing.mix(docs(spark, TEXTS), none).collect()} == {1.0}
    assert len(mixing.mix(docs(spark, TEXTS), labelled).collect()) == len(TEXTS)
    assert mixing.mix(spark.createDataFrame([], EMPTY), labelled).collect() == []


def test_mixing_rates_match_brute_force(spark):
    """Distributed descent against plain projected gradient on all rates, where targets can be met and where not."""
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.6, 0.6, 0.6], 400)
    p = np.vstack([p, np.tile([0.0, 1.0, 0.0], (3, 1))])
    tokens = rng.integers(0, 500, len(p))
    table = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p, strict=True)], "tokens long, posterior array<double>").repartition(3)
    for targets, most in (({"a": 0.2, "b": 0.2, "c": 0.6}, None), ({"a": 1.0}, 2.0)):
        rates = mixing.fit_rates(table, ["a", "b", "c"], targets, 60, most)
        w = np.array([targets.get(d, 0.0) for d in "abc"])
        total = tokens.sum()
        a = (p * tokens[:, None]).T @ p / total + mixing.RIDGE * np.eye(3)
        inverse = np.linalg.inv(a)

        def loss(r):
            gap = (tokens * r) @ p / total - w
            return gap @ inverse @ gap

        r = np.ones(len(p))
        for _ in range(20_000):
            r = np.clip(r - 0.9 * p @ (inverse @ ((tokens * r) @ p / total - w)), 0, most)
        mine = rates.of(p)
        assert (mine >= 0).all() and loss(mine) <= loss(r) + 1e-3
        assert rates.shares == pytest.approx((tokens * mine) @ p / total) and rates.gap == pytest.approx(np.abs(rates.shares - w).max())
    assert rates.gap > 0.01  # soft members of the other domains come along: told, not hidden


def test_mixing_words():
    bucket, n = mixing.word_buckets(TEXTS)
    words = [(t or "").encode().split() for t in TEXTS]
    assert n.tolist() == list(map(len, words)) and len(bucket) == n.sum()
    seen = {}
    for w, b in zip((w for ws in words for w in ws), bucket, strict=True):
        assert seen.setdefault(w, b) == b
    long = "word " * 700_000
    assert mixing.word_buckets(["a", long, "b"])[1].tolist() == [1, 700_000, 1]


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((160, 16))
    crowd = base[0] + rng.standard_normal((60, 16)) * 0.05
    near = base[1:40] + rng.standard_normal((39, 16)) * 0.08
    x = np.concatenate([base, crowd, near, base[5:9]]).astype(np.float32)
    rows = [(int(i) * 3 + 1, v.tolist(), "l") for i, v in enumerate(x)]
    odd = [(1000, None, ""), (1001, [0.0] * 16, ""), (1002, [float("nan")] * 16, ""), (1003, [1.0, None], ""), (1004, [], ""), (None, x[0].tolist(), ""), (1005, [1.0, 2.0], ""), (1006, [float("inf")] * 16, "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label string")
    found = []
    got = {r.vec_id: r for r in neighbours.near_duplicates(df, report=found.append).collect()}
    assert found[-1]["recall"] >= 0.9 and len(got) == len(rows) + len(odd)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = y @ y.T >= 0.95
    np.fill_diagonal(true, False)
    links = np.array([got[r[0]].n_links for r in rows])
    assert (links <= true.sum(axis=1)).all() and links.sum() >= 0.98 * true.sum()
    reach = closure(true)
    parts = [got[r[0]].component_id // 3 for r in rows]
    assert all(reach[p] == reach[i] for i, p in enumerate(parts))  # nothing is joined that links do not join
    assert sum(p == q for p, q in zip(parts, reach, strict=True)) >= 0.98 * len(rows)
    for i in range(1000, 1007):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    for r in rows:
        assert got[r[0]].kept == (got[r[0]].component_id == r[0]) and got[r[0]].component_id <= r[0]
    assert neighbours.near_duplicates(df.limit(0)).collect() == []


def closure(true):
    reach = np.arange(len(true))
    while True:
        after = np.minimum(reach, np.where(true, reach, len(true)).min(axis=1))
        if (after == reach).all():
            return reach
        reach = after


def linked(df, x, **options):
    got = {r.vec_id: r for r in neighbours.near_duplicates(df, **options).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = y @ y.T >= 0.95
    np.fill_diagonal(true, False)
    reach = closure(true)
    assert [(got[i].n_links, got[i].component_id) for i in range(len(x))] == list(zip(true.sum(axis=1).tolist(), reach.tolist(), strict=True))
    return true


def test_neighbours_across_saturated_groups(spark):
    rng = np.random.default_rng(7)
    center, aside = np.eye(24)[0], np.eye(24)[1]
    turned = 0.96 * center + np.sqrt(1 - 0.96**2) * aside
    groups = [c + rng.standard_normal((70, 24)) * 0.005 for c in (center, turned, np.eye(24)[5])]
    x = np.concatenate([*groups, rng.standard_normal((60, 24))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert linked(df, x)[:70, 70:140].any()


def test_neighbours_fall_to_the_exact_search(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 12))
    x = np.concatenate([base, base[:25] + rng.standard_normal((25, 12)) * 0.05, base[0] + rng.standard_normal((20, 12)) * 0.01]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(neighbours, "_forest", lambda vectors, *rest: vectors.selectExpr("id AS u", "id AS v", "0D AS sim").limit(0))
    found = []
    monkeypatch.setattr(neighbours, "ATTEMPTS", 1)
    monkeypatch.setattr(neighbours, "EXACT_BLOCK", 64)
    monkeypatch.setattr(neighbours, "ROUNDS", 0)
    assert linked(df, x, report=found.append).any()
    assert found[-1]["attempt"] == "exact"


def test_neighbours_come_from_descent(spark):
    from quiresmith.llm.common import Shelf

    rng = np.random.default_rng(11)
    base = rng.standard_normal((1500, 24))
    mate = base[:500] + rng.standard_normal((500, 24)) * 0.27
    x = np.concatenate([base, mate]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id long, vector array<float>, weight long")
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = {(i, j) for i, j in zip(*np.nonzero(y @ y.T >= 0.95), strict=True) if i < j}

    def recall(rounds):
        shelf = Shelf(spark, "test")
        graph, _ = neighbours.neighbour_graph(df, len(x), 0.95, 10, shelf, rounds=rounds)
        found = {(min(r.u, r.v), max(r.u, r.v)) for r in graph.where("sim >= 0.95").collect()}
        assert found <= true
        return len(found) / len(true)

    before, after = recall(0), recall(None)
    assert len(true) > 300 and before < 0.9 and after > 0.95 and 1 - after < (1 - before) / 2


def test_neighbours_enlarge_saturated_lists(spark):
    from quiresmith.llm.common import Shelf

    rng = np.random.default_rng(12)
    groups = [c + rng.standard_normal((m, 16)) * 0.02 for c, m in ((np.eye(16)[0], 25), (np.eye(16)[3], 70))]
    x = np.concatenate([*groups, rng.standard_normal((100, 16))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id long, vector array<float>, weight long")
    graph, full = neighbours.neighbour_graph(df, len(x), 0.95, 10, Shelf(spark, "test"))
    degree = {r.u: r["count"] for r in graph.where("sim >= 0.95").groupBy("u").count().collect()}
    assert all(degree[i] == 24 for i in range(25)) and all(degree[i] == 40 for i in range(25, 95))
    assert {r.id for r in full.collect()} == set(range(25, 95))


def test_neighbours_repeated_id_with_other_vectors(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.01]
    rows = [(7, a), (7, b), (3, c), (9, a), (5, [0.0, 0.0, 1.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(3, 1, 3), (5, 0, 5), (7, 1, 3), (7, 1, 3), (9, 1, 3)]


def test_unigram_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = unigram.read_vocabulary(tokens.public_path("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abce thn ▁\n🙂ω漢 é") for _ in range(rng.randint(1, 80))) for _ in range(300)] + ["<unk> a <s>b", "☃☃ ☃x☃"]
    want = [len(t.encode(x, add_special_tokens=False).ids) if x else 0 for x in texts]
    got = {r.doc_id: r.n_tokens for r in unigram.count_tokens(docs(spark, texts), tokens.public_path("piece_bpe_32k.model")).collect()}
    assert [got[i] for i in range(len(texts))] == want
    counter = unigram.Counter(vocabulary)
    long = "".join(rng.choice("abcdehinorst漢☃") for _ in range(60_000))  # one pre-token, packed tables
    assert counter.text(long) == len(t.encode(long, add_special_tokens=False).ids)
    tied = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0)]
    t = Tokenizer(models.Unigram(tied, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    count = unigram.Counter(tied)
    for _ in range(300):
        x = "".join(rng.choice("aab cc") for _ in range(rng.randint(1, 12)))
        assert count.text(x) == len(t.encode(x, add_special_tokens=False).ids), x


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/x>menu {n}</a></ul></nav><!-- c --><div class="ad">Buy {n}</div><div class="top">Site slogan</div>
<div class=story><h1>Title {n}</h1><p><b>Bold{n} &amp; x<br><p>Next&nbsp;  para\n{n} &lt;ok&gt;<p>Read more</div>
<div id="comments">nice {n}</div><footer>f {n}</footer></body></html>"""


def test_html_wrapper_and_blocks(spark):
    rows = [(i, f"https://u@H.example:80/{i}", PAGE.format(n=f"w{i} v{i * 7}"), "x") for i in range(8)]
    rows += [(100, None, None, ""), (101, "", "", ""), (102, "http://solo/x", "plain <b>te</b>xt <p>two", ""), (103, "http://solo/y", "<article><header><h1>A</h1></header><div>b<span>c</span></div><form>no</form></article>tail", "")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    for i in range(8):
        n = f"w{i} v{i * 7}"
        assert got[i].text == f"Title {n} Bold{n} & x Next para {n} <ok>"
        assert got[i].n_chars == len(got[i].text)
    assert [got[i].text for i in (100, 101, 102, 103)] == ["", "", "plain text two", "A bc"]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    assert html.main_text(html.parse(deep)) == "core" and len(html.induce([deep + str(i) for i in range(5)])) == 1


def test_html_template_in_the_middle_of_long_lists(spark):
    menu = "".join(f"<li><a href=/{i}>section {i}</a></li>" for i in range(20))
    page = "<body><div><ul>{menu}</ul></div><div>{body}<p>Support us<p>{tail}</div></body>"
    rows = [(i, "http://long.example/", page.format(menu=menu, body="".join(f"<p>own {i} {j}" for j in range(9 + i % 3)), tail="<p>".join(f"end {i} {j}" for j in range(9))) ) for i in range(10)]
    for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        i = r.page_id
        assert r.text == " ".join([f"own {i} {j}" for j in range(9 + i % 3)] + [f"end {i} {j}" for j in range(9)])
    cells = [f"<table><tr>{'<td>yes' * (1 + i)}<td>{i}</table>" for i in range(6)]
    assert html.induce(cells) == []  # a word that comes differently often is data


def test_html_template_of_all_pages_and_layouts(spark):
    one = "<body><div class=left>Our motto</div><div><p>story {i}</div></body>"
    two = "<body><section>Ask us</section><section><p>story {i}</section></body>"
    rows = [(i, "http://two.example/", (one, two)[i % 2].format(i=i)) for i in range(40)]
    rows += [(100 + 10 * h + i, f"http://four{h}.example/", one.format(i=i)) for h in range(8) for i in range(4)]
    rows += [(200 + i, "http://empty.example/", one.format(i=i)) for i in range(30)] + [(230, "http://empty.example/", "")]
    rows += [(300 + i, "http://copies.example/", one.format(i=i // 10)) for i in range(30)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert [got[i] for i in range(40)] == [f"story {i}" for i in range(40)]
    assert all(got[100 + 10 * h + i] == f"story {i}" for h in range(8) for i in range(4))
    assert all(got[200 + i] == f"story {i}" for i in range(30)) and got[230] == ""
    assert got[300] == "story 0"  # three pages and copies of them: no constants, but the slot that varies


BARE = """<body><div><ul><li><a href=/a>{a}</a><li><a href=/b>{b}</a></ul></div><div>{ad}</div><div><h1>{title}</h1><p>{text}</div><div>&copy; {end}</div>"""


def test_html_wrapper_decides_where_no_mark_does(spark):
    rng = random.Random(3)

    def words(n):
        return " ".join(rng.choice(("lorem", "dolor", "amet", "sit")) + str(rng.randrange(999)) for _ in range(n))

    rows, want = [], {}
    for i in range(24):  # on every third page the advert is longer than the article
        title, text = words(2), words(3 if i % 3 == 0 else 60)
        rows.append((i, "http://bare.example/", BARE.format(a=words(2), b=words(2), ad=words(25), title=title, text=text, end=words(4))))
        want[i] = f"{title} {text}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert {r.page_id: r.text for r in html.extract(df).collect()} == want
    alone = {i: html.main_text(html.parse(h)) for i, _, h in rows}
    assert sum(alone[i] != want[i] for i in want) >= 8  # a page by itself does not tell
    assert all(html.main_text(html.parse(h)).find(want[i][:5]) >= 0 for i, _, h in rows if i % 3)


def test_html_alignment_is_simple_tree_matching():
    rng = random.Random(5)

    def tree(n):
        parents = [-1] + [rng.randrange(max(0, i - 4), i) for i in range(1, n)]
        tags = ["#root"] + [rng.choice(("div", "section")) for _ in range(1, n)]
        order = sorted(range(n), key=lambda i: i)
        slots = [html.Slot(tags[i], rng.randrange(3), parents[i]) for i in order]
        for i in range(1, n):
            slots[parents[i]].children.append(i)
        return html._finish(slots)

    def weight(a, b, i, j):  # all order-preserving choices of children
        if a[i].tag != b[j].tag:
            return 0

        def best(p, q):
            if not p or not q:
                return 0
            return max(best(p[1:], q), *(weight(a, b, p[0], q[k]) + best(p[1:], q[k + 1 :]) for k in range(len(q))))

        return 1 + (a[i].label == b[j].label) + best(a[i].children, b[j].children)

    for _ in range(60):
        a, b = tree(rng.randint(1, 9)), tree(rng.randint(1, 9))
        met = html.align(a, b)
        assert sum(1 + (a[i].label == b[j].label) for i, j in met.items()) == weight(a, b, 0, 0)
        assert all(a[i].tag == b[j].tag and (i == 0 or met[a[i].parent] == b[j].parent) for i, j in met.items())
        assert html.load(html.dump(a))[-1].parent == a[-1].parent


def test_html_time_is_linear_in_bad_markup():
    import time

    began = time.time()
    html.main_text(html.parse("<div>" * 90_000 + "</x>" * 90_000 + "<h1>" * 20_000))
    assert time.time() - began < 20  # a second or two; a walk to the root for each tag takes an hour


def test_html_repeated_article_is_no_template(spark):
    rows = [(i, "http://same.example/", f"<body><div class=menu>m{i}</div><div><h1>One title</h1><p>{'the same text ' * 9}<p>n{i}</div>") for i in range(9)]
    for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == f"One title {('the same text ' * 9).strip()} n{r.page_id}"


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def test_quality_statistics_and_rules(spark, sf_dir):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice("ab") for _ in range(n)) for n in range(40)]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = {r.doc_id: r for r in quality.judge(docs(spark, texts), labels).collect()}
    for i, t in enumerate(texts):
        want = plain_statistics(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r.base_failed or not r.kept)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = quality.judge(table, labels).join(labels, "doc_id").collect()
    good = [r for r in out if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept != r.base_failed for r in quality.judge(docs(spark, texts), none).collect())
    assert quality.judge(spark.createDataFrame([], EMPTY), none).collect() == []


def test_decision_list_finds_planted_rule(spark):
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.MEASURES)))
    bad = (x[:, 2] > 0.8) & (x[:, 5] <= 0.5)
    rules = quality.learn(x, bad)
    taken = np.zeros(len(x), bool)
    for r in rules:
        taken |= quality._holds(r, x)
    assert (taken & bad).sum() >= 0.9 * bad.sum() and (taken & ~bad).sum() <= 0.02 * len(x)


def test_quality_rules_judge_as_learned(spark, sf_dir):
    """The emitted conditions against the learned list applied row by row."""
    table, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    limits = quality.Limits(precision=0.6, cover=2, rules=3, conditions=2, cuts=8)
    rules = quality.fit(quality.measure(table), labels, limits=limits)
    assert len(rules) <= 3 and all(len(r) <= 2 for r in rules)
    place = {m[0]: m for m in quality.MEASURES}
    got = quality.judge(table, labels, limits=limits).collect()
    for r in got:
        def value(name, r=r):
            _, top, bottom = place[name]
            return float(r[top]) if bottom is None else r[top] / r[bottom] if r[bottom] else 0.0

        first = next((i for i, rule in enumerate(rules) if all((value(c.measure) > c.cut) == c.above for c in rule)), None)
        assert r.rule == (None if r.base_failed else first) and r.kept == (not r.base_failed and first is None)


def test_chat_of_text_ids(spark):
    rows = [("none", 0, "user", "a"), (None, 0, "assistant", "b"), ("x y", 0, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").withColumns({"tree": F.lit("t"), "score": F.lit("s"), "formatted": F.lit("f")})
    got = {r.conv_id: r.loss_chars for r in chat.digests(chat.conversations(chat.threads(df)), "string").collect()}
    assert got == {"none": 0, None: 1, "x y": 1}


def test_chat_template_round_trip():
    rng = random.Random(6)
    bits = ["\\", "#", "###", "### ", "</turn>", " </turn>\n", ": ", ":", " ", "\n", "a", "assistant", "é🙂", "<\\/turn>"]
    for _ in range(500):
        turns = [("".join(rng.choices(bits, k=rng.randint(0, 4))) if rng.random() < 0.3 else "assistant", "".join(rng.choices(bits, k=rng.randint(0, 8)))) for _ in range(rng.randint(0, 5))]
        text, mask = chat.format_turns(turns)
        assert chat.read_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]
        assert text.count("</turn>") == len(turns) == text.count("###")


def test_reply_trees(spark):
    rng = random.Random(8)
    nodes, want = [], {}
    for tree in ("a", "b", "c"):
        parent = {}
        for n in range(40):
            parent[n] = None if n == 0 else rng.randrange(max(0, n - 6), n)
            nodes.append((tree, n, parent[n], "user" if n % 2 else "assistant", f"t{n}", (n * 37 % 11) / 10))
        score = {n: s for t, n, _, _, _, s in nodes if t == tree}
        found = []
        for leaf in set(parent) - set(parent.values()):
            path = [leaf]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            found.append((-sum(score[n] for n in path) / len(path), leaf, path[::-1]))
        want[tree] = {leaf: path for _, leaf, path in sorted((round(a, 9), b, c) for a, b, c in found)[:2]}
    nodes += [("x", 1, 2, "user", "circle", 0.0), ("x", 2, 1, "user", "circle", 0.0), ("y", 1, 99, None, None, None), (None, 1, None, "user", "lost", 0.0), ("y", 1, 99, None, None, None)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    got = {}
    for r in chat.conversations(df, branches=2).collect():
        got.setdefault(r.tree, {})[r.leaf] = [t for _, t in chat.read_turns(r.formatted)]
    assert {t: {n: [f"t{i}" for i in p] for n, p in x.items()} for t, x in want.items()} == {t: got[t] for t in want}
    assert "x" not in got and got["y"] == {1: [""]}
    assert chat.conversations(df.limit(0)).collect() == []


def test_chat_query_equals_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = sorted(con.execute(registry.oracle_sql()["op9_chat"]).fetchall())
    assert sorted(map(tuple, registry.op9_chat(spark, sf_dir).collect())) == want
    odd = spark.createDataFrame([(None, None, None, None), (None, 1, "user", "x"), (1, 0, "user", None), (1, 0, "user", None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.n_turns for r in chat.digests(chat.conversations(chat.threads(odd))).collect()}
    assert got == {None: 2, 1: 2}


@pytest.mark.parametrize("window", [300, 10_000_000])
def test_packing_keeps_every_id_once(spark, window):
    from tokenizers import Tokenizer

    path = tokens.public_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = TEXTS + ["<|endoftext|> it's  a \n test ", "a <|endoftext|> b<|endoftext|><|endoftext|>  c <|endoftext", "<|endoftext|>", "word " * 3000, " ".join(f"w{i}" for i in range(900))] * 2
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    rows = packing.pack(docs(spark, texts).repartition(7), path, window=window, with_ids=True).collect()
    for i, x in ids.items():
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [k for r in own for k in r.ids] == x and {r.doc_tokens for r in own} == {len(x)}
        assert all(r.start == sum(q.length for q in own[:k]) for k, r in enumerate(own))
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in own)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        n = sum(p.length for p in parts)
        assert n == 1024 or n < 1024 and n & (n - 1) == 0
    assert sum(len(p) > 0 and sum(x.length for x in p) < 1024 for p in sequences.values()) <= 10  # of all partitions together
    assert packing.pack(spark.createDataFrame([], EMPTY), path).collect() == []


def test_packing_balances_cost():
    lengths = [1 + i * 37 % 900 for i in range(400)]
    pieces = packing.assign(lengths)
    m = sum(lengths) // 1024
    load = [0.0] * m
    for _, _, n, k in pieces:
        if k >= 0:
            load[k] += packing.cost(n)
    assert sum(n for *_, n, k in pieces if k < 0) == sum(lengths) % 1024
    assert max(load) <= 1.3 * sum(load) / m


def five_word_similarity(a, b):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline
    from quiresmith.llm.common import Shelf

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shelf, now = Shelf(spark, "test"), table
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, shelf.put(stage(spark, now, sf_dir))
        if name != "packing":
            assert now.columns == table.columns
            assert now.join(before, now.columns, "left_anti").count() == 0
        if name == "simhash_dedup":  # against all pairs
            rows = sorted((r.doc_id, r.text) for r in before.collect())
            root = {i: i for i, _ in rows}
            for k, (i, p) in enumerate(rows):
                for j, q in rows[k + 1 :]:
                    if 0.5 < len(p) / max(1, len(q)) < 2 and five_word_similarity(p, q) >= 0.8:
                        root[j] = min(root[i], root[j])
            want = {i for i in root if root[i] == i}
            got = {r.doc_id for r in now.collect()}
            assert want <= got and len(got - want) <= 1 + 0.1 * (len(root) - len(want))
        if name == "mixture":
            model = mixing.fit_classifier(before, mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")))
            shares = []
            for df in (before, now):
                p, n = model.posteriors([r.text for r in df.collect()])
                shares.append(dict(zip(model.domains, n @ p / n.sum(), strict=True)))
            assert abs(shares[1]["toxic"] - corpus_pipeline.MIX["toxic"]) <= abs(shares[0]["toxic"] - corpus_pipeline.MIX["toxic"]) + 0.02
    lengths = [r["sum(length)"] for r in now.groupBy("sequence_id").sum("length").collect()]
    assert lengths and all(x == 1024 or x & (x - 1) == 0 for x in lengths)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score string, n_words string, copies string, rate string, id string, c0 string, wide string, posterior string"


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    import corpus_pipeline

    good = " ".join(f"the word{i} and the dog{i % 7}" for i in range(60))
    rows = [(i, t, "en" if i % 2 else None, None, None, *"abcdefghi") for i, t in enumerate([good, good, good + " tail", None, "", "12 34", "漢字 " * 80, "x" * 3000])]
    rows += [(None, good + " other words at the end", "en", "s", 1, *"abcdefghi"), (0, good, "en", None, None, *"abcdefghi"), (0, " ".join(f"quite{i} another{i}" for i in range(90)), "en", None, None, *"abcdefghi")]
    odd = spark.createDataFrame(rows, CLASHING)
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, odd.limit(0), odd.select("doc_id", "text", "lang", "source", "n_chars")):
            out = stage(spark, df, sf_dir)
            got = out.collect()
            if name != "packing":
                assert out.columns == df.columns
            if df is odd:
                ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in got)
                if name == "language_id":
                    assert not {3, 4, 5, 6} & set(ids) and {0, 1, 2, -1} <= set(ids)
                elif name == "quality_rules":
                    assert set(ids) <= {0, 1, 2, 6, -1}
                elif name == "simhash_dedup":  # copies of good, of nothing, and the rest; the second text of id 0 stays
                    assert ids == [0, 0, 3, 5, 6, 7]
                elif name == "packing":
                    assert sum(r.length for r in got if r.doc_id in (3, 4)) == 2
            elif not len(df.take(1)):
                assert got == []


def test_wide_fingerprints_find_near_copies(spark, monkeypatch):
    from quiresmith.llm import simhash
    from quiresmith.llm.common import Shelf

    rng = random.Random(7)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base[:40]:
        edited = list(b)
        for _ in range(max(1, len(b) // 60)):
            edited[rng.randrange(len(b))] = "changed"
        texts.append(" ".join(edited))
    crowd = [f"c{rng.randrange(9999)}" for _ in range(200)]
    for i in range(150):  # a group of near copies, no two equal
        texts.append(" ".join(crowd + [f"end{i}", "of", "it"]))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    roots = {r.id: r.root for r in simhash.similar(df, Shelf(spark, "test")).collect()}
    links = [(i, j) for i in range(100) for j in range(i + 1, 100) if five_word_similarity(texts[i], texts[j]) >= 0.8]
    assert len(links) >= 30
    missed = [(i, j) for i, j in links if roots.get(i, i) != roots.get(j, j)]
    assert len(missed) <= 0.1 * len(links)
    assert all(five_word_similarity(texts[i], texts[roots[i]]) >= 0.8 for i in roots if i < 100)
    assert {roots.get(i) for i in range(100, 250)} == {100}
    monkeypatch.setattr(simhash, "TOGETHER", 20)  # crowded keys are dealt to several tasks
    dealt = {r.id: r.root for r in simhash.similar(df, Shelf(spark, "test")).collect()}
    assert {dealt.get(i) for i in range(100, 250)} == {100}
    assert simhash.similar(df.limit(0), Shelf(spark, "test")).collect() == []


def test_merging_by_rank_equals_merging_by_pair():
    from tokenizers import Tokenizer

    path = tokens.public_path("byte_bpe_50k.json")
    assert tokens.merges_are_canonical(path)
    t = Tokenizer.from_file(path)
    rng = random.Random(2)
    units = ["".join(chr(rng.choice([rng.randint(33, 126), rng.randint(97, 122), rng.randint(0xA1, 0x17F)])) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts = [" ".join(units[i : i + 30]) for i in range(0, 3000, 30)]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert tokens.Encoder(path).encode(texts) == want
