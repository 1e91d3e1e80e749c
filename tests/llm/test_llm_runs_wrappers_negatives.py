"""Periodic runs, page wrappers and hard negatives against brute force, with nulls, ties, repeats, odd texts and clashing columns."""

import hashlib
import html
import math
import random
import re
import struct
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mktlens.llm import hard_negatives, html_wrappers, periodic_runs, queries

DOCS = "doc_id long, text string, lang string, runs string, start int, length int, period int, h int, g int, best string"


def _runs(words, least=6, times=4):
    out = set()
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            n = i + q - s
            if i > s and n >= max(least, times * q) and not any(words[s:s + n - r] == words[s + r:s + n] for r in range(1, q)):
                out.add((s, n, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapsed(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def _text(rnd):
    n = rnd.randint(0, rnd.choice([10, 60, 700]))
    words = [str(rnd.randint(0, rnd.choice([1, 2, 50]))) for _ in range(n)]
    for _ in range(rnd.randint(0, 2)):
        if n:
            a = rnd.randrange(n)
            p, e = rnd.randint(1, max(1, (n - a) // 3)), rnd.randint(a, n)
            for i in range(a, e):
                words[i] = words[a + (i - a) % p]
    return rnd.choice([" ", "\n\t", "  "]).join(words) + rnd.choice(["", " \x0b"])


def test_op11_runs_of_small_alphabets():
    rnd = random.Random(5)
    for _ in range(150):
        texts = [_text(rnd) for _ in range(rnd.randint(1, 5))]
        n_words, runs, collapsed = periodic_runs._collapse(pa.array(texts), 6, 4)
        for text, n, found, rest in zip(texts, n_words.tolist(), runs.to_pylist(), collapsed.to_pylist(), strict=True):
            words = text.split()
            want = _runs(words)
            assert n == len(words) and rest == _collapsed(words, want)
            assert [(r["start"], r["length"], r["period"]) for r in found] == want


def test_op11_query_on_planted_texts(spark, tmp_path):
    rnd = random.Random(6)
    texts = [None, "", " \n ", "a", "a " * 9, "\x85 \xa0   " * 7, "x y " * 5000, " ".join(str(i % 1200) for i in range(9000))]
    texts += [_text(rnd) for _ in range(60)]
    rows = [(i, t, "en", "r", 1, 2, 3, 4, 5, "b") for i, t in enumerate(texts)]
    rows += [rows[9], (None, "a b c " * 6, None, None, None, None, None, None, None, None), (-7, "u v " * 8, *rows[0][2:])]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r)[:9] for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect())
    want, planted = Counter(), 0
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
            planted += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = _runs(words)
        best = min(runs, key=lambda r: (-r[1] * 10 ** 9 // r[2], r[0], r[2]), default=None)
        want[(doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
              hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest(),
              hashlib.sha256(_collapsed(words, runs).encode()).hexdigest())] += 1
    assert planted > 3
    assert Counter(k[:8] for k in got.elements()) == want


def test_op11_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(none))).collect() == []


def _page(title, blocks, menu=2, extra="", tail="</body></html>"):
    links = "".join(f'<li><a href="/{k}">Link {title} {k}</a></li>' for k in range(menu))
    body = "".join(f"<p>{b}</p>" for b in blocks)
    return (f"<!DOCTYPE html><html><head><title>{title}</title><script>var a='</p><article>no</article>';</script></head><body>"
            f"<nav><ul>{links}</ul></nav><!-- <p>ad</p> --><article><h1>{title}</h1>{body}{extra}</article><footer>&copy; me</footer>{tail}")


def test_op12_wrapper_has_slots_constants_optional_and_repeated_groups():
    w = html_wrappers.Wrapper()
    pages = [_page("one", ["a"]), _page("two", ["b", "c"], extra="<ul><li>x</li></ul><p>y</p>"), _page("three", ["d"], menu=1)]
    for p in pages:
        html_wrappers.align(w, p)
    assert w.expression() == ("html(head!-1(title!-1() script!-1()) body(nav!-1(ul(li(#)+)) "
                              "article!4(h1(#) (p(#)+? ul(li(#))?)+) footer!-1(=)))").replace("p(#)+?", "(p(#))+?")
    parts = [html_wrappers.Wrapper() for _ in pages]
    for x, p in zip(parts, reversed(pages), strict=True):
        html_wrappers.align(x, p)
    merged = html_wrappers.Wrapper()
    for x in parts:  # in another order, and through their written form
        merged.add(html_wrappers.Wrapper.load(x.dump()))
    assert merged.dump() == w.dump()


MARKED = [  # (html, main text)
    (_page("t&amp;x", ["a <b>b</b>&nbsp;c", " ", "d<br>e &lt;p&gt;"]), "t&x\na b c\nd\ne <p>"),
    (_page("cut", ["one", "two"], tail="")[:-30], "cut\none\ntwo"),
    (_page("t", ["x<span class='ad'>buy</span>y"], extra="<aside>side</aside><div class='share-buttons'>S</div><form>f</form><ol><li>1<li>2</ol>"
           "<section id=comments><p>first!</p><article class=comment>c</article></section>"), "t\nxy\n1\n2"),
    ("<body><header>Site</header><main><h2>Head</h2>text<div class='related-links'>r</div><table><tr><td>1<td>2<tr><td>3</table></main>"
     "<div class=sidebar>s</div>", "Head\ntext\n1\n2\n3"),
    ("<div class='cookie-notice'>We use</div><div id='content'>Real <i>text</i> here<p hidden>no</p></div><div>other</div>", "Real text here"),
    ("<p>1 < 2 & 3 <a href='x>y'>z</a></p><!-- open", "1 < 2 & 3 z"),
    ("<article>" + "<div>" * 300 + "deep" + "</div>" * 300 + "after</article>", "deep\nafter"),
    ("<article><p>unclosed <script>x", "unclosed"), ("plain", "plain"), ("", ""), (None, ""), ("<nav>only</nav>", ""), (" \n ", ""),
    ("<article><p>" + "long words " * 60000 + "</p></article>", ("long words " * 60000).strip()),
]


def test_op12_marked_pages(spark, tmp_path):
    rows = [(i, f"http://h{i}.example.com/x", h, "c", "t", 1, "l") for i, (h, _) in enumerate(MARKED)]
    rows += [rows[0], (None, None, MARKED[2][0], None, None, None, None), (91, "no host", MARKED[0][0], None, None, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string, share int, levels string")
    table.repartition(4).write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter(map(tuple, queries.op12_html_wrappers(spark, str(tmp_path)).collect()))
    text = dict(enumerate(t for _, t in MARKED)) | {None: MARKED[2][1], 91: MARKED[0][1]}
    assert got == Counter((r[0], r[1], text[r[0]], len(text[r[0]])) for r in rows)
    assert html_wrappers.main_texts(table.limit(0)).collect() == []


def test_op12_pages_without_marks_leave_out_constants_and_link_lists(spark):
    pages = [(i, "https://Plain.example.org/" + str(i), f"<body><div><a href=/>Home</a> <a href=/n{i}>News {i}</a></div><table><tr><td>"
              f"<h1>Title {i}</h1><p>Story {i} begins.<p>Story {i} ends.</table><center>Made by us</center>") for i in range(5)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in html_wrappers.main_texts(table).collect()}
    assert got == {i: f"Title {i}\nStory {i} begins.\nStory {i} ends." for i in range(5)}
    row = html_wrappers.wrappers(table).first()
    assert (row.host, row.pages) == ("plain.example.org", 5)
    assert row.expression == "body(div(#) table(tr(td(h1(#) p(#)+))) center(=))"


def test_op12_many_kinds_of_children_and_whole_table(spark):
    w, odd = html_wrappers.Wrapper(), [f"<body><div class='{a}{b}x'>{a}</div><div class='{b}{a}y ad'>no</div><article>{a}{b}</article>"
                                       for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    for p in odd:
        html_wrappers.align(w, p)
    assert w.kids["body"].short and len(w.kids["body"].kids) < 9
    assert [html_wrappers.extract(w.levels(), p) for p in odd[:3]] == ["aa", "ab", "ac"]
    sf = "/root/testdata/sf0.001"
    got = {r.page_id: r.text for r in queries.op12_html_wrappers(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        lines = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner))
        assert got[r.page_id] == "\n".join(x for x in lines if x)


def _whole(v):
    return [math.floor(256 * struct.unpack("f", struct.pack("f", x))[0]) for x in v]


def _mined(rows, anchors, k=5):
    ok = [(n, i, la, _whole(v)) for n, (i, v, la) in enumerate(rows)
          if la is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, la, v in ok:
        if i is not None and anchors(i):
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, m, lb) for m, j, lb, w in ok if m != n))
            for s, no_id, j, _, _ in [x for x in scored if x[4] == la][:k]:
                best = [x for x in scored if x[4] != la and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
                out += [(i, None if no_id else j, r + 1, None if x[1] else x[2], -s, -x[0]) for r, x in enumerate(best)]
    return Counter(out)


@pytest.mark.parametrize("scale_up", [1, 1e30])
def test_op13_against_all_scores(spark, scale_up):
    rnd = random.Random(8)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, 1.0]) if i % 3 else rnd.uniform(-1, 1) for _ in range(6)], rnd.choice([0, 0, 0, 1, 2])) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.5, -0.25, 0.0, 1.0, 0.25], i % 2) for i in range(40)]
    rows += [(2000, None, 1), (2100, [], 1), (2200, [1.0, None], 0), (2300, [float("nan")], 0), (2400, [float("inf")], 1), (2500, [1.0, -1.0], 0),
             (None, [1.0] * 6, 1), (None, [1.0] * 6, 0), (2600, [1.0] * 6, None), (2700, [0.0] * 6, 1), (2800, [1.0] * 7, 9), rows[0], rows[100]]
    if scale_up > 1:  # products that leave 64 bits, outside of all windows
        rows += [(3001, [0.0, -scale_up, 0.0, 0.0, 0.0, 0.0], 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("row", F.lit(1)).withColumn("v", F.lit("x"))
    got = hard_negatives.mine(table.repartition(3), F.col("id") % 50 == 0, block_rows=64, group_rows=3)
    assert Counter(map(tuple, got.collect())) == _mined(rows, lambda i: i % 50 == 0)


def test_op13_empty_and_alone(spark):
    table = spark.createDataFrame([(100, [1.0], 1), (1, [1.0], 2)], "vec_id long, embedding array<double>, label int")
    assert hard_negatives.mine(table, F.col("id") % 100 == 0).collect() == []
    assert hard_negatives.mine(table.limit(0), F.col("id") % 100 == 0).collect() == []
