import hashlib
import random

import pytest

from barcast.llm import html, syncmers

FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<div id="wrap"><div class="ad">Buy now</div><article class="post"><header><h1>Head  line &amp; more</h1></header><p><b>First
 paragraph.<br><p>Short.</p><form><input value="x"><label>Mail</label></form><p>Second &eacute; long paragraph with <a href="#">a link</a> in it.</p>
<ul><li>One<li>Two</ul><aside>Related</aside></article><div class="comments"><p>Great post, thank you very much for it!</p></div></div>
<footer>&copy; site</footer></body></html>"""


def test_extract():
    assert html.extract(FULL).split("\n") == [
        "Head line & more",
        "First paragraph.",
        "Short.",
        "Second é long paragraph with a link in it.",
        "One",
        "Two",
    ]


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<nav><a>x</a></nav>", "<script>x", "<!-- a"])
def test_no_text(page):
    assert html.extract(page) in ("", "<", "<p")


def test_without_article():
    page = "<body><div class=menu><a href=1>a</a><a href=2>b</a></div><div id=content><p>Some long running text of the page.</p><p>More of it here.</p></div><div class=footer>x</div>"
    assert html.extract(page) == "Some long running text of the page.\nMore of it here."
    assert html.extract("just words &lt;here") == "just words <here"
    assert len(html.extract("<article><p>" + "word " * 50_000 + "</article>")) == 249_999


def test_pages_table(spark):
    rows = [(1, "u", FULL, "t"), (1, "u", FULL, "t"), (None, None, None, None), (3, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.main_text(pages).collect()
    assert len(got) == 4 and {r.n_chars for r in got} == {0, len(html.extract(FULL))}
    assert html.main_text(pages.limit(0)).count() == 0


def test_registered_pages_whole(spark):
    """On the given pages the article element holds the text: compare with a plain cut of the markup."""
    import html as entities
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S).group(1)
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def brute_syncmers(text, k, s):
    points = syncmers._points(text)
    out = []
    for i in range(len(text) - k + 1):
        inner = [syncmers.closed_syncmers(points[i + j : i + j + s], s, s) for j in range(k - s + 1)]
        assert all(len(x) == 1 for x in inner)  # an s-mer alone is its own smallest
        hashes = []
        for j in range(k - s + 1):
            h = syncmers.np.zeros(1, syncmers.np.uint64)
            for x in range(s):
                h = h * syncmers._BASE + points[i + j + x]
            hashes.append(int(syncmers._mixed(h)[0]))
        if min(hashes) in (hashes[0], hashes[-1]):
            out.append(i)
    return out


def test_syncmers_by_definition():
    rng = random.Random(1)
    text = "".join(rng.choices("abcdé ", k=150))
    assert syncmers.closed_syncmers(syncmers._points(text), 12, 5).tolist() == brute_syncmers(text, 12, 5)
    assert syncmers.closed_syncmers(syncmers._points(text), 9, 4).tolist() == brute_syncmers(text, 9, 4)


def test_fingerprints(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(7 * i, text(rng.randint(30, 400))) for i in range(60)]
    rows += [(421, ""), (422, None), (423, "x"), (424, "abc def gh"), (424, "abc def gh"), (None, "no id at all, still a row"), (500, rows[3][1])]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, part string").repartition(4)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for at, (i, t) in enumerate(order):
        changed = syncmers.edited(t, order[(at + 1) % len(order)][1])
        q = len(t) // 4
        assert changed == t[: len(t) - q] + order[(at + 1) % len(order)][1][:q]
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest()))
    for size in (5, 4000):
        got = syncmers.fingerprints(docs, size).collect()
        assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
    prints = {r.doc_id: r for r in got}
    assert prints[500].fingerprint == prints[21].fingerprint and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 200]
    assert min(r.near_edited for r in long) > 0.35 > 0.15 > max(r.near_next for r in long if r.doc_id != 497)
    assert syncmers.fingerprints(docs.limit(0)).count() == 0
    single = syncmers.fingerprints(docs.where("doc_id = 0")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0
