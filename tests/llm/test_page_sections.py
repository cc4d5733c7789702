"""Pages whose text lies in several sibling sections."""

from barcast.llm import html

SENTENCE = "This sentence of the page is of usual length and has no markup in it at all. "


def page(*sections):
    inner = "".join(f'<div class="section">{s}</div>' for s in sections)
    return f'<body><div class="menu"><a href="1">a</a><a href="2">b</a></div><div id="content">{inner}</div><div class="footer">x</div></body>'


def texts(*paragraphs):
    return "".join(f"<p>{p}</p>" for p in paragraphs)


def test_sibling_sections_stay():
    long, short = (SENTENCE * 6).strip(), (SENTENCE * 3).strip()
    got = html.extract(page(texts(long), texts(short, "A short end.")))
    assert got.split("\n") == [long, short, "A short end."]
    assert html.extract(page(texts(short), texts(long, long, long))).split("\n") == [short, long, long, long]


def test_one_very_long_paragraph():
    huge, usual = (SENTENCE * 200).strip(), (SENTENCE * 2).strip()
    got = html.extract(page(texts(usual), texts(huge), texts(usual, usual, usual, usual)))
    assert got.split("\n") == [usual, huge, usual, usual, usual, usual]


def test_text_beside_the_article_does_not_widen_it():
    body = "<article>" + texts(*[(SENTENCE * 4).strip()] * 3) + "</article><div><p>" + SENTENCE + "</p><a href='/'>more</a></div>"
    assert html.extract(f"<body><div>{body}</div></body>").split("\n") == [(SENTENCE * 4).strip()] * 3


def test_several_articles_stay():
    parts = [(SENTENCE * n).strip() for n in (6, 2, 2)]
    got = html.extract("<body><div>" + "".join(f"<article><p>{p}</p></article>" for p in parts) + "</div></body>")
    assert got.split("\n") == parts
