import pytest

from courtline.llm import html_text as H

CASES = [
    (None, ""), ("", ""), ("plain & simple", "plain & simple"), ("<div class='ad'>buy</div>", ""),
    ("<p>a&nbsp;b &lt;t&gt; &#8217;s</p><p>c<br>d</p>", "a b <t> ’s\nc\nd"),
    ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a>Home</a></nav>"
     "<article><h1>Head</h1><p><b>First, one.<br><p>Second   one.</p></article><footer>f</footer></body>",
     "Head\nFirst, one.\nSecond one."),
    ("<article><p>Cut off here &am", "Cut off here &am"),
    ("<article><p>Cut in a tag</p><p cla", "Cut in a tag"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    assert H.main_text(page) == text


def test_layouts_without_an_article_element():
    page = ("<body><header>Site</header><ul class='menu'><li>a</li><li>b</li></ul><div id='content'><h2>Title</h2>"
            "<p>Hello, world. This is a long sentence, really.</p><p>short</p><form><label>mail</label></form>"
            "<div class='comments'><p>Nice, very nice post. I like it, thanks!</p></div></div>"
            "<aside>More, more. More.</aside><div class='cookie-notice'>We use cookies, sorry.</div></body>")
    assert H.main_text(page) == "Title\nHello, world. This is a long sentence, really.\nshort"


LONG = "This is a long sentence, with commas and words, that says something. " * 12


@pytest.mark.parametrize("page,text", [
    (f"<div><h1>Title</h1><p>Lead.</p><div>{LONG}</div></div>", f"Title\nLead.\n{LONG.strip()}"),
    (f"<body><div><p>{LONG * 12}</p></div><div><p>{LONG}</p></div></body>",
     f"{(LONG * 12).strip()}\n{LONG.strip()}"),
    (f"<body><article><p>{LONG * 3}</p></article><article><p>{LONG * 2}</p></article></body>",
     f"{(LONG * 3).strip()}\n{(LONG * 2).strip()}"),
    (f"<table><tr><td><h2>Head</h2><blockquote>{LONG}</blockquote></td></tr></table>", f"Head\n{LONG.strip()}"),
    (f"<body><ul class='menu'><li>a</li></ul><section><h2>One</h2><p>{LONG}</p></section>"
     f"<section><h2>Two</h2><div>{LONG * 15}</div></section></body>",
     f"One\n{LONG.strip()}\nTwo\n{(LONG * 15).strip()}"),
])
def test_nested_and_several_articles_lose_nothing(page, text):
    assert main_text_lines(page) == text.split("\n")


def main_text_lines(page):
    return H.main_text(page).split("\n")


def test_extract_keeps_every_page(spark):
    rows = [(1, "u", None, 5), (1, "u", None, 5), (2, None, "<article><p>x é</p></article>", 6), (None, "u", "", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted(map(tuple, H.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (2, None, "x é", 3), (None, "u", "", 0)], key=str)
    assert H.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page,text", [
    (f"<div style='overflow:hidden'><h1>T</h1><p>{LONG}</p></div>", f"T\n{LONG.strip()}"),
    (f"<p title='no hidden fee'>{LONG}</p>", LONG.strip()),
    (f"<div class='content no-sidebar'><p>{LONG}</p></div>", LONG.strip()),
    (f"<div class='page login-page'><p>{LONG}</p></div>", LONG.strip()),
    (f"<article><p>{LONG}</p><section class='related-work'><p>Rel.</p></section></article>", f"{LONG.strip()}\nRel."),
    (f"<article><div class='article-header'><h1>Head</h1></div><p>{LONG}</p></article>", f"Head\n{LONG.strip()}"),
    ("<article><p>x</p><p>tail <a href=\"x", "x\ntail"),
    ("<p class=\"x>one</p><p>two</p>", "one\ntwo"),
    (f"<body><div><p>{LONG}</p></div><p>Copyright 2024 ..</p></body>", LONG.strip()),
    (f"<body><div><p>{LONG}</p></div><div class='login-box'>Sign in, please.</div></body>", LONG.strip()),
    (f"<article><p>{LONG}</p><div class='comment-list'><p>{LONG * 4}</p></div></article>", LONG.strip()),
    (f"<article><p>{LONG}</p><p hidden>no</p><p style='display: none'>no</p><p aria-hidden='true'>no</p></article>",
     LONG.strip()),
])
def test_attributes_and_ratios_decide(page, text):
    assert H.main_text(page) == text


def test_ratios_equal_a_plain_version():
    page = f"<body><ul><li>a</li><li>b, c</li></ul><div><h2>T</h2><p>{LONG}</p><p>x.</p></div><p>(c) y</p></body>"
    nodes = [n for n in H.text_nodes(page) if n.text.strip()]
    ratio, points = [], []
    for n in nodes:
        same = [m for m in nodes if m.path == n.path]
        ratio.append(sum(len(m.text.strip()) for m in same) / len(same))
        points.append(sum(len(H.PUNCTUATION.findall(m.text)) for m in same) / len(same))

    def smooth(x, i):
        at = [min(max(i + d, 0), len(x) - 1) for d in (-2, -1, 0, 1, 2)]
        return sum(x[j] * k for j, k in zip(at, (1, 2, 4, 2, 1))) / 10
    fused = [(r * smooth(ratio, i)) ** 0.5 * (0.25 + smooth(points, i) / (1 + smooth(points, i)))
             for i, r in enumerate(ratio)]
    limit = H.THRESHOLD * sum(fused) / len(fused)
    want = set()
    for n in nodes:
        mine = [f for f, m in zip(fused, nodes) if m.path == n.path]
        if sum(mine) / len(mine) >= limit:
            want.add(n.path)
    assert H.content_paths(nodes) == want == {"body/div/p"}


def test_other_paths_give_other_texts(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    texts, paths = [H.main_text(p) for p in pages], H.content_paths
    for wrong in (lambda s: set(), lambda s: {n.path for n in s} - paths(s)):
        monkeypatch.setattr(H, "content_paths", wrong)
        assert sum(H.main_text(p) != t for p, t in zip(pages, texts)) > 0.9 * sum(map(bool, texts))
