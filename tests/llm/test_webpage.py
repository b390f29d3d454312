"""The block labeller: leaves, gradients, reading in pieces, held-out pages, pages written by hand, and whole tables."""

import re
from html import unescape

import numpy as np
import pytest

from lodestone.llm import webpage
from lodestone.llm.webpage import _Hashes, leaves, made_page


def test_leaves():
    html = """<!DOCTYPE html><head><title>no <b></title><style>p{}</style></head><body><!-- <p>no</p> --><script>var t = "</p><p>no";</script>
    <nav class="mainMenu top-bar"><a href='a>b'>One</a> &amp; <a>Two</a></nav><p><b>first&nbsp;&lt;x&gt; 1 < 2<br>line<p>second <i>in</i>line</b></p>
    <ul><li>a<li>b</ul>tail <span>x</span>y<table><tr><td>c<td>d</table><template><p>no</p></template><textarea><p>no</textarea><p>end &am"""
    found = leaves(html)
    assert [x.text for x in found] == ["One & Two", "first <x> 1 < 2 line", "second inline", "a", "b", "tail xy", "c", "d", "end &am"]
    assert {"t:nav", "t:body", "c:main", "c:menu", "c:top", "c:bar", "l:nav"} <= set(found[0].path) and found[0].linked == 6
    assert "t:nav" not in found[1].path and "l2:ul/li" in found[3].path
    assert leaves("") == [] == leaves("<p></p>  <div>\n</div>") == leaves("<script>x") == leaves("<!-- x")
    assert [x.text for x in leaves("plain text < and no tag")] == ["plain text < and no tag"]
    deep = leaves("<div>" * 50_000 + "<b>" * 50_000 + "x" + "<p>y" * 2000 + "</div>" * 50_000 + "z")
    assert len(deep) == 2002 and deep[-1].text == "z" and deep[-1].depth == 0


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    model = webpage.Labeller(rng)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x = rng.normal(size=(5, 3, webpage.WIDTH)) * (rng.random((5, 3, webpage.WIDTH)) < 0.05)
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], float)
    y = rng.integers(0, 2, (5, 3)).astype(float)
    _, g = model.gradients(x, y, mask)
    for k, w in model.w.items():
        flat = w.reshape(-1)
        for at in rng.choice(len(flat), min(len(flat), 12), replace=False):
            was, e = flat[at], 1e-5
            flat[at] = was + e
            up = model.gradients(x, y, mask)[0]
            flat[at] = was - e
            down = model.gradients(x, y, mask)[0]
            flat[at] = was
            assert abs((up - down) / (2 * e) - g[k].reshape(-1)[at]) < 1e-4, k


def _plain(model, page):
    """Odds of one page, leaf by leaf."""
    x = webpage.vectors([(page, 0, len(page), max(len(a.text) for a in page))], _Hashes(webpage.PATH), _Hashes(webpage.WORDS))
    n, out = webpage.HIDDEN, x @ model.w["s"] + model.w["ob"]
    for d, order, wo in (("f", range(len(page)), model.w["o"][:n]), ("b", range(len(page) - 1, -1, -1), model.w["o"][n:])):
        h = c = np.zeros(n)
        for t in order:
            z = x[t] @ model.w[f"x{d}"] + model.w[f"b{d}"] + h @ model.w[f"h{d}"]
            i, f, o = (1 / (1 + np.exp(-z[k * n : k * n + n])) for k in range(3))
            c = f * c + i * np.tanh(z[3 * n :])
            h = o * np.tanh(c)
            out[t] += h @ wo
    return out


def test_reading_in_pieces(monkeypatch):
    model = webpage.Labeller(np.random.default_rng(3))
    pages = [leaves(made_page(k)[0]) for k in range(6)] + [[], leaves("<p>one")]
    want = [_plain(model, p) if p else [] for p in pages]
    for step in (8192, 100, 9, 1):
        monkeypatch.setattr(webpage, "STEP", step)
        got = model.read(pages, _Hashes(webpage.PATH), _Hashes(webpage.WORDS))
        for a, b in zip(got, want, strict=True):
            assert np.allclose(a, b, atol=1e-3), step
    assert model.read([], _Hashes(webpage.PATH), _Hashes(webpage.WORDS)) == []


def _text(html):
    model = webpage.labeller()
    page = leaves(html)
    return "\n".join(x.text for x, o in zip(page, model.read([page], _Hashes(webpage.PATH), _Hashes(webpage.WORDS))[0], strict=True) if o > 0)


def test_made_pages_that_were_not_trained_on():
    right = total = 0
    for k in range(300):
        html, labels = made_page(9_000_000 + k)
        page = leaves(html)
        if len(page) == len(labels) and page:
            odds = webpage.labeller().read([page], _Hashes(webpage.PATH), _Hashes(webpage.WORDS))[0]
            right += int(((odds > 0) == np.array(labels)).sum())
            total += len(page)
    assert right / total > 0.96


PARAGRAPHS = [
    "The harbour was quiet when the first ferry of the season left the pier, and few of those who watched it go knew how long the crossing would take.",
    "Built in 1931, the vessel had been laid up for eleven winters. Its owners, a cooperative of islanders, raised the money for repairs with a lottery.",
    "“Nobody believed it would float,” said one of them.",
    "Three days later, it was back: late, soaked and very much alive.",
]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
WANT = "\n".join(["A ferry returns", *PARAGRAPHS])
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sports</a></li><li><a href="/c">Contact</a></li></ul>'
HAND = {
    "article": f"<html><body><header><h2><a href=/>The Daily Gull</a></h2><nav>{MENU}</nav></header><main><article><h1>A ferry returns</h1>{BODY}</article></main><aside><h3>Most read</h3>{MENU}</aside><footer><p>© 2024 The Daily Gull. All rights reserved.</p></footer></body></html>",
    "divs": f'<body><div id="header"><div class="logo">The Daily Gull</div></div><div id="nav">{MENU}</div><div id="content"><h1>A ferry returns</h1>{BODY}</div><div id="sidebar"><h3>Popular posts</h3>{MENU}</div><div id="footer">Copyright 2024 <a href=/i>Imprint</a></div></body>',
    "cookies": f'<body><div class="cookie-banner"><p>We use cookies to improve your experience on our site.</p><button>Accept all</button></div><nav>{MENU}</nav><article class="post"><h1>A ferry returns</h1>{BODY}</article><div class="advert">Advertisement: buy fresh fish now and save 50%.</div><footer>Terms of use</footer></body>',
    "comments": f'<body><nav>{MENU}</nav><article><h1>A ferry returns</h1>{BODY}</article><section id="comments"><h2>2 comments</h2><ol><li><p>Old salt says:</p><p>I was on board that day, and it was much worse than the article makes it sound. We nearly turned back twice.</p></li><li><p>Marie</p><p>Lovely story, thanks!</p></li></ol><form><label>Your name</label><input><button>Post comment</button></form></section><footer>© Gull</footer></body>',
    "inside": f'<body><nav>{MENU}</nav><main><h1>A ferry returns</h1><p>{PARAGRAPHS[0]}</p><div class="ad">Sponsored: cheap holidays by the sea, book today and save.</div><p>{PARAGRAPHS[1]}</p><form class="newsletter"><p>Sign up for our newsletter</p><input><button>Subscribe</button></form><p>{PARAGRAPHS[2]}</p><p>{PARAGRAPHS[3]}</p></main><footer><p>Privacy policy</p></footer></body>',
    "unclosed": f'<body><nav>{MENU}</nav><!-- ad --><div class="ad">Try it free today.</div><article><h1>A ferry returns</h1>{"".join(f"<p>{p}" for p in PARAGRAPHS)}</article><footer>&copy; gull.example &middot; made by islanders',
}


@pytest.mark.parametrize("name", HAND)
def test_pages_written_by_hand(name):
    assert _text(HAND[name]) == WANT


def test_no_article():
    assert _text(f"<body><nav>{MENU}</nav><footer>© 2024 all rights reserved</footer></body>") == ""


def test_tables(spark):
    hard = [(1, "u", None, 1, "t"), (2, None, "", 1, "t"), (3, "u", "   ", 1, "t"), (4, "v", HAND["article"], 1, "t"), (4, "v", HAND["article"], 1, "t"), (None, "w", HAND["unclosed"], 1, "t")]
    hard += [(5, "x", "<article>" + BODY * 3000 + "</article>", 1, "t"), (6, "y", "<p>" + "long " * 300_000, 1, "t")]
    rows = webpage.main_text(spark.createDataFrame(hard, "page_id long, url string, html string, n_chars long, text string")).collect()
    assert len(rows) == len(hard) and all(r.n_chars == len(r.text) for r in rows)
    got = {(r.page_id, r.url): r.text for r in rows}
    assert got[(1, "u")] == got[(2, None)] == got[(3, "u")] == "" and got[(4, "v")] == got[(None, "w")] == WANT
    assert got[(5, "x")] == "\n".join(PARAGRAPHS * 3000)
    assert webpage.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_op12_on_the_table(spark):
    from lodestone.llm.queries import queries

    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries()["op12_html_extraction"](spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)

    def article(html):
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", re.sub(r"<br>", " ", inner)))
        return "\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)

    same = sum(r.text == article(pages[r.page_id].html) for r in rows)
    assert same / len(rows) >= 0.99
