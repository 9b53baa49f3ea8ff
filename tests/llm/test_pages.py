"""Articles of made pages: what stands in the article stays whatever its size, what does not goes whatever it is called."""

import random

import pytest

from evispark.llm import wrappers


def text(page):
    return wrappers.main_text(page, None)


def test_an_article_is_not_replaced_by_longer_comments():
    comments = "".join(f"<p>{'A reader says much more about this than the article does. ' * 4}</p>" for _ in range(3))
    for name in ("reader-comments", "userComments", "commentlist", "fb-comments", "zzz"):
        assert text(f'<body><article><p>A short article.</p></article><div class="{name}">{comments}</div></body>') == "A short article."
        assert text(f'<body><main><article><p>A short article.</p></article></main><div class="{name}"><article>{comments}</article></div></body>').startswith("A short article.")


@pytest.mark.parametrize("name", ["reader-comments", "userComments", "commentlist", "fb-comments", "adbox", "google-ad", "dfp-ad-slot", "ad-wrapper-300x250", "ads", "cookieConsent"])
def test_names_of_comments_and_adverts(name):
    assert text(f'<body><div><h1>Head</h1><p>Story.</p><div class="{name}"><p>other</p></div></div></body>') == "Head\nStory."


def test_short_pages_stay():
    assert text("<form><p>A short article.</p></form>") == "A short article."
    assert text('<div class="social"><p>A short article.</p></div>') == "A short article."
    assert text('<body class="has-comments"><div class="post comments-open"><p>Text</p></div></body>') == "Text"
    assert text('<div class="ad-free-page sidebar"><article><p>Text</p></article></div>') == "Text"
    assert text("<nav>only</nav>") == "" == text("") == text("<div class=ad>x</div>")


def test_what_stands_in_the_article_stays():
    page = '<body><header><h1>Site</h1></header><main><h1>Head</h1><article><p>One <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> two</p><p class="comment">A remark</p><h2 class="related">Other work</h2></article><article><p>More</p></article></main><article><h2><a href="/x">Other story</a></h2><p>Teaser</p></article></body>'
    assert text(page) == "Head\nOne x=1 two\nA remark\nOther work\nMore"
    assert text('<article><h2><a href="/me">Linked head</a></h2><p>Body</p></article>') == "Linked head\nBody"


def site(r, pages, weak):
    """Pages of a host: a template of random blocks, an article of random parts, adverts and comments; and the articles."""
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    line = lambda n: " ".join(word() for _ in range(n))
    top, low, nav = line(6), line(7), "".join(f"<li><a href=/{k}>{word()}</a></li>" for k in range(4))
    wrap = r.choice(["<article>{}</article>", "<div><article>{}</article></div>", "<main>{}</main>"])
    out = []
    for _ in range(pages):
        blocks = [line(r.randrange(3, 30)) for _ in range(r.randrange(2, 7))]
        body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:-1])
        body += f'<div class="related"><p>{(last := line(30))}</p></div>' if weak else f"<section><p>{(last := blocks[-1])}</p></section>"
        blocks[-1] = last
        comments = "".join(f"<div class=q><b>{word()}</b><p>{line(r.randrange(3, 60))}</p></div>" for _ in range(r.randrange(6)))
        out.append((f"<body><div>{top}</div><ul>{nav}</ul><div class=google-ad>{line(8)}</div>{wrap.format(body)}<div class={r.choice(['reader-comments', 'zz'])}>{comments}</div><div><p>{low}</p></div></body>", "\n".join(blocks)))
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_generated_sites(spark, weak):
    r = random.Random(11 + weak)
    rows, want = [], {}
    for host, pages in enumerate((1, 2, 12, 40) if not weak else (12, 40)):
        for k, (page, article) in enumerate(site(r, pages, weak)):
            rows.append((len(rows), f"http://h{host}.org/{k}", page))
            want[rows[-1][0]] = article
    got = {x["page_id"]: x["text"] for x in wrappers.extract(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(4)).collect()}
    assert got == want
    # Names alone would leave out what only looks unlike an article: the host's pages tell that it is one.
    assert weak == any(text(p) != want[i] for i, _, p in rows)


def test_a_host_without_article_elements_needs_its_wrapper(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    bodies = [[word() * 3 for _ in range(r.randrange(1, 5))] for _ in range(9)]
    pages = [f"<body><div><p>Welcome</p><p>Offers</p></div><div>{''.join(f'<p>{b}</p>' for b in own)}</div><div><p>All rights</p></div></body>" for own in bodies]
    df = spark.createDataFrame([(i, "http://w.org/", p) for i, p in enumerate(pages)], "page_id int, url string, html string")
    assert {x["page_id"]: x["text"] for x in wrappers.extract(df).collect()} == {i: "\n".join(own) for i, own in enumerate(bodies)}
    assert all(text(p) != "\n".join(own) for p, own in zip(pages, bodies, strict=True))
