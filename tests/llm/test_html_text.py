"""HTML extraction: roles, differencing against a plain alignment, ranges, odd pages."""

import random

from epilake.llm import html_text as H

SCHEMA = "page_id long, url string, html string, text string, key int, host string"


def test_roles_and_text():
    page = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p><article>";</script></head>
    <body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li>News</ul></nav><!-- <p>no</p> -->
    <div class="cookie-notice"><p>We use cookies</p></div><div class="ad">Buy<br>now</div>
    <article class="post"><header class="entry-header"><h1>The  title&nbsp;here</h1></header><p><b>First &lt;b&gt; one<br><p>Second
      <a href="x">linked</a> words &#233;&#x41;.</p><div class="share-buttons">Share</div><form><input><button>Go</button>Mail</form>
      <ul><li>item one<li>item two</ul><blockquote>Quoted</blockquote><section id="comments"><p>Nice post!</p></section><pre>a   b</pre></article>
    <aside>Related</aside><p>outside</p><footer>&copy; all</footer><noscript>off</noscript></body></html>"""
    own = H.lines(page)
    assert H.main_text(own, set()) == "The title here\nFirst <b> one\nSecond linked words éA.\nitem one\nitem two\nQuoted\na b"


def test_broken_markup():
    assert H.lines("") == [] and H.lines("<") == [("<", H.OPEN)]
    assert H.lines("a < b && c &lt; d") == [("a < b && c < d", H.OPEN)]
    assert H.main_text(H.lines("<p>one<div>two</p></span></nav>three<script>x"), set()) == "one\ntwo\nthree"
    assert H.main_text(H.lines("<nav>menu<p>still</nav><article><p>x<nav>in</nav><p>y"), set()) == "x\ny"
    assert H.lines("<!-- open comment <p>x</p>") == []
    assert H.main_text(H.lines("<head><title>t</title><body><p>kept"), set()) == "kept"
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert H.lines(deep) == [("deep", H.OPEN)]


def test_odd_quotes_and_slashes():
    text = lambda page: H.main_text(H.lines(page), set())
    assert text("<p class=it's>Hello") == "Hello" and text('<p title="x>Hello') == "Hello"
    assert text("<p class=it's>Hello, don't <b>go</b></p><p>on") == "Hello, don't go\non"
    assert text("""<p title="a > b" lang='x>y'>Hello""") == "Hello" and text("<p data-x = 'a>b'>Hello") == "Hello"
    assert text('<p "odd>Hello "you"') == 'Hello "you"'
    assert text("<nav class=/a/>menu</nav><article id=/b/><p>text</article>") == "text"
    assert text('<div class="ad"/><p>text') == "text" and text("<nav a='/'/><p>text") == "text"
    assert text("<a " + 'b="c" ' * 3000) == "<a " + 'b="c" ' * 2999 + 'b="c"'  # no end: one pass over the attributes


def lcs(x, y):
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def subsequence(s, y):
    it = iter(y)
    return all(c in it for c in s)


def test_alignment(monkeypatch):
    rng = random.Random(1)
    for _ in range(400):
        x, y = ([rng.randrange(rng.choice([2, 6, 40])) for _ in range(rng.randint(0, 25))] for _ in "xy")
        got = [x[i] for i in sorted(H.common(x, y))]
        assert len(got) == lcs(x, y) and subsequence(got, y)
    monkeypatch.setattr(H, "ALIGN_BITS", 0)
    for _ in range(100):
        x, y = rng.sample(range(40), 25), rng.sample(range(40), 25)
        got = [x[i] for i in sorted(H.common(x, y))]
        assert len(got) == lcs(x, y) and subsequence(got, y)


def site(host, n, hot=False):
    """Pages without article elements, whose frame only differencing tells from the text."""
    frame = [f"{host} home", f"{host} about us", "Latest stories"]
    return [(f"https://{host}/{'same' if hot else i // 3}/{i}?q={i}#x",
             "".join(f"<div>{x}</div>" for x in frame) + f"<p>Story {host} {i} is told here.</p><p>And part two of {i}.</p><div>{host} imprint</div>",
             f"Story {host} {i} is told here.\nAnd part two of {i}.") for i in range(n)]


def test_differencing_and_ranges(spark):
    rows, want = [], {}
    for u, h, t in site("a.example", 60, True) + site("b.example", 7) + site("C.example", 2):
        want[len(rows)] = t
        rows.append((len(rows), u, h, "x", 1, "y"))
    copies = "<nav>n</nav><article><h1>Copied</h1><p>The same article.</p></article><div>foot</div>"
    for u in ("http://d.example/1", "http://d.example/1", "http://d.example/2"):
        want[len(rows)] = "Copied\nThe same article."
        rows.append((len(rows), u, copies, None, None, None))
    for u, h, t in ((None, None, ""), (None, "<p>x", "x"), ("", "", ""), ("nonsense url", "<p>y &amp; z", "y & z"), ("http://long.example/", "<p>" + "w " * 200_000, ("w " * 200_000).strip())):
        want[len(rows)] = t
        rows.append((len(rows), u, h, "x", 1, "y"))
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 6):
        got = H.extract(df, parts).collect()
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        assert {r.page_id: r.text for r in got} == want


def test_repeated_and_null_ids(spark):
    rows = [(None, "http://e.example/1", "<article><p>a", "", 0, ""), (None, "http://e.example/1", "<article><p>a", "", 0, ""),
            (5, "http://e.example/1", "<article><p>b", "", 0, ""), (5, "http://e.example/1", "<article><p>b", "", 0, ""), (-5, "http://e.example/1", "<article><p>c", "", 0, "")]
    got = H.extract(spark.createDataFrame(rows, SCHEMA), 3).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == sorted((str(r[0]), r[2][-1]) for r in rows)
    assert H.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_copies_without_article(spark):
    """Copied pages keep their text, however many there are and wherever the ranges are cut."""
    frame = ["Home", "About us", "Imprint"]
    page = lambda text: "".join(f"<div>{x}</div>" for x in frame) + f"<p>{text}</p>"
    rows, want = [], {}
    for i in range(80):
        text = "Front story" if i < 20 else f"Story {i}" if i < 25 else "Copied story" if i < 65 else f"Story {i}"
        want[i] = text
        rows.append((i, f"https://f.example/{i:03d}", page(text), "", 0, ""))
    for i in range(80, 90):
        want[i] = "\n".join([*frame, "Only story"])
        rows.append((i, f"https://g.example/same?q={i}", page("Only story"), "", 0, ""))
    df = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 4, 30):
        got = H.extract(df, parts).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want


def test_split_alignment_is_longest(monkeypatch):
    rng = random.Random(5)
    for bits in (0, 40, 200):
        monkeypatch.setattr(H, "ALIGN_BITS", bits)
        for _ in range(150):
            x, y = ([rng.randrange(rng.choice([2, 6, 40])) for _ in range(rng.randint(0, 25))] for _ in "xy")
            got = [x[i] for i in sorted(H.common(x, y))]
            assert len(got) == lcs(x, y) and subsequence(got, y)


def test_class_words_of_wrappers():
    story = "<article><h1>Title</h1><p>The story.</p></article>"
    want = "Title\nThe story."
    for wrapper in ('class="wrap has-sidebar"', 'id="page" class="no-sidebar"', 'class="content-with-header"', 'class="header-layout"', 'id="search"'):
        assert H.main_text(H.lines(f"<body><div {wrapper}><nav>Menu</nav>{story}<div class='sidebar'>Side</div></div>"), set()) == want, wrapper
    for wrapper in ('class="share-enabled"', 'class="widget-text"'):
        page = f"<article><h1>Title</h1><div {wrapper}><p>The story is told at some length.</p></div><div class='social'><p>Share</p></div></article>"
        assert H.main_text(H.lines(page), set()) == "Title\nThe story is told at some length.", wrapper
    page = "<article><h1>T</h1><p>x</p><section id='comments'><article class='comment'><p>A very long reply to this.</p></article></section></article>"
    assert H.main_text(H.lines(page), set()) == "T\nx"
    # without article or main the pair decides
    own = H.lines("<div class='widget'>About us</div><div class='search-results'><p>Own text.</p></div>")
    assert own == [("About us", H.OPEN), ("Own text.", H.OPEN)] and H.main_text(own, {0}) == "Own text."
