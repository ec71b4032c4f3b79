"""Lines, alignment and main text, against plain versions of them."""

import random

import pytest

from postgrain.llm import page_difference as P

SCHEMA = "page_id long, url string, html string"


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("bits", [1 << 27, 16])
def test_alignment_is_longest(monkeypatch, bits):
    monkeypatch.setattr(P, "_BITS", bits)  # 16: by halves
    draw = random.Random(1)
    for _ in range(800):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(14))] for _ in "ab")
        places = P.common(a, b)
        rest = iter(b)
        assert places == sorted(set(places)) and all(a[k] in rest for k in places)
        assert len(places) == longest(a, b)


def test_alignment_of_many_equal_lines():
    assert len(P.common(["x"] * 30_000, ["y", *["x"] * 20_000, "z"])) == 20_000


def texts(page, neighbours=()):
    return P.difference(P.lines_of(page), [P.lines_of(n) for n in neighbours])


def test_lines():
    page = ("<!DOCTYPE html><title>No</title><style>p{}</style><script>'<p>no</p>'</script><!-- <p>no -->"
            "<p>One\n\t two&nbsp;&amp;&#233;&lt;b&gt; <b>bo<i>ld</i></b>!<br>more<p title='a>b'>a < b <3</p>"
            "<ul><li>first<li>second</ul><table><tr><td>x</td><td>y</table><p></p><div> </div>tail<a href=")
    assert [line.text for line in P.lines_of(page)] == [
        "One two &é<b> bold! more", "a < b <3", "first", "second", "x y", "tail"]
    assert P.lines_of(None) == P.lines_of("") == P.lines_of("<script>never closed") == []
    assert [line.text for line in P.lines_of("<p " * 30_000 + "<p>" * 30_000 + "deep")] == ["deep"]


LAYOUT = """<body class="has-sidebar"><header><h1>Site</h1><a href=/>home</a></header><nav>menu</nav>
<div class="cookie-notice"><p>We use cookies</p></div><form>search <input></form>
<main><div class="ad">Buy</div><article class="post"><header><h1>Title {0}</h1><p>by someone</p></header>
<p>Body {0} &amp; more.</p><p>A passage that many pages quote.</p><p><a href="#">Share this</a></p>
<div class="share-buttons">share</div><aside>related</aside><p hidden>secret</p>
<section id="comments"><article><p>first!</p></article></section><footer>tags</footer></article></main>
<div class="sidebar">side</div><footer>&copy; {0}</footer>"""


def test_article_of_a_page_that_marks_it():
    one, two = LAYOUT.format(1), LAYOUT.format(2)
    whole = ["Title 1", "Body 1 & more.", "A passage that many pages quote."]
    assert texts(one) == [*whole, "Share this"]
    assert texts(one, [two]) == whole  # shared lines of links alone are the template's, shared prose is quoted
    assert texts(one, [one]) == whole
    assert texts(f"<form action=/>{one}</form>") == [*whole, "Share this"]


def test_unmarked_pages_lose_what_their_neighbours_have():
    page = "<body><div>Site name</div><table><tr><td>{0}</table><p>Text {0}.</p><p>Text two {0}.</p><div>All rights</div>"
    one, two = page.format("One"), page.format("Two")
    assert texts(one) == ["Site name", "One", "Text One.", "Text two One.", "All rights"]
    assert texts(one, [two]) == texts(one, [one, two]) == ["One", "Text One.", "Text two One."]
    assert texts(one, [one]) == texts(one)  # a copy tells nothing


def expected(rows):
    """Results by a plain walk over the sorted rows."""
    def split(url):
        rest = (url or "").partition("://")[2]
        host, slash, path = rest.partition("/")
        return host.lower(), slash + path

    order = sorted(rows, key=lambda r: (*(x.encode() for x in split(r[1])), (r[1] or "").encode(), r[0] or -1))
    out = []
    for k, (page_id, url, page) in enumerate(order):
        host, path = split(url)
        near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order) and host and split(order[j][1])[0] == host]

        def same(other, path=path):
            pairs = list(zip(path.split("/"), split(other[1])[1].split("/"), strict=False))
            return next((k for k, (a, b) in enumerate(pairs) if a != b), len(pairs))

        near.sort(key=lambda o: -same(o))
        text = "\n".join(texts(page, [o[2] for o in near]))
        out.append((page_id, url, text, len(text)))
    return sorted(out, key=repr)


def test_pages_by_host_and_path(spark):
    draw = random.Random(2)
    page = "<div>{0}</div><p>{1}</p><p>{2}</p><div>{0} end</div>"
    hosts = ["hot.example"] * 6 + ["Hot.example", "b.example", "c.example"]
    rows = [(i, f"https://{draw.choice(hosts)}/{draw.choice('abc')}/{draw.randrange(60)}",
             page.format(draw.choice(["site", "name"]), draw.choice("xyz"), i)) for i in range(150)]
    rows += [(900, None, page.format("site", "x", 1)), (901, None, page.format("site", "x", 2)), (902, "no url", None),
             (None, "http://b.example/a/1", ""), (903, "http://alone.example", LAYOUT.format(3)), rows[5], rows[5],
             (904, "https://hot.example/a/1", "<p>" + "long " * 100_000)]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for parts in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(sorted((tuple(r) for r in P.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert found[0] == found[1] == expected(rows)


def test_other_columns_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "http://a/b", "<p>x</p>", 1, 2, 3)], SCHEMA + ", key int, `odd.name` int, `URL` int")
    assert [tuple(r) for r in P.main_texts(frame).collect()] == [(1, "http://a/b", "x", 1)]
    assert P.main_texts(frame.limit(0)).collect() == []
