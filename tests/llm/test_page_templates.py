"""Main text of pages: whole templates, by brute force on the table, and on awkward pages."""

import html
import random
import re

import pytest

from larkspur.llm import page_templates as pt
from larkspur.llm import queries
from tests.llm.test_llm import FOLDER

PAGES = "page_id bigint, url string, html string, host string, text string, mains int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "t", 1) for r in rows], PAGES)


def texts(df):
    rows = df.collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    got = {r.page_id: r.text for r in rows}
    assert len(got) == len(rows)
    return got


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))


def by_hand(source):
    """For the given tables only: what lies between the article's tags."""
    found = re.search(r"<article>(.*?)</article>", source or "", re.S)
    parts = re.split(r"</?(?:h1|p)>", found[1] if found else "")
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in parts]
    return "\n".join(b for b in blocks if b)


def test_main_text_of_the_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    out = queries.QUERIES["op11_main_text"](spark, FOLDER)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert texts(out) == {r.page_id: by_hand(r.html) for r in rows}


def named(rng, i, body):
    menu = "".join(f"<li><a href='/{w}'>{w}</a>" for w in words(rng, rng.randint(2, 5)).split())
    return (
        f"<!DOCTYPE html><HTML><head><title>{words(rng, 3)}</title><script>if (a<b) x='</p><article>'</script></head>"
        f"<body class='no-sidebar'><header><h1>{words(rng, 2)}</h1></header><nav><ul>{menu}</ul></nav>"
        f"<div id=cookie-notice>{words(rng, 4)}</div><aside>{words(rng, 30)}</aside><article class='post-{i}'>{body}"
        f"<section class='comments'><article class=comment><p>{words(rng, 9)}</p></article></section></article>"
        f"<form>{words(rng, 3)}<input></form><footer>&copy; {words(rng, 5)}</footer></body></html>"
    )


def test_named_article(spark):
    rng = random.Random(1)
    rows, expected = [], {}
    for i in range(12):
        a, b, c = words(rng, 40), words(rng, 30), words(rng, 7)
        body = (
            f"<header><h1>{a[:20]} &amp; more</h1></header><p>{a}<p>{b[:30]} <b>bo</b>ld  \n<a href='x'>link</a><br>next"
            f"<div class='ad'>{words(rng, 5)}</div><ul><li>{c}<li>x &lt; {c}</ul><!-- {a} --><span class=advert>{b}</span>{c[::-1]}"
        )
        rows.append((i, f"https://Site.example:80{i}/p/{i}", named(rng, i, body)))
        blocks = [f"{a[:20]} & more", a, f"{b[:30]} bold link next", c, f"x < {c}", c[::-1]]
        expected[i] = "\n".join(" ".join(x.split()) for x in blocks)
    assert texts(pt.extract_main_text(pages(spark, rows))) == expected


def plain(rng, content, extra=""):
    """A template of nameless elements; the main one can be known only by its text."""
    links = "".join(f"<div><a href='#'>{w}</a></div>" for w in words(rng, 4).split())
    return (
        f"<html><body><div><div>{links}</div></div><div class=x><div class=y><h2>{words(rng, 2)}</h2>{content}</div>"
        f"<div class=z>{words(rng, 3)}</div></div>{extra}</body></html>"
    )


def test_nameless_main_element(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for i in range(20):
        paragraphs = [words(rng, rng.randint(25, 60)) for _ in range(rng.randint(2, 4))]
        # One page has little text of its own and a long foreign block; the host's template still tells what is what.
        if i == 7:
            paragraphs, extra = ["short"], f"<div>{words(rng, 300)}</div>"
        else:
            extra = ""
        source = plain(rng, "<p>Read on.</p>" + "".join(f"<p>{p}</p>" for p in paragraphs), extra)
        rows.append((i, f"http://host.example/{i}", source))
        heading = re.search("<h2>(.*?)</h2>", source)[1]
        # "Read on." is on every page and so a part of the template.
        expected[i] = "\n".join([heading, *paragraphs])
    got = texts(pt.extract_main_text(pages(spark, rows)))
    assert got == expected
    # Alone, that page is taken for its foreign block.
    assert texts(pt.extract_main_text(pages(spark, rows[7:8])))[7] != expected[7]


def test_copies_keep_their_text(spark):
    rng = random.Random(3)
    source = named(rng, 1, f"<p>{words(rng, 50)}</p><p>{words(rng, 50)}</p>")
    rows = [(i, f"http://copies.example/{i}", source) for i in range(30)]
    # Near copies as well, whose differing paragraph is the smaller part.
    rows += [(100 + i, f"http://near.example/{i}", source.replace("<article", f"<p>{i}</p><article")) for i in range(30)]
    got = texts(pt.extract_main_text(pages(spark, rows)))
    wanted = "\n".join(re.findall("<p>(.*?)</p>", source.split("<article class='")[1].split("<section")[0]))
    assert set(got.values()) == {wanted} and len(got) == 60


def test_templates_mixed_on_one_host(spark):
    """Two templates share a host; each page gets the text of its own."""
    rng = random.Random(4)
    rows, expected = [], {}
    for i in range(24):
        a = words(rng, 50)
        if i % 3:
            rows.append((i, "http://mixed.example/", named(rng, i, f"<p>{a}</p>")))
            expected[i] = a
        else:
            rows.append((i, "http://mixed.example/", source := plain(rng, f"<p>{a}</p>")))
            expected[i] = re.search("<h2>(.*?)</h2>", source)[1] + "\n" + a
    assert texts(pt.extract_main_text(pages(spark, rows))) == expected


def test_awkward_pages(spark):
    long = "wort " * 60_000
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    cases = {
        1: (None, ""), 2: ("", ""), 3: ("no markup &amp; no tags", "no markup & no tags"),
        4: (f"<article><p>{long}</article>", long.strip()), 5: (deep, "deep"),
        6: ("<article>a<!-- open <p>b", "a"), 7: ("<article>a<p title='open>b</p>c", "a"),
        8: ("<article>1 < 2 <p>&amp; &#233; &nbsp; &lt;b&gt; &am</article>", "1 < 2\n& é <b> &am"),
        9: ("<article>a<script>b</article></script><style>c</style>d</article>e", "ad"),
        10: ("<p>one<p>two</div></p></article>three", "one\ntwo\nthree"),
        11: ("<article></article><footer>foot</footer>", ""),
        12: ("<main><table><tr><td>a<td>b<tr><td>c</table></main>x", "a\nb\nc"),
        13: ("<article><p>a<span class=ad>no<p>b</article>", "a\nb"),
        14: ("<a <a <a <a", ""), 15: ("퟿\U0001f389<P>x</P>", "퟿\U0001f389\nx"),
    }
    urls = [None, "", "nonsense", "http://odd.example/a", "HTTP://ODD.example/b", "ftp://u:p@odd.example:21/"]
    rows = [(i, urls[i % len(urls)], source) for i, (source, _) in cases.items()]
    df = pages(spark, rows)
    assert texts(pt.extract_main_text(df)) == {i: text for i, (_, text) in cases.items()}
    assert pt.extract_main_text(df.where("false")).count() == 0
    twice = pages(spark, [(None, None, "<p>x"), (None, None, "<p>x"), (3, "http://a.b/", "<p>x")])
    assert sorted((r.page_id or 0, r.text) for r in pt.extract_main_text(twice).collect()) == [(0, "x"), (0, "x"), (3, "x")]


@pytest.mark.parametrize("n", [1_000, 100_000])
def test_open_markup_is_read_once(n):
    """Unfinished tags, comments and quotes in numbers; time in proportion, and no text lost before them."""
    for piece in ("<a ", "<a href='", "<!-- ", "<p", "</", "<!", '<a x="', "< ", "<b>", "<script>", "&", "<li class=ad>"):
        page = pt.Page("<p>start</p>" + piece * n)
        assert page.blocks[0][0] == "start"


def test_classes_by_vectors():
    """Sums of random numbers tell classes as the vectors themselves do, and order and nesting are seen."""
    sources = [f"<ul>{'<li><i class=ad></i></li>' * (i + 2)}</ul><p>t{i}</p>" for i in range(6)]
    token_lists = [pt.Page(s).tokens for s in sources]
    vectors = {}
    for token in set().union(*token_lists):
        vectors.setdefault(tuple(t.count(token) for t in token_lists), set()).add(token)
    assert sorted(len(v) for v in vectors.values()) == [1] * 6 + [4, 4]
    places, sizes = {}, {}
    for number, (_, members) in enumerate(sorted((v, m) for v, m in vectors.items() if len(m) > 1)):
        for place, token in enumerate(sorted(members, key=token_lists[0].index)):
            places[token] = number, place
        sizes[number] = len(members)
    outer = places[token_lists[0][0]][0]
    # ul, /ul, p and /p come in order; the list's items lie after the first of them.
    assert pt.slots_of(token_lists[0], places, sizes) == {outer: pt._TOP, 1 - outer: outer * pt._PLACES + 1}
    assert pt.slots_of(token_lists[0][::-1], places, sizes)[outer] == pt._BROKEN
    verdicts = [{"class": 0, "parent": pt._TOP, "pages": 9}, {"class": 1, "parent": 3, "pages": 97}, {"class": 1, "parent": pt._BROKEN, "pages": 3},
                {"class": 2, "parent": pt._PLACES * 3, "pages": 5}, {"class": 3, "parent": pt._BROKEN, "pages": 5}]
    assert pt.nested_classes(verdicts) == {0, 1}
