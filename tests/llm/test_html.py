import html
import random
import re

from jsonmill.llm import html as own
from jsonmill.llm import queries
from jsonmill.llm.html import align, content_regions, expression, extract, extract_main_text, fold, infer, infer_wrappers, tokenize


def text_of(page, order=("article", "main", "body")):
    return extract(tokenize(page), order)


def test_blocks_and_references():
    assert text_of("<p>a  b\n c&amp;d&nbsp;&eacute;</p><div>x<b>y</b><br>z</div> tail") == "a b c&d é\n\nxy z\n\ntail"
    assert text_of("<p>a < b <!-- no --> c<script>if (a</p>b)</script> d<p>e") == "a < b c d\n\ne"
    assert text_of("") == "" and text_of("<p> </p>") == "" and text_of("a <b") == "a"
    assert text_of("<ul><li>one<li>two</ul>") == "one\n\ntwo"


def test_what_is_no_article():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>Head</header><nav><ul><li>Menu</ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><div class=ad>Buy</div><main><article><header><h1>Title</h1></header><p>Text <a href='x>y'>link</a>.</p>"
        "<div class='ad-box'>Ad</div><form>Mail <input></form><p><b>Unclosed.<br><p>More</article>"
        "<section id=comments><article>Reader says</article></section></main><aside>Side</aside><footer>&copy; x</footer>"
    )
    assert text_of(page) == "Title\n\nText link.\n\nUnclosed.\n\nMore"


def test_fold_and_align():
    a = fold(tokenize("<ul><li>1</li><li>2</li><li>3</li></ul>").items)
    assert a == ["ul", ("+", ("li", "#body", "/li")), "/ul"]
    b = fold(tokenize("<ul><li>1</li></ul>").items)
    c = fold(tokenize("<ul><li>1</li></ul><p>x</p>").items)
    assert expression(infer([a, b])) == "<ul>(<li>(.*)</li>)+</ul>"
    assert expression(infer([b, a, c])) == "<ul>(<li>(.*)</li>)+</ul>(<p>)?((.*))?(</p>)?"
    assert content_regions(infer([a])) == ("body",)
    assert align(infer([a]), infer([a])) == infer([a])


def make_page(rng):
    paragraphs = [" ".join(rng.choice(["wort", "a&b", "x<y", "été", "fin."]) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 9))]
    body = "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs)
    menu = "".join(f"<li><a href=/{k}>{k}</a></li>" for k in range(rng.randint(1, 6)))
    ad = "<div class=ad>Kauf</div>" if rng.random() < 0.5 else ""
    return f"<html><body><nav><ul>{menu}</ul></nav>{ad}<article>{body}</article><footer>f</footer></body></html>", "\n\n".join(paragraphs)


def test_pages_against_what_made_them(spark, monkeypatch):
    rng = random.Random(8)
    made = [make_page(rng) for _ in range(120)]
    rows = [(i, f"http://h{i % 7}.example/x", p, "n") for i, (p, _) in enumerate(made)]
    rows += [(500, None, None, "n"), (501, "odd", "", "n"), (None, "http://h1.example/", "<p>z", "n"), (None, "http://h1.example/", "<p>z", "n"), (502, "http://h1.example/", "<article>" + "w " * 50_000, "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    want = [(i, t) for i, (_, t) in enumerate(made)] + [(500, ""), (501, ""), (None, "z"), (None, "z"), (502, ("w " * 50_000).strip())]
    got = [(r.page_id, r.text) for r in extract_main_text(pages).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    monkeypatch.setattr(own, "BROADCAST_HOSTS", 0)
    assert sorted([(r.page_id, r.text) for r in extract_main_text(pages).collect()], key=str) == sorted(want, key=str)
    assert extract_main_text(pages.limit(0)).count() == 0
    assert {r.host for r in infer_wrappers(pages).collect()} == {"", *(f"h{k}.example" for k in range(7))}


def test_whole_table_against_a_plain_reading(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op5_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<(?!/?(p|h1)\b)[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_constant_texts_and_content_without_known_names(spark):
    rows, want = [], {}
    for i in range(12):
        story = [f"Story {i} part {k} of its own." for k in range(1 + i % 3)]
        body = "".join(f"<p>{x}</p>" for x in story)
        top = "<div id=x1><span>Home</span><span>About us</span></div>"
        rows += [(i, "http://plain.example/a", f"<body>{top}<div id=x2><p>Our site wishes you a nice day.</p>{body}</div><div id=x3>&copy; Plain</div>")]
        want[i] = "\n\n".join(story)
        # the tags mislead: the article is a constant teaser, the story is in the body, and a date is part of a block
        rows += [(100 + i, "http://odd.example/a", f"<body><article><p>Read our best offers.</p></article><div>{body}</div><p>Day <b>{i}</b></p>")]
        want[100 + i] = "\n\n".join([*story, f"Day {i}"])
        # the names mislead: everything is in a widget
        rows += [(200 + i, "http://names.example/a", f"<body><div class=widget><p>Menu</p>{body}</div>")]
        want[200 + i] = "\n\n".join(story)
        # copies of one article are no template
        rows += [(300 + i, "http://copies.example/a", f"<article><p>Same text of all the copies.</p><p>And its end.</p></article><div class=ad>{i}</div>")]
        want[300 + i] = "Same text of all the copies.\n\nAnd its end."
        # the story is spread over an article and the main part
        rows += [(400 + i, "http://two.example/a", f"<main><article><p>Head {i}</p></article><div>{body}</div><div>Constant</div></main>")]
        want[400 + i] = "\n\n".join([f"Head {i}", *story])
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
