import json
import random

from pyspark.sql import functions as F

from lattix.llm import html_extract as h


def page(article, extra="", n=0):
    return f'<!DOCTYPE html><html><head><title>No {n}</title><script>var t="</p><article>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div class="cookie-notice">We use cookies</div>{article}{extra}<footer>&copy; us</footer></body></html>'


CASES = [
    ("<article><h1>Title &amp;  more</h1><p>A <b>bo</b>ld\n word.<p>Next &lt;p&gt; &#233;</p><div class='ad'>Buy</div><ul><li>x</li><li>y</li></ul></article>", "Title & more A bold word. Next <p> é x y"),
    ("<article><p>One</p><p>Two</p><section class='comments'><p>Nice post</p></section></article>", "One Two"),
    ("<article><p>Only<br>this</p><form>Sign up <input></form></article><aside><p>Side</p></aside>", "Only this"),
    ("<main><div class='sidebar'><p>no</p></div><p>Main text</p></main>", "Main text"),
    ("<div class='content'><p>Content text 3 < 4</p></div>", "Content text 3 < 4"),
    ("<p>Plain body</p>", "Plain body"),
    ("<article></article>", ""),
]


def test_cases(spark):
    rows = [(i, f"http://h{i}.example.org/x", page(a, n=i)) for i, (a, _) in enumerate(CASES)]
    rows += [(100, None, None), (101, "http://h0.example.org/y", ""), (102, "nonsense", "no tags at all"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "host": F.lit("x"), "content": F.lit(2)})
    got = h.extract(df).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    for i, (_, want) in enumerate(CASES):
        assert text[i] == want, i
    assert (text[100], text[101], text[102]) == ("", "", "no tags at all")
    assert all(r.n_chars == len(r.text) for r in got)
    assert h.extract(df.limit(0)).count() == 0


def test_wrapper_is_union_free():
    shapes = [h.shape(h.Page(page(f"<article>{'<p>t</p>' * n}{extra}</article>"))) for n, extra in ((1, ""), (3, ""), (2, "<div class='ad'>x</div>"), (5, "<ul><li>a</li><li>b</li></ul>"))]
    wrapper = shapes[0]
    for s in shapes[1:]:
        wrapper = h.aligned(wrapper, s)
    kinds = lambda items: {x[0] for x in items} | {k for x in items if x[0] in "ro" for k in kinds(x[1])}
    assert kinds(wrapper) <= {"t", "s", "r", "o"} and "o" in kinds(wrapper) and "r" in kinds(wrapper)
    assert all(h.places(s) <= h.places(wrapper) for s in shapes)


def test_two_templates_on_one_host(spark):
    bodies = ["<article><p>First {}</p></article>", "<main><p>Second {}</p></main>", "<div class='content'><p>Third {}</p></div>", "<div><p>Fourth {}</p></div>"]
    for urls in (lambda i: "http://mixed.example.org/x", lambda i: None if i % 8 < 4 else "nonsense"):
        rows = [(i, urls(i), page(bodies[i % 4].format(i), n=i)) for i in range(12)]
        got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {i: f"{('First', 'Second', 'Third', 'Fourth')[i % 4]} {i}" for i in range(12)}


def test_constant_texts_are_template(spark):
    stub = "<div class='x1'>Join our club</div><div class='x1'><p>{}</p></div><p>{} of <b>many</b></p><div><p>Hours: 9 to 5</p></div>"
    bodies = [page(stub.format(f"Story {i}", f"Part {i}"), n=i) for i in range(8)]
    rows = [(i, "http://club.example.org/x", b) for i, b in enumerate(bodies)]
    rows += [(10 + i, "http://copies.example.org/x", bodies[0]) for i in range(5)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(8)] == [f"Story {i} Part {i} of many" for i in range(8)]
    assert {got[10 + i] for i in range(5)} == {"Join our club Story 0 Part 0 of many Hours: 9 to 5"}


def test_plain_bodies_keep_lists_links_and_bare_text(spark):
    bodies = [
        ("<div><h1>Head</h1><p>Text</p><ul><li>Step one</li><li>Step <a href='/x'>two</a></li></ul></div>", "Head Text Step one Step two"),
        ("<div><h2><a href='/t'>Linked head</a></h2><div>See <a href='/y'>this</a> word</div></div>", "Linked head See this word"),
        ("<p>One</p>between<p>Two</p><ul><li><a href='/1'>Home</a></li><li><a href='/2'>Help</a></li></ul>", "One between Two"),
        ("<div><a href='/1'>Home</a> <a href='/2'>Help</a></div><table><tr><td>Cell <a href='/3'>link</a></td></tr></table><p>End</p>", "Cell link End"),
        ("<div class='x2'><section><ul><li>Far away</li></ul></section></div><div><div><p>Here</p></div></div>", "Here"),
    ]
    rows = [(i, "http://plain.example.org/x", page(b, n=i)) for i, (b, _) in enumerate(bodies)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(bodies))] == [want for _, want in bodies]


def accepts(items, tokens):
    """Whether an expression takes a whole sequence of (kind, token): every way is tried."""

    def ends(items, at):
        found = {at}
        for kind, x in items:
            now = set()
            for i in found:
                if kind in "ts":
                    now |= {i + 1} if i < len(tokens) and tokens[i] == (kind, x) else set()
                elif kind == "o":
                    now |= {i} | ends(x, i)
                else:
                    seen, new = set(), ends(x, i)
                    while new - seen:
                        seen |= new
                        new = set().union(*(ends(x, j) for j in new))
                    now |= seen
            found = now
        return found

    return len(tokens) in ends(items, 0)


def random_page(rng, n):
    items = "".join(f"<li><a href='/{i}'>Link {n} {i}</a></li>" for i in range(rng.randrange(1, 5)))
    parts = [f"<h1>Head {n}</h1>"] + [rng.choice([f"<p>Text <b>{n}</b> {i}</p>", f"<p>Text {n} {i}<br>more</p>", f"<ul>{''.join(f'<li>Point {n} {j}</li>' for j in range(rng.randrange(1, 4)))}</ul>", f"<table><tr><td>{n}</td><td>{i}</td></tr></table>", f"<div class='ad'>Ad {n}</div>"]) for i in range(rng.randrange(1, 8))]
    note = "<div><span>All rights</span></div>" if rng.random() < 0.5 else ""
    return f"<html><body><ul>{items}</ul>{note}<{'article' if n % 3 else 'div'}>{''.join(parts)}</{'article' if n % 3 else 'div'}></body></html>"


def test_wrappers_take_their_pages():
    rng = random.Random(51)
    pages = [h.Page(random_page(rng, n)) for n in range(150)]
    folding = h.Folding()
    shapes = [h.shape(p, folding) for p in pages]
    wrapper = h.inferred(iter(shapes))
    pattern, matched = h.Wrapper(wrapper), 0
    for p, s in zip(pages, shapes):
        runs = h.stream(p)
        tokens = [(k, x) for k, x, _ in runs]
        assert accepts(s, tokens) and accepts(wrapper, tokens)
        m = pattern.match(runs)
        matched += m is not None
        if m is not None:
            assert {at: pattern.slots[slot][0] for at, slot in m.items()} == {i: x for i, (k, x) in enumerate(tokens) if k == "s"}
    assert matched == len(pages)
    for n in range(20):  # other pages need not be taken, but never are wrongly
        runs = h.stream(h.Page(random_page(rng, 1000 + n)))
        assert (pattern.match(runs) is not None) == accepts(wrapper, [(k, x) for k, x, _ in runs])


def test_wrapper_grows_little_with_pages():
    sizes = []
    for many in (100, 1000):
        rng = random.Random(52)
        folding = h.Folding()
        distinct = {json.dumps(h.shape(h.Page(random_page(rng, n)), folding)) for n in range(many)}
        sizes.append(h.size(h.inferred(json.loads(s) for s in sorted(distinct, key=lambda s: (len(s), s)))))
    assert sizes[1] < 3 * sizes[0] and sizes[1] < h.MOST_ITEMS


def test_the_wrapper_decides(spark, monkeypatch):
    """A menu of one link is a menu where other pages of the host show that it repeats; without wrappers it is text."""
    rows = [(i, "http://menu.example.org/x", f"<html><body><ul>{''.join(f'<li><a href=/{j}>Go {i} {j}</a></li>' for j in range(1 + i % 3))}</ul><div>Story {i}</div></body></html>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in h.extract(df).collect()} == {i: f"Story {i}" for i in range(9)}
    assert h.extracted(h.Page(rows[0][2])) == "Go 0 0 Story 0"


def test_names_are_evidence_in_an_article():
    kept = "<article><header><h1>Head</h1></header><div class='side-note'>One</div><section id='related-work'>Two</section><p class='legal'>Three</p><div class='article-header'>Four</div></article>"
    assert h.extracted(h.Page(kept)) == "Head One Two Three Four"
    gone = "<article><p>Text</p><div class='share-buttons'>a</div><div class='related-posts'>b</div><nav>c</nav><footer>d</footer><div class='ad-slot-3'>e</div><div role='navigation'>f</div><aside>g</aside><div id='comments'>h</div></article>"
    assert h.extracted(h.Page(gone)) == "Text"


def test_long_pages_and_unclosed_tags_are_linear():
    import time

    def took(html):
        began = time.process_time()
        h.extracted(h.Page(html))
        return time.process_time() - began

    for unit, tail in (('<a x="b', ""), ("<a ", '" >'), ('<a "> "', "x"), ("<script ", ""), ("<div>x", ""), ("<p>some text <b>x</b></p>", ""), ("<ul><li>a<li>b</ul>", "")):
        small, large = took("<article>" + unit * 4000 + tail), took("<article>" + unit * 40000 + tail)
        assert large < 30 * small + 0.5, unit
    assert h.extracted(h.Page("<article><p data-x='<b>'>a < b</p>" + "<p>word </p>" * 100_000 + "</article>")) == "a < b" + " word" * 100_000
