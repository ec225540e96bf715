import functools
import json
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import html_wrappers as w

PAGES = "page_id long, url string, html string, text string"


def text_of(spark, pages):
    df = spark.createDataFrame([(i, u, h, "theirs") for i, (u, h) in enumerate(pages)], PAGES)
    got = w.extract(df).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def page(body, aside="", comments=""):
    return (
        "<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t='</p>';</script></head><body><header><h2>Site</h2></header>"
        f"<nav><ul><li><a href='/a'>Menu</a></li></ul></nav><!-- no <p>no</p> --><div class='cookie-notice'>We</div><div class=\"ad\">Buy</div>"
        f"<article>{body}</article>{aside}<section id='comments'><p>{comments}</p></section><form><p>Mail</p></form><footer>&copy; no</footer>"
    )


def test_article_text(spark):
    body = "<h1>Ti&amp;tle &am</h1><p>one <b>t</b>wo<br>three\n\t four&nbsp;five<p>six &lt;p&gt; &#233;&quot;<ul><li>a<li>b</ul><div class=share>no</div><p></p>end"
    pages = [("http://h/1", page(body, "<aside><p>no</p></aside>", "no")), ("http://h/2", page("<p>only</p>")), (None, None), ("x", ""), ("y", "bare  text")]
    assert text_of(spark, pages) == ["Ti&tle &am one two three four five six <p> é\" a b end", "only", "", "", "bare text"]


def test_pages_without_an_article_use_the_wrapper(spark):
    def plain(n):
        links = "".join(f"<li><a href='/{n}{i}'>go {n} {i}</a></li>" for i in range(6))
        return f"<body><div class=top><p>Welcome to us</p></div><ul>{links}</ul><div class=body><h1>Head {n}</h1><p>Text {n} here</p><p>More {n}</p></div><p>Made by us</p></body>"

    got = text_of(spark, [("http://w/" + str(n), plain(n)) for n in range(12)])
    assert got == [f"Head {n} Text {n} here More {n}" for n in range(12)]


def test_wrapper_has_slots_options_and_repeats(spark):
    html = ["<div><h1>a</h1><p>x</p><p>y</p><b>k</b></div>", "<div><h1>b</h1><table><tr><td>1</table><p>z</p></div>"]
    df = spark.createDataFrame([("h", x) for x in html], "host string, html string")
    found = w.expression(json.loads(w.infer(df).first().wrapper))
    assert "<h1>#PCDATA</>" in found and "(<table>" in found and ")?" in found and "(<p>#PCDATA" in found and ")+" in found


@pytest.mark.parametrize("html", ["<div>" * 3000 + "deep" + "</div>" * 3000, "<p " + '"' * 5000 + ">after</p>", "<" * 5000 + "x", "<a href='" + "x" * 200_000 + "'>t</a>"])
def test_odd_pages_end(html):
    w.main_text(html, {})


def test_no_text_is_lost_by_depth():
    assert w.main_text("<div>" * 500 + "deep" + "</div>" * 500 + "<p>after", {}) == "deep after"


def test_empty_table(spark):
    assert w.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_repeated_pages_and_hosts(spark):
    pages = [("http://h/1", page("<p>same</p>"))] * 50 + [("http://other/", page("<main><p>in</p></main>"))]
    assert text_of(spark, pages) == ["same"] * 50 + ["in"]
    hosts = spark.createDataFrame([(i, u, h, "") for i, (u, h) in enumerate(pages)], PAGES).select(w.host_and_path(F.col("url"))[0].alias("host"), "html")
    assert w.infer(hosts).count() == 2


def test_copies_of_one_page_are_not_template(spark):
    copy = "<body><div class=top><h1>Head</h1></div><div class=body>One block</div></body>"
    other = "<body><h2>Other {0}</h2><table><tr><td>cell {0}</td></tr></table></body>"
    pages = [("http://c/1", copy)] * 5 + [("http://b/1", "bare text")] * 4
    # an optional group of a host whose other pages differ
    pages += [("http://o/1", copy)] * 4 + [(f"http://o/{n}", other.format(n)) for n in range(4)]
    assert text_of(spark, pages) == ["Head One block"] * 5 + ["bare text"] * 4 + ["Head One block"] * 4 + [f"Other {n} cell {n}" for n in range(4)]


def test_siblings_of_one_label_keep_their_template(spark):
    def plain(n):
        return f"<body><div><p>Ours alone</p></div><h1>Head {n}</h1><div><p>Text {n}</p></div><h2>Sub {n}</h2><div><p>Made by us</p></div></body>"

    assert text_of(spark, [(f"http://s/{n}", plain(n)) for n in range(6)]) == [f"Head {n} Text {n} Sub {n}" for n in range(6)]


def test_the_wrapper_removes_template_inside_main_elements(spark):
    def with_main(n):
        links = "".join(f"<li><a href='/{n}{i}'>see {n} {i}</a></li>" for i in range(5))
        return f"<body><p>Top {n}</p><main><p>By our staff</p><h1>Head {n}</h1><div><p>Text {n}</p><p>More {n}</p></div><ul>{links}</ul><h3>Share this</h3></main></body>"

    assert text_of(spark, [(f"http://m/{n}", with_main(n)) for n in range(8)]) == [f"Head {n} Text {n} More {n}" for n in range(8)]
    # two pages show no template
    few = text_of(spark, [(f"http://m/{n}", with_main(n)) for n in range(2)])
    assert all(x.startswith("By our staff Head") and x.endswith("Share this") for x in few)


def test_the_wrapper_overrules_names(spark):
    long = "words of text number {0} " * 20
    teaser = "<body><article><h4>Tip {0}</h4></article><div><h1>Head {0}</h1><p>" + long + "</p></div></body>"
    widget = "<body><p>Ours</p><div class='widget post'><h1>Head {0}</h1><p>" + long + "</p></div><div class=ad>Buy {0}</div></body>"
    text = [f"Head {n} " + " ".join(long.format(n).split()) for n in range(5)]
    assert text_of(spark, [(f"http://t/{n}", teaser.format(n)) for n in range(5)]) == [f"Tip {n} {x}" for n, x in enumerate(text)]
    assert text_of(spark, [(f"http://w/{n}", widget.format(n)) for n in range(5)]) == text


def test_copied_articles_are_not_template(spark):
    got = text_of(spark, [(f"http://a/{n % 3}", page("<h1>Same</h1><p>body</p>", f"<div>seen {n}</div>")) for n in range(6)])
    assert got == ["Same body"] * 6


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def plain_wrapper(pages):
    """Distinct pages folded one after another: by part, then the parts."""
    parts = {}
    for html in set(pages):
        x = signed(xxhash.xxh64_intdigest(html, 42))
        y = signed(xxhash.xxh64_intdigest(html, xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)))
        parts.setdefault(x % w.SALTS, []).append((x, y, html))
    folded = [functools.reduce(w.align, [w.as_wrapper(w.read_page(h)) for *_, h in sorted(parts[s])]) for s in sorted(parts)]
    return json.dumps(functools.reduce(w.align, folded))


def test_wrappers_do_not_depend_on_storage(spark):
    r = random.Random(2)
    bits = ["<h1>Head {0}</h1>", "<table><tr><td>{0}</table>", "<p>Text {0}</p>", "<p>Ours</p>", "<div class='x y z q'><p>in {0}</p></div>", "<ul><li>a<li>b</ul>"]
    pages = [("<body>" + "".join(r.choice(bits).format(n) for _ in range(6)) + "</body>") for n in range(40)] * 2
    want = plain_wrapper(pages)
    for n in (1, 4, 32):
        r.shuffle(pages)
        df = spark.createDataFrame([("h", p) for p in pages], "host string, html string").repartition(n)
        assert [x.wrapper for x in w.infer(df).collect()] == [want]


def test_a_wrapper_is_bounded_and_loses_no_text(spark):
    pages = [(f"http://k/{n}", "<body>" + "".join(f"<x{n}-{i}>part {n} {i}</x{n}-{i}>" for i in range(30)) + "<p>Made by us</p></body>") for n in range(40)]
    df = spark.createDataFrame([("h", h) for _, h in pages], "host string, html string")
    assert len(json.loads(w.infer(df).first().wrapper)[7]) <= w.KIDS
    got = text_of(spark, pages)
    assert all(got[n].startswith(" ".join(f"part {n} {i}" for i in range(30))) for n in range(40))


def wide_page(n, names, more=""):
    """Short constant texts in elements with names of their own around what varies."""
    ours = "".join(f"<div class='x{i}'>Ours {i}</div>" for i in names)
    return f"<body>{ours}<div class=text><h1>Head {n}</h1><p>Text {n} is longer than what is ours by far, {n * n}</p></div>{more}</body>"


def told(n):
    return f"Head {n} Text {n} is longer than what is ours by far, {n * n}"


def test_wide_nodes_keep_their_template(spark):
    r = random.Random(4)
    pages = [(f"http://k/{n}", wide_page(n, r.sample(range(600), 240))) for n in range(60)]
    pages += [(f"http://few/{n}", wide_page(n, [7])) for n in range(6)]
    assert text_of(spark, pages) == [told(n) for n in (*range(60), *range(6))]


def test_wide_nodes_count_from_both_ends(spark):
    r = random.Random(9)

    def html(n):
        own = "".join(f"<p>Own {n} {i}</p><div class='own{n}q{i}'>more</div>" for i in range(r.randint(1, 9)))
        return f"<body><p>By our staff</p><h2>{n}</h2>{own}" + "".join(f"<div class='x{i}'>Ours</div>" for i in r.sample(range(600), 240)) + "<p>Made by us</p></body>"

    pages = [html(n) for n in range(30)]
    want = [" ".join([str(n), *(f"Own {n} {i} more" for i in range(h.count("more")))]) for n, h in enumerate(pages)]
    assert text_of(spark, [(f"http://k/{n}", h) for n, h in enumerate(pages)]) == want


def test_wide_nodes_inside_wide_nodes(spark):
    r = random.Random(5)

    def nested(n):
        inner = "".join(f"<section class='y{i}'><b>Inner {i}</b></section>" for i in r.sample(range(500), 240))
        own = "".join(f"<div class='own{n}q{i}'>Only {n} {i}</div>" for i in range(3))
        return wide_page(n, r.sample(range(500), 230), f"<div class=list>{inner}</div>{own}")

    got = text_of(spark, [(f"http://k/{n}", nested(n)) for n in range(30)])
    assert got == [f"{told(n)} " + " ".join(f"Only {n} {i}" for i in range(3)) for n in range(30)]


def test_neighbours_may_be_wide_together(spark):
    r = random.Random(10)

    def half(n, k):
        ours = "".join(f"<section class='x{i}'>Ours {i}</section>" for i in r.sample(range(600), 130))
        return f"<div>{ours}<h3>Own {n} {k}</h3></div>"

    # one repeated group on the page itself
    got = text_of(spark, [(f"http://k/{n}", f"<body>{half(n, 0)}{half(n, 1)}<p>Text {n}</p></body>") for n in range(40)])
    assert got == [f"Own {n} 0 Own {n} 1 Text {n}" for n in range(40)]


def test_a_wide_node_may_be_content_against_its_name(spark):
    r = random.Random(11)
    long = "words of text number {0} " * 60

    def html(n):
        ours = "".join(f"<section class='x{i}'>Ours {i}</section>" for i in r.sample(range(400), 130))
        return f"<body><p>Site</p><div class='widget post'>{ours}<h1>Head {n}</h1><p>{long.format(n)}</p></div><div class=ad>Buy {n}</div></body>"

    got = text_of(spark, [(f"http://k/{n}", html(n)) for n in range(40)])
    assert got == [f"Head {n} " + " ".join(long.format(n).split()) for n in range(40)]


def test_wide_hosts_count_what_their_pieces_hold(spark):
    r = random.Random(6)
    long = "words of text number {0} " * 20

    def widget(n):
        ours = "".join(f"<div class='x{i}'>Ours {i}</div>" for i in r.sample(range(600), 240))
        return f"<body>{ours}<p>{n}</p><div class='widget post'><h1>Head {n}</h1><p>{long.format(n)}</p></div></body>"

    # most of what varies is in an element that its name hints away
    got = text_of(spark, [(f"http://k/{n}", widget(n)) for n in range(30)])
    assert got == [f"{n} Head {n} " + " ".join(long.format(n).split()) for n in range(30)]


def test_wide_hosts_equal_an_alignment_without_bound(spark, monkeypatch):
    # what all pages hold comes in one order, so there is one alignment; elements that one page alone holds make the union wide
    def html(n):
        own = [f"<p class='own{n}q{i}'>Own {n} {i}</p>" for i in range(4)]
        links = [f"<ul class='x{i}'>" + "".join(f"<li><a href='/{n}{j}'>see {n} {j}</a></li>" for j in range(3)) + "</ul>" for i in range(20)]
        ours = [f"<div class='x{i}'>{'Ours' if i % 3 else n} {i}</div>" for i in range(80)]
        return f"<body>{own[0]}{''.join(links)}bare {own[1]}{''.join(ours)}{own[2]}<main><h1>Tip {n}</h1></main>{own[3]}Made by us</body>"

    pages = [html(n) for n in range(40)]
    got = text_of(spark, [(f"http://k/{n}", h) for n, h in enumerate(pages)])
    capped = json.loads(plain_wrapper(pages))
    monkeypatch.setattr(w, "KIDS", 10**9)
    whole = json.loads(plain_wrapper(pages))
    assert list(w.wide_keys(capped)) and not list(w.wide_keys(whole))
    assert got == [w.main_text(h, w.template_of(whole)) for h in pages] and "Ours" not in got[0] and "Own 0 3" in got[0]


def test_wide_hosts_do_not_depend_on_storage(spark):
    r = random.Random(8)
    rows = [(n, f"http://k{n % 2}/{n}", wide_page(n // 3, random.Random(n).sample(range(600), 150), "bare<ul><li>a<li>b</ul>end")) for n in range(60)] * 2
    found = []
    for n in (1, 4, 32):
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)
        found.append(sorted(map(tuple, w.extract(df).collect())))
    assert len(found[0]) == 120 and found[0] == found[1] == found[2]


def test_text_comes_through_the_wrapper(spark):
    def html(n):
        return f"<body><main><p>By our staff</p><h1>Head {n}</h1><p>Text {n}</p></main></body>"

    got = text_of(spark, [(f"http://z/{n}", html(n)) for n in range(5)])
    assert all(got[n] == f"Head {n} Text {n}" != w.main_text(html(n), {}) for n in range(5))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article>one<article class='comment'>reader</article> two</article>", "one two"),
        ("<article>one <span class='ad'>Buy <span>it</span> now</span> two</article>", "one two"),
        ("<article>one <p hidden>no</p><p style='color:red; display: none'>no</p><p class='hidden-x' title='so hidden here'>two</p></article>", "one two"),
        ("<p>one <b class=ad>no</p><p>two <b>three</b></p>", "one two three"),
    ],
)
def test_asides_and_hidden_elements(html, text):
    assert w.main_text(html, {}) == text


LOST = {
    "layout": "<div class='layout has-sidebar'><article>{}</article></div>",
    "form": "<form action='/x'><article>{}</article></form>",
    "no-comments": "<article class='post no-comments'>{}</article>",
    "related-work": "<article><section class='related-work'>{}</section></article>",
    "social-science": "<article><p class='social-science'>{}</p></article>",
    "sidebar": "<div class='sidebar'><main>{}</main></div>",
    "no article": "<form class='page'><div><p>{}</p></div></form>",
}


@pytest.mark.parametrize("kind", LOST)
@pytest.mark.parametrize("n", [1, 6])
def test_names_never_take_an_article_away(spark, kind, n):
    body = lambda i: f"Page {i} tells of things that only page {i} knows, at length {i * i}."
    pages = [
        (i, f"http://h.{kind.replace(' ', '')}/{i}", f"<nav>Home News</nav>{LOST[kind].format(body(i))}<p class='footer'>{'Varying words outside ' + str(i) if kind != 'no article' else ''}</p><div class='comments'>Nice {i}</div>")
        for i in range(n)
    ]
    got = w.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: body(i) for i in range(n)}


def test_names_of_several_parts():
    gone = ["site-header", "cookie-banner", "comment-list", "ad_slot", "nav", "sidebar-left", "social-share", "ad 300"]
    stays = ["no-comments", "has-sidebar", "related-work", "social-science", "header-less", "readme", "post"]
    says = lambda x: w.says(w.class_names(f'class="{x}"'), w.NOT_CONTENT_CLASSES)
    assert all(map(says, gone)) and not any(map(says, stays))


def test_unclosed_link_ends_with_its_block():
    page = w.read_page("<div><p>Read <a href=x>this</p><p>Then a long text that is no link at all.</p></div>")
    (one,), (two,) = (k.kids for k in page.kids[0].kids)
    assert one[1] == 4 and two[1] == 0
