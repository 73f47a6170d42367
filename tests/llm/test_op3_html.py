from kgloom.llm import op3_html as op

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="page">
<header><h2>Site</h2></header><nav><ul><li><a href="/a">a</a><li>b</ul></nav><!-- <p>no</p> --><div class="cookie-notice">Accept</div>
<article class="post"><h1>Title &amp; more</h1><p><b>Bold</b> text<br>next line<p>Second&nbsp;para <i>in</i>line</p><form><input><button>Go</button></form>
<div id="comments"><p>nice</p></div><aside>aside</aside></article><div class="sidebar">s</div><footer>&copy; f</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, low int")


def test_article_without_the_rest(spark):
    out = op.main_text(pages(spark, [(1, "http://a.example/x", PAGE.format())])).collect()
    assert [tuple(r) for r in out] == [(1, "http://a.example/x", "Title & more Bold text next line Second para inline", 51)]


def test_broken_and_empty_html(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://h/", "<article>a<b>b<p>c < d &lt;e</article"), (4, "http://h/", "<p>one<div>two</p></span>three"), (5, "http://h/", "<script>x"), (6, "http://h/", "<a href='x>y\">q'>z</a> t"), (1, None, None)]
    out = {r["page_id"]: r["text"] for r in op.main_text(pages(spark, rows)).collect()}
    assert out == {1: "", 2: "", 3: "ab c < d <e", 4: "one two three", 5: "", 6: "z t"}
    assert op.main_text(pages(spark, [])).collect() == []


def test_site_style_tree_removes_what_all_pages_share(spark, prose):
    rows = [(i, "http://s.example/%d" % i, f"<body><div class='slogan'>Buy our things today</div><div class='text'><p>{prose.text(30)}</p></div></body>") for i in range(12)]
    out = op.main_text(pages(spark, rows)).collect()
    assert all(not r["text"].startswith("Buy") and r["n_chars"] == len(r["text"]) > 50 for r in out)
    few = op.main_text(pages(spark, rows[:3])).collect()
    assert all(r["text"].startswith("Buy") for r in few)


def test_copies_of_one_article_stay(spark, prose):
    text = prose.text(40)
    rows = [(i, "http://c.example/", f"<body><div class='text'><p>{text}</p></div></body>") for i in range(20)]
    assert {r["text"] for r in op.main_text(pages(spark, rows)).collect()} == {" ".join(text.split())}


def test_importance_is_entropy(spark):
    rows = [(i, "http://e.example/", f"<body><div class='a'>{'same' if i % 2 else 'other'}</div></body>") for i in range(4)]
    df = pages(spark, rows).withColumn("host", op.host(op.F.col("url")))
    got = {r["path"]: r["importance"] for r in op.importance(df).collect()}
    assert abs(got["/body/div.a"] - 0.5) < 1e-6


def test_very_long_page(spark, prose):
    body = "".join(f"<p>{prose.text(20)}</p>" for _ in range(3000))
    out = op.main_text(pages(spark, [(1, "http://l.example/", f"<article>{body}</article>")])).first()
    assert out["n_chars"] > 200_000


def test_deep_nesting(spark):
    html = "<div>" * 20_000 + "deep" + "<font>" * 20_000 + "<p>end"
    out = op.main_text(pages(spark, [(i, "http://d.example/", html) for i in range(2)])).collect()
    assert {r["text"] for r in out} == {"deep end"}


def test_class_words_never_empty_a_page():
    text = "<h1>Title</h1><p>Some words of the story</p>"
    for page in (
        f"<body class='has-sidebar'>{text}</body>", f"<html class='no-header'><body class='no-header'>{text}</body>", f"<article class='post has-comments'>{text}</article>", f"<main id='with-menu'>{text}</main>",
        f"<div id='page-with-menu'>{text}<div class='menu'>a</div></div>", f"<div class='with-sidebar'><article>{text}</article><div class='sidebar'>{'x ' * 200}</div></div>", f"<p>x</p><div id='page-with-menu'>{text}</div>".replace("<p>x</p>", "<nav>x</nav>"),
    ):
        assert op.extract(page) == "Title Some words of the story", page
    assert op.extract("<div class='with-menu'><p>Some words</p><div class='menu'>a</div></div>") == "Some words"
    assert op.extract("<p>Short story</p><div class='comments'><p>a much longer comment than the story</p></div>") == "Short story"


def test_all_articles_and_main_parts_are_kept(prose):
    long = " ".join(prose.words(100))
    assert op.extract(f"<article>{long}</article><article>Short one</article>") == f"{long} Short one"
    assert op.extract("<main>One</main><p>x</p><div itemprop='articleBody'>Two</div>") == "One Two"
    assert op.extract("<main><h1>Title</h1><article>Text</article></main>") == "Title Text"


def test_short_articles_beside_much_boilerplate(spark, prose):
    same = prose.text(200)
    rows = [(i, "http://b.example/%d" % i, f"<body><div class='slogan'><p>{same}</p></div><div class='text'><p>Story {prose.word()} {i}</p></div></body>") for i in range(12)]
    assert all(r["text"].startswith("Story") for r in op.main_text(pages(spark, rows)).collect())


def site(prose, n, host="big.example.org"):
    """Pages of a site: six menus, three notices and two footers in turn, an article with a pull quote of its own and a byline in it, and what no list names."""
    words = lambda k: " ".join(prose.words(k))
    menus = [f"<ul><li><a href='/'>{words(2)}</a><li><a>{words(1)}</a></ul>" for _ in range(6)]
    lines, ends = [words(5) for _ in range(3)], [words(4) for _ in range(2)]
    rows, want = [], {}
    for i in range(n):
        title, first, quote, last = words(4), words(12), words(6), words(9)
        html = f"<html><body class='has-menu'><nav>{menus[i % 6]}</nav><div class='strip'>{lines[i % 3]}</div><article><h1>{title}</h1><p>{first}</p><aside>{quote}</aside><h2>More</h2><p>{last}</p><div class='comments'><p>{words(8)}</p></div></article><div class='x9'>{ends[i % 2]}</div><footer>{ends[i % 2]}</footer></body></html>"
        rows.append((i, f"https://{host}/{i}", html))
        want[i] = f"{title} {first} {quote} More {last}"
    return rows, want


def test_importance_decides_on_sites_with_enough_pages(spark, prose):
    """Menus that vary little go, a pull quote that is called furniture but is different on every page stays; without the tree both stay, by lists alone both go."""
    rows, want = site(prose, 60)
    df = pages(spark, rows)
    assert {r["page_id"]: r["text"] for r in op.main_text(df, many=50).collect()} == want
    off = {r["page_id"]: r["text"] for r in op.main_text(df, 0, 0, 50, 0).collect()}
    lists = {r["page_id"]: r["text"] for r in op.main_text(df, many=1000).collect()}
    assert all(off[i] != want[i] and want[i].split()[-1] in off[i] for i in want) and all(len(lists[i]) < len(want[i]) < len(off[i]) for i in want)


def test_hosts_of_few_pages_take_the_tree_of_their_domain(spark, prose):
    rows, want = site(prose, 60)
    rows = [(i, f"https://h{i % 10}.example.org/{i}", html) for i, _, html in rows]
    assert {r["page_id"]: r["text"] for r in op.main_text(pages(spark, rows), many=50).collect()} == want


def test_copies_on_a_site_do_not_make_its_articles_unimportant(spark, prose):
    """Seven of ten pages are one article; its pages and the others keep theirs."""
    rows, want = site(prose, 100)
    rows = [(i, u, rows[0][2] if i % 10 < 7 else h) for i, u, h in rows]
    out = {r["page_id"]: r["text"] for r in op.main_text(pages(spark, rows), many=50).collect()}
    assert all(out[i] == want[0 if i % 10 < 7 else i] for i in out)


def test_clashing_names_and_repeated_rows(spark, prose):
    rows, want = site(prose, 12)
    df = pages(spark, rows + rows[:3]).withColumns({c: op.F.lit(1) for c in ("_host", "judged", "paths", "importances", "path", "site")})
    assert len(op.main_text(df).collect()) == 15


CLASSES = "social-contract search-algorithms share-price comment-on-law subscription-model related-work promo-history widget-factory notice alert".split()


def test_class_words_remove_nothing_inside_articles():
    for name in CLASSES:
        for part in ("article", "main"):
            assert op.extract(f"<nav>n</nav><{part}><h1>T</h1><section class='{name}'><p>kept</p></section><div id='{name}'>too</div></{part}>") == "T kept too", name
    assert op.extract("<article>a<div class='comments x'>c</div><div class='ad'>b</div>d</article>") == "a d"
    assert op.extract("<div class='share-price'>out</div><article>a</article>") == "a"


def test_unnamed_boilerplate_inside_main_parts_goes(spark, prose):
    """On a site with enough pages, and on a small host from PAGES pages on; headings that all pages share stay."""
    line = "<div class='q7'><p>Reprinted by kind permission of nobody</p></div>"
    rows = [(i, f"http://m.example.org/{i}", f"<body><nav>x</nav><main><h1>Head</h1><p>{prose.text(20)}</p>{line}<p>end {i} {prose.word()}</p></main></body>") for i in range(60)]
    for many, n in ((50, 60), (1000, 60), (1000, op.PAGES)):
        out = op.main_text(pages(spark, rows[:n]), many=many).collect()
        assert all(r["text"].startswith("Head ") and "Reprinted" not in r["text"] and f"end {r['page_id']} " in r["text"] for r in out)
    assert all("Reprinted" in r["text"] for r in op.main_text(pages(spark, rows[: op.PAGES - 1])).collect())
    assert all("Reprinted" in r["text"] for r in op.main_text(pages(spark, rows), 0, 0, 50, 0).collect())


def entropies_by_hand(rows):
    """A plain reading of the tree's importance: pages of a host, nodes by path, the share of different shapes or contents."""
    import collections

    seen = collections.defaultdict(lambda: (collections.Counter(), collections.Counter()))
    for html in rows:
        merged = {}

        def content(x, merged=merged):
            """Own text of a block with that of its inline elements, shapes by path."""
            own = []
            for p in x.parts:
                if isinstance(p, str):
                    own.append(p)
                elif p.tag not in op.RAW:
                    own += content(p)
            if x.tag in op.COUNTED:
                shape, text = merged.setdefault(x.path, ([], []))
                shape.append(tuple(dict.fromkeys(c.style for c in x.parts if not isinstance(c, str))))
                text.append("|".join(own))
            return own

        content(op.parse(html))
        for path, (shape, text) in merged.items():
            seen[path][0][tuple(shape)] += 1
            seen[path][1]["\n".join(sorted(text))] += 1
    return {p: max(len(c) / sum(c.values()) for c in both) for p, both in seen.items()}


def test_importance_against_brute_force(spark, prose):
    rows, _ = site(prose, 14)
    df = pages(spark, rows + rows[:2]).withColumn("host", op.host(op.F.col("url")))
    got = {r["path"]: r["importance"] for r in op.importance(df.where("host = 'big.example.org'")).where("site = 'big.example.org'").collect()}
    want = entropies_by_hand([h for _, _, h in rows + rows[:2]])
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
