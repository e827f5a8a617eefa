from embedlens.llm import site_tree

PAGES = "page_id long, url string, html string"


def test_blocks_and_noise():
    page = """<html><body class="x sidebar-left"><header><h1>Site</h1></header><nav>m</nav><div class="cookie-notice">we use</div>
    <article><header><h1>T  &eacute;</h1></header><p>a<b>b</b> c<br>d<p>e <!-- x --> f<div class="share">s</div><ul><li>one<li>two</ul>
    <table><tr><td>x<td>y</table></article><section id=comments><article><p>c1</p></article></section><form><input><p>f</p></form>
    <aside>z</aside><script>if (a<b) "</p>"</script><footer>&copy; x</footer>"""
    assert site_tree.extract(page, {}) == "T é\nab c d\ne f\none\ntwo\nx\ny"
    assert site_tree.extract("<div><p>one</p><p>two &lt;b&gt; 3 < 4</p></div><style>p{}", {}) == "one\ntwo <b> 3 < 4"
    assert site_tree.extract("plain &amp; text", {}) == "plain & text"
    assert site_tree.extract(None, {}) == site_tree.extract("", {}) == site_tree.extract("<!-- <p>x", {}) == ""
    assert site_tree.extract("<form id=aspnet><article><p>a</p></article></form>", {}) == "a"


def test_importance_by_hand():
    """Content on all pages has importance 0, content of one page each 1; one style has presentation 0."""
    nodes = {"": (4, 0.0, 1, None), "/div.a": (4, 0.0, 1, 0.0), "/div.b": (4, 0.0, 1, 1.0)}
    tree = site_tree.composite(nodes)
    assert tree["/div.a"][0] == 0 and abs(tree["/div.b"][0] - site_tree.GAMMA) < 1e-12
    assert abs(tree[""][0] - site_tree.GAMMA * site_tree.GAMMA / 2) < 1e-12


def test_repeated_branches_go_where_the_markup_says_nothing(spark):
    page = '<html><body><div class="u">same words on every page</div><div class="v">text {0} of page {0}</div></body></html>'
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(40)] + [(99, "http://other.example/", page.format(99))]
    got = {r.page_id: r.text for r in site_tree.main_text(spark.createDataFrame(rows, PAGES).repartition(4)).collect()}
    assert all(got[i] == f"text {i} of page {i}" for i in range(40))
    assert got[99] == "same words on every page\ntext 99 of page 99"  # one page bears no witness


def test_importance_decides_where_the_markup_says_nothing(spark):
    """From few pages on, in both directions, and noise beside it takes no content away."""
    same = "".join(f'<div class="{c}">{c} on every page</div>' for c in "abcd")
    plain = '<body><div class="u">same words</div><div class="v">text {0} of page {0}</div></body>'
    beside = '<body><article><p>own {0}</p></article><div class="u">same words</div><div class="v">text {0}</div></body>'
    mixed = f'<body>{same}<div class="v">text {{0}}</div></body>'
    marked = '<body><div class="ad">advert {0}</div><article><p>the same article</p></article></body>'
    rows = [(100 * k + i, f"http://h{k}.example/{i}", page.format(i)) for k, (page, n) in enumerate([(plain, 6), (beside, 10), (mixed, 60), (marked, 60)]) for i in range(n)]
    got = {r.page_id: r.text for r in site_tree.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == f"text {i} of page {i}" for i in range(6))
    assert all(got[100 + i] == f"own {i}\ntext {i}" for i in range(10))
    assert all(got[200 + i] == f"text {i}" for i in range(60))
    assert all(got[300 + i] == "the same article" for i in range(60))


def test_large_trees_meet_pages_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(site_tree, "TREE_BYTES", 0)
    test_repeated_branches_go_where_the_markup_says_nothing(spark)


def test_articles_stay_even_if_all_pages_are_copies(spark):
    rows = [(i, "http://h.example/x", "<body><nav>a</nav><article><p>the text</p></article>") for i in range(50)]
    assert {r.text for r in site_tree.main_text(spark.createDataFrame(rows, PAGES)).collect()} == {"the text"}


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "http://a/", "<p>x</p>"), (2, "no host", ""), (2, "no host", ""), (3, "HTTP://A/", "<p>" + "y " * 200_000)]
    frame = spark.createDataFrame(rows, PAGES).selectExpr("*", "'clash' AS host", "'clash' AS nodes", "'clash' AS text", "1 AS n_chars")
    got = site_tree.main_text(frame).collect()
    assert len(got) == 5 and sorted(r.n_chars for r in got) == [0, 0, 0, 1, 399_999]
    assert site_tree.main_text(frame.where("1 = 0")).count() == 0


def test_broken_pages_are_read_in_one_pass():
    """A megabyte of unclosed quotes, tags and elements takes seconds and memory in proportion; tags after a broken one are read."""
    import time
    import tracemalloc

    assert site_tree.extract("<x y=\"1' z><img src=\"q\"> text <p>one</p><a b='>'>two", {}) == "<x y=\"1' z> text\none\ntwo"
    assert site_tree.extract("<p title=\"a > b\" x='\"'>one<p>2 < 3 \" ' <", {}) == "one\n2 < 3 \" ' <"
    assert site_tree.extract("<svg>a<svg>b</svg>c", {}) == "c"
    pages = ['<a b="c>' * 125_000 + '"', "<a '\"b>" * 140_000, "<div>" * 200_000, '<div class="abcdefgh">' * 50_000, "<a" * 500_000 + '"', "<foo>" * 100_000 + "</bar>" * 80_000, "<svg>" * 200_000]
    for page in pages:
        begin = time.time()
        site_tree.read_page(page)
        assert time.time() - begin < 30, page[:20]
    tracemalloc.start()
    deep = site_tree.read_page("<div class=abcdefgh>" * 20_000 + "<p>x" + "</div>" * 20_000 + "<p>y")
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()
    assert [b[2] for b in deep.blocks] == ["x", "y"] and max(len(p) for p, _ in deep.styles) <= site_tree.LONG_PATH
    assert site_tree.extract("<div class=abcdefgh>" * 300 + "<p>x", {}) == "x"
