import random

from vecspark.llm import html_template
from vecspark.llm.html_template import block_tokens, class_checks, extract, frequent_tokens, in_page_order, main_text, page_tokens, parse


def alone(source):
    return extract(parse(source), set(), set())


def test_blocks_and_references():
    assert alone("<body><article><h1>A &amp; B</h1><p>one\n  two<b>three</b><br>four &lt;x&gt; caf&#233;<p>five&nbsp;six</article></body>") == "A & B one twothree four <x> café five six"


def test_boilerplate_by_name():
    page = ("<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href='/x'>Home</a></ul></nav>"
            "<div class='cookie-notice'>We use cookies</div><main><article><header><h1>Title</h1></header><p>Text of it.</p><script>var a='</p>';</script>"
            "<form><p>Your mail</p></form><div class=ad>Buy</div></article><section id='comments'><article class='comment'><p>First!</p></article></section></main>"
            "<aside>See also</aside><footer>&copy; me</footer></body></html>")
    assert alone(page) == "Title Text of it."


def test_broken_markup():
    assert alone("") == "" and alone("plain text") == "plain text" and alone("<") == "<" and alone("a < b") == "a < b"
    assert alone("<article><p>one<p>two<!-- never ends <p>three") == "one two"
    assert alone("<article><p>one</p><div>two</article><footer>f") == "one two"
    assert alone("<article><p>x</p><p title='a>b'>y</p><script>z") == "x y"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert alone(deep) == "deep"


def test_page_without_names():
    page = "<body><div><ul><li><a>Home</a><li><a>News</a></ul></div><div><div><p>" + "Much text here. " * 20 + "</p></div></div></body>"
    assert alone(page) == ("Much text here. " * 20).strip()


def make_pages():
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randrange(50)) for _ in range(n))
    rows, want = [], {}
    for i in range(60):  # a host without telling names: constant box, links, varying text
        paras = [words(rng.randint(5, 60)) for _ in range(rng.randint(1, 6))]
        links = "".join(f"<li><a href='/{k}'>{words(2)}</a></li>" for k in range(rng.randint(2, 6)))
        rows.append((i, f"http://User@One.example.org:80/p{i}", f"<html><body><div class=a><ul>{links}</ul></div><div class=b><div class=c>{''.join(f'<p>{p}</p>' for p in paras)}</div><div class=d>Read our terms now</div></div><div class=e>All rights reserved</div></body></html>"))
        want[i] = " ".join(paras)
    for i in range(60, 100):  # a host with an article
        paras = [words(rng.randint(5, 60)) for _ in range(rng.randint(1, 6))]
        rows.append((i, f"https://two.example.org/{i}?x", f"<body><nav>{words(5)}</nav><div class='ad'>{words(6)}</div><article><h1>{paras[0]}</h1>{''.join(f'<p>{p}' for p in paras[1:])}</article><footer>{words(7)}"))
        want[i] = " ".join(paras)
    rows += [(100, None, "<p>no url</p>"), (101, "not a url", None), (102, "http://three.example.org", ""), (103, "http://four.example.org", "<article>" + "<p>word</p>" * 20_000), (None, "http://two.example.org/z", "<article><p>same</p></article>")]
    rows += [(104, "http://two.example.org/z", "<article><p>same</p></article>")] * 3
    want |= {100: "no url", 101: "", 102: "", 103: " ".join(["word"] * 20_000), None: "same", 104: "same"}
    return rows, want


def test_hosts(spark):
    rows, want = make_pages()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, token int")
    got = main_text(df).collect()
    assert len(got) == len(rows) and sorted(str(r.url) for r in got) == sorted(str(r[1]) for r in rows)
    for r in got:
        assert r.text == want[r.page_id], r
        assert r.n_chars == len(r.text)


def test_no_pages(spark):
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_names_on_what_holds_the_text():
    text = "Much text here. " * 20
    for page in ("<body class='has-sidebar'><article><p>{}</p></article></body>", "<body><article class='post comments-open'><p>{}</p></article></body>",
                 "<body><main id='search-results'><p>{}</p></main></body>", "<html class='no-cookies'><body><div><p>{}</p></div></body></html>",
                 "<body><div class='with-sidebar'><article><p>{}</p></article><div class='sidebar'>Links</div></div></body>", "<body><main><p></p><div class='menu-open'><p>{}</p></div></main></body>"):
        assert alone(page.format(text)) == text.strip(), page
    assert alone(f"<article><p>Short.</p></article><section id='comments'><p>{text}</p></section>") == "Short."
    assert alone(f"<main><p>Short.</p><section id='comments'><article class='comment'><p>{text}</p></article></section></main>") == "Short."
    assert alone(f"<div>{text}</div><div class='related'><article>Another page</article></div>") == text.strip()


def test_copies_of_pages_are_not_constants(spark):
    page = "<body><article><h1>Title {0}</h1><div class=text><p>Text {0} of it, long enough to be most.</p></div><div class=terms>Terms of use</div></article></body>"
    rows = [(i, f"http://copies.example.org/{i}", page.format("same")) for i in range(20)]
    rows += [(1000 + i, f"http://few.example.org/{i}", page.format(f"no{i % 21}")) for i in range(1000)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "Title same Text same of it, long enough to be most. Terms of use" for i in range(20))
    assert all(got[1000 + i] == f"Title no{i % 21} Text no{i % 21} of it, long enough to be most." for i in range(1000))


def test_copies_in_a_layout_of_their_own(spark):
    rows = [(i, f"http://h.example.org/{i}", f"<body><article><h1>T{i}</h1><div class=text><p>Text {i} of this page.</p></div></article></body>") for i in range(100)]
    rows += [(100 + i, f"http://h.example.org/c{i}", "<body><article><h1>Copy</h1><div class=special><p>Text of the copies, as it is on all.</p></div></article></body>") for i in range(20)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[110] == "Copy Text of the copies, as it is on all." and got[7] == "T7 Text 7 of this page."


def host_pages(seed):
    """Pages of one small host: a random tree of boxes without telling names, some of them repeated, optional or swapped."""
    rng = random.Random(seed)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}"
    boxes = [f"b{chr(97 + k)}" for k in range(rng.randint(2, 6))]
    pages = []
    for _ in range(rng.randint(3, 7)):
        order = list(boxes)
        if rng.random() < 0.3:
            rng.shuffle(order)
        out = []
        for box in order:
            if rng.random() < 0.15:
                continue
            inner = "".join(f"<li class=x{box}><p class=y{box}>{word()}</p></li>" * rng.choice([1, 1, 2, 3]) if rng.random() < 0.7 else f"<p class=z{box}>always {box}</p>" for _ in range(rng.randint(1, 2)))
            out.append(f"<div class={box}>{inner}</div>")
        pages.append(f"<body><div class=top>Top of all</div>{''.join(out)}<div class=end>End</div></body>")
    return pages


def brute_classes(pages):
    """Valid classes, as sets of tokens, by the definitions, with the library's tokens alone."""
    parsed = [parse(p) for p in pages]
    every = [{t: v[0] for part in (page_tokens(p), block_tokens(p)) for t, v in part.items()} for p in parsed]
    vectors = {}
    for t in set().union(*every):
        vectors.setdefault(tuple(x.get(t, 0) for x in every), set()).add(t)
    classes = [c for v, c in vectors.items() if len(c) > 1 and sum(map(bool, v)) >= 3]
    valid = set(map(frozenset, classes))
    orders = {}
    for p in parsed:
        tokens = in_page_order(p)
        cycles = {}
        for c in map(frozenset, classes):
            at = [i for i, t in enumerate(tokens) if t in c]
            if not at:
                continue
            groups = [at[k : k + len(c)] for k in range(0, len(at), len(c))]
            if len({tuple(tokens[i] for i in g) for g in groups}) > 1 or {tokens[i] for i in groups[0]} != c:
                valid.discard(c)
                continue
            orders.setdefault(c, set()).add(tuple(tokens[i] for i in groups[0]))
            cycles[c] = groups
        for a in cycles:
            for b in cycles:
                for x in cycles[a]:
                    for y in cycles[b] if a != b else ():
                        gap = lambda inner, outer: len({sum(o < i for o in outer) for i in inner}) == 1
                        if not gap(y, x) and not gap(x, y):
                            valid -= {a, b}
    return {c for c in valid if len(orders[c]) == 1}


def test_valid_classes_equal_brute_force(spark):
    hosts = {f"h{k}.example.org": host_pages(k) for k in range(30)}
    rows = [(f"http://{h}/{i}", p, h) for h, pages in hosts.items() for i, p in enumerate(pages)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string, host string")
    frequent = frequent_tokens(df)
    checks = class_checks(df, frequent)
    found = {}
    for r in frequent.join(checks.where("is_class and ok").selectExpr("host", "id AS vector"), ["host", "vector"]).collect():
        found.setdefault((r.host, r.vector), set()).add(r.token)
    want = {(h, c) for h, pages in hosts.items() for c in brute_classes(pages)}
    assert {(h, frozenset(c)) for (h, _), c in found.items()} == want and len(want) > 30


def test_constant_blocks_without_names(spark):
    rng = random.Random(8)
    words = lambda n: " ".join(f"{rng.choice('abcdef')}{rng.randrange(1000)}" for _ in range(n))
    texts = [[words(30) for _ in range(rng.randint(1, 4))] for _ in range(40)]
    page = lambda paras: "<body><div><div class=q><p>Sign our petition today</p>" + "".join(f"<p>{t}</p>" for t in paras) + "<h4>More below</h4></div></div></body>"
    rows = [(i, f"http://plain.example.org/{i}", page(t)) for i, t in enumerate(texts)] + [(100 + i, f"http://copy.example.org/{i}", page(texts[0])) for i in range(10)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == " ".join(t) for i, t in enumerate(texts))
    one = main_text(spark.createDataFrame(rows[-1:], "page_id long, url string, html string")).first().text
    assert all(got[100 + i] == one == " ".join(["Sign our petition today", *texts[0], "More below"]) for i in range(10))


def test_many_hosts_are_joined_by_salted_keys(spark, monkeypatch):
    monkeypatch.setattr(html_template, "BROADCAST_HOSTS", 1)
    rows, want = make_pages()
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(r.text == want[r.page_id] for r in got)
