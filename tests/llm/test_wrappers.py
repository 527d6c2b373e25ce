import random

from corpusloom.llm.wrappers import Wrapper, align, extract, infer_wrappers, main_text, page_wrapper, region

SCHEMA = "page_id long, url string, html string, text string, host int"

SOUP = """<html><head><title>T &amp; t</title><style>p>a{{}}</style></head><body>
<div id=top-nav><a href="/">Home</a></div><div class="cookie-notice"><p>We use cookies</p></div>
<div class="post"><h2>{title}</h2><div class='body'>{paragraphs}</div>
<form action=x><input name="q"><p>Subscribe!</p></form></div>
<div class="sidebar"><ul><li>one</li><li>two</li></ul></div>
<section id="comments"><p>First! Great post, thanks a lot for all of this.</p></section>
<script>if (a < b) document.write("<p>no</p>")</script><footer>(c)</footer></body></html>"""


def soup(title, paragraphs):
    return SOUP.format(title=title, paragraphs="".join(f"<p>{p}</p>" for p in paragraphs))


def test_blocks_references_and_white_space():
    page = """<!DOCTYPE html><body><nav>menu</nav><article class=x><h1>A &lt;b&gt;</h1><!-- <p>no</p> -->
    <p>one <b>two</b>&nbsp; three&#33;<br>four<p>unclosed &eacute; <i>x</i>y</p>
    <aside>side</aside><ul><li>a<li>b</ul> tail <script>var t="</p>";</script></article><p>after</p>"""
    assert extract(page, "article.x") == "A <b>\none two three!\nfour\nunclosed é xy\na\nb\ntail"
    assert extract(page, "") == extract(page, "article.x") + "\nafter"
    assert extract(page, "div.unknown") == extract(page, "")
    assert extract("", "article") == "" and extract("just text < 3 & more", "") == "just text < 3 & more"
    assert extract("<article><p>cut off</p><p>end <a hre", "article") == "cut off\nend"
    assert extract('<article><p title="a > b">quoted</p></article>', "article") == "quoted"


def test_repeated_and_optional_groups():
    one = page_wrapper("<body><article><h1>a</h1><p>b</p></article></body>")
    many = page_wrapper("<body><article><h1>a</h1><p>b</p><p>c</p><p>d</p></article></body>")
    assert many.pattern() == "<body><article><h1>#</h1>(<p>#</p>)+</article></body>"
    assert align(one, many).pattern() == many.pattern()
    other = page_wrapper("<body><div class=ad>x</div><article><h1>a</h1><p>b</p></article></body>")
    assert align(one, other).pattern() == "<body>(<div.ad>#</div.ad>)?<article><h1>#</h1><p>#</p></article></body>"
    both = align(align(one, many), other)
    assert Wrapper.load(both.dump()).pattern() == both.pattern()
    assert sum(t.mass for t in both.tokens) == 9


def test_region_without_semantic_elements():
    wrapper = Wrapper()
    rng = random.Random(1)
    for i in range(6):
        page = page_wrapper(soup(f"title {i}", ["word " * rng.randint(30, 60)] * (i + 1)))
        wrapper = align(wrapper, page) if wrapper.tokens else page
    assert region(wrapper) in ("div.post", "div.body")
    assert region(Wrapper()) == "" and region(page_wrapper("plain text")) == ""


def test_pages_of_several_hosts(spark):
    rows = [(i, f"http://a.example/{i}", soup(f"t{i}", [f"text {i} " + "word " * 40, "more &amp; more"])) for i in range(12)]
    rows += [(100 + i, f"https://B.example:8/x?{i}", f"<article><h1>h{i}</h1>" + "<p>p</p>" * i + "</article><footer>f</footer>") for i in range(5)]
    rows += [(200, None, "<p>no url</p>"), (201, "x", None), (202, "", ""), (100, "https://b.example:8/x?0", "<article>again</article>")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA).repartition(4)
    got = main_text(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    texts = {(r.page_id, r.url): r.text for r in got}
    for i in range(12):
        assert texts[(i, f"http://a.example/{i}")].endswith(f"text {i} " + ("word " * 40).strip() + "\nmore & more")
        assert "Subscribe" not in texts[(i, f"http://a.example/{i}")] and "Great post" not in texts[(i, f"http://a.example/{i}")]
    assert texts[(103, "https://B.example:8/x?3")] == "h3\np\np\np"
    assert texts[(200, None)] == "no url" and texts[(201, "x")] == texts[(202, "")] == ""
    assert texts[(100, "https://b.example:8/x?0")] == "again"


def test_supplied_pages_give_back_their_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = {"\n".join(" ".join(x.split()) for x in r.text.split("\n") if x.split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = main_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert rows and all(r.text.split("\n", 1)[1] in docs for r in rows)


def test_wrappers_do_not_depend_on_the_partitioning(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr("split_part(url, '/', 3) AS host", "html")
    masses = lambda df: sorted((r.host, sum(t.mass for t in Wrapper.load(r.wrapper).tokens)) for r in infer_wrappers(df).collect())
    assert masses(pages) == masses(pages.repartition(7))


def test_empty_table(spark):
    assert main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_two_templates_and_ids_of_pages(spark):
    """News pages are fewer than blog pages, and each page has a number in its ids: every page gives its own article."""
    menu = "<ul><li>start</li><li>about us and more words than usual in a menu</li></ul>"
    blog = lambda i: f'<body>{menu}<article id="post-{100 + i}" class="blog entry-{100 + i}"><p>blog {i} {"word " * 40}</p></article><p>end of all pages</p></body>'
    news = lambda i: f'<body>{menu}<article class="news"><p>news {i} {"text " * 40}</p></article><p>end of all pages</p></body>'
    rows = [(i, f"http://two.example/{i}", blog(i) if i % 5 < 3 else news(i), "t", 1) for i in range(30)]
    for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect():
        kind, word = ("blog", "word") if r.page_id % 5 < 3 else ("news", "text")
        assert r.text == f"{kind} {r.page_id} " + " ".join([word] * 40)


def test_many_templates_of_which_none_is_common(spark):
    page = lambda i: f'<body><p>menu</p><article class="{"abcdefg"[i % 7]}"><p>own {i} {"word " * 30}</p></article><p>end</p></body>'
    rows = [(i, f"http://many.example/{i}", page(i), "t", 1) for i in range(28)]
    for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.text == f"own {r.page_id} " + " ".join(["word"] * 30)
