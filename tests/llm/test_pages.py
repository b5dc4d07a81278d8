import html
import re

from isoreach.llm import extraction, registry, reputation
from tests.compare import connect, difference
from tests.llm.helpers import rows

PAGES = "page_id long, url string, html string, text string"


def pages(spark, given):
    return spark.createDataFrame([(*g, "clash") for g in given], PAGES).repartition(3)


def texts(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def test_article_only(spark):
    body = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header>"
        "<nav><ul><li>Home</ul></nav><div class='cookie-notice'>We use</div>"
        "<article><header><h1>A &amp; B</h1></header><p>One <b>bold</b>,\n  two<br>three<p>Four<!-- no --><script>var t='</p>';</script>"
        "<div class=\"ad\">Buy</div><ul><li>x<li>y</ul></article><section id=comments><p>Nice</p></section>"
        "<form>Mail</form><aside>Side</aside><footer>&copy; Z</footer></body></html>"
    )
    got = extraction.extract(pages(spark, [(1, "http://a.b/", body), (2, None, None), (3, "x", ""), (4, "http://a.b/", body[: body.index("Buy") - 3])]))
    assert texts(got) == {1: "A & B One bold, two three Four x y", 2: "", 3: "", 4: "A & B One bold, two three Four"}
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())


def test_attributes_are_read_one_by_one(spark):
    article = "<article><h1>Title</h1><p>Some text of the article</p></article>"
    whole = "Title Some text of the article"
    attrs = [
        'style="overflow:hidden"', 'data-href="/the-hidden-valley"', 'data-title="hidden gems"', 'data-href="/x?id=comment"',
        'class="no-sidebar post"', 'class="entry social-science"', 'class="has-widget"', 'class="sidebar"', 'id=nav data-x', "title='role=alert'",
    ]
    given = [(i, f"http://h{i}.org/", f"<body><div {a}>{article}</div><p>Outside</p></body>") for i, a in enumerate(attrs)]
    gone = ["hidden", 'a="b" HIDDEN', "aria-hidden='true'", "role=dialog"]
    given += [(100 + i, f"http://g{i}.org/", f"<body><div {a}>Box</div><p>Plain text of the page</p></body>") for i, a in enumerate(gone)]
    gone = ["class='x ad-slot'", "id='site-footer'", "class=cookie-notice", "class='share-buttons'"]
    given += [(200 + i, f"http://k{i}.org/", f"<body><div {a}>Box</div><p>Plain text of the page</p></body>") for i, a in enumerate(gone)]
    given += [(300, "http://c.org/", f"<body>{article}<div id=comments><article>A very long comment, longer than all else here</article></div></body>")]
    given += [(301, "http://d.org/", "<body><div class='widget'>All the text of a page</div><p>Foot</p></body>")]
    given += [(302, "http://e.org/", "<main><div class='social'><p>All the text of an article</p><div class='promo'>Buy</div></div></main>")]
    got = texts(extraction.extract(pages(spark, given)))
    assert [got[i] for i in range(len(attrs))] == [whole] * len(attrs)
    assert {got[k] for k in got if 100 <= k < 300} == {"Plain text of the page"}
    assert [got[k] for k in (300, 301, 302)] == [whole, "All the text of a page Foot", "All the text of an article"]


def test_parts_that_recur_on_a_host_go(spark):
    page = "<body><div class=top>Welcome <i>here</i></div><div><p>Text {0}</p><p>Same line</p></div><div>Until {0}</div></body>"
    given = [(i, f"http://one.org/{i}", page.format(i)) for i in range(4)] + [(9, "http://two.org/", page.format(9))]
    got = texts(extraction.extract(pages(spark, given), min_pages=3))
    assert got[2] == "Text 2 Until 2"  # no article is marked, so recurring paragraphs go too
    assert got[9] == "Welcome here Text 9 Same line Until 9"


def test_article_copies_stay_and_recurring_containers_in_them_go(spark):
    page = "<body><main><p>Copied text that is long enough to matter</p><div>Read on</div></main></body>"
    got = texts(extraction.extract(pages(spark, [(i, "http://one.org/", page) for i in range(5)])))
    assert set(got.values()) == {"Copied text that is long enough to matter"}


def test_copies_keep_their_parts(spark):
    lists = "<h1>Heading</h1><p>A paragraph that holds most of the words of this article</p><ul><li>one<li>two</ul><table><tr><td>cell</table><section>Part</section>"
    whole = "Heading A paragraph that holds most of the words of this article one two cell Part"
    given = [(i, "http://a.org/", f"<body><nav>{i}</nav><p>Seen {i}</p><article>{lists}</article></body>") for i in range(4)]
    given += [(10 + i, "http://b.org/", f"<article>{lists}<p>Changed {i}</p></article>") for i in range(4)]  # near copies
    parts = "".join(f"<div>Part {k} of the text</div>" for k in range(5))
    given += [(20 + i, "http://c.org/", f"<main>{parts}</main>") for i in range(4)]
    given += [(30 + i, "http://d.org/", "<body><div><h1>No</h1><p>mark</p></div></body>") for i in range(4)]
    given += [(40 + i, None, f"<body><p>Same</p><p>Own {i}</p></body>") for i in range(4)]
    got = texts(extraction.extract(pages(spark, given)))
    for i in range(4):
        assert got[i] == whole
        assert got[10 + i] == f"{whole} Changed {i}"
        assert got[20 + i] == " ".join(f"Part {k} of the text" for k in range(5))
        assert got[30 + i] == "No mark"
        assert got[40 + i] == f"Same Own {i}"


def test_parts_of_different_articles_go_by_their_share_of_the_host(spark):
    page = "<article><h1>Title {0}</h1><p>Paragraph {0} is longer than all other parts</p><ul><li>More<li>stories</ul>{1}</article>"
    given = [(i, "http://a.org/", page.format(i, "<table><tr><td>rare</table>" if i < 4 else "")) for i in range(300)]
    got = texts(extraction.extract(pages(spark, given)))
    assert got[9] == "Title 9 Paragraph 9 is longer than all other parts"
    assert got[1] == "Title 1 Paragraph 1 is longer than all other parts rare"  # four of 300 pages


def test_broken_markup(spark):
    odd = ["<", "<p", "a < b", "<p>a</div></p>b", "<b>a<p>b</b>c", "<script>x", "<!-- x", "&lt;p&gt; &#65;&#x42; &nbsp;z", "<p a='<>'>q", "x" * 200_000]
    got = texts(extraction.extract(pages(spark, list((i, "u", h) for i, h in enumerate(odd)))))
    assert [got[i] for i in range(9)] == ["<", "", "a < b", "a b", "a bc", "", "", "<p> AB z", "q"]
    assert got[9] == odd[9]


def test_extraction_query(spark, sf_dir):
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = texts(registry.op1_extraction(spark, sf_dir))
    assert set(got) == set(source)
    for k, h in source.items():
        m = re.search(r"<article>(.*?)(?:</article>|$)", h, re.S)
        inner = re.sub(r"<[^>]*$", "", m[1] if m else "").replace("<b>", "").replace("</b>", "")
        assert got[k] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def test_empty_tables(spark):
    assert extraction.extract(pages(spark, [])).count() == 0
    assert reputation.judge_urls(pages(spark, [])).count() == 0


def test_hosts_paths_and_rules(spark):
    urls = [
        "http://Www.Example.COM/en/1?x#y", "https://example.com/en/2", "http://example.com/EN/", "http://a.net/es/3", "ftp://b.org",
        "http://badexample.com/en/", "//none", None, "", "http://", "http://x.net?/es/", "http://net/fr/a://b", "HTTP://É.net/es/",
    ]
    got = rows(reputation.judge_urls(pages(spark, [(i, u, None) for i, u in enumerate(urls)])), "page_id", "host", "path", "rule")
    assert sorted(got) == [
        (0, "www.example.com", "/en/1", "www.example.com/en/"), (1, "example.com", "/en/2", "example.com/en/"),
        (2, "example.com", "/EN/", "com/"), (3, "a.net", "/es/3", "net/es/"), (4, "b.org", "", None),
        (5, "badexample.com", "/en/", "com/"), (6, "", "", None), (7, "", "", None), (8, "", "", None), (9, "", "", None),
        (10, "x.net", "", None), (11, "net", "/fr/a://b", "net/fr/"), (12, "É.net", "/es/", "net/es/"),
    ]


def test_reputation_shrinks_towards_the_levels_above(spark):
    given = [(i, f"http://bad{i % 3}.net/fr/{i}", None) for i in range(300)]
    given += [(1000 + i, f"http://good{i % 3}.com/fr/{i}", None) for i in range(300)]
    given += [(2000, "http://bad0.net/en/", None), (2001, "http://new.net/en/", None), (2002, "http://new.org/en/", None)]
    got = {r["page_id"]: (r["verdict"], r["reputation"]) for r in reputation.judge_urls(pages(spark, given)).collect()}
    assert got[2000][0] == "block" and got[2000][1] > 0.9
    assert got[2002][0] == "allow" and got[2002][1] < got[2001][1] <= got[2000][1]


def test_reputation_query(spark, sf_dir):
    assert difference(registry.op2_reputation(spark, sf_dir), connect(sf_dir), reputation.judge_sql()) is None


def shrunk(counts, z=2.0):
    """Posterior mean and lower bound of each host from {host: (labelled pages, blocked)}, level by level."""
    def posterior(groups, parents):
        """groups: {name: (n, bad)}; parents: {name: (mean, variance)}."""
        seen = [(n, b, parents[g][0]) for g, (n, b) in groups.items() if n]
        spread = sum(n * (b / n - m) ** 2 for n, b, m in seen) - sum(m * (1 - m) for _, _, m in seen)
        most = sum(m * (1 - m) * (n - 1) for n, _, m in seen)
        share = min(0.99, max(0.001, spread / most)) if most > 0 else 0.5
        strength, out = 1 / share - 1, {}
        for g, (n, b) in groups.items():
            up, unsure = parents[g]
            alpha, beta = strength * up + b, strength * (1 - up) + n - b
            mean = alpha / (alpha + beta)
            out[g] = mean, alpha * beta / ((alpha + beta) ** 2 * (alpha + beta + 1)) + (strength / (n + strength)) ** 2 * unsure
        return out

    def grouped(name):
        out = {}
        for h, (n, b) in counts.items():
            a, c = out.get(name(h), (0, 0))
            out[name(h)] = a + n, c + b
        return out

    suffix, domain = (lambda h: h.split(".")[-1]), (lambda h: ".".join(h.split(".")[-2:]))
    root = (sum(b for _, b in counts.values()) + 0.5) / (sum(n for n, _ in counts.values()) + 1)
    suffixes = posterior(grouped(suffix), {g: (root, 0.0) for g in grouped(suffix)})
    domains = posterior(grouped(domain), {g: suffixes[suffix(g)] for g in grouped(domain)})
    hosts = posterior(counts, {h: domains[domain(h)] for h in counts})
    return {h: (m, m - z * v**0.5) for h, (m, v) in hosts.items()}


def test_reputation_against_a_plain_version(spark, sf_dir):
    """Beta-binomial posteriors computed one by one, on the given pages and on hosts of all kinds."""
    import random

    rng = random.Random(1)
    names = ["a.com", "www.a.com", "b.net", "x.b.net", "y.b.net", "c.org", "", "localhost", "www.example.com", "example.com", "z.fr", "u.v.z.fr"]
    made = [(i, f"https://{rng.choice(names)}/{rng.choice(['en', 'es', 'fr', 'q'])}/{i}", None) for i in range(900)] + [(9000, None, None)]
    for given in (pages(spark, made), registry.table(spark, sf_dir, "pages")):
        got = reputation.judge_urls(given).collect()
        counts, said = {}, dict(reputation.RULES)
        for r in got:
            n, b = counts.get(r["host"], (0, 0))
            counts[r["host"]] = n + (r["rule"] is not None), b + (said.get(r["rule"]) == "block")
        want = shrunk(counts)
        for r in got:
            mean, low = want[r["host"]]
            assert abs(r["reputation"] - mean) < 2e-6
            assert r["verdict"] == (said[r["rule"]] if r["rule"] else "block" if low > 0.5 else "allow")
