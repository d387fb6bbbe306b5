import itertools
import re
from html import unescape

import numpy as np
import pytest

from refspark.llm import htmltext as h


@pytest.fixture(scope="module")
def model():
    return h.fit(h.labelled_examples())


def test_marginals_are_exact():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 9))
        parent = np.array([-1] + [int(rng.integers(0, k)) for k in range(1, n)])
        depth = np.zeros(n, int)
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
        x, m = rng.normal(size=(n, 3)), h.Model(rng.normal(size=3), rng.normal(size=(2, 2)))
        total = np.zeros((n, 2))
        for s in itertools.product((0, 1), repeat=n):
            e = sum((x[k] @ m.weights) * s[k] for k in range(n)) + sum(m.edge[s[parent[k]], s[k]] for k in range(1, n))
            for k in range(n):
                total[k, s[k]] += np.exp(e)
        assert np.allclose(h.marginals(m, x, parent, depth), total[:, 1] / total.sum(1))


def run(model, html):
    nodes = h.parse(html)
    parent, depth = h.shapes([nodes])
    return h.blocks(nodes, h.marginals(model, h.own_features(nodes), parent, depth))


def test_page_with_every_part(model):
    said = "The ferry left at nine and came back at noon, as it had done every day since the bridge fell. "
    page = f"""<html><head><title>T</title><script>x="<p>no</p>"</script></head><body><header><p>{said}HEAD</p></header><nav><ul><li><a href=1>MENU</a></li></ul></nav>
    <div class="cookie-banner"><p>{said}NOTICE</p></div><article><h1>Title &amp; more</h1><p>One\n two&nbsp;<b>three</b><br>four. {said}<p>Five &lt;six&gt; {said}<div class=ad><p>{said}ADVERT</p></div>
    <ul><li>{said}A</li><li>{said}B</ul><form><p>{said}FORM</p></form></article><div class="comments"><p>{said}COMMENT</p></div><aside><p>{said}SIDE</p></aside><footer><p>{said}FOOT</p></footer></body></html>"""
    got = run(model, page)
    want = ["Title & more", f"One two three four. {said}".strip(), f"Five <six> {said}".strip(), f"{said}A", f"{said}B"]
    assert got.split("\n\n") == want


@pytest.mark.parametrize("html", ["", "<", "plain words only", "<p", "</p></div>", "<!-- open", "<p title='x", "<script>never closed", "<table><td><li>" * 50, "<a>" * 2000])
def test_broken_markup(model, html):
    run(model, html)


def test_all_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in h.html_digest(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        parts = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>|<br>", "", article))
        want = [" ".join(unescape(x).split()) for x in parts]
        assert got[r.page_id].text == "\n\n".join(x for x in want if x), r.page_id
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_nulls_and_clashes(spark):
    pages = spark.createDataFrame([(1, "u", None, 3), (2, None, "", 4)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, h.html_digest(pages).collect())) == [(1, "u", "", 0), (2, None, "", 0)]
    assert h.html_digest(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "html",
    [
        "<div><svg viewBox='0 0 1 1'/><p>SAID</p></div>",
        "<div><svg/><p>SAID</p><svg><text>no</text></svg></div>",
        "<div><math/>SAID</div>",
        "<div><svg><p>SAID</p><svg><text>no</text></svg></div>",
        "<div><object data=x><p>SAID</p></div>",
        "<div><canvas id=c><p>SAID</p></div>",
        "<div><iframe src=x><p>SAID</p></div>",
        "<div><svg><!-- </svg> --><text>no</text><svg><text>no</text></svg><text>no</text></svg><p>SAID</p></div>",
        "<div><object><object><p>no</p></object><p>no</p></object><p>SAID</p></div>",
        "<html><head><title>no</title><meta name=a><script>no</script><body><p>SAID</p></body></html>",
        "<html><head><title>no</title><p>SAID</p></html>",
        "<html><head><title>no</title>SAID</html>",
        "<html><head><style>no</style><a href=x>SAID</a></html>",
        "<html><head><title>no</title><template><p>no</p></template></head><body>SAID</body></html>",
    ],
)
def test_hidden_elements_take_no_other_text(html):
    assert "".join(t for node in h.parse(html) for _, t in node.parts).strip() == "SAID"


def test_formulas_code_plain_words_and_repeated_rows(spark):
    said = "The sum of the first numbers grows as the square of how many there are, as anyone can see who draws them as rows of stones."
    pages = [
        ("a", f"<article><h1>Sums</h1><p>{said} Let <math><mi>x</mi></math> be one.</p><xmp>a < b &amp; <i>c</i></xmp><p>{said}</p></article>"),
        ("b", said),
        ("b", said),
        ("c", f"<article><h1>Sums</h1><p>{said}</p><noscript><p>{said}</p></noscript></article>"),
    ]
    frame = spark.createDataFrame(pages, "url string, html string").selectExpr("1L page_id", "*", "2 as text", "3 as n_chars")
    got = sorted((r.url, r.text, r.n_chars) for r in h.html_digest(frame).collect())
    want = ["Sums\n\n" + said + " Let x be one.\n\na < b &amp; <i>c</i>\n\n" + said, said, said, f"Sums\n\n{said}\n\n{said}"]
    assert got == sorted((u, t, len(t)) for (u, _), t in zip(pages, want, strict=True))
    assert h.html_digest(frame.limit(0)).count() == 0


def test_time_grows_with_the_length_of_a_page():
    import time

    def seconds(html):
        start = time.process_time()
        nodes = h.parse(html)
        h.own_features(nodes)
        parent, depth = h.shapes([nodes])
        h.marginals(h.Model(np.zeros(len(h.FEATURES)), np.zeros((2, 2))), np.zeros((len(nodes), len(h.FEATURES))), parent, depth)
        return time.process_time() - start

    for unit in ("<a>x", "<b><div>", "<p><a>x</b>", "<div>x", "<li><b>x", "<svg>x"):
        seconds(unit * 1000)
        assert seconds(unit * 40_000) < 40 * max(0.05, seconds(unit * 4000)), unit
