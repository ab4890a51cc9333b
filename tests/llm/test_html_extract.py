import re
import time

import numpy as np
import pytest

from cairnwork.llm import html_extract as hx


def test_gradient_matches_differences():
    r = np.random.default_rng(0)
    scores, step, labels = r.normal(size=(6, 2)), r.normal(size=(2, 2)), np.array([0, 1, 1, 0, 1, 1])
    _, by_state, by_step = hx.gradient(scores, step, labels)
    e = 1e-6
    for x, g in ((scores, by_state), (step, by_step)):
        for at in np.ndindex(x.shape):
            x[at] += e
            up = hx.gradient(scores, step, labels)[0]
            x[at] -= 2 * e
            down = hx.gradient(scores, step, labels)[0]
            x[at] += e
            assert abs((up - down) / (2 * e) - g[at]) < 1e-5


def test_viterbi_is_the_best_of_all_paths():
    r = np.random.default_rng(1)
    for _ in range(50):
        scores, step = r.normal(size=(5, 2)), r.normal(size=(2, 2))
        paths = [[k >> i & 1 for i in range(5)] for k in range(32)]
        value = lambda p: sum(scores[i, k] for i, k in enumerate(p)) + sum(step[a, b] for a, b in zip(p, p[1:]))
        assert hx.Crf({}, np.zeros((0, 2)), step).viterbi(scores) == max(paths, key=value)


def test_leaf_blocks():
    page = (
        "<head><title>t</title></head><body><p>a <b>b\n c</b><br>d &amp;&eacute;&nbsp; <p>e<script>var x='<p>no</p>';</script>f"
        "<!-- <p>no</p> --><ul><li>g<li><a href='x>y'>h</a></ul>i<style>p{}</style><div>j</div"
    )
    assert [b.text for b in hx.leaf_blocks(page)] == ["a b c d &é", "e", "f", "g", "h", "i", "j"]
    assert hx.leaf_blocks(page)[4].linked == 1


def test_held_out_pages():
    model, wrong, total = hx.default_model(), 0, 0
    for seed in range(200):
        rows, labels, page, text = hx.labelled(seed)
        wrong += "\n".join(model.main_blocks(page)) != text
    assert wrong <= 6


def test_table_against_its_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in hx.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        assert got[r.page_id].text == "\n".join(b.text for b in hx.leaf_blocks(body)) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_cases(spark):
    main = "<article><p>One two three, four.</p></article>"
    rows = [(1, None), (2, ""), (3, "<"), (4, "plain"), (5, main), (5, main), (None, main), (6, "<article><p>" + "long text, " * 50_000)]
    pages = spark.createDataFrame([(i, "u", h, 9, "x") for i, h in rows], "page_id long, url string, html string, n_chars int, text string")
    got = hx.extract(pages).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by[1] == by[2] == by[3] == "" and by[5] == by[None] == "One two three, four."
    assert by[6] == ("long text, " * 50_000).strip()
    assert hx.extract(pages.limit(0)).count() == 0


def test_broken_tags():
    blocks = lambda page: [b.text for b in hx.leaf_blocks(page)]
    assert blocks('<p class="x>One two</p><p class="y">Three <b title="a > b">four</b></p>') == ["One two", "Three four"]
    assert blocks("<p data-x='<b>no</b>'>Hi</p><script>x='</script><p>end</p>") == ["Hi", "end"]
    assert blocks('<div class="x>never closed') == ["never closed"]
    assert blocks("<p>a < b & 3<4</p><!-- <p>no</p> --><p>c") == ["a < b & 3<4", "c"]


@pytest.mark.parametrize("bad", ['<a "', "<div>x", '<p class="x>y ', "</p>x", "<p \"'>", "<div class=\"a'>x</i>", '<a href="', "<!--", "<title>x", "<", "&", "<script>"])
def test_long_broken_pages_take_linear_time(bad):
    began = time.time()
    hx.default_model().main_blocks(bad * (1_000_000 // len(bad)))
    assert time.time() - began < 20
