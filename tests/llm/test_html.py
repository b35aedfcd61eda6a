"""HTML extraction on generated pages whose text is known, on deep pages and edge cases."""

import html
import random
import time

from quantloom.llm import html_text


def words(r, n):
    return " ".join("".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(n))


def sentence(r):
    return words(r, r.randint(12, 30)).capitalize() + r.choice([".", "!", "?"])


def page(seed, named):
    """Html and its main text; without names only ratios can tell content."""
    r = random.Random(seed)
    title, paragraphs = words(r, 6), [" ".join(sentence(r) + r.choice(["", " & so <on>"]) for _ in range(r.randint(2, 5))) for _ in range(r.randint(3, 9))]
    menu = "".join(f"<li><a href='/{i}'>{words(r, 1)}</a></li>" for i in range(r.randint(4, 12)))
    body = f"<h1>{title}</h1>" + "".join(f"<p>{html.escape(p)}</p>\n" for p in paragraphs)
    note = words(r, 5)
    if named:
        return f"<nav><ul>{menu}</ul></nav><div class='cookie-notice'>{note}</div><div><article>{body}</article></div><div id='comments'><p>{words(r, 9)}.</p></div><footer>{note}</footer>", " ".join([title, *paragraphs])
    return f"<div class='k1'><ul>{menu}</ul></div><div class='k2'>{note}</div><div class='k3'>{body}</div><div class='k4'><ul>{menu}</ul></div>", " ".join([title, *paragraphs])


def test_generated_pages():
    for named in (True, False):
        wrong = [seed for seed in range(150) if html_text.main_text("<html><body>" + page(seed, named)[0]) != page(seed, named)[1]]
        assert not wrong


def test_the_ratio_decides():
    """Where no element holds the article, only the threshold keeps notices out."""
    for seed in range(50):
        flat, text = page(seed, False)
        flat = flat.replace("<div class='k3'>", "").replace("</p>\n</div>", "</p>\n")
        assert html_text.main_text(flat) == text
        assert html_text.main_text(flat, least_share=0.0) != text


def test_deep_and_broken_markup_takes_linear_time():
    took = {}
    for n in (10_000, 40_000):
        began = time.perf_counter()
        assert html_text.main_text("<div>" * n + "x" + "</div>" * n) == "x"
        assert html_text.main_text("<div><p>some text here, and more" * n)
        assert html_text.main_text("<ul><li>" + "<div>" * n + "</li></p>" * n + "text") is not None
        took[n] = time.perf_counter() - began
    assert took[40_000] < 12 * took[10_000]


def test_rows(spark):
    deep = "<html><body>" + page(1, True)[0] * 300
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<p>Hello, world. This is text."), (3, "u", "<p>Hello, world. This is text."), (None, None, "<nav>menu</nav>"), (5, "u", deep)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(html_text.extract(df).collect(), key=str)
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == by_id[2] == by_id[None] == "" and by_id[3] == "Hello, world. This is text." and len(by_id[5]) > 100_000
    assert html_text.extract(df.where("false")).count() == 0
