"""Two passes on every page: an article or main element is evidence, not the answer."""

import html
import itertools
import random
import re
import time
import tracemalloc

from wayfold.llm import html_extraction

FIRST = "This is the first paragraph of the story and it has many of the words that we want to see in a real text on the web."
SECOND = "And then there was the second long paragraph with all that one would want to read in this place, and a little more of it."
THIRD = "They were not at all sure of what to do with it after that, so we have the rest of the story here for all of you to read."
ADVERT = "Cheap watches, designer handbags, luxury brands: limited offer, huge discounts, free shipping worldwide"


def test_text_outside_a_teaser_article_stays():
    page = f"<body><article><h2>A teaser</h2><p>Read all about it.</p></article><div><p>{FIRST}</p><p>{SECOND}</p></div><div><p>{ADVERT}</p></div></body>"
    text = html_extraction.extract(page)
    assert FIRST in text and SECOND in text and ADVERT not in text


def test_parts_beside_the_first_article_stay():
    page = f"<body><article><h1>Title</h1><p>{FIRST}</p></article><div><h2>Next part</h2><p>{SECOND}</p><p>Short one.</p><p>{THIRD}</p></div></body>"
    assert html_extraction.extract(page) == f"Title {FIRST} Next part {SECOND} Short one. {THIRD}"


def test_density_and_links_decide_inside_an_article():
    linked = ADVERT.replace("limited offer", '<a href="x">limited offer</a>')
    page = f"<body><article><h1>Title</h1><p>{FIRST}</p><div>{linked}</div><p>{SECOND}</p></article></body>"
    assert html_extraction.extract(page) == f"Title {FIRST} {SECOND}"


def test_pass_two_decides_short_blocks_of_an_article():
    links = '<p><a href="x">One link and another link of this site</a></p>'
    page = f"<body><article>{links}<p>Tiny.</p>{links}<p>{FIRST}</p><p>Short one.</p><p>{SECOND}</p></article></body>"
    assert html_extraction.extract(page) == f"{FIRST} Short one. {SECOND}"


def test_an_article_of_short_blocks_stays():
    page = "<body><nav><a href=x>Home</a></nav><article><h1>Oddly</h1><p>Oddly named.</p></article><footer>Imprint</footer></body>"
    assert html_extraction.extract(page) == "Oddly Oddly named."


def test_pages_without_their_article_tags(sf_dir, spark):
    """Most of the text stays, and nothing else, once the pages' article tags are gone."""
    kept = whole = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", r.html)[1]
        truth = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        text = html_extraction.extract(re.sub("</?article>", "", r.html))
        words = set(truth.split())
        assert all(w in words for w in text.split())
        kept += len(text)
        whole += len(truth)
    assert kept > 0.9 * whole


def test_pages_whose_article_elements_are_plain_divs(spark):
    """Without article and main elements density, length, links and neighbours find the same text; both passes decide blocks."""
    import html as references
    import re

    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    inside = lambda h: re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", h)[1]
    truth = [" ".join(references.unescape(re.sub(r"<[^>]*>", " ", inside(h))).split()) for h in pages]
    plain = [re.sub(r"(?i)(</?)(article|main)\b", r"\1div", h) for h in pages]
    found = [html_extraction.extract(h) for h in plain]
    assert sum(f == t for f, t in zip(found, truth, strict=True)) >= 0.98 * len(pages)
    assert all(f for f, t in zip(found, truth, strict=True) if t)
    labels = [b.decided() for h in plain for b in html_extraction.blocks(h)]
    first = sum(x in (html_extraction.GOOD, html_extraction.BAD) for x in labels)
    assert first > 1000 and len(labels) - first > 500


def test_a_short_block_goes_with_the_blocks_of_its_own_element():
    text = "It was the best that they had, and so it is with all of us who have been there, as one would say of them. " * 3
    page = f"<body><div><p>{text}</p><p>Short last one.</p></div><div><a href=x>Home and all the links of it</a></div><div><p>Also</p><a href=x>More links to be found there</a></div></body>"
    assert html_extraction.extract(page) == f"{text.strip()} Short last one."


def test_deep_nesting_and_tags_without_end_take_linear_time_and_memory():
    pages = ["<div>x" * 50_000, "<div>x" * 50_000 + "</div>" * 50_000, "<div>" * 50_000 + "</p>" * 50_000, "</svg>" + "<svg>" * 50_000, "<article>x" * 20_000 + "</article>" * 20_000, "<a" * 100_000, "<" + "a" * 200_000]
    tracemalloc.start()
    start = time.time()
    for page in pages:
        html_extraction.extract(page)
    assert time.time() - start < 60 and tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()


def test_neighbours_share_the_elements_open_between_them():
    """What the least number of open elements tells is what lists of the elements around each block tell."""
    random.seed(4)
    for _ in range(50):
        tags = [random.choice(["<div>", "<ul>", "<td>", "</div>", "</ul>", "</td>"]) for _ in range(60)]
        page = "".join(f"{t}w{i}" for i, t in enumerate(tags)) + "</div></ul></td>"
        stack, paths = [("", -1)], {}
        for i, t in enumerate(tags):
            name = t.strip("</>")
            if t[1] != "/":
                stack.append((name, i))
            elif any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
            paths[f"w{i}"] = list(stack)
        found = html_extraction.blocks(page)
        assert [b.text for b in found] == list(paths)
        for a, b in itertools.pairwise(found):
            common = sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(paths[a.text], paths[b.text], strict=False)))
            assert (b.depth, b.shared) == (len(paths[b.text]), common)
