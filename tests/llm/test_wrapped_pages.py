"""Articles inside forms and wrappers whose class, id or role sounds like boilerplate."""

import random

import pytest

from runlens.llm import extract

BODY = "<h1>Title here</h1><p>the whole story of the page in a few words</p>"
STORY = "Title here\nthe whole story of the page in a few words"
MENU, NOTE = "<nav><a href='/'>menu one two</a></nav>", "<div class='comments'>first nice</div>"


@pytest.mark.parametrize("start, end", [("<form id=aspnetForm>", "</form>"), ("<div class='content has-sidebar'>", "</div>"), ("<div class='no-ads'>", "</div>"), ("<div class='post share-enabled'>", "</div>"), ("<div id='search-page'>", "</div>"), ("<div class='search'>", "</div>")])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_wrapped_article(start, end, tag):
    page = f"<html><body>{start}{MENU}<{tag}>{BODY}{NOTE}</{tag}>{end}<footer>foot</footer></body></html>"
    assert extract.main_text(page, extract.Weights({})) == STORY


def test_comments_stay_out_though_they_are_articles():
    page = f"<body><article>{BODY}</article><div class='comments'><article>one two</article><article>three four five</article></div></body>"
    assert extract.main_text(page, extract.Weights({})) == STORY


@pytest.mark.parametrize("seed", range(20))
def test_best_run_against_brute_force(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-3, -2, -0.5, 0, 1, 2]) for _ in range(rng.randrange(14))]
    sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
    got, most = extract.best_run(scores), max([0, *sums.values()])
    assert (sum(scores[slice(*got)]) if most > 0 else got == (0, 0) and 0) == most


def test_the_scan_decides_what_no_mark_tells():
    links = "<table>" + "<tr><td><i>one</i></td><td><b>two</b></td></tr>" * 30 + "</table>"
    counts = {k: (5, 95) for k in ("table", "tr", "td", "i", "b")} | {"p": (90, 10), "h1": (50, 50)}
    weights = extract.Weights(counts)
    page = f"<body>{links}<div>{BODY}</div>{links}</body>"
    _, elements = extract.parse(page, weights)
    assert not any(e.marked for e in elements)  # so without the scan all of the page would stay
    assert extract.main_text(page, weights) == STORY


def test_learned_kinds_override_the_list_and_are_marked_without_it():
    body = f"<div><p>{'good words here ' * 9}</p><div class='teaser'>buy it now</div><div class='social'>{'what people say of it ' * 4}</div></div>"
    assert "buy it now" in extract.main_text(body, extract.Weights({})) and "people say" not in extract.main_text(body, extract.Weights({}))
    learned = extract.Weights({"div.teaser": (0, 80), "div.social": (80, 0), "p": (90, 3)})
    assert "buy it now" not in extract.main_text(body, learned) and "people say" in extract.main_text(body, learned)


def learned_pages(n):
    """Pages like the given table's: title, menu, advert, article, footer; the counts are learned from all of them."""
    rng = random.Random(5)
    words = lambda least, most: " ".join(rng.choice(["ab", "cd", "efg", "hi&amp;"]) for _ in range(rng.randrange(least, most)))
    out, counts = [], {}
    for _ in range(n):
        title, paragraphs = words(3, 9), [words(1, 60) for _ in range(rng.randrange(1, 9))]
        menu = "".join(f"<li><a href='/x'>{words(1, 3)}</a></li>" for _ in range(6))
        article = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
        page = f"<html><head><title>{title}</title></head><body><nav><ul>{menu}</ul></nav><div class='ad'>{words(4, 40)}</div><article>{article}</article><footer>{words(4, 40)}</footer></body></html>"
        out.append((page, "\n".join([title, *paragraphs]).replace("&amp;", "&")))
        for (kind, inside), m in extract.counted(page).items():
            a, b = counts.get(kind, (0, 0))
            counts[kind] = (a + m, b) if inside else (a, b + m)
    return out, counts


def test_the_scan_alone_finds_the_borders(monkeypatch):
    pages, counts = learned_pages(60)
    monkeypatch.setattr(extract, "listed", lambda kind: False)  # weights as learned, no prior
    weights, settle = extract.Weights(counts), extract.settle
    assert all(extract.main_text(page, weights) == text for page, text in pages)

    def unmarked(elements):
        settle(elements)
        for e in elements:
            e.off = False

    with monkeypatch.context() as patch:  # nothing is left out by a mark: the run is the article
        patch.setattr(extract, "settle", unmarked)
        assert all(extract.main_text(page, weights) == text for page, text in pages)
    with monkeypatch.context() as patch:  # without the scan no page comes out right
        patch.setattr(extract, "best_run", lambda scores: (0, len(scores)))
        assert not any(extract.main_text(page, weights) == text for page, text in pages)


def test_marks_cut_only_between_words_of_the_run():
    _, counts = learned_pages(60)
    weights = extract.Weights(counts)
    page = f"<body><div class='ad'>buy one</div><article><p>first part</p><div class='ad'>{'buy two now ' * 40}</div><p>second</p><div class='ad'>buy three</div></article><footer>f</footer></body>"
    assert extract.main_text(page, weights) == "first part\nsecond"


def test_counts_of_a_labelled_page():
    page = "<html><body><nav class=top><a>m</a></nav><div id=w><article><p>x</p><div class=ad><p>y</p></div></article></div></body></html>"
    got = extract.counted(page)
    assert got == {("nav.top", False): 1, ("a", False): 1, ("article", True): 1, ("p", True): 1}


def test_rows(spark):
    long = "word " * 300_000
    rows = [(1, "u", f"<nav>menu</nav><article><p>{long}</p></article>"), (2, None, ""), (2, None, ""), (None, "u", "<p>some text</p>"), (3, "u", "<<<"), (4, "u", "<div class='ad'>")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, kind int, text string")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in extract.extract_text(df).collect()))
    assert got == sorted([(1, long.strip(), len(long) - 1), (2, "", 0), (2, "", 0), (0, "some text", 9), (3, "<<<", 3), (4, "", 0)])
    assert extract.extract_text(df.limit(0)).count() == 0


def test_weights_decide_without_the_list(spark, monkeypatch):
    page = lambda i: f"<html><body><nav><ul><li>menu {i}</li></ul></nav><div class='ad'>buy {i} now</div><article><h1>title {i}</h1><p>the story of number {i}</p></article><footer>foot</footer></body></html>"
    pages = spark.createDataFrame([(i, "u", page(i)) for i in range(40)], "page_id long, url string, html string")
    counts = extract.fit(pages)
    assert counts["div.ad"] == (0, 40) and counts["p"] == (40, 0)
    monkeypatch.setattr(extract, "listed", lambda kind: False)
    assert extract.main_text(page(99), extract.Weights(counts)) == "title 99\nthe story of number 99"
