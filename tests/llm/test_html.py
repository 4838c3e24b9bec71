"""Main text against known truth, broken markup and hostile pages."""

import random
import time

import pytest

from meterlark.llm import html_extract as h


@pytest.fixture(scope="module")
def model():
    return h.train([])


def _truth(page: str) -> list[str]:
    """The words of the pieces that the generator marked."""
    words, stack = [], [h.parse(page)]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            words += h.entities.unescape(item.replace("\x01", "")).split() if item.lstrip().startswith("\x01") else []
        elif item.tag not in h.HIDDEN:
            stack.extend(reversed(item.items))
    return words


def test_known_truth(model):
    rng = random.Random(4321)
    pages = [h._made_page(rng) for _ in range(200)]
    found = h.extract([p.replace("\x01", "") for p in pages], model)
    hit = wrong = missed = 0
    for page, text in zip(pages, found, strict=True):
        a, b = _truth(page), text.split()
        common = sum(min(a.count(w), b.count(w)) for w in set(a) & set(b))
        hit, wrong, missed = hit + common, wrong + len(b) - common, missed + len(a) - common
    assert 2 * hit / (2 * hit + wrong + missed) > 0.99


CASES = {
    "<article><p title=don't>text with an apostrophe.</p></article>": "text with an apostrophe.",
    "<article><p class=\"a>text one</p><p class=\"b\">text two</p></article>": "text one\ntext two",
    '<article><p data-x="a > b" title=\'<b>\'>kept text</p></article>': "kept text",
    "<article><h1>Head</h1><p>Some words, and more of them.</p><pre>a\n b</pre><p>one<br>two</p></article>": "Head\nSome words, and more of them.\na b\none two",
    "<article><p>5 < 6 &amp; 7 &gt; 6 &#8364; &eacute;</p><script>var a = '</p>'</script><style>p{}</style></article>": "5 < 6 & 7 > 6 € é",
    "<body>Text right in the body,<br>and a second line.</body>": "Text right in the body, and a second line.",
    "<body><h1>A Title</h1><p>The first paragraph of the story, with some words in it.</p><p>And a second one, which also has words.</p></body>": "A Title\nThe first paragraph of the story, with some words in it.\nAnd a second one, which also has words.",
    "<p>unclosed <b>bold": "unclosed bold",
    "<div><p>one sentence</p></div>": "one sentence",
    "<header>Site</header>just this<footer>&copy; us</footer>": "just this",
    "<nav><a href=/>Home</a> <a href=/b>More</a></nav><article><p>The story, at last.</p></article><footer>&copy; us</footer>": "The story, at last.",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(model, page):
    assert h.extract([page], model) == [CASES[page]]


@pytest.mark.parametrize("piece", ["<a b=\"x'", "<!", "</a", "<a ", "<a b='>", "<a b=\"><a b='>", "<!--", "<a =", "<p/", "&", "<script>", "</b>"])
def test_broken_pages_take_linear_time(model, piece):
    start = time.time()
    h.extract([piece * (1_000_000 // len(piece))], model)
    assert time.time() - start < 6


@pytest.mark.parametrize("piece", ["<b><div>", "<i><div></i>", "<p><b>", "<li>", "<td>", "<div></b>"])
def test_deep_pages_take_linear_time(model, piece):
    def seconds(size):
        start = time.time()
        h.extract([piece * (size // len(piece))], model)
        return time.time() - start

    assert seconds(400_000) < 12 * max(seconds(100_000), 0.05)


def _other_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page made another way than those of training: English sentences, tables of layout, bare bodies, odd names; and its article's words."""
    subject, verb, thing = "The ship|A teacher|My neighbour|This town|Every engine".split("|"), "carries|has seen|will repair|remembers|paints".split("|"), "the old harbour|three letters|a wooden bridge|its own winter|the market square".split("|")

    def sentence() -> str:
        return f"{rng.choice(subject)} {rng.choice(verb)} {rng.choice(thing)}, and {rng.choice(thing)} stays {rng.choice(['quiet', 'open', 'as it was'])}."

    def paragraph(tag="p") -> tuple[str, list[str]]:
        text = " ".join(sentence() for _ in range(rng.randrange(2, 7)))
        return f"<{tag}>{text}</{tag}>", text.split()

    title = f"{rng.choice(subject)} {rng.choice(verb)}"
    parts = [(f"<h1>{title}</h1>", title.split()), *(paragraph(rng.choice(["p", "p", "p", "blockquote"])) for _ in range(rng.randrange(2, 9)))]
    inner, words = "".join(a for a, _ in parts), [w for _, ws in parts for w in ws]
    menu = "<ul>" + "".join(f'<li><a href="#{i}">{rng.choice(["Start", "News", "About", "Contact", "Shop"])}</a></li>' for i in range(rng.randrange(3, 7))) + "</ul>"
    kind = rng.randrange(4)
    if kind == 0:
        page = f"<html><body>{inner}</body></html>"
    elif kind == 1:
        page = f'<body><div class="topnav">{menu}</div><div class="col-main">{inner}</div><div class="site-footer">Imprint | Terms</div></body>'
    elif kind == 2:
        page = f"<body><nav>{menu}</nav><main>{inner}</main><aside><h3>Most read</h3>{menu}</aside><footer>All rights reserved</footer></body>"
    else:
        page = f'<body><header><b>The Daily Page</b>{menu}</header><article>{inner}</article><section id="comments"><h2>Comments</h2><div class="comment"><p>{sentence()}</p></div></section></body>'
    return page, words


def test_pages_of_another_generator(model):
    rng = random.Random(77)
    made = [_other_page(rng) for _ in range(200)]
    hit = wrong = missed = 0
    for (_, a), text in zip(made, h.extract([p for p, _ in made], model), strict=True):
        b = text.split()
        common = sum(min(a.count(w), b.count(w)) for w in set(a) & set(b))
        hit, wrong, missed = hit + common, wrong + len(b) - common, missed + len(a) - common
    assert 2 * hit / (2 * hit + wrong + missed) > 0.97, (hit, wrong, missed)


def test_edge_rows(spark):
    pages = [(1, "u", None), (1, "u", None), (None, None, "<p>a page without an id"), (2, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (3, "u", "<article>" + "<p>Word and word, again.</p>" * 40_000 + "</article>")]
    frame = spark.createDataFrame([(*p, "t", 5, "r") for p in pages], "page_id long, url string, html string, text string, n_chars int, label string")
    found = h.extract_main_text(frame).collect()
    assert sorted(str(r["page_id"]) for r in found) == sorted(str(p[0]) for p in pages) and all(r["n_chars"] == len(r["text"]) for r in found)
    by = {r["page_id"]: r["text"] for r in found}
    assert by[1] == "" and by[None] == "a page without an id" and by[2] == "deep" and by[3].count("\n") == 39_999
    assert h.extract_main_text(frame.limit(0)).collect() == []
