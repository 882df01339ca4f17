"""Main text of long, broken and headed pages."""

import random
import time

import pytest

from folioscan.llm.html_text import main_text

LONG = {
    "quotes that never pair": '<script "' * 200_000,
    "quotes before a bracket": '<script "' * 200_000 + ">",
    "nested blocks, foreign end tags": "<div>" * 200_000 + "</b>" * 200_000,
    "quoted tags": '<b "' * 400_000,
    "open comments": "<!--" * 500_000,
    "unclosed paragraphs": "<p>word " * 200_000,
    "one name": "<" + "a" * 2_000_000,
    "paragraphs below figures": "<p><div>" + "<figure>" * 100_000 + "<p></p>" * 100_000,
    "end tags of scripts": "</script " * 200_000,
    "brackets": "<" * 2_000_000,
    "attributes": "<p " + 'a="' * 600_000 + ">",
}


@pytest.mark.parametrize("page", LONG.values(), ids=LONG.keys())
def test_time_follows_the_length(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 10


def test_headings_move_the_start_up_only():
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice(["some", "words", "of", "text"]) for _ in range(n))
    for k in range(200):
        blocks = [(rng.choice(["p", "p", "h2"]), words(rng.randint(20, 40))) for _ in range(rng.randint(1, 6))]
        blocks = [(tag, t[:20] if tag == "h2" else t) for tag, t in blocks]
        title = [("h1", "The title")] if k % 2 else []
        if all(tag == "h2" for tag, _ in blocks):
            continue
        page = "<body>" + "".join(f"<{tag}>{t}</{tag}>" for tag, t in title + [("p", words(30)), *blocks]) + "</body>"
        expected = [t for _, t in title] + [t for t in main_text(page).split("\n") if t != "The title"]
        assert main_text(page).split("\n") == expected and main_text(page).count("\n") == len(title) + len(blocks)


def test_formulas_stay_and_scripts_go():
    page = "<article><p>Energy <math><mi>E</mi></math> is for all.</p><script src='a.js'/>var x = 1;</script><p>End.</p>{}</article>"
    for more in ("", "<svg viewBox='0'/>", "<svg><text>no</text></svg>", "<!-- <p>no</p> -->", "<?no?>", "<STYLE>p {}</Style >"):
        assert main_text(page.format(more)) == "Energy E is for all.\nEnd."
    assert main_text(page.format("<script src='b.js'/><p>More.</p>")) == "Energy E is for all.\nEnd.\nMore."  # no end tag at all
    assert main_text(page.format("<script>never closed <p>no</p>")) == "Energy E is for all.\nEnd."
