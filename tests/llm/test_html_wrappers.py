"""Elements that wrap an article are not cut for their name."""

import pytest

from corvane.llm.html_extract import Weights, main_text

P = "Plain words of an article that go on for a while, one after another, and then some more. "
MENU = "<nav><a href=a>Home</a><a href=b>News</a></nav>"


@pytest.mark.parametrize("label", [True, False])
@pytest.mark.parametrize("wrap", ["form", "object", "dialog", "menu", "noscript", "nav", "aside", "footer"])
def test_a_page_inside_one_element(wrap, label):
    own = f"<h1>Title</h1><p>{P}</p><p>{P * 2}</p>"
    own = f"<article>{own}</article>" if label else f"<div>{own}</div>"
    got = main_text(f"<html><head><title>T</title></head><body><{wrap} id=f>{MENU}{own}<form><input><button>Send</button></form></{wrap}></body></html>", Weights())
    assert got == f"Title\n{P.strip()}\n{(P * 2).strip()}"


def test_small_forms_still_go():
    got = main_text(f"<body>{MENU}<div><h1>Title</h1><p>{P}</p><form>Your name <input> and more <button>Send</button></form><p>{P}</p></div><footer>All rights</footer></body>", Weights())
    assert got == f"Title\n{P.strip()}\n{P.strip()}"


@pytest.mark.parametrize("gap", ["<svg><text>x</text></svg>", "<button>Copy</button>", "<select><option>a</option></select>", "<canvas>no</canvas>"])
def test_a_gap_inside_a_block(gap):
    assert main_text(f"<body><p>{P}one {gap} two {P}</p></body>", Weights()) == f"{P}one two {P}".strip()


def test_titles():
    entry = f"<body>{MENU}<div><header class='entry-header'><h1>The title</h1></header><p>{P}</p></div></body>"
    assert main_text(entry, Weights()) == f"The title\n{P.strip()}"
    site = f"<body><header class='site'><h1>My site</h1>{MENU}</header><div><p>{P}</p></div></body>"
    assert main_text(site, Weights()) == P.strip()
    items = [f"{i}. {P.strip()}" for i in range(10)]
    tips = f"<body>{MENU}<div><h1>Ten tips</h1><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul></div></body>"
    assert main_text(tips, Weights()) == "\n".join(["Ten tips", *items])
