import pytest

from ferrule.llm.html_text import UNSEEN, Page

BODY = "<body><p>first words</p><p>last words</p></body></html>"


def text(page):
    return " ".join("".join(t for _, t in Page(page).pieces).split())


@pytest.mark.parametrize("end", ["", "</head>"])
def test_head_may_stay_open(end):
    page = f"<html><head><title>x</title><style>p {{}}</style><script>var a = '<p>';</script><meta name=a>{end}{BODY}"
    assert text(page) == "first wordslast words"
    assert text(page.replace("<body>", "").replace("</body>", "")) == "first wordslast words"


@pytest.mark.parametrize("name", sorted(UNSEEN - {"head"}))
def test_unseen_element_without_end_tag(name):
    rest = "" if name in ("script", "style") else "last words"
    assert text(f"<html><head></head><body><p>first words</p><{name}><p>last words</p></body></html>") == "first words" + rest
    assert text(f"<html><body><p>first words</p><{name}>gone</{name}><p>last words</p></body></html>") == "first wordslast words"
