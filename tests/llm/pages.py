"""Pages with labelled main text: those of the tables, with their marks taken away and other parts put in."""

import html as entities
import random
import re
from collections import Counter

SPLIT = re.compile(r"^(.*?<body>)(<nav>.*?</nav>)(.*?)<article>(.*?)</article>(.*)$", re.DOTALL)
TAGS = re.compile(r"<(?:h1|/h1|p|/p)>")


def label(article: str) -> list[str]:
    """The blocks of an article of the tables, which has h1, p, b and br only."""
    cut = [entities.unescape(re.sub(r"<br>", " ", part).replace("<b>", "").replace("</b>", "")) for part in TAGS.split(article)]
    return [" ".join(x.split()) for x in cut if x.split()]


def variants(page: str, seed: int = 0) -> dict[str, tuple[str, list[str]]]:
    """Each variant's page and its blocks of main text."""
    rng = random.Random(seed)
    m = SPLIT.match(page)
    if m is None:
        return {}
    head, nav, ad, body, foot = m.groups()
    want = label(body)
    plain = lambda x: re.sub(r"<(/?)(?:nav|footer|article)\b", r"<\1div", re.sub(r" class=\"[^\"]*\"", "", x))
    side = '<div class="r2"><h4>Also</h4><ul><li><a href=/a>One other thing</a></li><li><a href=/b>And one more</a></li></ul></div>'
    said = "".join(
        f'<div class="z{i}"><p>{rng.choice(["Ann", "Bo", "Cy"])} says:</p><p>{rng.choice(["I think so, too.", "No, never; not so.", "Thanks, this was of use."])}</p></div>'.replace(f"z{i}", "q9")
        for i in range(rng.randint(1, 4))
    )
    parts = re.split(r"(?=<p>)", body)
    half = len(parts) // 2
    out = {
        "as it is": (page, want),
        "without marks": (head + plain(nav) + plain(ad) + f"<div>{body}</div>" + plain(foot), want),
        "neutral names": (head + plain(nav) + f'<div class="k1">{ad}</div><div class="k2">{body}</div>{side}<div class="k3">' + plain(foot), want),
        "in a form": (head + f"<form id=f>{nav}{ad}<div class=t>{body}</div></form>" + foot, want),
        "comments": (head + nav + ad + f"<article>{''.join(parts[:half])}{said}{''.join(parts[half:])}</article>" + foot, want),
        "sections": (head + nav + ad + f'<article><section id="search-methods">{"".join(parts[:half])}</section><section class="related-work">{"".join(parts[half:])}</section></article>' + foot, want),
        "a long menu inside": (head + nav + ad + f"<article>{body}<ul>" + "".join(f"<li><a href=/{i}>Link {i} of many</a></li>" for i in range(9)) + "</ul></article>" + foot, want),
    }
    return out


def agreement(got: str, want: list[str]) -> tuple[int, int, int]:
    """Characters that are right, that were given, and that should have been."""
    a, b = Counter(got.split("\n") if got else []), Counter(want)
    return sum(len(x) * n for x, n in (a & b).items()), sum(len(x) * n for x, n in a.items()), sum(len(x) * n for x, n in b.items())
