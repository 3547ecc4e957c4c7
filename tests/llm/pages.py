"""Made pages whose blocks have known labels, for fitting and testing the extraction."""

import random

WORDS = "the of and to in is was for on that with as by from at river stone letter garden morning window market people water light paper house story number winter engine teacher bridge forest question answer music history mountain village".split()


def sentence(rng, low, high):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))).capitalize() + rng.choice([".", ".", ".", "?", "!"])


def paragraph(rng):
    kind = rng.random()
    if kind < 0.15:  # short, as in verse, dialogue or a caption
        return " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5))).capitalize() + rng.choice(["", "", ".", ","])
    return " ".join(sentence(rng, 4, 25) for _ in range(rng.randint(1, 5)))


def page(rng):
    """A page and its blocks' texts with labels, in order."""
    out, blocks = [], []

    def put(tag, text, label, inner=None):
        out.append(f"<{tag}>{inner or text}</{tag.split()[0]}>")
        blocks.append((text, label))

    def links(wrapper, count):
        out.append(f"<{wrapper}><ul>")
        for _ in range(count):
            text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))
            put("li", text, False, f"<a href='/x'>{text}</a>" if rng.random() < 0.9 else None)
        out.append(f"</ul></{wrapper.split()[0]}>")

    def blurbs(wrapper, count):
        out.append(f"<{wrapper}>")
        for _ in range(count):
            put("p", sentence(rng, 2, 14), False)
        out.append(f"</{wrapper.split()[0]}>")

    named = rng.random() < 0.6  # whether the page says what its parts are
    if rng.random() < 0.7:
        out.append("<header>" if named else "<div>")
        put("h1" if rng.random() < 0.5 else "p", " ".join(rng.choice(WORDS) for _ in range(2)), False)
        out.append("</header>" if named else "</div>")
    if rng.random() < 0.9:
        links("nav" if named else "div", rng.randint(3, 9))
    if rng.random() < 0.4:
        blurbs("div class='ad'" if rng.random() < 0.9 else "div", 1)
    if rng.random() < 0.3:
        blurbs("div class='cookie-notice'", 1)
    if not named and rng.random() < 0.3:
        links("div", rng.randint(3, 6))
    body = rng.choice(["article", "main"]) if named else rng.choice(["div", "div class='post'", "td", "div"])
    out.append(f"<{body}>")
    for _ in range(rng.randint(3, 14)):
        kind = rng.random()
        if kind < 0.12:
            put("h2", " ".join(rng.choice(WORDS) for _ in range(rng.randint(2, 6))).capitalize(), True)
        elif kind < 0.18 and named:
            blurbs("div class='ad'", 1)
        elif kind < 0.25:
            text = sentence(rng, 5, 20)
            put("p", text, True, f"<a href='/y'>{text[: len(text) // 2]}</a>{text[len(text) // 2 :]}")
        else:
            put("p", paragraph(rng), True)
    out.append(f"</{body.split()[0]}>")
    if rng.random() < 0.4:
        blurbs(rng.choice(["section id='comments'", "div class='comments'"]), rng.randint(1, 4))
    if rng.random() < 0.5:
        links("aside" if named else "div class='sidebar'", rng.randint(2, 6))
    if rng.random() < 0.7:
        out.append("<footer>" if named else "<div>")
        put("p", "Copyright " + rng.choice(WORDS) + " 2024", False)
        out.append("</footer>" if named else "</div>")
    return "<body>" + "".join(out) + "</body>", blocks


def pages(seed, count):
    rng = random.Random(seed)
    return [page(rng) for _ in range(count)]
