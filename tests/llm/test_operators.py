import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import bitslice, html, language, mixing, packing, pii, toxicity, vectors
from tessera.llm.queries import tokenizer_path

WORDS = "The quick brown fox, it's a dog. Über straße 42! Ça va? don't stop ".split()


def texts(n, seed=1):
    rng = random.Random(seed)
    made = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 5, 60, 400]))) for _ in range(n)]
    return [*made, None, "", "   ", "日本語 ﬁ Σς <|endoftext|> x", "word " * 9000, "a" * 30000]


# packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(k if k != 3 else None, t, 1) for k, t in enumerate(texts(120))] + [(5, "again", 2), (5, "again", 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(3)
    got = packing.pack(frame, tokenizer_path(), stretch=20_000).toPandas()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = sorted(((-1 if i is None else i), np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for i, t, _ in rows)
    whole = []
    for (i, _, s), g in got.assign(k=(got["start"] == 0).cumsum(), doc_id=got.doc_id.fillna(-1)).groupby(["doc_id", "k", "doc_tokens"]):
        assert list(g.start) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == s
        whole.append((int(i), b"".join(g.ids_le)))
    assert sorted(whole) == want
    for _, g in got.groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
    assert packing.pack(frame.limit(0), tokenizer_path()).count() == 0
    for n in (1, 3, 37, 63, 100):  # few tokens go to windows of powers of two
        few = packing.pack(spark.createDataFrame([(1, "a " * (n - 1))], "doc_id long, text string").coalesce(1), tokenizer_path)
        assert packing.padding(few).agg(F.sum("padding"), F.sum("tokens")).first() == (0, n)
    waste = packing.padding(spark.createDataFrame(got[["sequence_id", "length"]])).agg(F.sum("padding"), F.sum("tokens")).first()
    assert waste[0] < 0.2 * waste[1]


def test_cuts_against_all_plans():
    rng = np.random.default_rng(0)
    for _ in range(150):
        bounds = np.concatenate(([0], np.cumsum(rng.integers(1, 9, rng.integers(1, 9)))))
        fees = rng.choice([0.0, 8.0, 64.0], len(bounds))

        def cost(cuts, bounds=bounds, fees=fees):
            total = 0.0
            for a, b in zip(cuts, cuts[1:]):
                size = int(bounds[b] - bounds[a])
                if size > 128:
                    return math.inf
                total += (0 if size >= packing.LEAST_EXACT and size & (size - 1) == 0 else 128 - size) + fees[b] + packing.WINDOW_COST
            return total

        bounds *= 9
        inner = range(1, len(bounds) - 1)
        best = min(cost([0, *(k for k in inner if m >> k & 1), len(bounds) - 1]) for m in range(1 << len(bounds)))
        if math.isfinite(best):
            assert cost(packing.plan_cuts(bounds, fees, 128)) == pytest.approx(best)


# mixing


def test_mixing(spark):
    rows = [(k, "x" * (k % 7), ["a", "b", None][0 if k % 3 else 1 + k % 2], 0) for k in range(6000)] + [(None, None, "a", 0), (7, "x", "a", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    out = mixing.mix(frame, {"a": 1.0, "b": 2.0, None: 1.0}, seed=3)
    size = {r[0]: r[1] for r in out.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1)).collect()}
    whole = sum(size.values())
    assert size["b"] / whole == pytest.approx(0.5, abs=0.03) and size["a"] / whole == pytest.approx(0.25, abs=0.03)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, mixing.mix(frame, {"a": 1.0, "b": 2.0, None: 1.0}, seed=3).collect()), key=str)
    assert mixing.mix(frame, {"b": 1.0}).where("source is null or source <> 'b'").count() == 0
    assert mixing.mix(frame.limit(0)).count() == 0
    # Poisson counts: mean and variance equal the rate
    rate = mixing.rates(frame, {"b": 1.0}).where("source = 'b'").first()["rate"]
    counts = [r[0] for r in frame.where("source = 'b'").select("doc_id").join(mixing.mix(frame, {"b": 1.0}).groupBy("doc_id").count(), "doc_id", "left").select(F.coalesce("count", F.lit(0))).collect()]
    assert np.mean(counts) == pytest.approx(rate, rel=0.1) and np.var(counts) == pytest.approx(rate, rel=0.2)


# pseudonyms


def test_permutation_is_a_bijection_without_fixed_points():
    f = pii.Feistel(b"k")
    for n in (2, 3, 10, 97, 1000):
        image = [f.stand_in("x", n, k) for k in range(n)]
        assert sorted(image) == list(range(n)) and all(a != b for a, b in enumerate(image))
        assert [f.invert("x", n, f.permute("x", n, k)) for k in range(n)] == list(range(n))


def test_pseudonyms(spark):
    raw = ["4111 1111 1111 1111", "4111-1111-1111-1111", "anna.b@mail.example.com", "+1 (212) 555-0123", "078-05-1120", "DE89 3704 0044 0532 0130 00", "2024-02-29", "31/12/1999", "10.0.0.1", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    plain = ["4111111111111112", "999.1.1.1", "2023-02-30", "000-12-3456", "call 12345", "a = b", "v1.2.3", "ratio 3:4"]
    rows = [(k, f"see {t}, ok", "p") for k, t in enumerate(raw)] + [(100 + k, t, "p") for k, t in enumerate(plain)] + [(200, None, "p"), (201, "", "p"), (202, "z " * 100_000 + raw[8], "p"), (0, f"see {raw[0]}, ok", "p")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, private string")
    out = pii.pseudonymise(frame, key="k").collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    for k, t in enumerate(raw):
        text, spans = got[k].text, got[k].private
        assert len(spans) == 1 and t not in text and text.startswith("see ") and text.endswith(", ok")
        new = text[4:-4]
        assert [c if not c.isalnum() else "x" for c in new] == [c if not c.isalnum() else "x" for c in t] or spans[0].kind in ("ip", "date")
    digits = lambda k: "".join(c for c in got[k].text if c.isdigit())
    assert digits(0) == digits(1) and pii.luhn_digit(digits(0)[:-1]) == digits(0)[-1]
    iban = got[5].text[4:-4].replace(" ", "")
    assert pii.iban_digits(iban[:2], iban[4:]) == iban[2:4]
    assert all(0 <= int(o) < 256 for o in got[8].text[4:-4].split("."))
    for k, t in enumerate(plain):
        assert got[100 + k].text == t and got[100 + k].private == []
    assert got[200].text is None and got[201].text == "" and raw[8] not in got[202].text
    assert pii.pseudonymise(frame.limit(0), key="k").count() == 0


def test_pseudonyms_of_adjacent_values():
    work = pii.Pseudonyms("k")
    for value, rest in [
        ("+1 (826) 555-4081", " 190.137.223.204"),
        ("+49 30 1234567", " 190.137.223.204"),
        ("4111 1111 1111 1111", " 12/27"),
        ("4111 1111 1111 1111", " 123"),
        ("4111111111111111", " 2 items"),
        ("BE68 5390 0754 7034", " EUR 50"),
        ("AT611904300234573201", " EUR 50"),
    ]:
        alone, both = work.scrub(value)[0], work.scrub(f"pay {value}{rest}")
        assert alone != value and both[0].startswith(f"pay {alone} ") and value not in both[0]
        assert [k for k, *_ in both[1]][1:] == (["ip"] if "." in rest else [])
    for value in ("+1 (017) 555-7713", "A9ECF9C9B99FE9999999B9B99BC999E9999B0011", "2001:db8::8a2e:370:7334", "FE80:0:0:0:202:B3FF:FE1E:8329", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NSJ9.SflKxwRJSMeKKF2QT4"):
        new, spans = work.scrub(f"see {value}, ok.")
        assert len(spans) == 1 and value not in new and new.startswith("see ") and new.endswith(", ok.")
    assert work.scrub("A9ECF9C9B99FE9999999B9B99BC999E9999B0011")[0].lower() == work.scrub("a9ecf9c9b99fe9999999b9b99bc999e9999b0011")[0]
    new, spans = work.scrub("secret=aaaa1.bbbb2.cccc3. Then")
    assert new[7:].endswith(". Then") and not any(x in new for x in ("aaaa1", "bbbb2", "cccc3")) and spans[0][1:] == (7, 24)
    for plain in ("at 12:30:45", "std::abs", "call a::b now", "9807915762804490", "1234567890123452", "::1"):
        assert work.scrub(plain) == (plain, [])
    # a number before a card
    assert "4111 1111 1111 1111" not in work.scrub("no 12 4111 1111 1111 1111")[0]


def test_pseudonyms_of_long_secrets():
    work = pii.Pseudonyms("k")
    rng = random.Random(6)
    for size in (40, 256, 300, 100_000):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(size))
        token = "".join(rng.choice("abcXYZ019_") for _ in range(size))
        for text, value in ((f"see {key}, ok", key), (f'token="{token}" ok', token)):
            new, spans = work.scrub(text)
            (kind, start, end), = spans
            assert kind == "secret" and end - start == size and new[:start] + value + new[end:] == text
            assert all(value[k : k + 40] not in new for k in range(0, size - 39, 20))


def test_pseudonyms_of_many_values_in_a_text():
    import time

    work = pii.Pseudonyms("k")
    values = [f"10.{k % 200}.{k // 200 % 250}.{k % 7}" for k in range(50_000)]
    began = time.time()
    text, spans = work.scrub(" x ".join(values))
    assert len(spans) == len(values) and time.time() - began < 60
    plain = {v: work._ip(v) for v in set(values[:500])}
    assert text.split(" x ")[:500] == [plain[v] for v in values[:500]]


# extraction


def brute_cut(odds, edges):
    n = len(odds)
    cost = lambda s: sum(abs(o) for o, x in zip(odds, s) if (o > 0) != x) + sum(c for (i, j), c in edges.items() if s[i] != s[j])
    return min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n)), cost


def test_minimum_cut_against_all_labellings():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 8)
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 1.5) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        best, cost = brute_cut(odds, edges)
        assert cost(html.minimum_cut(odds, edges)) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href=/a>Menu a</a><li><a href=/b>Menu b</a></ul></nav>
<!-- ad <p>hidden</p> --><div class="cookie-notice"><p>We use cookies on this site, as everybody does.</p></div>
<article><h1>A &amp; B</h1><p>First   <b>bold</b>\n text&nbsp;here.<p><b>Second<br>line.<br><p>Ok.</p><div class=ad>Buy now and get this wonderful thing for free.</div><p>Last one.</p></article>
<section id="comments"><article><p>I liked this post very much, thanks for writing it.</p></article></section><aside>Side</aside><form><p>Your name</p><input></form><footer>&copy; x</footer></body>"""


def test_only_hidden_elements_are_dropped():
    body = "<p>The first plain sentence of a long article, with words enough. And a second one follows it.</p>"
    shown = ['style="overflow:hidden"', "style='overflow: hidden'", 'class="post overflow-hidden"', 'class="hidden-print article"', 'aria-hidden="false"', 'data-hidden="1"', 'hidden="until-found"', 'title="display:none"', 'style="backface-visibility:hidden"']
    gone = ["hidden", 'HIDDEN=""', 'class="post" hidden', 'style="color:red; Display : NONE"', "style='visibility:hidden'", "style=display:none!important", "aria-hidden=true"]
    for tag in ("article", "div"):
        assert [a for a in shown if html.blocks_of(f"<body><{tag} {a}>{body}</{tag}></body>")] == shown
        assert [a for a in gone if not html.blocks_of(f"<body><{tag} {a}>{body}</{tag}></body>")] == gone


def test_the_cut_mends_labels():
    from pages import pages

    blocks = [(html.blocks_of(page), [y for _, y in labels]) for page, labels in pages(1, 2000)]
    assert html.WEIGHTS == pytest.approx(html.fit([b for bs, _ in blocks for b in bs], [y for _, ys in blocks for y in ys]), abs=0.01)
    alone = cut = total = 0
    for page, labels in pages(2, 300):
        bs, want = html.blocks_of(page), [y for _, y in labels]
        assert [b.text for b in bs] == [" ".join(t.split()) for t, _ in labels]
        odds = [html.log_odds(b) for b in bs]
        alone += sum((o > 0) == y for o, y in zip(odds, want))
        cut += sum(k == y for k, y in zip(html.minimum_cut(odds, html.smoothness(bs)), want))
        total += len(want)
    assert cut > 0.995 * total and alone < 0.985 * total
    # short lines between paragraphs and a sentence in a menu, with no name on either
    text = "".join(f"<p>{'A long and plain sentence of this story. ' * 2}</p><p>Yes</p>" for _ in range(3)) + "<p>And so it ended, as all plain stories do.</p>"
    menu = "<div><ul><li><a>One</a><li><a>Two</a><li>News every day.<li><a>Three</a><li><a>Four</a></ul></div>"
    bs = html.blocks_of(f"<body>{menu}<div>{text}</div></body>")
    assert [b.text for b in bs if b.text in ("Yes", "News every day.") and html.log_odds(b) <= 0] == ["Yes"] * 3
    assert html.main_blocks(f"<body>{menu}<div>{text}</div></body>").count("Yes") == 3


def test_extraction_of_many_and_deep_blocks():
    import time

    began = time.time()
    n = 20_000
    for page in ("<b>" * n + "</i>" * n + "x", "<div>" * n + "</p>" * n + "x", "<i><p>" + "<b>" * n + "</i>" * n, "<b>" * n + "<hr>" * n, "<p><b>" * n + "x", "<ul><li>" * n + "x"):
        html.main_blocks(page)
    html.main_blocks("".join(f"<div><p>{'word ' * (3 + k * 7 % 18)}</p></div><p>{'a b c d ' * (k * 5 % 4 + 1)}</p>" for k in range(8000)))
    assert time.time() - began < 60


def test_extraction(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, "<!-- open"), (5, "<p>" + "A long plain paragraph of words. " * 5000), (1, PAGE)]
    got = spark.createDataFrame(rows, "page_id long, html string").select("page_id", html.main_text(F.col("html")).alias("t")).collect()
    found = {r.page_id: r.t for r in got}
    assert found[1] == "A & B\nFirst bold text here.\nSecond line.\nOk.\nLast one."
    assert found[2] == found[3] == found[4] == "" and len(got) == 6
    assert found[5] == ("A long plain paragraph of words. " * 5000).strip()


# models


def language_rows(seed=2, n=60):
    rng = random.Random(seed)
    parts = {"aa": ["ka", "ro", "mi"], "bb": ["zu", "schi", "ö"]}
    return parts, [(k, " ".join("".join(rng.choice(p) for _ in range(3)) for _ in range(20)), lang) for k, (lang, p) in enumerate(list(parts.items()) * n)]


def test_language(spark):
    parts, rows = language_rows()
    frame = spark.createDataFrame([*rows, (900, None, "aa"), (901, "kakaka", None)], "doc_id long, text string, lang string")
    model = language.train(frame)
    ask = spark.createDataFrame([(1, "karomikaro", "x"), (2, "zuzuschizuö", "x"), (3, None, "x"), (4, "12 !?", "x"), (5, "日本", "x"), (6, "karomi " * 200_000, "x"), (7, "½ ² Ⅷ ①", "x"), (8, "", "x"), (1, "karomikaro", "x")], "doc_id long, text string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(ask, model).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4, 6, 7, 8)] == ["aa", "bb", "und", "und", "aa", "und", "und"] and got[5][0] in parts
    assert all(0 <= s <= 1 for _, s in got.values()) and got[3][1] == got[7][1] == 0
    empty = language.train(frame.limit(0))
    assert language.identify(ask, empty).where("lang_pred <> 'und'").count() == 0
    assert language.identify(ask.limit(0), model).count() == 0


def test_language_against_plain_dictionaries(spark):
    _, rows = language_rows(n=20)
    rows += [(200, "Ka-roß ÖÖ é", "aa"), (201, "abc " * 3, "bb"), (202, "İx Σς", "aa")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    words, counts = lambda t: __import__("regex").findall(r"[\p{L}\p{M}]+", t.lower()), {}
    for _, text, lang in rows:
        for w in words(text):
            for n in range(6):
                for key in [w] if n == 0 else [f"^{w}$"[k : k + n] for k in range(len(w) + 3 - n)]:
                    counts.setdefault((n, key), {"aa": 0, "bb": 0})[lang] += 1
    sums = {n: {x: sum(c[x] for (m, _), c in counts.items() if m == n) for x in ("aa", "bb")} for n in range(6)}
    size = {n: sum(m == n for m, _ in counts) for n in range(6)}
    log = lambda n, key, x: math.log((counts[n, key][x] + 0.1) / (sums[n][x] + 0.1 * size[n]))

    def score(word, x):
        if (0, word) in counts:
            return log(0, word, x)
        for n in range(5, 0, -1):
            if known := [g for k in range(len(word) + 3 - n) if (n, g := f"^{word}$"[k : k + n]) in counts]:
                return sum(log(n, g, x) for g in known) / len(known)
        return 0.0

    rng = random.Random(8)
    asked = [" ".join("".join(rng.choice("karomizuschöabcxyé") for _ in range(rng.randrange(1, 12))) for _ in range(6)) for _ in range(200)] + [rows[3][1], "Karo, mika! zu-zu", "qqq www"]
    got = model.predict(asked)
    for text, lang, p in zip(asked, got.lang_pred, got.score):
        a, b = (sum(score(w, x) for w in words(text)) for x in ("aa", "bb"))
        assert p == pytest.approx(1 / (1 + math.exp(-abs(a - b))), abs=1e-4)
        assert abs(a - b) < 1e-4 or lang == ("aa" if a > b else "bb")


def held_out(table, divisor, rest):
    """The rows of sf0.1 and whether their remainder is ``rest``."""
    path = "/root/testdata/sf0.1"
    rows = pd.read_parquet(f"{path}/documents.parquet") if table == "documents" else pd.read_parquet(f"{path}/documents.parquet").merge(pd.read_parquet(f"{path}/labels.parquet"), on="doc_id")
    return rows, np.array([zlib.crc32(str(i).encode()) % divisor == rest for i in rows.doc_id])


def test_language_of_held_out_documents(spark):
    rows, held = held_out("documents", 4, 2)
    model = language.train(spark.createDataFrame(rows[~held][["doc_id", "text", "lang"]]), max_train=2500)
    got = model.predict(rows.text[held].tolist())
    assert (got.lang_pred.to_numpy() == rows.lang[held].to_numpy()).mean() > 0.99
    assert (got.fit < -12).mean() < 0.002
    foreign = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "xkcd wqrtz bnmpl vrtsk zzxqw plkjh qwrtp mnbvc", "def main(): for x in range(10): print(x) import numpy"]
    assert (model.predict(foreign).fit < -12).all()


def test_toxicity_of_held_out_documents():
    rows, held = held_out("labels", 5, 0)
    rows, held = rows[rows.toxic.notna()], held[rows.toxic.notna()]
    model = toxicity.fit([toxicity.condensed(t) for t in rows.text[~held]], rows.toxic[~held].to_numpy())
    found, toxic = model.scores(rows.text[held].tolist()) >= 0.5, rows.toxic[held].to_numpy() == 1
    assert found[toxic].mean() >= 0.85 and found[~toxic].mean() <= 0.02


def test_toxicity_against_plain_runs():
    rng = random.Random(9)
    asked = [" ".join("".join(rng.choice("abcdéß") for _ in range(rng.randrange(1, 6))) for _ in range(n)) for n in (1, 2, 4, 5, 6, 7, 40, 300)]
    table = np.random.default_rng(1).normal(size=toxicity.BUCKETS)
    got = toxicity.Model(table, 0.25, -9.0).logits([*asked, "", None, "12 ?"])
    for text, logit in zip(asked, got):
        words = list(dict.fromkeys(text.split()))
        begins = [k for k in range(0, len(words), toxicity.RUN) if k == 0 or len(words) - k >= toxicity.RUN / 2]
        best = -math.inf
        for a, b in zip(begins, [*begins[1:], len(words)]):
            made = language.Words.of([" ".join(words[a:b])])
            rows, _ = toxicity.subwords(made, np.arange(b - a))
            assert len(rows) == sum(1 + sum(max(0, len(w) + 3 - n) for n in (3, 4, 5)) for w in words[a:b])
            best = max(best, table[rows].mean())
        assert logit == pytest.approx(best + 0.25)
        assert toxicity.Model(table, 0.25, -9.0).logits([toxicity.condensed(text)])[0] == pytest.approx(logit)
    assert list(got[-3:]) == [-9.0] * 3


def test_toxicity(spark):
    rng = random.Random(3)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    make = lambda bad: " ".join([*(rng.choice(clean) for _ in range(40)), *(["xyzzyqu" + rng.choice("abcdef") for _ in range(3)] if bad else [])])
    rows = [(k, make(k % 4 == 0)) for k in range(400)]
    frame = spark.createDataFrame([*rows, (999, None), (1, rows[1][1])], "doc_id long, text string").withColumn("toxic", F.lit(7)).withColumn("words", F.lit("x"))
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(999, 0), (1000, 1), (1, None), (2, 0)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    model = toxicity.train(frame, labels)
    ask = spark.createDataFrame([(1, make(False)), (2, " ".join(clean[:40]) + " xyzzyqux xyzzyquz xyzzyquy"), (3, None), (4, ""), (5, "xyzzyqua " * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in ask.select("doc_id", toxicity.toxicity(spark, model, F.col("text")).alias("s")).collect()}
    assert got[1] < 0.5 < got[2] and got[3] == got[4] < 0.5 and got[5] > 0.5
    none = toxicity.train(frame.limit(0), labels)
    assert 0 < none.scores(["x", None])[0] < 1 and toxicity.toxicity(spark, none, F.col("text")) is not None
    assert ask.limit(0).select(toxicity.toxicity(spark, model, F.col("text"))).count() == 0


# vectors


def vector_rows(seed, n=700):
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(n, 16)).astype(np.float32)
    made[100:300] = made[100]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(made)]
    return [*rows, (2000, None, 1), (2100, [0.0] * 16, 1), (2200, [float("nan"), *[1.0] * 15], 1), (2300, [None, *[1.0] * 15], 1), (2400, [float("inf"), *[1.0] * 15], 1), (None, [1.0] * 16, 1)], made


def test_nearest_neighbours(spark):
    rows, made = vector_rows(1)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = vectors.search(frame, F.col("vec_id") % 100 == 0, k=10).toPandas().sort_values(["query_id", "rank"])
    assert sorted(got.query_id.unique()) == [0, 100, 200, 300, 400, 500, 600]
    hits = 0
    for q, g in got.groupby("query_id"):
        far = np.sqrt(((made.astype(float) - made[q].astype(float)) ** 2).sum(axis=1))
        far[q] = np.inf
        best = np.lexsort((np.arange(len(far)), far))[:10]
        hits += len(set(best) & set(g.vec_id))
        assert list(g["rank"]) == list(range(1, 11)) and np.array_equal(g.score, far[g.vec_id]) and q not in set(g.vec_id)
        if q in (100, 200):
            assert list(g.vec_id) == [k for k in range(100, 112) if k != q][:10]
    assert hits >= 0.9 * 70
    assert vectors.search(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = vectors.search(frame.where("vec_id < 4"), F.col("vec_id") == 0, k=10).collect()
    assert len(few) == 3


def test_neighbours_of_several_widths_and_lists(spark, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP_ROWS", 150)
    monkeypatch.setattr(vectors, "LEAST_INDEXED", 250)
    rng = np.random.default_rng(4)
    made = [(k, rng.normal(size=w).tolist()) for k, w in enumerate([16] * 400 + [3] * 298 + [2] * 4)]
    made += [(k + 1000, made[5][1]) for k in range(300)]  # a hot list
    got = vectors.search(spark.createDataFrame(made, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=5).toPandas()
    hits = total = 0
    for q, v in made:
        if q % 100 == 0:
            best = sorted((float(np.sqrt(((np.array(w) - v) ** 2).sum())), n) for n, w in made if n != q and len(w) == len(v))[:5]
            mine = got[got.query_id == q].sort_values("rank")
            assert len(mine) == len(best)
            hits, total = hits + len({n for _, n in best} & set(mine.vec_id)), total + len(best)
            if len(v) == 2:
                assert list(zip(mine.score, mine.vec_id)) == best
    assert hits >= 0.9 * total


def test_recall_on_embeddings(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = vectors.search(frame, F.col("vec_id") % 100 == 0, k=10).toPandas()
    rows = frame.toPandas().sort_values("vec_id")
    ids, data = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    hits = 0
    for q, g in got.groupby("query_id"):
        far = np.sqrt(((data - data[ids == q][0]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        hits += len(set(ids[np.lexsort((ids, far))[:10]]) & set(g.vec_id))
    assert hits >= 0.95 * 10 * (ids % 100 == 0).sum()


def test_top_k_of_huge_components(spark):
    rows = [(0, [1.0, -2.0]), (20, [300000.0, 1.0]), (1, [3e8, -1.5]), (2, [-3e8, 0.0]), (3, [0.01, 1e30]), (4, [1.0]), (40, [2.0]), (5, []), (60, []), (6, None), (7, [float("inf"), 1.0])]
    got = bitslice.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=3).toPandas()
    ints = {n: [math.floor(64 * x) for x in v] for n, v in rows if v is not None and all(map(math.isfinite, v))}
    want = []
    for q in (0, 20, 40, 60):
        best = sorted((-sum(a * b for a, b in zip(v, ints[q])), n) for n, v in ints.items() if n != q and len(v) == len(ints[q]))[:3]
        want += [(q, k + 1, n, max(min(-s, 2**63 - 1), -(2**63))) for k, (s, n) in enumerate(best)]
    assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].astype(object).values.tolist())) == sorted(want)
    assert bitslice.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("rows_a_block, least_rows", [(1 << 16, 1 << 12), (100, 50)])
def test_top_k_is_exact(spark, monkeypatch, rows_a_block, least_rows):
    monkeypatch.setattr(bitslice, "BLOCK_ROWS", rows_a_block)
    monkeypatch.setattr(bitslice, "LEAST_ROWS", least_rows)
    rows, made = vector_rows(2, 420)
    got = bitslice.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int"), F.col("vec_id") % 20 == 0, k=20).toPandas()
    ints = np.floor(64 * made.astype(float)).astype(np.int64)
    ints, ids = np.concatenate((ints, np.zeros((1, 16), dtype=np.int64))), np.array([*range(420), 2100])
    want = []
    for q in ids[ids % 20 == 0]:
        s = ints @ ints[ids == q][0]
        best = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        want += [(q, r + 1, ids[k], s[k]) for r, k in enumerate(best)]
    assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].values.tolist())) == sorted(tuple(map(int, w)) for w in want)


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    # several words a language, so that every document is sure of its own
    vocabulary = {"en": [f"the{k}ing".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(400)], "de": [f"sch{k}ung".translate(str.maketrans("0123456789", "klmnopqrst")) for k in range(400)]}
    rows = []
    for k in range(80):
        lang = "en" if k % 2 else "de"
        rows.append((k, " ".join(rng.choice(vocabulary[lang]) for _ in range(80)) + (" mail x.y@z.example.com." if k % 5 == 0 else "."), lang, f"s{k % 3}"))
    rows += [(100, rows[3][1], "en", "s0"), (101, rows[4][1].replace(".", "!"), "de", "s1"), (102, None, None, "s0"), (103, "1234 !!", "en", "s0")]
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars int").withColumn("n_chars", F.col("n_chars").cast("long"))
    docs, kept = frame, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs)
    assert all(d.columns == frame.columns for d in kept[:-1])
    assert {r.doc_id for r in kept[0].collect()} == {*range(80), 100, 101}
    assert {r.doc_id for r in kept[1].collect()} == set(range(80))
    assert kept[2].where("text like '%x.y@z.example.com%'").count() == 0 and kept[2].count() == 80
    assert {r.doc_id for r in kept[3].collect()} <= set(range(80))
    assert kept[4].agg(F.sum("length")).first()[0] > 1000


@pytest.mark.parametrize("rows", [[], [(None, "The same text stands here. " * 30, "en", "s", 1), (None, None, None, None, None), (7, "", "en", None, 0), (7, "Seven words stand in this short text", "en", "s", 3), (7, "Seven words stand in this short text", "en", "s", 3), (8, "x" * 100_000, "en", "s", 9)]])
def test_pipeline_stages_on_odd_rows(spark, tmp_path, rows):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, __gone long, group_id long, digest string, code long, id long"
    docs = spark.createDataFrame([(*r, 1, 2, "d", 3, 4) for r in rows], schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        assert k == 4 or out.columns == docs.columns
        docs = spark.read.parquet(path)
        if k == 1 and rows:
            assert sorted((r.doc_id for r in docs.collect()), key=repr) == sorted({r.doc_id if r.doc_id is not None else None for r in docs.collect()}, key=repr)
    assert rows or docs.count() == 0


def test_pseudonyms_of_whole_documents(spark):
    """Every kind of value that the documents hold, found by plain patterns of its own."""
    import re

    from tessera.llm.queries import PII_KEY, op5_pseudonyms

    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
    patterns = {
        "email": r"[a-z.0-9%+-]+(?=@mail\d+\.example\.com)",
        "secret": r"\b[0-9a-f]{40}\b|\b[0-9A-F]{40}\b",
        "phone": r"\+1 \(\d{3}\) 555-\d{4}",
        "card": r"\b\d{16}\b",
        "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]\d)",
    }
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    stand_ins, found = {}, 0
    for r in op5_pseudonyms(spark, folder).collect():
        old, spans = texts[r.doc_id], sorted(r.private, key=lambda s: s.start)
        want = sorted((m.start(), kind, m[0]) for kind, p in patterns.items() for m in re.finditer(p, old or "", re.I if kind == "email" else 0) if kind != "card" or luhn(m[0]) and m[0][0] in "23456")
        mine, shift, at, rebuilt = [], 0, 0, []
        for s in spans:
            size = s.end - s.start
            begin = s.start - shift
            value = next(v for b, k, v in want if b == begin and k == s.kind)
            shift += size - len(value)
            new = r.text[s.start : s.end]
            rebuilt += [r.text[at : s.start], value]
            at = s.end
            mine.append((begin, s.kind, value))
            key = (s.kind, re.sub(r"\W", "", value).lower() if s.kind != "ip" else value)
            plain = re.sub(r"\W", "", new).lower() if s.kind != "ip" else new
            assert stand_ins.setdefault(key, plain) == plain and plain != key[1]
        assert mine == want and "".join([*rebuilt, (r.text or "")[at:]]) == (old or "")
        found += len(mine)
    assert found > 50 and len(set(stand_ins.values())) == len(stand_ins) and PII_KEY


def test_crc_of_pieces(spark):
    out = packing.pack(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), tokenizer_path()).select("ids_le", F.crc32("ids_le").alias("c")).first()
    assert out.c == zlib.crc32(bytes(out.ids_le)) and isinstance(pd.DataFrame(), pd.DataFrame)
