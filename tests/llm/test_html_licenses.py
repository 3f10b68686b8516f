import math
import random
import re

import pytest

from arborlake.llm.html_extract import ARTICLE, GAMMA, LEAST_PAGES, OPEN, SUSPECT, THRESHOLD, extract_main_text, host_of, parse
from arborlake.llm import license_rules
from arborlake.llm.license_rules import rules
from arborlake.llm.licenses import BASE, Scanner, license_scan, resolve

PAGES = "page_id bigint, url string, html string"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a<br>b<p>c &lt;x&gt; &amp d&nbsp;e<ul><li>1<li>2</ul>tail", ["a b", "c <x> & d e", "1", "2", "tail"]),
        ("<nav><div>q</div></nav>ok<script>if(a<b){}</script>more<!-- c --><aside>no</aside>", ["okmore"]),
        ("<head><title>t</title><style>p{}</style></head><body><div class='ad'>x</div><p>yes", ["yes"]),
        ("<head><title>t", []),
        ("<p>a</b>c</p><table><tr><td>1<td>2<tr><td>3</table>", ["ac", "1", "2", "3"]),
        ("<form>x<input></form>y<button>z</button>", ["y"]),
        ("<div class='has-sidebar'><p>text</p></div>", ["text"]),
        ("<div class='menu'><article><p>in</p></article></div>", ["in"]),
        ("  \n x \n\n y  ", ["x y"]),
        ("", []),
        (None, []),
    ],
)
def test_blocks(html, want):
    assert [t for z, _, t in parse(html).blocks if z != SUSPECT] == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<article><p class=ad>x<p>real<p>more</article>after", ["real", "more", "after"]),
        ("<ul><li>a<li class=share>s<li>b</ul>c", ["a", "b", "c"]),
        ("<div><aside>no<p>no</div>yes", ["yes"]),
        ("<dl><dt>t<dd class=ad>x<dt>u</dl><table><tr><td class=ad>x<td>y<tr class=ad><td>x<tr><td>z</table>", ["t", "u", "y", "z"]),
        ("<span>a<div class=ad>x</span>x</div>b</span>", ["a", "b"]),
        ("<p>a<button><p>x</button>b</p>c", ["ab", "c"]),
    ],
)
def test_skipped_elements_end_as_others_do(html, want):
    assert [t for z, _, t in parse(html).blocks if z != SUSPECT] == want


def test_article():
    page = parse("<body><header>site</header><article><header><h1>T</h1></header><p>x <b>y</b>z</p> loose <div>in</div> after<div class='comments'><article class='comment'>c</article></div></article><p>out</body>")
    assert [t for zone, _, t in page.blocks if zone == ARTICLE] == ["T", "x yz", "loose", "in", "after"]


def test_hosts():
    assert [host_of(u) for u in ("http://A.example.com/x", "https://u@h:80?q", "nothing", None, "//x.y/z")] == ["a.example.com", "h:80", "", "", "x.y"]


def soup(i, body):
    return f"<body><div class=a><div class=b><a>Start</a> <a>Shop {i % 2}</a></div></div><div class=c><div class=d>{''.join(f'<div class=e>{t}</div>' for t in body)}</div></div><div class=f>All about us</div></body>"


def test_style_tree_removes_what_recurs(spark):
    rows = [(i, f"http://soup.example.com/{i}", soup(i, [f"Story {i} begins", f"and {i} ends"])) for i in range(40)]
    rows += [(100 + i, "http://small.example.com/x", soup(i, [f"small {i}"])) for i in range(2)]
    rows += [(200, None, None), (201, "x", ""), (0, rows[0][1], rows[0][2])]
    got = {r["page_id"]: r for r in extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i]["text"] == f"Story {i} begins\nand {i} ends" and got[i]["removed"] == 2 for i in range(40))
    assert got[100]["text"] == "small 0"
    assert got[200]["text"] == got[201]["text"] == "" and got[200]["n_chars"] == 0
    assert extract_main_text(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize(
    ("attrs", "zone"),
    [
        ("class=ad", SUSPECT),
        ("id='main-menu'", SUSPECT),
        ("class='x ad-box-2'", SUSPECT),
        ("class=sidebarLeft", SUSPECT),
        ("role=complementary", SUSPECT),
        ("class='share-price'", ARTICLE),
        ("class='social-policy'", ARTICLE),
        ("class='has-sidebar'", ARTICLE),
        ("class=content", ARTICLE),
    ],
)
def test_names(attrs, zone):
    assert parse(f"<article><p>a</p><section {attrs}>b</section></article>").blocks[1][0] == zone


def page(i):
    prose = "".join(f"<p>{w} {i}</p>" + "<h2>more</h2>" * (i * k % 3) for k, w in enumerate(("one", "two", "three")))
    return f"""<body><div class=ad>buy {i}</div><div>Intro {i}</div><div class=r>Recurs</div><article><h1>T {i}</h1><h2>Summary</h2><p class=share-price>p {i}</p>
      <section class=promo>{prose}</section><div class=promo>offer {i}</div></article><div class=tail>All rights</div><div class=comments><p>c {i}</p>{"<p>d</p>" * (i % 4)}</div></body>"""


def test_trees_judge_on_pages_with_an_article(spark):
    """Suspect branches stay where they vary, text beside an article stays where it isn't boilerplate."""
    rows = [(i, "http://a.example.com/x", page(i)) for i in range(30)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(30):
        prose = [x for k, w in enumerate(("one", "two", "three")) for x in (f"{w} {i}", *["more"] * (i * k % 3))]
        assert got[i].split("\n") == [f"Intro {i}", f"T {i}", "Summary", f"p {i}", *prose]
    # Without the trees all but comments stays; on too few pages names decide.
    ablated = extract_main_text(spark.createDataFrame(rows, PAGES), threshold=0.0).where("page_id = 3").first()["text"]
    assert "buy 3" in ablated and "All rights" in ablated and "offer 3" in ablated and "c 3" not in ablated
    alone = extract_main_text(spark.createDataFrame(rows[3:4], PAGES)).first()["text"]
    assert "buy" not in alone and "one 3" not in alone and "All rights" in alone


def entropy(groups, base):
    return -sum(g / base * math.log(g / base, base) for g in groups)


def brute_texts(pages):
    """The definition, page by page: trees of hosts and of all pages as dicts of sets."""
    parsed = {p: parse(html) for p, _, html in pages}
    distinct = {(host_of(url), html): p for p, url, html in reversed(pages)}
    shown, texts = {}, {}
    for (host, _), p in distinct.items():
        for path, kind, feature in parsed[p].rows:
            for key in ((host, path), path):
                (texts if kind else shown).setdefault(key, {}).setdefault(feature, set()).add((host, p))

    def importance(key):
        per = [len(v) for v in shown.get(key, {}).values()]
        m = sum(per)
        if m < LEAST_PAGES:
            return None
        presentation = entropy(per, m)
        held = [len(v) for v in texts.get(key, {}).values()]
        content = max(0.0, 1 - sum(math.log(k, m) for k in held) / len(held)) if held else presentation
        return presentation, content

    out = {}
    for p, url, _ in pages:
        kept = []
        for zone, path, text in parsed[p].blocks:
            known = [x for x in (importance((host_of(url), path)), importance(path)) if x]
            stays = zone != SUSPECT
            if known and zone != ARTICLE:
                presentation, content = (min(x) for x in zip(*known, strict=True))
                stays = GAMMA[zone] * content + (1 - GAMMA[zone]) * presentation >= THRESHOLD
            if stays:
                kept.append(text)
        out[p] = "\n".join(kept)
    return out


def test_trees_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        body = "".join(f"<{t} class={c}>{'<b>x</b>' * rng.randrange(3)}{rng.choice(('same', f'text {rng.randrange(40)}', f'own {i}'))}</{t}>" for t, c in rng.choices([("div", "ad"), ("div", "q"), ("p", "r"), ("section", "promo"), ("div", "notice")], k=6))
        rows.append((i, f"http://h{rng.choice((0, 0, 0, 1, 2, rng.randrange(9)))}.example.com/{i}", body if i % 3 else f"<article><p>in {i}</p></article>{body}"))
    rows += [(900, *rows[4][1:]), (901, None, None), (902, "http://h0.example.com/", "")]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == brute_texts(rows)
    assert 0 < sum("text" in t for t in got.values()) < 120


def test_long_and_deep_pages(spark):
    deep = "<div>" * 20_000 + "deep" + "</b>" * 20_000 + "</div>" * 20_000
    long = "<p>" + "word " * 200_000 + "<p>end"
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame([(1, "http://x/", deep), (2, "http://x/", long)], PAGES)).collect()}
    assert got[1] == "deep" and got[2] == ("word " * 200_000).strip() + "\nend"


def test_repeated_rows_and_extra_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "http://h/", "<article>é &eacute;</article>")] * 3, PAGES).select("*", *[F.lit(1).alias(c) for c in ("rid", "host", "text", "blocks", "path")])
    rows = extract_main_text(df).collect()
    assert [(r["text"], r["n_chars"]) for r in rows] == [("é é", 3)] * 3


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for p, label in BASE.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(ws), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


TEXTS = ["MIT License", "the mit-license; CC BY CC by 4.0 cc\nby", "Apache  LICENSE, gnu general\tpublic license v3", "mit licenses", "é mit license é", "gnu general public license " * 50, "", None, "ccby cc by" + " x" * 1000, "apache license apache license"]


def test_base_phrases(spark, docs, empty, clashing):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    for r in license_scan(df).collect():
        t = TEXTS[r["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert license_scan(clashing).count() == docs.count()
    assert license_scan(empty).count() == 0


def hand_written():
    return len(license_rules._GRANTS) + sum(map(len, license_rules._NAMES.values()))


def test_rules():
    table = rules()
    assert hand_written() >= 400 and len(table) > hand_written()
    assert all(k in p.replace("\\", "").replace("[cs]", "c") or len(k) > 1 for _, k, p in table)
    scan = Scanner()
    found = {label for _, _, label, _ in scan.detections("Licensed under the GNU General Public License, version 2 or any later version. SPDX-License-Identifier: Apache-2.0\n * CC-BY-SA 4.0, BSD 3-Clause; Permission is hereby granted, free of charge, to any person obtaining a copy")}
    assert found == {"gpl-2.0-or-later", "apache-2.0", "cc-by-sa-4.0", "bsd-3-clause", "mit"}
    assert scan.detections("nothing to see") == []


def plain_detections(table, text):
    """Every rule on every text, and suppression pair by pair, as stated."""
    plain = re.sub(r"[\s]+(?:[*#;/]+[\s]+)*", " ", text.lower())
    found = [(m.start(), m.end(), i) for i, (_, _, p) in enumerate(table) for m in re.finditer(p, plain) if m.end() > m.start()]
    inside = lambda x, y: y[0] <= x[0] and x[1] <= y[1] and ((x[0], x[1]) != (y[0], y[1]) or y[2] < x[2])
    outer = sorted({x for x in found if not any(inside(x, y) for y in found if y != x)})
    kept = []
    for x in outer:  # from left to right, a weaker one gives way to a stronger one that it meets
        while kept and kept[-1][1] > x[0] and kept[-1][2] > x[2]:
            kept.pop()
        if not kept or kept[-1][1] <= x[0]:
            kept.append(x)
    return [(a, b, table[i][0]) for a, b, i in kept]


def test_rules_against_brute_force():
    """The gate loses nothing and suppression does as it says, on texts made of what the rules look for."""
    table, scan, rng = rules(), Scanner(), random.Random(12)
    simple = [re.sub(r"\\([.+()])", r"\1", p.replace("\\b", "").replace("licen[cs]e", "license")) for _, _, p in table]
    simple = [p for p in simple if not re.search(r"[\[\]{}?|*\\]", p)] + ["MPL 2.0", "EPL-1.0", "LGPLv2.1", "https://creativecommons.org/licenses/by-nc/4.0", "The Unlicense", "GNU Library General Public Licence", "GNU General Public License, version 2 or any later version"]
    assert len(simple) > 150
    some = 0
    for _ in range(400):
        text = "".join(rng.choice(simple) + rng.choice((" ", " ", ", ", "\n * ", " and the ", ". ", "-", "/")) for _ in range(rng.randint(1, 6)))
        got = [x[:3] for x in scan.detections(text)]
        assert got == plain_detections(table, text), text
        some += len(got)
    assert some > 500


def test_score():
    scores = {}
    df = [(0, "none"), (1, "mit license"), (2, "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"), (3, "isc license")]
    for i, text in df:
        found = Scanner().detections(text)
        longest = Scanner().base_places(text.lower().encode())[4]
        scores[i] = 1 - 0.5 ** (max([longest, *(x[3] for x in found)]) / 2)
    assert scores[0] == 0 and scores[1] == 0.5 and scores[2] > 0.95 and 0.3 <= scores[3] <= 0.7


def test_long_texts(spark):
    long = "word " * 300_000 + "MIT License " + "word " * 300_000 + "cc by"
    r = license_scan(spark.createDataFrame([(1, long)], "doc_id bigint, text string")).first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (600_004, 2, 300_000, 600_002, "cc-by,mit")


def test_suppression():
    assert resolve([(0, 10, 5), (2, 8, 1), (0, 10, 3)]) == [(0, 10, 3)]
    assert resolve([(0, 6, 2), (4, 9, 1), (9, 12, 8)]) == [(4, 9, 1), (9, 12, 8)]
    assert resolve([(0, 6, 1), (4, 9, 2), (8, 11, 3)]) == [(0, 6, 1), (8, 11, 3)]
    assert resolve([]) == []
