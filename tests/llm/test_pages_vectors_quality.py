import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from callweave.llm import quality
from callweave.llm.html_text import extract, read_page
from callweave.llm.topk_search import top_k_search

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="<p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy &amp; win</div>
<article class="post"><h1>Head &amp; more</h1><p><b>First   line.<br><p>Second&nbsp;line <i>here</i>.</p>
<div class="cookie-notice">We use cookies</div><aside>See also</aside><form><p>Your name</p></form><!-- x > y -->
<section><p>Third &lt;b&gt; &#233;</p><span class="share">Share</span> tail</section><div class="comments"><article><p>Nice!</p></article></div>
<a title="a > b">link</a></article><footer>&copy; us</footer></body></html>"""


def inside(page):
    return [text for within, text in read_page(page)[0] if within]


def test_marked_page():
    found, marked = read_page(PAGE)
    assert marked and inside(PAGE) == ["Head & more", "First line.", "Second line here.", "Third <b> é", "tail", "link"]
    assert {"Home", "Buy & win", "© us", "Nice!"} <= {text for within, text in found if not within}


def test_main_with_teaser_articles_keeps_its_story():
    story, teaser = "<h1>Head</h1><p>" + "A long story. " * 9 + "</p>", "<article><p>Read on</p></article>"
    told = ["Head", ("A long story. " * 9).strip()]
    assert inside(f"<main>{story}{teaser}</main>") == told + ["Read on"]
    assert inside(f"<main>{story}</main>{teaser}") == told
    assert inside(f"<main>{story}</main>{teaser * 50}") == told
    assert inside(f"<main>{story}{teaser * 50}</main>") == told + ["Read on"] * 50
    assert inside(f"<main><p>Crumbs</p><article>{story}</article></main>") == told
    assert inside(f"<main><p>Crumbs</p></main><article>{story}</article>") == told
    assert inside(f"<div role='main' class='content has-sidebar'>{story}<div class='sidebar'>Links</div></div>") == told
    assert read_page(f"<article class='comment'>{teaser}</article><p>x</p>")[1] is False


def test_class_names_count_whole_and_never_against_most_of_the_text():
    story = "<p>" + "A long story. " * 9 + "</p>"
    told = [("A long story. " * 9).strip()]
    for name in ("post has-sidebar", "social-studies", "comment-on-budget", "share-price-news", "sidebar", "related content"):
        assert inside(f'<article><div class="{name}">{story}</div><div class="share-buttons">Share</div></article>') == told, name
        assert inside(f'<div class="{name}">{story}</div><div id="ad-slot-12">Buy</div>') == told, name
    for name in ("comments", "comment-list", "reply_form", "respond"):
        assert inside(f'<article><p>Short.</p><div class="{name}">{story}</div></article>') == ["Short."], name
    for name in ("ad-slot-1", "sidebar left", "share_bar", "cookie-notice", "newsletter-box"):
        assert inside(f'<article>{story}<div class="{name}"><p>Beside it.</p></div></article>') == told, name
    assert inside("<!-- <article> --><p>a</p><scr" + "ipt>'<main>'</scr" + "ipt><div class='menu'>b</div>") == ["a"]


def brute_host(pages, run=6):
    """Texts of (host, html) pages, judged from all repeated runs of whole blocks held in memory."""
    read = [(host, *read_page(h)) for host, h in pages]
    bodies, contents, owners = [], set(), defaultdict(set)
    for host, found, marked in read:
        texts = [t for within, t in found if within]
        words = " ".join(texts).encode().split(b" ")
        grams = {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}
        bodies.append((tuple(texts), min(map(xxhash.xxh3_64_intdigest, grams)), min(map(xxhash.xxh64_intdigest, grams))))
        contents.add((host, tuple(texts)))
    spans = []
    for (host, found, marked), body in zip(read, bodies):
        mine = []
        for a in range(len(found)):
            b = next((e for e in range(a + 1, len(found) + 1) if sum(len(t.split(" ")) for _, t in found[a:e]) >= run), None)
            if b and not (marked and any(within for within, _ in found[a:b])):
                key = (host, tuple(t for _, t in found[a:b]))
                owners[key].add(body)
                mine.append((key, a, b))
        spans.append(mine)
    spread = {}
    for (host, key), of in owners.items():
        n, k = len({x[0] for x in of}), min(len({x[i] for x in of}) for i in (1, 2))
        if k >= 2 and k >= n / 8 and k >= sum(h == host for h, _ in contents) / 200:
            spread[host, key] = k
    out = []
    for (host, found, marked), mine in zip(read, spans):
        cover = [max([spread.get(key, 0) for key, a, b in mine if a <= i < b], default=0) for i in range(len(found))]
        tokens = [(c, len(t.split(" "))) for (within, t), c in zip(found, cover) if within]
        covered, beyond = sorted(x for x in tokens if x[0]), 0
        if not marked and sum(n for _, n in covered) > 0.75 * sum(n for _, n in tokens):
            half, total = sum(n for _, n in covered) / 2, 0
            for c, n in covered:
                total += n
                if total >= half:
                    beyond = c
                    break
        out.append("\n".join(t for (within, t), c in zip(found, cover) if within and (marked or c <= beyond)))
    return out


def test_a_host_of_many_pages_against_brute_force(spark):
    rng = random.Random(12)
    sentence = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(n))
    stories = [[sentence(rng.randint(3, 40)) for _ in range(rng.randint(1, 6))] for _ in range(40)]
    boiler, quote = [sentence(9), "Home", "News of the day", sentence(12)], sentence(14)
    rows = []
    for i in range(160):
        story = list(rng.choice(stories))
        if i % 5 == 0:  # a copy with one token changed
            story[-1] += " changed" + str(i)
        if i % 40 == 0:
            story.append(quote)
        blocks = boiler[:3] + story + boiler[3:]
        if i % 3 == 0:
            html = "<div>" + "</div><div>".join(boiler[:3]) + "</div><article><p>" + "</p><p>".join(story + boiler[3:]) + "</p></article><footer>" + boiler[3] + "</footer>"
        else:
            html = "".join(f"<div>{b}</div>" for b in blocks)
        rows.append((i, f"http://{'big' if i % 8 else 'small'}.example/{i}", html))
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "page_id long, url string, html string, runs int, name string")
    got = {r.page_id: r.text for r in extract(docs).collect()}
    want = brute_host([(u.split("/")[2], h) for _, u, h in rows])
    assert got == dict(enumerate(want))
    plain = [i for i in range(160) if i % 3]
    assert all(boiler[0] not in got[i] and boiler[3] not in got[i].split("\n") for i in plain)
    # Marked articles keep all they hold; the stories of other pages come out whole, copied or not.
    assert all(got[i].endswith(boiler[3]) for i in range(160) if i % 3 == 0)
    assert sum(bool(got[i]) for i in plain) == len(plain)


def page(*blocks):
    return "<html><body><div class='menu'>Home News</div>" + "".join(f"<div>{b}</div>" for b in blocks) + "</body></html>"


def test_pages_without_a_mark_lose_what_their_host_repeats(spark):
    boiler = "All rights reserved by the owners of this site since 1999"
    rows = [(i, "http://h.example/%d" % i, page(f"Story number {i} about thing {i * 3} told only once {i}", boiler)) for i in range(5)]
    rows += [(10, "http://other.example/x", page("Lonely story here on its own host today", boiler)), (11, "http://c.example/1", page("one two three four five six seven")),
             (12, "http://c.example/2", page("one two three four five six seven", "x")), (13, None, None), (None, "http://h.example/n", PAGE), (14, "http://h.example/0", rows[0][2]),
             (15, "u", "plain &amp; simple"), (16, "u", "<scr" + "ipt>'<article>'</scr" + "ipt><p>kept</p>"), (17, "u", "<article>a<p>b"), (17, "u", "<article>a<p>b"), (18, "u", "<p>" + "word " * 50000)]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "page_id long, url string, html string, content int, names string")
    got = sorted(((r.page_id, r.text) for r in extract(docs).collect()), key=str)
    text = dict(got)
    assert text[0] == "Story number 0 about thing 0 told only once 0" == text[14]
    assert text[10] == "Lonely story here on its own host today\n" + boiler
    assert text[11] == "one two three four five six seven"
    assert text[12] == "one two three four five six seven\nx"  # a copy keeps its text
    assert text[13] == "" and text[15] == "plain & simple" and text[16] == "kept" and text[17] == "a\nb"
    assert text[18] == "word " * 49999 + "word" and len(got) == len(rows)
    assert text[None].startswith("Head & more\nFirst line.")
    assert extract(docs.limit(0)).collect() == []


def brute_search(rows, k):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    pad = lambda a, n: np.pad(a, (0, n - len(a)))
    out = []
    for q, a in ok:
        if q % 50 == 0:
            scored = sorted((-int(pad(a, 9) @ pad(b, 9)), i) for i, b in ok if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,group,at_once", [(4, 2, 2), (512, 16, 4096)])
def test_search(spark, block, group, at_once):
    rng = random.Random(1)
    rows = [(i * 5, [rng.choice([-0.5, 0.25, 0.1, 1.0]) for _ in range(5)]) for i in range(150)]
    rows += [(None, [1.0] * 5), (3, None), (4, [1.0, None]), (6, [float("nan")] * 5), (7, [float("inf")] * 5), (8, [1.0]), (9, []), (8, [1.0]), (11, [2.0] * 9)]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<float>, vector string, row int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = top_k_search(docs, "vec_id % 50 = 0", k=5, block=block, group=group, queries_at_once=at_once).collect()
    assert sorted(map(tuple, got)) == brute_search(rows, 5)
    assert top_k_search(docs.limit(0), "vec_id % 50 = 0").collect() == []


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.85
    n = len(quality.LABELLERS)
    votes = np.ones((len(truth), n), int)
    for k in range(n):
        bad_vote = np.where(truth, rng.random(len(truth)) < 0.001, rng.random(len(truth)) < 0.3 + 0.05 * k)
        votes[:, k] = np.where(rng.random(len(truth)) < 0.2, 1, np.where(bad_vote, 0, 2))
    codes, inverse, counts = np.unique(votes @ 3 ** np.arange(n - 1, -1, -1), return_inverse=True, return_counts=True)
    good, table, prior = quality.fit_labels(codes, counts.astype(float))
    assert abs(prior - 0.85) < 0.02 and ((good[inverse] > 0.5) == truth).mean() > 0.97
    assert all(abs(table[0, k, 0] - (0.3 + 0.05 * k)) < 0.05 for k in range(n))


def test_classifier_on_given_labels_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs)
    held = quality.scores(docs, model).join(labels, "doc_id").collect()  # the labels took no part in the fit
    wrong = [r for r in held if (r.score >= 0.5) != (r.quality == 1)]
    assert len(wrong) <= 0.01 * len(held) and not [r for r in wrong if r.quality == 1]
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "The end of it. " * 9, 3), (3, "A!! B!! CCC!! DD!! E!! FF!! " * 20, 4)], "doc_id long, text string, score int")
    assert [(r.doc_id, r.score) for r in quality.keep_good(odd, model).collect()] == [(None, 1), (1, 2), (1, 2), (2, 3)]
    known = quality.fit(odd)
    assert len(quality.scores(odd, known).collect()) == 5
    empty = odd.limit(0)
    assert quality.keep_good(empty, quality.fit(empty)).collect() == [] and quality.scores(empty, quality.fit(empty)).collect() == []


def test_training_sample_is_bounded_and_weighs_copies(spark, monkeypatch):
    sample, seen = 50, []
    rows = [(None,)] * 4000 + [("",)] * 3000 + [("A text that has very many copies. " * 3,)] * 2000 + [(f"Text {i} tells of number {i * 7}, once.",) for i in range(1000)]
    docs = spark.createDataFrame(rows, "text string").repartition(5)
    real = quality.fit_scorer
    monkeypatch.setattr(quality, "fit_scorer", lambda x, good, **more: seen.append((x, more["copies"])) or real(x, good, **more))
    quality.fit(docs, sample=sample)
    x, copies = seen[0]
    assert len(x) == len(copies) == sample and (x != 0).any(axis=1).all()  # null and empty texts have no feature
    assert copies.max() == 2000 and 500 < copies.sum() - 2000 < 2000  # the hot text once; the others stand for about 1000
    assert len(quality.draw(docs, 2000)) == 1001 and set(quality.draw(docs, 2000).values()) == {1.0, 2000.0}
