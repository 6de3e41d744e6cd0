"""Fitted operators: held-out accuracy, brute force and edge cases."""

import itertools
import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from pathloom.llm import html, langid, quality, toxicity

DATA = Path("/root/testdata/sf0.01")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def test_suffix_automaton_parses_like_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 25)))
        q = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 25)))
        a, n, i = langid.SuffixAutomaton(t), 0, 0
        while i < len(q):
            size = 0
            while i + size < len(q) and q[i : i + size + 1] in t:
                size += 1
            assert a.longest_match(q, i) == size
            i, n = i + max(size, 1), n + 1
        assert a.phrases(q) == n


def test_language_cases(spark):
    rows = [(k, "the and of ing " * 5 if k % 2 else "der und ein ich " * 5, "en" if k % 2 else "de") for k in range(1, 40)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !!", None), (103, "the ing of", None), (104, "und" * 5000, "de"), (103, "the ing of", None)]
    frame = spark.createDataFrame([(i, t, la, 9) for i, t, la in rows], "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in langid.identify(frame).collect()}
    assert [got[k]["lang_pred"] for k in (100, 101, 102, 103, 104)] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert langid.identify(frame).count() == len(rows)
    assert langid.identify(frame.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(frame.where("lang is null")).collect()} == {"und"}


def test_chain_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    chain = quality.Chain(3)
    chain.ties = rng.normal(size=(2, 2))
    counts, odds = np.array([3, 1, 5, 2]), rng.normal(size=11)
    got, at = chain.marginals(odds, counts), 0
    for n in counts:
        total, good = 0.0, np.zeros(n)
        for ys in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(odds[at + k] * y for k, y in enumerate(ys)) + sum(chain.ties[a, b] for a, b in zip(ys, ys[1:], strict=False)))
            total += w
            good += w * np.array(ys)
        assert np.allclose(good / total, got[at : at + n])
        at += n


def test_quality_cases(spark):
    good, bad = "A calm sentence of plain words stands here.\nAnother one follows it.", "BUY!! NOW!! CHEAP!!\n### %%% $$$ &&&"
    rows = [(k, f"{good} {k}." if k % 2 else f"{bad} {k}") for k in range(60)] + [(100, None), (101, ""), (102, "\n\n"), (103, "word " * 30000), (103, "word " * 30000)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(frame, labels).collect()}
    assert all(got[k]["predicted"] == k % 2 for k in range(60))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[100]["score"] == got[101]["score"]
    assert quality.classify(frame.limit(0), labels).count() == 0
    assert quality.classify(frame, labels.limit(0)).count() == len(rows)
    kept = quality.keep_good(frame, quality.learn(frame, labels))
    assert kept.columns == frame.columns and {k for k in range(60)} & {r["doc_id"] for r in kept.collect()} == set(range(1, 60, 2))


def test_nearest_examples_are_exact():
    rng = random.Random(2)
    examples = [(k, " ".join([rng.choice(["red", "blue", "green", "grey"])] * rng.randint(1, 3) + (["vile", "nasty"][: rng.randint(1, 2)] if k % 2 else ["mild"]) + [f"u{rng.randrange(9)}x"]), k % 2) for k in range(200)]
    index = toxicity.Index(examples, min_chi2=0.5, block=8, k=5)
    vectors = [index.vector(t) for _, t, _ in examples]
    for q in ("vile red blue", "nasty nasty mild", "green u3x", "mild"):
        which, weight = index.vector(q)
        dense = dict(zip(which.tolist(), weight.tolist(), strict=True))
        exact = sorted((round(sum(dense.get(t, 0) * w for t, w in zip(*(x.tolist() for x in v), strict=True)), 9) for v in vectors), reverse=True)
        assert np.allclose(index.nearest(which, weight)[1], [c for c in exact[:5] if c > 0], atol=1e-8)


def test_rare_words_of_a_large_sample_are_found():
    """Each toxic text has a word that few others share: far below a hundredth of the sample."""
    rng = random.Random(7)
    name = lambda k: "".join("abcdefghij"[int(x)] for x in f"{k:03}")
    plain = [name(k) + "some" for k in range(400)]
    vile = [name(k) + "vile" for k in range(400, 530)]
    examples = [(k, " ".join(rng.choices(plain, k=20) + ([vile[k // 2 % 130]] * 2 if k % 2 else [])), k % 2) for k in range(1500)]
    index = toxicity.Index(examples, share=0.1)
    assert len(index.terms) > 130
    assert all(index.score(" ".join(rng.choices(plain, k=20)) + f" {x} {x}")[0] > 0.5 for x in vile)
    assert np.mean([index.score(" ".join(rng.choices(plain, k=20)))[0] > 0.5 for _ in range(200)]) < 0.05


def test_toxicity_cases(spark):
    rows = [(k, f"some words here {'awful idiot' if k % 4 == 0 else 'and more'} number {k % 7}") for k in range(200)] + [(500, None), (501, ""), (502, "zzz"), (503, "idiot " * 30000), (503, "idiot " * 30000)]
    frame = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, evidence string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)] + [(None, 1)], "doc_id long, toxic int")
    got = toxicity.classify(frame, labels).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(by[k]["predicted"] == int(k % 4 == 0) for k in range(200))
    assert by[503]["predicted"] == 1 and by[500]["score"] == by[501]["score"] < 0.5 and by[0]["evidence"][0]["label"] == 1
    assert toxicity.classify(frame.limit(0), labels).count() == 0
    assert toxicity.classify(frame, labels.limit(0)).count() == len(rows)


@needs_data
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(str(DATA / f"{n}.parquet")) for n in ("documents", "labels"))
    lang = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in lang]) > 0.97
    q = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in q]) > 0.95
    t = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["toxic"] == r["predicted"] for r in t]) > 0.9


PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a>Home</a></nav>
<div class="ad">Buy this now please</div><article><h1>The  title &amp; more</h1><p>First para <b>bold</b><br>after break<p>Second &lt;p&gt; one</p>
<form>your mail <input></form><aside>related story here</aside></article><div id="comments"><p>nice post</p></div><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    w = html.learned()
    assert html.extract(PAGE, w) == "The title & more\nFirst para bold\nafter break\nSecond <p> one"
    assert html.extract(None, w) == html.extract("", w) == html.extract("<script>x</script>", w) == ""
    assert html.extract("plain text only", w) == "plain text only"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", "<p>" + "word " * 50000), (None, "w", "<p>no id but a text</p>")]
    frame = spark.createDataFrame([(*r, 3) for r in rows], "page_id long, url string, html string, text int")
    got = html.extract_table(frame).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 16), *[(1, len(html.extract(PAGE, w)))] * 2, (2, 0), (3, 249999)]
    assert html.extract_table(frame.limit(0)).count() == 0


def test_region_is_the_best_contiguous_stretch():
    w = html.learned()
    page = html.tokens("<div><a>menu</a></div>" + "<p>main words run on here</p>" * 3 + "<div><a>x</a><a>y</a></div>" * 6 + "<p>late</p>")
    scores = [w.of(t, False) for t in page]
    best = max(sum(scores[a:b]) for a in range(len(page)) for b in range(a + 1, len(page) + 1))
    a, b = html.region(page, w)
    assert sum(scores[a:b]) == pytest.approx(best)


STORY = "<p>The committee met on Monday to discuss the state of the bridge over the river and decided to repair it before winter.</p>"
STORY_TEXT = STORY[3:-4]


def test_the_scan_finds_the_text_between_containers_of_unknown_names():
    w = html.learned()
    page = f"""<body><div class=q1><ul><li><a href=x>Home</a></li><li><a>World</a></li></ul></div><div>Town Paper</div><div class=z9><h1>Bridge to be repaired</h1>{STORY * 3}
</div><div class=k2><h3>Archive</h3><ul><li><a>May</a></li><li><a>June</a></li></ul></div><div><div>Copyright 2024 Town Paper</div></div></body>"""
    assert html.extract(page, w) == "\n".join(["Bridge to be repaired", *[STORY_TEXT] * 3])
    assert "Copyright 2024 Town Paper" in html.extract(page, w, scan=False)


def test_stray_quotes_and_text_between_adverts():
    w = html.learned()
    assert html.extract("<p title=\"a\"\">first text stays here, a whole sentence</p><p title='>'>and so does this second one</p>", w) == "first text stays here, a whole sentence\nand so does this second one"
    many = "<aside><ul>" + "<li><a>related words here and more</a></li>" * 14 + "</ul></aside>"
    assert html.extract(f"<article>{STORY}{many}<p>A short end.</p></article>", w) == f"{STORY_TEXT}\nA short end."
    assert html.extract(f"<body>{STORY * 2}<aside>{'other words ' * 30}</aside>{STORY * 2}</body>", w) == "\n".join([STORY_TEXT] * 4)
    assert html.extract(f"<body>{STORY}<div><a>Related one</a> <a>Related two</a></div>{STORY}</body>", w) == f"{STORY_TEXT}\n{STORY_TEXT}"
    assert html.extract(f"<body>{STORY}<p>Read <a>the report</a> for more detail.</p>{STORY}</body>", w).split("\n")[1] == "Read the report for more detail."


def test_language_sample_has_long_texts_and_no_empty_ones(spark):
    rows = [(k, "lange Rede ohne Ende " * 1200, "de") for k in range(3)] + [(k, "", "fr") for k in range(10, 40)] + [(50, "une seule phrase", "fr")]
    got = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), docs_per_language=1)
    assert set(got) == {"de", "fr"} and "lange rede" in got["de"] and "une seule phrase" in got["fr"]
