"""HTML extraction and the licence scan against plain Python and planted cases."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

ARTICLE = "<h1>Title</h1><p>First paragraph, with commas, and enough words to count.</p><p>Second &amp; last,\n\t with&nbsp;an &lt;entity&gt;.<br>More.</p>"
WANT = "Title\nFirst paragraph, with commas, and enough words to count.\nSecond & last, with an <entity>. More."
PAGES = [
    (0, f"<html><body><nav><a href=/>Home</a></nav><article>{ARTICLE}</article><footer>f</footer></body></html>", WANT),
    (1, f"<body class='has-sidebar'><div id=header>Site</div><div class='cookie-notice'>Cookies, yes, please.</div><div class=post>{ARTICLE}</div><div class=sidebar><p>Some, other, things</p></div>", WANT),
    (2, f"<main>{ARTICLE}</main><section id=comments><article class=comment><p>Nice, long, comment, indeed, very.</p></article></section><form>x</form>", WANT),
    (3, None, ""), (4, "", ""), (5, "just text", "just text"), (6, "<script>var a='<p>no</p>';</script><style>p{}</style>", ""),
    (7, "<p><b>one, two<br><p>three<div class=ad>buy</div><!-- x --><p>fo<i>u</i>r", "one, two\nthree\nfour"),
    (8, f"<article>{ARTICLE}<ul><li><a href=1>Related one</a><li><a href=2>Related two</a><li><a href=3>Related three</a></ul></article>", WANT),
    (9, "<article><p>" + "long words here, " * 20_000 + "</p></article>", ("long words here, " * 20_000).strip()),
    (10, f"<article>{ARTICLE}</article><footer", WANT), (11, "<p>a" * 3000, "\n".join(["a"] * 3000)), (11, "<p>a" * 3000, "\n".join(["a"] * 3000)),
    (None, "<div><header><h2>x</h2></header><p>body, text</p></div>", "body, text"),
]


def test_main_text(spark):
    from assayer.llm.html import extract

    pages = spark.createDataFrame([(i, None, h, "clash") for i, h, _ in PAGES], "page_id long, url string, html string, text string")
    got = Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in extract(pages).collect())
    assert got == Counter((i, None, w, len(w)) for i, _, w in PAGES)
    assert extract(pages.where(F.lit(False))).collect() == []


TEXTS = [
    None, "", "No licence here at all.", "Released under the MIT License.", "mit license MIT-license x mit\nlicense", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0. and cc by", "émit license", "mit licenses", "gnu general public licence",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "redistribution of source", "word " * 30_000 + "Apache License " * 2_000, "Released under the MIT License.", "the license of the of the free software", "APKACHE license apache license",
]
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def plain(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(spark):
    from assayer.llm.licenses import scan_licenses

    docs = spark.createDataFrame([(None if i == 2 else i % 15, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string")
    rows = scan_licenses(docs).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows)
    assert got == Counter((None if i == 2 else i % 15, *plain(t)) for i, t in enumerate(TEXTS))
    labels = Counter((r["doc_id"], r["labels"]) for r in rows)
    assert labels[(5, "apache,apache-2.0")] and labels[(6, "gpl")] and labels[(7, "cc-by,cc-by-nc")] and labels[(11, "mit")] and labels[(12, "bsd")] and labels[(13, "")]
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "") for r in rows)
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in rows)
    assert scan_licenses(docs.where(F.lit(False))).collect() == []
    assert "Python" not in (plan := scan_licenses(docs)._jdf.queryExecution().toString()) and "Arrow" not in plan


def test_whole_notices_score_one_beside_rarer_words(spark):
    """A notice's share counts its own words, whatever rarer words of other notices the file holds."""
    from assayer.llm.licenses import NOTICES, VOCABULARY, scan_licenses

    others = ["affero", "any", "associated", "attribution", "binary", "can", "cc0", "charge"]
    idf = {w: 9.0 if w in others else 1.0 for w in VOCABULARY}
    docs = spark.createDataFrame([(k, " ".join([*others, "x", notice, "y"])) for k, (_, notice, _) in enumerate(NOTICES)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in scan_licenses(docs, idf).collect()}
    assert all(name in rows[k]["labels"].split(",") and rows[k]["score"] == 1 for k, (name, _, _) in enumerate(NOTICES))


def plain_labels(text):
    """Every beginning of every notice compared word by word."""
    from assayer.llm.licenses import AGREE, BARE, NOTICES, SHORT, SLACK

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    found = {}
    for label, notice, phrases in NOTICES:
        want = notice.split()
        for b in range(1 - len(want), len(words)):
            agree = sum(0 <= b + k < len(words) and words[b + k] == w for k, w in enumerate(want))
            low = max(0, b - SLACK)
            said = f" {' '.join(words[low : low + len(want) + 2 * SLACK])} "
            if agree >= AGREE * len(want) and any(f" {p} " in said for p in (*phrases, *SHORT.get(label, ()))):
                found[label] = max(found.get(label, 0), agree / len(want))
        if any(f" {p} " in f" {' '.join(words)} " for p in phrases):
            found.setdefault(label, BARE)
    base = plain(text)[-1]
    score = max([*found.values(), 0.5 if base else 0])
    return ",".join(sorted({*found, *base.split(",")} - {""})), round(score, 9)


def test_labels_come_through_agreeing_places(spark):
    """Labels and scores against every beginning of every notice: damaged, cut, repeated, mixed and only named notices."""
    import random

    from assayer.llm.licenses import NOTICES, scan_licenses

    rng, texts = random.Random(7), [t for t in TEXTS if t is None or len(t) < 5000]
    for _, notice, _ in NOTICES:
        words = notice.split()
        texts += [" ".join(words[rng.randrange(len(words)) :]), " ".join(words[: rng.randrange(len(words))]), " ".join([*words, "x"] * 3)]
        for rate in (0.1, 0.3, 0.5, 0.6, 0.7):
            texts.append(" ".join(rng.choice(["of", "the", "gpl", "mit", "x"]) if rng.random() < rate else w for w in words))
        shuffled = rng.sample(words, len(words))
        texts += [" ".join(shuffled), " ".join([*shuffled, *words, *rng.choice(NOTICES)[1].split()])]
    gpl = next(n for name, n, _ in NOTICES if name == "gpl")
    texts += [gpl.replace("gnu general public license", "gpl"), gpl.replace("gnu general public license", "licence"), "we compared the mozilla public license with others"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in scan_licenses(docs).collect()}
    assert got == {i: plain_labels(t) for i, t in enumerate(texts)}
    assert got[len(texts) - 3][0] == "gpl" and got[len(texts) - 2] == ("", 0) and got[len(texts) - 1] == ("mpl-2.0", 0.25)


def test_names_of_prose_and_deep_pages():
    """A paragraph goes only if every part of its name says so; nested elements cost time in proportion."""
    from assayer.llm.html import main_text

    def page(name):
        return main_text(f"<main><p>First paragraph, with words.</p><p class='{name}'>Body, of text.</p></main>")

    assert all(page(c).endswith("\nBody, of text.") for c in ("side-effects", "notice-of-rights", "searchResult")) and all("Body" not in page(c) for c in ("cookie-notice", "ad", "side"))
    assert main_text("<div>text, here" * 20_000).count("text, here") >= 1
