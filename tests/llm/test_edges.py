"""Verdicts, positions and records in the cases that a single rule decides."""

import random
import zlib
from statistics import median_low

import numpy as np
import pytest

from prospect.llm import flat, html_extract, license_scan, quality, secrets, warc


def plain(df):
    return [r.asDict() for r in df.collect()]


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_quality_bands_and_verdicts_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(40, 160)), ("xx", "xx", "xx", "yy")[i % 4]) for i in range(160)]
    rows += [(300 + i, prose(rng, 60, "klmnop"), "zz") for i in range(3)] + [(200, prose(rng, 80), None), (201, None, "xx"), (202, "few words", "none"), (203, prose(rng, 90, [chr(c) for c in range(0x400, 0x500)]), "xx"), (204, "ab cd ef " * 60, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = plain(quality.rate(docs))
    nats = {r["doc_id"]: np.log(r["perplexity"]) for r in got if r["perplexity"] is not None}
    length = {i: len(t) for i, t, _ in rows if t}
    good = {r["doc_id"] for r in got if not r["base_failed"]}
    lang = {i: x for i, _, x in rows}

    def step(x, s):
        return int(np.floor(x / s + 0.5)) * s

    def measured(ids):
        mid = median_low([step(nats[i], 1e-4) for i in ids])
        return mid, median_low([step(abs(nats[i] - mid) * length[i] ** 0.5, 1e-3) for i in ids])

    every = measured(sorted(good))
    for r in got:
        own = [i for i in good if lang[i] == r["lang"]]
        mine, n = (measured(own) if own else (0.0, 0.0)), len(own)
        mid, mad = ((n * a + 20 * b) / (n + 20) for a, b in zip(mine, every))
        if r["doc_id"] not in nats:
            assert not r["kept"]
            continue
        half = 0.05 + 4 * max(1.4826 * mad, 0.75) / length[r["doc_id"]] ** 0.5
        inside = abs(nats[r["doc_id"]] - mid) <= half
        assert r["kept"] == (inside and not r["base_failed"]), r
        assert abs(np.log(r["lower"]) - (mid - half)) < 1e-6 and abs(np.log(r["upper"]) - (mid + half)) < 1e-6
    by = {r["doc_id"]: r for r in got}
    assert not by[203]["kept"] and not by[203]["base_failed"] and by[204]["base_failed"]


def test_quality_bands_change_smoothly_with_the_texts(spark):
    """One more text moves a language's band by little, wherever it stands."""
    rng = random.Random(5)
    base = [(i, prose(rng, 100), "xx") for i in range(60)]
    more = [(100 + i, prose(rng, 100, "abcdefghijkl"), "yy") for i in range(22)]
    uppers = []
    for n in (18, 19, 20, 21):
        docs = spark.createDataFrame([*base, *more[:n]], "doc_id long, text string, lang string")
        uppers.append(np.log(next(r for r in plain(quality.rate(docs)) if r["doc_id"] == 100)["upper"]))
    assert max(abs(a - b) for a, b in zip(uppers, uppers[1:])) < 0.02


def test_secrets_every_run_is_a_candidate():
    text = "a kQzRtWxPaVnLsdFgHjYbUcMeXoTiNwZq b 1234567890123456 c ================ d short"
    assert [text[a:b] for a, b in secrets.candidates(text)] == ["kQzRtWxPaVnLsdFgHjYbUcMeXoTiNwZq", "1234567890123456", "================"]
    assert "learned" in [k for _, _, k in secrets.spans(["the key is kQzRtWxPaVnLsdFgHjYbUcMeXoTiNwZq here"], secrets.trained())[0]]
    calm = ["internationalisation und donaudampfschifffahrt", "=" * 60, "Kraftfahrzeughaftpflichtversicherung.", "usr/share/documentation/readme"]
    assert [x for x in secrets.spans(calm, secrets.trained()) if x] == []


def test_secret_findings_are_what_a_scan_reads():
    windows, truth = secrets.labelled(400, seed=9)
    assert len(windows) == len(truth) == 400 and all(len(w) == secrets.WIDTH for w in windows)


def test_secret_spans_against_all_pairs():
    """Of candidates and fixed spans in any order and overlap, those within a fixed span are not read."""
    rng = random.Random(8)
    net = secrets.trained()
    for _ in range(60):
        parts = [rng.choice(["password=", "token: ", "AKIA", "", " ", '"', "\n"]) + "".join(rng.choice("abcdef0123456789XYZ+/_.=-") for _ in range(rng.randint(1, 60))) for _ in range(8)]
        text = rng.choice([" ", "", ","]).join(parts)
        base = secrets.base_spans(text)
        want = {(a, b) for a, b in secrets.candidates(text) if not any(s <= a and b <= e for s, e, _ in base) and max(net.chances(secrets.classes(secrets.windows_of(text, a, b)))) >= net.threshold}
        assert {(a, b) for a, b, k in secrets.spans([text], net)[0] if k == "learned"} == want


def test_secrets_of_many_digests_take_linear_time():
    import hashlib
    import time

    def text(n):
        return "\n".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(n))

    took = []
    for n in (4_000, 32_000):
        t, start = text(n), time.process_time()
        assert len(secrets.spans([t], secrets.trained())[0]) == n
        took.append(time.process_time() - start)
    assert took[1] < 24 * took[0] + 0.5


def test_licenses_of_ids_of_any_kind(spark):
    rows = [("doc-1", "Released under the MIT License.", "web"), (None, "no licence", "web"), (None, "Released under the MIT License.", None), ("40", "Released under the MIT License.", "web"), ("41", "words", "web"), ("doc-1", "Released under the MIT License.", "web")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    files = license_scan.as_files(docs)
    paths = {(r["doc_id"], r["path"]) for r in files.collect()}
    n = zlib.crc32(b"doc-1")
    name = "LICENSE" if n % 20 == 0 else "doc-1.txt"
    assert paths == {("doc-1", f"web/{n // 400}/{n // 20}/{name}"), (None, "web/unnamed.txt"), (None, "unknown/unnamed.txt"), ("40", "web/0/2/LICENSE"), ("41", "web/0/2/41.txt")}
    found = license_scan.scan(files)
    assert found.count() == len(rows)
    by = {(r["doc_id"], r["path"]): r for r in found.collect()}
    assert by["41", "web/0/2/41.txt"]["found"] == "inherited" and by["41", "web/0/2/41.txt"]["license"] == "MIT"
    assert by[None, "unknown/unnamed.txt"]["found"] == "own" and by[None, "web/unnamed.txt"]["found"] == "none"


def test_licenses_rows_do_not_mix(spark):
    """Rows of one path keep their own texts' licences."""
    rows = [(f"a/{i % 3}.txt", "Released under the MIT License." if i % 2 else "Licensed under CC BY 4.0.", i) for i in range(40)]
    found = license_scan.scan(spark.createDataFrame(rows, "path string, text string, i int").repartition(7))
    assert {r["i"]: r["license"] for r in found.collect()} == {i: "MIT" if i % 2 else "CC-BY-4.0" for i in range(40)}


def test_warc_pages_without_an_id(spark):
    rows = [(3, "u", "<p>same"), (5, "u", "<p>same"), (None, None, "<p>same"), (None, "u", None), (7, "u", ""), (None, "u", "only")]
    got = plain(warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got) == sorted(
        [("3", "response", None, 7), ("5", "revisit", 3, 7), ("None", "revisit", 3, 7), ("None", "revisit", 7, 0), ("7", "response", None, 0), ("None", "response", None, 4)]
    )


def test_warc_changed_payloads_are_noticed(spark):
    pages = spark.createDataFrame([(i, "http://a/b", f"<p>page {i} of some</p>") for i in range(6)], "page_id long, url string, html string").coalesce(1)
    files = warc.write(pages)
    uri = files.first()["file"]
    with flat.open_file(uri) as f:
        data = f.read()
    assert warc.read_records(files).count() == 6
    path = uri.removeprefix("file://").removeprefix("file:")
    with open(path, "wb") as f:
        f.write(data.replace(b"page 3 of", b"page 8 of"))
    with pytest.raises(Exception, match="not what its headers state"):
        warc.read_records(files).collect()


CHROME = ["cookie-consent-banner", "site-nav", "share-buttons", "sidebar", "ad-box", "newsletter-signup-form", "comments-list", "social-share-bar", "footer-links", "gdpr-notice", "user-comments", "top-menu"]
NEUTRAL = ["content", "story", "col-8", "text", "wrapper", "post-body", "adventure", "main-part", "navigator-story", "shared"]


def built(rng, depth=0, inside=False, in_chrome=False):
    """Markup of a random tree, with the blocks that it gives the article, by its own walk."""
    markup, blocks = "", []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        words = prose(rng, rng.randint(1, 6))
        if kind < 0.45 or depth > 3:
            tag = rng.choice(["p", "li", "blockquote", "h2"])
            first, _, last = words.partition(" ")
            markup += rng.choice([f"<{tag}>{words}</{tag}>", f"<{tag}><b>{first}</b> {last}</{tag}>", f"<{tag}>{first} <a href='/x'>{last}</a> \n</{tag}>"])
            blocks += [("chrome" if in_chrome else "main" if inside else "open", words)]
        elif kind < 0.6:
            name = rng.choice(CHROME)
            more, found = built(rng, depth + 1, inside, True)
            markup += rng.choice([f'<div class="{name}">{more}</div>', f"<div id='{name}'>{more}</div>", f"<nav>{more}</nav>", f"<aside>{more}</aside>", f"<form>{more}</form>"])
            blocks += found
        elif kind < 0.85:
            more, found = built(rng, depth + 1, inside, in_chrome)
            tag = rng.choice(["div", "section"])
            markup += f'<{tag} class="{rng.choice(NEUTRAL)}">{more}</{tag}>'
            blocks += found
        else:
            markup += f"<script>{words}</script><!-- {words} -->"
    return markup, blocks


def test_html_structure_against_a_walk_of_random_trees():
    rng = random.Random(6)
    for _ in range(400):
        parts, want = [], []
        for _ in range(rng.randint(1, 3)):
            inside = rng.random() < 0.5
            markup, blocks = built(rng, 2, inside)
            parts.append(f"<article><h1>{'heading'}</h1>{markup}</article>" if inside else f"<div>{markup}</div>")
            want += [("main", "heading"), *blocks] if inside else blocks
        found = html_extract.blocks("<html><head><title>t</title></head><body>" + "".join(parts) + "</body></html>")
        assert found == want
        assert html_extract.marks_article(found) == any(k == "main" for k, _ in want)


def test_html_lengths_do_not_matter(spark):
    pages = [
        '<article><p>x</p></article><div id="cookie-consent-banner">We use cookies and say so at length</div>',
        '<article><h1>Short</h1><p>text</p></article><div class="related">a much longer list of other things to read <a href="/">one</a></div>',
        '<div><p>The text of the page.</p></div><article><h2><a href="/other">Another page</a></h2><p>about it</p></article>',
        '<article><div class="tag">news</div><h2><a href="/other">Another page</a></h2></article><p>The text of the page.</p>',
        '<main><article><h2><a href="/own">Its own address</a></h2><p>The text.</p></article></main><p>aside</p>',
        '<article><p>See <a href="/x">this</a>.</p><p><a href="/y">Link alone</a></p></article>',
    ]
    df = spark.createDataFrame([(i, f"http://h{i}.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()} == {
        0: "x", 1: "Short\n\ntext", 2: "The text of the page.\n\nAnother page\n\nabout it", 3: "news\n\nAnother page\n\nThe text of the page.",
        4: "Its own address\n\nThe text.", 5: "See this.\n\nLink alone",
    }


def test_html_repeated_strings_go_from_unmarked_pages_alone(spark):
    rng = random.Random(4)
    legal = "all rights reserved by the makers of this site since long ago"
    own = [prose(rng, 20) for _ in range(5)]
    rows = [(i, "http://same.org/x", f"<p>{own[i]} {legal}</p><p>subscribe to our paper</p>") for i in range(4)] + [(4, "http://same.org/y", f"<article><p>{own[4]} {legal}</p></article>")]
    # without a host no page speaks against another
    rows += [(10 + i, url, f"<p>{own[0]} {legal}</p>") for i, url in enumerate([None, "", "no address", "//x", None])]
    df = spark.createDataFrame([*rows, (None, "http://same.org/z", f"<p>{legal} new</p>")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert [got[i] for i in range(4)] == own[:4]
    assert got[4] == f"{own[4]} {legal}" and got[None] == "new"
    assert {got[10 + i] for i in range(5)} == {f"{own[0]} {legal}"}
