"""Fill-in-middle, language identification and Merkle manifests against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from prospect.llm import fim, language_id, merkle

DOC = "doc_id long, text string, lang string, source string, n_chars long, n long, tree string, row long, form string, part string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 2, "clash", "clash") for r in rows], DOC)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def key(row):
    return tuple((x is not None, str(x)) for x in row)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    pools = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(80)] for lang, letters in (("aa", "abcdeé"), ("bb", "bcxyzñ"), ("Zz", "жукёба"))}
    out = []
    for i in range(90):
        lang = ("aa", "bb", "Zz")[i % 3]
        text = "".join(rng.choice(pools[lang]) + rng.choice([" ", " ", ", ", "\n", "\n\n"]) for _ in range(rng.randint(3, 80)))
        out.append((i, text, lang, rng.choice(["web", None]), len(text)))
    out += [out[5], out[5], (200, None, "aa", "s", None), (201, "", None, None, 0), (202, "\n", "bb", "", 1), (203, "x <S> y\nz", "aa", "s", 9), (204, "1 2 3 !", None, "s", 7), (None, "line\nother", "aa", "s", 10), (None, "b\nb", "aa", "s", 3)]
    out += [(205, "𝄞\n" * 5 + "end", "bb", "s", 13), (206, "ab ñ\n" * 40_000, "bb", "s", 200_000), (207, "a" * 50_000, "aa", "s", 50_000), (5, "other text of an id", "bb", "s", 19)]
    return out


def cut_by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    first, middle, last = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, text, len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < 50 else "psm"
    made = f"<S>{last}<P>{first}<M>{middle}" if form == "spm" else f"<P>{first}<S>{last}<M>{middle}"
    return doc_id, text, len(units), form, len(first), len(middle), made


def test_fill_in_middle_against_slices(spark, rows):
    made = fim.transform(table(spark, rows))
    want = [cut_by_hand(r[0], r[1]) for r in rows]
    got = [tuple(r) for r in made.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    digests = [tuple(r) for r in fim.digests(made).collect()]
    assert sorted(digests, key=key) == sorted([(r[0], *r[2:6], sha(r[6]), sha(r[1])) for r in want], key=key)


def test_fill_in_middle_rates(spark, rows):
    docs = table(spark, rows)
    assert {r["form"] for r in fim.transform(docs, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fim.transform(docs, spm_share=0).collect()} == {"plain", "psm"}
    assert fim.digests(fim.transform(docs.limit(0))).collect() == []


def test_fill_in_middle_of_text_ids(spark):
    docs = spark.createDataFrame([("a", "1\n2\n3"), ("b", "1\n2\n3")], "doc_id string, text string")
    assert sorted(tuple(r) for r in fim.transform(docs).collect()) == [cut_by_hand(i, "1\n2\n3") for i in "ab"]


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        yield (level[i - 1], "") if i % 2 else ("", level[i + 1] if i + 1 < len(level) else "")
        i //= 2


def manifest_by_hand(rows):
    def leaf(r):
        return sha(*(field(x) for x in (r[0], r[3], r[2], r[4], r[1])))

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted(by[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in names}
    trees = {x: levels([leaf(r) for r in own[x]]) for x in names}
    top = levels([trees[x][-1][0] for x in names])
    out = []
    for k, x in enumerate(names):
        for i, r in enumerate(own[x]):
            path = [*siblings(trees[x], i), *siblings(top, k)]
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                node = leaf((*r[:4], r[4] + 1))
            for left, right in path:
                node = sha(left, node, right)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], sha(*(a + b for a, b in path)), node, node == top[-1][0]))
    return out


@pytest.mark.parametrize("depth", [10, 2, 1])
def test_manifest_against_a_plain_tree(spark, rows, monkeypatch, depth):
    monkeypatch.setattr(merkle, "LEVELS", depth)
    monkeypatch.setattr(merkle, "BLOCK", 1 << depth)
    got = [tuple(r) for r in merkle.manifest(table(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(manifest_by_hand(rows), key=key)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_full_blocks_and_single_leaves(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    for sizes in ([4], [1], [16, 1], [17, 4, 5], [3] * 6):
        rows = [(100 * k + i, f"t{i}", f"l{k}", None, i) for k, n in enumerate(sizes) for i in range(n)]
        got = [tuple(r) for r in merkle.manifest(table(spark, rows)).collect()]
        assert sorted(got) == sorted(manifest_by_hand(rows)), sizes


def test_manifest_of_nothing_and_of_text_ids(spark, rows):
    assert merkle.manifest(table(spark, rows).limit(0)).collect() == []
    named = spark.createDataFrame([("b", "x", "l", "s", 1), ("a", "y", "l", "s", 1)], "doc_id string, text string, lang string, source string, n_chars int")
    found = {r["doc_id"]: r for r in merkle.manifest(named).collect()}
    assert found["a"]["root"] == sha(*(sha(*(field(x) for x in r)) for r in (("a", "s", "l", 1, "y"), ("b", "s", "l", 1, "x"))))


def word_list(text):
    return [w[i : i + 64] for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for i in range(0, len(w), 64)]


def gram_list(word, size):
    marked = word if size == 1 else f" {word} "
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


def languages_by_hand(rows, most_words, most_grams):
    counts, parts = {}, {}
    for doc_id, text, lang, *_ in rows:
        if lang is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 != 1:
            counts.setdefault(lang, Counter()).update(word_list(text))
    counts = {lang: c for lang, c in counts.items() if c}
    langs = sorted(counts, key=lambda x: (-sum(counts[x].values()), x))
    for lang, own in counts.items():
        for word, n in own.items():
            for size in range(1, 6):
                for g in gram_list(word, size):
                    parts.setdefault((size, lang), Counter())[g] += n

    def logs(counter, most):
        total, room = sum(counter.values()), max(1, most // max(1, len(langs)))
        return {x: math.log(n / total) for x, n in counter.items() if n * room >= total}, math.log(1 / room)

    known = {lang: logs(counts[lang], most_words) for lang in langs}
    of_parts = {k: logs(c, most_grams) for k, c in parts.items()}
    out = []
    for doc_id, text, *_ in rows:
        held = doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 == 1
        own = Counter(word_list(text))
        if not own or not langs:
            out.append((doc_id, held, "und", 0.0))
            continue
        sums = dict.fromkeys(langs, 0.0)
        for word, n in own.items():
            if any(word in known[x][0] for x in langs):
                for x in langs:
                    sums[x] += n * known[x][0].get(word, known[x][1])
                continue
            for size in range(5, 0, -1):
                grams = gram_list(word, size)
                if any(g in of_parts[size, x][0] for g in grams for x in langs):
                    for x in langs:
                        sums[x] += n * sum(of_parts[size, x][0].get(g, of_parts[size, x][1]) for g in grams) / len(grams)
                    break
        best = max(langs, key=lambda x: sums[x])
        out.append((doc_id, held, best, 1 / sum(math.exp(sums[x] - sums[best]) for x in langs)))
    return out


@pytest.mark.parametrize("room", [1 << 16, 60])
def test_language_id_against_dictionaries(spark, rows, monkeypatch, room):
    """Also with so little room that most words are left to n-grams, and most of these to shorter ones."""
    docs = table(spark, rows)
    learned = docs.where(language_id.F.col("lang").isNotNull() & ~language_id.held_out(language_id.F.col("doc_id"))).select("lang", "text")
    model = language_id.train(learned, room, room)
    assert len(model.known.log) <= room and all(len(t.log) <= room for t in model.parts.values())
    got = [tuple(r) for r in language_id.predict(docs, model).select("doc_id", language_id.held_out(language_id.F.col("doc_id")), "lang_pred", "score").collect()]
    want = languages_by_hand(rows, room, room)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda r: key(r[:3])), sorted(want, key=lambda r: key(r[:3]))):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-3


def test_language_id_of_held_out_and_odd_rows(spark, rows):
    found = language_id.rate(table(spark, rows)).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    held = [r for r in rows[:90] if by[r[0]]["held_out"]]
    assert len(held) > 20 and sum(by[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (200, 201, 202, 204))
    assert by[206]["lang_pred"] == "bb" and by[207]["lang_pred"] == "aa"


def test_language_id_without_learning(spark, rows):
    none = table(spark, [(i, t, None, s, n) for i, t, _, s, n in rows[:6]])
    assert {(r["lang_pred"], r["score"]) for r in language_id.rate(none).collect()} == {("und", 0.0)}
    assert language_id.rate(table(spark, rows).limit(0)).collect() == []


def test_caches_do_not_change_scores(spark, rows, monkeypatch):
    docs = table(spark, rows)
    want = sorted(map(tuple, language_id.rate(docs).collect()), key=key)
    monkeypatch.setattr(language_id, "CACHED", 5)
    monkeypatch.setattr(language_id, "STEP", 7)
    monkeypatch.setattr(language_id, "HELD_ENTRIES", 3)
    got = sorted(map(tuple, language_id.rate(docs).collect()), key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want))
