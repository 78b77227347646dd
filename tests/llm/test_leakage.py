"""Leaked passages, against brute force."""

import random
import re
import unicodedata

import numpy as np
import pytest

L = pytest.importorskip("tickloom.llm.leakage")
WORDS = "harbour court lease fence tunnel crane deposit boundary licence pension audit ledger mooring boiler invoice tender".split()
HAN = "法院判决码头租约押金桥梁锅炉水渠账册仓库许可围墙证人"


def brute(docs, items, words=8, chars=20):
    n = lambda t: unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).casefold())
    out = set()
    for i, lang, p in items:
        if i is None or p is None:
            continue
        u = re.findall(r"[^\W_]+", n(p))
        char = lang in ("zh", "ja")
        u, size = ("".join(u), chars) if char else (u, words)
        grams = {tuple(u[a : a + size]) for a in range(len(u) - size + 1)}
        for d, t in docs:
            if d is None or t is None:
                continue
            v = re.findall(r"[^\W_]+", n(t))
            v = "".join(v) if char else v
            if any(tuple(v[a : a + size]) in grams for a in range(len(v) - size + 1)):
                out.add((d, i))
    return out


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, lang string, passage string")
    return {(r.doc_id, r.item_id) for r in L.find_leaks(d, i, **kw).collect()}


def made(seed):
    rnd = random.Random(seed)
    items = [(i, rnd.choice(["en", "de", None]), " ".join(rnd.choice(WORDS) for _ in range(30))) for i in range(12)]
    items += [(100 + i, rnd.choice(["zh", "ja"]), "".join(rnd.choice(HAN) for _ in range(60))) for i in range(6)]
    docs = []
    for d in range(80):
        i, lang, p = rnd.choice(items)
        char = lang in ("zh", "ja")
        u = list(p) if char else p.split()
        n = rnd.choice([19, 20, 21, 40] if char else [6, 7, 8, 9, 20])
        a = rnd.randrange(len(u) - n + 1) if n < len(u) else 0
        part = u[a : a + n]
        text = "".join(x + rnd.choice(["", "，", "\n", " "]) for x in part) if char else "".join(x.upper() * (w := rnd.random() < 0.2) or x for x in [y + rnd.choice([" ", ", ", "\n", " - "]) for y in part])
        noise = " ".join(rnd.choice(WORDS) for _ in range(20)) if rnd.random() < 0.5 else "".join(rnd.choice(HAN) for _ in range(30))
        docs.append((d, f"{noise} | {text} | {noise}"))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    docs, items = made(seed)
    want = brute(docs, items)
    assert want and run(spark, docs, items) == want
    assert run(spark, docs, items, block_items=4, characters=50, radius=0) == want


def test_forms_of_text(spark):
    p = "Straße école cafés über naïve façade señor garçon"
    items = [(1, "de", p), (2, "en", "too short a passage"), (3, "en", None), (None, "en", p), (4, "en", ""), (1, "de", p)]
    docs = [(1, unicodedata.normalize("NFD", p).upper()), (2, p.replace(" ", "\n— ")), (3, p.replace("naïve", "naive")), (4, None), (5, ""), (6, "x " * 50_000 + p), (None, p), (7, p.replace(" ", "")), (1, p)]
    assert run(spark, docs, items) == {(1, 1), (2, 1), (6, 1)}


def test_documents_do_not_run_together(spark):
    p = " ".join(WORDS[:8])
    assert run(spark, [(1, " ".join(WORDS[:4])), (2, " ".join(WORDS[4:8]))], [(1, "en", p)]) == set()
    h = HAN[:20]
    assert run(spark, [(1, h[:10]), (2, h[10:])], [(1, "zh", h)]) == set()


def test_empty(spark):
    docs, items = made(1)
    assert run(spark, [], items) == run(spark, docs, []) == set()


def test_all_fingerprints_within_the_radius_are_found():
    rnd = np.random.default_rng(3)
    docs, items = made(5)
    ix = L.Index([(i, p) for i, g, p in items if g not in ("zh", "ja")], 8, False, 3, 1.0)
    prints = np.concatenate([ix.prints[:50] ^ np.uint64(sum(1 << int(b) for b in rnd.choice(64, k, replace=False))) for k in range(6)])
    got = set(ix._candidates(prints))
    want = {(a, b) for a in range(len(prints)) for b in range(len(ix.prints)) if bin(int(prints[a] ^ ix.prints[b])).count("1") <= 3}
    assert got == want and len(list(ix._candidates(prints))) == len(got)


def test_similar_windows(spark):
    p = " ".join(f"w{i}" for i in range(8))
    one_off = p.replace("w7", "v7")
    assert run(spark, [(1, one_off)], [(1, "en", p)]) == set()
    assert run(spark, [(1, one_off)], [(1, "en", p)], similarity=0.7, radius=20) == {(1, 1)}


def test_windows_of_the_size_of_an_item(spark):
    """Whole passages with a word altered come out by similarity; at the size of a leak only what is equal does."""
    rnd = random.Random(8)
    p = [f"w{rnd.randrange(10_000)}" for _ in range(40)]
    altered = [*p[:20], "other", *p[21:]]
    far = [w if i % 4 else "other" for i, w in enumerate(p)]
    docs = [(1, "before it " + " ".join(altered) + " after it"), (2, " ".join(far)), (3, " ".join(p[:30]))]
    items = [(1, "en", " ".join(p))]
    assert run(spark, docs, items, words=40, similarity=0.8, radius=12) == {(1, 1)}
    assert run(spark, docs, items) == {(1, 1), (3, 1)} == brute(docs, items)


def test_many_items_take_one_scan(spark):
    items = spark.range(20_000).selectExpr("id AS item_id", "'en' AS lang", "concat_ws(' ', transform(sequence(0, 9), x -> concat('w', id, 'x', x))) AS passage")
    docs = spark.range(100).selectExpr("id AS doc_id", "concat('so ', concat_ws(' ', transform(sequence(1, 8), x -> concat('w', id * 7, 'x', x))), ' it was') AS text")
    out = L.find_leaks(docs, items)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(r.doc_id, r.item_id) for r in out.collect()} == {(i, 7 * i) for i in range(100)}
