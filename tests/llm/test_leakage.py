"""Leak search against brute force over all windows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadloom.llm import leakage as L

WORDS = [f"w{i}" for i in range(60)] + ["the", "of", "and", "a"] * 3
HAN = "若滴度持续翻倍且伴夜间盗汗同时读数接近正确做法是遮盖弱视眼而非安排听力图不要归咎于粉刷走廊一位养蜂人在接触湿水泥后小时出现"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute(item, doc, zh):
    if zh:
        a, b = L.chars_of(L.normalise(item)), L.chars_of(L.normalise(doc))
        return any(a[i : i + 20] in b for i in range(len(a) - 19))
    a, b = L.words_of(L.normalise(item)), L.words_of(L.normalise(doc))
    runs = {tuple(a[i : i + 10]) for i in range(len(a) - 9)}
    if any(tuple(b[j : j + 10]) in runs for j in range(len(b) - 9)):
        return True
    for i in range(len(a) - 19):
        window, bag = a[i : i + 20], Counter(a[i : i + 20])
        for j in range(len(b)):
            if sum((bag & Counter(b[j : j + 23])).values()) >= 17 and any(edits(window, b[j : j + n]) <= 3 for n in range(17, 24) if j + n <= len(b)):
                return True
    return False


def mutate(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        kind = rng.choice("rdi")
        if kind == "r":
            words[k] = "zz"
        elif kind == "d":
            del words[k]
        else:
            words.insert(k, "qq")
    return words


@pytest.mark.parametrize("seed", range(4))
def test_same_as_brute_force(seed):
    rng = random.Random(seed)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.choice([5, 12, 30, 60]))), "en") for k in range(12)]
    items += [(100 + k, "".join(rng.choice(HAN) for _ in range(60)), "zh") for k in range(4)]
    shared = " ".join(rng.choice(WORDS) for _ in range(25))
    items += [(50, shared + " " + items[3][1], "de"), (51, items[2][1] + " " + shared, "es")]
    docs = []
    for _ in range(14):
        number, text, lang = rng.choice(items)
        noise = [rng.choice(WORDS) for _ in range(rng.choice([0, 3, 40]))]
        if lang == "zh":
            at, n = rng.randrange(40), rng.choice([18, 19, 20, 21, 40])
            docs.append("".join(rng.choice(HAN) for _ in range(30)) + text[at : at + n] + "，" + "".join(rng.choice(HAN) for _ in range(30)))
        else:
            words = text.split()
            at, n = rng.randrange(max(1, len(words) - 20)), rng.choice([8, 9, 10, 20, 24])
            docs.append(" ".join(noise + mutate(rng, words[at : at + n], rng.choice([0, 1, 3, 4, 5])) + noise))
    detector = L.Detector(items)
    for doc in docs:
        assert detector.leaks(doc) == sorted(n for n, text, lang in items if brute(text, doc, lang == "zh")), doc


def test_noise_makes_no_difference():
    item = "Which finding best separates skipping breakfast from a bout of measles in a ski patroller"
    found = L.Detector([(1, item, "en")]).leaks
    for doc in (
        item.upper(), item.replace(" ", "  \n"), "".join(c + "​" for c in item), item.replace("breakfast", "<b>break­fast</b>"), "> " + item.replace("from", "\n> from"),
        item.replace("best", "**best**").replace("bout", "_bout_"), "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in item), item.replace(" ", ", "), item.replace(" ", "&nbsp;"),
    ):
        assert found(doc) == [1], doc
    assert found(" ".join(item.split()[:9])) == [] and found(None) == [] and found("") == []


def test_wand_finds_all_above_threshold():
    rng = random.Random(3)
    texts = [[rng.choice(WORDS) for _ in range(40)] for _ in range(300)]
    index = L.Bm25Index(10, 20, 3).build(texts)
    by_item = [dict() for _ in texts]
    for term, t in index.terms.items():
        for k, w in zip(index.items[t], index.weights[t]):
            by_item[k][t] = w
    for _ in range(60):
        terms = index.lookup([rng.choice(WORDS) for _ in range(30)]).tolist()
        want = [k for k, weights in enumerate(by_item) if sum(weights.get(t, 0) for t in set(terms)) >= 1]
        assert sorted(index.search(terms)) == want


def test_find_leaks(spark):
    text = " ".join(f"word{i}" for i in range(30))
    long = "x " * 60000 + text
    items = spark.createDataFrame([(1, text, "en"), (2, None, "en"), (3, "too short", None), (4, text + " more", None), (None, text, "en")], "item_id long, item_text string, lang string").withColumn("doc_id", F.lit(1))
    docs = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, text), (4, text), (5, "nothing here")], "doc_id long, text string").withColumn("item_id", F.lit(9))
    want = [(1, 1), (1, 4), (4, 1), (4, 4)]
    assert sorted((r.item_id, r.doc_id) for r in L.find_leaks(docs, items).collect()) == want
    assert sorted((r.item_id, r.doc_id) for r in L.find_leaks(docs, items, items_a_pass=1).collect()) == want
    assert L.find_leaks(docs.limit(0), items).count() == 0 and L.find_leaks(docs, items.limit(0)).count() == 0
