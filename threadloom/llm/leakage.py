"""Held-out items inside training documents: a BM25 index of the items, block-max WAND, then a check.

The index holds the items, every passage of every document is a query; its terms are pairs of
neighbouring words, for unspaced text runs of three characters.  The threshold of an item is
the least score that a passage can have which really contains a leak of it, so the search loses none;
the check that follows only removes passages that merely look alike.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import Scratch

EXACT_WORDS = 10
FUZZY_WORDS, FUZZY_EDITS = 20, 3
EXACT_CHARS = 20
GRAM = 3  # terms of unspaced text are runs of so many characters
K1, B = 1.2, 0.75
POSTINGS_A_BLOCK = 64
ITEMS_A_PASS = 20000  # items indexed and broadcast at once; more items take more passes over the documents

_TAG = re.compile(r"</?(?:(p|br|div|li|tr|td|h[1-6])|[A-Za-z][A-Za-z0-9-]*)\b[^<>]*>", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]")


def normalise(text: str) -> str:
    """Lower case without markup, entities, invisible characters and differences of width."""
    if "<" in text:
        text = _TAG.sub(lambda m: " " if m[1] else "", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)))
    return text.casefold()


def words_of(text: str) -> list[str]:
    """Runs of letters and digits of a normalised text."""
    return _WORD.findall(text)


def chars_of(text: str) -> str:
    """All letters and digits of a normalised text, each of which counts as a word where there are no blanks."""
    return "".join(_WORD.findall(text))


def grams_of(chars: str) -> list[str]:
    return [chars[i : i + GRAM] for i in range(len(chars) - GRAM + 1)]


def has_han(text: str) -> bool:
    return any("一" <= c <= "鿿" or "㐀" <= c <= "䶿" or "\U00020000" <= c <= "\U0003ffff" for c in text)


@dataclass
class Bm25Index:
    """Postings by term in order of items, weights divided by the item's threshold, and block maxima.

    ``exact`` and ``fuzzy`` are the lengths of the windows in terms; ``lost`` is the number of terms
    that the allowed edits of a fuzzy window can destroy.
    """

    exact: int
    fuzzy: int = 0
    lost: int = 0
    terms: dict = field(default_factory=dict)
    items: list[list[int]] = field(default_factory=list)  # per term: item numbers
    weights: list[list[float]] = field(default_factory=list)
    block_max: list[list[float]] = field(default_factory=list)
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sorted_codes: np.ndarray | None = None
    code_terms: np.ndarray | None = None

    def build(self, texts: Sequence[list]) -> Bm25Index:
        """``texts``: the terms of each item; an item shorter than the exact window cannot leak and gets no postings."""
        usable = [(k, t) for k, t in enumerate(texts) if len(t) >= self.exact]
        df = Counter(term for _, text in usable for term in set(text))
        average = sum(len(t) for _, t in usable) / max(1, len(usable))
        postings: dict[object, list[tuple[int, float]]] = defaultdict(list)
        for k, text in usable:
            tf = Counter(text)
            norm = K1 * (1 - B + B * len(text) / average)
            weight = {t: math.log(1 + (len(usable) - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in tf.items()}
            threshold = self.threshold(text, weight)
            for t, w in weight.items():
                # edits can destroy every distinct term of a repetitive window, yet one of its places stays: any shared term is a hit then
                postings[t].append((k, w / threshold if threshold > 0 else 1.0))
        for term, rows in postings.items():
            self.terms[term] = len(self.items)
            self.items.append([k for k, _ in rows])
            self.weights.append([w for _, w in rows])
            self.block_max.append([max(w for _, w in rows[i : i + POSTINGS_A_BLOCK]) for i in range(0, len(rows), POSTINGS_A_BLOCK)])
        self.most = np.array([max(b) for b in self.block_max] + [0.0])  # the last entry is for terms outside the index
        return self

    def threshold(self, text: list, weight: dict) -> float:
        """The least score of a passage that contains a leak: over all windows, the sum over their distinct terms,
        for fuzzy windows without the heaviest terms that edits can destroy."""
        least = min(sum(weight[t] for t in set(text[i : i + self.exact])) for i in range(len(text) - self.exact + 1))
        for i in range(len(text) - self.fuzzy + 1) if self.fuzzy else ():
            window = sorted((weight[t] for t in set(text[i : i + self.fuzzy])), reverse=True)
            least = min(least, sum(window[self.lost :]))
        return least * (1 - 1e-9)

    def lookup(self, text: Sequence) -> np.ndarray:
        """Term numbers; terms outside the index get the number after the last."""
        get, none = self.terms.get, len(self.terms)
        return np.fromiter((get(t, none) for t in text), dtype=np.int32, count=len(text))

    def lookup_codes(self, codes: np.ndarray) -> np.ndarray:
        """The same for terms that are integers, by binary search over all of them at once."""
        if not len(self.terms):
            return np.zeros(len(codes), dtype=np.int32)
        if self.sorted_codes is None:
            self.sorted_codes = np.sort(np.fromiter(self.terms, dtype=np.int64, count=len(self.terms)))
            self.code_terms = np.array([self.terms[int(c)] for c in self.sorted_codes], dtype=np.int32)
        at = np.minimum(np.searchsorted(self.sorted_codes, codes), len(self.sorted_codes) - 1)
        return np.where(self.sorted_codes[at] == codes, self.code_terms[at], len(self.terms)).astype(np.int32)

    def passages(self, ids: np.ndarray, length: int, step: int) -> Iterator[int]:
        """Starts of passages whose bound from the terms' largest weights reaches a threshold; the others can have no hit."""
        upto = np.concatenate([[0.0], np.cumsum(self.most[ids])])
        starts = np.arange(0, max(1, len(ids) - length + step), step)
        bound = upto[np.minimum(starts + length, len(ids))] - upto[starts]
        return iter(starts[bound >= 1 - 1e-6].tolist())

    def search(self, terms: Sequence[int]) -> list[int]:
        """All items whose score for the distinct terms reaches their threshold, by block-max WAND."""
        lists = [[self.items[t][0], 0, t] for t in set(terms) if t < len(self.items)]
        hits = []
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                bound += self.most[t]
                if bound >= 1:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            heads = lists[: pivot + 1]
            block_bound, skip_to = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else 1 << 60
            for head in heads:
                rows = self.items[head[2]]
                at = bisect_left(rows, item, head[1])
                if at < len(rows):
                    block = at // POSTINGS_A_BLOCK
                    block_bound += self.block_max[head[2]][block]
                    skip_to = min(skip_to, rows[min(len(rows), (block + 1) * POSTINGS_A_BLOCK) - 1] + 1)
            if block_bound < 1:
                self._advance(heads, max(skip_to, item + 1))
            elif heads[0][0] == item:
                if sum(self.weights[t][at] for _, at, t in heads) >= 1:
                    hits.append(item)
                self._advance(heads, item + 1)
            else:
                self._advance([h for h in heads if h[0] < item], item)
            lists = [x for x in lists if x[1] < len(self.items[x[2]])]
        return hits

    def _advance(self, heads: list[list[int]], to: int) -> None:
        for head in heads:
            rows = self.items[head[2]]
            head[1] = bisect_left(rows, to, head[1])
            if head[1] < len(rows):
                head[0] = rows[head[1]]


def runs_of(terms: Sequence, length: int) -> Iterator[tuple]:
    """All runs of so many neighbouring terms."""
    return zip(*(terms[i:] for i in range(length)))


def contains_run(window: Sequence, length: int, runs: set) -> bool:
    return not runs.isdisjoint(runs_of(window, length))


def contains_edited(window: Sequence[int], item: Sequence[int], words: int = FUZZY_WORDS, edits: int = FUZZY_EDITS) -> bool:
    """True if any run of ``words`` item words occurs in the window with at most ``edits`` edits.

    A run is cut into edits + 1 blocks, one of which no edit can touch; only runs with a block that
    stands in the window as it is are matched, bit-parallel.
    """
    size = words // (edits + 1)
    seen = set(runs_of(window, size))
    whole_blocks = [at for at, run in enumerate(runs_of(item, size)) if run in seen]
    starts = {at - k * size for at in whole_blocks for k in range(edits + 1)}
    top = 1 << (words - 1)
    whole = (1 << words) - 1
    for start in sorted(s for s in starts if 0 <= s <= len(item) - words):
        masks: dict[int, int] = {}
        for k, term in enumerate(item[start : start + words]):
            masks[term] = masks.get(term, 0) | 1 << k
        plus, minus, distance = whole, 0, words
        for term in window:
            equal = masks.get(term, 0)
            diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
            up, down = minus | ~(diagonal | plus), plus & diagonal
            distance += bool(up & top) - bool(down & top)
            up, down = up << 1, down << 1
            plus, minus = (down | ~(diagonal | up)) & whole, up & diagonal & whole
            if distance <= edits:
                return True
    return False


class Detector:
    """Finds the leaked items of one document after another."""

    def __init__(self, items: Sequence[tuple[int, str, str | None]]):
        spaced, unspaced = [], []
        for number, text, lang in items:
            plain = normalise(text or "")
            zh = (lang or "").strip().lower() == "zh" if lang else has_han(plain)
            (unspaced if zh else spaced).append((number, plain))
        self.word_items = [n for n, _ in spaced]
        self.char_items = [n for n, _ in unspaced]
        word_texts = [words_of(t) for _, t in spaced]
        char_texts = [chars_of(t) for _, t in unspaced]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for t in word_texts for w in t))}
        self.item_words = [[self.vocabulary[w] for w in t] for t in word_texts]
        # a replaced or dropped word destroys two pairs of neighbours, an inserted one destroys one
        self.words = Bm25Index(EXACT_WORDS - 1, FUZZY_WORDS - 1, 2 * FUZZY_EDITS).build([self._pairs(np.array(t, dtype=np.int64)).tolist() for t in self.item_words])
        self.chars = Bm25Index(EXACT_CHARS - GRAM + 1).build([grams_of(t) for t in char_texts])
        self.word_runs = [{tuple(t[i : i + EXACT_WORDS]) for i in range(len(t) - EXACT_WORDS + 1)} for t in self.item_words]
        self.char_runs = [{t[i : i + EXACT_CHARS] for i in range(len(t) - EXACT_CHARS + 1)} for t in char_texts]

    def _pairs(self, words: np.ndarray) -> np.ndarray:
        """Codes of neighbouring words, -1 where one of them is in no item."""
        left, right = words[:-1], words[1:]
        return np.where((left < 0) | (right < 0), -1, left * len(self.vocabulary) + right)

    def leaks(self, text: str | None) -> list[int]:
        """Item ids, each once; none for null and empty texts."""
        if not text:
            return []
        plain = normalise(text)
        return sorted({self.word_items[k] for k in self._by_words(words_of(plain))} | ({self.char_items[k] for k in self._by_chars(plain)} if self.char_items and has_han(plain) else set()))

    def _by_words(self, words: list[str]) -> set[int]:
        found: set[int] = set()
        if len(words) < EXACT_WORDS or not self.word_items:
            return found
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        pairs = self.words.lookup_codes(self._pairs(ids))
        step = FUZZY_WORDS + FUZZY_EDITS - 1  # a leak has at most so many pairs, so it lies in one passage of twice that length
        for start in self.words.passages(pairs, 2 * step, step):
            window = ids[start : start + 2 * step + 1].tolist()
            for k in self.words.search(pairs[start : start + 2 * step].tolist()):
                if k not in found and (contains_run(window, EXACT_WORDS, self.word_runs[k]) or contains_edited(window, self.item_words[k])):
                    found.add(k)
        return found

    def _by_chars(self, plain: str) -> set[int]:
        found: set[int] = set()
        chars = chars_of(plain)
        if len(chars) < EXACT_CHARS:
            return found
        grams = EXACT_CHARS - GRAM + 1
        ids = self.chars.lookup(grams_of(chars))
        for start in self.chars.passages(ids, 2 * grams, grams):
            window = chars[start : start + 2 * grams + GRAM - 1]
            for k in self.chars.search(ids[start : start + 2 * grams].tolist()):
                if k not in found and any(window[i : i + EXACT_CHARS] in self.char_runs[k] for i in range(len(window) - EXACT_CHARS + 1)):
                    found.add(k)
        return found


def find_leaks(documents: DataFrame, items: DataFrame, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """``item_id, doc_id`` of every document that contains a passage of an item, each pair once.

    The index of a fixed number of items is built once, broadcast and kept by every worker for all
    its tasks.  More items take more passes over the documents, one after the other: a pass is
    written and its index dropped before the next, so what is broadcast at a time has one bound.
    Items without id or text and empty tables give no rows.
    """
    spark = documents.sparkSession
    rows = items.where("item_id is not null and item_text is not null").select("item_id", "item_text", "lang").orderBy("item_id").toLocalIterator()
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")

    def search(part: list[tuple[int, str, str | None]]):
        shared = spark.sparkContext.broadcast(Detector(part))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            detector = shared.value
            for batch in batches:
                pairs = [(item, doc) for doc, text in zip(batch["doc_id"], batch["text"]) for item in detector.leaks(text)]
                yield pd.DataFrame(pairs, columns=["item_id", "doc_id"]).astype("int64")

        return docs.mapInPandas(run, "item_id long, doc_id long"), shared

    found, block, scratch = [], [(r.item_id, r.item_text, r.lang) for r in islice(rows, items_a_pass)], Scratch(spark)
    while True:
        following = [(r.item_id, r.item_text, r.lang) for r in islice(rows, items_a_pass)]
        pairs, shared = search(block)
        if found or following:
            found.append(scratch.save(pairs, "leaks"))
            shared.destroy()
        else:
            found.append(pairs)
        if not following:
            break
        block = following
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole.distinct()
