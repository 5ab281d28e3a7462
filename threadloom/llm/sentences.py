"""Sentence ends in any script, with abbreviations and names settled by the document, then by the corpus."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Container, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import Scratch

PLACEHOLDERS = ("[deleted]", "[removed]")
DECISIONS_BROADCAST = 200_000  # corpus decisions that are broadcast at most; more are joined by document


class Prior:
    """Abbreviations known beforehand, in lower case and without the last dot, by what stands behind them."""

    def __init__(self, titles: str, before_number: str, continuing: str, ending: str, before_capital: str, also_words: str):
        self.titles, self.before_number, self.continuing = (frozenset(x.split()) for x in (titles, before_number, continuing))
        self.ending, self.ambiguous_before_capital, self.also_words = (frozenset(x.split()) for x in (ending, before_capital, also_words))
        self.every = self.titles | self.before_number | self.continuing | self.ending | self.also_words


# The prior beside a corpus, asked only where neither the document nor the corpus shows what a token is.
CORE_PRIOR = Prior(
    "dr prof mr mrs ms st sr sra hr fr m mme г-н ул проф κ डॉ", "no nos nr núm n fig vol p pp pág art ca approx стр рис с σελ पृ", "vs cf e.g i.e al z.b d.h u.a p.ej p.ex т.е π.χ",
    "etc usw u.s.w a.m p.m u.s u.k e.u jr inc ltd co т.д т.п κ.λπ ee.uu", "u.s u.k e.u jr inc ltd co", "no nos fig art p s c st co m fr",
)
# The wide prior that stands in for a corpus where there is none.
WIDE_PRIOR = Prior(
    "dr prof mr mrs ms mx st rev hon fr sr sra srta dra d dª m mm mme mlle mgr me pr hr hrn dipl ing med phil jur rer nat habil gen col capt lt sgt maj cmdr gov sen rep pres supt "
    "проф акад г-н г-жа им ул пр пер д кв корп обл р-н гр тов κ κα καθ δρ αγ ดร นพ พญ ผศ รศ ศ น.ส पं डॉ डा श्री प्रो सुश्री कु د أ م",
    "no nos nr nrs núm n fig figs vol vols p pp pg pgs bldg apt ste ch chap sec art arts para eq tab tbl abb bd s st kap ziff abs rn ca approx aprox env ungef c v ver "
    "рис табл стр с гл ст п пп № εικ σελ αρ ص ج पृ सं क्र ม ข้อ หน้า jan feb mar apr jun jul aug sep sept oct nov dec",
    "vs cf viz i.e e.g eg ie al inkl exkl bzw vgl evtl ggf sog z.b d.h u.a s.o o.ä z.t i.d.r m.e dept ext est incl excl resp p.ej p.ex c.-à-d т.е т.н т.к см ср напр тыс млн млрд "
    "π.χ δηλ βλ τηλ मि.ग्रा कि.ग्रा मि.ली कि.मी से.मी रु มก มล กก กม ซม ถ จ อ ต ช.ม พ.ศ ค.ศ พ.ต.ท",
    "etc usw u.s.w a.m p.m u.s u.k u.s.a e.u d.c jr inc ltd co corp llc bros т.д т.п др руб коп г гг кг κ.λπ κ.λ.π κ.ά κλπ ecc enz ee.uu a.c n.chr v.chr ph.d m.d b.a m.a b.sc m.sc",
    "u.s u.k u.s.a e.u jr inc ltd co corp llc bros ph.d m.d b.a m.a b.sc m.sc г", "no nos fig art p s c v st mar jun sec co me d m gen al rep pres hon est ext fr",
)
GERMAN_MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez".split())
GERMAN_BEFORE_ORDINAL = frozenset("am dem den der die das des zum vom im beim ab bis seit ihr sein mein unser jeder jeden".split())

STRONG = "!?！？。．｡।॥؟۔‽⁇⁈⁉։።፧។៕။܀"
WIDE = "！？。｡．"
DOTS = ".…"
CLOSERS = "”’»›\"'）)]」』】〕〗》〉"
PAIRS = {"“": "”", "„": "“”", "‚": "‘’", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "《": "》", "〈": "〉", "【": "】"}
ROUND = "(（"
INVISIBLE = "​‌‍⁠﻿­"

_BLANK_LINE = re.compile(r"\n[^\S\n]*(?:\r?\n[^\S\n]*)+")
_LIST_MARK = re.compile(r"\n[^\S\n]*(?:([-*•‣▪–])|(\d{1,3})[.)])(?=[^\S\n]+\S)")
_FIRST_MARK = re.compile(r"\s*(\d{1,3})[.)](?=[^\S\n]+\S)")
_EMOTICON = re.compile(r"(?<![\w.])(?:[:;=8][-'^]?[)(\]\[DPpOo3/\\|*]+|<3+|</3|\^_?\^|[xX]D+|\(:|:'\()(?!\w)")
_EMOJI = "[\U0001f000-\U0001faff☀-➿⬀-⯿\U0001f1e6-\U0001f1ff]"
_CLOSING_SMILES = re.compile(rf"(?:[^\S\n]*(?:{_EMOJI}[︎️\U0001f3fb-\U0001f3ff‍]*)+|[^\S\n]+{_EMOTICON.pattern}(?=\s|$))+")
_MARKS = re.compile(rf"[{re.escape(STRONG)}.…;;]")
_SEPARATOR = re.compile(r"[\s(\[{«»“”„\"<>,;:!?¡¿（「、，。/]")
_IS_SEPARATOR = np.zeros(0x110000, dtype=bool)
_IS_SEPARATOR[[m.start() for m in _SEPARATOR.finditer("".join(map(chr, range(0xD800))))]] = True  # none of them has a higher number but the wide ones
_IS_SEPARATOR[[ord(c) for c in "（，"]] = True
_INSIDE = re.compile(r"[^\s/]*")
_LEADING = re.compile(r"[ \t\n\xa0—–-]*")
_BRACKETS = re.compile(f"[\"'{re.escape(''.join(dict.fromkeys(''.join(PAIRS) + ''.join(PAIRS.values()))))}]")
_THAI = "ก-๛"
_THAI_BLANK = re.compile(rf"(?<=[{_THAI}])([^\S\n]+)(?=\S)")
_LATIN_RUN = re.compile(r"[^\W\d_฀-๿]+(?:[-'’][^\W\d_]+)*")
_THAI_FINAL = ("ครับ", "ค่ะ", "คะ", "จ้ะ", "จ้า")
_WORD = re.compile(r"[^\W\d_]+")
_WORD_ALONE = re.compile(r"(?<![\w.])[^\W\d_]+(?!\w|\.\w)")
_DOT = re.compile(r"(?<![.…\s])\.(?![.…\w])")
_PLAIN_END = re.compile(r"\.\s+[A-WYZÀ-ÞА-ЯΑ-Ω][^\W\d_]")
_ONWARD = re.compile(r"(?<![.…\s])\.(?=[,;:]|\s+(?![A-ZÀ-ÞА-ЯΑ-Ω])[^\W_])")
_FOLLOWING = re.compile(r"(\s*)([^\W\d_]+|\S?)")
_PLAIN_NUMBER = re.compile(r"(?<=[^\S\n])\d{1,2}(?![\d.]|[,:]\d)")
_MID_CAPITAL = re.compile(r"(?<=[^\W\d_A-Z] )([A-ZÀ-ÞА-ЯΑ-Ω][^\W\d_]+)")


def letter_case(c: str) -> str:
    """'u' upper, 'l' lower, 'n' digit, 'o' letter without case, '' anything else."""
    if c.isupper() or c.istitle():
        return "u"
    if c.islower():
        return "l"
    if c.isdigit():
        return "n"
    return "o" if c.isalpha() or unicodedata.category(c)[0] == "M" else ""


# What is known of a kind of token: bits that say where a dot behind it ends nothing, or does before a capital.
BEFORE_LOWER, BEFORE_DIGIT, BEFORE_CAPITAL, ENDS_BEFORE_CAPITAL, BEFORE_CASELESS, IS_NAME, IS_COMMON = (1 << k for k in range(7))
NAMED_BITS = {"abbreviation": BEFORE_LOWER | BEFORE_DIGIT, "name": IS_NAME, "common": IS_COMMON}
CONTEXTS = ("lower", "comma", "digit", "capital", "common", "named", "caseless", "close")  # what stands behind a dotted token


class Tokens:
    """Tokens of a text that end at a given place, found from the separators in linear time."""

    def __init__(self, text: str):
        self.text = text
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.separators = np.flatnonzero(_IS_SEPARATOR[codes]).tolist()

    def begin(self, at: int, opened: int) -> int:
        """Where the token that ends before ``at`` begins."""
        n = bisect_left(self.separators, at)
        return max(opened, self.separators[n - 1] + 1 if n else 0)

    def before(self, begin: int, opened: int) -> tuple[int, int]:
        """(begin, end) of the token before the one that begins here; equal where there is none."""
        text = self.text
        while begin > opened and text[begin - 1].isspace():
            begin -= 1
        return self.begin(begin, opened), begin


def kind_of_token(text: str, tokens: Tokens, begin: int, at: int, opened: int) -> str:
    """The token in lower case; a day number is named by the word before it, as in ``dem #``."""
    token = text[begin:at].lstrip("'’‘*_~").casefold()
    if at - begin > 2 or not token.isdigit():
        return token
    first, last = tokens.before(begin, opened)
    if first == last or "\n" in text[last:begin] and text[last - 1] in STRONG + DOTS:
        return ""
    word = text[first:last].rstrip(".").casefold()
    return f"{'#' if word.isdigit() and text[last - 1] == '.' else word} #"


def is_lowercased(text: str) -> bool:
    """True where sentences mostly begin in lower case; two such places are no proof in a text that begins with a capital."""
    low = capital = 0
    for m in _NEW_SENTENCE.finditer(text):
        if m[1]:
            low += 1
        else:
            capital += 1
    return low > capital and (low > 2 or not next((c for c in text if c.isalpha()), "").isupper())


_NEW_SENTENCE = re.compile(r"[.!?…]\s+(?:([a-zß-ÿа-яα-ω])|[A-ZÀ-ÞА-ЯΑ-Ω])")


def dot_contexts(text: str, tokens: Tokens, words: Container[str], names: Container[str]) -> Iterator[tuple[str, int]]:
    """(kind of token, number of its context) of every single dot behind a token.

    A capital is common when its word also stands in lower case in the same document, and named when
    it is an initial or its word also stands inside a sentence there with its capital.
    """
    for m in _DOT.finditer(text):
        at = m.start()
        begin = tokens.begin(at, 0)
        if begin == at:
            continue
        kind = kind_of_token(text, tokens, begin, at, 0)
        if not kind or kind[-1] == "#" and "\n" in text[begin - 2 : begin]:  # a number that begins a line may be a list mark
            continue
        follow = _FOLLOWING.match(text, at + 1)
        gap, word = follow[1], follow[2]
        if not word or gap.count("\n") > 1 or not gap and word in CLOSERS:
            yield kind, 7
        elif not gap:
            if word in ",;:":
                yield kind, 1
        elif word[0].isdigit():
            if "\n" not in gap:
                yield kind, 2
        elif (case := letter_case(word[0])) == "l":
            yield kind, 0
        elif case == "u":
            yield kind, 5 if word in names or text.startswith(".", follow.end()) and len(word) == 1 else 4 if word.lower() in words else 3
        elif case == "o":
            yield kind, 6


def judge(kind: str, every: int, counts: Sequence[int], least: int) -> int:
    """What counts by context say of a kind of token; ``every`` counts it as a word with and without dot.

    An ordinary word at the end of a sentence is mostly followed by a capital, often of a common
    word, or by the end of a text; an abbreviation goes on in lower case, with a comma or a number, or
    stands before names only and hardly ever without its dot.  The longer the token the more it takes.
    """
    lower, comma, digit, capital, common, named, caseless, close = counts
    capital += common + named
    dotted = lower + comma + digit + capital + caseless + close
    bound = dotted * 10 >= 9 * max(every, dotted)
    onward = lower + comma + digit
    bits = 0
    if lower + comma >= least and ((lower + comma) * 5 >= dotted if bound else onward * 10 >= 9 * dotted):
        bits |= BEFORE_LOWER
    if digit >= least and digit * 5 >= dotted:
        bits |= BEFORE_DIGIT
    rarely = bound and close * 10 <= dotted
    before_names = rarely and named >= least and named * 10 >= capital and named >= 2 * common
    never_new = capital >= 3 * least << max(0, len(kind) - 4) and common * 50 <= capital and close * 50 <= dotted and dotted * 5 >= 2 * every
    day_number = rarely and kind[-1] == "#" and common * 10 <= capital
    if dotted >= least + 2 and (onward * 10 >= 9 * dotted or day_number) or before_names or never_new:
        bits |= BEFORE_CAPITAL
    elif bound and bits and capital >= least:
        bits |= ENDS_BEFORE_CAPITAL
    if bound and dotted >= least and close * 10 <= dotted and ("." in kind or len(kind) <= 2):
        bits |= BEFORE_CASELESS
    return bits


class DocumentEvidence:
    """What the document itself shows about a word, gathered when it is first asked for."""

    def __init__(self, text: str, tokens: Tokens, lowercased: bool):
        self.text, self.tokens, self.lowercased = text, tokens, lowercased
        self.known: dict[str, int] | None = None
        self.ready = False

    def read_words(self) -> None:
        self.every = _WORD_ALONE.findall(self.text)
        self.words = set(self.every)
        self.names = set(_MID_CAPITAL.findall(self.text))
        self.ready = True

    def gather(self) -> None:
        """Bits of every kind of token that goes on behind its dot at least twice; no other kind gets any."""
        self.known = {}
        if self.lowercased:
            return
        text, onward = self.text, Counter()
        for m in _ONWARD.finditer(text):
            begin = self.tokens.begin(m.start(), 0)
            if begin < m.start():
                onward[kind_of_token(text, self.tokens, begin, m.start(), 0)] += 1
        many = {kind for kind, n in onward.items() if n > 1 and kind}
        if not many:
            return
        if not self.ready:
            self.read_words()
        counts: dict[str, list[int]] = {}
        for kind, context in dot_contexts(text, self.tokens, self.words, self.names):
            if kind in many:
                counts.setdefault(kind, [0] * len(CONTEXTS))[context] += 1
        every = Counter(w for w in map(str.casefold, self.every) if w in many)
        for kind, seen in counts.items():
            self.known[kind] = judge(kind, every[kind], seen, 2) & (BEFORE_LOWER | BEFORE_DIGIT)

    def bits(self, kind: str) -> int:
        """What at least two clear occurrences in the document say, else 0."""
        if self.known is None:
            self.gather()
        return self.known.get(kind, 0)

    def is_common(self, word: str) -> bool | None:
        """True for a word seen in lower case, False for one only seen as a name inside sentences, else None."""
        if not self.ready:
            self.read_words()
        if word.lower() in self.words:
            return True
        return False if word in self.names else None


class Segmenter:
    """Settles a dot by the document, then by ``corpus``, and only then by a prior.

    ``corpus`` maps a kind of token to its bits, or to 'abbreviation', 'name' or 'common'.
    """

    def __init__(self, corpus: Mapping[str, int] | None = None):
        self.prior = WIDE_PRIOR if corpus is None else CORE_PRIOR
        self.corpus = {token: NAMED_BITS[known] if isinstance(known, str) else known for token, known in (corpus or {}).items()}

    def ends(self, text: str | None) -> list[int]:
        """Ends of sentences as numbers of code points, ascending; none for null and blank texts."""
        if text is None:
            return []
        whole = len(text.rstrip().rstrip(INVISIBLE).rstrip())
        if not whole:
            return []
        if text.strip().lower() in PLACEHOLDERS:
            return [whole]
        out: list[int] = []
        self.lowercased = is_lowercased(text)
        self.tokens = Tokens(text)
        self.evidence = DocumentEvidence(text, self.tokens, self.lowercased)
        for start, end, marks in self._blocks(text, whole):
            self._block(text, start, end, marks, out)
        return out

    def _blocks(self, text: str, whole: int) -> Iterator[tuple[int, int, set[int]]]:
        """Spans between blank lines and before list marks, with the positions of the dots of list numbers."""
        cuts, marks = {0, whole}, set()
        for m in _BLANK_LINE.finditer(text, 0, whole):
            cuts.add(m.start())
        number = 0
        lead = _FIRST_MARK.match(text)
        if lead and int(lead[1]) <= 1:
            marks.add(lead.end() - 1)
            number = int(lead[1])
        for m in _LIST_MARK.finditer(text, 0, whole):
            if m[2]:
                first, last = self.tokens.before(m.start(), 0)
                word = text[first:last].rstrip(".").casefold()
                after = self._after(text, m.end(), whole)[1]
                known = self.corpus.get(word, 0) & BEFORE_DIGIT and text[last - 1 : last] == "." or self.corpus.get(f"{word} #", 0) & (BEFORE_LOWER | BEFORE_DIGIT | BEFORE_CAPITAL)
                if int(m[2]) != number + 1 and int(m[2]) != 1 or known or word in self.prior.before_number or word in GERMAN_BEFORE_ORDINAL or after.isdigit() or after.islower() and not number and int(m[2]) != 1:
                    continue
                number = int(m[2])
                marks.add(m.end() - 1)
            cuts.add(m.start())
        edges = sorted(cuts)
        for a, b in zip(edges, edges[1:]):
            end = a + len(text[a:b].rstrip().rstrip(INVISIBLE).rstrip())
            start = b - len(text[a:b].lstrip())
            if end > start:
                yield start, end, marks

    def _regions(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """Outermost quotations and round brackets as (first, last) positions; unmatched marks protect nothing."""
        found: list[tuple[int, int]] = []
        places = [m.start() for m in _BRACKETS.finditer(text, start, end)]
        if not places:
            return found
        smiles = {k for m in _EMOTICON.finditer(text, start, end) for k in range(m.start(), m.end())}
        stack: list[tuple[str, int]] = []
        waiting: Counter = Counter()  # how many open marks each closing mark could close

        def close(c: str) -> int:
            """Takes marks off the stack down to the last that ``c`` closes, and returns its place."""
            while True:
                closers, at = stack.pop()
                for x in closers:
                    waiting[x] -= 1
                if c in closers:
                    return at

        def put(closers: str, at: int) -> None:
            stack.append((closers, at))
            for x in closers:
                waiting[x] += 1

        for k in places:
            c = text[k]
            if k in smiles:
                continue
            if c in "\"'":
                before, after = text[k - 1] if k > start else " ", text[k + 1] if k + 1 < end else " "
                opens = (before.isspace() or before in "([¿¡—–-") and not after.isspace()
                closes = not before.isspace() and not (c == "'" and after.isalnum())
                if waiting[c] and (closes or c == '"' and not opens):
                    found.append((close(c), k))
                elif opens or c == '"' and not waiting[c] and before in PAIRS:
                    if waiting[c]:
                        close(c)
                    put(c, k)
            elif waiting[c]:
                found.append((close(c), k))
            elif c in PAIRS:
                put(PAIRS[c], k)
        found.sort()
        outer: list[tuple[int, int]] = []
        for a, b in found:
            if not outer or a > outer[-1][1]:
                outer.append((a, b))
            elif b > outer[-1][1]:
                outer[-1] = (outer[-1][0], b)
        return outer

    def _block(self, text: str, start: int, end: int, marks: set[int], out: list[int]) -> None:
        regions = self._regions(text, start, end)
        firsts = [a for a, _ in regions]
        candidates: list[tuple[int, int, str]] = []  # (order, end, kind)
        k = start
        while k < end:
            m = _MARKS.search(text, k, end)
            if not m:
                break
            at = m.start()
            n = bisect_right(firsts, at) - 1
            if n >= 0 and at <= regions[n][1]:
                k = regions[n][1] + 1
                continue
            last = at + 1
            while last < end and text[last] in STRONG + DOTS:
                last += 1
            candidates.append((at, last, "mark"))
            k = last
        for n, (a, b) in enumerate(regions):
            inner = text[a + 1 : b].rstrip()
            if text[a] not in ROUND and inner and inner[-1] in STRONG + DOTS + ";;" + CLOSERS and (inner[-1] not in ";" or self._greek(inner[:-1])):
                candidates.append((a, b + 1, "quote"))
        for m in _THAI_BLANK.finditer(text, start, end):
            n = bisect_right(firsts, m.start()) - 1
            if not (n >= 0 and m.start() <= regions[n][1]):
                candidates.append((m.start(), m.start(), "thai"))
        candidates.sort()
        opened = start
        for at, last, kind in candidates:
            if last <= opened or last >= end:
                continue
            if kind == "mark" and last == at + 1 and self._plain_end(text, opened, at, end):
                stop = last
            else:
                stop = getattr(self, f"_{kind}_end")(text, opened, at, last, end, marks)
            if stop is None or stop >= end:
                continue
            if text[opened:stop].strip():
                out.append(stop)
                opened = stop
                while opened < end and (text[opened].isspace() or text[opened] in INVISIBLE):
                    opened += 1
        if text[opened:end].strip():
            out.append(end)

    def _plain_end(self, text: str, opened: int, at: int, end: int) -> bool:
        """A dot between an ordinary word of at least five letters and a new one with a capital; most dots are such and need no more thought."""
        if not _PLAIN_END.match(text, at, end):
            return False
        begin = self.tokens.begin(at, opened)
        token = text[begin:at]
        if at - begin < 5 or not token.isalpha() or token[-1] >= "฀":
            return False
        low = token.casefold()
        return low not in self.prior.every and not self._known(low)

    @staticmethod
    def _greek(text: str) -> bool:
        tail = text.rstrip("»\" ")[-1:]
        return "Ͱ" <= tail <= "Ͽ" or "ἀ" <= tail <= "῿"

    @staticmethod
    def _after(text: str, at: int, end: int) -> tuple[int, str]:
        """(position, character) of what follows blanks and invisible characters; '' at the end of the block."""
        while at < end and (text[at].isspace() or text[at] in INVISIBLE):
            at += 1
        return at, text[at] if at < end else ""

    def _absorb(self, text: str, last: int, end: int) -> int:
        """Past closing marks and then closing emoji or emoticons."""
        while last < end and text[last] in CLOSERS:
            if text[last] in "\"'" and last + 1 < end and text[last + 1].isalnum():
                break
            last += 1
        m = _CLOSING_SMILES.match(text, last, end)
        return m.end() if m else last

    def _quote_end(self, text: str, opened: int, at: int, last: int, end: int, marks: set[int]) -> int | None:
        """After a quotation that closes with an end mark."""
        place, following = self._after(text, last, end)
        if not following or last < end and text[last] in STRONG + DOTS + ",;:，、；：":
            return None
        leads = _LEADING.match(text, opened, at).end() == at  # the sentence begins with the quotation
        kind = letter_case(following)
        if kind == "l":
            return last if self.lowercased and not leads and place > last else None
        if kind == "o":
            if leads or "぀" <= following <= "ヿ":
                return None
            return last
        if not kind and following not in "“„«‹「『\"'¿¡(（<>*#" and not unicodedata.category(following).startswith("So"):
            return None
        return self._absorb(text, last, end)

    def _thai_end(self, text: str, opened: int, at: int, last: int, end: int, marks: set[int]) -> int | None:
        """At a blank after Thai letters; blanks next to numbers, units, quotations and Latin names are inside."""
        place, following = self._after(text, at, end)
        kind = letter_case(following)
        if kind == "o":
            return at
        if following in "\"“'‘«":
            return None if text.endswith("ว่า", opened, at) else at
        if kind in ("u", "l"):
            words = []
            while True:
                m = _LATIN_RUN.match(text, place, end)
                if not m:
                    break
                words.append(m[0])
                place, _ = self._after(text, m.end(), end)
            return at if text.endswith(_THAI_FINAL, opened, at) or len(words) >= 4 or len(words) >= 2 and any(w.islower() for w in words) else None
        if kind == "n":
            return at if text.endswith(_THAI_FINAL, opened, at) else None
        return None

    def _mark_end(self, text: str, opened: int, at: int, last: int, end: int, marks: set[int]) -> int | None:
        """After a run of end marks outside quotations and brackets."""
        run = text[at:last]
        if at in marks:
            return None
        if run[0] in ";;":
            if run[0] == ";" and not self._greek(text[max(opened, at - 3) : at]):
                return None
            return self._absorb(text, last, end)
        place, following = self._after(text, last, end)
        kind = letter_case(following) if following else ""
        if following and following in ",;:，、；：" and place == last:
            return None
        if any(c in STRONG for c in run):
            if place == last and kind in ("l", "n") and not any(c in WIDE for c in run) and ord(run[-1]) < 128:
                return None
            return self._absorb(text, last, end)
        if len(run) > 1 or run == "…":
            if following and (kind == "l" or following in "—–)" or following == "-" and text[place + 1 : place + 2].isspace()):
                return None
            if place == last and kind == "n":
                return None
            return self._absorb(text, last, end)
        return self._dot_end(text, opened, at, last, end, place, following, kind)

    def _dot_end(self, text: str, opened: int, at: int, last: int, end: int, place: int, following: str, kind: str) -> int | None:
        """A single dot."""
        begin = self.tokens.begin(at, opened)
        while begin < at and text[begin] in "'’‘*_~":
            begin += 1
        stop = self._absorb(text, last, end)
        if begin == at:
            return None if kind in ("n", "l") and place == last else stop if at > opened and text[at - 1] in CLOSERS + "%°" else None if kind == "n" else stop
        if place == last and kind:  # no blank: an end only between a whole word and a new capitalised one
            token = text[begin:at] if kind == "u" else ""
            if token.isalpha() and len(token) > 2 and token[1:].islower() and token.casefold() not in self.prior.titles and not self._known(token.casefold()) & BEFORE_CAPITAL:
                m = _WORD.match(text, place, end)
                inside = _INSIDE.match(text, place, end).end()
                if m and (len(m[0]) > 1 and m[0][1:].islower() or m[0] in ("I", "A")) and (inside == end or text[inside] != "/"):
                    return stop
            return None
        if following and following in ",;:)]}/%&=+-–—" and place == last:
            return None
        if not following:
            return stop
        token = text[begin:at]
        if "฀" <= token[-1] <= "๿":
            return None
        shown = self._shown(text, opened, begin, at, kind, place, end)
        if shown is not None:
            return stop if shown else None
        low = token.casefold()
        tail = low.rpartition(".")[2]
        if token[-1].isdigit() and not any(c.isalpha() for c in tail):
            return self._number_end(text, opened, at, token, following, kind, place, end, stop)
        joined = self._joined(text, opened, begin, low)
        capital = kind == "u" or kind in ("", "o")
        if joined in self.prior.continuing:
            return None
        if joined in self.prior.ending and joined != low:
            return stop if capital else None
        if len(low) == 2 and low[0] == low[1] and token.isupper() and re.match(r"\s*([A-Z])\1\.", text[last : last + 6]):
            return None
        if low in self.prior.titles and low not in self.prior.also_words or tail in self.prior.titles and "." in low and len(tail) > 1:
            return None
        if len(token) == 1:
            return self._letter_end(text, opened, at, token, kind, place, end, stop)
        if low in self.prior.before_number and (kind == "n" or low in ("approx", "aprox", "env", "ca", "bldg", "nos")):
            return None
        if low in self.prior.ending or "." in low and low not in self.prior.continuing:
            if kind in ("l", "n") or following in "-–—":
                return None
            if low in self.prior.ambiguous_before_capital and kind == "u":
                return stop if self._common(text, place, end) is not False else None
            return stop
        if low in self.prior.continuing:
            return stop if low in ("al", "тыс", "млн", "млрд") and capital and kind else None
        if low in self.prior.titles:  # also an ordinary word: a title when a name follows
            return None if kind == "u" and token[0].isupper() and self._common(text, place, end) is not True or self.lowercased and low in ("st", "fr", "d", "m") else stop
        return stop

    def _known(self, kind: str) -> int:
        """Bits of the document or else, where it says nothing, of the corpus."""
        return self.evidence.bits(kind) | self.corpus.get(kind, 0) & ~(IS_NAME | IS_COMMON)

    def _shown(self, text: str, opened: int, begin: int, at: int, kind: str, place: int, end: int) -> bool | None:
        """Whether the dot ends a sentence by what is known of its token from other occurrences; None where that is not clear."""
        bits = self._known(kind_of_token(text, self.tokens, begin, at, opened))
        if not bits:
            return None
        if kind == "l":
            return False if bits & BEFORE_LOWER and not self.lowercased or bits & BEFORE_CAPITAL else None
        if kind == "n":
            return False if bits & BEFORE_DIGIT else None
        if kind == "o":
            return False if bits & BEFORE_CASELESS else None
        if kind == "u":
            if bits & BEFORE_CAPITAL:
                return False
            if bits & ENDS_BEFORE_CAPITAL:
                return True
            return self._common(text, place, end) if at - begin > 1 else None
        return None

    def _joined(self, text: str, opened: int, begin: int, low: str) -> str:
        """The abbreviation ending here with its blanks taken out, as in ``z. B.`` or ``т. д.``; it has at most four parts."""
        parts = [low]
        while len(parts) < 4:
            first, last = self.tokens.before(begin, opened)
            if last - first < 2 or begin - last > 2 or text[last - 1] != "." or not all(0 < len(p) <= 3 and p.isalpha() for p in text[first : last - 1].split(".")):
                break
            parts = [*text[first : last - 1].casefold().split("."), *parts]
            begin = first
        for n in range(len(parts)):
            name = ".".join(parts[n:])
            if name in self.prior.continuing or name in self.prior.ending:
                return name
        return low

    def _number_end(self, text: str, opened: int, at: int, token: str, following: str, kind: str, place: int, end: int, stop: int) -> int | None:
        """A dot after digits: an ordinal before a German month or noun, else an end."""
        first, last = self.tokens.before(at - len(token), opened)
        word = text[first:last].rstrip(".").casefold()
        if last == opened and len(token) <= 3:
            return None
        ordinal = token.isdigit() and len(token) <= 2
        nxt = _WORD.match(text, place, end)
        name = nxt[0].casefold() if nxt else ""
        if ordinal and name in GERMAN_MONTHS and (word in GERMAN_BEFORE_ORDINAL or name not in ("april", "mai", "august", "september", "november")):
            return None
        if ordinal and word in GERMAN_BEFORE_ORDINAL:
            return None
        if ordinal and kind in ("n", "l") and word.isdigit() and text[last - 1] == ".":  # as in Am 27. 2.
            first, last = self.tokens.before(first, opened)
            if text[first:last].casefold() in GERMAN_BEFORE_ORDINAL:
                return None
        return stop

    def _letter_end(self, text: str, opened: int, at: int, token: str, kind: str, place: int, end: int, stop: int) -> int | None:
        """A dot after one letter: an initial, part of a spaced abbreviation, or a one-letter word."""
        if kind in ("l", "n"):
            return None
        if letter_case(token) == "o":
            return None
        if token.islower() and re.match(r"[^\W\d_]\.", text[place : place + 2]):
            return None  # the first half of one like z. B.
        first, last = self.tokens.before(at - 1, opened)
        before = text[first:last]
        if kind == "u" and token.isupper():
            following = text[place + 1 : place + 2]
            named = following == "." or not before or before.endswith(".") or before[:1].isupper()
            if named or self._common(text, place, end) is not True:
                return None
            return stop
        if token.casefold() in self.prior.continuing | self.prior.before_number | self.prior.titles:
            return None if kind == "u" and token.casefold() in self.prior.titles or token.casefold() in self.prior.continuing else stop
        return stop

    def _common(self, text: str, place: int, end: int) -> bool | None:
        """Whether the word that follows is an ordinary one, by the document, then by the corpus."""
        m = _WORD.match(text, place, end)
        if not m:
            return None
        if len(m[0]) == 1 and text.startswith(".", m.end()):
            return False  # an initial
        known = self.evidence.is_common(m[0])
        if known is None:
            bits = self.corpus.get(m[0].casefold(), 0)
            known = True if bits & IS_COMMON else False if bits & IS_NAME else None
        return known


COUNTED = ("every", "small", "name", *CONTEXTS)


def word_evidence(texts: Iterable[str]) -> dict[str, list[int]]:
    """Counts by kind of token: as a word, in lower case, with a capital inside a sentence, and dotted by context.

    Documents without capitals show nothing of all this and are left out.
    """
    out: dict[str, list[int]] = defaultdict(lambda: [0] * len(COUNTED))
    words, names, numbers, dotted = Counter(), Counter(), Counter(), Counter()
    for text in texts:
        if is_lowercased(text):
            continue
        own, inside = _WORD_ALONE.findall(text), _MID_CAPITAL.findall(text)
        words.update(own)
        names.update(inside)
        tokens = Tokens(text)
        for m in _PLAIN_NUMBER.finditer(text):
            first, last = tokens.before(m.start(), 0)
            numbers[text[first:last]] += 1
        dotted.update(dot_contexts(text, tokens, set(own), set(inside)))
    for w, n in words.items():
        row = out[w.casefold()]
        row[0] += n
        if w.islower():
            row[1] += n
    for w, n in names.items():
        out[w.casefold()][2] += n
    for w, n in numbers.items():
        if w := w.rstrip(".").casefold():
            out[f"{w} #"][0] += n
    for (kind, context), n in dotted.items():
        row = out[kind]
        row[3 + context] += n
        if kind[-1] == "#":
            row[0] += n
    return out


def corpus_decisions(documents: DataFrame, text: str = "text") -> DataFrame:
    """``token, kind, bits`` for kinds of tokens on which the corpus is clear; ``kind`` is abbreviation, name or common.

    Each task counts its batches before the shuffle, so a frequent word sends few rows.  A name is
    never written in lower case and stands inside sentences; ``judge`` says what dots do.
    """
    schema = "token string, " + ", ".join(f"{c} long" for c in COUNTED)

    def rows_of(kept: dict[str, list[int]]) -> pd.DataFrame:
        table = pd.DataFrame(list(kept.values()), columns=list(COUNTED), dtype="int64")
        table.insert(0, "token", list(kept))
        return table

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, list[int]] = {}
        for batch in batches:
            for token, row in word_evidence(t for t in batch["text"] if t).items():
                old = kept.get(token)
                kept[token] = row if old is None else [a + b for a, b in zip(old, row)]
            if len(kept) > 200_000:
                yield rows_of(kept)
                kept = {}
        if kept:
            yield rows_of(kept)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = [judge(token, every, counts, 3) for token, every, *counts in zip(batch["token"], batch["every"], *(batch[c] for c in CONTEXTS))]
            yield pd.DataFrame({"token": batch["token"], "bits": bits, "word": batch["word"]}).assign(bits=lambda t: t["bits"] | t["word"])[["token", "bits"]]

    counts = documents.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInPandas(count, schema)
    table = counts.groupBy("token").agg(*[F.sum(c).alias(c) for c in COUNTED])
    name = (F.col("name") >= 2) & (F.col("small") * 20 <= F.col("name"))
    common = (F.col("small") >= 2) & (F.col("name") * 20 <= F.col("small")) & (F.col("every") > F.col("small"))
    table = table.withColumn("word", F.when(name, IS_NAME).when(common, IS_COMMON).otherwise(0))
    dotted = sum((F.col(c) for c in CONTEXTS), F.lit(0))
    useful = table.where((F.col("word") > 0) | (dotted >= 3)).mapInPandas(decide, "token string, bits int")
    kind = F.when(F.col("bits").bitwiseAND(IS_NAME - 1) != 0, "abbreviation").when(F.col("bits").bitwiseAND(IS_NAME) != 0, "name").otherwise("common")
    return useful.where("bits > 0").select("token", kind.alias("kind"), "bits")


def _cut(schema_key: str, corpus=None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = Segmenter(corpus.value) if corpus is not None else None
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                segmenter = shared or Segmenter(dict(zip(row.tokens, row.bits)) if row.tokens is not None else {})
                rows += [(row.doc, k) for k in segmenter.ends(row.text)]
            yield pd.DataFrame(rows, columns=["doc", "end_offset"]).astype({"end_offset": "int64"})

    return run, f"doc {schema_key}, end_offset long"


def sentence_ends(documents: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = DECISIONS_BROADCAST) -> DataFrame:
    """``key, end_offset`` of every sentence of every document; ``key`` is unique, else each row of it has its own ends.

    The corpus' decisions are written once and broadcast while there are at most ``broadcast_rows``
    of them; beyond that each document is joined with the decisions on its own tokens.  Null and
    blank texts have no sentence, a placeholder is one; texts of any length are read whole.
    """
    spark = documents.sparkSession
    kind = dict(documents.dtypes)[key]
    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    decisions = Scratch(spark).save(corpus_decisions(rows), "decisions")
    if decisions.count() <= broadcast_rows:
        run, schema = _cut(kind, spark.sparkContext.broadcast({r.token: r.bits for r in decisions.collect()}))
        return rows.mapInPandas(run, schema).withColumnRenamed("doc", key)

    def own_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [(d, w) for d, t in zip(batch["doc"], batch["text"]) for w in asked_tokens(t)]
            yield pd.DataFrame(pairs, columns=["doc", "token"])

    own = rows.mapInPandas(own_tokens, f"doc {kind}, token string").join(decisions, "token")
    lists = own.groupBy("doc").agg(F.collect_list(F.struct("token", "bits")).alias("known"))
    lists = lists.select(F.col("doc").alias("__doc"), F.col("known.token").alias("tokens"), F.col("known.bits").alias("bits"))
    run, schema = _cut(kind)
    return rows.join(lists, F.col("doc") == F.col("__doc"), "left").drop("__doc").mapInPandas(run, schema).withColumnRenamed("doc", key)


def asked_tokens(text: str) -> set[str]:
    """Every token of a text about which its segmentation may ask the corpus."""
    words = {w.casefold() for w in _WORD.findall(text)}
    return words | {f"{w} #" for w in words} | {"# #"} | {kind for kind, _ in dot_contexts(text, Tokens(text), (), ())}
