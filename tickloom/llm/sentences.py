"""Sentence units of texts in any script, by a hidden-event n-gram model.

Between the words of a paragraph stand hidden events: a boundary or none. Places where a boundary may
stand are found by structure (after closing marks and what closes with them; in scripts
that end sentences with a space, such as Thai, at spaces without a digit beside them). The n-gram model gives for each place

* with a boundary: P(boundary | two words before) P(two words after | boundary);
* without: P(none | two words before) P(two words after | none);

each n-gram smoothed by the next shorter one, the single word by its class (script, mark, what closes, shape of the
word), the class by a weak guess. Events depend on each other by length: after a boundary, P(boundary | tokens since it). Forward-backward
over the places of a paragraph, whose start is a boundary, gives the posterior of each event; above one half, a unit ends there.

Nothing is labelled. Ends and beginnings of paragraphs are certain boundaries; within paragraphs events are hidden, but a
sentence ends within a paragraph ``rho`` times as often as at its end, so of the ``open`` places where an n-gram stands
within paragraphs, about ``rho * sure`` are boundaries, where ``sure`` counts it at paragraphs' ends. ``rho`` of a script is the
median of open / sure over the ends, weighted by sure: most words at ends are no abbreviations.

All documents are counted, by exact sums of n-grams. The model keeps a vocabulary of ``VOCABULARY`` places: of the n-grams whose hashes share
a place, the most frequent one stays. The others are unknown to the model, as rare words are to any n-gram model, and are taken
by the next shorter n-gram or their class. So its size is bounded, counts are never mixed, and what it keeps of a growing
corpus are its most frequent n-grams.

Structure first: blank lines end units; single line breaks do not; within quotations
and brackets that close in the same paragraph nothing ends.

Defined results: null, empty and blank texts have no unit; a block without letters is one
unit like any other; repeated rows give their units again; whole texts of any length are split;
rows with a null id keep it; an empty frame gives an empty one; of other columns only the id is kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = 1 << 20  # n-grams the model can hold
KEPT = 4.0  # weight of the shorter n-gram, or of the class, against the counts
SEEN = 5  # a type counts at most so often for its class
SIGMAS = 2.0  # a count is above another only by more than so many standard deviations
SLACK = 0.2  # rho of a word may be above that of its script by so much
LENGTH = 0.5  # weight of the length, which says in part what the words say
LONGEST = 40  # longer sentences are alike in length
MEMO = 200_000  # odds kept by a worker; they are the same when computed again
BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*")
ODD_SPACES = "\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NUMBER = re.compile(r"\s*(?:[\[(（【]\d{1,4}[\])）】]|(?:Rn|No|Nr|n)\. ?\d{1,4}|§ ?\d{1,4}|\d{1,4}(?:\.º|[.)º．、])|\d{1,4}(?=[ 　]))(?=\s|\D)\s*")
FULL = "。！？｡।॥؟۔።።"
#: Nothing ends before a digit, or before a small letter, of the next word too.
GOES_ON = r"(?!\d| ?[a-zß-öø-ÿά-ώа-яё])"
TERMINAL = re.compile(r"[.!?…。！？｡।॥؟۔።‼⁇⁈⁉]++" + GOES_ON)
#: In Greek letters a semicolon (U+003B or U+037E) asks.
GREEK_TERMINAL = re.compile("(?:[.!?…]++|(?<=[\u0370-\u03ff\u1f00-\u1fff])[;\u037e])" + GOES_ON)
#: Where a block has no capitals at all, small letters tell nothing.
UNCASED_TERMINAL = re.compile(r"[.!?…。！？｡।॥؟۔።‼⁇⁈⁉]++(?!\d)")
ANY_TERMINAL = re.compile(r"[.!?…。！？｡।॥؟۔።‼⁇⁈⁉]")
GREEK = re.compile("[α-ω]")
CLOSING = re.compile("[”’'»›)\\]」』）】》〉]*(?:[ ]»)?[)\\]」』）】]*")
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", '"': '"', "（": "）", "(": ")", "[": "]"}
OPENER = re.compile("[“„«「『\"（(\\[]")
OPENING = "\"“„«‹‘([「『（【《¿¡—–- "
DIGITS = re.compile(r"\d+")
TAIL = ".,;:!?…\"”“’»)]」』）】"
#: Scripts whose sentences end with a space.
SPACE_ENDS = "\u0e00-\u0eff\u1780-\u17ff"
SPACE_ENDED = re.compile(f"[{SPACE_ENDS}]")
GAP = re.compile(f"(?<=[^\\s\\d]) +(?=[{SPACE_ENDS}])|(?<=[{SPACE_ENDS}]) +(?=[^\\s\\d])")
LETTER = re.compile(r"[^\W\d_]")
#: No spaces between words.
DENSE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")


def blocks(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in BLANK_LINE.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def spaced(text: str) -> str:
    """The text with every white space a plain one, line breaks kept."""
    for c in ODD_SPACES[:8] if text.isascii() else ODD_SPACES:
        if c in text:
            text = text.replace(c, " ")
    return text


def spans_of(s: str, body: int) -> list[tuple[int, int]]:
    """Outermost quotations and brackets that close within the block."""
    out, at = [], body
    ahead: dict[str, int] = {}  # next place of each closing mark; -1 if none is left
    while m := OPENER.search(s, at):
        a = m.start()
        z = -1
        for c in PAIRS[m.group()]:
            e = ahead.get(c, 0)
            if 0 <= e <= a:  # passed: each mark is sought once over the whole block
                e = ahead[c] = s.find(c, a + 1)
            if e >= 0 and (z < 0 or e < z):
                z = e
        if z < 0:
            at = a + 1
        else:
            out.append((a, z + 1))
            at = z + 1
    return out


class _Folded(dict):
    """Words with their numbers folded; a bounded memo."""

    def __missing__(self, w: str) -> str:
        if len(self) >= MEMO:
            self.clear()
        got = self[w] = DIGITS.sub("9", w)
        return got


FOLD = _Folded()


def _script(m: re.Match | None) -> str:
    c = ord(m.group()) if m else 65
    if c < 0x370:
        return "l"
    if c < 0x400 or 0x1F00 <= c < 0x2000:
        return "g"
    if c < 0x590:
        return "c"
    if c < 0x900:
        return "a"
    if c < 0xE00:
        return "d"
    if c < 0xF00 or 0x1780 <= c < 0x1800:
        return "t"
    return "z" if DENSE.match(m.group()) else "o"


def script_of(s: str, body: int = 0) -> str:
    """The script of a block, as two of three of its letters have it."""
    third = (len(s) - body) // 3
    first = _script(LETTER.search(s, body))
    second = _script(LETTER.search(s, body + third))
    return first if first == second else _script(LETTER.search(s, body + 2 * third))


#: (script, word before the last, word before, marks, span)
Left = tuple[str, str, str, str, str]
#: (script, word after, the next, opened, span)
Right = tuple[str, str, str, bool, str]
#: (end, tokens since the place before, what stands before, what stands after)
Place = tuple[int, int, Left, Right | None]


def places(s: str, body: int, script: str, terminal: re.Pattern = TERMINAL, flat: bool = False, last: bool = True) -> tuple[list[Place], Place | None]:
    """Every place within the block where a unit could end, and (``last``) the end of the block if it is one.

    ``s`` has plain spaces only; ``body`` is where its number ends; ``flat``: all its letters are of one case. The span is the
    kind of what closes at the place: ``quote-first``, ``quote``, ``bracket-first``, ``bracket`` or nothing.
    """
    out: list[Place] = []
    final: Place | None = None
    spans: list[tuple[int, int]] | None = None
    k, n, done, since = 0, len(s), body, body
    dense = script == "z"
    fold, rfind, find = FOLD, s.rfind, s.find
    for m in terminal.finditer(s, body):
        a, z = m.span()
        if a < done:
            continue
        c = s[z : z + 1]
        if c == " " and s[z + 1 : z + 2] != "»" or not c:
            end = z
        else:
            end = CLOSING.match(s, z).end()
        if spans is None:
            spans = spans_of(s, body)
        span = ""
        if spans:
            while k < len(spans) and spans[k][1] <= a:
                k += 1
            if k < len(spans) and spans[k][0] < a:
                if end == spans[k][1] - 1 and s[end] in "“\"":  # these open elsewhere
                    end = CLOSING.match(s, end + 1).end()
                if end < spans[k][1]:
                    continue
                before = s[body : spans[k][0]].rstrip()
                first = not before or before[-1] in ".!?。！？।؟" or (before[-1] in "”»“\"」）)" and before[-2:-1] in ".!?。！？।؟ ")
                span = ("bracket" if s[spans[k][0]] in "([（" else "quote") + ("-first" if first else "")
        done = nxt = end
        while nxt < n and s[nxt] == " ":
            nxt += 1
        if nxt >= n and not last:
            break
        marks = s[a:z]
        if dense:
            w1, w0 = s[max(body, a - 2) : z], s[max(body, a - 4) : max(body, a - 2)]
            tokens = (a - since) // 2 + 1
        else:
            start = rfind(" ", 0, a) + 1
            w1 = s[start:z]
            if w1[0] in OPENING:
                w1 = w1.lstrip(OPENING)
            w1 = fold[w1]
            w0 = fold[s[rfind(" ", 0, start - 1) + 1 : start - 1].lstrip(OPENING)] if start > body + 1 else ""
            tokens = s.count(" ", since, a) + 1
        if nxt >= n:
            final = (end, tokens, (script, w0, w1, marks, span), None)
            break
        word = nxt
        while word < n and s[word] in OPENING and s[word] != "[":
            word += 1
        if dense:
            w2, w3 = s[word : word + 2], s[word + 2 : word + 4]
        else:
            stop = find(" ", word)
            if stop < 0:
                w2, w3 = fold[s[word:].rstrip(TAIL)], ""
            else:
                w2 = fold[s[word:stop].rstrip(TAIL)]
                stop2 = find(" ", stop + 1)
                w3 = fold[(s[stop + 1 :] if stop2 < 0 else s[stop + 1 : stop2]).rstrip(TAIL)]
        if nxt == end and marks[-1] not in FULL:
            # a space is missing: only a word that ended before a capital
            x, y, ends = w2[:1], w2[1:2], w1[-2:-1]
            if flat:
                x, y, ends = x.upper(), y.lower(), ends.lower()
            if not x.isupper() or not span and not (y.islower() and (marks[-1] in "!?" or ends.islower() or ends in "9)]%")):
                continue
        since = nxt
        out.append((end, tokens, (script, w0, w1, marks, span), (script, w2, w3, word > nxt, span)))
    if script == "t":
        out, final = _gaps(s, body, out)
    return out, final


def _piece(w: str, last: bool) -> str:
    """A word that may be a whole clause: its end or its beginning stands for it."""
    w = FOLD[w]
    return w if len(w) <= 12 else "~" + w[-6:] if last else w[:6] + "~"


def _gaps(s: str, body: int, marked: list[Place]) -> tuple[list[Place], Place | None]:
    """Places at spaces, beside those after marks."""
    out: list[Place] = []
    since = body
    for m in GAP.finditer(s, body):
        a, b = m.span()
        stop = s.find(" ", b)
        w1, w2 = s[s.rfind(" ", 0, a) + 1 : a], s[b:] if stop < 0 else s[b:stop]
        out.append((a, s.count(" ", since, a) + 1, ("t", "", _piece(w1, True), " ", ""), ("t", _piece(w2, False), "", False, "")))
        since = b
    end = len(s.rstrip())
    final = None
    if end > body and (body or " " in s[body:end].strip()):
        final = (end, s.count(" ", since, end) + 1, ("t", "", _piece(s[s.rfind(" ", 0, end) + 1 : end], True), " ", ""), None)
    if marked:
        at = {p[0] for p in out}
        out = sorted([*out, *(p for p in marked if p[0] not in at)])
    return out, final


def _number_end(s: str) -> int:
    m = NUMBER.match(s)
    return m.end() if m and m.end() < len(s) else 0


def _recased(p: Place) -> Place:
    """The words as they would stand in a text of both cases."""
    end, tokens, (script, w0, w1, *rest), right = p
    if right:
        _, w2, w3, opened, span = right
        right = (script, w2[:1].upper() + w2[1:].lower(), w3.lower(), opened, span)
    return end, tokens, (script, w0.lower(), w1.lower(), *rest), right


def _read(plain: str, last: bool = True) -> Iterator[tuple[int, str, int, str, list[Place], Place | None]]:
    """(start, block, end of its number, script, places, final place) of each block."""
    greek = GREEK_TERMINAL if not plain.isascii() and GREEK.search(plain) else TERMINAL
    by_marks = greek is TERMINAL and (plain.isascii() or not SPACE_ENDED.search(plain))
    for a, z in blocks(plain):
        s = plain[a:z].replace("\n", " ")
        if by_marks and not ANY_TERMINAL.search(s):  # a heading, a name: no places
            yield a, s, 0, "l", [], None
            continue
        body = _number_end(s)
        script = "l" if s.isascii() else script_of(s, body)
        small = s.islower()
        flat = small or s.isupper()
        found, final = places(s, body, script, UNCASED_TERMINAL if small else greek, flat, last)
        if flat:
            found, final = [_recased(p) for p in found], final and _recased(final)
        yield a, s, body, script, found, final


# n-grams and classes


def _left_class(script: str, w: str, marks: str, span: str) -> str:
    mark = marks[-1]
    shape = ""
    if not span and mark in ".…":
        core = w.rstrip(".…")
        if not core:
            shape = "-"
        elif core[-1].isdigit():
            shape = "9"
        elif w.endswith("...") or mark == "…":
            shape = "e"
        elif len(core) == 1:
            shape = "i"
        elif "." in core:
            shape = "p"
        else:
            shape = ("S" if core[0].isupper() else "s") + str(min(len(core), 7))
    return f"{script}{mark}{span}:{shape}"


def _left_guess(script: str, cls: str) -> float:
    """What a class is taken for while nothing is counted."""
    mark, (span, shape) = cls[1], cls[2:].split(":")
    if mark == " ":
        return 0.9
    if mark in FULL:
        return 0.02 if span in ("quote-first", "bracket") else 0.97
    if span.startswith("bracket") and mark == "…":
        return 0.02
    if mark in "!?;\u037e" or span:
        return 0.95
    if shape[:1] in ("-", "9", "e", "i", "p", ""):
        return {"-": 0.1, "9": 0.5, "e": 0.3, "i": 0.08, "p": 0.08, "": 0.9}[shape[:1]]
    return 0.9 if shape[1:] > "3" else 0.15 if shape[0] == "S" else 0.5


def _right_class(script: str, w: str, opened: bool, span: str) -> str:
    c = w[:1]
    kind = "-" if not c else "9" if c.isdigit() else "l" if c.islower() else "U" if c.isupper() else "n" if c.isalpha() else "," if c in ",;:、，；：と" else "o"
    return f"{script}{kind}{'q' if opened else ''}{span[:1] if kind == 'l' else ''}"


def _right_guess(cls: str) -> float:
    return {"-": 0.5, "9": 0.4, "l": 0.02, "U": 0.8, "n": 0.6, ",": 0.02, "o": 0.5}[cls[1]]


def _key(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts)) - (1 << 63)


def _bounds(sure, open_, rho: float, prior):
    """Of the open places of a type, how many may be boundaries: only what exceeds ``rho * sure`` by more than chance is none."""
    seen = sure + prior
    return np.minimum(open_, rho * ((1 + SLACK) * seen + SIGMAS * np.sqrt(sure)))


def _share(sure: float, open_: float, rho: float, prior: float) -> float:
    """Of the open places of a type, the share that are boundaries."""
    seen = sure + prior
    return (min(open_, rho * ((1 + SLACK) * seen + SIGMAS * math.sqrt(sure))) + KEPT * prior) / (open_ + KEPT)


def _rho(sure: np.ndarray, open_: np.ndarray) -> float:
    """Boundaries within paragraphs for each at an end: the median of open / sure, weighted by sure."""
    often = sure >= 5
    if sure[often].sum() >= 50:
        sure, open_ = sure[often], open_[often]
    if sure.sum() < 20:
        return float((open_.sum() + 1) / (sure.sum() + 1))
    ratio = open_ / np.maximum(sure, 1e-9)
    order = np.argsort(ratio)
    mass = np.cumsum(sure[order])
    return max(float(ratio[order][np.searchsorted(mass, mass[-1] / 2)]), 0.05)


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


class Model:
    """The vocabulary: hashes in order, with the counts at the sure and at the open places; classes and scripts."""

    def __init__(self, rows: pd.DataFrame):
        """``rows`` (h, kind, cls, sure, open), one of each n-gram."""
        rows = rows.sort_values("h")
        self.h = rows.h.to_numpy(np.int64)
        self.sure, self.open = rows.sure.to_numpy(np.int64), rows.open.to_numpy(np.int64)
        self.rho: dict[str, float] = {}
        self.base: dict[str, float] = {}
        self.classes: dict[str, float] = {}
        self._memo: dict[tuple, float] = {}
        ends = rows[rows.kind == "e"]
        for script, g in ends.groupby(ends.cls.str[0]):
            self.rho[script] = _rho(g.sure.to_numpy(float), g.open.to_numpy(float))
        for kind, guess in (("e", lambda c: _left_guess(c[0], c)), ("b", _right_guess)):
            of = rows[rows.kind == kind]
            for cls, g in of.groupby("cls"):
                rho, p = self.rho.get(cls[0], 1.0), guess(cls)
                weight = np.minimum(g.open.to_numpy(float), SEEN)
                share = _bounds(g.sure.to_numpy(float), g.open.to_numpy(float), rho, p) / np.maximum(g.open.to_numpy(float), 1)
                self.classes[kind + cls] = float(((weight * share).sum() + KEPT * p) / (weight.sum() + KEPT))
        for script, g in ends.groupby(ends.cls.str[0]):
            p = np.array([self.classes["e" + c] for c in g.cls])
            b = _bounds(g.sure.to_numpy(float), g.open.to_numpy(float), self.rho[script], p).sum()
            self.base[script] = float((b + KEPT / 2) / (g.open.sum() + KEPT))
        lengths = rows[rows.kind == "k"]
        self.length: dict[tuple[str, int], float] = {}
        for script, g in lengths.groupby(lengths.cls.str[0]):
            rho = _rho(g.sure.to_numpy(float), g.open.to_numpy(float))
            for cls, sure, open_ in zip(g.cls, g.sure, g.open):
                base = self.base.get(script, 0.5)
                share = max(_share(sure, open_, rho, base), 0.01)
                if share < base:  # sentences so short are rarer; no length is a reason to end
                    far = LENGTH * _logit(share) + (1 - LENGTH) * _logit(base)
                    self.length[script, int(cls[1:])] = 1 / (1 + math.exp(-far))

    def counts(self, *parts: str) -> tuple[int, int]:
        key = _key(*parts)
        i = int(np.searchsorted(self.h, key))
        return (int(self.sure[i]), int(self.open[i])) if i < len(self.h) and self.h[i] == key else (0, 0)

    def odds(self, left: Left, right: Right) -> float:
        """Log odds of a boundary against none, by the n-grams around the place alone."""
        memo = self._memo
        a, b = memo.get(left), memo.get(right)
        if a is None or b is None:
            if len(memo) >= MEMO:
                memo.clear()
            a = memo[left] = self._before(*left)
            b = memo[right] = self._after(*right)
        return a + b

    def _before(self, script: str, w0: str, w1: str, marks: str, span: str) -> float:
        """Log odds of a boundary after these words."""
        rho = self.rho.get(script, 1.0)
        cls = _left_class(script, w1, marks, span)
        p = self.classes.get("e" + cls)
        p = _share(*self.counts("e", cls, w1), rho, _left_guess(script, cls) if p is None else p)
        if w0:
            p = _share(*self.counts("f", cls, w0, w1), rho, p)
        return _logit(p)

    def _after(self, script: str, w2: str, w3: str, opened: bool, span: str) -> float:
        """Log of P(words after | boundary) / P(words after | none)."""
        rho = self.rho.get(script, 1.0)
        cls = _right_class(script, w2, opened, span)
        p = self.classes.get("b" + cls)
        p = _share(*self.counts("b", cls, w2), rho, _right_guess(cls) if p is None else p)
        if w3:
            p = _share(*self.counts("c", cls, w2, w3), rho, p)
        return _logit(p) - _logit(self.base.get(script, 0.5))

    def decide(self, script: str, odds: list[float], tokens: list[int], forward_backward: bool = True) -> list[bool]:
        """The events of a paragraph: posterior of a boundary above one half. Without ``forward_backward`` each place by itself."""
        if not forward_backward:
            return [x > 0 for x in odds]
        base = self.base.get(script, 0.5)
        # P(boundary | boundary so many tokens before); the start of a paragraph is one
        length = self.length
        after = [length.get((script, k if k < LONGEST else LONGEST), base) for k in tokens]
        if after.count(base) == len(after):  # the events do not depend on each other here
            return [x > 0 for x in odds]
        shift = _logit(base)
        n = len(odds)
        like = [math.exp(min(max(x - shift, -30.0), 30.0)) for x in odds]
        fw = []
        f0, f1 = 0.0, 1.0
        for x, h in zip(like, after):
            y1 = (f0 * base + f1 * h) * x
            y0 = f0 * (1 - base) + f1 * (1 - h)
            t = y0 + y1
            f0, f1 = y0 / t, y1 / t
            fw.append((f0, f1))
        out = [False] * n
        g0 = g1 = 1.0
        for i in range(n - 1, -1, -1):
            f0, f1 = fw[i]
            out[i] = f1 * g1 > f0 * g0
            x, h = like[i], after[i]
            e0, e1 = g0, x * g1
            g0, g1 = (1 - base) * e0 + base * e1, (1 - h) * e0 + h * e1
            t = g0 + g1
            g0, g1 = g0 / t, g1 / t
        return out


def units(text: str, model: Model, forward_backward: bool = True) -> list[tuple[int, int]]:
    """(start, end) of the units of a text, in code points."""
    out = []
    odds = model.odds
    for a, s, _, script, found, _ in _read(spaced(text), False):
        ends: list[int] = []
        if found:
            yes = model.decide(script, [odds(p[2], p[3]) for p in found], [p[1] for p in found], forward_backward)
            ends = [p[0] for p, y in zip(found, yes) if y]
        at, n = 0, len(s)
        for e in (*ends, n):
            while at < e and s[at] == " ":
                at += 1
            j = e
            while j > at and s[j - 1] == " ":
                j -= 1
            if at < j:
                out.append((a + at, a + j))
            at = e
    return out


def count(text: str, table: Counter) -> None:
    """Add what the paragraphs of a text say: what stands before and after their places, at sure (0) and at open ones (1)."""
    for _, s, body, script, found, final in _read(spaced(text)):
        k = 0
        for p in found:
            table[p[2], 1] += 1
            table[p[3], 1] += 1
            if not k:
                k = p[1] if p[1] < LONGEST else LONGEST
                table[(script, k), 1] += 1
        if final:
            words = s[body:].lstrip(OPENING)
            opened = len(words) < len(s) - body
            if script == "z":
                w2, w3 = words[:2], words[2:4]
            elif script == "t":
                w2, w3 = _piece(words.split(" ", 1)[0], False), ""
            else:
                two = words.split(None, 2)
                w2 = FOLD[two[0].rstrip(TAIL)] if two else ""
                w3 = FOLD[two[1].rstrip(TAIL)] if len(two) > 1 else ""
                if s.islower() or s.isupper():
                    w2, w3 = w2[:1].upper() + w2[1:].lower(), w3.lower()
            table[final[2], 0] += 1
            table[(script, w2, w3, opened, ""), 0] += 1
            if not found:
                table[(script, min(final[1], LONGEST)), 0] += 1


def ngrams(table: Counter) -> Counter:
    """Counts by (n-gram, kind, class, open)."""
    out: Counter = Counter()
    for (place, c), n in table.items():
        if len(place) == 2:
            script, k = place
            out[_key("k", script, str(k)), "k", f"{script}{k}", c] += n
        elif isinstance(place[3], bool):
            script, w2, w3, opened, span = place
            cls = _right_class(script, w2, opened, span)
            out[_key("b", cls, w2), "b", cls, c] += n
            if w3:
                out[_key("c", cls, w2, w3), "c", cls, c] += n
        else:
            script, w0, w1, marks, span = place
            cls = _left_class(script, w1, marks, span)
            out[_key("e", cls, w1), "e", cls, c] += n
            if w0:
                out[_key("f", cls, w0, w1), "f", cls, c] += n
    return out


def _batch(table: Counter) -> pa.RecordBatch:
    g = ngrams(table)
    keys = list(g)
    columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array([k[3] for k in keys], pa.int32()), pa.array(list(g.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["h", "kind", "cls", "c", "n"])


def model_of(texts: Iterable[str]) -> Model:
    """The model of a few texts at hand."""
    table: Counter = Counter()
    for t in texts:
        count(t, table)
    df = _batch(table).to_pandas()
    df = df.assign(sure=df.n.where(df.c == 0, 0), open=df.n.where(df.c == 1, 0))
    return Model(df.groupby(["h", "kind", "cls"], as_index=False)[["sure", "open"]].sum())


def train(docs: DataFrame, text: str = "text") -> Model:
    """The model of a corpus, from the counts of all its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                count(t, table)
                if len(table) > 500_000:  # the words of one task alone must not fill its memory
                    yield _batch(table)
                    table.clear()
        yield _batch(table)

    rows = docs.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "h bigint, kind string, cls string, c int, n bigint")
    types = rows.groupBy("h").agg(F.first("kind").alias("kind"), F.first("cls").alias("cls"), F.sum(F.when(F.col("c") == 0, F.col("n")).otherwise(0)).alias("sure"), F.sum(F.when(F.col("c") == 1, F.col("n")).otherwise(0)).alias("open"))
    # at most VOCABULARY rows come to the driver
    kept = types.groupBy(F.pmod(F.col("h"), F.lit(VOCABULARY)).alias("place")).agg(F.max(F.struct((F.col("sure") + F.col("open")).alias("n"), "h", "kind", "cls", "sure", "open")).alias("r"))
    return Model(kept.select("r.h", "r.kind", "r.cls", "r.sure", "r.open").toPandas())


def split_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_char, end_char) of each unit; offsets in code points, end excluded."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, end = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for s, e in units(t, model.value):
                    row.append(i)
                    start.append(s)
                    end.append(e)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=[doc_id, "start_char", "end_char"])

    return docs.where(F.col(text).isNotNull()).select(doc_id, text).mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, start_char int, end_char int")
