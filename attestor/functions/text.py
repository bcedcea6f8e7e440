"""Text mechanics: folding, tokens, sentences, paragraphs, boundaries, occurrences, windows, names, labels.

Plain functions over one string come first; below them are the same as columns, native where an expression suffices and
Arrow-batched UDFs where offsets are needed.  Offsets are code points.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, functions as F, types as Ty


class Span(NamedTuple):
    start: int
    end: int
    text: str


_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}'’\-]*")
_STOP = regex.compile(r"[.!?][\"'”’)\]]*(?=\s|$)")
_BLANK_LINES = regex.compile(r"\n[ \t]*\n+")
_BREAK = regex.compile(r"[;:—–()\[\]|]|--")
_ASCII_WORDS = regex.compile(r"[A-Za-z0-9]+")
_KEPT = regex.compile(r"[\p{L}\p{N}]")

# Words whose full stop does not end a sentence.
ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr st mt rev hon gov sen rep inc ltd llc llp plc co corp no vs etc al approx est u.s u.k e.g i.e a.m p.m".split())
# Words that add nothing but a type to a label.
GENERIC_WORDS = frozenset(
    "activity activities business businesses company companies firm firms fund funds group industry industries management market markets operation operations practice "
    "sector sectors service services space work works investing investment investments".split()
)


# ---- one string -----------------------------------------------------------------------------------------------


def squeeze(text: str | None) -> str:
    return " ".join((text or "").split())


def folded(text: str | None) -> tuple[str, list[int]]:
    """Lower-case letters and digits without accents, runs of anything else as one blank, and each character's origin."""
    text = text or ""
    if text.isascii():  # nothing to decompose: words keep their places
        words = list(_ASCII_WORDS.finditer(text))
        origin = []
        for k, m in enumerate(words):
            origin.extend(range(m.start(), m.end()))
            if k + 1 < len(words):
                origin.append(m.end())
        return " ".join(m.group() for m in words).lower(), [*origin, len(text)]
    chars: list[str] = []
    origin: list[int] = []
    for i, ch in enumerate(text):
        for c in unicodedata.normalize("NFKD", ch).lower():
            if "̀" <= c <= "ͯ":
                continue
            if _KEPT.match(c):
                chars.append(c)
                origin.append(i)
            elif chars and chars[-1] != " ":
                chars.append(" ")
                origin.append(i)
    if chars and chars[-1] == " ":
        chars.pop()
        origin.pop()
    return "".join(chars), [*origin, len(text)]


def fold(text: str | None) -> str:
    return folded(text)[0]


def label_key(label: str | None) -> str:
    """Folded label without possessives and plural endings of longer words."""
    words = fold(regex.sub(r"['’]s\b", "", label or "")).split()
    return " ".join(regex.sub(r"([^s])s$", r"\1", regex.sub(r"ies$", "y", w)) if len(w) > 3 else w for w in words)


def tokens(text: str) -> list[Span]:
    return [Span(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]


def sentences(text: str) -> list[Span]:
    """Sentences with closing quotes; a stop after an abbreviation or an initial does not end one."""
    out, start = [], 0
    for m in _STOP.finditer(text):
        if m.start() < start:
            continue
        if text[m.start()] == ".":
            word = regex.search(r"[\p{L}.]+$", text[max(0, m.start() - 12) : m.start()])
            if word and (word.group().lower() in ABBREVIATIONS or regex.fullmatch(r"\p{Lu}", word.group())):
                continue
        if text[start : m.end()].strip():
            out.append(Span(start, m.end(), text[start : m.end()]))
        start = m.end()
        while start < len(text) and text[start].isspace():
            start += 1
    if text[start:].strip():
        out.append(Span(start, len(text), text[start:]))
    return out


def paragraphs(text: str) -> list[Span]:
    cuts = [0, *(x for m in _BLANK_LINES.finditer(text) for x in m.span()), len(text)]
    return [Span(a, b, text[a:b]) for a, b in zip(cuts[::2], cuts[1::2]) if text[a:b].strip()]


class Layout:
    """Sentences, paragraphs and tokens of one text, and how far apart its offsets lie."""

    def __init__(self, text: str):
        self.text = text
        self.sentences, self.paragraphs, self.tokens = sentences(text), paragraphs(text), tokens(text)
        self._starts = {kind: [s.start for s in getattr(self, kind)] for kind in ("sentences", "paragraphs", "tokens")}

    def index(self, kind: str, at: int) -> int:
        """Number of the span that holds the offset, else of the last one; -1 without spans."""
        spans = getattr(self, kind)
        i = bisect_right(self._starts[kind], at) - 1
        return i if i >= 0 and at < spans[i].end else len(spans) - 1

    def token(self, at: int) -> int:
        """Number of the token nearest to the offset."""
        i = max(bisect_right(self._starts["tokens"], at) - 1, 0)
        around = self.tokens[i : i + 2]
        gaps = [0 if w.start <= at < w.end else min(abs(w.start - at), abs(w.end - at)) for w in around]
        return i + gaps.index(min(gaps))

    def distance(self, a: int, b: int) -> int:
        return abs(self.token(a) - self.token(b)) if self.tokens else abs(a - b)

    def boundary(self, a: int, b: int) -> str:
        """How close two offsets lie: same clause, sentence, adjacent sentence, same paragraph, or further."""
        i, j = self.index("sentences", a), self.index("sentences", b)
        if i == j and i >= 0:
            return "same_sentence" if _BREAK.search(self.text, min(a, b), max(a, b)) else "same_clause"
        if i >= 0 and j >= 0 and abs(i - j) == 1:
            return "adjacent_sentence"
        p = self.index("paragraphs", a)
        return "same_paragraph" if p >= 0 and p == self.index("paragraphs", b) else "different_paragraph"


def boundary(text: str, a: int, b: int) -> str:
    return Layout(text).boundary(a, b)


def token_distance(text: str, a: int, b: int) -> int:
    return Layout(text).distance(a, b)


def occurrences(text: str, phrases: Iterable[str]) -> list[Span]:
    """Word-bounded places of the phrases, folded; those of one phrase do not overlap.  text is the phrase found."""
    hay, origin = folded(text)
    found = []
    for phrase in phrases:
        needle = fold(phrase)
        if needle:
            for m in regex.finditer(regex.escape(needle), hay):
                if (m.start() == 0 or hay[m.start() - 1] == " ") and (m.end() == len(hay) or hay[m.end()] == " "):
                    found.append(Span(origin[m.start()], origin[m.end()], phrase))
    return sorted(found, key=lambda s: s.start)


def evidence_window(text: str, at: int, reach: int = 1000, layout: Layout | None = None) -> dict:
    """The paragraph and the neighbouring sentences around an offset, within ``reach`` characters of it."""
    layout = layout or Layout(text)
    by_sentence, i, p = layout.sentences, layout.index("sentences", at), layout.index("paragraphs", at)
    near = [by_sentence[k] if i >= 0 and 0 <= k < len(by_sentence) else None for k in (i - 1, i, i + 1)]
    paragraph = layout.paragraphs[p] if p >= 0 else None
    low, high = max(0, at - reach), min(len(text), at + reach)
    words = [squeeze(s.text) if s else "" for s in near]
    return {"text": text[low:high], "offset": low, "sentence": words[1], "previous": words[0], "next": words[2], "paragraph": squeeze(paragraph.text)[: 2 * reach] if paragraph else ""}


def windows(text: str, names: Sequence[str], most: int = 6, reach: int = 1000) -> list[tuple[int, int]]:
    """(start, end) of the evidence windows around the names; overlapping ones are one."""
    out: list[list[int]] = []
    for hit in occurrences(text, names):
        start, end = max(0, hit.start - reach), min(len(text), hit.start + reach)
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        elif len(out) < most:
            out.append([start, end])
        if len(out) >= most:
            break
    return [(a, b) for a, b in out]


def name_variants(name: str, kind: str = "person") -> list[str]:
    """Shorter forms under which a person or organisation is written about."""
    name = squeeze(name)
    parts = name.split()
    if kind != "person":
        forms = [regex.sub(r"(?i),?\s+(inc|llc|ltd|plc|corp|corporation|company|co)\.?$", "", name).strip()]
    elif len(parts) >= 3:
        initials = [p[0].upper() for p in parts[1:-1]]
        forms = [" ".join([parts[0], *(i + "." for i in initials), parts[-1]]), " ".join([parts[0], *initials, parts[-1]]), f"{parts[0]} {parts[-1]}"]
    else:
        forms = [f"{parts[0][0]}. {parts[1]}"] if len(parts) == 2 else []
    return [f for f in dict.fromkeys(forms) if f and f != name]


def is_generic_variant(shorter: str, longer: str) -> bool:
    """Whether the longer label is the shorter one, in order, with generic words only added."""
    want, rest = label_key(shorter).split(), []
    for word in (words := label_key(longer).split()):
        if want and word == want[0]:
            want = want[1:]
        else:
            rest.append(word)
    return bool(label_key(shorter)) and bool(words) and not want and bool(rest) and set(rest) <= GENERIC_WORDS


def quotations(text: str) -> list[str]:
    return regex.findall(r"[“\"]([^”\"]+)[”\"]", text or "")


def person_names(text: str, known: Iterable[str] = ()) -> list[str]:
    """Runs of two or three title-case words that hold no word of the known names."""
    skip = {w for n in known for w in fold(n).split() if len(w) > 2}
    found = regex.findall(r"\b[A-Z][a-z’'-]+(?:\s+[A-Z]\.)?(?:\s+[A-Z][a-z’'-]+){1,2}\b", text or "")
    return [n for n in dict.fromkeys(found) if not skip & set(fold(n).split())]


# ---- columns --------------------------------------------------------------------------------------------------


def _accents() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode's own decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFKD", chr(c))) == 2 and unicodedata.normalize("NFKD", chr(c))[1] in "̧̨̀́̂̃̄̆̇̈̊̋̌"]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def squeezed_column(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def folded_column(text: Column) -> Column:
    """fold() for Latin text, without Python."""
    return F.trim(F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), ACCENTED, PLAIN)), r"[^\p{L}\p{N}]+", " "))


def words_column(text: Column) -> Column:
    return F.filter(F.split(folded_column(text), " "), lambda w: w != "")


def label_key_column(label: Column) -> Column:
    plain = lambda w: F.when(F.length(w) > 3, F.regexp_replace(F.regexp_replace(w, "ies$", "y"), "([^s])s$", "$1")).otherwise(w)
    return F.array_join(F.transform(words_column(F.regexp_replace(label, r"['’]s\b", "")), plain), " ")


def token_count_column(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'’\-]*")).cast("long")


def paragraph_count_column(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\n[ \t]*\n+"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")).cast("long")


def sentence_like_column(label: Column) -> Column:
    """Whether a label is a clause rather than a name."""
    text = squeezed_column(label)
    n = F.size(F.split(text, " "))
    return (text == "") | (n > 8) | ((n >= 5) & text.rlike(r"(?i)\b(is|was|are|were|has|have|had|formed by|owned by|founded by|which|that|who)\b"))


def contains_phrase_column(text: Column, phrase: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), folded_column(text), F.lit(" ")), F.concat(F.lit(" "), folded_column(phrase), F.lit(" ")))


SPAN = Ty.ArrayType(Ty.StructType().add("start", Ty.IntegerType()).add("end", Ty.IntegerType()).add("text", Ty.StringType()))


@F.pandas_udf(SPAN)
def sentence_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [s._asdict() for s in sentences(t or "")])


@F.pandas_udf(SPAN)
def paragraph_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [s._asdict() for s in paragraphs(t or "")])


@F.pandas_udf(SPAN)
def token_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [s._asdict() for s in tokens(t or "")])


@F.pandas_udf(Ty.StringType())
def fold_text(texts: pd.Series) -> pd.Series:
    return texts.map(fold)


def occurrence_spans(text: Column, phrases: Sequence[str]) -> Column:
    """Places of a fixed list of phrases, which is sent with the expression."""
    listed = list(phrases)

    @F.pandas_udf(SPAN)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [s._asdict() for s in occurrences(t or "", listed)])

    return find(text)
