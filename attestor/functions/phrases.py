"""Wording and formatting of figures and lists, and names made fit for matching, as column functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from attestor.functions import text as T
from attestor.functions.exprs import half_up

# Numbers written out, suffixes that are no surname, titles of pages that are not the article's.
NUMBER_WORDS = ("no", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md", "esq", "kc", "qc", "cbe", "obe", "mbe")
CHALLENGE_TITLE = r"(?i)^(one moment|just a moment|please wait|attention required|access denied|are you a robot|security check|checking your browser|verify you are human|403|404|page not found)"
BYLINE = r"(?im)^\s*(?:by|written by|opinion by|op-ed by)\s*[:|]?\s+(.{3,80})$"
AUTHOR_META = r"""(?is)<meta[^>]+(?:name|property)=["'](?:author|article:author|parsely-author|sailthru\.author|dc\.creator)["'][^>]*content=["']([^"']+)["']"""


def number_word(n: Column) -> Column:
    """no, one ... ten, then digits."""
    return F.coalesce(F.get(F.array(*map(F.lit, NUMBER_WORDS)), F.when(n.between(0, 10), n.cast("int"))), n.cast("string"))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(number_word(n), F.lit(" "), F.when(n == 1, one).otherwise(many or one + "s"))


def capitalise(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))


def shorten(text: Column, most: int = 110) -> Column:
    body = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(body) > most, F.concat(F.substring(body, 1, most - 1), F.lit("…"))).otherwise(body)


def list_of(items: Column) -> Column:
    """none; a; a and b; a, b and c."""
    n = F.size(items)
    rest = F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(items, -1))
    return F.when(n == 0, "none").when(n == 1, F.get(items, F.lit(0))).otherwise(rest)


def _plain(value: Column, places: int) -> Column:
    """Digits as few as needed: 12.0 is 12."""
    rounded = half_up(value, places)
    return F.when(rounded == F.floor(rounded), rounded.cast("long").cast("string")).otherwise(F.format_string(f"%.{max(places, 1)}f", rounded))


def percent(share: Column) -> Column:
    return F.when(share.isNull(), "—").otherwise(F.concat(_plain(share * 100, 1), F.lit("%")))


def change(share: Column) -> Column:
    return F.when(share.isNull(), "—").otherwise(F.concat(F.when(share >= 0, "+").otherwise(""), _plain(share * 100, 0), F.lit("%")))


def surname(name: Column, kind: Column) -> Column:
    """A person's last name if the name has two parts and the last, suffixes apart, has four letters; else null."""
    parts = F.filter(F.transform(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: F.translate(w, ".,", "")), lambda w: w != "")
    for _ in range(3):  # a name ends in a few suffixes at most
        parts = F.when((F.size(parts) > 2) & F.lower(F.try_element_at(parts, F.lit(-1))).isin(*NAME_SUFFIXES), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    last = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-1)))
    return F.when((kind == "person") & (F.length(T.folded_column(last)) >= 4), last)


def usable_aliases(aliases: Column, entity: Column, label: Column) -> Column:
    """Surface forms that may stand for an association: five words at most, distinct, and without the entity's own name unless
    the label has it."""
    own = F.filter(T.words_column(entity), lambda w: F.length(w) >= 3)
    named = F.size(F.array_intersect(T.words_column(label), own)) > 0
    keyed = F.transform(aliases, lambda a: F.struct(T.folded_column(a).alias("key"), F.trim(a).alias("form")))
    fit = F.filter(keyed, lambda x: (x["key"] != "") & (x["key"] != T.folded_column(label)) & (F.size(F.split(x["key"], " ")) <= 5) & (named | (F.size(F.array_intersect(F.split(x["key"], " "), own)) == 0)))
    first = F.filter(fit, lambda x, i: F.array_position(F.transform(fit, lambda y: y["key"]), x["key"]) == i + 1)
    return F.transform(first, lambda x: x["form"])


def avoid_terms(label: Column, kind: Column, category: Column, aliases: Column, entity: Column, carriers: Column) -> Column:
    """array<struct<term, severity>>: what a text that displaces an association must not say (block) or should not (warn)."""
    last = F.try_element_at(T.words_column(label), F.lit(-1))
    person = (kind == "named_entity") & (category == "person") & (F.length(last) >= 4)
    term = lambda c, severity: F.struct(F.trim(c).alias("term"), F.lit(severity).alias("severity"))
    blocked = F.concat(F.array(label), usable_aliases(aliases, entity, label), F.when(person, F.array(last)).otherwise(F.array().cast("array<string>")))
    rows = F.concat(F.transform(blocked, lambda c: term(c, "block")), F.transform(carriers, lambda c: term(c, "warn")))
    own = T.words_column(entity)
    fit = F.filter(rows, lambda x: (F.length(T.folded_column(x["term"])) >= 3) & ~F.array_contains(own, T.folded_column(x["term"])))
    keys = F.transform(fit, lambda x: T.folded_column(x["term"]))
    return F.filter(fit, lambda x, i: F.array_position(keys, T.folded_column(x["term"])) == i + 1)


def page_title(title: Column, text: Column) -> Column:
    """The title, or where it is a bot check's or missing the first line of three words and 160 characters at most."""
    squeezed = T.squeezed_column(title)
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), T.squeezed_column)
    headline = F.get(F.filter(lines, lambda x: (F.size(F.split(x, " ")) >= 3) & (F.length(x) <= 160) & ~x.rlike(CHALLENGE_TITLE)), F.lit(0))
    return F.when((squeezed != "") & ~squeezed.rlike(CHALLENGE_TITLE), F.substring(squeezed, 1, 300)).otherwise(headline)


def byline_names(html: Column, text: Column, names: Sequence[str]) -> Column:
    """Whether an author mark or a byline near the top names one of the names."""
    author = F.regexp_extract(F.coalesce(html, F.lit("")), AUTHOR_META, 1)
    lines = F.regexp_extract_all(F.substring(F.coalesce(text, F.lit("")), 1, 2500), F.lit(BYLINE), F.lit(1))
    among = lambda text: reduce(lambda a, b: a | b, (T.contains_phrase_column(text, F.lit(n)) for n in names), F.lit(False))
    return among(author) | F.exists(lines, lambda x: among(x))
