import hashlib

import numpy as np
import pytest
from hypothesis import given, strategies as st

from attestor.functions import hashing as H
from attestor.functions import text as T


def slow_fold(text):
    import unicodedata

    out = ""
    for c in "".join(x for ch in text for x in unicodedata.normalize("NFKD", ch).lower() if not "̀" <= x <= "ͯ"):
        out += c if T._KEPT.match(c) else " "
    return " ".join(out.split())


@given(st.text(alphabet="aZé Ñ-_.,'’0９ß\n", max_size=40))
def test_fold_and_offsets(text):
    folded, origin = T.folded(text)
    assert folded == slow_fold(text) and len(origin) == len(folded) + 1 and origin == sorted(origin)


def test_sentences_mind_abbreviations_and_initials():
    text = 'Dr. Smith met John A. Jones at 5 p.m. today. "Really?" she asked. Acme Inc. grew! No end'
    assert [s.text for s in T.sentences(text)] == ["Dr. Smith met John A. Jones at 5 p.m. today.", '"Really?"', "she asked.", "Acme Inc. grew!", "No end"]


def test_boundaries():
    text = "John leads Acme, he said; Beta fell. Gamma rose. Delta stood.\n\nOmega left."
    layout = T.Layout(text)
    at = text.index
    assert layout.boundary(at("John"), at("Acme")) == "same_clause"
    assert layout.boundary(at("John"), at("Beta")) == "same_sentence"
    assert layout.boundary(at("John"), at("Gamma")) == "adjacent_sentence"
    assert layout.boundary(at("John"), at("Delta")) == "same_paragraph"
    assert layout.boundary(at("John"), at("Omega")) == "different_paragraph"
    assert layout.distance(at("John"), at("Acme")) == 2


def test_occurrences_are_word_bounded_and_folded():
    text = "Café CAFÉ cafés; the café-bar"
    assert [text[s.start : s.end] for s in T.occurrences(text, ["cafe"])] == ["Café", "CAFÉ", "café"]


def test_label_keys():
    assert T.label_key("Smith’s Companies") == "smith company" and T.label_key("Boss Classes") == "boss classe"


def test_generic_variants():
    assert T.is_generic_variant("Venture Capital", "venture capital investments") and T.is_generic_variant("Art", "Art Market")
    assert not T.is_generic_variant("Art", "Modern Art") and not T.is_generic_variant("Art", "Art")


def test_name_variants():
    assert T.name_variants("John Andrew Smith") == ["John A. Smith", "John A Smith", "John Smith"]
    assert T.name_variants("John Smith") == ["J. Smith"] and T.name_variants("Acme Holdings, Inc.", "organization") == ["Acme Holdings"]


def test_paragraphs_and_windows():
    text = "One.\n\n  \nTwo.\n\nThree."
    assert [p.text.strip() for p in T.paragraphs(text)] == ["One.", "Two.", "Three."]
    assert len(T.windows("John x. " * 3, ["John"])) == 1


def test_columns_equal_functions(spark):
    rows = [("It's  Smith’s   companies",), ("Les élèves à l’école",), ("",), (None,), ("x",)]
    df = spark.createDataFrame(rows, "text string")
    got = df.select(T.folded_column(df.text).alias("f"), T.label_key_column(df.text).alias("k"), T.token_count_column(df.text).alias("n")).collect()
    for (text,), r in zip(rows, got):
        assert r.f == T.fold(text) and r.n == len(T.tokens(text or "")) and (text is None or r.k == T.label_key(text))


def test_simhash_and_minhash(spark):
    base = " ".join(f"word{i}" for i in range(60))
    near, far = base.replace("word30", "other"), " ".join(f"thing{i}" for i in range(60))
    bits = lambda a, b: (H.simhash_of(a) ^ H.simhash_of(b)).bit_count()
    assert H.simhash_of("") is None and bits(base, base) == 0 and bits(base, near) < bits(base, far)
    got = {r.id: r.signature for r in H.minhash(spark.createDataFrame([(1, base), (2, near), (3, "")], "id long, text string"), "id", "text").collect()}
    words = base.split()
    want = [2**32] * 64
    for i in range(len(words) - 2):
        d = hashlib.md5(" ".join(words[i : i + 3]).encode()).digest()
        h1, h2 = int.from_bytes(d[:4], "big"), int.from_bytes(d[4:8], "big") | 1
        want = [min(w, (h1 + k * h2) % 2**32) for k, w in enumerate(want)]
    assert got[1] == want and 3 not in got and np.mean(np.array(got[1]) == np.array(got[2])) > 0.8


@pytest.mark.parametrize("text,grams", [("a b", ["a b"]), ("a b c d", ["a b c", "b c d"]), ("", [])])
def test_shingles(spark, text, grams):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(H.shingles(df.text).alias("g")).first().g == grams
