"""Fingerprints of text: content hash, shingles, simhash, minhash, bands."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import cache
from os.path import commonprefix

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as Ty

from attestor.functions.text import ACCENTED, PLAIN, fold, folded_column, squeezed_column, words_column

PERMUTATIONS = 64
MODULUS = 1 << 32


def content_hash(text: Column) -> Column:
    return F.sha2(squeezed_column(text).cast("binary"), 256)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 40)


def shingles(text: Column, size: int = 3) -> Column:
    """Runs of ``size`` folded words; a shorter text is its own shingle, an empty one has none."""

    def runs(words: Column) -> Column:
        n = F.size(words)
        listed = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))
        return F.when(n >= size, listed).when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))

    # the words are bound once, not cut anew for every run
    return F.flatten(F.transform(F.array(words_column(text)), runs))


def minhash_of(folded: str) -> list[int] | None:
    """64 minima of (h1 + i * h2) mod 2^32 over the shingles of a folded text."""
    words = folded.split(" ") if folded else []
    grams = {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else {folded} if words else set()
    if not grams:
        return None
    md5 = hashlib.md5
    digests = np.frombuffer(b"".join([md5(g.encode()).digest()[:8] for g in grams]), ">u4").reshape(-1, 2).astype(np.uint32)
    value, step, out = digests[:, 0].copy(), digests[:, 1] | np.uint32(1), []
    for _ in range(PERMUTATIONS):
        out.append(int(value.min()))
        value += step  # modulo 2^32 by its width
    return out


@F.pandas_udf(Ty.ArrayType(Ty.LongType()))
def minhash_signature(folded: pd.Series) -> pd.Series:
    """The signature of each folded text in one pass over it; null without words."""
    return folded.map(minhash_of)


def minhash(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, signature): 64 minima of (h1 + i * h2) mod 2^32 over the text's shingles, h1 and h2 from their md5.

    Texts are dealt out evenly, then each gives its 64 numbers in one pass; no shingle becomes a row.  Texts without words have
    no row.
    """
    dealt = docs.select(F.col(id_column), folded_column(F.col(text_column)).alias("folded")).repartition(F.col(id_column))
    return dealt.select(id_column, minhash_signature("folded").alias("signature")).where("signature IS NOT NULL")


def minhash_similarity(a: Column, b: Column) -> Column:
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v))
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.size(a))


def _gram_hashes(grams: list[str]) -> np.ndarray:
    """FNV-1a of the first eight bytes of each gram's sha1, in 64 bits."""
    return _fnv(b"".join(hashlib.sha1(g.encode()).digest()[:8] for g in grams))


def _fnv(eights: bytes) -> np.ndarray:
    digests = np.frombuffer(eights, np.uint8).reshape(-1, 8)
    h = np.full(len(digests), 0xCBF29CE484222325, dtype=np.uint64)
    for k in range(8):
        h = (h ^ digests[:, k]) * np.uint64(0x100000001B3)
    return h


def simhash_of(text: str | None) -> int | None:
    words = fold(text).split()
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    if not grams:
        return None
    bits = np.unpackbits(_gram_hashes(grams).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
    votes = 2 * bits.sum(0) - len(grams)  # repeated grams vote as often as they occur
    return int(np.packbits(votes > 0).view(">u8")[0])


def _words_for_simhash(raw: str | None, folded: str) -> list[str]:
    """fold(raw).split(); folded, which is folded_column's, where both are the same for every character of raw."""
    if raw is None or raw.isascii() or all(map(_folds_alike, set(raw))):
        return folded.split()
    return fold(raw).split()


@cache
def _folds_alike(c: str) -> bool:
    """Whether fold() and folded_column() take the character for the same, whatever stands beside it."""
    if not (c < "\u0250" or "\u2010" <= c <= "\u2027" or c == "€") or len(c.lower()) != 1:
        return False
    here = regex.sub(r"[^\p{L}\p{N}]+", " ", c.translate(str.maketrans(ACCENTED, PLAIN)).lower())
    return fold(f"a{c}b") == f"a{here}b"


def signatures(raws: Sequence[str | None], folded: Sequence[str]) -> list[tuple[int | None, list[int] | None]]:
    """(simhash, minhash) of each text, as simhash() and minhash_of() give them, the simhash as a signed number.

    Runs of three words that a text begins with like the text before it are not hashed anew.
    """
    out, before = [], ([], np.empty(0, np.uint64), np.empty((0, 2), np.uint32))
    for raw, plain in zip(raws, folded):
        words = _words_for_simhash(raw, plain)
        if words != plain.split():  # beyond Latin the two read a text differently
            h = simhash_of(raw)
            out.append((None if h is None else h - (1 << 64) if h >> 63 else h, minhash_of(plain)))
            continue
        if not words:
            out.append((None, None))
            continue
        same = max(len(commonprefix([before[0], words])) - 2, 0) if len(words) >= 3 and len(before[0]) >= 3 else 0
        grams = [" ".join(words[i : i + 3]).encode() for i in range(same, max(len(words) - 2, 1))]
        votes = np.concatenate([before[1][:same], _fnv(b"".join([hashlib.sha1(g).digest()[:8] for g in grams]))])
        pairs = np.concatenate([before[2][:same], np.frombuffer(b"".join([hashlib.md5(g).digest()[:8] for g in grams]), ">u4").reshape(-1, 2).astype(np.uint32)])
        before = (words, votes, pairs)
        ones = np.unpackbits(votes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        bits = int(np.packbits(2 * ones > len(votes)).view(">u8")[0])
        value, step, least = pairs[:, 0].copy(), pairs[:, 1] | np.uint32(1), []
        for _ in range(PERMUTATIONS):
            least.append(int(value.min()))
            value += step  # modulo 2^32 by its width
        out.append((bits - (1 << 64) if bits >> 63 else bits, least))
    return out


@F.pandas_udf(Ty.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """The 64 bits as a signed number; null without words."""
    found = [simhash_of(t) for t in texts]
    return pd.Series([None if h is None else h - (1 << 64) if h >> 63 else h for h in found], dtype="Int64")


@F.pandas_udf(Ty.StructType([Ty.StructField("simhash", Ty.LongType()), Ty.StructField("minhash", Ty.ArrayType(Ty.LongType()))]))
def both_signatures(raw: pd.Series, folded: pd.Series) -> pd.DataFrame:
    """signatures() of texts and their folded_column()."""
    found = signatures(list(raw), list(folded))
    return pd.DataFrame({"simhash": pd.Series([s for s, _ in found], dtype="Int64"), "minhash": pd.Series([m for _, m in found], dtype="object")})


def hamming(a: Column, b: Column) -> Column:
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def band_keys(fingerprint: Column) -> Column:
    """Four 16-bit bands, each marked by its place."""
    return F.array(*(F.shiftrightunsigned(fingerprint, 16 * k).bitwiseAND(65535) + (k << 16) for k in range(4)))


def title_similarity(a: Column, b: Column) -> Column:
    """Shared distinct words over the larger number of them."""
    x, y = F.array_distinct(words_column(a)), F.array_distinct(words_column(b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.greatest(F.size(x), F.size(y)).cast("double")), F.lit(0.0))


