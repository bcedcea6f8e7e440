"""Associations in the windows around an entity's names: capitalised names, concepts by trigger, relations by pattern."""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window, functions as F

from attestor.functions import hashing as H
from attestor.functions import text as T
from attestor.operators.identity import Profile

# Concepts (label, category, triggers), relations (words before the name, relation, confidence), words.
CONCEPTS = (
    ("Philanthropy", "philanthropy", ("philanthropy", "philanthropic", "charitable giving", "charitable activities", "charity work", "donation", "donated", "gift to", "foundation grant", "pledged")),
    ("Lawsuit", "legal", ("lawsuit", "sued", "litigation", "court filing", "complaint against", "legal action")),
    ("Investigation", "controversy", ("investigation", "investigating", "probe", "subpoena", "inquiry into")),
    ("Contemporary Art", "arts_culture", ("contemporary art", "art collection", "collector", "gallery", "museum", "art fair")),
    ("Venture Capital", "financial", ("venture capital", "raised a fund", "limited partners", "portfolio company", "seed round", "series a")),
    ("Award", "award", ("award", "honoured", "honored", "prize", "named to", "recognised as", "recognized as")),
    ("Politics", "politics", ("campaign donation", "political donation", "lobbying", "endorsed", "super pac")),
    ("Education", "education", ("graduated", "alumnus", "alumna", "mba", "studied at", "degree from")),
    ("Board Membership", "role", ("board of directors", "serves on the board", "board member", "trustee", "chairman of")),
)
RELATIONS = (
    (r"\b(founder|co-founder|founded)\b[^.]{0,30}$", "founder_of", 0.95),
    (r"\b(chief executive|ceo|president|chairman|managing partner)\b[^.]{0,30}$", "leads", 0.93),
    (r"\b(serves on the board|board member|trustee|joined the board)\b[^.]{0,30}$", "board_member", 0.93),
    (r"\b(donated|gave|pledged|contributed)\b[^.]{0,40}$", "donated_to", 0.9),
    (r"\b(sued|filed suit against|accused|charged)\b[^.]{0,40}$", "accused_of", 0.88),
    (r"\b(graduated from|studied at|earned)\b[^.]{0,30}$", "educated_at", 0.9),
    (r"\b(attended|spoke at|appeared at)\b[^.]{0,30}$", "attended", 0.4),
)
ORGANISATION = r"(?i)\b(inc|llc|ltd|plc|corp|corporation|company|foundation|institute|university|college|group|partners|capital|holdings|trust|association|society|museum|hospital|bank|fund)\b"
LEADING = r"(?i)^(the|a|an|from|in|at|on|after|before|analysis|interview|profile|inside|regulators)\s+"
PLAIN_WORDS = frozenset(
    "the a an and or but in on at to for of with by from monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september "
    "october november december mr mrs ms dr he she they it this that his her their".split()
)
NEGATIVE = ("legal", "controversy")

_NAME = regex.compile(r"\b[A-Z][\p{L}&'’.-]*(?:\s+(?:of|and|the|for|de|van|von)?\s*[A-Z][\p{L}&'’.-]*){0,4}")
_RELATIONS = [(regex.compile(p, regex.I), r, c) for p, r, c in RELATIONS]
_ORGANISATION = regex.compile(ORGANISATION)

ASSOCIATION = "struct<label:string,kind:string,category:string,relationship:string,relationship_confidence:double,sentiment:string,evidence:string,start:int>"


def names_in(sentence: str, own: set[str]):
    """(name, place) of the capitalised names of a sentence that are not the entity's own."""
    for m in _NAME.finditer(sentence):
        name = regex.sub(LEADING, "", regex.sub(r"[.,;:]$", "", T.squeeze(m.group())))
        key = T.fold(name)
        single = " " not in name
        if len(key) < 4 or any(key in alias or alias in key for alias in own) or set(key.split()) <= PLAIN_WORDS or (single and not _ORGANISATION.search(name)):
            continue
        yield name, m.start()


def extract(window: str, profile: Profile, offset: int = 0) -> list[dict]:
    """The associations of one window, each once."""
    names = profile.names()
    own, seen, out = {T.fold(n) for n in names}, set(), []
    for s in T.sentences(window):
        named = bool(T.occurrences(s.text, names))
        quoted, folded = T.squeeze(s.text), T.fold(s.text)
        for name, at in names_in(s.text, own):
            if (key := T.fold(name)) not in seen:
                seen.add(key)
                relation, confidence = next(((r, c) for p, r, c in _RELATIONS if p.search(s.text[:at])), ("mentioned_with", 0.35) if named else ("co_occurs_with", 0.2))
                out.append({"label": name, "kind": "named_entity", "category": "organization" if _ORGANISATION.search(name) else "other", "relationship": relation, "relationship_confidence": confidence, "sentiment": "neutral", "evidence": quoted, "start": offset + s.start + at})
        for label, category, triggers in CONCEPTS:
            found = next((t for t in triggers if T.fold(t) in folded), None)
            if found and ("concept", label) not in seen:
                seen.add(("concept", label))
                hit = T.occurrences(s.text, [found])
                sentiment = "negative" if category in NEGATIVE else "neutral"
                out.append({"label": label, "kind": "concept", "category": category, "relationship": "involved_in", "relationship_confidence": 0.6 if named else 0.3, "sentiment": sentiment, "evidence": quoted, "start": offset + s.start + (hit[0].start if hit else 0)})
    return out


def supported(window: str, quote: str) -> bool:
    """Whether a quote stands in the window, or, if long, at least its first three fifths."""
    hay, needle = T.fold(window), T.fold(quote)
    words = needle.split()
    head = " ".join(words[: -(-len(words) * 3 // 5)])
    return len(quote or "") >= 8 and (needle in hay or (len(words) >= 6 and head in hay))


def extract_associations(docs: DataFrame, profile: Profile, most_windows: int = 3) -> DataFrame:
    """docs (document_id, text): one row per association found, with the token distance and boundary to the nearest name."""
    names = profile.names()

    @F.pandas_udf(f"array<struct<window:int,found:{ASSOCIATION},token_distance:int,boundary:string>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None):
            text, out = text or "", []
            named = T.occurrences(text, names)
            if not named:
                return out
            layout = T.Layout(text)
            for k, (a, b) in enumerate(T.windows(text, names, most_windows)):
                for found in extract(text[a:b], profile, a):
                    near = min(named, key=lambda n: (layout.distance(n.start, found["start"]), n.start))
                    out.append({"window": k, "found": found, "token_distance": layout.distance(near.start, found["start"]), "boundary": layout.boundary(near.start, found["start"])})
            return out

        return texts.map(one)

    rows = docs.select("document_id", F.explode(run("text")).alias("x")).select("document_id", "x.window", "x.found.*", "x.token_distance", "x.boundary")
    place = Window.partitionBy("document_id", "kind", "label").orderBy("window", "start")
    return rows.withColumn("occurrence", F.row_number().over(place) - 1)


def canonical_associations(found: DataFrame) -> DataFrame:
    """One row per (kind, label key): the label met first, the first category that says something, documents, mentions."""
    keyed = found.where(~T.sentence_like_column(F.col("label"))).withColumn("label_key", T.label_key_column(F.col("label"))).where("label_key <> ''")
    order = F.struct("document_id", "occurrence", "label")
    return keyed.groupBy("kind", "label_key").agg(
        F.min_by("label", order).alias("label"), F.coalesce(F.min_by(F.when(F.col("category") != "other", F.col("category")), F.when(F.col("category") != "other", order)), F.lit("other")).alias("category"),
        F.countDistinct("document_id").alias("documents"), F.count("*").alias("mentions"),
    )


def merge_generic_variants(associations: DataFrame) -> DataFrame:
    """associations (kind, label_key) with merged_into: the shortest label of which this one is a generic variant.

    Variants keep all words of the shorter label in order, so the two share their first word or differ by a generic first
    word: pairs are met by a word of the shorter label, not all with all.
    """
    words = associations.select("kind", "label_key", F.explode(F.split("label_key", " ")).alias("word"))
    short, long = words.alias("s"), words.alias("l")
    met = short.join(long, (F.col("s.kind") == F.col("l.kind")) & (F.col("s.word") == F.col("l.word")) & (F.length("s.label_key") < F.length("l.label_key"))).select(F.col("s.kind").alias("kind"), F.col("s.label_key").alias("into"), F.col("l.label_key").alias("label_key")).distinct()

    @F.pandas_udf("boolean")
    def variant(shorter: pd.Series, longer: pd.Series) -> pd.Series:
        return pd.Series([T.is_generic_variant(a, b) for a, b in zip(shorter, longer)])

    best = met.where(variant("into", "label_key")).groupBy("kind", "label_key").agg(F.min_by("into", F.struct(F.length("into"), F.col("into"))).alias("merged_into"))
    return associations.join(best, ["kind", "label_key"], "left")


def similar_pairs(vectors: DataFrame, threshold: float, id_column: str = "vec_id", kind_column: str = "label", vector_column: str = "embedding", block: int = 1024) -> DataFrame:
    """Pairs (a, b, similarity) within a kind whose vectors' cosine, to four places, reaches the threshold.

    A kind is dealt into blocks of ``block`` vectors; every two blocks meet in one task as a product of two matrices.
    """
    kind, id_type = (vectors.schema[c].dataType.simpleString() for c in (kind_column, id_column))
    rows = vectors.select(F.col(kind_column).alias("kind"), F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where("v IS NOT NULL")
    blocks = rows.groupBy("kind").agg(F.ceil(F.count("*") / block).alias("blocks"))
    own = rows.join(blocks, "kind").withColumn("own", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = own.selectExpr("kind", "least(own, other) AS low", "greatest(own, other) AS high", "own", "id", "v")

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        matrix = np.array(frame["v"].tolist())
        matrix = matrix / np.maximum(np.sqrt((matrix * matrix).sum(1)), 1e-300)[:, None]
        ids, mine, low = frame["id"].to_numpy(), frame["own"].to_numpy(), frame["low"].iloc[0]
        left, right = np.flatnonzero(mine == low), np.flatnonzero(mine == frame["high"].iloc[0])
        similarity = np.floor(matrix[left] @ matrix[right].T * 10_000 + 0.5) / 10_000
        i, j = np.nonzero(similarity >= threshold)
        a, b = ids[left[i]], ids[right[j]]
        once = a < b if low == frame["high"].iloc[0] else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[once], "b": np.maximum(a, b)[once], "similarity": similarity[i, j][once]})

    return dealt.groupBy("kind", "low", "high").applyInPandas(meet, f"a {id_type}, b {id_type}, similarity double")


def merge_suggestions(associations: DataFrame, threshold: float = 0.86) -> DataFrame:
    """associations (kind, label_key): pairs of labels of a kind that read alike, for an analyst to merge: (kind, a, b, similarity)."""
    vectors = associations.select("kind", "label_key", hashed_vector(F.col("label_key")).alias("vector"))
    pairs = similar_pairs(vectors, threshold, "label_key", "kind", "vector")
    return pairs.join(associations.select("kind", F.col("label_key").alias("a")), "a").select("kind", "a", "b", "similarity").distinct()


def hashed_vector(text, dimensions: int = 256):
    """A text as counts of its words and word pairs hashed to ``dimensions`` places."""
    grams = F.concat(T.words_column(text), F.filter(H.shingles(text, 2), lambda g: F.contains(g, F.lit(" "))))
    slots = F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(dimensions)))
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float"))
