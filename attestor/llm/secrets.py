"""Secrets in whole texts: patterns for assignments, access keys and hex strings, and high-entropy strings.

Everything is built of DataFrame functions.  A pattern's matches and the pieces between them (split by the same pattern)
give each match's place as a running sum of lengths, in code points.

Entropy: candidate strings are runs of at least ``window`` base64 or URL-safe characters that hold a digit.  A window of
``window`` characters slides over a candidate; the counts of its characters change by the one that enters and the one
that leaves, and with them sum(c * log2 c), kept as whole millionths so that the result is exact.  A window is hot if its
Shannon entropy reaches the threshold of the candidate's character class (hex, or letters and digits).  A candidate's
span runs from its first hot window's start to its last one's end.  Candidates that match the allow-list (examples,
placeholders, UUIDs, plain numbers, counting runs) are suppressed.  Entropy spans come on top of the pattern spans.

Defined results: null and empty texts have no spans; repeated rows get a row each, rows with one id and different texts
too; a very long text or candidate is scanned whole; two kinds may start at one place (ties are listed in the kinds' order);
other columns are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# The patterns of the three kinds, in the order in which ties are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
ALLOWED = (
    r"(?i)example|placeholder|dummy|sample|changeme|redacted|xxxx|0123456789|abcdefgh"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[0-9_-]+$|^(?:[A-Za-z]++[/_-])++[A-Za-z]*+[0-9]{0,4}$"
)


@dataclass(frozen=True)
class Entropy:
    """Window size and least bits per character by class."""

    window: int = 20
    hex_bits: float = 3.0
    mixed_bits: float = 3.6
    allowed: str = ALLOWED


def _scaled(c: int) -> int:
    """c * log2(c) in millionths."""
    return round(1_000_000 * c * math.log2(c)) if c else 0


def _bound(value: Column, fn) -> Column:
    """fn of a value that is computed once, however often fn's lambdas read it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _running(lengths: Column, total: Column) -> Column:
    """The running sums from ``total`` after each length; every step copies the sums so far, so only short arrays come here."""
    zero = F.struct(total.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out"))

    return F.aggregate(lengths, zero, step, lambda acc: acc["out"])


def _running_sums(lengths: Column) -> Column:
    """The running sums of an array of any size: by blocks of about the root of its size, each from where the last one ends."""

    def blocks(p: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(p))).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / size).cast("int")), lambda k: F.slice(p, k * size + 1, size))
        ends = _bound(cut, lambda c: F.struct(c.alias("blocks"), _running(F.transform(c, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0)).alias("ends")))
        return _bound(ends, lambda e: F.flatten(F.transform(e["blocks"], lambda x, k: _running(x, F.when(k > 0, F.get(e["ends"], k - 1)).otherwise(0)))))

    return F.when(F.size(lengths) > 0, _bound(lengths, blocks)).otherwise(F.array().cast("array<bigint>"))


def _places(matches: Column, pieces: Column) -> Column:
    """array<struct<start, stop, text>> of a pattern's matches, given the pieces between them."""
    length = lambda x: F.length(x).cast("long")
    through = _running_sums(F.transform(matches, lambda m, i: length(F.get(pieces, i)) + length(m)))
    return _bound(
        F.struct(matches.alias("m"), through.alias("t")),
        lambda p: F.transform(p["m"], lambda m, i: F.struct((F.get(p["t"], i) - length(m)).alias("start"), F.get(p["t"], i).alias("stop"), m.alias("text"))),
    )


def hot_span(text: Column, entropy: Entropy) -> Column:
    """struct<first, last>: indexes of the last characters of the first and last hot window, -1 without one."""
    w = entropy.window
    table = F.array(*(F.lit(_scaled(c)).cast("long") for c in range(w + 2)))
    codes = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c))
    is_hex = text.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")
    # entropy >= bits  <=>  sum(c log2 c) <= w * (log2 w - bits)
    most = F.when(is_hex, math.floor(1_000_000 * w * (math.log2(w) - entropy.hex_bits))).otherwise(math.floor(1_000_000 * w * (math.log2(w) - entropy.mixed_bits))).cast("long")
    packed = F.array(F.struct(codes.alias("codes"), most.alias("most")))  # bound once, used in every step

    def slide(p: Column) -> Column:
        codes, most = p["codes"], p["most"]
        begin = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"), F.lit(0).cast("long").alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last")
        )

        def step(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.when(i >= w, F.get(codes, i - w)).otherwise(F.lit(-1))
            same = enters == leaves
            n_in, n_out = F.get(acc["n"], enters), F.get(acc["n"], F.greatest(leaves, F.lit(0)))
            gain = F.get(table, n_in + 1) - F.get(table, n_in)
            loss = F.when(leaves >= 0, F.get(table, n_out) - F.get(table, n_out - 1)).otherwise(F.lit(0).cast("long"))
            total = F.when(same, acc["s"]).otherwise(acc["s"] + gain - loss)
            counts = F.when(same, acc["n"]).otherwise(F.transform(acc["n"], lambda c, k: c + (k == enters).cast("int") - (k == leaves).cast("int")))
            new = F.array(F.struct(counts.alias("n"), total.alias("s")))
            return F.get(
                F.transform(
                    new,
                    lambda x: F.struct(
                        x["n"].alias("n"), x["s"].alias("s"),
                        F.when((acc["first"] < 0) & (i >= w - 1) & (x["s"] <= most), i).otherwise(acc["first"]).alias("first"),
                        F.when((i >= w - 1) & (x["s"] <= most), i).otherwise(acc["last"]).alias("last"),
                    ),
                ),
                F.lit(0),
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), begin, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return F.get(F.transform(packed, slide), F.lit(0))


def _matches(pattern: str, guard: Column, group: int = 0) -> Column:
    return F.when(guard, F.regexp_extract_all(F.col("_text"), F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))


def _pieces(pattern: str, found: Column) -> Column:
    return F.when(F.size(found) > 0, F.split(F.col("_text"), pattern, -1)).otherwise(F.array().cast("array<string>"))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def scan(docs: DataFrame, entropy: Entropy = Entropy(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the pattern spans _base and all spans _all (start, kind, stop)."""
    slim = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    lowered = F.lower("_text")
    keyed = F.lit(False)
    for word in KEYWORDS:
        keyed = keyed | F.contains(lowered, F.lit(word))
    candidate = CANDIDATE % entropy.window
    patterns = {"assign": (ASSIGN, keyed), "access": (ACCESS, F.contains(F.col("_text"), F.lit("AKIA"))), "hex": (HEX, F.lit(True)), "entropy": (candidate, F.lit(True))}
    found = slim.select("*", *(_matches(p, guard).alias(f"_m_{k}") for k, (p, guard) in patterns.items()), _matches(ASSIGN, keyed, 1).alias("_values"))
    cut = found.select("*", *(_pieces(p, F.col(f"_m_{k}")).alias(f"_p_{k}") for k, (p, _) in patterns.items()))
    placed = cut.select("doc_id", "_values", *(_places(F.col(f"_m_{k}"), F.col(f"_p_{k}")).alias(f"_{k}") for k in patterns))
    span = lambda kind, start, stop: F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), stop.cast("long").alias("stop"))
    # the value of an assignment must have 6 characters; the other patterns hold their least lengths
    kept = F.filter(F.arrays_zip(F.col("_assign").alias("span"), F.col("_values").alias("value")), lambda x: F.length(x["value"]) >= 6)
    assign = F.transform(kept, lambda x: span("assign", x["span"]["start"], x["span"]["stop"]))
    access = F.transform("_access", lambda x: span("access", x["start"], x["stop"]))
    hexes = F.transform("_hex", lambda x: span("hex", x["start"], x["stop"]))
    suspicious = F.filter("_entropy", lambda x: x["text"].rlike("[0-9]") & ~x["text"].rlike(entropy.allowed))
    timed = F.transform(suspicious, lambda x: F.struct(x["start"].alias("start"), hot_span(x["text"], entropy).alias("hot")))
    hot = F.transform(
        F.filter(timed, lambda x: x["hot"]["last"] >= 0),
        lambda x: span("entropy", x["start"] + x["hot"]["first"] - (entropy.window - 1), x["start"] + x["hot"]["last"] + 1),
    )
    base = placed.select("doc_id", F.concat(assign, access, hexes).alias("_base"), hot.alias("_hot"))
    return base.select("doc_id", "_base", F.concat("_base", "_hot").alias("_all"))


def digest(spans: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the pattern spans and all spans as text."""
    count = lambda kind: F.size(F.filter("_base", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *map(count, KINDS[:3]), F.sha2(_joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("_all")).alias("spans"))
