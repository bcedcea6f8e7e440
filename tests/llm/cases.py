"""Small tables with the awkward rows every operator must take, and a real sample."""

import random
import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def edge_rows():
    rng = random.Random(5)
    vocab = ["the", "of", "and", "ship", "Étude", "naïve", "stone", "river", "x1", "(a)", "b|c"] + [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = prose(120)
    texts = [
        None, "", " \n\t ", "one", "one two", base, base, base + " tail", base.replace("the", "THE"), prose(60), prose(4000),
        "line a b\nline a b\nother\n" * 30, "a " * 500, "🙂 emoji — dash “quote” 中文 word " * 9, prose(200), prose(49),
    ]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}" if i % 5 else None, len(t) if t else None) for i, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rows.append((None, base, "en", "src0", 3))
    for i in range(40):  # ties: many equal texts in one source
        rows.append((100 + i, "tied text of five words", "en", "src0", 23))
    return rows


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


#: Names that the operators give to columns of their own, and awkward ones.
OWN_NAMES = (
    "kept", "shard", "size", "n_words", "weight", "probability", "tokens", "item_id", "key", "class", "group", "node", "text_crc32", "score", "topic", "component_id", "h1", "n",
    "_tokens", "_topic", "_weight", "_probability", "_residual", "_sampled", "_words", "_key", "_windows", "_kept", "_digest", "_cell_0", "_text", "_lang", "_source", "_rank", "__tokens",
    "_WORDS_", "digest", "bands", "registers", "root", "part", "slot", "chunk", "r", "data", "axis", "x0", "page_id", "a.b", "`q`", "with blank",
)


def clashing(df):
    """The same with extra columns named like the operators' own."""
    return df.select("*", *(F.lit("extra").alias(name) for name in OWN_NAMES))


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
