"""Token counts of whole texts by a tokenizer whose pre-tokens never cross white space.

Offline, on the driver, every vocabulary string is encoded alone; those that come back as their own single token are
proved whole tokens, and that set (no larger than the vocabulary) goes to the executors.  A text is the sum of its words
between ASCII white space, since the tokenizer drops white space and merges within pre-tokens only.  Per chunk each
distinct word is counted once: words and pre-tokens in the proved set count 1 without merging, and only the rest is
merged by the library.  Texts that hold an added token's string, and words beyond ASCII, are left to the library whole.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each, rows with one id and
different texts too; very long texts and words are counted whole; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from attestor.llm.frames import map_chunks
from attestor.llm.text import Texts

#: Text counted together: the larger, the fewer times a word is looked up.
CHUNK = 12 << 20
#: Merged pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 300_000


def tokenizer_text(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def loaded(text: str):
    """The library's tokenizer without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others,
    in order, for the characters from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


def proved_whole(text: str, end: str = "</w>") -> list[str]:
    """Vocabulary strings that, alone, encode as themselves in one token."""
    tokenizer, alphabet = loaded(text), byte_alphabet()
    special = {x["content"] for x in json.loads(text).get("added_tokens", [])}
    found, ids = [], []
    for entry, id_ in tokenizer.get_vocab(with_added_tokens=False).items():
        body = entry.removesuffix(end)
        if body and body != entry and entry not in special and all(c in alphabet for c in body):
            try:
                found.append(bytes(alphabet[c] for c in body).decode())
                ids.append(id_)
            except UnicodeDecodeError:
                continue
    encoded = tokenizer.encode_batch(found, add_special_tokens=False)
    return [s for s, id_, e in zip(found, ids, encoded) if e.ids == [id_]]


_MADE: dict = {}


def once(make, *args):
    """make(*args), made once per worker process, which keeps what it remembers from task to task."""
    key = (make, str(args[0]))
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = make(*args)
    return _MADE[key]


class Counter:
    """Counts tokens per text; made once per worker."""

    def __init__(self, text: str, whole: list[str]):
        spec = json.loads(text)
        self.tokenizer = loaded(text)
        self.whole = set(whole)
        self.whole_column = pa.array(whole, pa.large_string())
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.pre_token = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.memo: dict[str, int] = {}

    def merged(self, strings: list[str]) -> None:
        """Has the library count strings that are not remembered."""
        new = [s for s in dict.fromkeys(strings) if s not in self.memo]
        if len(self.memo) + len(new) > REMEMBERED:
            self.memo.clear()
            new = list(dict.fromkeys(strings))
        self.memo.update(zip(new, map(len, self.tokenizer.encode_batch(new, add_special_tokens=False))))

    def words(self, words: list[str]) -> list[int]:
        """Tokens of each word."""
        split = []
        rest: list[str] = []
        for w in words:
            pieces = self.pre_token.findall(w.lower()) if w.isascii() else [w]
            split.append(pieces)
            rest.extend(p for p in pieces if p not in self.whole)
        self.merged(rest)
        whole, memo = self.whole, self.memo
        return [sum(1 if p in whole and p.isascii() else memo[p] for p in pieces) if len(pieces) != 1 else (1 if pieces[0] in whole else memo[pieces[0]]) for pieces in split]

    def count(self, column: pa.Array) -> np.ndarray:
        column = pc.fill_null(column, "").cast(pa.large_string())
        out = np.zeros(len(column), dtype=np.int64)
        odd = np.zeros(len(column), dtype=bool)
        for s in self.special:
            odd |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        if odd.any():
            at = np.flatnonzero(odd)
            out[at] = [len(e) for e in self.tokenizer.encode_batch(column.take(pa.array(at)).to_pylist(), add_special_tokens=False)]
            column = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), column)
        lists = pc.ascii_split_whitespace(column)
        flat = lists.flatten().dictionary_encode()
        words = flat.dictionary
        known = pc.is_in(words, self.whole_column).to_numpy(zero_copy_only=False) | (pc.binary_length(words).to_numpy(zero_copy_only=False) == 0)
        per_word = np.ones(len(words), dtype=np.int64)
        per_word[pc.binary_length(words).to_numpy(zero_copy_only=False) == 0] = 0
        rest = np.flatnonzero(~known)
        per_word[rest] = self.words(words.take(pa.array(rest)).to_pylist())
        total = np.concatenate([[0], np.cumsum(per_word[flat.indices.to_numpy(zero_copy_only=False)])])
        offsets = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)
        return out + total[offsets[1:]] - total[offsets[:-1]]


def token_counts(docs: DataFrame, path: str, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    text = tokenizer_text(path)
    shared = docs.sparkSession.sparkContext.broadcast((text, proved_whole(text)))  # the vocabulary file and a part of it
    slim = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        n = once(Counter, *shared.value).count(part.column(1))
        sizes = np.diff(Texts.of(part.column(1)).offsets)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_chunks(slim, rows, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean", limit=CHUNK)
