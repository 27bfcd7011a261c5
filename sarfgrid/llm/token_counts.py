"""Token counts with a whole-token shortcut.

Offline, every vocabulary string that carries the word end is encoded once by the
tokenizer's own merges; those that come back as that one token are *whole*. At run
time a pre-token found among them counts 1 without any merging, and only the rest
is merged. No shuffle: one Arrow pass over the texts.

Defined results: null text counts as empty (0 bytes, 0 tokens); empty text 0; texts
of any length are counted whole; repeated rows are counted each; columns of the input
that clash with the new ones are kept out of the way by selecting first.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, table

#: Entries of the cache of merged pre-tokens in a worker; beyond it the cache starts anew.
CACHE_ENTRIES = 400_000
#: Longest pre-token that is cached, in characters.
CACHE_CHARS = 64
#: Below this code point normal form C changes nothing and Python's lower-casing is the tokenizer's.
PLAIN = 0x250


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _plain_pattern() -> re.Pattern:
    """The vocabulary file's split pattern, for lower-cased texts of code points below PLAIN."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] == kind)
    letters, numbers, space = of("L"), of("N"), r" \t\n\x0b\x0c\r\x85\xa0"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")


class _Counts(dict):
    """Pre-token -> number of tokens; whole tokens are there from the start."""

    def __init__(self, whole, merge):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.merge, self.spare = whole, merge, CACHE_ENTRIES

    def __missing__(self, word):
        n = self.merge(word)
        if len(word) <= CACHE_CHARS:
            if not self.spare:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
                self.spare = CACHE_ENTRIES
            self[word] = n
            self.spare -= 1
        return n


class TokenCounter:
    """Counts tokens as the library does for a word-end BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.normal, self.split, self.model = tok.normalizer, tok.pre_tokenizer, tok.model
        special = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pattern, self.beyond = _plain_pattern(), re.compile(f"[^\x00-{chr(PLAIN - 1)}]")
        self.counts = _Counts(self.prove(tok.get_vocab(), set(special)), self.merge)

    def prove(self, vocab, special) -> set[str]:
        """The texts of word-end entries which the merges turn into exactly that entry."""
        back, found = {c: b for b, c in self.letters.items()}, set()
        for entry in vocab:
            if entry.endswith("</w>") and entry not in special and all(c in back for c in entry[:-4]):
                got = self.model.tokenize(entry[:-4])
                if len(got) == 1 and got[0].value == entry:
                    try:
                        found.add(bytes(back[c] for c in entry[:-4]).decode())
                    except UnicodeDecodeError:  # part of a character: no pre-token equals it
                        pass
        return found

    def merge(self, word: str) -> int:
        return len(self.model.tokenize("".join(map(self.letters.__getitem__, word.encode()))))

    def pre_tokens(self, text: str) -> list[str]:
        if self.beyond.search(text):
            back = {c: b for b, c in self.letters.items()}
            return [bytes(back[c] for c in w).decode() for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(text))]
        return self.pattern.findall(text.lower())

    def count(self, text: str) -> int:
        parts, n = [text], 0
        if self.special and "<|" in text:
            parts = self.special.split(text)
            n = len(parts) - 1
        look = self.counts.__getitem__
        return n + sum(sum(map(look, self.pre_tokens(p))) for p in parts if p)


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""

    def fn(c):
        of, texts = counter(path), [t or "" for t in c["t"].to_pylist()]
        n = [of.count(t) for t in texts]
        return {"doc_id": c["i"], "n_bytes": ([len(t.encode()) for t in texts], pa.int64()), "n_tokens": (n, pa.int64()), "over_limit": ([x > limit for x in n], pa.bool_())}

    return arrow_map(docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].alias("t")), fn, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
