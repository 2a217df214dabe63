"""Byte-pair encoding with the exact merges of a published vocabulary, by backtracking, and decoding by an offset table.

Encoding a word takes the longest token at each position from an Aho-Corasick automaton and steps back to a shorter
one whenever two neighbours could not stand side by side after real merging. Whether two tokens may is kept in a
pair-compatibility table. A prefix of a word has one encoding only, so a position from which no way leads on is dead
for good and each position is left for dead once at most: time is linear in the word. Words repeat, so each worker
also keeps a bounded table of words already encoded.
"""

from __future__ import annotations

import base64
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a worker's word table and of its pair table before they are emptied.
TABLE_WORDS, TABLE_PAIRS = 400_000, 1_000_000
#: One symbol that stands for the word-end mark inside this module; it is never text.
END = ""
#: Characters that Python's split() takes for white space and Unicode doesn't.
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 is itself, the rest counts up from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class BacktrackingBpe:
    """Exact BPE of single words over ``vocab`` (token to id) and ``merges`` (pairs, preferred first).

    With ``suffix`` a word's last symbol carries the word-end mark, as its tokens in the vocabulary do.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        inner = lambda t: t[: -len(suffix)] + END if suffix and t.endswith(suffix) and len(t) > len(suffix) else t
        self.marked = bool(suffix)
        self.rank: dict[tuple[str, str], int] = {}
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault((inner(a), inner(b)), r)
        self.ids = {inner(t): i for t, i in vocab.items()}
        made = {a + b for a, b in self.rank}
        self.automaton = ahocorasick.Automaton()
        for t in self.ids:
            if len(t.rstrip(END)) == 1 or t in made:
                self.automaton.add_word(t, t)
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging, preferred pair first and leftmost first: the definition that backtracking must equal."""
        parts = [*text[:-2], text[-2:]] if text.endswith(END) else list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(p, len(self.rank)) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == len(self.rank):
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether ``a`` and ``b`` (``a`` empty: ``b`` alone) are what their joined text merges into."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= TABLE_PAIRS:
                self.fits.clear()
            known = self.fits[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def encode(self, word: str) -> list[int]:
        """Token ids of one word, without its mark. Symbols outside the vocabulary are left out, as unknown ones are."""
        text = word + END if self.marked and word else word
        n = len(text)
        starting: list[list[str]] = [[] for _ in range(n)]
        for last, token in self.automaton.iter(text):
            starting[last - len(token) + 1].append(token)
        for found in starting:
            found.sort(key=len)
        alive = [True] * n + [True]
        stack: list[str] = []
        at, options = 0, starting[0][:] if n else []
        while at < n:
            before = stack[-1] if stack else ""
            while options:
                token = options.pop()
                if alive[at + len(token)] and self.compatible(before, token):
                    stack.append(token)
                    at += len(token)
                    options = starting[at][:] if at < n else []
                    break
            else:
                alive[at] = False
                if not stack:
                    return [self.ids[t] for t in self.merged(text) if t in self.ids]
                token = stack.pop()
                at -= len(token)
                options = [t for t in starting[at] if len(t) < len(token)]
        return [self.ids[t] for t in stack]


class WordBpe(dict):
    """A tokenizer file of the word-end kind (NFC, lower case, white space dropped): white-space-free pieces to packed ids."""

    def __init__(self, path: str):
        super().__init__()
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.bpe = BacktrackingBpe(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.word_ids: dict[str, list[int]] = {}
        strings = {**{i: t for t, i in model["vocab"].items()}, **{i: t for t, i in self.special.items()}}
        shown = [strings.get(i, "").encode() + b" " for i in range(max(strings) + 1)]
        self.buffer = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in shown])])

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= TABLE_WORDS:
            self.clear()
        text = unicodedata.normalize("NFC", piece)
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        ids: list[int] = []
        for w in self.words.findall(text):
            if (known := self.word_ids.get(w)) is None:
                if len(self.word_ids) >= TABLE_WORDS:
                    self.word_ids.clear()
                known = self.word_ids[w] = self.bpe.encode("".join(map(self.letters.__getitem__, w.encode())))
            ids += known
        packed = self[piece] = np.array(ids, dtype="<u4").tobytes()
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers. Special tokens in the text get their own ids."""
        if "<|" in text:
            parts = self.at_special.split(text)
            return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        pieces = regex.split(r"\p{White_Space}+", text) if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.__getitem__, pieces))

    def decode(self, packed: bytes) -> bytes:
        """The tokens' strings joined by blanks, as UTF-8: slices of one buffer by the offset table."""
        ids = np.frombuffer(packed, dtype="<u4")
        if not len(ids):
            return b""
        first = self.offsets[ids]
        width = self.offsets[ids + 1] - first
        ends = np.cumsum(width)
        return self.buffer[np.repeat(first - ends + width, width) + np.arange(ends[-1])].tobytes()[:-1]


class _Uneven(Exception):
    """White space at a piece's edge."""


class ByteBpe:
    """Byte-level BPE ids of whole texts. Pieces between single blanks encode on their own; other texts go as a whole."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks_path, "rb") if line.strip())}
        self.special = {t["content"]: t["id"] for t in json.load(open(json_path, encoding="utf-8"))["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")")
        self.coder = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        coder = self.coder

        class Pieces(dict):
            def __init__(self, before: str):
                self.before = before

            def __missing__(self, piece: str) -> bytes:
                if not piece or piece[0].isspace() or piece[-1].isspace():
                    raise _Uneven
                if len(self) >= TABLE_WORDS:
                    self.clear()
                packed = self[piece] = np.array(coder.encode_ordinary(self.before + piece), dtype="<u4").tobytes()
                return packed

        self.first, self.rest = Pieces(""), Pieces(" ")
        self.newline = np.array(coder.encode_ordinary("\n"), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Special tokens in the text get their own ids."""
        if not text:
            return b""
        if "<|" in text and self.at_special.search(text):
            parts = self.at_special.split(text)
            return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if k % 2 else self.encode(p) for k, p in enumerate(parts))
        try:
            out = []
            for line in text.split("\n"):
                head, *tail = line.split(" ")
                out.append(self.first[head] + b"".join(map(self.rest.__getitem__, tail)))
            return self.newline.join(out)
        except _Uneven:
            return np.array(self.coder.encode_ordinary(text), dtype="<u4").tobytes()


def encode_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids (binary, little-endian unsigned 32-bit), decoded (string)`` of every whole text, row by row.

    Nulls count as empty texts, which give no ids and an empty decoded text. Repeated rows and ids stay as they are;
    other columns are ignored. Needs no shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = WordBpe(tokenizer_path)
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                ids = [coder.encode(t or "") for t in part["text"]]
                yield pd.DataFrame({"id": part["id"], "ids": ids, "decoded": [coder.decode(i).decode() for i in ids]})

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)


def token_digests(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like ``encode_decode`` but only each row's digests leave the worker: ``id_col, n_tokens, ids_sha256, decoded_sha256``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = WordBpe(tokenizer_path)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        for pdf in batches:
            rows = []
            for text in pdf["text"]:  # one text's tokens at a time
                ids = coder.encode(text or "")
                rows.append((len(ids) // 4, digest(ids), digest(coder.decode(ids))))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(id=pdf["id"].to_numpy())[["id", "n_tokens", "ids_sha256", "decoded_sha256"]]

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
