"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of the tree hold, for each symbol of a word, the rank of its pair with the next one; an inner node holds the least
of its leaves. The root is then the leftmost lowest-rank merge. A merge changes three leaves, each by a walk to the root, so a
word of n symbols takes n log n steps, whatever its length.

Texts are encoded where they lie, in Arrow batches, without a shuffle. Words repeat, so each Python worker keeps the words it
has met in tables of bounded size; what is in them changes the speed and never the result.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

from galley.sources.workers import ship, trimmed

#: White space as the tokenizer's patterns have it, which is less than str.split() takes.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
KEPT_WORDS, KEPT_PIECES = 1 << 18, 1 << 16
WORD_END = "</w>"
NO_PAIR = 1 << 60


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in shown)
    out = {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(rest)}
    return [out[b] for b in range(256)]


def merged(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The symbols of one word after all merges; merges gives (rank, merged symbol) of a pair."""
    n = len(symbols)
    if n < 2:
        return symbols
    found = [merges.get(p) for p in zip(symbols, symbols[1:])]
    if not any(found):
        return symbols
    width = 1 << (n - 1).bit_length()
    tree = [NO_PAIR] * (2 * width)
    # A leaf orders by rank and then by place, so the least is the leftmost of the lowest rank.
    for i, hit in enumerate(found):
        if hit:
            tree[width + i] = hit[0] * width + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    symbols = list(symbols)
    while (least := tree[1]) < NO_PAIR:
        i = least % width
        j = after[i]
        symbols[i] = merges[symbols[i], symbols[j]][1]
        symbols[j] = -1
        k = after[i] = after[j]
        changed = [(j, NO_PAIR)]
        if k < n:
            before[k] = i
            hit = merges.get((symbols[i], symbols[k]))
            changed.append((i, hit[0] * width + i if hit else NO_PAIR))
        else:
            changed.append((i, NO_PAIR))
        if (h := before[i]) >= 0:
            hit = merges.get((symbols[h], symbols[i]))
            changed.append((h, hit[0] * width + h if hit else NO_PAIR))
        for leaf, value in changed:
            at = width + leaf
            tree[at] = value
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                value = a if a < b else b
                if tree[at] == value:
                    break
                tree[at] = value
                at >>= 1
    return [s for s in symbols if s >= 0]


class Codec:
    """Encoder and decoder of a tokenizer file with a word-end suffix, a byte-level alphabet and lower-cased words."""

    def __init__(self, definition: str) -> None:
        file = json.loads(definition)
        model = file["model"]
        vocab: dict[str, int] = model["vocab"]
        if model.get("end_of_word_suffix") != WORD_END or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("only vocabularies with word ends and plain merges can be read")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        by_id = {v: k for k, v in vocab.items()} | {v: k for k, v in self.special.items()}
        self.tokens = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + WORD_END] for s in symbols]
        self.split_special = regex.compile(f"({'|'.join(map(regex.escape, self.special))})") if self.special else None
        rule = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.pieces = regex.compile(rule).findall
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def part(self, piece: str) -> bytes:
        # A piece in ASCII is a word of its own with the same ids, so one table holds both.
        table, most = (self.words, KEPT_WORDS) if piece.isascii() else (self.parts, KEPT_PIECES)
        if (ids := table.get(piece)) is None:
            data = piece.encode()
            inner = self.inner
            ids = array("I", merged([*(inner[b] for b in data[:-1]), self.last[data[-1]]], self.merges)).tobytes()
            if len(piece) <= 64:
                if len(table) >= most:
                    table.clear()
                table[piece] = ids
        return ids

    def word(self, word: str) -> bytes:
        """Packed ids of a stretch without white space."""
        text = word if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ")
        pieces = self.pieces(text.lower())
        got = b"".join([self.part(piece) for piece in pieces])
        if len(word) <= 64:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, got = self.words, []
        stretches = self.split_special.split(text) if self.split_special and "<|" in text else [text]
        for k, stretch in enumerate(stretches):
            if k % 2:
                got.append(self.special[stretch].to_bytes(4, "little"))
                continue
            words = [stretch] if ODD_SPACE.search(stretch) else stretch.split()
            hits = list(map(known.get, words))
            if None in hits:
                hits = [self.word(w) if h is None else h for h, w in zip(hits, words)]
            got += hits
        return b"".join(got)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by one space each, as the file names no decoder of its own; special tokens stay."""
        return " ".join(map(self.tokens.__getitem__, array("I", ids)))


_codecs: dict[int, Codec] = {}


def codec(definition: str) -> Codec:
    """One codec for each worker and tokenizer."""
    if (key := hash(definition)) not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(definition)
    return _codecs[key]


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids binary (little-endian unsigned 32-bit), decoded string; one row per input row.

    ``tokenizer`` is the path of the tokenizer file on the driver, which sends its text, a few megabytes, to the executors. A
    null or empty text, or one of white space, has no ids and decodes to the empty string. A repeated row is encoded as often
    as it occurs. An empty table gives no rows. Other columns are ignored.
    """
    spark = ship(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(definition.value)
        for frame in frames:
            for start in range(0, len(frame), 256):
                part = frame.iloc[start : start + 256]
                ids = [own.encode(t or "") for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": ids, "decoded": list(map(own.decode, ids))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(trimmed(batches), f"doc_id {kind}, ids binary, decoded string")
