"""Byte-level BPE: encoding by a queue of merge ranks over a linked list of symbols, decoding by the vocabulary's strings."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from calipra.llm.common import bound_batches

#: A worker forgets the words that it has encoded when it holds so many.
CACHE_WORDS = 600_000
#: How the byte-level pre-tokenizer splits a text (fixed by the vocabulary).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# Up to U+024F, the characters of WORDS's classes can be named, which the standard library looks up faster than classes. Contractions, which begin with what is no letter or number, come after these.
_LETTERS, _NUMBERS, _SPACES = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", " \t-\r\u0085\u00a0"
_OTHER = re.compile("[^\x00-\u024f]").search
_LATIN_WORDS = re.compile(f" ?[{_LETTERS}]+| ?[{_NUMBERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_LETTERS}{_NUMBERS}{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+").findall
_ALL_WORDS = regex.compile(WORDS).findall


def split_words(text: str) -> list[str]:
    """The parts of a text that WORDS finds."""
    return _LATIN_WORDS(text) if text.isascii() or not _OTHER(text) else _ALL_WORDS(text)


def byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Packed(dict):
    """Of each word, its ids as little-endian 32-bit numbers."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = self.encode(word.encode())
        return out


def is_plain(spec: dict) -> bool:
    """Whether a tokenizer file asks for byte-level BPE of the words of WORDS and for nothing else."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    return plain and model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))


class ByteBPE:
    """Reads a tokenizer file of plain byte-level BPE; others are refused. Its added tokens are found in texts first, longest first, as the file asks."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, chars = spec["model"], byte_chars()
        as_bytes = lambda s: bytes(chars[c] for c in s)
        ids: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if not is_plain(spec) or any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} is no file of plain byte-level BPE")
        if max([*ids.values(), *added.values()]) >= 1 << 17:
            raise ValueError(f"{path} has ids of more than 17 bits")
        self.special = {s: array("I", [i]).tobytes() for s, i in added.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")").split if added else lambda t: [t]
        self.strings: list[bytes] = [b""] * (max([*ids.values(), *added.values()]) + 1)
        for s, i in ids.items():
            self.strings[i] = s.encode() if s in added else as_bytes(s)
        for s, i in added.items():
            self.strings[i] = s.encode()
        self.of_byte = [0] * 256
        for c, b in chars.items():
            self.of_byte[b] = ids[c]
        # of a pair of ids: its rank above 17 bits that hold the merged id
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[ids[x] << 17 | ids[y]] = rank << 17 | ids[x + y]
        self.packed = Packed(self.word)

    def word(self, word: bytes) -> bytes:
        """The packed ids of one word: the pair of the least rank is merged, leftmost first, till no pair has a rank.

        Queue entries aren't removed as their pairs go; one whose place no longer holds the pair it was made for is skipped.
        """
        of_byte, pairs = self.of_byte, self.pairs
        ids = [of_byte[b] for b in word]
        n = len(ids)
        queue = []
        for i in range(n - 1):
            m = pairs.get(ids[i] << 17 | ids[i + 1])
            if m is not None:
                queue.append((m, i))
        if queue:
            heapify(queue)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while queue:
                m, i = heappop(queue)
                j = after[i]
                if ids[i] < 0 or j >= n or pairs.get(ids[i] << 17 | ids[j]) != m:
                    continue
                new = m & 0x1FFFF
                ids[i], ids[j] = new, -1
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    m = pairs.get(new << 17 | ids[k])
                    if m is not None:
                        heappush(queue, (m, i))
                h = before[i]
                if h >= 0:
                    m = pairs.get(ids[h] << 17 | new)
                    if m is not None:
                        heappush(queue, (m, h))
            ids = [x for x in ids if x >= 0]
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian 32-bit numbers."""
        get, out = self.packed.__getitem__, []
        for k, part in enumerate(self.split(text)):
            if k % 2:
                out.append(self.special[part])
            else:
                out.extend(map(get, split_words(part)))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, array("I", packed))).decode("utf-8", "replace")


@cache
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request, ids (array<int>) and decoded (string).

    Rows stay where they are: no shuffle. Null text counts as empty: no ids, an empty decoded text. Rows may repeat;
    null doc_ids stay null; other columns of docs are not read. tokenizer is a path that every machine has.
    """
    bound_batches(docs.sparkSession)
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            counts, ids_sha, text_sha, ids, decoded = [], [], [], [], []
            for t in batch.column(1):
                packed = bpe.encode(t.as_py() or "")
                back = bpe.decode(packed)
                counts.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    ids.append(array("I", packed).tolist())
                    decoded.append(back)
            cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(id_col, text).mapInArrow(run, schema)
