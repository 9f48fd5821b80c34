"""Encoding with the tokenizers library, each distinct unit of text once per worker process."""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import unicodedata
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa

#: Units whose ids a worker process keeps; the store is emptied when it is full.
KEPT_UNITS = 600_000
#: Units that one call encodes.
JOINED = 512
#: Frequent marks after words; and characters that Python counts as white space and the tokenizers' patterns do not.
MARKS = frozenset(".,;:!?")
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: A pattern whose matches hold runs of letters whole.
LETTERS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: White space and what follows it, as byte-level patterns divide them.
SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")


if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are packed in the machine's order, which must be little-endian with 4-byte integers")


def unit_rule(definition: dict) -> str:
    """How a tokenizer's texts fall into units that it encodes independently.

    ``spaced``: byte-level pre-tokens never reach over the borders of ``SPACED``. ``words``: white
    space is dropped and no pre-token holds any. ``whole``: unknown, so only whole texts are encoded.
    """
    first = definition.get("pre_tokenizer") or {}
    normalizer = definition.get("normalizer")
    parts = first.get("pretokenizers", [])
    if first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not normalizer:
        return "spaced"
    if [p.get("type") for p in parts] == ["Split", "ByteLevel"] and parts[0].get("behavior") == "Removed" and parts[0].get("invert"):
        pattern = parts[0].get("pattern", {}).get("Regex", "")
        plain = {"NFC", "Replace", "Lowercase"}
        if "[^\\s" in pattern and " " not in pattern and {n.get("type") for n in (normalizer or {}).get("normalizers", [])} <= plain:
            return "words"
    return "whole"


def _stays_letter(c: str) -> bool:
    """Whether a character is a letter, also after composition and lower case: some become letter and mark."""
    return c.isalpha() and (c.isascii() or unicodedata.normalize("NFC", c).lower().isalpha())


class Encoder:
    """Ids of texts as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            definition = json.load(file)
        self.rule = unit_rule(definition)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.code = "H" if self.width == 2 else "I"
        self.known: dict[str, bytes] = {}
        self.plain = None
        if self.rule == "spaced":  # a byte-level token has a character for each of its bytes
            self.byte_lengths = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.byte_lengths[i] = len(token)
        suffix = definition["model"].get("end_of_word_suffix")
        if self.rule == "words" and suffix and definition["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex") == LETTERS:
            self.word_ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.word_ends[i] = token.endswith(suffix)
            # The same model for lower-case ASCII letters, which the other steps leave as they are.
            self.plain = Tokenizer(self.tokenizer.model)

    def _units(self, text: str) -> list[str]:
        if self.rule == "whole" or ODD_SPACE.search(text):
            return [text]
        return SPACED.findall(text) if self.rule == "spaced" else text.split()

    def _learn(self, fresh: list[str]) -> None:
        """Learns units, those whose ends show in the ids many in a call: there each is a word that is encoded by itself."""
        rest = fresh
        if self.rule == "spaced":
            # The bytes that the ids stand for tell where each unit ends.
            rest = self._learn_words(self.tokenizer, fresh, fresh, lambda ids, words: (
                np.cumsum(self.byte_lengths[ids]), np.cumsum(list(map(len, map(str.encode, words))))))
        elif self.plain:
            # One pre-token each, which the normalizer does not change but for lower case: its last id has the suffix.
            rest, units = [], []
            for u in fresh:
                (units if u.isascii() and u.isalpha() else rest).append(u)
            rest += self._learn_words(self.plain, units, list(map(str.lower, units)), lambda ids, words: (
                np.cumsum(self.word_ends[ids]) * self.word_ends[ids], np.arange(1, len(words) + 1)))
        # The fast form gives the same ids and leaves out the offsets.
        made = [x.ids for x in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        self._keep(rest, list(chain.from_iterable(made)), np.cumsum([*map(len, made)], dtype=np.int64))

    def _learn_words(self, tokenizer, units: list[str], words: list[str], ends) -> list[str]:
        """Learns units as the words of calls; ``ends`` gives the place told by each id and that of each word's last one. What does not fit is left."""
        left = []
        for low in range(0, len(units), JOINED):
            some = units[low : low + JOINED]
            ids = tokenizer.encode_batch_fast([words[low : low + JOINED]], is_pretokenized=True, add_special_tokens=False)[0].ids
            told, wanted = ends(np.array(ids, np.int64), words[low : low + JOINED])
            stops = np.flatnonzero(np.isin(told, wanted)) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                self._keep(some, ids, stops)
            else:
                left += some
        return left

    def _keep(self, units: list[str], ids: list[int], stops: np.ndarray) -> None:
        data, at = array(self.code, ids).tobytes(), 0
        for unit, stop in zip(units, (stops * self.width).tolist(), strict=True):
            self.known[unit] = data[at:stop]
            at = stop

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        gc.disable()  # hundreds of thousands of small results and no cycle among them
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        divided = [self._units(t or "") for t in texts]
        # Units are told apart once a batch, so only different ones are looked up and ids are put together at once.
        coded = pa.array(list(chain.from_iterable(divided)), pa.large_string()).dictionary_encode()
        units, known = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known
        if len(known) > KEPT_UNITS:
            known.clear()
        found = list(map(known.get, units))
        missing = [i for i, ids in enumerate(found) if ids is None]
        fresh = {units[i] for i in missing}
        # A mark after a letter is a pre-token of its own: such units are made of two others.
        ended = [] if self.rule == "whole" else [u for u in fresh if u[-1] in MARKS and _stays_letter(u[-2:-1])]
        if ended:
            fresh = fresh.difference(ended).union({u[:-1] for u in ended}.difference(known), {u[-1] for u in ended}.difference(known))
        self._learn(list(fresh))
        for u in ended:
            known[u] = known[u[:-1]] + known[u[-1]]
        for i in missing:
            found[i] = known[units[i]]
        made = pa.array(found, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(made.buffers()[1], np.int64, len(made) + 1, 8 * made.offset) if len(made) else np.zeros(1, np.int64)
        stops, data = ends[np.cumsum([0, *map(len, divided)])].tolist(), memoryview(made.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(stops, stops[1:], strict=False)]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a vocabulary file in this process: a worker's later tasks find the units of earlier ones."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def widened(ids: bytes, kind: np.dtype) -> bytes:
    """The same ids as little-endian unsigned 32-bit integers."""
    return np.frombuffer(ids, dtype=kind).astype("<u4").tobytes()


def small_batches(texts: list[str | None], most: int = 2048, characters: int = 1 << 22):
    """Runs of texts and where they begin: up to ``most``, and a run ends once it holds so many characters."""
    at = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if i + 1 - at == most or held >= characters or i + 1 == len(texts):
            yield at, texts[at : i + 1]
            at, held = i + 1, 0
