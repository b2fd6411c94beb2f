"""The public byte-level vocabulary as plain tables, and pre-tokens of texts."""

from __future__ import annotations

import json

import numpy as np
import public_tokenizers
import regex

#: The characters that byte-level vocabularies print for themselves.
PRINTED = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]


def byte_of_character() -> dict[str, int]:
    """A vocabulary file writes each byte as one printable character: itself, or the next free one from 256 on."""
    rest = [b for b in range(256) if b not in set(PRINTED)]
    return {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, byte values and merge ranks of a byte-level file, read once per worker."""

    _open: dict[str, "Vocabulary"] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        if model["type"] != "BPE" or not plain:
            raise ValueError(f"not a plain byte-level vocabulary: {path}")
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        table = byte_of_character()
        self.bytes_of = {i: bytes(table[c] for c in token) for token, i in self.ids.items() if all(c in table for c in token)}
        self.first = np.zeros(256, dtype=np.int64)
        for c, b in table.items():
            self.first[b] = self.ids[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, whole = (np.array([self.ids[x] for x in xs], dtype=np.int64) for xs in zip(*((a, b, a + b) for a, b in pairs)))
        self.size = max(self.ids.values()) + 1
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), whole[order]
        self.pre = regex.compile(public_tokenizers.PATTERN)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    @classmethod
    def open(cls, path: str) -> "Vocabulary":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """Stretches of ordinary text and, with their ids, the special strings between them."""
        if self.cut is None or not any(s in text for s in self.special):
            return [(text, None)]
        return [(p, self.special.get(p)) for p in self.cut.split(text) if p]
