"""Token ids of whole texts by a tokenizers file, with a bounded memory of words already encoded.

Memory holds up to twice `words` words and those of one call; worker processes keep it from task to task.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

from loomtext.llm.base import KEPT

LETTER = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: how byte-level BPE files of this family cut text before merging (fixed value), spelled out for the characters outside RARE
SPLIT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")
#: texts with such characters go to the library whole
RARE = re.compile("[^\t\n\r\x20-\x7e\xa1-\xff]")

#: how byte-level vocabularies spell bytes (fixed value): printable ones as themselves, the others by the code points from 256 on
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLED = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Words(dict):
    """Raw ids of words; one that is not there is encoded by the file's model, or moves here from the older half."""

    def __init__(self, library, older: dict[str, bytes]) -> None:
        super().__init__()
        self.tokenize, self.older = library.model.tokenize, older

    def __missing__(self, word: str) -> bytes:
        raw = self.older.pop(word, None)
        if raw is None:
            if not word.isascii() or word.isspace():
                spelled = word.encode().decode("latin-1").translate(SPELLED)
            else:
                spelled = SPELLED[32] + word[1:] if word[0] == " " else word
            raw = array("I", [t.id for t in self.tokenize(spelled)]).tobytes()
        self[word] = raw
        return raw


class Encoder:
    """Encodes lists of texts; each distinct word goes through the tokenizers library once while it is remembered.

    Byte-level BPE never merges across the cuts of SPLIT, so a text's ids are its words' ids end to end.
    Files of another kind, and texts with rare characters or a token that was added to the vocabulary, are encoded whole.
    """

    def __init__(self, path: str, words: int = 200_000) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words = words
        self.known = Words(self.library, {})
        file = json.loads(self.library.to_str())
        split = file["pre_tokenizer"] or {}
        plain = file["model"]["type"] == "BPE" and not file["model"].get("dropout") and not file["model"].get("ignore_merges")
        self.by_word = plain and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and file["normalizer"] is None and file["truncation"] is None and file["padding"] is None
        added = [t["content"] for t in file["added_tokens"]]
        self.by_word = self.by_word and not any(t["normalized"] and not t["special"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"])
        self.added = added

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return self._whole(texts)
        out: list[np.ndarray | None] = [None] * len(texts)
        rare = [i for i, t in enumerate(texts) if any(a in t for a in self.added) or RARE.search(t)]
        for i, ids in zip(rare, self._whole([texts[i] for i in rare]), strict=True):
            out[i] = ids
        if len(self.known) > self.words:  # words met again move on from the older half, the rest is forgotten
            self.known.older = {}
            self.known = Words(self.library, self.known)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, SPLIT.findall(t))), np.uint32) if out[i] is None else out[i] for i, t in enumerate(texts)]


def encoder(path: str) -> Encoder:
    """This process's encoder of a file, kept while its tasks encode (sliced with kind="tokens")."""
    if ("tokens", path) not in KEPT:
        KEPT["tokens", path] = Encoder(path)
    return KEPT["tokens", path]
