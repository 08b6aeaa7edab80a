"""Token ids of whole texts by a ``tokenizers`` file, with a memory of words.

No token of these vocabularies crosses a space or line break, so a text is cut
into chunks and every distinct chunk is encoded once per Python worker. What is
joined for encoding and how the ids are told apart depends on the vocabulary;
texts with unusual white space or characters go through the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
from tokenizers import Tokenizer

RUN = 500
# Chunks of these characters are the same after NFC and have one lower case everywhere.
PLAIN = re.compile("[!-~À-ÿ]+")
# Signs behind a word that vocabularies of whole words cut off, in no token with letters.
MARKS = ".,;:!?"
# White space beyond the single space and line break, or at either end.
ODD = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]|[ \n]{2}|^[ \n]|[ \n]$")


def load(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class ChunkIds:
    """Ids of chunks as little-endian uint32 bytes, remembered in two bounded generations."""

    def __init__(self, path: str, limit: int) -> None:
        self.whole = load(path)
        # the same model and cutting without normaliser and added tokens
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = self.whole.pre_tokenizer
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.limit, self.known, self.old = limit, {}, {}

    def encoded(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def special(self, chunk: str) -> bool:
        return any(s in chunk for s in self.specials)

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks that are not known yet."""
        if len(self.known) > self.limit:
            self.old, self.known = self.known, {}
        plain, rest = [], []
        for chunk in chunks:
            if (ids := self.old.get(chunk)) is not None:
                self.known[chunk] = ids
            elif self.simple(chunk):
                plain.append(chunk)
            else:
                rest.append(chunk)
        for start in range(0, len(plain), RUN):
            run = plain[start : start + RUN]
            pieces = self.split_run(run)
            if pieces is None:
                rest.extend(run)
            else:
                self.known.update(zip(run, pieces))
        for chunk in rest:
            self.known[chunk] = self.encoded(chunk)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        cut = [self.chunks(t) for t in texts]
        flat = [c for chunks in cut if chunks is not None for c in chunks]
        found = list(map(self.known.get, flat))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        if gaps:
            self.learn({flat[i] for i in gaps})
            for i in gaps:
                found[i] = self.known[flat[i]]
        out, start = [], 0
        for text, chunks in zip(texts, cut):
            if chunks is None:
                out.append(self.encoded(text))
            else:
                out.append(b"".join(found[start : start + len(chunks)]))
                start += len(chunks)
        return out

    def cut_at(self, raw: np.ndarray, ends: np.ndarray, skip: int) -> list[bytes]:
        data, start, out = raw.astype("<u4").tobytes(), 0, []
        for end in ends.tolist():
            out.append(data[4 * start : 4 * end])
            start = end + skip
        return out


class WordEndIds(ChunkIds):
    """For vocabularies that drop white space and mark the end of words."""

    SEPARATOR = "\x01"

    def __init__(self, path: str, limit: int = 500_000) -> None:
        super().__init__(path, limit)
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.is_end[number] = token.endswith("</w>")
        (self.separator,) = self.bare.encode(self.SEPARATOR, add_special_tokens=False).ids

    def chunks(self, text: str) -> list[str] | None:
        # str.split() also cuts at these four, which are no white space to the library
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return None
        return text.split()

    def simple(self, chunk: str) -> bool:
        return PLAIN.fullmatch(chunk) is not None and not self.special(chunk)

    def learn(self, chunks: set[str]) -> None:
        # letters only: one word each, so word ends tell the words apart; the marks behind one have ids of their own
        words = {c: c.rstrip(MARKS) for c in chunks if c not in self.old}
        words = {c: word for c, word in words.items() if word.isalpha()}
        if not PLAIN.fullmatch("".join(words.values())):
            words = {c: word for c, word in words.items() if PLAIN.fullmatch(word)}
        super().learn(chunks.difference(words))
        ordered = []
        for word in set(words.values()):
            if word not in self.known:
                if (ids := self.old.get(word)) is None:
                    ordered.append(word)
                else:
                    self.known[word] = ids
        for start in range(0, len(ordered), RUN):
            run = ordered[start : start + RUN]
            (found,) = self.bare.encode_batch_fast([" ".join(run).lower()], add_special_tokens=False)
            raw = np.array(found.ids, np.uint32)
            pieces = self.cut_at(raw, np.flatnonzero(self.is_end[raw]) + 1, 0)
            self.known.update(zip(run, pieces) if len(pieces) == len(run) else ((c, self.encoded(c)) for c in run))
        for chunk, word in words.items():
            if len(chunk) > len(word):
                marks = chunk[len(word) :]
                if marks not in self.known:
                    self.known[marks] = self.encoded(marks)
                self.known[chunk] = self.known[word] + self.known[marks]

    def split_run(self, run: list[str]) -> list[bytes] | None:
        between = f" {self.SEPARATOR} "
        raw = np.array(self.bare.encode(between.join([*run, ""]).lower(), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(raw == self.separator)
        return self.cut_at(raw, ends, 1) if len(ends) == len(run) else None


class ByteIds(ChunkIds):
    """For byte-level vocabularies whose words carry the space before them."""

    def __init__(self, path: str, limit: int = 500_000) -> None:
        super().__init__(path, limit)
        (self.line,) = self.bare.encode("\n", add_special_tokens=False).ids

    def chunks(self, text: str) -> list[str] | None:
        """The words with their space; a line break is a chunk, and the word after it has no space."""
        if ODD.search(text):
            return None
        out: list[str] = []
        for line in text.split("\n"):
            first, *others = line.split(" ")
            out.append(first)
            out.extend([f" {w}" for w in others])
            out.append("\n")
        out.pop()
        return out

    def simple(self, chunk: str) -> bool:
        return chunk != "\n" and bool(chunk) and not self.special(chunk)

    def split_run(self, run: list[str]) -> list[bytes] | None:
        raw = np.array(self.bare.encode("\n".join([*run, ""]), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(raw == self.line)
        return self.cut_at(raw, ends, 1) if len(ends) == len(run) else None
