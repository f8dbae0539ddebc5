"""Token ids of whole texts by public tokenizers, quickly and exactly.

The paths of the vocabulary files are parameters; nothing is trained or copied.
Both encoders give the ids that the ``tokenizers`` library gives for the whole
text with ``add_special_tokens=False``. It splits texts by fixed patterns and
joins what it may by the vocabulary's merges; both encoders split alike and read
the merges as ranks. This needs libraries to agree on what is a blank or a letter:
texts that are not printable Latin-1 and newlines, and those that hold a special
token's string, go to the ``tokenizers`` library whole. Nothing is kept from text
to text, so that memory and time a text do not depend on how many came before.
"""

from __future__ import annotations

import base64
import gc
import os
import re
from functools import lru_cache

import numpy as np

#: Letters and digits of printable Latin-1.
LETTERS, DIGITS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: The split that belongs to the byte vocabulary's ranks, over printable Latin-1 and newlines.
#: That a run of blanks leaves its last one to what follows is not in it, as looking ahead
#: is slow: such runs are cut first.
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^ \n{LETTERS}{DIGITS}]+|[ \n]+"
BLANK_RUNS = re.compile(r"(?<=[ \n])(?=[ \n][^ \n\x01])")


def is_plain(text: str) -> bool:
    """Printable Latin-1 characters and newlines only."""
    if not text.replace("\n", " ").isprintable():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _specials(library) -> tuple[str, ...]:
    return tuple(t.content for t in library.get_added_tokens_decoder().values())


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1
    stands for itself, the other bytes in order for what follows U+00FF."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of a vocabulary that drops blanks and ends words.

    As ranks, a word is its bytes and ``END``, which stands for the vocabulary's word end.
    """

    #: The split of the word vocabulary's pre-tokenizer, over printable Latin-1 in lower case.
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
    #: No plain text holds this character.
    END = "\x01"

    def __init__(self, path: str):
        import tiktoken

        self.library = _library(path)
        self.specials = _specials(self.library)
        letters, ranks = _byte_letters(), {}
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            stem = token.removesuffix("</w>")
            ranks[bytes(map(letters.__getitem__, stem)) + (self.END.encode() if stem != token else b"")] = i
        self.quick = tiktoken.Encoding("words", pat_str=f"[^{self.END}]+{self.END}", mergeable_ranks=ranks, special_tokens={})

    def _encode(self, text: str) -> list[int]:
        if not is_plain(text) or any(x in text for x in self.specials):
            return self.library.encode(text, add_special_tokens=False).ids
        words = self.WORDS.findall(text.lower())
        return self.quick.encode_ordinary(self.END.join(words) + self.END) if words else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # Millions of short strings are made here and none in a cycle.
        was_on = gc.isenabled()
        gc.disable()
        try:
            return [np.array(self._encode(t), np.uint16) for t in texts]
        finally:
            if was_on:
                gc.enable()


class ByteEncoder:
    """Ids of a byte-level vocabulary; ``ranks`` is the file of the same vocabulary as ranks.

    Plain texts are encoded together, as one text in which ``END`` follows each.
    """

    #: Characters that no plain text holds, and ids that uint16 does not.
    END, CUT = "\x01", "\x02"
    END_ID, CUT_ID = 1 << 16, (1 << 16) + 1

    def __init__(self, path: str, ranks: str):
        import tiktoken

        self.library = _library(path)
        pairs = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks, "rb"))}
        self.specials = _specials(self.library)
        # No plain text holds the two marks: one ends a text, one only cuts a run of blanks.
        self.quick = tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=pairs, special_tokens={self.END: self.END_ID, self.CUT: self.CUT_ID})

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint16)

    def _is_quick(self, text: str) -> bool:
        return is_plain(text) and not any(x in text for x in self.specials)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        quick = [self._is_quick(t) for t in texts]
        joined = "".join(t + self.END for t, q in zip(texts, quick, strict=True) if q)
        if not joined:
            return [self._slow(t) for t in texts]
        if any(x in joined for x in ("  ", " \n", "\n ", "\n\n")):
            joined = BLANK_RUNS.sub(self.CUT, joined)
        found = self.quick.encode_to_numpy(joined, allowed_special={self.END, self.CUT})
        found = found[found != self.CUT_ID]
        ends = np.flatnonzero(found == self.END_ID)
        # Copies, so that no text keeps all others' ids.
        parts = iter([found[i:j].astype(np.uint16) for i, j in zip([0, *(ends[:-1] + 1)], ends, strict=False)])
        return [next(parts) if q else self._slow(t) for t, q in zip(texts, quick, strict=True)]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker, which keeps it from task to task."""
    return WordEncoder(path)


@lru_cache(maxsize=2)
def byte_encoder(path: str, ranks: str) -> ByteEncoder:
    return ByteEncoder(path, ranks)
