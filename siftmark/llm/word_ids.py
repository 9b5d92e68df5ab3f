"""Token ids of whole texts, word by word, for tokenizers whose words end at white space."""

from __future__ import annotations

import os
from itertools import compress, count, islice
from operator import not_
from struct import Struct
from unicodedata import is_normalized

from tokenizers import Tokenizer

#: So many words are remembered; beyond, the later half is forgotten.
REMEMBERED = 500_000
#: A byte for each of so many places tells which words have come before.
SEEN = 1 << 22
#: Endings that a tokenizer of this kind takes as a run of their own behind a letter or
#: digit: ASCII signs, but for the apostrophe of contractions and the end of a mark.
ENDINGS = b"!\"#$%&()*+,-./:;<=?@[\\]^_`{|}~"

#: Bytes that byte-level models write as themselves; the others follow from code point 256 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SIGNS = {b: 0x100 + i for i, b in enumerate(sorted(set(range(0x100)) - set(_PLAIN)))}


def ends_in_letter(stem: bytes) -> bool:
    """Whether a word ends in a lower letter, beyond ASCII, of the scripts on whose
    letters all versions of Unicode agree."""
    if stem[-1:] < b"\x80":
        return False
    last = stem[-4:].decode(errors="ignore")[-1:]
    return last < "\u0500" and last.isalpha() and last == last.lower()


class WordIds:
    """Ids of words as little-endian 32-bit numbers, each word tokenized once.

    The tokenizer is made on first use. It must compose and lower letters, drop
    white space, take letters, digits and other signs apart, and write bytes as
    signs in the usual way.
    """

    def __init__(self, tokenizer_json: str):
        self.json, self.tokenizer = tokenizer_json, None
        self.known: dict[bytes, bytes] = {}
        self.seen = bytearray(SEEN)

    def _open(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(self.json)
        self.model = self.tokenizer.model
        self.packers = [Struct(f"<{n}I").pack for n in range(64)]
        self.marks = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]

    def numbers(self, ids: list[int]) -> bytes:
        """As little-endian 32-bit numbers."""
        n = len(ids)
        return self.packers[n](*ids) if n < len(self.packers) else Struct(f"<{n}I").pack(*ids)

    def words(self, content: bytes) -> list[bytes]:
        """The words of a text, lowered unless one of the tokenizer's marks is then in it."""
        if self.tokenizer is None:
            self._open()
        lowered = content.lower()
        return (content if any(m in lowered for m in self.marks) else lowered).split()

    def ids(self, texts: list[list[bytes]]) -> list[bytes]:
        """The ids of each text's words, one after another."""
        found = [list(map(self.known.get, words)) for words in texts]
        fresh: set[bytes] = set()
        for words, own in zip(texts, found):
            fresh.update(compress(words, map(not_, own)))
        new = self._coded(fresh)
        for words, own in zip(texts, found):
            for at in list(compress(count(), map(not_, own))):
                own[at] = new[words[at]]
        self._remember(new)
        return list(map(b"".join, found))

    def _remember(self, new: dict[bytes, bytes]) -> None:
        """Most words come once and never again: one is remembered when it comes anew
        the second time. (Words that share a place may be taken for each other here.)"""
        if len(self.known) > REMEMBERED:
            self.known = dict(islice(self.known.items(), REMEMBERED // 2))
            self.seen = bytearray(SEEN)
        known, seen = self.known, self.seen
        for word, ids in new.items():
            place = hash(word) & SEEN - 1
            if seen[place]:
                known[word] = ids
            else:
                seen[place] = 1

    def _coded(self, fresh: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words that are not remembered, and of the parts they were cut into."""
        known, new, cut = self.known, {}, []
        for word in fresh:
            if word[-1] in ENDINGS:
                stem = word.rstrip(ENDINGS)
                if stem[-1:].isalnum() or ends_in_letter(stem):
                    cut.append((word, stem, word[len(stem) :]))
                    continue
            new[word] = b""
        for _, stem, end in cut:
            for part in (stem, end):
                new[part] = known.get(part, b"")
        self._tokenize(new)
        for word, stem, end in cut:
            new[word] = new[stem] + new[end]
        return new

    def _tokenize(self, new: dict[bytes, bytes]) -> None:
        """Sets ids where there are none. Words that are one run of lower letters go to the
        model as they are; the others go through the whole tokenizer."""
        tokenize, numbers = self.model.tokenize, self.numbers
        others = []
        for word, ids in new.items():
            if ids:
                continue
            text = word.decode()
            if word.isalpha() and word.islower():  # of bytes: ASCII letters, which such models write as themselves
                new[word] = numbers([t.id for t in tokenize(text)])
            elif text.isalpha() and text == text.lower() and is_normalized("NFC", text):
                new[word] = numbers([t.id for t in tokenize(word.decode("latin-1").translate(SIGNS))])
            else:
                others.append((word, text))
        coded = self.tokenizer.encode_batch([t for _, t in others], add_special_tokens=False)
        new.update((w, numbers(c.ids)) for (w, _), c in zip(others, coded))


def kept_in(holder: dict) -> WordIds:
    """The object kept in a broadcast ``{"json": ...}``. A worker process holds on to
    a broadcast's value, so what one task has learned serves the next one."""
    if "ids" not in holder:
        holder["ids"] = WordIds(holder["json"])
    return holder["ids"]
