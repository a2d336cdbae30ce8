"""Token ids of whole texts, one white-space separated word at a time.

The tokenizer drops white space before it looks for words, so the ids of a text are the ids of its words in order. Each Python
worker keeps the ids of words it has met in a bounded cache; a word it has not met is encoded by the ``tokenizers`` library.
"""

from __future__ import annotations

import re
import sys
from array import array

#: A word that is one run of Latin letters and one run of marks: the library's own split puts the border between the two.
_LETTERS_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


class WordIds:
    """Encodes words with the tokenizer of a file. One Python worker keeps ``room`` words and ``runs`` runs of letters or marks at most.

    The first words met fill the room, and frequent words come early; if four times as many came in vain since, the words have
    changed, and the room is cleared.
    """

    def __init__(self, path: str, room: int = 200_000, runs: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.room, self.most_runs = Tokenizer.from_file(path), room, runs
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.in_vain = 0
        self.alphabet = _byte_alphabet()

    def _run(self, letters: str) -> bytes:
        """Ids of a run of lower-case letters or of a run of marks: one piece of the library's split, so its model can take it."""
        piece = letters if letters.isascii() else "".join(map(self.alphabet.__getitem__, letters.encode()))
        ids = array("H", [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()
        if len(self.runs) >= self.most_runs:
            self.runs.clear()
        self.runs[letters] = ids
        return ids

    def __missing(self, word: str) -> bytes:
        if m := _LETTERS_MARKS(word):
            letters, marks = m.groups()
            letters = letters.lower()
            ids = self.runs.get(letters) or self._run(letters)
            if marks:
                ids += self.runs.get(marks) or self._run(marks)
        else:
            ids = array("H", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(self.words) < self.room:
            if len(word) <= 64:
                self.words[word] = ids
        else:
            self.in_vain += 1
            if self.in_vain > 4 * self.room:
                self.words.clear()
                self.in_vain = 0
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of one text as little-endian unsigned 16-bit integers; none for null and for white space alone."""
        get, missing, text = self.words.get, self.__missing, text or ""
        for mark in "\n\t\r\x0b\x0c":
            text = text.replace(mark, " ")
        return b"".join([get(w) or missing(w) for w in text.split(" ") if w])


def word_ids(path: str) -> WordIds:
    """The encoder of this Python worker, which outlives a task."""
    held = sys.__dict__.setdefault("_recon_word_ids", {})
    if path not in held:
        held[path] = WordIds(path)
    return held[path]
