"""Token ids of texts by a public tokenizer, word by word and remembered.

The vocabulary used here drops white space, folds case and never merges across
words or between letters and other characters. So the ids of a text are the ids
of its words in turn, and those of most words the ids of its letter runs and
marks in turn. Words and runs repeat; each worker remembers a bounded number of
both. Words with characters outside ASCII and Latin letters, and those that
could hold a special token, are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHERS_KEPT = 30_000
RUNS_KEPT = 150_000
LONGEST_KEPT = 48

#: Where the tokenizer splits words of plain letters, and which words those are.
RUN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")
PLAIN = re.compile(r"[!-~À-ÖØ-öø-įı-ſ]+")
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ſ]+").fullmatch
CLOSING = frozenset(".,;:!?")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory(dict):
    """What ``find`` says of a key, remembered in two generations of ``most`` keys."""

    def __init__(self, find: Callable, most: int) -> None:
        super().__init__()
        self.find, self.most, self.old = find, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.find(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordIds:
    """Little-endian unsigned 32-bit ids of whole texts."""

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.end_id = end_id
        self.runs = Memory(self._of_run, RUNS_KEPT)
        self.others = Memory(self._of_other, OTHERS_KEPT)

    def _of_run(self, run: str) -> bytes:
        plain = run if run.isascii() else "".join(self.letters[b] for b in run.encode())
        return array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()

    def _of_other(self, word: str) -> bytes:
        if "<|" not in word and PLAIN.fullmatch(word):
            return b"".join(map(self.runs.__getitem__, RUN.findall(word.lower())))
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word; most are letters, or letters and a closing mark."""
        runs, others, found = self.runs, self.others, []
        for word in words:
            if word.isalpha() and LATIN(word):
                found.append(runs[word.lower()])
            elif word[-1:] in CLOSING and word[:-1].isalpha() and LATIN(word, 0, len(word) - 1):
                found.append(runs[word[:-1].lower()] + runs[word[-1]])
            else:
                found.append(others[word])
        return found

    def encode(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of each text and the closing id, as bytes, and their numbers; a null text counts as empty.

        Each different word of the batch is looked up once; its ids are copied
        to all its places together.
        """
        # Only ASCII white space divides here: the tokenizer drops all of it,
        # and no other character is white space for both.
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        found = self.of_words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), "<u4")
        which = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[which]
        before = np.concatenate([[0], np.cumsum(each)])
        first = (np.cumsum(sizes) - sizes)[which]
        ids = pool[np.arange(before[-1]) + np.repeat(first - before[:-1], each)]
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        counts = np.diff(before[edges]) + 1
        ends = np.cumsum(counts)
        whole = np.empty(int(ends[-1]) if len(ends) else 0, "<u4")
        closing = np.zeros(len(whole), bool)
        closing[ends - 1] = True
        whole[closing] = self.end_id
        whole[~closing] = ids
        offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(whole)])
        return data, counts
