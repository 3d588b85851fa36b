"""Token ids of texts by the tokenizers library, each distinct word encoded once per task.

Both vocabularies used here cut a text into words by a pattern first and encode every word by itself, so
the ids of a text are those of its words in a row, and, as no word crosses white space, those of the chunks
between white space.  Chunks and words come from caches of bounded size; new words go to the library.  Only texts of common characters take this path: letters up to U+024F and the punctuation of
U+2010-U+2027, for which Python's and the library's notions of letter, number, space and lower case agree.
All other texts, and those that spell one of the file's added tokens, are encoded whole by the library.
"""

from __future__ import annotations

import os
import re
from itertools import chain, count, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: How the vocabularies cut texts into words: fixed values of the tokenizer files, written for common
#: characters in the syntax of `re` ([^\W\d_] is a letter there, \d a number).  Texts are cut many at a time: no
#: word crosses the character 0 between them, which no text of common characters has.
CUTS = {
    "byte_bpe_50k": r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w\0]|_)+|\s+(?![^\s\0])|\s+",
    "word_bpe_49k": r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w\0]|_)+",
}
LOWERED = {"word_bpe_49k"}
_UNCOMMON = re.compile("[^\\t\\n\\r -~¡-±´-¸º»¿-įı-ɏ‐-‧]")


#: White space at which a text's chunks would depend on each other, where a word takes the space before it.
_WIDE = ("  ", "\n\n", " \n", "\n ", "\t", "\r")


class _Known:
    """Strings by number, the ids of each, back to back, and how often each was asked for."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.ids, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)

    def numbered(self, strings: list[str]) -> tuple[np.ndarray, list[str]]:
        """The number of each string, and the strings not seen before, which get the next numbers as they come."""
        fresh = dict.fromkeys(filterfalse(self.numbers.__contains__, strings))
        self.numbers.update(zip(fresh, count(len(self.numbers))))
        return np.fromiter(map(self.numbers.__getitem__, strings), np.int64, len(strings)), list(fresh)

    def learn(self, ids: np.ndarray, size: np.ndarray):
        self.begin = np.concatenate([self.begin, np.cumsum(size) - size + len(self.ids)])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])
        self.used = np.append(self.used, np.zeros(len(size), np.int64))

    def ids_of(self, number: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered strings in a row, and how many there are in each run of them that ends at a cut."""
        self.used += np.bincount(number, minlength=len(self.used))
        flat, ends = self._flat(number)
        return flat, np.diff(np.concatenate([[0], ends])[cuts], prepend=0)

    def _flat(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[number]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.begin[number] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends

    def often(self, most: int) -> _Known:
        """Those asked for twice or more, the most frequent `most` of them."""
        kept = np.flatnonzero(self.used > 1)
        if len(kept) > most:
            kept = np.sort(kept[np.argpartition(self.used[kept], len(kept) - most)[-most:]])
        out, strings = _Known(), list(self.numbers)
        out.numbers.update((strings[number], k) for k, number in enumerate(kept.tolist()))
        out.learn(self._flat(kept)[0], self.size[kept])
        out.used = self.used[kept] // 2
        return out


class WordEncoder:
    """Encodes texts with a tokenizer file; keeps about `most` distinct words and as many chunks, and beyond that
    those that came up again.

    A chunk is what stands between white space; only new chunks are cut into words, and only new words go to
    the library's model, in the byte alphabet of the files.
    """

    def __init__(self, path: str, most: int = 300_000):
        name = path.rpartition("/")[2].removesuffix(".json")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
        self.tokenizer = Tokenizer.from_file(path)
        self.cut = re.compile(CUTS[name]) if name in CUTS else None
        self.lowered, self.most = name in LOWERED, most
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = sorted({c.lower() if self.lowered else c for c in added})
        signs = [re.search(r"[^\w\s]+", c) for c in added]  # what a text must have to spell one, in either case
        self.signs = {m[0] for m in signs} if all(signs) else {""}
        self.bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.words, self.chunks = _Known(), _Known()

    def _model(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, size = [], []
        for word in words:  # one by one: Python's garbage collector would go through all tokens if they were kept
            spelled = word.replace(" ", "Ġ") if word.isascii() and word.isprintable() else self.bytes(word)[0][0]
            found = [token.id for token in self.tokenizer.model.tokenize(spelled)]
            size.append(len(found))
            ids += found
        return np.array(ids, np.uint32), np.array(size, np.int64)

    def _by_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words.numbers) > self.most:
            self.words = self.words.often(self.most // 2)
        words = self.cut.findall("\0".join(texts))
        # words cover all of a text, so a text's words are those that end where it does or before
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        cuts = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))), "right")
        number, fresh = self.words.numbered(words)
        if fresh:
            self.words.learn(*self._model(fresh))
        return self.words.ids_of(number, cuts)

    def _split(self, texts: list[str]) -> pa.ListArray:
        """Chunks of each text.  Where words take the space before them, a chunk stands for itself with that space,
        and the first one, which has none, is marked by the character 0."""
        if self.lowered:
            return pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        return pc.split_pattern(pa.array(["\0" + text.replace("\n", " \n") for text in texts], pa.large_string()), " ")

    def _spelled(self, chunk: str) -> str:
        if self.lowered or chunk.startswith("\n"):
            return chunk
        return chunk[1:] if chunk.startswith("\0") else " " + chunk

    def _by_chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.chunks.numbers) > self.most:
            self.chunks = self.chunks.often(self.most // 2)
        split = self._split(texts)
        found = split.values.dictionary_encode()
        number, fresh = self.chunks.numbered(found.dictionary.to_numpy(zero_copy_only=False).tolist())
        if fresh:
            self.chunks.learn(*self._by_words(list(map(self._spelled, fresh))))
        return self.chunks.ids_of(number[found.indices.to_numpy()], split.offsets.to_numpy()[1:])

    def _way(self, text: str):
        if self.cut is None or _UNCOMMON.search(text):
            return self._whole
        if any(sign in text for sign in self.signs):
            plain = text.lower() if self.lowered else text
            if any(token in plain for token in self.added):  # found before a text is cut into words
                return self._whole
        return self._by_words if not self.lowered and any(gap in text for gap in _WIDE) else self._by_chunks

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        ways, out = list(map(self._way, texts)), [None] * len(texts)
        for way in (self._whole, self._by_words, self._by_chunks):
            rows = [row for row, own in enumerate(ways) if own == way]
            if rows:
                flat, size = way([texts[row].lower() if self.lowered and way != self._whole else texts[row] for row in rows])
                for row, ids in zip(rows, np.split(flat, np.cumsum(size)[:-1])):
                    out[row] = ids
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each file and worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encoded(batches, path: str, text: str = "text", characters: int = 1 << 21):
    """(batch, first row, list of ids) for runs of rows of Arrow batches; null texts count as empty."""
    own = encoder(path)
    for batch in batches:
        column, first, run, size = batch.column(text), 0, [], 0
        for row, value in enumerate(column):
            run.append(value.as_py() or "")
            size += len(run[-1])
            if size >= characters:
                yield batch, first, own.encode(run)
                first, run, size = row + 1, [], 0
        if run:
            yield batch, first, own.encode(run)
