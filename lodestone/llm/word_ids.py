"""Token ids of whole texts by way of their words.

Where a tokenizer never joins characters of two words into one token, the ids of a text are those of its words in a row. So
each batch of texts is cut into words natively, each distinct word is looked up or encoded once, and the ids are gathered by
place. Words are encoded by the tokenizer itself. Words of letters alone are a single pre-token, so that many of them go
through its model in one text, cut by white space; punctuation that ends a word is a pre-token of its own."""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker remembers. When it is full the later half, of rarer words, is forgotten.
MEMO_WORDS = 600_000
#: Words that are encoded in one text.
TOGETHER = 500
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space other than a space or line end.
_ODD_SPACE = re.compile("[\\s\\u180e\\u200b\\ufeff]")
_MISSING = object()


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _WordIds:
    """memo: the ids of a word as bytes; None for one that must not be taken from its text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)  # words as they are, cut by white space
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes | None] = {}

    def _ids(self, tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [x.tobytes() for x in self._ids(self.tokenizer, texts)]

    def marked(self, token) -> np.ndarray:
        """By id: whether token(its string)."""
        out = np.zeros(self.tokenizer.get_vocab_size(), bool)
        out[[k for word, k in self.tokenizer.get_vocab().items() if token(word)]] = True
        return out

    def cut(self, tokenizer, texts: list[str], edge: np.ndarray, after: bool, n: int) -> list[bytes] | None:
        """The ids of the n words of the texts, each of which has one token that edge marks, its last (after) or first."""
        ids = np.concatenate(self._ids(tokenizer, texts))
        at = np.flatnonzero(edge[ids])
        if len(at) != n:
            return None
        at = np.append(0, at + 1) if after else np.append(at, len(ids))
        data, at = ids.tobytes(), (at * self.dtype.itemsize).tolist()
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def letters(self, words: list[str]) -> list[bytes]:
        """Ids of words that are letters alone."""
        raise NotImplementedError

    def others(self, words: list[str]) -> list[bytes | None]:
        raise NotImplementedError

    def single(self, word: str) -> bool:
        """Whether the word is one pre-token, which punctuation after it doesn't join."""
        return word.isalpha()

    def learn(self, words: list[str]) -> dict[str, bytes | None]:
        plain: dict[str, bytes | None] = {}
        rest, parts = [], []
        for word in words:
            core = word.rstrip(_PUNCTUATION)
            if self.single(core):
                parts.append((word, core))
                plain[core] = self.memo.get(core) if core is not word else None
            else:
                rest.append(word)
        keys = [core for core, ids in plain.items() if ids is None]
        for at in range(0, len(keys), 40 * TOGETHER):
            part = keys[at : at + 40 * TOGETHER]
            plain.update(zip(part, self.letters(part), strict=True))
        tails = {word[len(core) :]: b"" for word, core in parts}
        tails.update(zip(tails, self.whole(list(tails)), strict=True))
        out: dict[str, bytes | None] = {word: plain[core] + tails[word[len(core) :]] if core is not word else plain[core] for word, core in parts}
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            out.update(zip(part, self.others(part), strict=True))
        return out

    def values(self, words: list[str]) -> list[bytes | None]:
        memo = self.memo
        found = list(map(memo.get, words, repeat(_MISSING)))
        new = [w for w, x in zip(words, found, strict=True) if x is _MISSING]
        if not new:
            return found
        fresh = self.learn(new)
        if len(memo) + len(fresh) > MEMO_WORDS:
            kept = list(memo.items())[: MEMO_WORDS // 2]
            memo.clear()
            memo.update(kept)
        if len(memo) + len(fresh) <= MEMO_WORDS:
            memo.update(fresh)
        return [fresh[w] if x is _MISSING else x for w, x in zip(words, found, strict=True)]

    def gathered(self, units: pa.Array, ends: np.ndarray, texts: list[bytes], first=None) -> list[np.ndarray]:
        """The ids of each text, whose units end at ends. first: units that aren't looked up as others are, by place, and
        their ids."""
        known = units.dictionary_encode()
        values = self.values(known.dictionary.to_pylist())
        at = known.indices.to_numpy()
        if first:
            at = at.copy()
            at[first[0]] = len(values) + np.arange(len(first[0]))
            values = values + first[1]
        unknown = np.zeros(0, bool)
        if None in values:
            unknown = np.fromiter((x is None for x in values), bool, len(values))
            values = [x or b"" for x in values]
        size = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(values), self.dtype)
        n = size[at]
        done = np.cumsum(n)
        total = int(done[-1]) if len(done) else 0
        ids = flat[np.repeat((np.cumsum(size) - size)[at] - (done - n), n) + np.arange(total)]
        out = np.split(ids, np.append(0, done)[ends[:-1]])
        if len(unknown):
            bad = np.append(0, np.cumsum(unknown[at]))
            bad = np.flatnonzero(np.diff(bad[np.append(0, ends)]))
            for k in bad.tolist():  # one by one: a long text's encoding is large
                (out[k],) = self._ids(self.tokenizer, [texts[k].decode()])
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        raise NotImplementedError


def _strings(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.large_binary()).view(pa.large_string())


class LowerWords(_WordIds):
    """For tokenizers that lower all letters, drop white space, and end the last token of each pre-token with '</w>'."""

    def __init__(self, path: str):
        super().__init__(path)
        self.closes = self.marked(lambda token: token.endswith("</w>"))
        self.memo[""] = b""

    def single(self, word: str) -> bool:
        """Some letters come apart into a letter and a mark when they are composed or lowered."""
        return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())

    def letters(self, words: list[str]) -> list[bytes]:
        out: dict[str, bytes] = {}
        small = [w for w in words if w.isascii() and w.islower()]
        known = set(small)
        for tokenizer, part in ((self.model, small), (self.tokenizer, [w for w in words if w not in known])):
            if part:
                found = self.cut(tokenizer, [" ".join(part[at : at + TOGETHER]) for at in range(0, len(part), TOGETHER)], self.closes, True, len(part))
                out.update(zip(part, self.whole(part) if found is None else found, strict=True))
        return [out[w] for w in words]

    def others(self, words: list[str]) -> list[bytes | None]:
        return self.whole(words)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Lowering A-Z first makes fewer words; the tokenizer's special tokens, which hold '<|', are in lower case."""
        units = pc.ascii_split_whitespace(_strings([t if b"<|" in t else t.lower() for t in texts]))
        return self.gathered(units.flatten(), units.offsets.to_numpy()[1:] - units.offsets[0].as_py(), texts)


class SpacedWords(_WordIds):
    """For byte-level tokenizers that split before a space and around a line end.

    Where every white space is a single space or line end between other characters, no pre-token spans it: the ids are
    those of ' word' after ' word'. Other texts are given whole to the tokenizer. Units are words after a space, and words
    that begin a line, with the line end before them."""

    def __init__(self, path: str):
        super().__init__(path)
        letters = _byte_letters()
        self.table = letters | {ord(" "): letters[ord(" ")], ord("\n"): " "}
        self.opens = self.marked(lambda token: token.startswith(letters[ord(" ")]))
        self.newline = self.whole(["\n"])[0]
        self.memo[""] = self.memo["\n"] = None

    def letters(self, words: list[str]) -> list[bytes]:
        texts = ["".join([f"\n {w}" for w in words[at : at + TOGETHER]]).encode().decode("latin-1").translate(self.table) for at in range(0, len(words), TOGETHER)]
        found = self.cut(self.model, texts, self.opens, False, len(words))
        return self.whole([f" {w}" for w in words]) if found is None else found

    def others(self, words: list[str]) -> list[bytes | None]:
        out: dict[str, bytes | None] = {w: None for w in words if _ODD_SPACE.search(w, 1 if w[0] == "\n" else 0)}
        for before, begin in ((b"", False), (self.newline, True)):
            part = [w for w in words if w not in out and (w[0] == "\n") == begin]
            out.update(zip(part, (before + x for x in self.whole([w[1:] if begin else f" {w}" for w in part])), strict=True))
        return [out[w] for w in words]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        units = pc.split_pattern(pc.replace_substring(_strings(texts), "\n", " \n"), " ")
        edges = units.offsets.to_numpy() - units.offsets[0].as_py()
        flat = units.flatten()
        begin = flat.take(pa.array(edges[:-1])).to_pylist()
        # a text's first word, without a space before it; none where the text begins with white space
        odd = [bool(_ODD_SPACE.search(x)) for x in begin]
        own = iter(self.whole([x for x, o in zip(begin, odd, strict=True) if not o]))
        first = [None if o else next(own) for o in odd]
        return self.gathered(flat, edges[1:], texts, (edges[:-1], first))


_KNOWN: dict[tuple[type, str], _WordIds] = {}


def word_ids(kind: type, path: str) -> _WordIds:
    """One of a kind for each worker and file."""
    if (kind, path) not in _KNOWN:
        _KNOWN[kind, path] = kind(path)
    return _KNOWN[kind, path]
