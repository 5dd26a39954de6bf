"""Token ids by a public tokenizer, the same as encoding each whole text, at several times the speed.

The vocabulary drops white space and lower-cases, and its pre-tokens never cross
white space, so a text's ids are those of its space-separated words in order.
Ids of words seen are kept: ``CACHE`` words, and as many from before that, which
move over when met again. Words of more than ``LONGEST`` letters are encoded each
time, so the tables are bounded in bytes too.
A word of plain Latin letters with closing marks is put together from its
lower-cased letters and the marks, which the tokenizer also treats apart; a text
of nothing else is lower-cased and taken apart as a whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

CACHE, LONGEST, RUN = 250_000, 64, 256
#: Latin letters that NFC leaves alone and whose lower case is one letter, then ASCII marks but for the apostrophe.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: What a simple text consists of, in Latin-1: those letters, full stops, commas and plain white space.
_SIMPLE = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100), *b" \t\n\r\x0b\x0c.,"])
_MARKS = (b"..", b",,", b".,", b",.")
#: Spaces to the tokenizer's regex; str.split() has four control characters more.
_CONTROLS = re.compile("[\x1c-\x1f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=1)
def word_ids(path: str | None = None) -> WordIds:
    """The worker process's own encoder: Spark reuses workers, so later tasks find its table filled."""
    return WordIds(path)


class WordIds:
    """Little-endian unsigned 32-bit ids of texts, as bytes."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # Lower-cased plain letters are one pre-token, so the model alone gives their ids.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = [i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[ends] = True
        self.seen: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.seen[w] = array("I", e.ids).tobytes()

    def _encode_letters(self, words: list[str]) -> None:
        """Plain words, many in one text; the last id of a word is one that ends words."""
        seen = self.seen
        parts = [words[i : i + RUN] for i in range(0, len(words), RUN)]
        for part, e in zip(parts, self.letters.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            raw = ids.tobytes()
            at = 0
            for w, to in zip(part, ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), strict=True):
                seen[w] = raw[at:to]
                at = to

    def _learn(self, new: Iterable[str]) -> None:
        seen = self.seen
        whole, letters, composed = [], set(), []
        for w in new:
            m = _PLAIN.fullmatch(w)
            if m is None:
                whole.append(w)
                continue
            core, mark = m[1].lower(), m[2]
            if core not in seen:
                letters.add(core)
            if mark and mark not in seen:
                whole.append(mark)
            if mark or core != w:
                composed.append((w, core, mark))
        self._encode(whole)
        self._encode_letters(list(letters))
        for w, core, mark in composed:
            seen[w] = seen[core] + seen[mark] if mark else seen[core]

    @staticmethod
    def _simple(text: str) -> bool:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not raw.translate(None, _SIMPLE) and not any(m in raw for m in _MARKS)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = []
        for t in texts:
            if not t:
                split.append([])
            elif self._simple(t):
                split.append(t.lower().replace(".", " . ").replace(",", " , ").split())
            elif _CONTROLS.search(t):
                split.append(re.split(r"[^\S\x1c-\x1f]+", t))
            else:
                split.append(t.split())
        here = set().union(*split)
        new = here.difference(self.seen)
        if len(self.seen) + len(new) > CACHE:
            self.before, self.seen = self.seen, {}
            new = here
        known = new.intersection(self.before)
        self.seen.update((w, self.before[w]) for w in known)
        self._learn(new.difference(known))
        # a table of this call's words is small enough to stay in the processor's cache
        get = dict(zip(here, map(self.seen.__getitem__, here), strict=True)).__getitem__
        for w in [w for w in new if len(w) > LONGEST]:
            m = _PLAIN.fullmatch(w)
            for x in (w, m[1].lower(), m[2]) if m else (w,):
                self.seen.pop(x, None)
        return [b"".join(map(get, ws)) for ws in split]
