"""Token ids of whole texts, piece by piece with a memo.

The vocabulary's pre-tokens never reach over white space, a run of letters always stands apart
from what is around it, and the normaliser works character by character.  So the ids of a text are
those of its runs in a row.  Each run is encoded once per worker; the ids of a text are then joined
from bytes that are already there.  Texts in which that might not hold go another way:

* with an apostrophe (contractions reach over it) or ``<|`` (special tokens): by words between white
  space;
* with a character beyond Latin letters next to other signs: by the tokenizer as they are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

from timeloom.llm.common import MEMO_WORDS

#: Letters below this code point lower and split alike in every Unicode version.
SETTLED = "ɐ"
RUNS = re.compile(rb"[a-z\x80-\xff]+|[^a-z\x80-\xff\x20\x09-\x0d]+")
#: Runs of letters that are encoded in one call.
TOGETHER = 100


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _letters(run: bytes) -> bool:
    if run.isalpha():
        return True
    text = run.decode()
    return text.isalpha() and max(text) < SETTLED


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int = 3 * MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.runs: dict[bytes, bytes | None] = {}
        self.words: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts],
                                                 add_special_tokens=False)
        return [np.array(code.ids, "<u4") for code in found]

    def _learn(self, new: Iterable[bytes]) -> None:
        """Encode runs; an id that closes a word tells where the next run of letters begins."""
        letters, signs = [], []
        for run in new:
            if run[0] < 0x80 and not run[:1].isalpha():
                signs.append(run)
            elif _letters(run):
                letters.append(run)
            else:
                self.runs[run] = None
        chunks = [letters[i:i + TOGETHER] for i in range(0, len(letters), TOGETHER)]
        for chunk, ids in zip(chunks, self._encode([b" ".join(c) for c in chunks]), strict=True):
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()
            if len(ends) != len(chunk):
                signs.extend(chunk)
                continue
            raw, at = ids.tobytes(), 0
            for run, end in zip(chunk, ends, strict=True):
                self.runs[run] = raw[at:end]
                at = end
        for run, ids in zip(signs, self._encode(signs), strict=True):
            self.runs[run] = ids.tobytes()

    def _by_words(self, text: bytes) -> bytes:
        words, memo = text.split(), self.words
        if len(memo) > self.most // 4:
            memo.clear()
        new = list({w for w in words if w not in memo})
        for word, ids in zip(new, self._encode(new), strict=True):
            memo[word] = ids.tobytes()
        return b"".join(map(memo.__getitem__, words))

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if len(self.runs) > self.most:
            self.runs.clear()
        cut: list[list[bytes] | None] = [
            None if b"'" in t or b"<|" in t else RUNS.findall(t.lower()) for t in texts
        ]
        seen: set[bytes] = set()
        for runs in cut:
            if runs:
                seen.update(runs)
        memo = self.runs
        self._learn([r for r in seen if r not in memo])
        out = []
        for text, runs in zip(texts, cut, strict=True):
            if runs is None:
                out.append(self._by_words(text))
                continue
            try:
                out.append(b"".join(map(memo.__getitem__, runs)))
            except TypeError:
                out.append(self._encode([text])[0].tobytes())
        return out


def in_portions(texts: Iterable[bytes], most_bytes: int = 1 << 21) -> Iterable[list[bytes]]:
    """Lists of texts of bounded size in all; a longer text stands alone."""
    portion: list[bytes] = []
    size = 0
    for text in texts:
        if portion and size + len(text) > most_bytes:
            yield portion
            portion, size = [], 0
        portion.append(text)
        size += len(text)
    if portion:
        yield portion


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One per Python worker."""
    return WordEncoder(path)
