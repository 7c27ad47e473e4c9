"""Token ids by a public tokenizer, memoised by white-space-separated piece."""

from __future__ import annotations

import os
from itertools import pairwise
from operator import itemgetter

import numpy as np
import public_tokenizers

from tidewater.llm.common import kept

TOKENIZER = "word_bpe_49k.json"
#: Pieces in each of the memo's two generations; a bound on memory, without effect on results.
GENERATION = 450_000
#: Words in one text that is encoded for the memo.
JOINED = 50


class TokenBytes:
    """Texts to ids as little-endian 32-bit integers.

    The tokenizer drops white space, and no token, composition or lower-casing reaches over ASCII white space, so the
    ids of a text are those of its pieces in order. A piece of letters and one final point or comma has the letters'
    ids and that mark's. Unknown words of letters are encoded many at once: each is one run of letters to the
    tokenizer, so it ends where a token does that ends a word.
    """

    def __init__(self, file: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file if os.path.isabs(file) else public_tokenizers.path(file))
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.now: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.marks = {m: self._ids([m.decode()])[0] for m in (b".", b",")}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, pieces: set[bytes]) -> None:
        now, old = self.now, self.old
        if len(now) >= GENERATION:
            self.old, self.now = now, {}
            now, old = self.now, self.old
        if old:
            found = pieces & old.keys()
            now.update(zip(found, map(old.__getitem__, found), strict=True))
            pieces = pieces - found
        words = [p for p in pieces if p.isalpha() and p.islower()]  # ASCII letters
        now.update(dict.fromkeys(words, b""))
        rest = list(pieces.difference(words))
        strings = b" ".join(rest).decode("utf-8", "replace").split(" ") if rest else []
        if len(strings) != len(rest):
            raise RuntimeError("a piece holds a space")
        split, other, marks = [], [], self.marks
        for p, s in zip(rest, strings, strict=True):
            if s.isalpha() and s.lower().isalpha():
                if p not in now:
                    now[p] = b""
                    words.append(p)
            elif p[-1:] in marks and (s := s[:-1]).isalpha() and s.lower().isalpha():
                split.append((p, low := p[:-1], p[-1:]))
                if low not in now:
                    if (known := old.get(low)) is not None:
                        now[low] = known
                    else:
                        now[low] = b""
                        words.append(low)
            else:
                other.append(p)
        for p, b in zip(other, self._ids([p.decode("utf-8", "replace") for p in other]), strict=True):
            now[p] = b
        for i in range(0, len(words), JOINED * 200):
            some = words[i : i + JOINED * 200]
            got = self._ids([b" ".join(some[j : j + JOINED]).decode() for j in range(0, len(some), JOINED)])
            joined = b"".join(got)
            at = [0, *((np.flatnonzero(self.ends[np.frombuffer(joined, "<u4")]) + 1) * 4).tolist()]
            if len(at) != len(some) + 1:
                raise RuntimeError("a word's ids don't end with the word")
            now.update(zip(some, [joined[a:z] for a, z in pairwise(at)], strict=True))
        for p, low, mark in split:
            now[p] = now[low] + marks[mark]

    def of(self, texts: list[bytes], end: int) -> list[bytes]:
        """The ids of each whole text and one end id."""
        # Lower case of ASCII first, where no combining mark and no special token depends on it.
        pieces = [(t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower()).split() for t in texts]
        missing = set().union(*pieces).difference(self.now)
        if missing:
            if len(self.now) >= GENERATION:
                missing = set().union(*pieces)
            self._add(missing)
        now, last = self.now, end.to_bytes(4, "little")
        return [(b"".join(itemgetter(*p)(now)) if len(p) > 1 else b"".join(now[x] for x in p)) + last for p in pieces]


def token_bytes(file: str = TOKENIZER) -> TokenBytes:
    """The process's own TokenBytes: its memo serves all tasks of a worker."""
    return kept(f"tokens {file}", lambda: TokenBytes(file))
