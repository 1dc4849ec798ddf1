"""Words from the vocabulary files of public tokenizers: ordinary words, and the dictionary of spaceless scripts."""

from __future__ import annotations

import base64
import math
import os
import re
from functools import lru_cache

#: Folder with the vocabulary files, and those that are read.
TOKENIZERS = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")

_SPACELESS = re.compile(r" ?([぀-ヿ㐀-䶿一-鿿豈-﫿]+|[฀-๿]+)")


def _tokens(tokenizers: str, name: str):
    with open(os.path.join(tokenizers, name), "rb") as f:
        for line in f:
            yield base64.b64decode(line.split(b" ", 1)[0])


@lru_cache(maxsize=None)
def ordinary_words(tokenizers: str = TOKENIZERS) -> frozenset[str]:
    """Words in small letters that the vocabularies hold whole, with a blank before."""
    out: set[str] = set()
    for name in VOCABULARIES:
        for t in _tokens(tokenizers, name):
            if t[:1] == b" " and len(t) > 3:
                w = t[1:].decode(errors="replace")
                if w.isalpha() and w.islower():
                    out.add(w)
    return frozenset(out)


class Lattice:
    """Words of spaceless text: the cheapest path through the lattice of dictionary words and single characters. A
    word costs the logarithm of its rank in the vocabulary, which lists frequent words first; a character that is no
    word costs more than any word. A run of katakana, or of up to four Chinese characters between others, may also be
    one unknown word."""

    RANK, UNKNOWN = 40, math.log(1 << 19)
    _GROUP = re.compile(r"[ァ-ヺー]{2,}|(?<![㐀-䶿一-鿿])[㐀-䶿一-鿿]{2,4}(?![㐀-䶿一-鿿])")

    def __init__(self, words: dict[str, float]) -> None:
        self.cost = words
        self.most: dict[str, int] = {}
        for w in words:
            self.most[w[0]] = max(self.most.get(w[0], 1), len(w))

    def words(self, text: str) -> list[str]:
        n = len(text)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        get, most, unknown = self.cost.get, self.most.get, self.UNKNOWN
        groups = dict(m.span() for m in self._GROUP.finditer(text))
        for i in range(n):
            here = best[i]
            if (j := groups.get(i)) is not None and here + unknown + j - i < best[j]:
                best[j], back[j] = here + unknown + j - i, i
            for j in range(i + 1, min(n, i + most(text[i], 1)) + 1):
                c = get(text[i:j])
                if c is None:
                    if j > i + 1:
                        continue
                    c = unknown
                if here + c < best[j]:
                    best[j], back[j] = here + c, i
        out, at = [], n
        while at:
            out.append(text[back[at] : at])
            at = back[at]
        return out[::-1]


@lru_cache(maxsize=None)
def lattice(also: tuple[str, ...] = (), tokenizers: str = TOKENIZERS) -> Lattice:
    """The lattice of the Chinese, Japanese and Thai words of the vocabularies and those of also, which count as frequent."""
    cost: dict[str, float] = {}
    for name in VOCABULARIES:
        for rank, t in enumerate(_tokens(tokenizers, name)):
            m = _SPACELESS.fullmatch(t.decode(errors="replace"))
            if m:
                cost[m.group(1)] = min(math.log(rank + Lattice.RANK), cost.get(m.group(1), math.inf))
    for w in also:
        cost[w] = min(math.log(Lattice.RANK), cost.get(w, math.inf))
    return Lattice(cost)
