"""Reading of public tokenizer files, and byte-pair merging of one word."""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

#: White space as the tokenizers' patterns see it (fixed values).
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else
    the next free code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Token ids, strings and merge ranks of a tokenizers file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.ids.items()}
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.strings.update({i: s for s, i in self.special.items()})
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        letters = byte_letters()
        self.byte_ids = [self.ids.get(c) for c in letters]
        self.last_byte_ids = [self.ids.get(c + self.suffix) for c in letters]

    def first_ids(self, word: bytes) -> list[int]:
        ids = [self.byte_ids[b] for b in word]
        ids[-1] = self.last_byte_ids[word[-1]]
        return ids

    def encode_word(self, word: bytes) -> list[int]:
        return merge(self.first_ids(word), self.merges)


def merge(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Byte-pair merging: a priority queue of (rank, place, left, right) over a
    doubly linked list of symbols.  An entry whose symbols have since been
    merged is stale and is skipped when it comes up."""
    n = len(ids)
    if n < 2:
        return ids
    queue = []
    for i in range(n - 1):
        found = merges.get((ids[i], ids[i + 1]))
        if found is not None:
            queue.append((found[0], i, ids[i], ids[i + 1]))
    if not queue:
        return ids
    heapq.heapify(queue)
    symbol = list(ids)
    following = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while queue:
        _, i, left, right = heapq.heappop(queue)
        if symbol[i] != left:
            continue
        j = following[i]
        if j >= n or symbol[j] != right:
            continue
        new = merges[left, right][1]
        symbol[i] = new
        symbol[j] = -1
        k = following[i] = following[j]
        if k < n:
            before[k] = i
            found = merges.get((new, symbol[k]))
            if found is not None:
                heapq.heappush(queue, (found[0], i, new, symbol[k]))
        h = before[i]
        if h >= 0:
            found = merges.get((symbol[h], new))
            if found is not None:
                heapq.heappush(queue, (found[0], h, symbol[h], new))
    return [s for s in symbol if s != -1]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
