"""Edit-aware token counts: a segment tree per document over its pre-tokens.

A leaf is a block of whole words with its token count; inner nodes hold sums.
An edit replaces a range of characters.  Only the blocks it touches, and the
words at their borders that it may join or cut, are encoded again; sums change
along one path each, so a count after an edit costs the edited region and the
logarithm of the number of blocks, not the text.  The leaves' sizes and counts
can be stored and a tree made from them again without encoding anything.
"""

from __future__ import annotations

import numpy as np

from tallyrook.llm.wordids import ChunkEncoder

#: Characters per leaf, about.
LEAF_CHARS = 512


class CountTree:
    """Counts of a text that changes.  Blocks end after a space or line feed,
    where the vocabulary never joins tokens."""

    def __init__(self, text: str, encoder: ChunkEncoder | None = None, leaves: tuple[list[int], list[int]] | None = None):
        """leaves: characters and tokens of each block, as stored before."""
        self.encoder = encoder
        self.encoded_chars = 0
        if leaves is None:
            blocks = cut(text)
            self._build(blocks, self._count(blocks))
        else:
            ends = np.cumsum(leaves[0]).tolist()
            self._build([text[e - n : e] for e, n in zip(ends, leaves[0], strict=True)] or [""], leaves[1] or [0])

    def _build(self, blocks: list[str], counts: list[int]) -> None:
        self.blocks = blocks
        self.width = 1 << max(0, (len(blocks) - 1).bit_length())
        self.tokens, self.chars = np.zeros(2 * self.width, np.int64), np.zeros(2 * self.width, np.int64)
        self.tokens[self.width : self.width + len(blocks)] = counts
        self.chars[self.width : self.width + len(blocks)] = [len(b) for b in blocks]
        for level in (self.tokens, self.chars):
            at = self.width
            while at > 1:
                level[at // 2 : at] = level[at : 2 * at : 2] + level[at + 1 : 2 * at : 2]
                at //= 2

    def _count(self, blocks: list[str]) -> list[int]:
        self.encoded_chars += sum(map(len, blocks))
        return self.encoder.counts(blocks)

    @property
    def leaves(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of each block."""
        at = slice(self.width, self.width + len(self.blocks))
        return self.chars[at].tolist(), self.tokens[at].tolist()

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    @property
    def text(self) -> str:
        return "".join(self.blocks)

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds character `at`, and the characters before it."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if at >= before + self.chars[node] and node + 1 < 2 * self.width and self.chars[node + 1] > 0:
                before += int(self.chars[node])
                node += 1
        return min(node - self.width, len(self.blocks) - 1), before

    def _set(self, leaf: int, block: str, count: int) -> None:
        self.blocks[leaf] = block
        node = leaf + self.width
        more, longer = count - self.tokens[node], len(block) - self.chars[node]
        while node:
            self.tokens[node] += more
            self.chars[node] += longer
            node //= 2

    def region(self, start: int, end: int, new: str) -> tuple[int, int, list[str]]:
        """First and last block that replacing characters start..end touches,
        and the blocks that come in their place."""
        start, end = max(0, min(start, self.length)), max(0, min(end, self.length))
        end = max(start, end)
        first, before = self._find(start)
        last, last_before = self._find(max(start, end - 1)) if end > start else (first, before)
        joined = self.blocks[first][: start - before] + new + self.blocks[last][end - last_before :]
        # the edit may have removed the white space at the end of the region: take the next block in
        while last + 1 < len(self.blocks) and joined and joined[-1] not in " \n":
            last += 1
            joined += self.blocks[last]
        while first > 0 and self.blocks[first - 1] and self.blocks[first - 1][-1] not in " \n":
            first -= 1
            joined = self.blocks[first] + joined
        parts = cut(joined)
        room = last - first + 1
        if room < len(parts) <= 2 * room + 2:
            parts = parts[: room - 1] + ["".join(parts[room - 1 :])]
        return first, last, parts + [""] * (room - len(parts))

    def put(self, region: tuple[int, int, list[str]], counts: list[int]) -> int:
        """Put a region's blocks, with their counts, in place; the total."""
        first, last, parts = region
        self.encoded_chars += sum(map(len, parts))
        if len(parts) > last - first + 1:
            tokens = self.leaves[1]
            self._build(self.blocks[:first] + parts + self.blocks[last + 1 :], tokens[:first] + counts + tokens[last + 1 :])
        else:
            for k, (b, n) in enumerate(zip(parts, counts, strict=True)):
                self._set(first + k, b, n)
        return self.total

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters start..end by `new`; the total afterwards."""
        region = self.region(start, end, new)
        return self.put(region, self.encoder.counts(region[2]))


def cut(text: str) -> list[str]:
    """Blocks of about LEAF_CHARS, each ending after a space or line feed."""
    out, at = [], 0
    while at < len(text):
        stop = at + LEAF_CHARS
        if stop < len(text):
            cuts = [p for p in (text.find(" ", stop), text.find("\n", stop)) if p >= 0]
            stop = min(cuts) + 1 if cuts else len(text)
        out.append(text[at:stop])
        at = stop
    return out or [""]
