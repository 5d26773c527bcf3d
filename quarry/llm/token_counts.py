"""Token counts that follow edits.

A document is cut into leaves of about LEAF characters, each between two pre-tokens: after a letter, before anything that
isn't one; after a number likewise; or between a symbol and a number, space or line break. There every text splits,
whatever surrounds it, so leaf counts add up, and a segment tree over the leaves holds the sums of characters and
tokens. An edit changes the leaves it touches; where an end of the changed part is no longer such a place, the
neighbour joins it. The changed part is cut into leaves anew, only these are encoded again, and their sums go up the
tree; where there are more of them than before, the tree gets new slots and keeps the counts of all other leaves. A
leaf is longer than LEAF only where one pre-token is: that must be encoded as a whole.

Null and empty texts have no tokens. Edits are (start, stop, replacement) in characters of the text as it is at that
moment, applied one after the other; equal starts are fine, and an edit beyond the end appends. Rows are independent,
and rows that repeat are counted each.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarry.llm.model_text import texts
from quarry.llm.packing import default_paths, encode, encoders

LEAF = 1024
#: What the query edits, in this order: e-mail addresses, then digit runs of five or more outside of them, are masked.
MASKS = ((regex.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), "EMAIL"), (regex.compile(r"[0-9]{5,}"), "00000"))


def _kind(c: str) -> str:
    if c in " \n\r\t":
        return "blank"
    group = unicodedata.category(c)[0]
    return {"L": "letter", "N": "number"}.get(group, "other" if group in "ZC" else "symbol")


def _splits(a: str, b: str) -> bool:
    """Whether every text splits between its parts that end in a and begin with b (two characters or more, if there are)."""
    x, y = _kind(a[-1]), _kind(b[0])
    if b.startswith("|>"):  # the end of a special token
        return False
    return x in ("letter", "number") and y != x or x == "symbol" and y in ("number", "blank")


def leaves(text: str, size: int = LEAF) -> list[str]:
    out, at = [], 0
    while at < len(text):
        i = at + size
        while i < len(text) and not _splits(text[i - 1], text[i : i + 2]):
            i += 1
        out.append(text[at:i])
        at = i
    return out


class TokenTree:
    """Sums of characters and tokens over the leaves of one text."""

    def __init__(self, text: str, count: Callable[[str], int], size: int = LEAF):
        self.count, self.size, self.encoded = count, size, 0
        parts = leaves(text, size) or [""]
        self._build(parts, [count(x) for x in parts])

    def _build(self, parts: list[str], tokens: list[int]) -> None:
        self.leaf = parts
        self.base = 1 << (len(parts) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        self.chars[self.base : self.base + len(parts)] = map(len, parts)
        self.tokens[self.base : self.base + len(parts)] = tokens
        for i in range(self.base - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _put(self, k: int, text: str, tokens: int) -> None:
        """Leaf k gets a text, and the sums above follow."""
        self.leaf[k] = text
        i = self.base + k
        self.chars[i], self.tokens[i] = len(text), tokens
        while i := i // 2:
            self._sum(i)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and where in it."""
        i = 1
        while i < self.base:
            i *= 2
            if at >= self.chars[i] and self.chars[i + 1]:
                at -= self.chars[i]
                i += 1
        return i - self.base, min(at, self.chars[i])

    def _next(self, k: int, step: int) -> int | None:
        k += step
        while 0 <= k < len(self.leaf):
            if self.leaf[k]:
                return k
            k += step
        return None

    def edit(self, start: int, stop: int, replacement: str) -> None:
        first, a = self.find(start)
        last, b = self.find(max(start, stop - 1))
        b = min(len(self.leaf[last]), b + (stop > start))
        changed = self.leaf[first][:a] + replacement + self.leaf[last][b:]
        while (k := self._next(first, -1)) is not None and not (changed and _splits(self.leaf[k], changed)):
            changed, first = self.leaf[k] + changed, k
        while (k := self._next(last, 1)) is not None and not (changed and _splits(changed, self.leaf[k])):
            changed, last = changed + self.leaf[k], k
        parts = leaves(changed, self.size)
        tokens = [self.count(x) for x in parts]
        self.encoded += len(changed)
        if len(parts) > last - first + 1:
            held = [(x, self.tokens[self.base + i]) for i, x in enumerate(self.leaf) if x and not first <= i <= last]
            before = sum(1 for x in self.leaf[:first] if x)
            held[before:before] = zip(parts, tokens)
            self._build([x for x, _ in held], [n for _, n in held])
            return
        for i in range(first, last + 1):
            part, n = (parts[i - first], tokens[i - first]) if i - first < len(parts) else ("", 0)
            if part or self.leaf[i]:
                self._put(i, part, n)

    @property
    def total(self) -> int:
        return self.tokens[1]


def masks(text: str) -> list[tuple[int, int, str]]:
    """The edits of MASKS, last first, so that no edit moves another; what overlaps an earlier pattern's match is left."""
    taken: list[tuple[int, int, str]] = []
    for pattern, new in MASKS:
        before = [a for a, _, _ in taken]
        found = []
        for m in pattern.finditer(text):
            k = bisect_left(before, m.end()) - 1
            if k < 0 or taken[k][1] <= m.start():
                found.append((m.start(), m.end(), new))
        taken = sorted(taken + found)
    return taken[::-1]


def counts(docs: DataFrame, edits: Callable[[str], list[tuple[int, int, str]]] = masks, paths: tuple[str, str | None] | None = None) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited and n_chars_encoded (again, because of the edits) for every row."""
    json_path, ranks_path = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slow, fast = encoders(json_path, ranks_path)
        for batch, own in texts(batches):
            rows = []
            for text in own:
                tree = TokenTree(text, lambda t: len(encode(t, slow, fast)))
                before, changes = tree.total, edits(text)
                for change in changes:
                    tree.edit(*change)
                rows.append((before, len(changes), tree.total, tree.encoded))
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *cols], names=["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_encoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_encoded long")
