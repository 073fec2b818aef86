"""Byte-level pre-tokens: the split pattern with explicit character classes, and a cache of their ids."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

#: Bytes of the pre-tokens and ids that a worker remembers, about; beyond that it forgets all and starts again. What one
#: entry takes besides its characters, and characters of the longest pre-token that is remembered.
CACHED_BYTES, ENTRY_BYTES, LONGEST = 96 << 20, 200, 128
#: Characters of a text that is split as one list, and pre-tokens of a part of a longer one.
WHOLE_CHARS, PART_TOKENS = 1 << 20, 1 << 16


def ranges(points: Iterable[int]) -> str:
    """The inside of a character class that holds just these code points."""
    out, points = [], sorted(points)
    start = last = None
    for point in [*points, None]:
        if point is not None and last is not None and point == last + 1:
            last = point
            continue
        if start is not None:
            out.append(f"\\U{start:08x}" + (f"-\\U{last:08x}" if last > start else ""))
        start = last = point
    return "".join(out)


def explicit(pattern: str, classes: dict[str, Iterable[int]]) -> str:
    """The pattern with classes such as \\p{L} spelled out as ranges; \\S becomes the rest of \\s."""
    spelled = {name: ranges(points) for name, points in classes.items()}
    out, at, inside = [], 0, False
    while at < len(pattern):
        name = next((n for n in (*spelled, "\\S") if pattern.startswith(n, at)), None)
        if name == "\\S":
            out.append(f"[^{spelled['\\s']}]")
        elif name:
            out.append(spelled[name] if inside else f"[{spelled[name]}]")
        else:
            name = pattern[at:at + 2] if pattern[at] == "\\" else pattern[at]
            inside = {"[": True, "]": False}.get(name, inside)
            out.append(name)
        at += len(name)
    return "".join(out)


class Splitter:
    """Pre-tokens of a text. Texts of Latin-1 characters take a pattern of those alone, which runs faster."""

    def __init__(self, narrow: str, wide: str):
        self.narrow, self.wide = re.compile(narrow), re.compile(wide)

    @staticmethod
    def is_narrow(text: str) -> bool:
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def parts(self, text: str) -> Iterator[list[str]]:
        pattern = self.narrow if self.is_narrow(text) else self.wide
        if len(text) <= WHOLE_CHARS:
            yield pattern.findall(text)
            return
        found = pattern.finditer(text)
        while part := [match[0] for match in islice(found, PART_TOKENS)]:
            yield part


def split_patterns(pattern: str, members: Callable[[str], set[int]]) -> tuple[str, str]:
    """Narrow and wide pattern, with the members of each class as the tokenizing library sees them."""
    classes = {name: members(name) for name in ("\\p{L}", "\\p{N}", "\\s")}
    latin = {name: {point for point in points if point < 256} for name, points in classes.items()}
    return explicit(pattern, latin), explicit(pattern, classes)


class IdCache:
    """Packed ids of pre-tokens; those not seen yet are encoded together."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.encode = encode
        self.known: dict[str, bytes] = {}
        self.held = 0

    def ids(self, tokens: list[str]) -> bytes:
        found = list(map(self.known.get, tokens))
        if None in found:
            fresh = list({token for token, ids in zip(tokens, found) if ids is None})
            encoded = dict(zip(fresh, self.encode(fresh)))
            found = [encoded[token] if ids is None else ids for token, ids in zip(tokens, found)]
            if self.held > CACHED_BYTES:
                self.known.clear()
                self.held = 0
            kept = {token: ids for token, ids in encoded.items() if len(token) <= LONGEST}
            self.held += ENTRY_BYTES * len(kept) + sum(map(len, kept)) + sum(map(len, kept.values()))
            self.known.update(kept)
        return b"".join(found)
