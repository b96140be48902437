"""What both tokenizers share: pieces of plain texts, and results that a worker remembers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Hashable

#: Texts of characters below are plain: every version of Unicode agrees on which of them are letters and digits, and their lower case stays among them.
PLAIN = 0x180
#: Longer pieces are not remembered, so that what is remembered is bounded in bytes.
LONGEST = 64
_plain_text = re.compile(f"[\\x00-\\u{PLAIN - 1:04x}]*").fullmatch


def is_plain(text: str) -> bool:
    """Plain, and without what could be a special token."""
    return _plain_text(text) is not None and "<|" not in text


def _ranges(kind: str) -> str:
    return "".join(f"\\u{c:04x}" for c in range(PLAIN) if unicodedata.category(chr(c)).startswith(kind))


def plain_pattern(pattern: str) -> Callable[[str], list[str]]:
    """A tokenizer's pattern as a function from a plain text to its pieces; classes are spelled out within the plain range."""
    letters, digits, space = _ranges("L"), _ranges("N"), r"\t-\r \x85\xa0"
    spelled = pattern.replace(r"(?!\S)", f"(?![^{space}])")
    # Inside a class a name becomes its members; alone it becomes a class.
    spelled = re.sub(r"\[[^\]]*\]|\\[pP]\{[LN]\}|\\s", lambda m: m[0] if m[0].startswith("[") else f"[{m[0]}]", spelled)
    for name, members in ((r"\p{L}", letters), (r"\p{N}", digits), (r"\s", space)):
        spelled = spelled.replace(name, members)
    return re.compile(spelled).findall


class Remembered(dict):
    """Values by key, made when first asked for. Of two generations the older goes when the newer is full; one in use passes on."""

    def __init__(self, make: Callable[[str], Hashable], most: int) -> None:
        super().__init__()
        self.make, self.most = make, most
        self.before: dict = {}

    def __missing__(self, key: str):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.most:
            self.before = dict(self)
            self.clear()

    def rest(self) -> None:
        """Between tasks only the newer generation stays in memory."""
        self.before = {}
