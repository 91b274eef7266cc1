"""Pre-tokens of whole texts for the byte-level pattern, found in numpy.

The pattern's alternatives depend on four character classes only (letter,
number, white space, other), so token ends are found for a block of texts at
once from the class of each code point. Any other pattern goes through
``regex`` as it stands.
"""

from __future__ import annotations

import numpy as np

#: Fixed value: the pattern whose splits are computed in numpy.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE, BORDER = range(5)
#: Between two texts of a block; a lone surrogate can't occur in a text.
_BETWEEN = "\ud800"


def character_classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    out[ord(_BETWEEN)] = BORDER
    return out


class Cutter:
    def __init__(self, pattern: str, classes: np.ndarray | None = None):
        self.find = None
        if pattern != BYTE_LEVEL_PATTERN:
            import regex

            self.find = regex.compile(pattern).findall
        else:
            self.classes = character_classes() if classes is None else classes

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of all texts in a row, and where each text's begin (one more than texts)."""
        if self.find:
            each = [self.find(t) for t in texts]
            return [t for ts in each for t in ts], np.concatenate([[0], np.cumsum([len(ts) for ts in each])]).astype(np.int64)
        text = _BETWEEN.join([*texts, ""])          # a border after every text
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(code):
            return [], np.zeros(1, np.int64)
        kind = self.classes[code]
        start = np.empty(len(code), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == BORDER
        # A run of blanks gives its last one to what follows, joined to it if it is U+0020.
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != BORDER))
        start[last] = True
        joined = last[code[last] == 0x20]
        start[joined + 1] = False
        # A lone apostrophe that begins a token takes one of the fixed endings with it.
        quote = np.flatnonzero(start & (code == 0x27))
        quote = quote[kind[np.minimum(quote + 1, len(code) - 1)] == LETTER]
        if len(quote):
            a, b = code[quote + 1], code[np.minimum(quote + 2, len(code) - 1)]
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            n = np.where(np.isin(a, [ord(c) for c in "stmd"]), 2, np.where(two, 3, 0))
            quote, n = quote[n > 0], n[n > 0]
            start[quote + 1] = False
            start[quote + n] = True                 # the border at the end is a start already
        at = np.flatnonzero(start)
        border = kind[at] == BORDER
        ends = np.append(at[1:], len(code))[~border].tolist()
        tokens = [text[i:j] for i, j in zip(at[~border].tolist(), ends, strict=True)]
        counts = np.diff(np.concatenate([[-1], np.flatnonzero(border)])) - 1
        return tokens, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
