"""Loading the public tokenizers and encoding texts through a bounded cache of pieces.

Both byte-pair vocabularies treat a text as a row of pieces that are encoded on their own, so a
text's ids are the ids of its pieces end to end, and a piece that came before need not be
encoded again. The cache is an exact memo, emptied when it holds ``CACHE_ENTRIES`` pieces.
"""

from __future__ import annotations

import functools
import re

from tokenizers import Tokenizer

#: Pieces kept per worker process (about 200 bytes each).
CACHE_ENTRIES = 600_000
#: Longer pieces are encoded, but not kept.
CACHE_CHARS = 64


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def load(name: str) -> Tokenizer:
    """The tokenizer of a vocabulary (a file's path, or a name of the installed collection)."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(name if "/" in name else vocabulary(name))


#: White space, in the widest sense, right before a space: no piece may begin at that space.
_GLUED = re.compile(r"\s ")


def spaced_pieces(text: str) -> list[str]:
    """The text cut at every space that follows a non-space character; each piece but the first
    is given without the space it begins with.

    Pre-tokenizers that attach one space to the next word never join text across such a cut:
    white space before a space keeps the two together, as runs of white space are cut by what
    follows them.
    """
    parts = text.split(" ")
    if text[:1] != " " and not _GLUED.search(text):
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        if out[-1] and not out[-1][-1].isspace():
            out.append(p)
        elif not out[-1] and len(out) > 1:  # a piece that is its own space only
            out[-1] = " " + p
        else:
            out[-1] += " " + p
    return out


class Memo(dict):
    """A bounded exact memo of a function of short strings."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, key: str):
        value = self.function(key)
        self.put(key, value)
        return value

    def put(self, key: str, value) -> None:
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[key] = value
