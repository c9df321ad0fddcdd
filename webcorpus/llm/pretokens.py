"""Cut texts into the pre-tokens of the byte-level vocabulary, a whole batch at a time.

The rule is that of the vocabulary file's ByteLevel step: contractions, then runs of letters, numbers
and other signs with at most one space before them, then white space. It is evaluated on arrays of code
points: a run of one class is a pre-token, corrected at spaces and apostrophes.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import regex

from webcorpus.llm.hashing import Spans, mix

SPACE, LETTER, NUMBER, OTHER, SPECIAL = range(5)
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@cache
def _classes() -> np.ndarray:
    # Interpreter and regex module know different versions of the character tables. Where they
    # disagree, the tokenizers library itself says whether a character goes on a run.
    from tokenizers import pre_tokenizers

    older = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, runs in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for run in regex.finditer(runs, every):
            table[run.start():run.end()] = kind
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for code in np.flatnonzero(table != older).tolist():
        goes_on = (kind for kind, run in ((LETTER, "a"), (NUMBER, "1")) if len(cut(run + chr(code))) == 1)
        table[code] = next(goes_on, OTHER)
    table[list(WHITE)] = SPACE
    return table


def pretokens(texts: list[str], special: str | None) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pre-tokens in order: the joined text, starts, ends, hashes, whether special, and the first of each text.

    ``special`` is a string that is one token of its own wherever it stands. The last array has one
    entry more than there are texts.
    """
    pieces, owners, marks = texts, None, []
    if special and any(special in t for t in texts):
        pieces, owners = [], []
        for k, text in enumerate(texts):
            for j, part in enumerate(text.split(special)):
                if j:
                    marks.append(len(pieces))
                    pieces.append(special)
                    owners.append(k)
                pieces.append(part)
                owners.append(k)
    joined = "".join(pieces)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(codes)
    bounds = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)), out=bounds[1:])
    kinds = _classes()[codes]
    for k in marks:
        kinds[bounds[k]:bounds[k + 1]] = SPECIAL
    first = np.zeros(n + 1, bool)  # a piece starts here
    first[bounds] = True
    starts = first.copy()
    if n:
        starts[1:n] |= kinds[1:] != kinds[:-1]
        inner = np.flatnonzero(~first[1:n])  # positions whose successor is of the same piece
        ends_white = inner[(kinds[inner] == SPACE) & (kinds[inner + 1] != SPACE)]
        starts[ends_white] = True
        joins = ends_white[codes[ends_white] == 32]
        starts[joins + 1] = False
        quotes = np.flatnonzero((codes == 39) & starts[:n])
        quotes = quotes[quotes + 1 < n]
        quotes = quotes[~first[quotes + 1] & (kinds[quotes + 1] == LETTER)]
        if len(quotes):
            one = codes[quotes + 1]
            two = np.where(first[quotes + 2], 0, codes[np.minimum(quotes + 2, n - 1)])
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for which, size in ((quotes[short], 2), (quotes[long], 3)):
                starts[which + 1] = False
                starts[which + size] = True
    at = np.flatnonzero(starts[:n])
    to = np.append(at[1:], n) if n else at
    hashes = Spans(mix(codes))(at, to)
    is_special = kinds[at] == SPECIAL if n else np.zeros(0, bool)
    counts_from = np.searchsorted(at, bounds)
    if owners is None:
        firsts = counts_from
    else:
        firsts = np.append(counts_from[np.searchsorted(np.array(owners), np.arange(len(texts)))], len(at))
    return joined, at, to, hashes, is_special, firsts
