"""Pre-tokens of byte-level BPE texts, found for whole blocks of texts at once.

The splitting rule of the byte-level pre-tokenizer is applied to arrays of letter classes instead of
by a regular expression per text: runs of letters, of digits, of other signs and of white space; a
single space joins the run after it; the last white-space character before a run stands alone; the
contractions after an apostrophe are pieces of their own.  The special string ``<|endoftext|>`` is
one piece wherever it stands and ends the text before it.
"""

from __future__ import annotations

import numpy as np
import regex

from proxima.llm.common import U64, mix, process_cache, run_hashes

LETTER, DIGIT, SIGN, SPACE = 0, 1, 2, 3
SPECIAL = "<|endoftext|>"


def letter_classes() -> np.ndarray:
    """The class of every code point."""
    def build():
        every = "".join(map(chr, [c if not 0xD800 <= c < 0xE000 else 0xFFFD for c in range(0x110000)]))
        t = np.full(0x110000, SIGN, np.uint8)
        for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", SPACE)):
            for m in regex.finditer(pattern, every):
                t[m.start(): m.end()] = value
        return t
    return process_cache("letter-classes", build)


def _symbols() -> np.ndarray:
    return process_cache("code-point-symbols", lambda: mix(np.arange(1, 0x110001, dtype=U64)))


def pieces(cp: np.ndarray, offsets: np.ndarray, specials: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(start, hash)`` of every piece of the texts ``cp[offsets[i]:offsets[i+1]]``, in order; a piece
    ends where the next begins.  ``specials`` are the places of the special string."""
    n = len(cp)
    if not n:
        return np.empty(0, np.int64), np.empty(0, U64)
    cls = letter_classes()[cp]
    hard = np.zeros(n + 1, bool)                        # a text, or the special string, begins here
    hard[offsets] = True
    inside = np.zeros(n, bool)
    for s in specials:
        hard[s] = hard[s + len(SPECIAL)] = True
        inside[s + 1: s + len(SPECIAL)] = True
    start = hard[:n].copy()
    start[1:] |= cls[1:] != cls[:-1]
    is_space = cls == SPACE
    run = np.flatnonzero(start)                         # runs of one class
    run_end = np.append(run[1:], n)
    blank = is_space[run]
    # a white-space run before other text: its last character is apart, and a space joins the next run
    ws, we = run[blank], run_end[blank]
    open_ = ~hard[we]
    last = we[open_] - 1
    start[last] = True
    joins = last[cp[last] == 32]
    start[joins + 1] = False
    # contractions: a lone apostrophe that begins a piece, then letters
    lone = np.flatnonzero((cp == 39) & start)
    lone = lone[(lone + 1 < n)]
    lone = lone[(cls[lone + 1] == LETTER) & ~hard[lone + 1]]
    if len(lone):
        nxt = cp[lone + 1]
        one = np.isin(nxt, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        second = np.where((lone + 2 < n) & ~hard[np.minimum(lone + 2, n)], cp[np.minimum(lone + 2, n - 1)], 0)
        two = ((nxt == ord("r")) & (second == ord("e"))) | ((nxt == ord("v")) & (second == ord("e"))) | (
            (nxt == ord("l")) & (second == ord("l")))
        for at, size in ((lone[one], 2), (lone[two], 3)):
            start[at + 1] = False
            after = at + size
            after = after[after < n]
            start[after] = True                         # the rest of the letters, or whatever follows
            # a white-space character that follows keeps its own rules: it began a run already
    start[inside] = False
    at = np.flatnonzero(start)
    lengths = np.diff(np.append(at, n))
    return at, run_hashes(_symbols()[cp], at, lengths)


def find_specials(text: str) -> np.ndarray:
    out, at = [], text.find(SPECIAL)
    while at >= 0:
        out.append(at)
        at = text.find(SPECIAL, at + len(SPECIAL))
    return np.array(out, np.int64)
