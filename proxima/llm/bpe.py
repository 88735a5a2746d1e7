"""Byte-level BPE, exact ids: per-prefix dynamic programming over automaton matches.

For every prefix of a pre-token there is one last token of its encoding.  Going through the bytes, an
Aho-Corasick automaton over the vocabulary names the tokens that end at a place; the one that is
compatible with the last token of the prefix before it is the prefix's last token.  Two tokens are
compatible if the merges, run on their bytes side by side, leave the border between them alone:
the merges that made them are undone from the latest on, and none of the border pairs met on the way
may have merged sooner.  Following the back-pointers from the end gives the ids.

``encode_documents`` encodes each distinct pre-token of a block once and keeps a bounded table of
pre-tokens between blocks.  Rules: a null text is empty; the special string inside a text is its own
id, as the library does by default; extra columns are ignored; rows are independent.
"""

from __future__ import annotations

import hashlib
import json

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import process_cache, text_blocks
from proxima.llm.pieces import SPECIAL, find_specials, pieces

BLOCK_BYTES = 1 << 20
TABLE_SIZE = 200_000             # pre-tokens kept per process between blocks


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for
    itself, every other byte, in order, for a letter from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and the automaton of a ``tokenizers`` byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        as_bytes = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        self.bytes_of = {i: as_bytes[t] for t, i in model["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}      # of the merge of two tokens
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right of the merge that makes it
        vocab = model["vocab"]
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, token = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((left, right), r)
            self.made.setdefault(token, (r, left, right))
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            text = as_bytes[t].decode("latin-1")
            if len(text) == 1 or i in self.made:
                self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` side by side ends in exactly ``a, b``."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[a, b] = self._border_holds(a, b)
        return known

    def _border_holds(self, a: int, b: int) -> bool:
        # The state next to the border, going back in time.  ``until`` is the rank at which the state
        # ends because a neighbour of the border is merged away: a border merge of a lower rank would
        # have come first.  Of equal ranks the left one comes first, so a border merge also wins
        # against the merge of its right neighbour (``until`` one higher), not against its left one's.
        until = 1 << 60
        x, y = a, b
        while True:
            r = self.rank.get((x, y))
            if r is not None and r < until:
                return False
            mx, my = self.made.get(x), self.made.get(y)
            if mx is None and my is None:
                return True
            # the later merge is undone first; of one rank, the right one was the later
            if my is None or (mx is not None and mx[0] > my[0]):
                until, x = mx[0], mx[2]
            else:
                until, y = my[0] + 1, my[1]

    def encode_all(self, distinct: list[bytes]) -> list[list[int]]:
        """The ids of distinct pre-tokens.  In sorted order, a pre-token takes over what the one before
        it has found for their common prefix."""
        out: list[list[int]] = [[]] * len(distinct)
        last, size, before = [-1], [0], b""
        fits, known, matches = self.fits, self._fits, self.automaton.iter
        for k in sorted(range(len(distinct)), key=distinct.__getitem__):
            piece = distinct[k]
            same, most = 0, min(len(piece), len(before))
            while same < most and piece[same] == before[same]:
                same += 1
            del last[same + 1:], size[same + 1:]
            before, done = piece, same + 1               # done: prefixes decided, the empty one included
            for end, (length, token) in matches(piece.decode("latin-1")):
                if end + 1 < done:
                    continue
                at = end + 1 - length
                if at:
                    pair = (last[at], token)
                    ok = known.get(pair)
                    if ok is None:
                        ok = fits(*pair)
                else:
                    ok = length == 1 or self._alone(token)
                if ok:
                    last.append(token)
                    size.append(length)
                    done += 1
            ids, at = [], len(piece)
            while at:
                ids.append(last[at])
                at -= size[at]
            ids.reverse()
            out[k] = ids
        return out

    def _alone(self, token: int) -> bool:
        """Whether a token's own bytes merge into it: its two halves stand side by side at its merge."""
        m = self.made.get(token)
        if m is None:
            return True
        key = (-1, token)
        known = self._fits.get(key)
        if known is None:
            known = self._fits[key] = self._forms(m)
        return known

    def _forms(self, made: tuple[int, int, int]) -> bool:
        r, left, right = made
        if not (self._alone(left) and self._alone(right)):
            return False
        # as a border that must hold until rank r
        until, x, y = r, left, right
        while True:
            s = self.rank.get((x, y))
            if s is not None and s < until:
                return False
            mx, my = self.made.get(x), self.made.get(y)
            if mx is None and my is None:
                return True
            if my is None or (mx is not None and mx[0] > my[0]):
                until, x = min(until, mx[0]), mx[2]
            else:
                until, y = min(until, my[0] + 1), my[1]

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def vocabulary(path: str) -> Vocabulary:
    return process_cache(("bpe", path), lambda: Vocabulary(path), "bpe")


def encode_pieces(v: Vocabulary, distinct: list[str]) -> list[list[int]]:
    """The ids of distinct pieces of ``BlockPieces``, the special string included."""
    plain = [p.encode() for p in distinct]
    out = v.encode_all(plain)
    for k, p in enumerate(distinct):
        if p in v.special:
            out[k] = [v.special[p]]
    return out


class BlockPieces:
    """The pieces of a block of texts: the distinct ones, and which of them each place holds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        text = data.tobytes().decode("utf-8")
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        # offsets in letters: bytes that begin a letter, counted up to each text
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        off = heads[offsets]
        specials = find_specials(text)
        if len(specials):                                # not across two texts
            specials = specials[np.searchsorted(off, specials, "right") == np.searchsorted(off, specials + len(SPECIAL) - 1, "right")]
        at, h = pieces(cp, off, specials)
        self.hashes, first, self.which = np.unique(h, return_index=True, return_inverse=True)
        ends = np.append(at[1:], len(cp))
        self.distinct = [text[a:b] for a, b in zip(at[first].tolist(), ends[first].tolist())]
        self.edge = np.searchsorted(at, off)             # first piece of every text
        self.text, self.off = text, off


def _encode_run(path: str):
    def run(batches):
        v = vocabulary(path)
        table = process_cache(("bpe-table", path), dict, "bpe")
        for batch in batches:
            for a, b, data, off in text_blocks(batch.column(1), BLOCK_BYTES):
                block = BlockPieces(data, off)
                if len(table) > TABLE_SIZE:
                    table.clear()
                new = [p for p in block.distinct if p not in table]
                for p, ids in zip(new, encode_pieces(v, new)):
                    table[p] = (len(ids), ",".join(map(str, ids)), v.decode(ids))
                found = [table[p] for p in block.distinct]
                counts = np.array([x[0] for x in found], np.int64)[block.which] if found else np.empty(0, np.int64)
                sums = np.concatenate([[0], np.cumsum(counts)])
                n_tokens = sums[block.edge[1:]] - sums[block.edge[:-1]]
                names, raw = [x[1] for x in found], [x[2] for x in found]
                ids_sha, text_sha = [], []
                for k in range(b - a):
                    w = block.which[block.edge[k]: block.edge[k + 1]].tolist()
                    ids_sha.append(hashlib.sha256(",".join([names[i] for i in w]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(b"".join([raw[i] for i in w])).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()),
                     pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids and of the decoded text."""
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(
        _encode_run(path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` for every row."""
    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for a, b, data, off in text_blocks(batch.column(1), BLOCK_BYTES):
                block = BlockPieces(data, off)
                found = encode_pieces(v, block.distinct)
                ids = [[i for w in block.which[block.edge[k]: block.edge[k + 1]].tolist() for i in found[w]] for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))],
                                                 names=["doc_id", "ids"])
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text."""
    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else v.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
