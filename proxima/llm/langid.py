"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram's vector binds (multiplies) its letters'
vectors, turned by two, one and no places; a text is the sum (bundle) of its trigrams' vectors; a
language is the bundle of its training texts, less what all languages share.  A text gets the
language with the largest cosine.

Texts are lower-cased; every run of other signs counts as one blank, so word ends are letters too.
Profiles are sums over all training rows, added up per task before they leave it.

Rules.  A text that is null or has no letters is ``und`` with score 0.  Of equal cosines the language
that sorts first wins.  Rows with a null language do not train.  Without any profile (no training
row, or none that tells languages apart) a text with letters has a null language and score 0.  The
score is the cosine, at least 0.  Rows are independent; extra columns are ignored.

``known_language`` keeps the documents in one of the labelled languages.  Its likeness is the largest
cosine with a language's whole bundle, what all languages share included.  A text of LEAST_TRIGRAMS
different trigrams or more needs a likeness of at least the floor; others hold too little to tell and
stay, as does every text with letters when there is no profile, or none for its label.  The floor is
FLOOR (other scripts reach 0.03 to 0.05, random letters mostly 0.06 to 0.09, labelled rows of sf0.1 more than 0.16), but
no more than half the likeness that 95 % of the held-out rows nearest to their own language reach with
bundles not trained on them; without such rows it is 0.  A language near to a labelled one in its
script and trigrams can pass (Dutch beside German: 0.18).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proxima.llm.common import process_cache, text_blocks
from proxima.llm.pieces import LETTER, letter_classes

DIM = 512
TABLE_SIZE = 1 << 16             # trigram vectors kept per process
UNKNOWN = "und"
FLOOR = 0.1                      # least likeness of a text in a known language
LEAST_TRIGRAMS = 32              # texts of fewer different ones are not held against the floor


def _letters() -> np.ndarray:
    """Code point to its lower-case letter, 0 for everything else."""
    def build():
        t = np.where(letter_classes() == LETTER, np.arange(0x110000, dtype=np.int32), np.int32(0))
        for c in np.flatnonzero(t):
            low = chr(c).lower()
            t[c] = ord(low) if len(low) == 1 else c
        return t
    return process_cache("lower-letters", build, "langid")


def _letter_vectors(cps: np.ndarray) -> np.ndarray:
    """Vectors of the given letters, made from the letter's number alone."""
    kept = process_cache("letter-vectors", dict, "langid")
    if len(kept) > 20_000:
        kept.clear()
    for c in cps.tolist():
        if c not in kept:
            kept[c] = (np.random.default_rng(c).integers(0, 2, DIM, dtype=np.int8) * 2 - 1).astype(np.int8)
    return np.stack([kept[c] for c in cps.tolist()])


def _trigram_vectors(codes: np.ndarray) -> np.ndarray:
    a, b, c = codes >> 42, (codes >> 21) & 0x1FFFFF, codes & 0x1FFFFF
    cps, at = np.unique(np.concatenate([a, b, c]), return_inverse=True)
    v, n = _letter_vectors(cps), len(codes)
    return np.roll(v, 2, axis=1)[at[:n]] * np.roll(v, 1, axis=1)[at[n: 2 * n]] * v[at[2 * n:]]


class _Table:
    """Rows of trigram vectors by trigram; emptied when full."""

    def __init__(self):
        self.rows = np.empty((TABLE_SIZE, DIM), np.int8)
        self.clear()

    def clear(self):
        self.keys, self.place = np.empty(0, np.int64), np.empty(0, np.int64)

    def bundle(self, codes: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The weighted sum of the vectors of distinct ``codes``, in slices of bounded memory."""
        out = np.zeros(DIM, np.float32)
        for i in range(0, len(codes), 4096):
            out += times[i: i + 4096].astype(np.float32) @ self.of(codes[i: i + 4096]).astype(np.float32)
        return out

    def of(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, codes)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == codes[hit]
        if not hit.all():
            new = codes[~hit]
            if len(self.keys) + len(new) > TABLE_SIZE:
                self.clear()
                new = codes
            n = len(self.keys)
            self.rows[n: n + len(new)] = _trigram_vectors(new)
            keys = np.concatenate([self.keys, new])
            place = np.concatenate([self.place, np.arange(n, n + len(new))])
            order = np.argsort(keys, kind="stable")
            self.keys, self.place = keys[order], place[order]
            at = np.searchsorted(self.keys, codes)
        return self.rows[self.place[at]]


def _block_letters(data: np.ndarray, off: np.ndarray):
    """The letters of a block of texts with one blank for every other run, and each text's bounds;
    a text begins and ends with a blank."""
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    edge = heads[off]
    # a blank before every text, and one at the end
    n = len(edge) - 1
    x = np.zeros(len(cp) + n + 1, np.int64)
    text = np.repeat(np.arange(n), np.diff(edge))
    x[np.arange(len(cp)) + text + 1] = _letters()[cp]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    bound = edge + np.arange(n + 1)                      # the blank before each text
    keep[bound] = True
    # the blank before a text also ends the one before it
    place = np.cumsum(keep) - 1
    return x[keep], place[bound]


def _texts(data: np.ndarray, off: np.ndarray):
    """``(trigram codes)`` of every text, None without letters."""
    x, bound = _block_letters(data, off)
    codes = (x[:-2] << 42 | x[1:-1] << 21 | x[2:]) if len(x) > 2 else np.empty(0, np.int64)
    solid = np.concatenate([[0], np.cumsum(x != 0)])
    for i in range(len(off) - 1):
        a, b = int(bound[i]), int(bound[i + 1])
        yield codes[a: b - 1] if solid[b] > solid[a] else None


def _table() -> _Table:
    return process_cache("trigram-table", _Table, "langid")


def _train(batches):
    """Per task and language, the bundle of its texts."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for a, b, data, off in text_blocks(batch.column(1)):
            by: dict[str, list] = {}
            for lang, codes in zip(langs[a:b], _texts(data, off)):
                if codes is not None:
                    by.setdefault(lang, []).append(codes)
            for lang, codes in by.items():
                v = _table().bundle(*np.unique(np.concatenate(codes), return_counts=True))
                sums[lang] = sums.get(lang, 0.0) + v.astype(np.float64)
    if sums:
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(names, DIM).tolist(), pa.string()), pa.array(np.tile(np.arange(DIM, dtype=np.int32), len(names))),
             pa.array(np.concatenate([sums[n] for n in names]))], names=["lang", "k", "v"])


def _bundles(labelled: DataFrame, label, text_col: str) -> dict[str, np.ndarray]:
    """The bundle of every label: DIM numbers each reach the driver."""
    rows = (labelled.select(label.cast("string").alias("lang"), F.col(text_col).cast("string")).where("lang is not null")
            .mapInArrow(_train, "lang string, k int, v double").groupBy("lang", "k").agg(F.sum("v").alias("v")).collect())
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(DIM))[r["k"]] = r["v"]
    return out


def _unit(out: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: v / np.linalg.norm(v) for k, v in out.items() if np.linalg.norm(v) > 0}


def _told_apart(out: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    unit = _unit(out)
    if len(unit) > 1:                                   # what all languages share tells none of them
        shared = sum(unit.values()) / len(unit)
        unit = {k: (v - shared) / np.linalg.norm(v - shared) for k, v in unit.items()
                if np.linalg.norm(v - shared) > 1e-9}
    return {k: unit[k] for k in sorted(unit)}


def language_profiles(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Profile of every language among the labelled rows."""
    return _told_apart(_bundles(labelled, F.col(lang_col), text_col))


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text",
                     out: tuple[str, ...] = ("lang_pred", "score"), bundles: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``docs`` with the predicted language and its score added after the other columns; with ``bundles``
    a third column has the likeness, null where there is no profile or the text holds too little."""
    names, columns, at = list(profiles), [*docs.columns, *out], docs.columns.index(text_col)
    matrix = np.stack([profiles[n] for n in names]) if names else np.zeros((0, DIM))
    whole = list(_unit(bundles or {}).values())
    plain = np.stack(whole) if names and whole else None

    def run(batches):
        for batch in batches:
            for a, b, data, off in text_blocks(batch.column(at)):      # rows go on block by block
                preds, scores, likes = [], [], []
                for codes in _texts(data, off):
                    best, score, like = UNKNOWN, 0.0, None
                    if codes is not None and not names:
                        best = None
                    elif codes is not None:
                        found, times = np.unique(codes, return_counts=True)
                        v = _table().bundle(found, times).astype(np.float64)
                        size = np.linalg.norm(v)
                        cos = matrix @ v / size if size else np.zeros(len(names))
                        k = int(np.argmax(cos))
                        best, score = names[k], float(min(1.0, max(0.0, cos[k])))
                        if plain is not None and size and len(found) >= LEAST_TRIGRAMS:
                            like = float((plain @ v).max() / size)
                    preds.append(best)
                    scores.append(score)
                    likes.append(like)
                made = [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(likes, pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *made[: len(out)]], names=columns)
    types = (T.StringType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(out, types))])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _bundles_and_floor(docs: DataFrame, id_col: str, lang_col: str, text_col: str) -> tuple[dict[str, np.ndarray], float]:
    """Bundles of all labelled rows, and the floor that the held-out ones allow; one pass sums both."""
    side = F.when(held_out(id_col), "1").otherwise("0")
    sums = _bundles(docs, F.concat(side, F.col(lang_col).cast("string")), text_col)
    every: dict[str, np.ndarray] = {}
    for k, v in sums.items():
        every[k[1:]] = every.get(k[1:], 0.0) + v
    rest = {k[1:]: v for k, v in sorted(sums.items()) if k[0] == "0"}
    checked = docs.where(held_out(id_col) & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    right = predict_language(checked, _unit(rest), out=("near", "score", "like"), bundles=rest).where("lang = near")
    low = right.agg(F.percentile_approx("like", 0.05, 10_000)).first()[0]
    return every, min(FLOOR, (low or 0.0) / 2)


def known_language(docs: DataFrame, out: tuple[str, str, str], id_col: str = "doc_id", lang_col: str = "lang",
                   text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in a known language, with prediction, score and likeness; see the module's rules."""
    bundles, floor = _bundles_and_floor(docs, id_col, lang_col, text_col)
    profiles = _told_apart(bundles)
    lang = F.col(lang_col).cast("string")
    told = F.coalesce(F.col(out[0]) != UNKNOWN, F.lit(True))
    free = lang.isNotNull() & ~lang.isin(list(profiles))    # a label that no profile stands for
    near = F.coalesce(F.col(out[2]) >= floor, F.lit(True))
    return predict_language(docs, profiles, text_col, out, bundles).where(told & (near | free))


def identify_languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: trained on the rows not held out, over all rows."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    profiles = language_profiles(docs.where(~held_out()))
    out = predict_language(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
