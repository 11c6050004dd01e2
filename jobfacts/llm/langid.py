"""Language identification in two steps: the family, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobfacts.llm.common import mapped, raw, small

#: Languages of a family by their two-letter codes; any other code is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi".split(),
    "romance": "ca es fr gl it oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu se".split(),
    "turkic": "az kk ky tk tr tt uz".split(),
    "indo-aryan": "as bn gu hi mr ne or pa sd si ur".split(),
    "semitic": "am ar he mt".split(),
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}

UNKNOWN = "und"
#: Hashed pairs and triples of bytes are counted in so many cells.
PAIRS, TRIPLES = 1024, 3072
CELLS = PAIRS + TRIPLES
_BATCH, _ROWS = 2 << 20, 512


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang, lang)


def _folded() -> np.ndarray:
    """Bytes as features see them: A-Z as a-z, all other ASCII that is no letter as a blank."""
    out = np.arange(256, dtype=np.uint32)
    out[:128] = 32
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    return out


_FOLD = _folded()


def features(texts: pa.Array) -> np.ndarray:
    """A row of `CELLS` numbers for each whole text: square roots of counts, of length one."""
    body, at = raw(texts)
    n = len(at) - 1
    counts = np.zeros(n * CELLS, np.float32)
    if len(body) > 2:
        b = _FOLD[body]
        doc = np.repeat(np.arange(n), np.diff(at))
        with np.errstate(over="ignore"):
            two = ((b[:-1] << 8 | b[1:]) * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(PAIRS)
            three = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2246822519) >> np.uint32(12)) % np.uint32(TRIPLES) + np.uint32(PAIRS)
        for cell, width in ((two, 2), (three, 3)):
            whole = doc[: len(cell)] == doc[width - 1 :]
            counts += np.bincount(doc[: len(cell)][whole] * CELLS + cell[whole], minlength=n * CELLS).astype(np.float32)
    rows = np.sqrt(counts.reshape(n, CELLS))
    return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-9)


def lettered(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter; texts without one of a-z are looked at character by character."""
    body, at = raw(texts)
    letters = np.concatenate([[0], np.cumsum((body | 32) - np.uint8(97) < 26)])
    out = letters[at[1:]] > letters[at[:-1]]
    for i in np.flatnonzero(~out).tolist():
        out[i] = any(c.isalpha() for c in texts[i].as_py() or "")
    return out


def train_svm(x: np.ndarray, rows: np.ndarray, positive: np.ndarray, c: float = 10.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights and bias (last) of a linear SVM with hinge loss, by dual coordinate descent; classes weigh alike.

    It learns from `rows` of x (16-bit numbers), `positive` or not, and takes them one at a time: nothing is copied.
    """
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, positive.mean(), 1 - positive.mean())
    top = c * 0.5 / np.maximum(share, 1e-9)
    one = np.ones(x.shape[1] + 1, np.float32)
    alpha, w, norm = np.zeros(len(rows)), np.zeros(x.shape[1] + 1, np.float32), np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            one[:-1] = x[rows[i]]
            norm[i] = norm[i] or one @ one
            new = min(max(alpha[i] - (y[i] * (w @ one) - 1) / norm[i], 0.0), top[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * one
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


class OneVersusOne:
    """A linear machine for each pair of classes; most duels won, then the larger sum of margins, decides."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> None:
        self.classes = sorted(set(labels[rows].tolist()))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        machines = []
        for a, b in self.pairs:
            use = rows[(labels[rows] == self.classes[a]) | (labels[rows] == self.classes[b])]
            machines.append(train_svm(x, use, labels[use] == self.classes[a]))
        self.weights = np.array(machines, np.float32).reshape(len(self.pairs), x.shape[1] + 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the class in `classes`, and the least margin by which it won a duel (infinite without rivals)."""
        n, k = len(x), len(self.classes)
        if not self.pairs:
            return np.zeros(n, int), np.full(n, np.inf)
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        won, total = np.zeros((n, k)), np.zeros((n, k))
        for m, (a, b) in zip(margins.T, self.pairs):
            won[:, a] += m >= 0
            won[:, b] += m < 0
            total[:, a] += m
            total[:, b] -= m
        best = np.lexsort((total, won), axis=1)[:, -1]
        least = np.full(n, np.inf)
        for m, (a, b) in zip(margins.T, self.pairs):
            least = np.where(best == a, np.minimum(least, m), np.where(best == b, np.minimum(least, -m), least))
        return best, least


class Hierarchy:
    """Families first, then the languages of the family that won."""

    def __init__(self, x: np.ndarray, langs: np.ndarray) -> None:
        of = np.array([family_of(x) for x in langs.tolist()])
        self.families = OneVersusOne(x, np.arange(len(x)), of)
        self.inside = {name: OneVersusOne(x, np.flatnonzero(of == name), langs) for name in self.families.classes}

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score: the lesser of both steps' least margins through a logistic curve."""
        family, margin = self.families.predict(x)
        lang = np.empty(len(x), object)
        for k, name in enumerate(self.families.classes):
            rows = np.flatnonzero(family == k)
            if len(rows):
                best, least = self.inside[name].predict(x[rows])
                lang[rows] = np.array(self.inside[name].classes, object)[best]
                margin[rows] = np.minimum(margin[rows], least)
        return lang, 1 / (1 + np.exp(-3 * np.minimum(margin, 50)))


def fit(labelled: DataFrame, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Hierarchy | None:
    """A hierarchy learnt from a sample of `labelled`, None when no row has a language and a text.

    The fit is the one thing that is bounded: about `sample_rows` rows in all, as many of each language, chosen by the
    hash of their id, so languages are counted first and a frequent one is thinned as it is read.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    each = max(20, sample_rows // len(counts))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30))
    chosen: Column = F.lit(False)
    for lang, n in counts.items():
        chosen = chosen | ((F.col(lang_col) == lang) & (draw <= min(1 << 30, (each << 30) // n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text", _BATCH, _ROWS):
            x = features(batch.column("text")).astype(np.float16)
            yield pa.record_batch([batch.column("lang"), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "x"])

    picked = rows.filter(chosen).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sample = mapped(picked, run, "lang string, x binary").limit(2 * each * len(counts)).toArrow()
    if not sample.num_rows:
        return None
    sample = sample.sort_by([("lang", "ascending"), ("x", "ascending")])
    langs = np.array(sample.column("lang").to_pylist(), object)
    held = raw(sample.column("x").combine_chunks())[0].view(np.float16).reshape(-1, CELLS)
    return Hierarchy(held, langs)


def identify(docs: DataFrame, model: Hierarchy | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, lang_pred, score.

    Every whole text is reduced to hashed byte pairs and triples, by which the model names the family and then the
    language in it. A null text, one without a letter, and any text without a model is `UNKNOWN` with score 0.
    Only the text decides: null ids, repeated rows and other columns make no difference.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text", _BATCH, _ROWS):
            n = batch.num_rows
            lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
            known = np.flatnonzero(lettered(batch.column("text"))) if model is not None else np.empty(0, int)
            if len(known):
                lang[known], score[known] = model.predict(features(batch.column("text").take(pa.array(known))))
            yield pa.record_batch([batch.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
