"""Quality classifier by co-training of two views.

View one sees the text's content: shares of character classes, word statistics and
hashed byte trigrams.  View two sees page metadata: language, source, length and
line layout.  Both are ridge logistic regressions.  In every round each view scores
all documents, and those that it is surest of join the *other* view's training rows
with the label it gives them: a distributed top-k, equal texts counting once.  Both
views are then calibrated on labelled rows that no round has seen, combined by a
logistic regression on further such rows, and the combination scores every document.

Only labelled rows are a sample, of a documented bound (``Params``): those with the
smallest hashes of their ids, so they are the same on every run.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tipoff.llm.common import Workspace, bounded_batches, map_batches, text_or_empty
from tipoff.llm.rules import class_histogram

TRIGRAMS, SOURCES, LANG_SLOTS = 256, 32, 8


@dataclass(frozen=True)
class Params:
    """Bound of the labelled rows and settings of the rounds."""

    labelled: int = 8000
    rounds: int = 3
    #: Pseudo-labels that a view hands on in a round, as a share of the labelled rows it
    #: learns from; shared out by the labels' frequencies.
    per_round: float = 0.05
    #: A view is sure where so many of its answers are right on rows it hasn't learnt from.
    sure: float = 0.97
    #: Share of the labelled rows for calibration, and the same again for combination.
    holdout: float = 0.15
    ridge: float = 1.0
    #: Documents of a lower combined score are rejected.
    threshold: float = 0.3


def text_view(text: str) -> np.ndarray:
    """Features of the content."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw))
    classes = class_histogram(text).astype(np.float64)
    space = np.isin(raw, (9, 10, 11, 12, 13, 32))
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(raw) else np.zeros(0, np.int64)
    words = max(1, len(starts))
    wide = raw.astype(np.uint32)
    tri = np.zeros(TRIGRAMS)
    distinct = 0.0
    if len(raw) >= 3:
        code = wide[:-2] * np.uint32(65599) * np.uint32(65599) + wide[1:-1] * np.uint32(65599) + wide[2:]
        code ^= code >> np.uint32(15)
        tri = np.bincount((code * np.uint32(2654435761)) >> np.uint32(24), minlength=TRIGRAMS) / n
        seen = np.bincount((code * np.uint32(2246822519)) >> np.uint32(18), minlength=1 << 14)
        distinct = np.count_nonzero(seen) / min(n, 1 << 14)
    return np.concatenate([classes / max(1.0, classes.sum()), [np.log1p(words) / 10, (n - space.sum()) / words / 10, distinct, words / n], np.sqrt(tri)]).astype(np.float32)


def meta_view(text: str, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Features of the page: language, source, length, line layout."""
    out = np.zeros(LANG_SLOTS + SOURCES + 6, np.float32)
    out[zlib.crc32((lang or "").encode()) % LANG_SLOTS] = 1
    out[LANG_SLOTS + zlib.crc32((source or "").encode()) % SOURCES] = 1
    n = len(text) if n_chars is None else max(0, int(n_chars))
    lines = text.count("\n") + 1
    longest = max(map(len, text.split("\n")))
    out[-6:] = (np.log1p(n) / 10, np.log1p(lines) / 10, np.log1p(len(text) / lines) / 10, longest / max(1, len(text)), np.log1p(longest) / 10, abs(n - len(text)) > 0)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Linear:
    """A logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias


def fit(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12) -> Linear:
    """Iterated reweighted least squares with a ridge."""
    x = x.astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(z @ w)
        v = np.maximum(p * (1 - p), 1e-4)
        step = np.linalg.solve((z * v[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return Linear(mean, scale, w[:-1], float(w[-1]))


@dataclass(frozen=True)
class Model:
    """Two views with their calibration and combination: logit = a * text + b * meta + c.

    Without rows of both classes there is nothing to learn: every score is ``base``.
    """

    text: Linear | None
    meta: Linear | None
    calibration: tuple[Linear, Linear] | None
    combination: Linear | None
    base: float

    def scores(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, text, meta) probabilities of good quality."""
        if self.text is None:
            same = np.full(len(xt), self.base)
            return same, same, same
        ct = self.calibration[0].logit(self.text.logit(xt)[:, None])
        cm = self.calibration[1].logit(self.meta.logit(xm)[:, None])
        return _sigmoid(self.combination.logit(np.column_stack([ct, cm]))), _sigmoid(ct), _sigmoid(cm)


@dataclass(frozen=True)
class Ask:
    """What a round asks of a view: at most ``most`` documents of a label, as sure as ``least``."""

    view: str
    label: float
    most: int
    least: float

    def other(self) -> str:
        return "m" if self.view == "t" else "t"


#: For a round: takes both views, what is asked of them, and the hashes that each view has
#: had; returns (hashes, text features, metadata features) for each.
Surest = Callable[[dict[str, Linear], list[Ask], dict[str, set[int]]], list[tuple[list[int], np.ndarray, np.ndarray]]]


def surety(p: np.ndarray, right: np.ndarray, share: float) -> float:
    """The least probability from which on answers are right with this share (by the rule
    of succession); over 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    n = np.arange(1, len(p) + 1)
    good = (np.cumsum(right[order]) + 1) / (n + 2) >= share
    last = np.append(p[order][1:] != p[order][:-1], True)  # equal ones stand or fall together
    found = np.flatnonzero(good & last)
    return float(p[order][found[-1]]) if len(found) else 2.0


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, surest: Surest | None, params: Params, texts: list[int] | None = None) -> Model:
    """Fit both views; rows come in a fixed order, the last shares are held out.

    ``texts`` are hashes of the rows' texts: no round may take one that is held out.
    """
    base = float(y.mean()) if len(y) else 0.5
    n = int(len(y) * params.holdout)
    held = len(y) - 2 * n
    parts = (slice(0, held), slice(held, held + n), slice(held + n, None))
    if not all(0 < y[p].sum() < len(y[p]) for p in parts):
        return Model(None, None, None, None, base)
    learn, calibrate, combine = parts
    rows = {"t": [(xt[learn], y[learn])], "m": [(xm[learn], y[learn])]}
    had = {v: set(texts[held:] if texts else ()) for v in "tm"}
    model = {}
    for turn in range(params.rounds + 1):
        for v in "tm":
            model[v] = fit(np.concatenate([a for a, _ in rows[v]]), np.concatenate([b for _, b in rows[v]]), params.ridge)
        if turn == params.rounds or surest is None:
            break
        asked = []
        for v, x in (("t", xt), ("m", xm)):
            p = _sigmoid(model[v].logit(x[calibrate]))
            for label, share in ((1.0, base), (0.0, 1 - base)):
                # an answer is for the label the view holds to be likelier
                sure = p if label else 1 - p
                mine = sure >= 0.5
                least = surety(sure[mine], y[calibrate][mine] == label, params.sure)
                asked.append(Ask(v, label, max(1, round(params.per_round * held * share)), least))
        asked = [a for a in asked if a.least <= 1]
        if not asked:
            break
        for a, (hashes, ft, fm) in zip(asked, surest(model, asked, had), strict=True):
            if hashes:
                had[a.other()].update(hashes)
                rows[a.other()].append((fm if a.other() == "m" else ft, np.full(len(hashes), a.label)))
    logits = lambda p: (model["t"].logit(xt[p])[:, None], model["m"].logit(xm[p])[:, None])
    lt, lm = logits(calibrate)
    calibration = (fit(lt, y[calibrate], params.ridge), fit(lm, y[calibrate], params.ridge))
    lt, lm = logits(combine)
    combination = fit(np.column_stack([calibration[0].logit(lt), calibration[1].logit(lm)]), y[combine], params.ridge)
    return Model(model["t"], model["m"], calibration, combination, base)


def surest_rows(found: list[tuple], k: int) -> list[tuple]:
    """The k surest of rows (sure, hash, ..), equal hashes once."""
    out: dict[int, tuple] = {}
    for row in sorted(found, key=lambda r: (-r[0], r[1])):
        if len(out) == k:
            break
        out.setdefault(row[1], row)
    return list(out.values())


CANDIDATE = "asked int, sure double, h long, t binary, m binary"


def surest_of(docs: DataFrame, work: Workspace) -> Surest:
    """Every document is scored; a task hands on its own surest, and Spark takes the
    surest of those, so that the driver gets what a round adds and no more."""
    got = docs.select(F.xxhash64(text_or_empty("text")).alias("h"), *_inputs())
    turns = itertools.count()

    def find(model: dict[str, Linear], asked: list[Ask], had: dict[str, set[int]]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple]] = [[] for _ in asked]
            for batch in batches:
                if not batch.num_rows:
                    continue
                h, text, lang, source, n_chars = (c.to_pylist() for c in batch.columns)
                views = {"t": np.stack([text_view(x) for x in text]), "m": np.stack([meta_view(*x) for x in zip(text, lang, source, n_chars, strict=True)])}
                p = {v: _sigmoid(model[v].logit(views[v])) for v in "tm"}
                for i, a in enumerate(asked):
                    sure = np.round(p[a.view] if a.label else 1 - p[a.view], 9)
                    new = [(float(sure[j]), h[j], views["t"][j].tobytes(), views["m"][j].tobytes()) for j in np.flatnonzero(sure >= a.least).tolist() if h[j] not in had[a.other()]]
                    best[i] = surest_rows(best[i] + new, a.most)
            rows = [(i, *row) for i, some in enumerate(best) for row in some]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=[c.split()[0] for c in CANDIDATE.split(", ")])

        bounded_batches(docs.sparkSession)
        found = work.put(got.mapInArrow(run, CANDIDATE), f"round_{next(turns)}")
        out = []
        for i, a in enumerate(asked):
            # equal texts of other metadata: that with the least bytes
            one = found.filter(F.col("asked") == i).groupBy("h").agg(F.max("sure").alias("sure"), F.min(F.struct("t", "m")).alias("x"))
            rows = one.orderBy(F.col("sure").desc(), "h").limit(a.most).select("h", "x.t", "x.m").collect()  # what the round adds
            out.append(([r.h for r in rows], *(np.stack([np.frombuffer(r[c], np.float32) for r in rows]) if rows else np.zeros((0, 0), np.float32) for c in ("t", "m"))))
        return out

    return find


def _features(docs: DataFrame) -> DataFrame:
    """(h, label, x, t, m): the text's hash and the views as packed floats, for bounded samples."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, lang, source, n_chars = (c.to_pylist() for c in batch.columns[3:])
        t = [text_view(x).tobytes() for x in text]
        m = [meta_view(*x).tobytes() for x in zip(text, lang, source, n_chars, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(t, pa.binary()), pa.array(m, pa.binary())], names=["h", "label", "x", "t", "m"])

    return map_batches(docs.select("h", "label", F.xxhash64(text_or_empty("text")).alias("x"), *_inputs()), run, "h long, label double, x long, t binary, m binary")


def _inputs() -> list:
    return [text_or_empty("text").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars")]


def train(docs: DataFrame, labels: DataFrame, params: Params = Params(), label_col: str = "quality") -> Model:
    """Fit on the labelled rows, bounded by ``params``, and pseudo-labels from all rows.

    Labels that are null are left out; of several labels of one id the lowest counts.
    Ids that several documents share are all used, within the bound.
    """
    ids = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).cast("double").alias("label"))
    known = ids.select("doc_id", "label", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(params.labelled)
    # the sample has at most `labelled` rows of three numbers: a safe broadcast
    rows = _features(docs.drop("h", "label").join(F.broadcast(known), "doc_id")).orderBy("h", "x", "t").limit(params.labelled).collect()
    if not rows:
        return co_train(np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0), None, params)
    xt, xm = (np.stack([np.frombuffer(r[c], np.float32) for r in rows]) for c in ("t", "m"))
    work = Workspace(docs.sparkSession, "cotrain")
    model = co_train(xt, xm, np.array([r.label for r in rows]), surest_of(docs, work), params, [r.x for r in rows])
    work.drop()
    return model


SCORES = "quality_score double, text_score double, meta_score double, kept boolean"


def score(docs: DataFrame, model: Model, params: Params = Params()) -> DataFrame:
    """All columns of docs and those of SCORES; like-named ones are replaced.

    Null texts are empty, null metadata is a value of its own; repeated rows are
    scored each; an empty table gives no rows.
    """
    names = [f.split()[0] for f in SCORES.split(", ")]
    kept = docs.drop(*names)
    columns, n = kept.columns, len(kept.columns)
    got = kept.select(*columns, *[c.alias(f"__{i}") for i, c in enumerate(_inputs())])
    schema = StructType([*kept.schema.fields, *StructType.fromDDL(SCORES).fields])
    threshold = params.threshold

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, lang, source, n_chars = (c.to_pylist() for c in batch.columns[n:])
        xt = np.stack([text_view(x) for x in text])
        xm = np.stack([meta_view(*x) for x in zip(text, lang, source, n_chars, strict=True)])
        both, t, m = (np.round(s, 6) for s in model.scores(xt, xm))
        return pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(both), pa.array(t), pa.array(m), pa.array(both >= threshold)], names=[*columns, *names])

    return map_batches(got, run, schema)


def classify(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """Train, then score every document.

    Without labels of both kinds all documents have the labels' mean as score (0.5
    without any); an empty table gives no rows; columns named like those of SCORES
    are replaced; repeated rows and equal texts are scored alike.
    """
    return score(docs, train(docs, labels, params), params)
