"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of `WINDOW` bytes. In each window one recurrent layer reads forwards and
one backwards; every byte position gets a probability per language, and a document's score is the
mean over all its positions. The network is trained in numpy by backpropagation through time, on a
bounded sample of labelled rows, each language as often as any other; prediction is one narrow pass over whole texts without a shuffle.

The gates use piecewise-linear squashing (clipping), which keeps a step to a few vector operations.

Edge cases: a null text, or one without any letter, is `und` with score 0; very long texts are cut
into windows like any other; if no labelled row can be learnt from, every row is `und`; a single
language is predicted with score 1; repeated rows each give their row; an empty table gives an empty
result. Columns other than doc_id, text and (for training) lang are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import common

WINDOW = 64
HIDDEN = 8
#: The training sample: passages of so many labelled documents of each language, so many characters of each.
SAMPLE_DOCS = 160
SAMPLE_CHARS = 1500
#: Languages that are learned at most: those with the most labelled documents, of equally many the first in order.
MAX_LANGUAGES = 200
STEPS = 260
BATCH = 160
RATE = 0.02
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    """`inputs` (3 * HIDDEN x 256), `recur` (3 * HIDDEN x HIDDEN) by direction; `out`, `bias` give the languages' logits."""

    languages: list[str]
    inputs: list[np.ndarray]
    recur: list[np.ndarray]
    out: list[np.ndarray]
    bias: np.ndarray

    def position_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(WINDOW, languages, windows) for bytes x of shape (WINDOW, windows)."""
        hidden = [_run(self.inputs[d], self.recur[d], x, d)[0] for d in (0, 1)]
        logits = sum(np.matmul(self.out[d], hidden[d]) for d in (0, 1)) + self.bias[:, None]
        return _softmax(logits)

    def label(self, text: str) -> list[str]:
        """The language of every byte of a text."""
        data = np.frombuffer(text.encode(), np.uint8)
        if not data.size or not self.languages:
            return [UNDETERMINED] * data.size
        padded = np.zeros(-(-data.size // WINDOW) * WINDOW, np.uint8)
        padded[: data.size] = data
        best = self.position_probabilities(padded.reshape(-1, WINDOW).T).argmax(1).T.reshape(-1)
        return [self.languages[i] for i in best[: data.size]]


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Over axis 1."""
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _run(inputs, recur, x, direction, keep=False):
    """Hidden states (WINDOW, HIDDEN, n) of one direction; with `keep`, also what backpropagation needs."""
    steps, n = x.shape
    k = recur.shape[1]
    states = np.empty((steps, k, n), np.float32)
    h = np.zeros((k, n), np.float32)
    kept = {}
    for t in range(steps) if direction == 0 else range(steps - 1, -1, -1):
        a = np.take(inputs, x[t], axis=1)
        u = recur @ h
        gates = a[: 2 * k] + u[: 2 * k]
        np.clip(gates, 0.0, 1.0, out=gates)
        z, r = gates[:k], gates[k:]
        raw = r * u[2 * k :]
        raw += a[2 * k :]
        new = np.clip(raw, -1.0, 1.0)
        if keep:
            kept[t] = (h, u[2 * k :], gates, raw, new)
        h = new + z * (h - new)
        states[t] = h
    return states, kept


def _backward(inputs, recur, x, direction, kept, grad_states):
    """Gradients of `inputs` and `recur` from those of the hidden states."""
    steps, n = x.shape
    k = recur.shape[1]
    g_in, g_rec = np.zeros_like(inputs), np.zeros_like(recur)
    carried = np.zeros((k, n), np.float32)
    order = range(steps - 1, -1, -1) if direction == 0 else range(steps)
    for t in order:
        h, u_new, gates, raw, new = kept[t]
        z, r = gates[:k], gates[k:]
        g = grad_states[t] + carried
        g_raw = g * (1 - z) * (np.abs(raw) < 1)
        g_z = g * (h - new) * ((z > 0) & (z < 1))
        g_r = g_raw * u_new * ((r > 0) & (r < 1))
        g_u = np.concatenate([g_z, g_r, g_raw * r])
        g_a = np.concatenate([g_z, g_r, g_raw])
        g_rec += g_u @ h.T
        carried = g * z + recur.T @ g_u
        for row in range(3 * k):
            g_in[row] += np.bincount(x[t], g_a[row], 256)
    return g_in, g_rec


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 7) -> LanguageModel:
    """Fit to byte windows (n, WINDOW) and their language numbers; the loss is taken at every position."""
    rng = np.random.default_rng(seed)
    k, c = HIDDEN, len(languages)
    params: list[np.ndarray] = []
    for _ in (0, 1):
        inputs = rng.normal(0, 0.3, (3 * k, 256)).astype(np.float32)
        inputs[: 2 * k] += 0.5
        params += [inputs, rng.normal(0, 0.3, (3 * k, k)).astype(np.float32), rng.normal(0, 0.5, (c, k)).astype(np.float32)]
    params.append(np.zeros(c, np.float32))
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    of_language = np.argsort(labels, kind="stable")
    sizes = np.bincount(labels, minlength=c)
    firsts = np.cumsum(sizes) - sizes
    for step in range(1, steps + 1):
        # languages of few passages are seen as often as others
        lang = rng.integers(0, c, min(BATCH, len(windows)))
        pick = of_language[firsts[lang] + (rng.random(len(lang)) * sizes[lang]).astype(int)]
        x, y = np.ascontiguousarray(windows[pick].T), labels[pick]
        runs = [_run(params[3 * d], params[3 * d + 1], x, d, keep=True) for d in (0, 1)]
        logits = sum(np.matmul(params[3 * d + 2], runs[d][0]) for d in (0, 1)) + params[6][:, None]
        delta = _softmax(logits)
        delta[:, y, np.arange(len(y))] -= 1
        delta = (delta * ((x != 0)[:, None, :] / max(1, np.count_nonzero(x)))).astype(np.float32)
        grads: list[np.ndarray] = []
        for d in (0, 1):
            g_out = np.einsum("tcn,tkn->ck", delta, runs[d][0])
            g_in, g_rec = _backward(params[3 * d], params[3 * d + 1], x, d, runs[d][1], np.matmul(params[3 * d + 2].T, delta))
            grads += [g_in, g_rec, g_out]
        grads.append(delta.sum((0, 2)))
        scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((g * g).sum() for g in grads)))))
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            g = g * scale
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return LanguageModel(languages, params[0:6:3], params[1:6:3], params[2:6:3], params[6])


def _id_remainder():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4


def held_out():
    return _id_remainder() == 2


def training_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, passage) of labelled documents that are not held out: SAMPLE_DOCS different passages of each of MAX_LANGUAGES languages, or all.

    The choice goes by a hash of the id, the passage's place by the same hash. Ids and labels are ranked
    first, so that only chosen ids' passages move; these are ranked once more, since an id may have many
    texts. The two rankings and the driver hold no more than the sample's size.
    """
    order = F.xxhash64("doc_id")
    labelled = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = labelled.groupBy(F.col("lang").alias("_known")).agg(F.count(F.lit(1)).alias("_n"))
    known = counts.orderBy(F.desc("_n"), "_known").limit(MAX_LANGUAGES)
    labelled = labelled.join(F.broadcast(known), F.col("lang") == F.col("_known"), "left_semi")

    def first(rows: DataFrame, *ties: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id", *ties))
        return rows.withColumn("n", place).where(F.col("n") <= SAMPLE_DOCS)

    chosen = first(labelled.select("doc_id", "lang", order.alias("o"))).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    start = F.pmod(order, F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))) + 1
    passage = F.col("text").substr(start.cast("int"), F.lit(SAMPLE_CHARS)).alias("passage")
    theirs = labelled.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi")
    passages = first(theirs.select("lang", "doc_id", order.alias("o"), passage).distinct(), "passage")
    return [(r["lang"], r["passage"]) for r in sorted(passages.collect(), key=lambda r: (r["lang"], str(r["doc_id"]), r["passage"]))]


def fit(docs: DataFrame) -> LanguageModel:
    """Train on the documents' own labelled, not held-out rows."""
    sample = training_sample(docs)
    languages = sorted({lang for lang, _ in sample})
    windows, labels = [], []
    for lang, passage in sample:
        data = np.frombuffer(passage.encode(), np.uint8)
        padded = np.zeros(-(-data.size // WINDOW) * WINDOW, np.uint8)
        padded[: data.size] = data
        windows.append(padded.reshape(-1, WINDOW))
        labels += [languages.index(lang)] * len(windows[-1])
    if not labels:
        return LanguageModel([], [], [], [], np.zeros(0))
    return train(np.concatenate(windows), np.array(labels), languages)


#: Windows that are read side by side.
_SIDE = 4096


def _document_scores(model: LanguageModel, texts: pa.StringArray) -> np.ndarray:
    """(documents, languages): the mean probabilities over each text's bytes; null texts have no bytes."""
    wide = texts.type == pa.large_string()
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    per_doc = -(-lengths // WINDOW)
    doc = np.repeat(np.arange(len(texts)), per_doc)
    nth = np.arange(doc.size) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    starts, ends = offsets[doc] + nth * WINDOW, offsets[doc + 1]
    sums = np.zeros((len(texts), len(model.languages)))
    steps = np.arange(WINDOW)[:, None]
    for a in range(0, doc.size, _SIDE):
        at = starts[None, a : a + _SIDE] + steps
        inside = at < ends[None, a : a + _SIDE]
        x = np.where(inside, data[np.minimum(at, data.size - 1)], 0)
        p = model.position_probabilities(x)
        short = ~inside.all(0)
        total = p.sum(0)
        if short.any():
            total[:, short] = (p[:, :, short] * inside[:, None, short]).sum(0)
        for c in range(len(model.languages)):
            sums[:, c] += np.bincount(doc[a : a + _SIDE], total[c], len(texts))
    return sums / np.maximum(lengths, 1)[:, None]


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: LanguageModel, keep_text: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of `docs` with the predicted language and its score, and with all other columns but, unless asked for, text.

    Only the text is looked at. The two new columns are called `names`; `docs` must not have such columns.
    """
    if {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have a column of the name {names[0]} or {names[1]} already")
    languages = np.array([*model.languages, UNDETERMINED], object)
    others = [c for c in docs.columns if c != "text"]
    quoted = [f"`{c.replace('`', '``')}`" for c in others]
    fields = [f"{q} {docs.schema[c].dataType.simpleString()}" for q, c in zip(quoted, others)] + ["text string"] * keep_text
    kept = [*others, *["text"] * keep_text]

    def run(batches):
        for batch in batches:
            letters = np.array(batch.column(len(others) + 1).to_pylist(), bool)
            best, score = np.full(len(letters), len(languages) - 1), np.zeros(len(letters))
            if len(languages) > 1 and len(letters):
                p = _document_scores(model, batch.column(len(others)))
                best[letters], score[letters] = p[letters].argmax(1), p[letters].max(1)
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [pa.array(languages[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    schema = ", ".join([*fields, f"{names[0]} string", f"{names[1]} double"])
    return docs.select(*quoted, "text", has_letter().alias(common.ROW)).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, by a model trained on its labelled rows."""
    model = fit(docs)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
