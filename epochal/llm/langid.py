"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows; the largest answer of
each filter feeds a softmax. The network is trained in numpy on windows of labelled texts.
A text's answers are averaged over all its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WIDTHS, FILTERS, LENGTH = (2, 3, 4), 16, 192
#: Bounds of the training sample: languages (the most frequent; rarer labels are taken for noise), documents of each, all documents
#: (each language has its equal part, 20 at least), windows of a document.
LANGUAGES, DOCUMENTS, ALL_DOCUMENTS, WINDOWS = 1000, 500, 32_000, 3
#: Bytes of texts that are cut into windows at once; a longer text is by itself.
SLICE = 1_000_000
STEPS, BATCH, RATE = 260, 96, 0.02
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """filters: for each width an array (width, 256, FILTERS) of what each byte adds at each place."""

    languages: list[str]
    filters: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def _cut(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts (rows of LENGTH bytes, filled with 0), of which text, and their weight."""
    rows = [max(1, -(-len(r) // LENGTH)) for r in raw]
    whole = b"".join([r.ljust(n * LENGTH, b"\0") for r, n in zip(raw, rows)])
    owner = np.repeat(np.arange(len(raw)), rows)
    x = np.frombuffer(whole, np.uint8).reshape(-1, LENGTH)
    weight = np.full(len(x), 1.0)
    ends = np.cumsum(rows) - 1
    weight[ends] = [max(1, len(r) - (n - 1) * LENGTH) / LENGTH for r, n in zip(raw, rows)]
    return x, owner, weight


def fit(windows: list[bytes], languages: list[str], labels: np.ndarray, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    x = np.stack([np.frombuffer(w[:LENGTH].ljust(LENGTH, b"\0"), np.uint8) for w in windows])
    filters = [rng.normal(0, 0.3 / w**0.5, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    weights = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
    params = [*filters, weights, np.zeros(len(languages), np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    share = np.bincount(labels, minlength=len(languages)) * len(languages) / len(labels)
    columns = np.arange(FILTERS)
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(x), BATCH)
        xb, yb = x[pick], labels[pick]
        tops, places = [], []
        for f in params[:-2]:
            w = len(f)
            conv = sum(f[j][xb[:, j : LENGTH - w + 1 + j]] for j in range(w))
            at = conv.argmax(1)
            places.append(at)
            tops.append(np.take_along_axis(conv, at[:, None], 1)[:, 0])
        raw = np.concatenate(tops, 1)
        hidden = np.maximum(raw, 0)
        z = hidden @ params[-2] + params[-1]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(BATCH), yb] -= 1
        p *= (1 / np.maximum(share[yb], 0.05) / BATCH)[:, None]
        back = (p @ params[-2].T) * (raw > 0)
        grads = []
        for k, f in enumerate(params[:-2]):
            g, own = np.zeros_like(f), back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(len(f)):
                np.add.at(g[j], (np.take_along_axis(xb, places[k] + j, 1), columns[None]), own)
            grads.append(g)
        grads += [hidden.T @ p + 1e-4 * params[-2], p.sum(0)]
        rate = RATE * (1 - 0.9 * step / STEPS)
        for q, g, (a, b) in zip(params, grads, moments):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(languages, params[:-2], params[-2], params[-1])


def train(labelled: DataFrame, seed: int = 5) -> Model:
    """labelled: doc_id, text, lang. Fits on a bounded sample, alike on every run: of each of the LANGUAGES most
    frequent languages as many documents as the bounds above give it, by a hash of the id, WINDOWS windows spread over each text.
    Rows of null text, null lang or no letter don't count; without any other row the model knows no language."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Model([], [], np.zeros((0, 0)), np.zeros(0))
    each = max(20, min(DOCUMENTS, ALL_DOCUMENTS // len(languages)))
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2.0 * each / r["count"]))]), F.col("lang"))
    draw = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "lang")
    picked = rows.where(F.pmod(draw, F.lit(1 << 30)) < share * (1 << 30))
    n = F.length("text")
    parts = F.array(*[F.substring("text", (1 + F.floor(F.greatest(n - LENGTH, F.lit(0)) * k / max(1, WINDOWS - 1))).cast("int"), F.lit(LENGTH)) for k in range(WINDOWS)])
    picked = picked.select("lang", draw.alias("draw"), F.array_distinct(parts).alias("parts"))
    first = Window.partitionBy("lang").orderBy("draw", "parts")
    picked = picked.withColumn("row", F.row_number().over(first)).where(F.col("row") <= each).orderBy("lang", "row").collect()
    windows = [(_bytes(p), languages.index(r.lang)) for r in picked for p in r.parts]
    return fit([w for w, _ in windows], languages, np.array([y for _, y in windows]), seed)


class Predictor:
    def __init__(self, model: Model):
        self.model = model
        two, three, four = model.filters
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        self.opening = np.ascontiguousarray(np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], 1))
        self.third, self.closing = np.ascontiguousarray(three[2]), np.ascontiguousarray(pair(four[2], four[3]))

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        m = self.model
        x, owner, weight = _cut([_bytes(t) for t in texts])
        z = np.empty((len(x), len(m.languages)), np.float32)
        for s in range(0, len(x), 64):
            b = x[s : s + 64]
            pairs = (b[:, :-1].astype(np.int32) << 8) | b[:, 1:]
            conv = self.opening.take(pairs, axis=0)  # places 0 to LENGTH - 2
            two, three, four = (conv[:, : LENGTH - w + 1, k * FILTERS : (k + 1) * FILTERS] for k, w in enumerate(WIDTHS))
            three += self.third.take(b[:, 2:], axis=0)
            four += self.closing.take(pairs[:, 2:], axis=0)
            hidden = np.concatenate([two.max(1), three.max(1), four.max(1)], 1)
            z[s : s + 64] = np.maximum(hidden, 0) @ m.weights + m.bias
        total = np.zeros((len(texts), z.shape[1]))
        np.add.at(total, owner, z * weight[:, None])
        total /= np.bincount(owner, weight, len(texts))[:, None]
        p = np.exp(total - total.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [m.languages[k] for k in best], p[np.arange(len(p)), best].tolist()


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for k, t in enumerate(texts):
        if k > begin and (size + len(t or "") > SLICE or k - begin >= 256):
            yield begin, k - begin
            begin, size = k, 0
        size += len(t or "")
    yield begin, len(texts) - begin


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two more columns, called names: the language and its score (0 to 1, the share that the softmax gives it). Only
    the text is looked at, all of it, so repeated rows get the same.

    The language is und, with score 0, where text is null or has no letter, and everywhere if the model knows
    no language. Columns of docs of these two names are replaced; an empty table gives an empty result.
    """
    lang_name, score_name = names
    docs = docs.drop(lang_name, score_name)
    names, at = docs.columns, docs.columns.index(text_col)
    given = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = Predictor(given.value) if given.value.languages else None
        for whole in batches:
            every = whole.column(at).to_pylist()
            for begin, size in _slices(every):
                batch, texts = whole.slice(begin, size), every[begin : begin + size]
                named = [k for k, t in enumerate(texts) if t and ask and _LETTER.search(t)]
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                if named:
                    for k, lang, score in zip(named, *ask([texts[k] for k in named])):
                        langs[k], scores[k] = lang, score
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, lang_name, score_name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(lang_name, "string").add(score_name, "double"))
