"""Quality: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over every position, and each filter's largest response is kept for each
chunk (CHUNK bytes, overlapping by half, covering the whole document). A small layer turns a chunk's responses into
features; their maximum and mean over the document's chunks give one probability of label 1. All layers are trained
together by gradient steps (Adam), each over all chunks of the documents it draws, on a bounded sample of labelled rows (SAMPLE_PER_CLASS of either class); the
intercept is corrected for the share of label 1 among all rows it may learn from.

Defined results: null and empty texts are scored as one empty chunk. Every row gets a score; repeated rows get equal
ones. With no labelled rows, or only one class, every score is that share (0.5 without any rows). A null id counts
as not held out. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import id_arrow
from .labelled import SAMPLE_PER_CLASS, remainder, training_sample

HALF = 128
CHUNK = 2 * HALF
WIDTH = 7
EMBED = 8
FILTERS = 24
HIDDEN = 16
#: Chunks whose gradients are held at once.
STEP_CHUNKS = 4096
#: Bytes convolved at once; a longer text goes through in parts.
STRETCH = 1 << 17

Params = dict[str, np.ndarray]


def text_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def responses(data: np.ndarray, p: Params) -> np.ndarray:
    """Each filter's response at each position; ``data`` ends with WIDTH - 1 more bytes than there are positions."""
    n = len(data) - WIDTH + 1
    e = p["embed"][data]
    windows = np.lib.stride_tricks.as_strided(e, (n, WIDTH * EMBED), (e.strides[0], e.strides[1]))
    return windows @ p["filters"]


def halves(data: np.ndarray, p: Params) -> np.ndarray:
    """The largest response of each filter in each HALF bytes of a text."""
    padded = np.concatenate([data, np.zeros(WIDTH - 1 + (len(data) == 0), np.uint8)])
    n, parts = max(1, len(data)), []
    for at in range(0, n, STRETCH):
        r = responses(padded[at : min(n, at + STRETCH) + WIDTH - 1], p)
        parts.append(np.maximum.reduceat(r, np.arange(0, len(r), HALF), axis=0))
    return np.concatenate(parts)


def chunk_inputs(data: np.ndarray, p: Params) -> np.ndarray:
    """Pooled responses of each chunk, and how full it is."""
    h, n = halves(data, p), len(data)
    pooled = np.maximum(h[:-1], h[1:]) if len(h) > 1 else h
    sizes = np.full((len(pooled), 1), 1.0, np.float32)
    sizes[-1] = (n - HALF * (len(pooled) - 1)) / CHUNK
    return np.hstack([np.maximum(pooled + p["bias"], 0.0), sizes])


def head(x: np.ndarray, p: Params) -> float:
    """The logit of a document from its chunks' inputs."""
    h = np.maximum(x @ p["hidden"] + p["hidden_bias"], 0.0)
    return float(np.concatenate([h.max(0), h.mean(0)]) @ p["out"] + p["out_bias"][0])


def score(text: str | None, p: Params) -> float:
    z = head(chunk_inputs(text_bytes(text), p), p) if "filters" in p else float(p["out_bias"][0])
    return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def pooled_places(data: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The largest response of each filter in each chunk of a text, and the byte at which it starts; as halves() has it, for all of the text."""
    padded = np.concatenate([data, np.zeros(WIDTH - 1 + (len(data) == 0), np.uint8)])
    n, tops, places = max(1, len(data)), [], []
    for at in range(0, n, STRETCH):
        r = responses(padded[at : min(n, at + STRETCH) + WIDTH - 1], p)
        short = -len(r) % HALF
        r = np.concatenate([r, np.full((short, FILTERS), -np.inf, r.dtype)]).reshape(-1, HALF, FILTERS)
        place = r.argmax(1)
        tops.append(np.take_along_axis(r, place[:, None, :], 1)[:, 0, :])
        places.append(place + at + HALF * np.arange(len(r))[:, None])
    top, place = np.concatenate(tops), np.concatenate(places)
    if len(top) == 1:
        return top, place
    later = top[1:] > top[:-1]
    return np.where(later, top[1:], top[:-1]), np.where(later, place[1:], place[:-1])


def step(docs: list[np.ndarray], y: np.ndarray, p: Params) -> tuple[float, Params]:
    """Loss and gradients over a few documents, all chunks of each."""
    found = [pooled_places(d, p) for d in docs]
    lens = np.array([len(top) for top, _ in found])
    starts, owner = np.cumsum(lens) - lens, np.repeat(np.arange(len(docs)), lens)
    pooled = np.concatenate([top for top, _ in found]) + p["bias"]
    sizes = np.ones((len(pooled), 1), np.float32)
    sizes[starts + lens - 1, 0] = [(len(d) - HALF * (k - 1)) / CHUNK for d, k in zip(docs, lens)]
    x = np.hstack([np.maximum(pooled, 0), sizes]).astype(np.float32)
    pre = x @ p["hidden"] + p["hidden_bias"]
    h = np.maximum(pre, 0)
    top, mean = np.maximum.reduceat(h, starts, axis=0), np.add.reduceat(h, starts, axis=0) / lens[:, None]
    doc = np.hstack([top, mean])
    z = doc @ p["out"] + p["out_bias"][0]
    q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = -np.mean(y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))
    dz = ((q - y) / len(y)).astype(np.float32)
    g: Params = {"out": doc.T @ dz, "out_bias": np.array([dz.sum()], np.float32)}
    ddoc = dz[:, None] * p["out"][None, :]
    is_top = (h == top[owner]) & (h > 0)
    ties = np.add.reduceat(is_top.astype(np.float32), starts, axis=0)
    dh = is_top * (ddoc[:, :HIDDEN] / np.maximum(ties, 1))[owner] + (ddoc[:, HIDDEN:] / lens[:, None])[owner]
    dpre = (dh * (pre > 0)).astype(np.float32)
    g |= {"hidden": x.T @ dpre, "hidden_bias": dpre.sum(0)}
    dpool = (dpre @ p["hidden"].T)[:, :FILTERS] * (pooled > 0)
    g |= {"bias": dpool.sum(0), "filters": np.zeros_like(p["filters"]), "embed": np.zeros_like(p["embed"])}
    # The window of each chunk's largest response is all that the filters and the embedding learn from.
    padded = [np.concatenate([d, np.zeros(WIDTH, np.uint8)]) for d in docs]
    begins = np.cumsum([0, *map(len, padded[:-1])])
    data, place = np.concatenate(padded), np.concatenate([at for _, at in found]) + begins[owner][:, None]
    for k in range(0, len(place), STEP_CHUNKS):
        part, d = data[place[k : k + STEP_CHUNKS, :, None] + np.arange(WIDTH)], dpool[k : k + STEP_CHUNKS]
        windows = p["embed"][part].reshape(*part.shape[:2], -1)  # chunk, filter, window
        g["filters"] += np.einsum("nfk,nf->kf", windows, d)
        moved, seen = (d[:, :, None] * p["filters"].T[None]).reshape(-1, EMBED), part.ravel()
        g["embed"] += np.stack([np.bincount(seen, moved[:, e], 256) for e in range(EMBED)], 1).astype(p["embed"].dtype)
    return float(loss), g


def fit(texts: list[str], labels: list[int], share: float, steps: int = 1200, batch: int = 32, rate: float = 4e-3, seed: int = 7) -> Params:
    """The network for a sample; ``share`` is the share of label 1 where the sample comes from."""
    logit = lambda v: float(np.log(max(v, 1e-6) / max(1 - v, 1e-6)))
    y = np.asarray(labels, dtype=np.float32)
    if len(y) == 0 or y.min() == y.max():
        return {"out_bias": np.array([logit(share)])}
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    p: Params = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "filters": draw(WIDTH * EMBED, FILTERS), "bias": np.zeros(FILTERS, np.float32), "hidden": draw(FILTERS + 1, HIDDEN), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": draw(2 * HIDDEN), "out_bias": np.zeros(1, np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    data = [text_bytes(t) for t in texts]
    sides = [np.flatnonzero(y == k) for k in (0, 1)]
    for t in range(1, steps + 1):
        picked = np.concatenate([rng.choice(s, batch // 2) for s in sides])
        _, g = step([data[i] for i in picked], y[picked], p)
        now = rate * min(1.0, 2 * (steps - t) / steps + 0.02)
        for k in p:
            first[k] += 0.1 * (g[k] - first[k])
            second[k] += 0.001 * (g[k] ** 2 - second[k])
            p[k] = (p[k] * (1 - now * 0.01) if k in ("filters", "hidden", "out") else p[k]) - now * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
            p[k] = p[k].astype(np.float32)
    p["out_bias"] = p["out_bias"] + np.float32(logit(share))  # the steps saw as many of either class
    return p


def train(docs: DataFrame, labels: DataFrame, held_mod: int = 5, held: int = 0, per_class: int = SAMPLE_PER_CLASS, **options) -> Params:
    """The network for labelled rows that are not held out; ``options`` go to fit()."""
    allowed = remainder(F.col("doc_id"), held_mod) != held
    return fit(*training_sample(docs, labels, "quality", allowed, per_class), **options)


def score_quality(docs: DataFrame, params: Params, threshold: float = 0.3, held_mod: int = 5, held: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. One scan, no shuffle."""
    narrow = docs.select("doc_id", "text")
    id_type = id_arrow(narrow)
    schema = pa.schema([("doc_id", id_type), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score(t, params) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], schema=schema)

    scored = narrow.mapInArrow(run, from_arrow_schema(schema))
    held_out = F.coalesce(remainder(F.col("doc_id"), held_mod) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, params: Params, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; all columns stay, and no shuffle is needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([score(t, params) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
