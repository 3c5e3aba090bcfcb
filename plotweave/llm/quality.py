"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import held_out, map_texts, raw, uniform

#: A text is read in chunks of CHUNK bytes, each sharing OVERLAP bytes with the next.
CHUNK, OVERLAP = 512, 64
#: Filters see WIDTH bytes of EMBED learned numbers and move by STRIDE.
WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 8, 4, 8, 32, 16
#: Bound of the training sample in documents, drawn by hash.
SAMPLE = 1500
THRESHOLD = 0.7

_PLACES = (CHUNK - WIDTH) // STRIDE + 1


def chunks_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, row of each chunk). Chunks cover every byte; zero bytes fill the last; an empty text has one."""
    lengths = np.diff(offsets)
    n = np.maximum(1, -(-(lengths - OVERLAP) // (CHUNK - OVERLAP)))
    rows = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    begin = k * (CHUNK - OVERLAP)
    at = (offsets[:-1][rows] + begin)[:, None] + np.arange(CHUNK)
    inside = (begin[:, None] + np.arange(CHUNK)) < lengths[rows][:, None]
    padded = np.append(data, np.uint8(0))
    return np.where(inside, padded[np.minimum(at, len(data))], 0).astype(np.uint8), rows


def _windows(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(chunks, places, WIDTH * EMBED): what each place of the filters sees."""
    seen = np.lib.stride_tricks.sliding_window_view(table[x].reshape(len(x), CHUNK * EMBED), WIDTH * EMBED, axis=1)
    return np.ascontiguousarray(seen[:, :: STRIDE * EMBED])


def logits(x: np.ndarray, net: dict) -> np.ndarray:
    """One number per chunk: filters, maximum over the chunk, a hidden layer."""
    pre = _windows(x, net["table"]).reshape(-1, WIDTH * EMBED) @ net["filters"]
    top = np.maximum(pre.reshape(len(x), _PLACES, FILTERS).max(1) + net["shift"], 0)
    return np.tanh(top @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 900, size: int = 64, seed: int = 3) -> dict:
    """Adam on log loss of chunks under their document's label; ``weight`` is a chunk's chance to be drawn."""
    rng = np.random.default_rng(seed)
    net = {
        "table": rng.normal(0, 0.5, (256, EMBED)),
        "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5 * 2, (WIDTH * EMBED, FILTERS)),
        "shift": np.zeros(FILTERS),
        "w1": rng.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)),
        "b1": np.zeros(HIDDEN),
        "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN),
        "b2": np.zeros(()),
    }
    net = {k: v.astype(np.float32) for k, v in net.items()}
    m, v = ({k: np.zeros_like(a) for k, a in net.items()} for _ in range(2))
    chance = weight / weight.sum()
    for t in range(1, rounds + 1):
        pick = rng.choice(len(x), size, p=chance)
        xb, yb = x[pick], y[pick]
        win = _windows(xb, net["table"])
        pre = win.reshape(-1, WIDTH * EMBED) @ net["filters"]
        pre = pre.reshape(size, _PLACES, FILTERS)
        place = pre.argmax(1)
        top = np.take_along_axis(pre, place[:, None], 1)[:, 0] + net["shift"]
        act = np.maximum(top, 0)
        hid = np.tanh(act @ net["w1"] + net["b1"])
        p = 1 / (1 + np.exp(-(hid @ net["w2"] + net["b2"])))
        d = ((p - yb) / size).astype(np.float32)
        dhid = d[:, None] * net["w2"] * (1 - hid * hid)
        dtop = (dhid @ net["w1"].T) * (top > 0)
        seen = win[np.arange(size)[:, None], place]
        dbytes = (dtop[:, :, None] * net["filters"].T[None]).reshape(size, FILTERS, WIDTH, EMBED)
        ids = xb[np.arange(size)[:, None, None], place[:, :, None] * STRIDE + np.arange(WIDTH)]
        table = np.zeros_like(net["table"])
        np.add.at(table, ids.ravel(), dbytes.reshape(-1, EMBED))
        grads = {
            "table": table,
            "filters": np.einsum("nf,nfk->kf", dtop, seen),
            "shift": dtop.sum(0),
            "w1": act.T @ dhid,
            "b1": dhid.sum(0),
            "w2": hid.T @ d,
            "b2": d.sum(),
        }
        rate = 0.01 * min(1.0, 2 * (1 - t / (rounds + 1)))
        for k, g in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net[k] = (net[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def score(texts: pa.Array, net: dict | None) -> np.ndarray:
    """Probability per text: the logistic of the mean of its chunks' numbers."""
    if net is None:
        return np.full(len(texts), 0.5)
    offsets, data = raw(texts)
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    begin = 0
    while begin < len(texts):  # bounded by bytes, so that a step's windows stay small
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + (64 << 10), "right")) - 1)
        x, rows = chunks_of(offsets[begin : end + 1] - offsets[begin], data[offsets[begin] : offsets[end]])
        for at in range(0, len(x), 128):
            part = rows[at : at + 128] + begin
            np.add.at(total, part, logits(x[at : at + 128], net))
            np.add.at(count, part, 1)
        begin = end
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Network from the labelled rows of ``docs`` that are not held out, at most about ``sample`` of them.

    Rows are drawn by a hash of the id; labels other than 0 and 1 and null texts are left
    out. None if no row of either class is left.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(4, 2)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    part = min(1.0, sample / max(1, n))
    drawn = known.where(uniform("quality", "doc_id") < part)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(drawn, "doc_id").select("text", "quality")

    def run(batches):
        xs, ys, ws = [], [], []
        for batch in batches:
            x, row = chunks_of(*raw(batch.column("text")))
            xs.append(x)
            ys.append(batch.column("quality").to_numpy(zero_copy_only=False)[row].astype(np.float32))
            ws.append(1 / np.sqrt(np.bincount(row)[row]))
        if xs and 0 < np.concatenate(ys).mean() < 1:
            net = fit(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))
            yield pa.RecordBatch.from_pydict({"net": [pickle.dumps(net)]})

    # The draw is shuffled to the task that fits; merging partitions would make it scan the table as well.
    got = rows.repartition(1).mapInArrow(run, "net binary").collect()
    return pickle.loads(got[0]["net"]) if got else None


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    Every byte of every text is read. Null is the empty text, which gets the score of one
    chunk of zero bytes. Repeated rows get equal scores, extra columns are not read, an
    empty table gives no rows; without labels of both classes every score is 0.5.
    """
    net = train(docs, labels, sample)

    def run(batch):
        s = score(batch.column("text"), net)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
            names=["doc_id", "held_out", "score", "predicted"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", held_out(4, 2).alias("held_out"), "text")
    return map_texts(plain, run, f"doc_id {kind}, held_out boolean, score double, predicted int")
