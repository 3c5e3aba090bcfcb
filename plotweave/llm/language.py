"""Language identification with error-correcting output codes."""

from __future__ import annotations

import itertools
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import cut, held_out, map_texts, uniform

UNDETERMINED = "und"
FEATURES = 1 << 13
#: Bound of the training sample: about this many documents per language are fitted.
SAMPLE_PER_LANGUAGE = 600
#: Bound of the sample over all languages; with many, each has fewer rows (one at least).
SAMPLE = 12_000
#: A text is ambiguous if the second codeword's loss is within this part of the mean loss per bit.
AMBIGUITY = 0.05

_LETTER = re.compile(r"[^\W\d_]")
# Letters stay, other ASCII characters become a blank.
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """(n, bits) matrix of -1 and 1: all splits for up to six classes, else random rows far apart."""
    if n <= 6:
        rows = [b for b in itertools.product((1, -1), repeat=n) if b[0] == 1 and min(b) < 0]
        return np.array(rows, np.float32).reshape(-1, n).T.copy()
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(n)))
    drawn = (rng.choice(np.array([-1, 1], np.float32), (n, bits)) for _ in range(40))
    return max(drawn, key=lambda c: (bits - np.abs(c @ c.T - bits * np.eye(n, dtype=np.float32))).min())


def ngram_features(texts: pa.Array) -> np.ndarray:
    """(rows, FEATURES) float32: square roots of the shares of hashed 2- and 3-grams of lower-case bytes.

    Whole texts; non-letters of ASCII count as blanks. Rows without n-grams are zero.
    """
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, text in enumerate(texts.to_pylist()):
        x = np.frombuffer((text or "").lower().encode("utf-8", "replace").translate(_PLAIN), np.uint8).astype(np.uint32)
        if len(x) < 2:
            continue
        two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + x[2:] * np.uint32(0x27D4EB2F)
        keys = np.concatenate([two, three]) >> np.uint32(19)
        counts = np.bincount(keys, minlength=FEATURES)
        out[i] = np.sqrt(counts / len(keys))
    return out


def fit_bits(x: np.ndarray, labels: np.ndarray, codes: np.ndarray, rounds: int = 120) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic classifiers of all bits at once: weights, offsets and a trust for each bit.

    A bit's trust is the logarithm of its odds of being right on the training rows, so
    weak bits count less when codewords are compared.
    """
    sign = codes[labels]
    share = np.bincount(labels, minlength=len(codes))[labels]
    row = (1.0 / share / len(codes)).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = -sign * row / (1 + np.exp(np.clip(sign * (x @ w + b), -30, 30)))
        gw = x.T @ g + 1e-6 * w
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        b -= 0.5 * g.sum(0)
    right = (np.sign(x @ w + b) == sign).astype(np.float32)
    right = np.clip((right * row).sum(0) / row.sum(), 0.51, 0.999)
    return w, b, np.log(right / (1 - right)).astype(np.float32)


def decode(margins: np.ndarray, codes: np.ndarray, trust: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, its share of exp(-loss), and whether another is about as near."""
    if codes.shape[1] == 0:
        n = len(margins)
        return np.zeros(n, int), np.ones(n), np.zeros(n, bool)
    loss = np.logaddexp(0, -margins[:, None, :] * codes[None]) @ trust
    best = loss.argmin(1)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    order = np.sort(loss, 1)
    close = order[:, 1] - order[:, 0] < AMBIGUITY * trust.sum()
    return best, (p.max(1) / p.sum(1)).astype(np.float64), close


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> dict:
    """Model from rows with text and lang; about ``per_language`` rows of each language, chosen by hash.

    All languages are learned; together they draw about SAMPLE rows, so one task fits them.
    No rows give a model without languages.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    names = sorted(r["lang"] for r in sizes.select("lang").collect())
    model = {"languages": names, "codes": codewords(max(1, len(names)))}
    if len(names) < 2:
        return model
    most = max(1, min(per_language, SAMPLE // len(names)))
    part = sizes.select("lang", F.least(F.lit(1.0), most / F.col("n")).alias("part"))
    drawn = rows.withColumn("size", F.length("text")).join(part, "lang").where(uniform("language", "doc_id", "size") < F.col("part"))
    codes = model["codes"]

    def fit(batches):
        texts, langs = [], []
        for b in batches:
            texts.append(ngram_features(b.column("text")))
            langs += b.column("lang").to_pylist()
        if texts:
            number = {x: i for i, x in enumerate(names)}
            labels = np.array([number[x] for x in langs])
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit_bits(np.concatenate(texts), labels, codes))]})

    # The draw is shuffled to the task that fits; merging partitions would make it scan the table as well.
    fitted = drawn.select("text", "lang").repartition(1).mapInArrow(fit, "model binary").collect()
    model["bits"] = pickle.loads(fitted[0]["model"]) if fitted else None
    return model


def identify(docs: DataFrame, model: dict, keep: list[str], prefix: str = "") -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred, score and ambiguous, these three under ``prefix``.

    The whole text is read. Null texts and texts without a letter, and all texts if the
    model knows no language, give ``und`` with score 0.
    """
    names, codes = model["languages"], model["codes"]
    bits = model.get("bits") or (
        np.zeros((FEATURES, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32), np.ones(codes.shape[1], np.float32)
    )
    w, b, trust = bits
    inner = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    added = [f"{prefix}{c}" for c in ("lang_pred", "score", "ambiguous")]

    def run(batch):
        texts = batch.column("text")
        best, score, close = [], [], []
        for start in range(0, len(texts), 256):
            x, y, z = decode(ngram_features(texts.slice(start, 256)) @ w + b, codes, trust)
            best.append(x)
            score.append(y)
            close.append(z)
        best, score, close = (np.concatenate(x) for x in (best, score, close))
        known = np.array([bool(names) and t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)
        lang = [names[i] if ok else UNDETERMINED for i, ok in zip(best, known, strict=True)]
        new = [pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(close & known)]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *new], names=[*keep, *added])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    kinds = [f"`{name}` {kind}" for name, kind in zip(added, ("string", "double", "boolean"), strict=True)]
    return map_texts(inner, run, ", ".join([*fields, *kinds]))


def language_id(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) per row; learned from rows that are not held out.

    Repeated rows get equal answers, extra columns are not read, an empty table gives no rows.
    """
    fold = docs.withColumn("held", held_out(5, 0))
    model = train(fold.where(~F.col("held")), per_language)
    plain = docs.select("doc_id", "text", held_out(5, 0).alias("held_out"))
    return identify(plain, model, ["doc_id", "held_out"])


def reject_unknown(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """``docs`` without rows whose language is undetermined or whose two nearest codewords lie about as near."""
    model = train(docs.where(~held_out(5, 0)), per_language)
    named = identify(docs, model, docs.columns, "language_id_")
    sure = (F.col("language_id_lang_pred") != UNDETERMINED) & ~F.col("language_id_ambiguous")
    return named.where(sure).select(*docs.columns)
