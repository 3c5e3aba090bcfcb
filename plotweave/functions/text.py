"""Text normalization and string similarity."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotweave.functions.geometry import col

_NOT_ASCII = r"[^\x00-\x7F]"


def _per_distinct(fn):
    """Run a string helper once per distinct value of the batch."""

    def run(values: pa.Array) -> pa.Array:
        encoded = values.dictionary_encode()
        words = pa.array([None if w is None else fn(w) for w in encoded.dictionary.to_pylist()], pa.string())
        return words.take(encoded.indices)

    return run


def _fold_text(value: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", value).casefold()).split())


def _fold_key(value: str) -> str:
    return re.sub(r"[_\-.\s/]+", " ", unicodedata.normalize("NFKC", value).strip().lower()).strip()


@F.arrow_udf(T.StringType())
def _fold_text_udf(values: pa.Array) -> pa.Array:
    return _per_distinct(_fold_text)(values)


@F.arrow_udf(T.StringType())
def _fold_key_udf(values: pa.Array) -> pa.Array:
    return _per_distinct(_fold_key)(values)


def _ascii_or(value: Column, ascii_form: Column, udf) -> Column:
    """JVM expression for ASCII rows; only other rows are sent to the Python helper."""
    special = value.rlike(_NOT_ASCII)
    return F.when(special, udf(F.when(special, value))).otherwise(ascii_form)


def _ascii_text(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", " ")
    return F.trim(F.regexp_replace(spaced, r"[\s\x1c-\x1f]+", " "))


def normalize_text(value) -> Column:
    """Compatibility-normalized, case-folded, punctuation to spaces, spaces collapsed; null becomes ''."""
    text = col(value).cast("string")
    return F.coalesce(_ascii_or(text, _ascii_text(text), _fold_text_udf), F.lit(""))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _fold_texts_udf(rows: pa.Array) -> pa.Array:
    fold = _per_distinct(_fold_text)
    return pa.ListArray.from_arrays(rows.offsets, fold(rows.values), mask=rows.is_null())


def normalize_texts(texts: list[Column]) -> Column:
    """:func:`normalize_text` of several columns as one array, with at most one trip to Python."""
    raw = F.array(*[F.coalesce(t.cast("string"), F.lit("")) for t in texts])
    special = F.concat_ws("", raw).rlike(_NOT_ASCII)
    return F.when(special, _fold_texts_udf(F.when(special, raw))).otherwise(F.transform(raw, _ascii_text))


NUMBER_TEXT = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def normalize_identifier(value) -> Column:
    return F.regexp_replace(normalize_text(value), "[^a-z0-9]", "")


def normalize_key(value) -> Column:
    """Field key: compatibility-normalized, lower case, separators to single spaces."""
    text = col(value).cast("string")
    ascii_form = F.trim(F.regexp_replace(F.lower(F.trim(text)), r"[_\-.\s/]+", " "))
    return F.coalesce(_ascii_or(text, ascii_form, _fold_key_udf), F.lit(""))


def numeric_value(value) -> Column:
    """Lenient number; null for booleans and for text that is not a number, as ``12F``."""
    value = col(value)
    kind = F.typeof(value)
    number = F.when(value.cast("string").rlike(NUMBER_TEXT), value.cast("string").try_cast("double"))
    return F.when(kind == "boolean", F.lit(None).cast("double")).otherwise(number)


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word sweep per character of b."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@lru_cache(1 << 17)
def ratio(a: str, b: str) -> float:
    """Insert/delete similarity 0..100."""
    if a == b:
        return 100.0
    return 200.0 * _common_subsequence(a, b) / (len(a) + len(b))


def _ratios(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Similarity of two flat text arrays, NaN where either is null; each distinct pair is computed once."""
    out = np.full(len(a), np.nan)
    known = np.flatnonzero(pc.and_(pc.is_valid(a), pc.is_valid(b)).to_numpy(zero_copy_only=False))
    if not len(known):
        return out
    left, right = (x.take(pa.array(known)).dictionary_encode() for x in (a, b))
    n = len(right.dictionary)
    pair = left.indices.to_numpy().astype(np.int64) * n + right.indices.to_numpy()
    distinct, place = np.unique(pair, return_inverse=True)
    words_a, words_b = left.dictionary.to_pylist(), right.dictionary.to_pylist()
    values = np.array([ratio(words_a[p // n], words_b[p % n]) for p in distinct.tolist()])
    out[known] = values[place]
    return out


@F.arrow_udf(T.DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Insert/delete similarity 0..100 of two text columns."""
    return pa.array(_ratios(a, b), pa.float64(), from_pandas=True)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def similarities(a: pa.Array, b: pa.Array) -> pa.Array:
    """Element-wise similarity of two text arrays up to the shorter; null where either side is null or empty."""
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
    least = np.minimum(*sizes)
    inner = np.arange(least.sum()) - np.repeat(np.cumsum(least) - least, least)
    flat = [
        x.flatten().take(pa.array(np.repeat(np.cumsum(n) - n, least) + inner)) for x, n in zip((a, b), sizes)
    ]
    flat = [pc.if_else(pc.equal(x, ""), pa.scalar(None, x.type), x) for x in flat]
    values = pa.array(_ratios(*flat), pa.float64(), from_pandas=True)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(least)), pa.int32()), values)
