"""Token alignment against a brute-force version over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

from helpers import awkward, sentences

from plotweave.llm import alignment

A, B = (f"{alignment.FOLDER}/{f}" for f in (alignment.SIDE_A, alignment.SIDE_B))


def pieces(side, text):
    """(id, start, end) of a blank and the text, encoded in one go; None if they do not spell it."""
    whole = (" " + text).encode()
    ids, at, out = side.encode(" " + text).tolist(), 0, []
    for i in ids:
        name = side.flat[side.begin[i] : side.begin[i + 1]].tobytes()
        if whole[at : at + len(name)] != name:
            return None
        out.append((i, at, at + len(name)))
        at += len(name)
    return out if at == len(whole) else None


def brute(texts):
    a, b = alignment.side(A), alignment.side(B)
    rows, counts = [], Counter()
    for text in texts:
        left, right = (pieces(s, text) if text else None for s in (a, b))
        if left is None or right is None:
            rows.append(None)
            continue
        ends = sorted({e for _, _, e in left} & {e for _, _, e in right})
        groups, links, start = [], [], 0
        for stop in ends:
            x, y = ([t for t in side if start < t[2] <= stop] for side in (left, right)) if len(text) < 3000 else (None, None)
            if x is None:
                break
            groups.append(f"{','.join(str(t[0]) for t in x)}|{','.join(str(t[0]) for t in y)}")
            links += [(t[0], u[0]) for t in x for u in y if t[1] < u[2] and u[1] < t[2]]
            start = stop
        rows.append((len(left), len(right), len(ends), links, ";".join(groups)))
        counts.update(set(links))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, text = row
        out.append((n_a, n_b, n_groups, len(links), sum(counts[x] == top[x[0]] for x in links), sum(counts[x] for x in links), text))
    return out


def check(df, digest=False):
    rows = df.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, brute([r.text for r in rows]), strict=True))
    if digest:
        want = Counter({(*k[:-1], hashlib.sha256(k[-1].encode()).hexdigest() if k[-1] else ""): n for k, n in want.items()})
    assert Counter(map(tuple, alignment.align(df, digest=digest).collect())) == want


def test_awkward_rows(spark):
    rng = random.Random(7)
    odd = ["<|endoftext|> <s> </s> <unk> <0x41>", "a  b   c ", "\n\n x\t y \r\n", "  x  y 　 z  w", "it's  don't 'll", "é é ﬁ ▁x ▁ y",
           " ", "  ", " lead", "12 345, 6.7 $8!", "日本語 テスト 日本", "\x1c \x1d a\x85 b", "x" * 300, "�", "a​ b  c  d"]
    texts = odd + ["".join(rng.choices("ab \n\t é　'1.", k=rng.randint(1, 60))) for _ in range(120)] + sentences(rng, 20)
    df = awkward(spark, texts).where("text IS NULL OR length(text) < 3000")
    check(df)
    check(df, digest=True)
    assert alignment.align(df.where("false")).count() == 0


def test_blocks_and_chunks_do_not_matter(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000")
    want = sorted(map(tuple, alignment.align(docs, digest=True).collect()))
    check(docs, digest=True)
    for name, value in (("BLOCK_BYTES", 20_000), ("CHUNK_PAIRS", 7), ("OPEN_ENTRIES", 50), ("ENCODE_BYTES", 10)):
        monkeypatch.setattr(alignment, name, value)
    table = docs.select("doc_id", "text").toArrow()
    rows = [r | {"block": k} for k, t in enumerate(alignment._blocks(iter(table.to_batches()), 20_000)) for r in alignment._records(t, alignment.side(A), alignment.side(B), k, 5, True)]
    assert len({r["block"] for r in rows}) > 10
    backs = merged([r for r in rows if r["kind"] == alignment._HEAD])
    assert {(r["block"], r["radix"], r["seq"]) for r in rows if r["kind"] == alignment._HEAD} == {b[:3] for b in backs}
    import pyarrow as pa

    frame = spark.createDataFrame(pa.Table.from_pylist(rows, alignment._FIELDS)).where("kind <> 0").drop("first", "head")
    back = spark.createDataFrame([(b[0], 0, b[1], b[2], bytearray(b[3])) for b in backs], "block long, kind byte, radix int, seq int, back binary")
    both = frame.unionByName(back, allowMissingColumns=True)
    assert sorted(map(tuple, alignment._sums(both.repartition("block").sortWithinPartitions("block", "radix", "kind", "seq")).collect())) == want


def merged(heads):
    """The heap merge of count_runs in this process, settling at every chunk."""
    import heapq

    import numpy as np

    out = []
    for radix in sorted({h["radix"] for h in heads}):
        runs, heap = [], []
        for h in sorted((h for h in heads if h["radix"] == radix), key=lambda h: h["first"]):
            out += alignment._settled(runs, heap, h["first"] >> 32 << 32)
            a, b, n = alignment._unpack(h["head"], 3)
            heapq.heappush(heap, (h["first"], len(runs)))
            runs.append([h["block"], radix, h["seq"], np.cumsum(a) << 32 | b, n, 0, []])
        out += alignment._settled(runs, heap, 1 << 62)
    return out


def test_whole_texts_equal_their_pieces(spark):
    """Encoding by pieces gives the ids of whole texts, on all texts of a table."""
    import numpy as np
    import pyarrow as pa

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    a, b = alignment.side(A), alignment.side(B)
    assert a.splits and b.splits
    table = pa.table({"doc_id": pa.array(range(len(texts))), "text": texts})
    rows = {r["seq"]: r for r in alignment._records(table, a, b, 0, 3, False) if r["kind"] == alignment._DOC}
    for i, text in enumerate(texts):
        groups = [g.split("|") for g in rows[i]["groups"].split(";")]
        for k, s in enumerate((a, b)):
            assert [int(x) for g in groups for x in g[k].split(",")] == s.encode(" " + text).tolist()
    assert np.isin([rows[0]["n_links"]], [rows[0]["n_a"] + rows[0]["n_b"] - rows[0]["n_groups"]]).all()
