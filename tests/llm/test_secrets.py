"""Secret scans: base spans by the stated rules, and secrets under layers of encoding."""

import base64
import gzip
import hashlib
import re
import zlib
from urllib.parse import quote

from helpers import awkward

from plotweave.llm import secrets

SECRET = "password=hunter2secret"


def stated(text):
    found = []
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, m.end())] * (len(m[1]) >= 6)
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def encode(text, layers):
    for layer in layers:
        raw = text.encode()
        text = {
            "url": lambda: "".join(f"%{b:02x}" for b in raw),
            "quote": lambda: quote(text, safe=""),
            "unicode": lambda: "".join(f"\\u{ord(c):04x}" for c in text),
            "base64": lambda: base64.b64encode(raw).decode(),
            "urlsafe": lambda: base64.urlsafe_b64encode(raw).decode().rstrip("="),
            "gzip": lambda: base64.b64encode(gzip.compress(raw)).decode(),
            "zlib": lambda: base64.b64encode(zlib.compress(zlib.compress(raw))).decode(),
        }[layer]()
    return text


def test_layers_map_to_the_outer_span():
    chains = [["url"], ["unicode"], ["base64"], ["urlsafe"], ["gzip"], ["zlib"], ["base64", "base64", "url"],
              ["gzip", "url", "base64"], ["unicode", "base64", "gzip", "unicode"], ["zlib"] * 6]
    for chain in chains:
        hidden = encode(f"so {SECRET} it is", chain)
        base, spans, layers = secrets.scan(f"é before {hidden} after")
        start = 9
        assert ("assign" in {k for _, _, k in spans}) and layers >= len(set(chain)), chain
        assert any(k == "assign" and s <= start and e >= start + len(hidden) - 2 for s, e, k in spans), chain
        assert secrets._joined(base) == stated(f"é before {hidden} after")


def test_cycles_and_bombs_end():
    assert secrets.scan(base64.b64encode(zlib.compress(b"a" * (20 << 20) + SECRET.encode())).decode())[1]
    loop = "%25" * 40 + "41"
    assert secrets.scan(loop)[2] >= 1
    assert secrets.scan("A" * 100_000)[1] == [] == secrets.scan("\\u0041" * 3)[1]


def test_clean_text_has_no_spans(spark):
    assert secrets.scan("Plain words/with+signs and-long_names abcdefghijklmnop 50% off, 100%25 sure.")[1] == []


def test_base_columns_on_whole_tables(spark):
    extra = ["TOKEN : 'abc-DEF=='", "api_key='short'", "apikey=\"longer_1\" AKIA" + "A1" * 9, "AKIAAKIA" + "Z" * 8, "f" * 23 + "g" + "0a" * 12,
             "to\u212aen=abcdefgh pa\u017fsword=abcdefgh", "secret=secret=secret=abc", "x" * 200_000 + " passwd=abcdef"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for df in (docs, awkward(spark, extra)):
        want = sorted((str(r.doc_id), stated(r.text or "")) for r in df.select("doc_id", "text").collect())
        rows = secrets.secret_scan(df).collect()
        assert sorted((str(r.doc_id), r.base_sha256) for r in rows) == sorted((i, hashlib.sha256(s.encode()).hexdigest()) for i, s in want)
        assert sum(r.n_assign + r.n_access + r.n_hex for r in rows) == sum(s.count(":") // 2 for _, s in want)
    assert secrets.secret_scan(docs.where("false")).count() == 0


def test_redact_keeps_the_rest(spark):
    got = {r.doc_id: r.text for r in secrets.redact(awkward(spark, [f"a {SECRET} b {encode(SECRET, ['base64'])} c"])).collect() if r.doc_id}
    assert got[100] == "a [SECRET] b [SECRET] c" and got[1] is None and got[2] == "" and got[3] == "short"


def test_short_and_shifted_stretches_are_opened():
    b64 = encode(SECRET, ["base64"])
    two = gzip.compress(b"nothing in the first member, ") + gzip.compress(f"but {SECRET} in the second".encode())
    split = gzip.compress(b"password=hun") + gzip.compress(b"ter2secret")
    percent = lambda data: "".join(f"%{b:02x}" for b in data)
    hidden = ["password%3Dhunter2secret", '"q":"token\\u003dabcdef123"', f"x/{b64}", f"id-{b64}", f"data/{b64}", f"some/long_path-of/words/{b64}", f"{b64}/x",
              f"data/{encode(SECRET, ['gzip'])}", f"some/dir-1/{encode(SECRET, ['zlib'])}", f"blob{encode(SECRET, ['gzip'])}",
              percent(gzip.compress(SECRET.encode())), percent(zlib.compress(SECRET.encode())), "".join(f"\\u{b:04x}" for b in gzip.compress(SECRET.encode())),
              base64.b64encode(two).decode(), base64.b64encode(split).decode()]
    for text in hidden:
        assert {k for _, _, k in secrets.scan(f"a {text} b")[1]} == {"assign"}, text
    assert secrets.scan("see docs/guide/some-long_page/with+signs and 5%25 of a\\u0020b")[1] == []


def test_escapes_decode_in_place():
    cases = {
        "password %3D hunter2secret": (0, 26), '{"a":"password \\u003d hunter2secret"}': (6, 35), 'p%61ssword: "hunter2secret"': (0, 26),
        "x token%253Dhunter2secret y": (2, 25), "é p%61ssword=%C3%A9 secret\\u003ahunter2": (20, 39),
    }
    for text, (start, end) in cases.items():
        assert (start, end, "assign") in secrets.scan(text)[1], text
        assert secrets.scan(text)[0] == []
    assert secrets.scan("100% of password: hunter2secret, 5%20off")[1] == [(8, 31, "assign")]


def test_lines_and_other_streams():
    import base64
    import bz2
    import gzip
    import lzma
    import zlib

    plain = b"the password = hunter2secret is here " + bytes(range(32, 90))
    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    forms = [gzip.compress(plain), bz2.compress(plain), lzma.compress(plain), raw.compress(plain) + raw.flush(), zlib.compress(plain)]
    for data in forms:
        one = base64.b64encode(data).decode()
        broken = "\n".join(one[i : i + 40] for i in range(0, len(one), 40))
        for text in (f"see {one} end", f"Mail:\n{broken}\n"):
            assert any(k == "assign" for _, _, k in secrets.scan(text)[1]), (data[:4], text)


def test_thousands_of_layers_end(spark):
    import base64
    import zlib

    data = b"password = hunter2secret"
    for _ in range(10_000):
        data = zlib.compress(data, 0)
    text = base64.b64encode(data).decode()
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.secret_scan(df).first().spans.startswith("assign:0:")


def test_random_nestings(spark):
    import base64
    import bz2
    import gzip
    import random
    import zlib
    from urllib.parse import quote

    rng = random.Random(12)
    wraps = [
        lambda t: "".join(f"%{b:02X}" for b in t.encode()), lambda t: quote(t, safe=""),
        lambda t: "".join(f"\\u{ord(c):04x}" for c in t), lambda t: base64.b64encode(t.encode()).decode(),
        lambda t: base64.urlsafe_b64encode(gzip.compress(t.encode())).decode(), lambda t: base64.b64encode(zlib.compress(t.encode())).decode(),
        lambda t: base64.b64encode(bz2.compress(gzip.compress(t.encode()))).decode(),
    ]
    missed = []
    for _ in range(200):
        text = f"a note, password = hunter{rng.randint(100, 999)}secret, and more"
        chain = [rng.choice(wraps) for _ in range(rng.randint(1, 4))]
        for wrap in chain:
            text = f"{rng.choice(['', 'see '])}{wrap(text)}{rng.choice(['', ' end'])}"
        if not any(k == "assign" for _, _, k in secrets.scan(text)[1]):
            missed.append(text[:80])
    assert not missed


def test_a_deflate_stream_without_a_head_is_read_to_its_end():
    """The secret lies behind the first piece, and once across the border of two."""
    for before in (secrets.PIECE_BYTES + 1000, secrets.PIECE_BYTES - 10):
        packer = zlib.compressobj(wbits=-15)
        raw = packer.compress(b"plain words " * (before // 12) + b" " * (before % 12) + SECRET.encode() + b" plain" * 1000) + packer.flush()
        run = base64.b64encode(raw).decode()
        assert ("assign" in {kind for _, _, kind in secrets.scan(f"see {run} .")[1]}), before
        assert "assign" not in {kind for _, _, kind in secrets.scan(base64.b64encode(raw + b"more").decode())[1]}
