import base64
import gzip
import hashlib
import re
import urllib.parse
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from mnemosaic.llm import queries, secrets

ID = "AKIA" + "Q7" * 8


def brute(text):
    """Base spans by the plainest reading: failing matches consume their text."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for rank, (kind, pattern, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m.group()) >= least]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def base_of(text):
    return [f"{k}:{a}:{b}" for k, a, b, how in secrets.find_secrets(text) if not how]


def test_query_matches_brute_force(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_secret_scan(spark, sf).collect()
    assert len(rows) == len(text) and sum(r.n_assign for r in rows) > 0
    for r in rows:
        want = brute(text[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""} and r.n_hex == sum(x.startswith("hex") for x in want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "api_key", "Secret", "=", ": ", '"', "abc", "AKIA", "Z9Z9Z9Z9", "deadbeef", " ", "ſecret", "K", "\n"]), max_size=14))
def test_base_spans_of_any_text(parts):
    assert base_of("".join(parts)) == brute("".join(parts))


def layered(text):
    return [(k, text[a:b], how) for k, a, b, how in secrets.find_secrets(text) if how]


def test_layers_are_unwrapped_and_mapped():
    line = "note password = hunter2hunter2 " + ID
    enc = base64.b64encode(line.encode()).decode()
    hidden = "".join(f"%{ord(c):02X}" for c in ID)
    assert layered(f"see {hidden} end") == [("access", hidden, "url")]
    escaped = "".join(f"\\u{ord(c):04x}" for c in ID)
    assert layered(f"é {escaped}.") == [("access", escaped, "unicode")]
    got = layered(f"data {enc} end")
    assert {k for k, _, _ in got} == {"assign", "access"} and all(t in enc for _, t, _ in got)
    for packed in (gzip.compress(line.encode(), mtime=0), zlib.compress(line.encode())):
        run = base64.b64encode(packed).decode()
        got = layered(f"blob={run}")
        assert {(k, how) for k, _, how in got} >= {("assign", "compressed"), ("access", "compressed")}
    deep = base64.b64encode(urllib.parse.quote(base64.b64encode(gzip.compress(line.encode(), mtime=0)).decode(), safe="").encode()).decode()
    assert any(how == "base64>url>compressed" or how.endswith("compressed") for _, _, how in layered("a " + deep))


def test_cycles_and_bombs_end():
    text = "QUFB" * 4000
    for _ in range(6):
        text = base64.b64encode(text.encode()).decode()
    secrets.find_secrets(text)
    bomb = base64.b64encode(gzip.compress(b"x" * 30_000_000 + b" token=abcdefgh", mtime=0)).decode()
    assert [k for k, *_ in layered(bomb)] == ["assign"]
    secrets.find_secrets("%25" * 50)


def test_edges_of_input(spark):
    schema = "doc_id long, text string, spans string"
    rows = [(1, None, "x"), (2, "", "x"), (3, "token=abcdef", "x"), (3, "token=abcdef", "x"), (None, ID, "x"), (5, "word " * 100000, "x")]
    got = secrets.secret_spans(spark.createDataFrame(rows, schema)).collect()
    assert sorted(len(r.spans) for r in got) == [0, 0, 0, 1, 1, 1]
    assert secrets.secret_spans(spark.createDataFrame([], schema)).count() == 0


def test_equal_wrapped_secrets_are_found_at_each_place():
    line = f"note password = hunter2hunter2 {ID}"
    inner = base64.b64encode(line.encode()).decode()
    for wrapped in (inner, urllib.parse.quote(inner, safe="").replace("a", "%61"), base64.b64encode(gzip.compress(line.encode(), mtime=0)).decode()):
        twice = base64.b64encode(wrapped.encode()).decode()
        one = secrets.find_secrets(f"x {twice} y\n")
        assert {k for k, *_ in one} == {"assign", "access"}
        step = len(f"x {twice} y\n")
        want = sorted((k, a + i * step, b + i * step, how) for i in range(3) for k, a, b, how in one)
        assert sorted(secrets.find_secrets(f"x {twice} y\n" * 3)) == want


def test_runs_that_are_glued_wrapped_or_hold_odd_bytes():
    line = "note password = hunter2hunter2 " + ID + " end"
    enc = base64.b64encode(line.encode()).decode()
    long = base64.b64encode(("filler words " * 20 + line).encode()).decode()
    wrapped = "\n".join(long[i : i + 76] for i in range(0, len(long), 76))
    odd = base64.b64encode(b"\x00\x01" + line.encode() + b"\xff\x00").decode()
    two = base64.b64encode(gzip.compress(b"first", mtime=0) + gzip.compress(line.encode(), mtime=0)).decode()
    for text in (f"blob_{enc} x", f"conf/{enc} x", f"a-{enc}", f"see\n{wrapped}\nend", f"see\n  {wrapped.replace(chr(10), chr(10) + '  ')} end", odd, f"z_{two}", f"{enc}\n{enc}"):
        got = layered(text)
        assert {k for k, _, _ in got} == {"assign", "access"}, text
    start = f"blob_{enc} x".index(enc)
    spans = {(k, a, b) for k, a, b, how in secrets.find_secrets(f"blob_{enc} x") if how}
    for k, a, b in spans:
        want = line.index("password" if k == "assign" else "AKIA")
        assert a == start + want * 4 // 3


PACK = {
    "url": lambda t, r: "".join(f"%{b:02X}" if r.random() < 0.7 or not 48 <= b < 58 else chr(b) for b in t.encode()),
    "unicode": lambda t, r: "".join(f"\\u{ord(c):04x}" for c in t),
    "base64": lambda t, r: base64.b64encode(t.encode()).decode(),
    "urlsafe": lambda t, r: "n_" + base64.urlsafe_b64encode(t.encode()).decode(),
    "wrapped": lambda t, r: "\n".join(x for x in re.findall(".{1,64}", base64.b64encode(t.encode()).decode())),
    "gzip": lambda t, r: base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode(),
    "zlib": lambda t, r: base64.b64encode(zlib.compress(t.encode())).decode(),
    "bz2": lambda t, r: base64.b64encode(__import__("bz2").compress(t.encode())).decode(),
    "xz": lambda t, r: "q/" + base64.b64encode(__import__("lzma").compress(t.encode())).decode(),
}


def test_secrets_under_random_stacks_of_layers_are_found_and_mapped():
    import random

    rng = random.Random(9)
    plain = {"assign": "password = hunter2hunter2", "access": ID, "hex": "0123456789abcdef" * 2}
    for _ in range(400):
        kind = rng.choice(sorted(plain))
        text = f"some words {plain[kind]} and more"
        stack = [rng.choice(sorted(PACK)) for _ in range(rng.randrange(1, 6))]
        for name in stack:
            text = PACK[name](text, rng)
            if rng.random() < 0.5:
                text = f"x {text} y" if rng.random() < 0.5 else f"line\n{text}\nline"
        inside = f"lead é {text} tail"
        start, end = inside.index(text), inside.index(text) + len(text)
        got = [(a, b) for k, a, b, how in secrets.find_secrets(inside) if k == kind and how]
        assert got and all(start <= a < b <= end for a, b in got), stack


def test_long_inflated_layers_keep_matches_at_window_borders(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 1000)
    nested = base64.b64encode(("filler words " * 200 + ID).encode()).decode()
    wrapped = "\n".join(re.findall(".{1,76}", nested))
    for body in (f"{'w ' * 700}\ntoken = {'a' * 5000}\n{'v ' * 900}", "\n".join(["line of words"] * 300) + "\n" + wrapped + "\n" + "\n".join(["line of words"] * 300)):
        text = base64.b64encode(gzip.compress(body.encode(), mtime=0)).decode()
        assert {k for k, _, _ in layered(text)} & {"assign", "access"}


def test_more_kinds_of_layers():
    import zlib as z

    deflate = z.compressobj(9, z.DEFLATED, -15)
    raw = deflate.compress(b"password = hunter2222 and more of it") + deflate.flush()
    for text in (
        "x " + base64.b64encode(raw).decode() + " y",
        "see \\U00000070assword=hunter2222",
        "q=password+%3D+hunter2222&x=1",
        "x " + base64.b64encode("password=hunter2222".encode("utf-16-le")).decode() + " y",
        "x " + base64.b64encode("password=hunter2222".encode("utf-16-be")).decode() + " y",
    ):
        assert any(k == "assign" for k, *_ in secrets.find_secrets(text)), text


def test_raw_deflate_of_any_length(monkeypatch):
    import random
    import zlib as z

    def packed(plain, end=True):
        deflate = z.compressobj(9, z.DEFLATED, -15)
        return deflate.compress(plain) + (deflate.flush() if end else deflate.flush(z.Z_SYNC_FLUSH))

    rng = random.Random(7)
    lines = "\n".join(" ".join(rng.choices("one two three four".split(), k=9)) for _ in range(400)).encode()
    plain = lines + b"\npassword = hunter2222\n" + lines
    monkeypatch.setattr(secrets, "WINDOW", 1 << 10)
    found = lambda raw: [k for k, *_ in secrets.find_secrets("x " + base64.b64encode(raw).decode() + " y")]
    assert found(packed(plain)) == ["assign"]
    assert found(packed(plain, end=False)) == [] == found(packed(plain) + b"more")


def test_inflated_layers_without_line_ends_stay_bounded(monkeypatch):
    import gzip
    import tracemalloc

    for filler in (b"a", b"<b>", b" "):
        plain = filler * ((8 << 20) // len(filler)) + b" AKIA" + b"Q" * 20 + filler * 100
        text = "x " + base64.b64encode(gzip.compress(plain, 1)).decode() + " y"
        monkeypatch.setattr(secrets, "HELD", 1 << 20)
        monkeypatch.setattr(secrets, "WINDOW", 1 << 18)
        tracemalloc.start()
        found = secrets.find_secrets(text)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert ("access", 2, len(text) - 2) in {s[:3] for s in found} and most < 16 << 20
