import base64
import bz2
import gzip
import lzma
import random
import re
import urllib.parse
import zlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.fixtures import docs_of, empty_docs, rows_of
from verdant.llm import secret_scans as ss

SECRET = "token = abcdef123456"
KEY = "AKIA" + "Q7" * 9
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="tokenTOKENſsecret=:\"' abcdef0123456789AKIAZ-_.\n", max_size=120))
def test_base_patterns(text):
    assert ss.base_spans(text) == plain(text)


def test_base_patterns_on_given_texts():
    for (text,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall():
        assert ss.base_spans(text) == plain(text)


def found(text):
    return [(ss.KINDS[k], text[s:e], via) for s, k, e, via in ss.scan_text(text) if via]


def test_each_layer_is_unwrapped_and_mapped():
    percent = "".join(f"%{b:02X}" for b in SECRET.encode())
    assert found(f"é {percent} z") == [("assign", percent, "url")]
    uni = "".join(f"\\u{ord(c):04x}" for c in SECRET)
    assert found(f"x {uni} .") == [("assign", uni, "unicode")]
    b64 = base64.b64encode(f"pre {SECRET} post".encode()).decode()
    ((kind, text, via),) = found(f"see {b64} !")
    assert (kind, via) == ("assign", "base64") and text in b64 and SECRET in base64.b64decode(b64).decode()
    for pack in (gzip.compress, zlib.compress):
        run = base64.b64encode(pack(f"{KEY} in a packed text".encode())).decode()
        assert ("access", run, "base64/inflate") in found(f"({run})")


def test_nested_layers_and_context():
    inner = base64.b64encode(f"my {SECRET}".encode()).decode()
    outer = base64.b64encode(f"again: {inner} .".encode()).decode().replace("=", "%3D")
    assert any(v.count("base64") == 2 for _, _, v in found(f"a {outer} b"))
    assert found("password%3Dabc%64ef")[0][1] == "password%3Dabc%64ef"
    assert found("pass\\u0077ord: abcdefg")[0][0] == "assign"
    half = "\\ud83d\\ude00"
    assert [x.text for x in ss._unicode(ss.Layer(half))] == ["😀"]


def test_plain_spans_stay_and_cycles_end():
    text = f"{SECRET} %41 {KEY}"
    assert [x[:3] for x in ss.scan_text(text) if not x[3]] == plain(text)
    ss.scan_text("%25" * 500 + "41" * 50)
    ss.scan_text("%" + "25" * 300 + "\\u005cu005cu0041")


def test_oversize_is_reported(monkeypatch):
    monkeypatch.setattr(ss, "LAYER_LIMIT", 1000)
    run = base64.b64encode(gzip.compress(b"a " * 5000)).decode()
    assert ("oversize", run, "oversize") in found(f"x {run} y")


def test_frame(spark):
    texts = [None, "", SECRET, SECRET, "no secret " * 5000 + SECRET]
    got = rows_of(ss.scan(docs_of(spark, texts)))
    assert [len(got[i].found) for i in range(5)] == [0, 0, 1, 1, 1]
    assert got[4].found[0].start == 50000
    clean = rows_of(ss.redact(docs_of(spark, texts)))
    assert clean[2].text == "[assign]" and clean[2].n_chars == 8 and clean[0].text is None and clean[0].n_chars is None and clean[1].text == ""
    assert ss.scan(empty_docs(spark)).count() == 0 and ss.redact(empty_docs(spark)).columns == empty_docs(spark).columns


def test_layers_of_any_characters_are_scanned():
    for text in (f"d\u00e9j\u00e0\u00a0: {SECRET}", f"\ufeff{SECRET} x", f"\x1b[31m{SECRET}\x1b[0m \0", f"\u3000\u202f\u200b\u00ad {SECRET}"):
        for raw in (text.encode(), text.encode("utf-16"), text.encode("utf-16-be"), b"." + text.encode("utf-16-le"), text.encode("latin-1", "replace")):
            run = base64.b64encode(raw).decode()
            assert any(k == "assign" and v == "base64" and t in run for k, t, v in found(f"see {run} !")), raw
            run = base64.b64encode(gzip.compress(raw)).decode()
            assert ("assign", run, "base64/inflate") in found(f"see {run} !"), raw
    (span,) = {(s, e) for s, k, e, v in ss.scan_text(base64.b64encode(f"\u00e9\ud83d\ude00 {KEY} z".encode("utf-16", "surrogatepass")).decode()) if k == 1}
    assert 0 < span[0] < span[1]


def test_wrapped_base64_is_joined():
    import textwrap

    text = "".join(f"word{i} \u00e9 " for i in range(40))
    for pad in range(48, 60):
        raw = (text[:pad] + SECRET + " " + text).encode()
        for sep in ("\n", "\r\n", "\n    ", "\\n", "\n> "):
            for columns in (64, 76, 10):
                body = sep.join(textwrap.wrap(base64.b64encode(raw).decode(), columns))
                whole = f"data: {body}\n."
                spans = [(s, e) for s, k, e, v in ss.scan_text(whole) if k == 0 and v == "base64"]
                at, n = len(text[:pad].encode()) * 4 // 3, -(-len((text[:pad] + SECRET).encode()) * 4 // 3)
                digits = [i for i, c in enumerate(whole) if 6 <= i < 6 + len(body) and i - 6 not in _gaps(body, sep)]
                assert (digits[at], digits[n - 1] + 1) in spans, (pad, sep, columns)
    noise = "".join(chr(33 + i * i % 89) + f"{i * 7919 % 1000}" for i in range(300))
    for pack in (gzip.compress, zlib.compress, bz2.compress):
        body = "\n".join(textwrap.wrap(base64.b64encode(pack(f"{noise} {KEY} end".encode())).decode(), 64))
        assert ("access", body, "base64/inflate") in found(f"({body})")


def _gaps(body, sep):
    return {i + d for i in range(len(body)) if body.startswith(sep, i) for d in range(len(sep))}


def test_runs_touching_other_digits():
    run = base64.b64encode(f"caf\u00e9 {SECRET} \u00e9t\u00e9".encode()).decode().rstrip("=")
    for before in ("/cb/", "key_", "id-", "\\n", "x", "xy+", "/v1/", "a/b/c-d_"):
        for after in ("", "/", "_x", "-end"):
            assert any(k == "assign" and t in run for k, t, _ in found(f"see {before}{run}{after} ")), (before, after)


def test_all_members_are_inflated():
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
        raw = pack(b"first member ") + pack(f"second {KEY[:9]}".encode()) + pack(f"{KEY[9:]} third".encode()) + pack(f"a {SECRET}".encode())
        run = base64.b64encode(raw).decode()
        got = found(f"({run})")
        assert ("access", run, "base64/inflate") in got and ("assign", run, "base64/inflate") in got
        assert any(k == "access" for k, _, _ in found(f"(/cb/id-{base64.b64encode(b'head' + raw).decode()})"))
    double = base64.b64encode(gzip.compress(bz2.compress(SECRET.encode()))).decode()
    assert ("assign", double, "base64/inflate/inflate") in found(double)


def test_oversize_layers_are_read_on(monkeypatch):
    monkeypatch.setattr(ss, "LAYER_LIMIT", 1000)
    for pack in (gzip.compress, bz2.compress, lzma.compress):
        run = base64.b64encode(pack(b"a " * 5000 + SECRET.encode() + b" b" * 5000 + KEY.encode())).decode()
        got = found(f"x {run} y")
        assert {("oversize", run, "oversize"), ("assign", run, "base64/inflate"), ("access", run, "base64/inflate")} <= set(got)


def test_compressed_bytes_under_escapes():
    rng = random.Random(5)
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
        raw = pack(" ".join(f"w{rng.random()}" for _ in range(50)).encode() + f" {KEY} ".encode() + SECRET.encode())
        hexed = "".join(f"\\x{b:02x}" for b in raw)
        for body in (hexed, repr(raw)[2:-1], urllib.parse.quote(raw), urllib.parse.quote_plus(raw), "".join(f"%{b:02X}" for b in raw)):
            via = "unicode/inflate" if "\\x" in body else "url/inflate"
            assert {("access", body, via), ("assign", body, via)} <= set(found(f"data {body} .")), body


def nested(depth, pack=gzip.compress):
    raw = SECRET.encode()
    for _ in range(depth):
        raw = pack(raw, 1)
    return base64.b64encode(raw).decode()


def quine():
    """Gzip data, but for its trailer, that inflates to itself: stored blocks of n units of 5 bytes, and repeats of the last four units."""
    store = lambda n: b"\0" + (5 * n).to_bytes(2, "little") + (65535 - 5 * n).to_bytes(2, "little")
    head, again = b"\x1f\x8b\x08\x08" + bytes(5) + b"\x03data\0", bytes.fromhex("428821c400")
    fourth, first, none = store(4), store(1), store(0)
    start = head + fourth + head + fourth + again + first + again + first + first + fourth + again + first + first + fourth
    return start + (again + fourth) * 4 + none * 4


def test_deeply_nested_layers():
    for depth in (1, 400, 1100):
        run = nested(depth)
        assert ("assign", run, "base64" + "/inflate" * depth) in found(f"x {run} y")


def test_five_thousand_layers():
    run = nested(5000, zlib.compress)
    assert run in {t for k, t, _ in found(f"x {run} y") if k == "assign"}


def test_data_that_inflate_to_themselves(spark):
    raw = quine()
    assert zlib.decompressobj(31).decompress(raw) == raw
    run = base64.b64encode(raw).decode()
    assert found(f"x {run} y") == []
    both = base64.b64encode(gzip.compress(f"a {KEY}".encode()) + raw).decode()
    assert ("access", both[: len(both)], "base64/inflate") in found(f"x {both} y")
    got = rows_of(ss.scan(docs_of(spark, [run, f"x {nested(1100)} y", SECRET])))
    assert [[f.kind for f in got[i].found] for i in range(3)] == [[], ["assign"], ["assign"]]


def test_large_layers_wait_compressed(monkeypatch):
    monkeypatch.setattr(ss, "LAYER_LIMIT", 4000)
    kept = []
    wait = ss.Layer.wait
    monkeypatch.setattr(ss.Layer, "wait", lambda self: wait(self) or kept.append(self.stored is not None))
    inner = gzip.compress(b"b " * 1500 + SECRET.encode())
    run = base64.b64encode(gzip.compress(b"a " * 1500 + inner)).decode()
    got = found(f"x {run} y")
    assert ("assign", run, "base64/inflate/inflate") in got and any(kept)
    layer = ss.Layer("", "/x", whole=(0, 1), data=b"z" * 4000)
    layer.wait()
    assert layer.data == b"" and layer.stored
    layer.resume()
    assert layer.data == b"z" * 4000
