import base64
import bz2
import gzip
import lzma
import re
import time
import urllib.parse
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from weft.llm import langid, pii, secret_scan
from weft.llm import progressive_jpeg as jpeg

HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def test_nested_secrets():
    plain = f'token = "{HEX}"'
    for press in (gzip.compress, zlib.compress, bz2.compress):
        inner = base64.b64encode(press(urllib.parse.quote(plain, safe="").encode())).decode()
        outer = urllib.parse.quote("x " + "".join(f"\\u{ord(c):04x}" for c in inner) + " y é")
        (found,) = secret_scan.scan(outer)
        assert found[0] == "assignment" and found[3] == "url>unicode>base64>compressed>url"
        assert urllib.parse.unquote(outer[: found[1]]) == "x " and urllib.parse.unquote(outer[found[2] :]) == " y é"
        assert found[4] == secret_scan.scan(plain)[0][4]
    twice = base64.b64encode(base64.b64encode(plain.encode())).decode()
    assert [x[3] for x in secret_scan.scan(f"a {twice} b")] == ["base64>base64"]
    at = secret_scan.scan(f"é %74oken = %22{HEX}%22")[0]
    assert f"é %74oken = %22{HEX}%22"[at[1] : at[2]] == HEX


def test_cycles_bombs_and_clean_texts(monkeypatch):
    assert secret_scan.scan("%2525252525" * 50) == [] and secret_scan.scan("AAAA" * 5000) == []
    for text in (None, "", "my token: hello world of prose", "the password is wrong", "Ninth thononinting " * 3000, "100% \\ &# %zz \\u12"):
        assert secret_scan.scan(text) == [] and secret_scan.redact(text, []) == text
    monkeypatch.setattr(secret_scan, "OPENED", 1000)
    assert secret_scan.scan(base64.b64encode(gzip.compress(b"x" * 2000)).decode())[0][0] == "compressed bomb"
    assert secret_scan.scan("AKIA" + "ABCDEFGH12345678" + " -----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----")[0][0] == "cloud key id"


def test_repeated_encoded_secrets():
    plain = f'token = "{HEX}"'.encode()
    for inner, layers in ((plain, "base64"), (gzip.compress(plain, mtime=0), "base64>compressed"), (base64.b64encode(plain), "base64>base64")):
        part = base64.b64encode(inner).decode()
        text = f"a {part} b\n" * 3 + f"%C3%A9 {part}"
        found = secret_scan.scan(text)
        assert [x[3] for x in found] == [layers] * 4 and len({x[1:3] for x in found}) == 4 and len({x[4] for x in found}) == 1
        assert part not in secret_scan.redact(text, found)
    once = base64.b64encode(gzip.compress(plain, mtime=0)).decode()
    assert len(secret_scan.scan(f"{once} " * 2000)) == 2000


def test_several_secrets_of_one_part():
    other = HEX[::-1]
    lines = [f'token = "{HEX}"', f'password = "{other}"', base64.b64encode(b"https://user:hunter22@example.org").decode()]
    want = {secret_scan.scan(x)[0][4] for x in lines}
    part = base64.b64encode("\n".join(lines).encode()).decode()
    found = secret_scan.scan(f"x {part} y")
    assert {x[4] for x in found} == want and len(found) == 3 and {x[1:3] for x in found} == {(2, 2 + len(part))}
    assert secret_scan.redact(f"x {part} y", found) == "x [SECRET] y"
    # the part itself is the value of a key
    assert {x[4] for x in secret_scan.scan(f'token = "{part}"')} > want


@pytest.mark.parametrize("width", [64, 76])
def test_wrapped_base64(width):
    digest = secret_scan.scan(f'token = "{HEX}"')[0][4]
    prose = " ".join(f"{i * i * 7919 % 1000003} words" for i in range(60))
    for press in (bytes, gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress):
        for before in range(3):
            raw = f'{prose[:40 + 3 * before]} token = "{HEX}" {prose}'.encode()
            code = base64.b64encode(press(raw)).decode()
            for end in ("\n", "\r\n", "\n    "):
                part = end.join(code[i : i + width] for i in range(0, len(code), width))
                text = f"Attached:\n{part}\nThe end"
                found = secret_scan.scan(text)
                assert [x[4] for x in found] == [digest], (press, before, found)
                assert "base64" in found[0][3] and found[0][1] >= text.index(part) and found[0][2] <= text.index("The end")
                if press is not bytes:
                    assert secret_scan.redact(text, found) == "Attached:\n[SECRET]\nThe end"
    # lines that are runs of their own stay so
    lone = base64.b64encode(f"password={HEX}  ".encode()).decode()
    assert len(lone) % 4 == 0 and "=" not in lone and len(secret_scan.scan(f"{lone}\n" * 3)) >= 3


def test_escaped_compressed_bytes():
    digest = secret_scan.scan(f'token = "{HEX}"')[0][4]
    raw = f'a note; token = "{HEX}" and so on'.encode()
    for press in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress):
        code = press(raw)
        ways = [("".join(f"%{c:02X}" for c in code), "url"), (urllib.parse.quote(code), "url"), (urllib.parse.quote_plus(code), "url"), ("".join(f"\\x{c:02x}" for c in code), "unicode"), (repr(code)[2:-1], "unicode"), ("".join(f"\\u{c:04x}" for c in code), "unicode")]
        for part, name in ways:
            text = f"x = '{part}' # done"
            found = secret_scan.scan(text)
            assert [x[4] for x in found] == [digest], (press, part)
            # short texts stand as they are in the other formats
            if press in (gzip.compress, zlib.compress, bz2.compress):
                assert found[0][3] == f"{name}>compressed" and secret_scan.redact(text, found) == "x = '[SECRET]' # done", (press, part)


def test_secret_table(spark):
    rows = [(1, f'a token = "{HEX}" b', 99, "r"), (1, f'a token = "{HEX}" b', 99, "r"), (2, None, None, None), (3, "", 0, "x"), (None, f"password={HEX}", 1, "q"), (4, "clean", 5, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, rule string")
    got = sorted(((r.doc_id, r.start, r.end) for r in secret_scan.secret_scan(docs).collect()), key=str)
    assert got == [(1, 11, 51), (1, 11, 51), (None, 9, 49)]
    cut = {(r.doc_id, r.text, r.n_chars) for r in secret_scan.redacted(docs).collect()}
    assert cut == {(1, 'a token = "[SECRET]" b', 22), (2, None, None), (3, "", 0), (None, "password=[SECRET]", 17), (4, "clean", 5)}
    assert secret_scan.secret_scan(docs.limit(0)).count() == 0


def test_entities_and_formats():
    text = "Mail the.72@mail3.example.com, call +1 (826) 555-4081 190.137.223.204 or 555!! Mr. John Smith and Mrs Smith, г-жа Иванова. 4111 1111 1111 1111"
    kinds = [k for *_, k, _ in pii.entities(text)]
    assert kinds == ["email", "phone", "ip", "first_m_latin", "last_latin", "last_latin", "last_cyrillic", "card"]
    given = {(k, v): pii.surrogate(pii.KEY, k, v, 0) for _, _, k, v in pii.entities(text)}
    new, n = pii.replace(text, given)
    assert n == 8 and not any(x in new for x in ("the.72", "555-4081", "190.137", "John", "Smith", "Иванова", "4111 1111"))
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} ", new) and pii.luhn(pii.digits(new[-19:])) == 0
    first, last, again = re.search(r"Mr\. (\w+) (\w+) and Mrs (\w+)", new).groups()
    assert last == again and first in pii.FIRST["latin", "m"] and re.search(r"г-жа [А-Я][а-я]+\.", new)
    assert pii.entities(None) == pii.entities("") == pii.entities("Clean prose, 12 of 1999. M. and so on") == []


def test_bare_names_plain_phones_and_ipv6():
    text = "Mr John Smith came. Smith said that John's car is Mr Smith's; smith, Smithson and Johnny stay. Call 415-555-2671 or 415.555.2672, 2001:db8::8a2e:370:7334. At 10:20:30 std::vector 1::"
    found = pii.entities(text)
    assert [(text[a:b], k) for a, b, k, _ in found] == [("John", "first_m_latin"), ("Smith", "last_latin"), ("Smith", "last_latin"), ("John", "first_m_latin"), ("Smith", "last_latin"), ("415-555-2671", "phone"), ("415.555.2672", "phone"), ("2001:db8::8a2e:370:7334", "ipv6"), ("1::", "ipv6")]
    new, n = pii.replace(text, {(k, v): pii.surrogate(pii.KEY, k, v, 0) for *_, k, v in found})
    first, last, again, owner = re.search(r"Mr (\w+) (\w+) came. (\w+) said that (\w+)'s", new).groups()
    assert n == 9 and last == again and first == owner and "smith, Smithson and Johnny stay" in new and re.search(r"\d{3}-\d{3}-\d{4} or \d{3}\.\d{3}\.\d{4}, (?:[0-9a-f]{4}:){7}[0-9a-f]{4}\.", new)


def test_distinct_surrogates(spark, monkeypatch):
    plain = pii.surrogate
    # a domain that is far too small at first: only the later attempts can be told apart
    monkeypatch.setattr(pii, "surrogate", lambda key, kind, value, attempt: f"s{hash(value) % 3}" if attempt == 0 else plain(key, kind, value, attempt))
    found = spark.createDataFrame([("email", f"a{i}@x.org") for i in range(40)] + [("email", "s1")], "kind string, value string")
    rows = pii.assign(found).collect()
    made = [r.surrogate for r in rows]
    assert len(rows) == 41 and len(set(made)) == 41 and not set(made) & {r.value for r in rows}


def test_surrogate_table(spark):
    text = "Herr Karl Meier, 10.0.0.1, a.b@c.de; 10.0.0.1"
    rows = [(1, text, "k", 1), (1, text, "k", 1), (2, None, "v", 2), (3, "", None, 3), (None, "10.0.0.1 " * 2000, None, None), (4, "nothing 12", "x", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, mark string, kind int")
    got = pii.surrogates(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[2].text is None and by[3].text == "" and by[4].text == "nothing 12" and by[4].n_replaced == 0
    assert by[1].n_replaced == 5 and "Meier" not in by[1].text and "10.0.0.1" not in by[1].text
    ip = re.findall(r"\d+\.\d+\.\d+\.\d+", by[1].text)
    assert ip[0] == ip[1] and by[None].text == f"{ip[0]} " * 2000
    other = {r.doc_id: r.text for r in pii.surrogates(docs, b"another key").collect()}
    assert other[1] != by[1].text
    assert pii.surrogates(docs.limit(0)).count() == 0


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    rows = docs.where("doc_id % 2 = 1").select("doc_id", "lang").collect()
    found = {r.doc_id: r for r in langid.identify(docs.where("doc_id % 2 = 1"), model).collect()}
    right = [found[r.doc_id].lang == r.lang for r in rows]
    assert np.mean(right) > 0.99 and np.mean([found[r.doc_id].accepted for r in rows]) > 0.999
    sure = np.array([found[r.doc_id].confidence for r in rows])
    assert abs(sure.mean() - np.mean(right)) < 0.02 and 0.05 < (model.weights == 0).mean() < 1
    odd = spark.createDataFrame([(1, None, "en", 5), (2, "", None, 5), (3, "12 ### 7", "de", 5), (None, "Erinst resh " * 4000, "en", 5), (5, "The", "en", 5), (5, "The", "en", 5)], "doc_id bigint, text string, lang string, confidence int")
    got = sorted(((r.doc_id, r.lang, r.accepted) for r in langid.identify(odd, model).collect()), key=str)
    assert got == [(1, "und", False), (2, "und", False), (3, "und", False), (5, "en", True), (5, "en", True), (None, "en", True)]
    assert langid.language_id(odd.limit(0)).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang for r in langid.language_id(unlabelled).collect()} == {"und"}


@pytest.mark.parametrize("halved", [True, False])
@pytest.mark.parametrize("quality", [20, 60, 100])
def test_coefficients_survive(quality, halved):
    rng = np.random.default_rng(quality)
    for shape in ((8, 8), (1, 1), (17, 33), (40, 23), (100, 7)):
        image = rng.integers(0, 256, (*shape, 3))
        data, want = jpeg.encode(image, quality, halved)
        decoder = jpeg.Decoder(data)
        for c, (got, own) in enumerate(zip(decoder.coefficients(), want)):
            if c == 0:
                own = own.copy()
                own[-(-shape[0] // 8) :, :, 1:] = 0
                own[:, -(-shape[1] // 8) :, 1:] = 0
            assert (got == own).all()
        rgb = decoder.rgb()
        assert rgb.shape == (*shape, 3)
        if quality == 100 and not halved:
            assert np.abs(rgb.astype(int) - image).max() < 12


def test_inverse_transform_by_definition():
    rng = np.random.default_rng(0)
    q, quant = rng.integers(-20, 20, (1, 1, 64)), rng.integers(1, 9, 64)
    flat = np.zeros(64)
    flat[jpeg.ZIGZAG] = q[0, 0] * quant
    c = lambda u: 0.5**0.5 if u == 0 else 1
    want = [[128 + 0.25 * sum(c(u) * c(v) * flat[8 * v + u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]
    assert np.allclose(jpeg.plane(q, quant), want)


def test_tensors(spark):
    image = np.add.outer(np.arange(20) * 5, np.arange(30) * 3)[:, :, None] + np.array([0, 20, 40])
    good = jpeg.encode(image, 90)[0]
    rows = [(1, bytearray(good), 1), (1, bytearray(good), 1), (2, None, 2), (3, bytearray(b""), 3), (4, bytearray(good[: len(good) // 2]), 4), (None, bytearray(good), 5), (6, bytearray(b"\xff\xd8\xff\xd9"), 6)]
    got = jpeg.tensors(spark.createDataFrame(rows, "page_id bigint, image binary, height int")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id in (1, None):
            rgb = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
            assert rgb.shape == (20, 30, 3) and np.abs(rgb.astype(int) - image).mean() < 4
        else:
            assert r.rgb is None and (r.error is None) == (r.page_id == 2)
    pages = spark.createDataFrame([(1, None, None), (2, "u", "<p>x")], "page_id bigint, url string, html string")
    assert all(r.rgb for r in jpeg.page_tensors(pages).collect()) and jpeg.page_tensors(pages.limit(0)).count() == 0


def test_whole_pages_are_pictured():
    html = "<p>" + "Erinst resh of the and " * 900 + "é</p>"
    size = len(html.encode())
    page = jpeg.picture("u", html)
    assert size <= page.shape[0] * page.shape[1] < size + 2 * page.shape[1] and (np.abs(page.mean(2).ravel()[:size] - np.frombuffer(html.encode(), np.uint8)) <= 41).all()
    seen = jpeg.decode(jpeg.encode(page)[0])
    assert seen.shape == page.shape and np.abs(seen.astype(int) - page).mean() < 16
    for at in (1, 5003, len(html) - 2):
        other = jpeg.decode(jpeg.encode(jpeg.picture("u", html[:at] + "~" + html[at + 1 :]))[0])
        assert other.shape == seen.shape and (other != seen).any()


def test_scans_of_many_pages_at_once(monkeypatch):
    rng, pages = np.random.default_rng(8), []
    for k in range(24):
        text = "".join(map(chr, rng.integers(32, 126, int(rng.integers(0, 3000))))) if k % 3 else "<p>a</p>" * 60
        pages.append(jpeg.picture(str(k), text))
    pages.append(np.full((1500, 1500, 3), 90, np.uint8))  # a run of more than 32,767 blocks
    both = jpeg.encode_all(pages, 90)
    for spec in jpeg.SCANS:
        if spec[1]:
            blocks = [q[spec[0][0]].reshape(-1, 64) for _, q in both]
            want = [jpeg._write_scan(x.tolist(), spec) for x in blocks]
            got = jpeg._write_ac(np.concatenate(blocks[:-1]), np.repeat(np.arange(24), [len(x) for x in blocks[:-1]]), 24, spec)
            assert got == want[:-1] and jpeg._write_ac(blocks[-1], np.zeros(len(blocks[-1]), int), 1, spec) == want[-1:]
    read = [jpeg.Decoder(data).coefficients() for data, _ in both]
    monkeypatch.setattr(jpeg.Decoder, "_ac_refine", jpeg.Decoder._ac_refine_by_numbers)
    assert all((a == b).all() for (data, _), own in zip(both, read) for a, b in zip(jpeg.Decoder(data).coefficients(), own))
    began = time.process_time()
    jpeg.encode_all(pages[:24] * 4, 90)
    together, began = time.process_time() - began, time.process_time()
    for spec in jpeg.SCANS:
        for _, q in both[:24] * 4 if spec[1] else []:
            jpeg._write_scan(q[spec[0][0]].reshape(-1, 64).tolist(), spec)
    assert together < 0.7 * (time.process_time() - began)


def test_many_files_are_read_at_once(monkeypatch):
    rng, pages = np.random.default_rng(10), []
    for k in range(90):
        text = "".join(map(chr, rng.integers(32, 126, int(rng.integers(0, 4000))))) if k % 3 else "<p>Erinst resh</p>" * (k + 1)
        pages.append(jpeg.picture(str(k), text))
    files = [data for data, _ in jpeg.encode_all(pages) + jpeg.encode_all(pages[:50], 95, False)]
    for k in range(0, 300):  # cut, and changed within scans
        data = bytearray(files[int(rng.integers(0, 90))])
        at = int(rng.integers(data.index(b"\xff\xda"), len(data) - 2))
        files.append(bytes(data[:at])) if k % 10 == 0 else files.append(bytes(data[:at] + bytes([data[at] ^ 1 << k % 8]) + data[at + 1 :]))
    files += [b"", b"\xff\xd8\xff\xd9"]
    monkeypatch.setattr(jpeg.Decoder, "_ac_refine", jpeg.Decoder._ac_refine_by_numbers)

    def alone(data):
        try:
            return jpeg.decode(data)
        except jpeg.Corrupt as e:
            return e

    want, read = list(map(alone, files)), []
    own = jpeg.decode
    monkeypatch.setattr(jpeg, "decode", lambda data: read.append(data) or own(data))
    for few in (32, 1, 1 << 30):
        monkeypatch.setattr(jpeg, "FEW", few)
        read.clear()
        got = jpeg.decode_all(files)
        assert not set(read) & set(files[:140])
        for a, b in zip(got, want):
            assert str(a) == str(b) if isinstance(b, jpeg.Corrupt) else (a == b).all()
    assert sum(isinstance(x, jpeg.Corrupt) for x in want) > 30 and sum(not isinstance(x, jpeg.Corrupt) for x in want[140:]) > 30
    monkeypatch.undo()
    files, began = files[:90] * 6, time.process_time()
    jpeg.decode_all(files)
    together, began = time.process_time() - began, time.process_time()
    for data in files:
        jpeg.decode(data)
    assert together < 0.7 * (time.process_time() - began)
