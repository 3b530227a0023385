"""Private keys of every length form, however they stand in a text."""

import base64

import pytest

from busline.llm import secrets


def item(tag, *parts):
    body = b"".join(parts)
    size = len(body)
    n = (size.bit_length() + 7) // 8
    return bytes([tag]) + (bytes([size]) if size < 128 else bytes([0x80 + n]) + size.to_bytes(n, "big")) + body


def sec1(size, curve):
    return item(0x30, b"\x02\x01\x01", item(4, bytes(range(1, size + 1))), item(0xA0, item(6, bytes.fromhex(curve))))


def pkcs8(oids, inner):
    return item(0x30, b"\x02\x01\x00", item(0x30, *(item(6, bytes.fromhex(o)) for o in oids)), item(4, inner))


P256 = "2a8648ce3d030107"
SHORT = {
    "MDECAQEE": sec1(32, P256),
    "MEECAQAw": pkcs8(["2a8648ce3d0201", P256], item(0x30, b"\x02\x01\x01", item(4, bytes(range(32))))),
    "MC4CAQAw": pkcs8(["2b6570"], item(4, bytes(range(32)))),
    "MEcCAQAw": pkcs8(["2b6571"], item(4, bytes(range(57)))),
    "MEYCAQAw": pkcs8(["2b656f"], item(4, bytes(range(56)))),
    "MGgCAQEE": item(0x30, b"\x02\x01\x01", item(4, bytes(range(28))), item(0xA0, item(6, bytes.fromhex("2b81040021"))), item(0xA1, item(3, bytes(58)))),
}


@pytest.mark.parametrize("start", list(SHORT))
def test_short_keys_alone(start):
    key = base64.b64encode(SHORT[start]).decode()
    assert key.startswith(start)
    for text in (key, f"x {key} y"):
        at = text.index(key)
        assert secrets.find_secrets(text)[1] == [(at, "der", at + len(key))]


def ssh(size):
    part = lambda x: len(x).to_bytes(4, "big") + x
    return b"openssh-key-v1\0" + part(b"none") + part(b"none") + part(b"") + (1).to_bytes(4, "big") + part(b"pub" * 9) + part(b"priv" * size)


def rsa(size):
    return item(0x30, b"\x02\x01\x00", *(item(2, bytes([1 + k] * (size + k))) for k in range(8)))


KEYS = [("der", x) for x in [*SHORT.values(), rsa(32), rsa(33), rsa(34), rsa(9000)]] + [("ssh", ssh(n)) for n in (20, 21, 22, 900)]


def wrapped(digits, by, width=64):
    return by.join(digits[k : k + width] for k in range(0, len(digits), width))


@pytest.mark.parametrize("by", ["\n", "\r\n", "\n    ", " \n\t", "\\n", "\\r\\n", "\\\\n"])
@pytest.mark.parametrize("kind,key", KEYS)
def test_keys_in_text(kind, key, by):
    plain = base64.b64encode(key).decode()
    for code in (plain, plain.rstrip("="), key.hex(), key.hex().upper()):
        body = wrapped(code, by)
        for before, after in (("", ""), ("the key is below" + by, by + "and a line of text"), ("30" + by, by + "0a is next"), ("a", "b" if "=" in code else " b"), ("-----BEGIN KEY-----" + by, by + "-----END KEY-----"), ("M" * 99, "")):
            text = before + body + after
            assert secrets.find_secrets(text)[1] == [(len(before), kind, len(before) + len(body))], (before, after)
        cut = wrapped(code.rstrip("=")[:-4], by)
        assert not secrets.find_secrets(f"x {cut} y")[1]


@pytest.mark.parametrize("by", ["", "\n", "\\n"])
def test_keys_in_the_url_alphabet(by):
    key = item(0x30, b"\x02\x01\x00", *(item(2, bytes([1]) + bytes.fromhex("fbeffe") * 20) for _ in range(8)))
    digits = base64.urlsafe_b64encode(key).decode().rstrip("=")
    assert "-" in digits and "_" in digits
    body = wrapped(digits, by)
    for before, after in (("", ""), ("x ", " y"), ("-----BEGIN KEY-----\n", "\n-----END KEY-----")):
        assert secrets.find_secrets(before + body + after)[1] == [(len(before), "der", len(before) + len(body))]
    for alphabet in (base64.urlsafe_b64encode, base64.b64encode):
        short = alphabet(key).decode().rstrip("=")[:-4]
        assert not secrets.find_secrets(f"-----BEGIN KEY-----\n{short}\n-----END KEY-----")[1]


def test_joined_keys():
    key = base64.b64encode(SHORT["MDECAQEE"]).decode()
    text = f"MII{key}{key} {SHORT['MC4CAQAw'].hex()}{SHORT['MC4CAQAw'].hex()}"
    at, n = text.index(" ") + 1, 2 * len(SHORT["MC4CAQAw"])
    assert secrets.find_secrets(text)[1] == [(3, "der", 3 + len(key)), (3 + len(key), "der", 3 + 2 * len(key)), (at, "der", at + n), (at + n, "der", at + 2 * n)]


def test_long_runs_stay_fast():
    import time

    began = time.process_time()
    for text in ("MI" * 100_000, "30" * 100_000, "M\n" * 100_000, "M" + " " * 1_000_000, "b3Blbn" * 40_000, "3 \n0" * 60_000):
        assert not secrets.find_secrets(text)[1]
    assert time.process_time() - began < 30


def url(raw):
    return base64.urlsafe_b64encode(raw if isinstance(raw, bytes) else raw.encode()).decode().rstrip("=")


HEADS = ['{"alg":"HS256"}', '{ "alg":"HS256"}', '{\n  "alg": "RS256",\n  "typ": "JWT"\n}', '{\t"alg":"none","x":{"a":[1,{"b":"}{"}]}}', '{"k":"a\\"}{\\\\","alg":"ES256"} \n', '{"typ":"JWT","alg":"HS256","kid":"é"}']
BODIES = ['{"sub":"1"}', "{}", ' {"a":{"b":[]}}', '\n{"x":"}"}']


@pytest.mark.parametrize("head", HEADS)
@pytest.mark.parametrize("body", BODIES)
@pytest.mark.parametrize("tail", ["c2lnbmF0dXJl", "", "x"])
def test_signed_tokens(head, body, tail):
    token = f"{url(head)}.{url(body)}.{tail}"
    for before, after in (("", ""), ("token: ", "\n"), ("eyJunk_", " y"), ("eyJhb.", ""), ("ewogey", ","), ("a.b.c.", "!"), ("x.", " "), ("é", "é"), ("eyJ" * 50, "")):
        text = before + token + after
        assert secrets.find_secrets(text)[1] == [(len(before), "jwt", len(before) + len(token))], text
    two = f"{token} {token}"
    assert [s for s, _, _ in secrets.find_secrets(two)[1]] == [0, len(token) + 1]


@pytest.mark.parametrize("text", ["eyJ.eyJ.eyJ", url('{"typ":"JWT"}') + "." + url("{}") + ".x", url('{"alg":1}') + "." + url("{}") + ".x", url('["alg"]') + "." + url("{}") + ".", url(HEADS[0]) + "." + url("[1]") + ".x", url(HEADS[0]) + "." + url("{}"), url(HEADS[0]) + ".." + url("{}") + ".x", url('{"alg":"HS256"') + "." + url("{}") + ".x"])
def test_no_signed_token(text):
    assert secrets.find_secrets(text)[1] == []


def test_time_grows_with_the_text():
    import time

    heads = [base64.b64encode(rsa(32)[:6]).decode()[:8], "MIL//wIBAAIB", "MIL//wIBAAICAf8C", "MIIB/wIBADAC"]
    body = url("{}")
    for text in ("eyJ" * 350_000, *(h * (1_000_000 // len(h)) for h in heads), "eyJa." * 200_000, (body + ".") * 200_000, url('{"a":' * 50) * 10_000 + "." + body + ".", url('{"alg":"a","b":"') * 40_000 + "." + body + ".x", "30820fff0201000201" * 50_000, "b3BlbnNzaC1rZXktdjEA" * 50_000, ("eyJ" * 40 + "." + body + ".") * 5_000):
        began = time.process_time()
        secrets.find_secrets(text)
        assert time.process_time() - began < 5, text[:40]
