"""Structures joined in one run, enciphered keys and armour with header lines are all found."""

import base64
import json

from rowloom.llm import secrets


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")) + body


def key(seed):
    return base64.b64encode(der(0x30, der(2, b"\0") + der(2, bytes([seed]) * 200) + der(2, b"\x01\0\x01"))).decode()


def token(name):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return f"{part({'alg': 'HS256'})}.{part({'sub': name})}.c2lnbmF0dXJlc2lnbmF0dXJl"


def spans(text):
    return [(k, text[s:e]) for s, k, e in secrets.method_spans(text)]


def test_two_structures_of_a_run():
    a, b = token("one"), token("two")
    assert spans(f"{a}={b}") == [("jwt", a), ("jwt", b)]
    assert spans(f"{a}.={key(7)}") == [("jwt", a), ("der", key(7))]
    for joint in ("=.", ".", "-", "/", "_"):
        x, y = key(7).rstrip("="), key(9).rstrip("=")
        assert spans(f"{x}{joint}{y}")[-1] == ("der", y) and [k for k, _ in spans(f"{x}{joint}{y}")] == ["der", "der"], joint
        assert x not in secrets.redacted(f"{x}{joint}{y}") and y not in secrets.redacted(f"{x}{joint}{y}")


def test_enciphered_keys_and_header_lines():
    sealed = der(0x30, der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d") + der(0x30, b"")) + der(4, bytes(range(64))))
    assert secrets.is_der_key(sealed)
    body = base64.b64encode(bytes(range(160))).decode()
    text = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n{body[:64]}\n{body[64:128]}\n{body[128:]}\n-----END RSA PRIVATE KEY-----"
    assert ("der", text) in spans(f"{text}")
    plain = f"-----BEGIN RSA PRIVATE KEY-----\nComment: x\n\n{key(3)}\n-----END RSA PRIVATE KEY-----"
    assert ("der", plain) in spans(plain)
