"""Runs of coded letters in linear time, and what is no secret."""

import base64
import json
import time

from rowloom.llm import secrets


def string(x):
    return len(x).to_bytes(4, "big") + x


def ssh(private=b"p" * 64, keys=1):
    return b"openssh-key-v1\0" + string(b"none") + string(b"none") + string(b"") + keys.to_bytes(4, "big") + string(string(b"ssh-ed25519") + string(b"k" * 32)) * keys + string(private)


def spans(text):
    return [(k, text[s:e]) for s, k, e in secrets.method_spans(text)]


def armoured(name, data):
    body = base64.b64encode(data).decode()
    return f"-----BEGIN {name}-----\n" + "\n".join(body[i : i + 70] for i in range(0, len(body), 70)) + f"\n-----END {name}-----"


def test_hostile_runs_end_soon():
    token = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "none"}, {"sub": "x"})) + ".c2ln"
    began = time.time()
    for text in (
        "eyJ" * 60_000, "eyJ" * 30_000 + "." + token, "eyJ." * 40_000, "eyJ" + base64.b64encode(b'{"":' * 40_000).decode()[3:] + "." + token, "/MIIE" * 30_000, "/MIIEowIBAAKC" * 12_000,
        "-----BEGIN PRIVATE KEY-----\n" * 5_000, "-----BEGIN PRIVATE KEY-----\n" + " " * 150_000, f"{token} " * 2_000, f"{token}=" * 2_000, "-----BEGIN A-----" + "x: y\n" * 30_000,
    ):
        secrets.find_spans(text)
    assert time.time() - began < 30


def test_every_token_of_a_run():
    token = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "none"}, {"sub": "x"})) + ".c2ln"
    assert spans("=".join([token] * 50)) == [("jwt", token)] * 50
    assert spans("eyJ" * 20 + "=" + token) == [("jwt", token)]
    assert spans("QUJDeyJ" + token)[-1][1].endswith(token)


def test_ssh_containers_are_parsed():
    text = armoured("OPENSSH PRIVATE KEY", ssh())
    assert spans(f"a\n{text}\nb") == [("ssh", text)]
    assert spans(base64.b64encode(ssh(keys=2)).decode()) == [("ssh", base64.b64encode(ssh(keys=2)).decode())]
    for bad in (b"openssh-key-v1\0junk" + b"x" * 40, ssh()[:-1], ssh() + b"!", ssh(b""), ssh(keys=0)):
        assert spans(armoured("OPENSSH PRIVATE KEY", bad)) == [] and not secrets.is_ssh_key(bad)


def test_public_keys_are_no_secrets():
    public = base64.b64encode(string(b"ssh-rsa") + string(b"\1\0\1") + string(b"n" * 257)).decode()
    assert spans(f"ssh-rsa {public} me@host") == []
    sequence = lambda *x: b"\x30" + bytes([sum(map(len, x))]) + b"".join(x)
    info = sequence(sequence(b"\x06\x03\x2b\x65\x70"), b"\x03\x21\0" + b"k" * 32)
    assert spans(base64.b64encode(info).decode()) == [] and spans(armoured("PUBLIC KEY", info)) == []
