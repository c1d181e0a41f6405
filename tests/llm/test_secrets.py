from __future__ import annotations

import base64
import hashlib
import json
import random
import re

import pytest

from quillgraph.llm import secrets as S

rng = random.Random(11)
rand = rng.randbytes


def tlv(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else (lambda b: bytes([0x80 | len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


def integer(n, size=None):
    b = n.to_bytes(n.bit_length() // 8 + 1, "big")
    return tlv(2, b)


def seq(*parts):
    return tlv(0x30, b"".join(parts))


def big(bits):
    return rng.getrandbits(bits) | 1 << (bits - 1) | 1


RSA_OID, EC_OID, PBES2 = (tlv(6, bytes.fromhex(x)) for x in ("2a864886f70d010101", "2a8648ce3d0201", "2a864886f70d01050d"))
RSA = seq(integer(0), integer(big(1024)), integer(65537), integer(big(1020)), *(integer(big(512)) for _ in range(5)))
EC = seq(integer(1), tlv(4, rand(32)), tlv(0xA0, tlv(6, bytes.fromhex("2a8648ce3d030107"))), tlv(0xA1, tlv(3, b"\0\4" + rand(64))))
PKCS8 = seq(integer(0), seq(RSA_OID, tlv(5, b"")), tlv(4, RSA))
ED25519 = seq(integer(0), seq(tlv(6, bytes.fromhex("2b6570"))), tlv(4, tlv(4, rand(32))))
LOCKED = seq(seq(PBES2, seq(seq(EC_OID))), tlv(4, rand(64)))
P12 = seq(integer(3), seq(tlv(6, bytes.fromhex("2a864886f70d010701")), tlv(0xA0, tlv(4, rand(300)))))
CERTIFICATE = seq(seq(tlv(0xA0, integer(2)), integer(big(100)), seq(RSA_OID)), seq(RSA_OID), tlv(3, b"\0" + rand(128)))
PUBLIC = seq(seq(RSA_OID, tlv(5, b"")), tlv(3, b"\0" + seq(integer(big(1024)), integer(65537))))


def ssh(same=True):
    s = lambda b: len(b).to_bytes(4, "big") + b
    check = rand(4)
    private = check + (check if same else bytes(4)) + s(b"ssh-ed25519") + s(rand(32)) + s(rand(64)) + s(b"me") + b"\1\2\3"
    return b"openssh-key-v1\0" + s(b"none") + s(b"none") + s(b"") + (1).to_bytes(4, "big") + s(s(b"ssh-ed25519") + s(rand(32))) + s(private)


def b64(data, width=0, end="\n"):
    t = base64.b64encode(data).decode()
    return end.join(t[i : i + width] for i in range(0, len(t), width)) if width else t


def url(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def token(alg="HS256", size=32, payload=b'{"sub":"1"}'):
    return ".".join([url(json.dumps({"alg": alg, "typ": "JWT"}).encode()), url(payload), url(rand(size))])


@pytest.mark.parametrize("key", [RSA, EC, PKCS8, ED25519, LOCKED, P12], ids=["rsa", "ec", "pkcs8", "ed25519", "locked", "p12"])
def test_keys(key):
    forms = [b64(key), b64(key).rstrip("="), b64(key, 64), b64(key, 76, "\r\n"), b64(key, 64, "\\n"), b64(key, 64, "\n    "), base64.urlsafe_b64encode(key).decode(), key.hex(), key.hex().upper()]
    for form in forms:
        for before, after in (("", ""), ("x = '", "'"), ("BEGIN-----\n", "\n-----END"), ("é ", " word")):
            text = (before + form + after).encode()
            at = len(before.encode())
            assert S.confirmed(text) == [(at, "key", at + len(form))], (form[:40], before)
    assert S.confirmed(("key\\n" + b64(key, 64, "\\n") + "\\n").encode()) != []
    # a length that does not hold, cut off, longer than it says, inside a longer run
    broken = key[:-1]
    wrong = bytearray(key)
    wrong[_inner_length(key)] ^= 1
    for bad in (broken, bytes(wrong), key + b"\0\0\0"):
        assert S.confirmed(b64(bad).encode()) == [] and S.confirmed(bad.hex().encode()) == []
    assert S.confirmed(("ab" + b64(key)).encode()) == [] and S.confirmed(("a" + key.hex()).encode()) == []


def _inner_length(key):
    top = S._head(key, 0)
    return S._children(key, *top[1:])[0][1] - 1


def test_others():
    for data in (CERTIFICATE, PUBLIC, rand(200), b"0" + rand(100), seq(integer(0)), seq(integer(0), integer(5))):
        assert S.confirmed(b64(data).encode()) == [] and S.confirmed(data.hex().encode()) == []
    good, bad = ssh(), ssh(False)
    for form in (b64(good), b64(good, 70)):
        assert S.confirmed(("-\n" + form + "\n-----END").encode()) == [(2, "ssh", 2 + len(form))]
    assert S.confirmed(b64(bad).encode()) == [] and S.confirmed(b64(good[:-5]).encode()) == []


def test_tokens():
    for alg, size in (("HS256", 32), ("HS512", 64), ("ES384", 96), ("RS256", 256), ("EdDSA", 64)):
        t = token(alg, size)
        assert S.confirmed(f"Bearer {t}, then".encode()) == [(7, "jwt", 7 + len(t))]
    for t in (token("none", 32), token("HS256", 33), token("RS256", 64), url(b"[1]" * 4) + "." + url(b"{}x") + "." + url(rand(32)), token() + ".x", "x" + token(), "a.b.c", url(b'{"alg":1}  ') + ".abc." + url(rand(32))):
        assert S.confirmed(t.encode()) == []


def expected(text):
    """The pattern kinds, by the rules as they are written."""
    out = []
    for m in re.finditer(r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 6)
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], f"{a}:{b}") for a, k, b in sorted(out)]


def random_text():
    parts = ["password", "PassWd", "secret", "toKen", "api_key", "APIkey", "\"", "'", " ", "  ", ":", "=", "abc", "abcdef", "0123456789abcdef" * 2, "AKIA" + "B2" * 8, "AKIA", "AKIAB", "é", "日本", "\n", "ſecret", "toKen", "x", "A", "f" * 23, "f" * 24]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(40)))


def test_query_on_rows_of_every_kind(spark):
    """Random texts of pieces of patterns against the rules as written; nulls, repeats, clashing names, long texts."""
    rows = [(i, random_text(), "k", 1) for i in range(400)]
    rows += [(900, None, "k", 1), (901, "", None, 1), (902, " \n", "k", 1), (None, "token = abcdefg", "k", 1), (903, "secret: abcdef", "k", 1), (903, "secret: abcdef", "k", 1), (904, "é" * 200_000 + " passwd=123456 " + "f" * 200_000, "k", 1)]
    mixed = "ключ é " + token() + " и\n" + b64(PKCS8, 64) + "\nsecret=" + "0f" * 20
    rows += [(905, mixed, "k", 1), (906, "eyJ" * 300_000, "k", 1), (907, ("M" + "IIE" * 20 + "\n") * 20_000, "k", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hex long").repartition(4)
    got = {}
    for r in S.find_secrets(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows) and len(got[903]) == 2
    seen = 0
    for i, t, *_ in rows:
        want = expected(t or "")
        base = ",".join(f"{k}:{p}" for k, p in want)
        for r in got[i]:
            assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, _ in want) for x in ("assign", "access", "hex")], t
            assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
            if r["n_key"] + r["n_ssh"] + r["n_jwt"] == 0:
                assert r["spans"] == base
        seen += len(want)
    assert seen > 300
    r = got[905][0]
    a, b = mixed.index("eyJ"), mixed.index("MII")
    assert r["spans"].startswith(f"jwt:{a}:{mixed.index(' и')},key:{b}:{mixed.index(chr(10) + 'secret')},assign:") and (r["n_key"], r["n_jwt"], r["n_hex"]) == (1, 1, 1)
    assert S.find_secrets(df.where("false")).count() == 0
