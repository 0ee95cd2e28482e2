"""Random strings within longer runs, and of several alphabets."""

import random
import string

import public_tokenizers
import pytest

from groundloom.llm import secret_scan

BASE62 = string.ascii_letters + string.digits


def spans(text):
    encoding = secret_scan._encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    base = secret_scan.pattern_spans(text)
    return [text[a:b] for a, _, b in secret_scan.random_spans(text, base, encoding, 1.6)]


def share(alphabet, n, before=""):
    rng = random.Random(7)
    keys = ["".join(rng.choices(alphabet, k=n)) for _ in range(400)]
    return sum(any(k in s for s in spans(f"see {before}{k} there")) for k in keys) / len(keys)


@pytest.mark.parametrize("before", ["", "session=", "client_session_id=", "/user/account/settings/"])
def test_readable_parts_hide_no_random_string(before):
    assert share(BASE62, 24, before) > 0.9


def test_rests_and_identifiers_in_runs():
    key, uuid = "zQ9x7Kp2Vw8Rt5Yb3Nm6Jh1", "123e4567-e89b-12d3-a456-426614174000"
    assert spans(f"AKIA{'Q7Z' * 6}/{key}") == [key]
    assert spans(f"/objects/{uuid}") == spans("/user/account/settings/overview") == []
    assert spans(f"/objects/{'0123456789ABCDEF' * 2}") == []


def test_digests_addresses_and_alphabets_are_no_secrets():
    import base64
    import hashlib

    for k in range(100):
        for name in ("sha1", "sha256", "sha384", "sha512"):
            digest = base64.b64encode(hashlib.new(name, b"%d" % k).digest()).decode()
            assert spans(f'integrity="{name}-{digest}" crossorigin') == [], digest
        raw = hashlib.md5(b"%d" % k).hexdigest()
        for joint in ("-", ":"):
            assert spans("address " + joint.join(raw[i : i + 2] for i in range(0, 12, 2))) == []
    assert spans(string.ascii_uppercase) == spans(string.ascii_lowercase + " abcdefghijklmnop") == []
    # A key beside an identifier is still found.
    assert spans("/01-23-45-67-89-ab/zQ9x7Kp2Vw8Rt5Yb3Nm6Jh1") == ["zQ9x7Kp2Vw8Rt5Yb3Nm6Jh1"]


@pytest.mark.parametrize("alphabet", ["0123456789ABCDEF", string.ascii_lowercase, string.ascii_lowercase + string.digits, BASE62])
@pytest.mark.parametrize("n", [20, 24])
def test_alphabets(alphabet, n):
    assert share(alphabet, n) > 0.9


def test_strings_of_sixteen():
    assert share(BASE62, 16) > 0.9 and share(string.ascii_lowercase + string.digits, 16) > 0.9
