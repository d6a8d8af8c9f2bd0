import random

from hypothesis import given, settings
from hypothesis import strategies as st

from models import read_message
from weir.operators.decode import INCOMPLETE, MALFORMED, OK, parse_message
from weir.operators.wire import parse_messages

HEAD = bytes.fromhex("123481800001000100000000")
NAME = b"\x03www\x07example\x03com\x00"
QUESTION = NAME + bytes.fromhex("00010001")


def test_compressed_answer():
    rr = bytes.fromhex("c00c00050001000000640006") + b"\x03cdn\xc0\x10"
    m = parse_message(HEAD + QUESTION + rr)
    assert m["err_code"] == OK
    assert m["questions"][0]["name"] == ".moc.elpmaxe.www"
    assert m["answers"][0]["name"] == "www.example.com."
    assert m["answers"][0]["rdata"] == b"cdn.example.com." and m["answers"][0]["ttl"] == 100


def test_bad_pointers():
    tail = bytes.fromhex("00010001") + b"\x00" * 8
    for pointer, code in [(b"\xc0\x0c", MALFORMED), (b"\xc0\x00", MALFORMED), (b"\xff\xff", MALFORMED)]:
        assert parse_message(HEAD + pointer + tail)["err_code"] == code


def test_limits():
    two = bytearray(HEAD + QUESTION)
    two[5] = 2
    assert parse_message(bytes(two))["err_code"] == MALFORMED
    assert parse_message(HEAD[:8])["err_code"] == INCOMPLETE
    long_name = b"".join(b"\x3f" + b"a" * 63 for _ in range(5)) + b"\x00"
    assert parse_message(HEAD + long_name + bytes(4))["err_code"] == MALFORMED
    assert parse_message(HEAD + QUESTION + bytes.fromhex("c00c000100010000006400ff"))["err_code"] == INCOMPLETE


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=120))
def test_never_raises(data):
    assert parse_message(data)["err_code"] in (OK, MALFORMED, INCOMPLETE)


def test_truncations_never_raise():
    rr = bytes.fromhex("c00c00010001000000640004") + b"\x0a\x00\x00\x01"
    whole, rng = HEAD + QUESTION + rr, random.Random(3)
    assert parse_message(whole)["err_code"] == OK
    for n in range(len(whole)):
        parse_message(whole[:n])
    for _ in range(500):
        bad = bytearray(whole)
        for _ in range(3):
            bad[rng.randrange(12, len(bad))] = rng.randrange(256)
        parse_message(bytes(bad))


def same(messages):
    """A batch read together and each message read byte by byte."""
    import pyarrow as pa

    from weir.operators.decode import _RECORD

    got = {k: v.to_pylist() for k, v in parse_messages(pa.array(messages, pa.binary()), _RECORD).items()}
    for i, m in enumerate(messages):
        want = read_message(m or b"")
        assert {k: v[i] for k, v in got.items()} == {k: want.get(k) for k in got}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=90), max_size=6))
def test_any_bytes_are_read_as_one_by_one(messages):
    same(messages)


def test_spoiled_messages_are_read_as_one_by_one():
    records = (bytes.fromhex("c00c000100010000006400040a000001") + bytes.fromhex("c00c00050001000000640006") + b"\x03cdn\xc0\x10"
               + bytes.fromhex("c00c000200010000012c0005026e73c00c") + bytes.fromhex("0000291000000080000000"))
    whole = bytes.fromhex("123481800001000200010001") + b"\x03www\x07exa\x00ple\x03com\x00" + bytes.fromhex("00010001") + records
    r, messages = random.Random(1), [whole, b"", None, whole[:5], HEAD + b"\x40" + b"b" * 64 + bytes(41)]
    for _ in range(1500):
        bad = bytearray(whole[:r.randrange(len(whole) + 1)] if r.random() < 0.3 else whole)
        for _ in range(r.randrange(5)):
            if bad:
                bad[r.randrange(len(bad))] = r.choice([0, 1, 3, 192, 12, 255, r.randrange(256)])
        messages.append(bytes(bad))
    same(messages)
    same([])
