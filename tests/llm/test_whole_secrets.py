"""Literals are taken whole, whatever they begin with and however long they are."""

from __future__ import annotations

import time

import pytest

from tallyforge.llm import secrets

KEY = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
JWT = ".".join("eyJhbGciOiJIUzI1NiJ9Zk93kdlsQ8x1" * k for k in (2, 20, 4))


@pytest.mark.parametrize(
    ("text", "value"),
    [
        (f"AWS_SECRET_ACCESS_KEY={KEY}", KEY),
        ("db_pwd: xK9/aB3dE+fG7hJ2", "xK9/aB3dE+fG7hJ2"),
        (f"auth_header: {JWT}\nnext: 1", JWT),
        (f"db_pwd = '{JWT * 6}'", JWT * 6),
        (f"db_pwd: str = '{KEY}'", KEY),
        (f"'db_pwd' => '{KEY}'", KEY),
        (f"{'a' * 300}_pwd={KEY};", KEY),
        (f"url: http://h.de/p?session_pwd={KEY}", KEY),
        (f"u=1&db_pwd={KEY}&other=1", KEY),
        (f"db_pwd = {' + '.join(['x1'] * 30)} + '{KEY}'", KEY),
        (f"note: db_pwd = {KEY}", KEY),
    ],
)
def test_literals_are_whole(text, value):
    assert value in {text[a:b] for a, _, b in secrets.literal_spans(text)}


def test_constants_joined_by_plus():
    text = "partOne = 'Zk93kdlsQ8x1'\npartTwo = 'pQ83lsmeW0x2'\nsecret = partOne+partTwo\n"
    assert [text[a:b] for a, _, b in secrets.literal_spans(text)] == ["Zk93kdlsQ8x1", "pQ83lsmeW0x2"]


@pytest.mark.parametrize("unit", ["a", "a=", "a:", "a ", "=", "&a", "a=b?", "+ ", "x='", "1.-", "a: b[", "a: b | "])
def test_long_texts_take_linear_time(unit):
    begin = time.process_time()
    secrets.find_spans(unit * (200_000 // len(unit)))
    assert time.process_time() - begin < 5
