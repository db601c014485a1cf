"""What looks like a secret and is none stays; keyed secrets of held-out kinds are found. The kinds here are written apart from those the field is fitted on."""

import base64
from datetime import datetime, timedelta
from pathlib import Path
from random import Random
from uuid import UUID

import pytest

from heliodor.llm import secrets

DATA = "/root/testdata/sf0.01/documents.parquet"


def some(r, alphabet, n):
    return "".join(r.choice(alphabet) for _ in range(n))


DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEGATIVES = {
    "iso time": lambda r: (datetime(1980, 1, 1) + timedelta(seconds=r.randrange(10**9))).isoformat() + "Z",
    "doi": lambda r: f"10.{r.randrange(1000, 9999)}/j.{some(r, LOWER, 6)}.{r.randrange(1990, 2030)}.{some(r, DIGITS, 6)}",
    "long number": lambda r: some(r, DIGITS, r.randrange(13, 16)),
    "camera file": lambda r: f"IMG_{r.randrange(1990, 2030)}{r.randrange(1, 13):02d}{r.randrange(1, 29):02d}_{some(r, DIGITS, 6)}.jpg",
    "uuid": lambda r: str(UUID(int=r.getrandbits(128))),
    "version": lambda r: f"lib{some(r, LOWER, 4)}-{r.randrange(9)}.{r.randrange(30)}.{r.randrange(30)}-x86_64",
    "inline image": lambda r: "data:image/png;base64," + base64.b64encode(r.randbytes(90)).decode(),
    "phone": lambda r: f"+{r.randrange(1, 99)}-{some(r, DIGITS, 3)}-{some(r, DIGITS, 3)}-{some(r, DIGITS, 4)}",
    "iban": lambda r: f"DE{some(r, DIGITS, 20)}",
    "url": lambda r: f"https://www.{some(r, LOWER, 7)}.com/{some(r, LOWER, 5)}/{r.randrange(2000, 2030)}/{some(r, LOWER, 8)}-{some(r, LOWER, 6)}",
    "path": lambda r: f"/usr/share/{some(r, LOWER, 6)}/{some(r, LOWER, 7)}{r.randrange(9)}/{some(r, LOWER, 5)}.conf",
    "camel case": lambda r: "".join(r.choice(("get", "Read", "Async", "Buffer", "Factory", "Handler", "Value", "Index")) for _ in range(4)),
    "isbn": lambda r: f"978-{r.randrange(9)}-{some(r, DIGITS, 4)}-{some(r, DIGITS, 4)}-{r.randrange(9)}",
    "sequence": lambda r: some(r, "ACGT", 40),
    "mac": lambda r: ":".join(some(r, DIGITS + "ABCDEF", 2) for _ in range(6)),
    "chemical key": lambda r: f"{some(r, UPPER, 14)}-{some(r, UPPER, 10)}-N",
    "invoice": lambda r: f"INV-{r.randrange(2000, 2030)}-{some(r, DIGITS, 6)}",
    "coordinates": lambda r: f"{r.randrange(90)}.{some(r, DIGITS, 6)},{r.randrange(180)}.{some(r, DIGITS, 6)}",
}
MIXED = UPPER + LOWER + DIGITS
KEYED = {
    "auth base64": lambda r: (f"Authorization: Bearer {(x := some(r, MIXED + '+/', 40))}", x),
    "private hex": lambda r: (f"private_key = {(x := some(r, DIGITS + 'ABCDEF', 64))}", x),
    "credential": lambda r: (f'credential: "{(x := some(r, MIXED, 32))}"', x),
    "auth joined": lambda r: (f"auth={(x := some(r, MIXED, 36))}", x),
    "pwd": lambda r: (f"pwd: {(x := some(r, MIXED + '_-', 28))}", x),
    "github": lambda r: (f"use ghp_{(x := some(r, MIXED, 36))} here", x),
    "live key": lambda r: (f"auth sk_live_{(x := some(r, MIXED, 24))}", x),
}


def prose(r, n):
    return " ".join(some(r, "etaoinshrdlucm", r.randrange(2, 10)) for _ in range(n))


@pytest.fixture(scope="module", params=["corpus", "nothing"])
def scores(spark, request):
    """A field fitted on the test corpus, and one fitted on plain prose alone."""
    r = Random(3)
    if request.param == "corpus":
        if not Path(DATA).exists():
            pytest.skip("no test corpus")
        docs = spark.read.parquet(DATA)
    else:
        docs = spark.createDataFrame([(k, prose(r, 150)) for k in range(300)], "doc_id bigint, text string")
    return secrets.Scores(secrets.fit_field(docs))


@pytest.mark.parametrize("kind", NEGATIVES)
def test_other_strings_stay(scores, kind):
    r, hit = Random(kind), 0
    for k in range(100):
        text = f"{prose(r, 25)} {('', '(', 'see ', 'from: ')[k % 4]}{NEGATIVES[kind](r)}{('', ')', ',', '.')[k % 4]} {prose(r, 25)}"
        hit += secrets.redacted(text, scores) != text and not secrets.base_spans(text, text.lower().encode())
    assert hit <= 5


def test_keyed_secrets_are_found(scores):
    for kind, make in KEYED.items():
        r, found = Random(kind), 0
        for _ in range(60):
            words, value = make(r)
            found += value not in secrets.redacted(f"{prose(r, 30)} {words} {prose(r, 30)}", scores)
        assert found >= 54, (kind, found)
