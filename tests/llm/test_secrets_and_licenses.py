"""Secrets by cue and validator; license passages; the diagonal votes stay few."""

import random

import duckdb
import pytest

from wavelake.llm import license_diagonals, pii_anchors


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', "04dbebab91ab85687d33eeaaf9ac699e1188f962"),
        ("api_key: abcdEFGH12345678.", "abcdEFGH12345678"),
        ('{"password": "hunter2!x"}', "hunter2!x"),
        ("Authorization: Bearer abcdef0123456789abcdef", "abcdef0123456789abcdef"),
        ("CLIENT_SECRET=>'0123456789abcdefgh'", "0123456789abcdefgh"),
        ("AUTH_TOKEN=aaaaaaaaaaaaaaaa1", "aaaaaaaaaaaaaaaa1"),
        ("a -----BEGIN RSA PRIVATE KEY-----\nMIIE\n-----END RSA PRIVATE KEY----- b", "-----BEGIN RSA PRIVATE KEY-----\nMIIE\n-----END RSA PRIVATE KEY-----"),
        ("-----BEGIN PRIVATE KEY-----\ncut off", "-----BEGIN PRIVATE KEY-----"),
    ],
)
def test_secrets(text, value):
    assert [text[a:b] for k, a, b in pii_anchors.find(text) if k == "secret"] == [value]


@pytest.mark.parametrize("text", ["the token is nice = good words", "tokens = 0123456789abcdef0123", "secret=short1", "password: maybe", "token: https://example.org/a1b2c3d4e5f6", "a secret: nobodyknowswhatitis", "betoken = 0123456789abcdef0123", "password", "token ="])
def test_no_secrets(text):
    assert not [s for s in pii_anchors.find(text) if s[0] == "secret"]


def test_planted_recall():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    plant = {
        "email": lambda: f"u{rng.randrange(999)}.x@mail{rng.randrange(99)}.org",
        "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "phone": lambda: f"+{rng.randrange(10, 99)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)} {rng.randrange(100, 999)}",
        "secret": lambda: rng.choice(["token", "api_key", "secret"]) + rng.choice([' = "', ': "', '="']) + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"',
        "uri": lambda: f"https://me:pw{rng.randrange(99)}@host.org/x",
    }
    for kind, make in plant.items():
        caught = 0
        for _ in range(200):
            text = " ".join(rng.choices(words, k=30) + [make()] + rng.choices(words, k=30))
            caught += any(k == kind for k, _, _ in pii_anchors.find(text))
        assert caught >= 195, kind


def test_counts_follow_the_spans(spark):
    docs = spark.createDataFrame([(1, 'a@b.cc token="0123456789abcdef0" 1.2.3.4'), (2, None)], "doc_id bigint, text string")
    one, two = pii_anchors.scan(docs).orderBy("doc_id").collect()
    assert (one.n_email, one.n_ip, one.n_secret, one.n_spans) == (1, 1, 1, 3) and two.n_spans == 0 and two.spans == ""
    assert "secret:14:31" in one.spans.split(",")


def test_each_passage_gives_its_label(spark):
    rng = random.Random(2)
    filler = [f"w{i}" for i in range(500)]
    rows, want = [], {}
    for i, (label, passage) in enumerate(license_diagonals.TEMPLATES):
        words = passage.upper().split()
        spoiled = [w for k, w in enumerate(words) if k != len(words) // 2] if len(words) > 17 else words
        rows.append((i, " ".join([*rng.choices(filler, k=40), *spoiled, *rng.choices(filler, k=40)])))
        want[i] = label
    got = {r.doc_id: r for r in license_diagonals.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(want[i] in got[i].labels.split(",") for i in want)


def test_equal_to_sql(spark):
    from wavelake.llm.queries import ORACLE

    rng = random.Random(5)
    pool = ["the", "license", "x", *"under the mit license cc by nc apache license version 2".split()]
    parts = [*[t for _, t in license_diagonals.TEMPLATES], *license_diagonals.PHRASES, *pool]
    rows = [(i // 2, rng.choice([", ", " ", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(300)] + [(900, None), (901, ""), (902, "mit"), (903, "É the")]
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = license_diagonals.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).select(columns).collect()
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        want = db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE['op9_license_scan']})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
