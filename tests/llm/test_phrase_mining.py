"""Phrase mining against plain counting, whatever the sample, the filter and the chunks are."""

import random
import re
from collections import Counter

import pytest

from wavelake.llm import phrase_mining as M

LEAST = 5


def plain_counts(docs):
    out = {}
    for lang, text in docs:
        own = out.setdefault(lang or "und", Counter())
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for n in range(1, 5):
                own.update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    return out


def plain(docs, least=LEAST, covered=80, top=2000):
    rows = []
    for lang, f in plain_counts(docs).items():
        n = sum(c for p, c in f.items() if " " not in p)
        candidates = {p: a for p, a in f.items() if " " in p and a >= least}
        kept = []
        for p, a in candidates.items():
            w = p.split(" ")
            if any(f" {p} " in f" {q} " and 100 * b >= covered * a for q, b in candidates.items() if len(q.split(" ")) > len(w)):
                continue
            cuts = [(2000000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            kept.append((-score, -a, p.encode(), f[" ".join(w[:k])], f[" ".join(w[k:])]))
        rows += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(rows)


def documents(n, seed):
    r = random.Random(seed)
    words = ["New", "york", "city", "hall", "a", "b", "the", "Été", "x-y", "İ", "ß", "0"]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(r.randrange(40)))
    return [(r.choice(["en", "fr", None]), r.choice([text(), "new york city hall"])) for _ in range(n)] + [("en", None), ("de", ""), ("de", ".,;")]


def frame(spark, docs):
    return spark.createDataFrame([(l, t, "clash", 3) for l, t in docs], "lang string, text string, phrase string, f int").repartition(3)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("sample,bits,chunk", [(8, 1 << 16, 3_000_000), (1 << 40, 1 << 16, 50), (1, 1 << 16, 100), (3, 1 << 7, 1000)])
def test_equals_plain_counting(spark, sample, bits, chunk):
    """No sample at all (every border word fails, pass after pass), all documents as the sample, and a filter that takes most phrases for proposed."""
    docs = documents(150, chunk)
    assert got(M.collocations(frame(spark, docs), least=LEAST, sample=sample, bits=bits, chunk=chunk)) == plain(docs)


def test_top_and_ties(spark):
    docs = [("en", "a b. c d. e f. g h")] * 6
    rows = got(M.collocations(frame(spark, docs), least=LEAST, top=3))
    assert rows == plain(docs, top=3) and [r[2] for r in rows] == ["a b", "c d", "e f"]


def test_contained_phrases_go_when_the_longer_one_covers_them(spark):
    docs = [("en", "p q r s")] * 8 + [("en", "p q")] * 2 + [("en", "q r")] * 3
    rows = got(M.collocations(frame(spark, docs), least=LEAST))
    assert rows == plain(docs)
    assert {r[2] for r in rows} == {"p q r s", "q r"}  # 8 of 10 cover p q, 8 of 11 don't cover q r


def test_mined_counts_and_empty_tables(spark):
    docs = documents(60, 4)
    mined = {(r.lang, r.phrase): r.f for r in M.mine(frame(spark, docs), least=LEAST).collect()}
    counts = plain_counts(docs)
    assert {k: f for k, f in mined.items() if k[1]} == {(lang, p): f for lang, c in counts.items() for p, f in c.items() if f >= LEAST}
    assert all(mined[lang, ""] == sum(f for p, f in c.items() if " " not in p) for lang, c in counts.items())
    assert got(M.collocations(frame(spark, docs).where("false"))) == []


def test_scores_beyond_64_bits(spark):
    """The arithmetic of the score, on counts that no small table holds."""
    big = 9_000_000_000_000_000_000
    said = spark.sql(f"SELECT CAST({big} AS BIGINT) AS a, CAST({big} AS BIGINT) AS l, CAST({big - 7} AS BIGINT) AS r")
    assert said.selectExpr(f"{M.SCORE} AS s").first().s == 2000000 * big // (2 * big - 7)


def test_a_further_pass_reads_only_around_what_it_was_told(monkeypatch):
    """Counts of what comes into reach are those over all words, but only the words around the last filter's are counted."""
    r = random.Random(11)
    data = " ".join(r.choice("abcdefgh") * r.choice([1, 1, 9]) + r.choice(["", "", ".", "\n"]) for _ in range(3000)).encode().translate(M._BYTES)
    keys, _, pieces = M.word_keys(data)
    keys = M._tagged(keys, 1)

    def made(phrases, bits):
        words = M.np.zeros(bits // 64, M.np.uint64)
        for key in phrases:
            for k in range(M.PROBES):
                at = int(M.probe(M.np.array([key], M.np.uint64), k, bits)[0])
                words[at >> 6] |= M.np.uint64(1 << (at & 63))
        return M.Filter(words)

    everything = {int(k): int(n) for _, ks, ns in M.reached(keys, pieces, 4, []) for k, n in zip(ks, ns, strict=True)}
    some = sorted(k for k in everything if k & 3 < 3)
    first = made(r.sample(some, len(some) // 3) + [k for k in some if k & 3 == 0][2:], 1 << 16)
    for told in (r.sample(some, 3), [k for k in some if k & 3 == 0][:1], []):
        last = made(told, 1 << 7)
        counted = lambda filters: {int(k): int(n) for _, ks, ns in M.reached(keys, pieces, 4, filters) for k, n in zip(ks, ns, strict=True)}
        both = made([], 1 << 16)
        monkeypatch.setattr(both, "has", lambda k, a=first, b=last: a.has(k) | b.has(k))
        before, now, new = counted([first]), counted([both]), counted([first, last])
        assert new == {k: n for k, n in now.items() if k not in before}
        near = M._around(keys, pieces, 4, last)
        assert len(near) < len(keys) and (len(near) == 0) == (not told)


def test_words_of_any_length_have_keys_of_their_own():
    """Words that differ in one byte, or only in length, around the lengths at which keys are made in another way."""
    words = [b"x" * n for n in range(1, 140)] + [b"x" * k + b"y" + b"x" * (n - k - 1) for n in (1, 7, 8, 9, 16, 17, 63, 64, 65, 66, 130) for k in range(n)]
    keys, starts, pieces = M.word_keys(b" ".join(words))
    assert len(keys) == len(words) and len(set(keys.tolist())) == len(set(words)) and not pieces.any()
    apart = [int(M.word_keys(b"\n  " + w + b"\n")[0][0]) for w in words]
    assert apart == keys.tolist()
    assert M.word_keys(b"\n a\nb c\n\nd")[2].tolist() == [1, 2, 2, 4]


def test_a_chunk_of_many_different_words():
    """Pairs of words are told apart where their numbers' products pass 32 bits."""
    r = random.Random(2)
    text = " ".join(f"w{r.randrange(90_000)}" + r.choice(["", "", "."]) for _ in range(200_000)) + " a b c d" * 3
    counts = M._Counts()
    counts.add(M.plain_bytes(text))
    every = M.Filter(M.np.full(1 << 6, ~M.np.uint64(0)))
    made = {p.decode(): int(n) for _, phrases, ns in counts.counted("en", every) for p, n in zip(phrases, ns, strict=True)}
    expected = plain_counts([("en", text)])["en"]
    assert made.pop("") == sum(f for p, f in expected.items() if " " not in p) and made == expected
