"""SentencePiece encoding with spans: against the library, its normalisers, and the source text."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from wavelake.llm import piece_spans

PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "aab  ▁\n\t.é<s></s>\0漢😀　é -1230"
ODD = ["", " ", "  ", "a ", " a", "▁", "▁a", "<s>", "<0x41>", "a\nb", "\0", "a" * 5000, "漢" * 3000, " " * 700, "ab" * 400 + "\n" * 600]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(n, letters=LETTERS, size=30, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(size))) for _ in range(n)]


def numbers(ids: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def test_ids_and_decoded_text_equal_the_library(library):
    own, given = piece_spans.Codec(PATH), ODD + texts(5000)
    for text, (ids, _, _, decoded) in zip(given, own.encode(given), strict=True):
        said = library.encode(text)
        assert numbers(ids) == said, text[:50]
        assert decoded == library.decode(said) == own.decode(said), text[:50]


def test_decoded_text_is_that_of_the_ids(monkeypatch):
    """What follows depends on the decoding: where it gives other texts, the decoded text and its digest are others."""
    given, decode = ["Hello  wörld", "one two"], piece_spans.Codec.decode
    before = piece_spans._digests([1, 2], given, PATH)
    monkeypatch.setattr(piece_spans.Codec, "decode", lambda self, ids: decode(self, ids).replace("o", "0"))
    assert [r[3] for r in piece_spans.codec(PATH).encode(given)] == ["Hell0  wörld", "0ne tw0"]
    changed = piece_spans._digests([1, 2], given, PATH)
    assert changed["ids_sha256"] == before["ids_sha256"]
    assert changed["decoded_sha256"] == [hashlib.sha256(t.encode()).hexdigest() for t in ("Hell0  wörld", "0ne tw0")]


def test_any_ids_decode_as_the_library_does(library):
    own, r = piece_spans.Codec(PATH), random.Random(8)
    kinds = [[i for i, kind in enumerate(own.kinds) if kind == k] for k in (piece_spans.BYTE, piece_spans.CONTROL, piece_spans.UNKNOWN)]
    spaces = [i for i, name in enumerate(own.names) if name.startswith(piece_spans.SPACE)][:50] + [own.names.index(piece_spans.SPACE)] * 20
    for _ in range(4000):
        ids = [r.choice(r.choice([*kinds, spaces, range(len(own.names))])) for _ in range(r.randrange(9))]
        assert own.decode(ids) == library.decode(ids), ids


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_spans, "WORDS", 3)
    own, given = piece_spans.Codec(PATH), texts(300)
    for k in range(0, 300, 20):
        assert [numbers(r[0]) for r in own.encode(given[k : k + 20])] == library.encode(given[k : k + 20])


def test_spans_are_places_in_the_source(library):
    own, given = piece_spans.Codec(PATH), ODD + texts(2000, seed=4)
    for text, (ids, starts, ends, _) in zip(given, own.encode(given), strict=True):
        data = text.encode()
        assert b"".join(data[a:b] for a, b in zip(starts, ends, strict=True)) == data
        for i, a, b, said in zip(numbers(ids), starts, ends, library.encode(text, return_type="proto").pieces, strict=True):
            if own.kinds[i] == piece_spans.BYTE:
                assert data[a:b] == bytes([int(own.names[i][3:5], 16)])
            else:
                assert (a, b) == (said.begin, said.end)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf", "identity"])
def test_compiled_maps_normalise_as_the_library_does(rule):
    said = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    own = piece_spans.Normaliser(said.serialized_normalizer_spec())
    for text in ODD + texts(1500, LETTERS + "ﬁ①ｶﾞアＡ​﻿İßＭ㌔½", 20, 9):
        made, source = own(text)
        expected, places = said.normalize(text, with_offsets=True)
        assert made == expected
        assert len(source) == len(made.encode()) + 1
        starts = [0, *(len(made[:k].encode()) for k in range(1, len(made) + 1))]
        # The library gives the characters of the source; ours are its bytes, and tell the bytes of copied characters apart.
        assert [len(text.encode()[: source[s]].decode(errors="ignore")) for s in starts] == places or not made


def test_round_trip_and_general_columns(spark, library):
    given = [(1, "Hello  wörld"), (1, "Hello  wörld"), (2, None), (3, ""), (None, "漢字\n\n")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in given], "doc_id bigint, text string, ids string")
    rows = piece_spans.round_trip(docs, PATH).collect()
    assert len(rows) == 5
    for r, (i, t) in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)), given, strict=True):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    whole = {r.doc_id: r for r in piece_spans.encode(docs, PATH).collect()}
    assert whole[1].ids == library.encode("Hello  wörld") and whole[1].decoded == "Hello  wörld" and whole[1].ends[-1] == 13
    assert whole[2].ids == [] == whole[2].ends
    assert piece_spans.round_trip(docs.where("false"), PATH).count() == 0


def test_models_it_does_not_read(tmp_path):
    with open(PATH, "rb") as f:
        fields = list(piece_spans.message(f.read()))
    bare = b"".join(piece_spans._field(k, v) for k, v in fields if k != piece_spans.TRAINER) + piece_spans._field(piece_spans.TRAINER, b"\x18\x01")
    (tmp_path / "other.model").write_bytes(bare)
    with pytest.raises(ValueError, match="merges"):
        piece_spans.Codec(str(tmp_path / "other.model"))


def test_a_model_that_trims_and_has_unknown_characters(tmp_path):
    r, given = random.Random(5), texts(400, "aab  bca -1", 30, 6)
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=iter(given * 3), model_prefix=str(tmp_path / "m"), model_type="bpe", vocab_size=40, minloglevel=2)
    said = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    own = piece_spans.Codec(str(tmp_path / "m.model"))
    for text, (ids, _, _, decoded) in zip(given + ODD, own.encode(given + ODD), strict=True):
        assert numbers(ids) == said.encode(text) and decoded == said.decode(numbers(ids)), text[:50]
    for _ in range(2000):
        ids = [r.choice([0, 1, 2, own.names.index("▁"), r.randrange(len(own.names))]) for _ in range(r.randrange(7))]
        assert own.decode(ids) == said.decode(ids), ids
