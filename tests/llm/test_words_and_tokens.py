from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from funnelcast.llm import encode, orc_tokens, packing, words
from funnelcast.llm.encode import encoder
from funnelcast.llm.host_rules import repeat_words
from .conftest import ODD

WORD_FILE, BYTE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \n\t\x0b\r\xa0abAB.,'é!1", max_size=40)), max_size=8)


def split(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(3, 50))
def test_word_hashes_agree_with_splitting(texts, block):
    buf, off = words.raw(pa.array(texts, pa.string()))
    old, words.BLOCK_BYTES = words.BLOCK_BYTES, block
    try:
        h, counts = words.hashes(buf, off, lower=True)
    finally:
        words.BLOCK_BYTES = old
    expected = [split(t, True) for t in texts]
    assert counts.tolist() == [len(x) for x in expected]
    seen = {}
    for w, x in zip([w for one in expected for w in one], h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=60), max_size=5))
def test_repeat_words_against_counting(texts):
    buf, off = words.raw(pa.array(texts, pa.string()))
    h, counts = words.hashes(buf, off)
    for text, got in zip(texts, repeat_words(h, counts)):
        w = text.split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        assert got == len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)})


def plain(path, text):
    """The library's own call on a file nothing else has touched."""
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


PIECES = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "don't", "I'll", "x's.", "a1b2", "mail@x.org,", "\n\n", " ", "  ", "Été", "(word)", "'"])


@pytest.mark.parametrize("path", [WORD_FILE, BYTE_FILE])
@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.one_of(PIECES, st.text(alphabet=" \n\t\xa0aBé.'!1<|>s,;", max_size=12)), max_size=6).map("".join), min_size=1, max_size=6))
def test_encoder_agrees_with_the_library(path, texts):
    ids, per = encoder(path).encode(pa.array(texts, pa.string()))
    tok = Tokenizer.from_file(path) if path not in FRESH else FRESH[path]
    FRESH[path] = tok
    expected = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert per.tolist() == [len(x) for x in expected]
    assert ids.tolist() == [i for x in expected for i in x]


FRESH: dict = {}


@pytest.mark.parametrize("path", [WORD_FILE, BYTE_FILE])
def test_sweeps_of_the_memo_change_nothing(path, monkeypatch):
    monkeypatch.setattr(encode, "MEMO", 40)
    enc, tok = encode.Encoder(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(4)
    for _ in range(30):
        texts = [" ".join(f"w{int(i)}" for i in rng.zipf(1.5, 12) % 500) for _ in range(4)]
        ids, per = enc.encode(pa.array(texts, pa.string()))
        expected = [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert per.tolist() == [len(x) for x in expected] and ids.tolist() == [i for x in expected for i in x]


@pytest.mark.parametrize("path", [WORD_FILE, BYTE_FILE])
def test_only_new_units_are_looked_up_twice(path):
    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

    enc = encode.Encoder(path)
    enc.memo = Counted()
    enc.encode(pa.array([" ".join(f"unit{i}" for i in range(300))], pa.string()))
    met, asked = len(enc.memo), enc.memo.asked
    assert asked == 2 * met
    enc.encode(pa.array([" ".join(f"unit{i}" for i in range(300)) + " another"], pa.string()))
    assert enc.memo.asked - asked == met + 2 * (len(enc.memo) - met)


def test_time_major_visits_every_token_once():
    order, token, border = words.time_major(np.array([3, 1, 0, 4]))
    assert order.tolist() == [3, 0, 1, 2] and sorted(token.tolist()) == list(range(8)) and border.tolist() == [0, 3, 5, 7, 8]


def test_cuts_are_powers_of_two():
    for total in (1, 2, 2047, 2048, 2049, 6000):
        pieces = packing.cuts(total)
        assert sum(pieces) == total and all(p & (p - 1) == 0 and p <= 2048 for p in pieces) and pieces == sorted(pieces, reverse=True)


def test_packing_round_trip(odd, none):
    rows = packing.pack(odd, WORD_FILE).collect()
    expected = sorted((i is None, i or 0, tuple([*plain(WORD_FILE, t), 1])) for i, t, *_ in ODD)
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length == 1 << r.bucket for r in rows)
    docs, now = [], None
    for r in sorted(rows, key=lambda r: r.sequence_id):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        if r.start == 0:
            now = []
            docs.append((r.doc_id, r.doc_tokens, now))
        assert r.start == len(now)
        now += ids
    assert sorted((i is None, i or 0, tuple(ids)) for i, _, ids in docs) == expected and all(n == len(ids) for _, n, ids in docs)
    assert packing.digest(packing.pack(none, WORD_FILE)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(none, WORD_FILE, max_len=1000)


def test_orc_files_keep_every_document(spark, odd, none, tmp_path):
    path = str(tmp_path / "t")
    orc_tokens.write_tokens(odd, path, BYTE_FILE)
    rows = orc_tokens.with_starts(orc_tokens.read_tokens(spark, path)).collect()
    whole = [(i, [*plain(BYTE_FILE, t), 0]) for i, t, *_ in ODD]
    expected = sorted((i is not None, i or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in whole)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == expected
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id is not None for r in rows] == sorted(r.doc_id is not None for r in rows)
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert ids == sorted(ids)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    got = orc_tokens.read_tokens(spark, path).filter("doc_id = 6").collect()
    assert got[0].ids == whole[8][1]
    orc_tokens.write_tokens(none, path, BYTE_FILE)
    assert orc_tokens.with_starts(orc_tokens.read_tokens(spark, path)).count() == 0


def test_starts_of_equal_ids_are_their_place_in_the_files(spark, frame, tmp_path):
    path, rows = str(tmp_path / "ties"), [(7, f"text {i % 40} " * (i % 40), "en", "s") for i in range(60)] + [(i, "x", "en", "s") for i in range(5)]
    orc_tokens.write_tokens(frame(rows + [(9, "x <|endoftext|> y", "en", "s")]).repartition(4), path, BYTE_FILE)
    files = sorted(str(f) for f in (tmp_path / "ties").glob("part-*.orc"))
    stored = [(r.doc_id, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for f in files for r in spark.read.orc(f).collect()]
    want, at = set(), 0
    for doc_id, n, crc in stored:
        want.add((at, doc_id, n, crc))
        at += n
    found = orc_tokens.with_starts(orc_tokens.read_tokens(spark, path)).collect()
    assert {(r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in found} == want and len(found) == len(want) == 66


def test_space_class_matches_the_contract():
    assert [c for c in range(256) if words.SPACE[c]] == [c for c in range(128) if re.match(r"[\x20\x09-\x0D]", chr(c))]
