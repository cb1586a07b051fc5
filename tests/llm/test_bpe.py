from __future__ import annotations

import hashlib
import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pricelode.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(PATH)


def same(text, library, own):
    ids = library.encode(text, add_special_tokens=False).ids
    assert list(own.encode(text)) == ids
    machine = bpe.Decoder(own.vocabulary, marked=True)
    assert machine.push(ids[:3]) + machine.push(ids[3:]) + machine.close() == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehinorstABÉéßüñΣσİ0129!'\".,- \n\t\x1c\x85\xa0́　中文😀", max_size=60))
def test_like_the_library(text):
    same(text, Tokenizer.from_file(PATH) if not hasattr(test_like_the_library, "lib") else test_like_the_library.lib, bpe.encoder(PATH))


test_like_the_library.lib = Tokenizer.from_file(PATH)


def test_long_words_without_a_break(library, own):
    r = random.Random(0)
    for alphabet in ("ab", "aeinrstho", "!?.", "1", "é"):
        same("".join(r.choice(alphabet) for _ in range(9_000)), library, own)
    same("ha" * 5_000 + " " + "a" * 70_000, library, own)


def test_special_tokens_contractions_and_slices(library, own, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 50)
    same("x<|endoftext|>y <|startoftext|><|endoftext|> don't we'll 'the THE'S " * 20, library, own)


def test_holds_back_no_more_than_the_window(own):
    machine = bpe.Transducer(own.vocabulary)
    most = 0
    for _ in range(20_000):
        list(machine.push("a"))
        most = max(most, len(machine.pending))
    assert most <= 2 * machine.window


def test_plain_text_comes_back(own):
    text = "naïve café 中文 word"
    machine = bpe.Decoder(own.vocabulary, marked=False)
    out = "".join(machine.push([i]) for i in own.encode(text)) + machine.close()
    assert out == "naïve café 中文 word "


def test_digests(documents, library):
    long = "word " * 100_000
    rows = [(1, "Hello  World"), (2, None), (3, ""), (4, long), (4, long), (None, "x")]
    want = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.round_trip(documents(rows), PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.round_trip(documents([]), PATH).collect() == []


def test_encode_and_decode_tables(documents):
    rows = bpe.encoded(documents([(1, "one two"), (2, None)]), PATH)
    assert sorted(tuple(r) for r in bpe.decoded(rows, PATH).collect()) == [(1, "one two "), (2, "")]


def test_words_side_by_side_and_forgotten_ones(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    monkeypatch.setattr(bpe, "BLOCK", 300)
    r = random.Random(3)
    own = bpe.Encoder(PATH)
    words = ["".join(r.choices("aeinrsthoéñ'.,1!中", k=r.randint(1, 70))) for _ in range(300)]
    texts = [" ".join(r.choices(words, k=r.randint(0, 40))) for _ in range(200)] + [None, "", "<|endoftext|>", " "]
    got = own.encode_all(texts)
    assert [list(x) for x in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not any(len(p) > bpe.LONGEST for p in own.known)


def test_ids_leave_before_a_long_word_ends(own):
    machine = bpe.Transducer(own.vocabulary)
    early = [i for _ in range(2_000) for i in machine.push("this")]
    late = list(machine.close())
    assert len(early) > len(late) > 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehinorstABÉéßüñΣσİ0129!'\".,- \n\t\x1c\x85\xa0́　中文😀", max_size=60))
def test_the_transducer_is_like_the_library(text):
    same(text, test_like_the_library.lib, bpe.encoder(PATH, streaming=True))


def test_long_words_through_the_transducer(library):
    test_long_words_without_a_break(library, bpe.Encoder(PATH, streaming=True))


def test_every_word_of_a_corpus_goes_through_the_transducer(library, monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzé0-!", k=r.randint(1, 14))) for _ in range(3_000)]
    own, early, late = bpe.Encoder(PATH, streaming=True), [], []
    push, close = bpe.Transducer.push, bpe.Transducer.close
    monkeypatch.setattr(bpe.Transducer, "push", lambda self, s: early.append(push(self, s)) or early[-1])
    monkeypatch.setattr(bpe.Transducer, "close", lambda self: late.append(close(self)) or late[-1])
    text = " ".join(words)
    assert list(own.encode(text)) == library.encode(text, add_special_tokens=False).ids
    cut = {w for piece in set(words) for w in own.vocabulary.pattern.findall(piece)}
    assert len(late) == len(cut) and sum(map(len, early)) > 1_000  # ids that left within their word


def test_ids_do_not_depend_on_how_a_word_arrives(own):
    r = random.Random(6)
    for _ in range(300):
        word = "".join(r.choices("aeinrsthqxz!.", k=r.randint(1, 60)))
        machine, found, at = bpe.Transducer(own.vocabulary), [], 0
        while at < len(word):
            n = r.randint(1, 5)
            found += machine.push(word[at:at + n])
            at += n
        assert found + machine.close() == [own.vocabulary.ids[t] for t in bpe.merged([*word[:-1], word[-1] + own.vocabulary.end], own.vocabulary.ranks)]


def test_words_met_in_an_earlier_block_and_their_ends_are_not_merged_again(library, monkeypatch):
    r = random.Random(7)
    words = ["".join(r.choices("aeinrsthoéñqxz中", k=r.randint(1, 30))) for _ in range(400)]
    own, calls, merging = bpe.Encoder(PATH, streaming=True), [], []
    word, merged = bpe.Encoder.word, bpe.merged
    monkeypatch.setattr(bpe.Encoder, "word", lambda self, w: calls.append(w) or word(self, w))
    monkeypatch.setattr(bpe, "merged", lambda s, ranks: merging.append(list(s)) or merged(s, ranks))
    for mark in ("", ".", "!!"):  # other pieces of the same words
        text = " ".join(w + mark for w in words)
        assert list(own.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert len(calls) == len(set(calls))
    assert not any(s[-1].endswith(own.vocabulary.end) for s in merging)


def test_few_remembered_runs(library, monkeypatch):
    monkeypatch.setattr(bpe, "RUNS", 20)
    r = random.Random(8)
    own = bpe.Encoder(PATH, streaming=True)
    for _ in range(5):
        text = " ".join("".join(r.choices("aeinrsthoéq'.!", k=r.randint(1, 60))) for _ in range(200))
        assert list(own.encode(text)) == library.encode(text, add_special_tokens=False).ids
