"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a byte-to-text state machine.

Reads the public JSON format of the ``tokenizers`` library for vocabularies of this kind: NFC, white space and lower case
normalised, a pattern that cuts words, byte-level symbols with a word-end mark, merges by rank.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.llm.corpus import texts

#: Characters normalised and cut at a time; slices end at ASCII white space.
SLICE = 1 << 16
#: Characters whose new words are encoded side by side.
BLOCK = 1 << 20
#: Pieces whose ids a worker remembers, and the longest piece it remembers and word it encodes beside others.
REMEMBERED, LONGEST = 300_000, 48
#: Symbols on each side of a border that tell whether a merge can cross it, and such surroundings that a worker remembers.
KNOWN, BORDERS = 2, 500_000
#: Runs of symbols between settled borders whose ids a worker remembers.
RUNS = 200_000
#: Bits of an id in the number that stands for a pair of ids.
_PAIR = 20
#: What the normaliser takes for white space (a fixed value of its pattern dialect), and what Python adds to that.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NO_SPACE = re.compile(r"[\x1c-\x1f]")
_PIECES = re.compile(f"[^{_SPACE}]+")
_MARKS = frozenset(",.;:!?")
_SLICE_END = re.compile(r"[\t\n\x0b\x0c\r ]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in set(plain) else chr(256 + next(rest)) for b in range(256)]


class Vocabulary:
    """Vocabulary, merges and patterns of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} is not a BPE vocabulary with word ends")
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**self.ids, **self.special}.items()}
        self.pattern = regex.compile(cut["pattern"]["Regex"].replace(r"\s", _SPACE))
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.symbols = byte_symbols()
        self.lookahead = sufficient_lookahead(merges, self.end)
        self.longest = max(map(len, self.ids))
        self.crossings = Crossings(merges, self.end)


def sufficient_lookahead(merges: list[tuple[str, str]], end: str) -> int:
    """How many symbols after a token must be known for it to stay, whatever follows them.

    What follows can only change tokens through a merge that reaches over the first symbol it changes: a merge ``(u, v)``
    moves that border left by ``u``. A later merge ``(u2, v2)`` moves it again only if its right half starts where the first
    one's left half started, so ``v2`` starts with the string ``u``; and merges apply in the order of their ranks. The
    longest chain of such merges, weighted by their left halves, bounds the distance. One symbol is added for the last
    one, which bears the word end where nothing follows.
    """
    best: dict[str, int] = {}
    most = 0
    for left, right in merges:
        text = right.removesuffix(end)
        reach = len(left) + max((best.get(text[:n], 0) for n in range(1, len(text) + 1)), default=0)
        best[left] = max(best.get(left, 0), reach)
        most = max(most, reach)
    return most + 1


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Applies the merges to the symbols, in place: always the pair of least rank, the leftmost of equal ones."""
    get, none = ranks.get, 1 << 60
    pairs = [get(p, none) for p in zip(symbols, symbols[1:])]  # noqa: B905
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        symbols[i] += symbols.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get((symbols[i], symbols[i + 1]), none)
        if i:
            pairs[i - 1] = get((symbols[i - 1], symbols[i]), none)
    return symbols


class Merges:
    """The merges as sorted arrays, for many short words at once."""

    def __init__(self, vocabulary: Vocabulary):
        ids, end = vocabulary.ids, vocabulary.end
        self.first = np.array([ids[s] for s in vocabulary.symbols], np.int64)
        self.last = np.array([ids[s + end] for s in vocabulary.symbols], np.int64)
        pairs = np.array([ids[a] << _PAIR | ids[b] for a, b in vocabulary.ranks], np.int64)
        self.made = np.array([ids[a + b] for a, b in vocabulary.ranks], np.int64)
        self.none = len(pairs)  # the rank of a pair that no merge takes
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], order

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << _PAIR | right
        at = np.minimum(np.searchsorted(self.pairs, pair), self.none - 1)
        return np.where(self.pairs[at] == pair, self.ranks[at], self.none)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, none of them empty, as 32-bit numbers.

        In each round every word merges its leftmost pair of least rank; words without one are done and leave.
        """
        if not words:
            return []
        data, n = np.frombuffer(b"".join(words), np.uint8), np.array(list(map(len, words)))
        ids, ends = self.first[data], np.cumsum(n)
        ids[ends - 1] = self.last[data[ends - 1]]
        rank = np.full(len(ids), self.none)
        rank[:-1] = self.rank(ids[:-1], ids[1:])
        rank[ends - 1] = self.none
        word = np.arange(len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            least = np.minimum.reduceat(rank, np.cumsum(n) - n)
            ready = least == self.none
            if ready.any():
                leaves = np.repeat(ready, n)
                done.append((word[ready], n[ready], ids[leaves]))
                ids, rank = ids[~leaves], rank[~leaves]
                word, n, least = word[~ready], n[~ready], least[~ready]
                if not len(word):
                    break
            starts = np.cumsum(n) - n
            hits = np.flatnonzero(rank == np.repeat(least, n))
            at = hits[np.searchsorted(hits, starts)]  # the first of each word
            ids[at] = self.made[least]
            rank[at] = rank[at + 1]  # none where the right half was the last
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            inner, after = at > starts, rank[at] < self.none
            after |= at + 2 < starts + n
            rank[at[after]] = self.rank(ids[at[after]], ids[at[after] + 2])
            rank[at[inner] - 1] = self.rank(ids[at[inner] - 1], ids[at[inner]])
            ids, rank, n = ids[stays], rank[stays], n - 1
        word, n, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        held, cuts = ids.astype(np.uint32).tobytes(), np.concatenate([[0], 4 * np.cumsum(n)]).tolist()
        out = [b""] * len(words)
        for w, a, b in zip(word.tolist(), cuts, cuts[1:]):  # noqa: B905
            out[w] = held[a:b]
        return out


class Crossings(dict):
    """Whether some merge can cross a border within a word, by up to ``KNOWN`` symbols before it and ``KNOWN`` after it.

    The first merge ``(u, v)`` that crosses a border joins a token that ends there with one that starts there, so the text
    before the border ends with ``u`` and the text after it starts with ``v``. Where no merge fits, no token ever crosses,
    whatever follows: what stands before the border is encoded by itself.
    """

    def __init__(self, merges: list[tuple[str, str]], end: str):
        super().__init__()
        self.joints: set[tuple[str, str]] = set()
        for left, right in merges:
            text = right.removesuffix(end)
            if text == right or len(text) >= KNOWN:  # the word goes on behind the known symbols, or may end right there
                self.joints.add((left[-KNOWN:], text[:KNOWN]))

    def __missing__(self, around: str) -> bool:
        left, right = around[:-KNOWN], around[-KNOWN:]
        crossed = any(
            (left[i:], right[:j]) in self.joints for i in range(len(left)) for j in range(1, KNOWN + 1))
        if len(self) < BORDERS:
            self[around] = crossed
        return crossed


class Transducer:
    """Encodes one word that arrives in pieces; holds back only what later symbols can still change.

    Ids leave as soon as ``KNOWN`` symbols behind a border show that no merge crosses it. Where no such border comes, they
    leave once the lookahead that suffices for all merges is seen, so what is held back is bounded.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.window = vocabulary.lookahead + 2 * vocabulary.longest
        self.pending = ""
        self.at = 1  # the next border to look at
        self.runs: tuple[dict[str, bytes], ...] = ({}, {})  # ids of runs met before, 32 bits each: within a word, at its end

    def push(self, symbols: str) -> list[int]:
        """Takes more symbols and gives the ids that are stable."""
        v, text, out = self.vocabulary, self.pending + symbols, []
        crossings, start, first = v.crossings, 0, self.at
        for at in range(first, len(text) - KNOWN + 1):
            if not crossings[text[max(start, at - KNOWN):at + KNOWN]]:
                out += self._ids(text[start:at], False)
                start = at
            elif at - start >= 2 * self.window - KNOWN:
                safe = at + KNOWN - v.lookahead
                for token in merged(list(text[start:at + KNOWN]), v.ranks):
                    if start + len(token) > safe:
                        break
                    out.append(v.ids[token])
                    start += len(token)
        self.at = max(first, len(text) - KNOWN + 1) - start  # at least 1
        self.pending = text[start:]
        return out

    def foresee(self, words: list[bytes], merges: Merges) -> None:
        """Merges side by side the runs that will end these words, none of them empty, so that ``close`` finds their ids.

        Finds the borders that ``push`` will, all words at once; what it should miss is only merged later.
        """
        crossings, met = self.vocabulary.crossings, self.runs[True]
        joined = b"".join(words)
        text = "".join(map(self.vocabulary.symbols.__getitem__, joined))
        codes = np.frombuffer(joined, np.uint8).astype(np.int64)
        ends = np.cumsum(list(map(len, words)))
        starts = np.append(0, ends[:-1])

        def settled(at: np.ndarray, before: int) -> np.ndarray:
            around = sum(codes[at + i] << 8 * (i + before) for i in range(-before, KNOWN))
            _, first, back = np.unique(around, return_index=True, return_inverse=True)
            return at[np.array([not crossings[text[i - before:i + KNOWN]] for i in at[first].tolist()], bool)[back]]

        border, inner = np.zeros(len(text), bool), np.ones(len(text), bool)
        border[starts] = True
        inner[starts] = False
        for i in range(1, KNOWN):
            inner[ends - i] = False  # too few symbols behind it
        at = np.flatnonzero(inner)
        border[settled(at[at >= KNOWN], KNOWN)] = True
        near = settled(at, 1)  # where no more symbols count, as a border stands before the last one
        while len(more := near[border[near - 1] & ~border[near]]):
            border[more] = True
        last = np.maximum.reduceat(np.where(border, np.arange(len(text)), 0), starts)
        tails = {text[a:b]: joined[a:b] for a, b in zip(last.tolist(), ends.tolist(), strict=True)}
        new = [t for t in tails if t not in met]
        if len(met) + len(new) > RUNS:
            met.clear()
            new = list(tails)
        for tail, ids in zip(new, merges.encode([tails[t] for t in new]), strict=True):
            met[tail] = ids

    def _ids(self, run: str, ends: bool) -> Iterable[int]:
        """The ids of a run of symbols that no merge leaves, which may end its word."""
        met = self.runs[ends]
        if (found := met.get(run)) is None:
            symbols = list(run)
            if ends:
                symbols[-1] += self.vocabulary.end
            found = array("I", map(self.vocabulary.ids.__getitem__, merged(symbols, self.vocabulary.ranks))).tobytes()
            if len(run) <= LONGEST:
                if len(met) >= RUNS:
                    met.clear()
                met[run] = found
        return memoryview(found).cast("I")

    def close(self) -> list[int]:
        """Ends the word; the next one may follow."""
        last, self.pending, self.at = self.pending, "", 1
        return list(self._ids(last, True)) if last else []


class Encoder:
    """Encodes texts slice by slice; keeps the ids of the pieces between white space that it met, up to a bound.

    With ``streaming`` every word that is not known goes through the transducer; else only those of more than ``LONGEST``
    characters do, and shorter ones are merged side by side.
    """

    def __init__(self, path: str, streaming: bool = False):
        self.streaming = streaming
        self.vocabulary = Vocabulary(path)
        self.merges = Merges(self.vocabulary)
        self.transducer = Transducer(self.vocabulary)
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.earlier_words: dict[str, bytes] = {}

    def meet(self, pieces: set[str]) -> None:
        """Makes the ids of pieces without white space known, as 32-bit numbers."""
        known, find = self.known, self.vocabulary.pattern.findall
        new: dict[str, str | Sequence[str]] = {}
        ids: dict[str, bytes] = {}
        for piece in pieces.difference(known):
            if piece in self.earlier:
                known[piece] = self.earlier[piece]
                continue
            text = normalised(piece)
            if text.isalpha():  # letters alone are one word
                new[piece] = text
                if text not in ids:
                    ids[text] = self._met(text)
                continue
            if text[-1] in _MARKS and text[:-1].isalpha():
                words = text[:-1], text[-1]
            else:
                words = find(text)
            new[piece] = words
            for word in words:
                if word not in ids:
                    ids[word] = self._met(word)
        short = [w for w, own in ids.items() if not own and len(w) <= LONGEST]
        coded = [w.encode() for w in short]
        if self.streaming and short:
            self.transducer.foresee(coded, self.merges)
        else:
            ids.update(zip(short, self.merges.encode(coded), strict=True))
        for word, own in ids.items():
            if not own:
                ids[word] = self.word(word)
            if len(word) <= LONGEST:
                self.words[word] = ids[word]
        for piece, words in new.items():
            known[piece] = ids[words] if isinstance(words, str) else b"".join(map(ids.__getitem__, words))

    def _met(self, word: str) -> bytes:
        """The ids of a word that was met before, else none."""
        if found := self.words.get(word) or self.earlier_words.get(word):
            return found
        return self.known.get(word, b"") if word.isascii() else b""  # its own normal form, so it may be known as a piece

    def word(self, word: str) -> bytes:
        """The ids of one word, emitted as they become stable."""
        symbols, machine = self.vocabulary.symbols, self.transducer
        plain = word.isascii() and word.isprintable()  # such bytes, but for the blank that no word holds, stand for themselves
        data = word if plain else word.encode()
        if len(data) <= SLICE:
            ids = machine.push(data if plain else "".join(map(symbols.__getitem__, data)))
            return array("I", ids + machine.close()).tobytes()
        out = array("I")
        for at in range(0, len(data), SLICE):
            part = data[at:at + SLICE]
            out.extend(machine.push(part if plain else "".join(map(symbols.__getitem__, part))))
        out.extend(machine.close())
        return out.tobytes()

    def streams(self, texts: Iterable[str | None]) -> Iterator[tuple[int, array]]:
        """``(place, ids)`` for the slices of all texts, in order; a text without slices has none."""
        block: list[tuple[int, list[str] | int]] = []
        held = 0
        for place, text in enumerate(texts):
            for part, size in self._parts(text or ""):
                block.append((place, part))
                held += size
                if held >= BLOCK:
                    yield from self._block(block)
                    block, held = [], 0
        yield from self._block(block)

    def _block(self, block: list[tuple[int, list[str] | int]]) -> Iterator[tuple[int, array]]:
        if len(self.known) >= REMEMBERED // 2:  # those not met again before the next half is full are forgotten
            self.known, self.earlier = {}, self.known
            self.words, self.earlier_words = {}, self.words
        pieces = set().union(*(part for _, part in block if isinstance(part, list)))
        self.meet(pieces)
        known = self.known.__getitem__
        for place, part in block:
            ids = array("I")
            if isinstance(part, list):
                ids.frombytes(b"".join(map(known, part)))
            else:
                ids.append(part)
            yield place, ids
        for piece in pieces:
            if len(piece) > LONGEST:
                del self.known[piece]

    def _parts(self, text: str) -> Iterator[tuple[list[str] | int, int]]:
        """The pieces of each slice, or the id of a special token, and their characters."""
        at = 0
        for m in self.vocabulary.specials.finditer(text):
            yield from self._plain(text, at, m.start())
            yield self.vocabulary.special[m[0]], len(m[0])
            at = m.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, at: int, end: int) -> Iterator[tuple[list[str], int]]:
        while at < end:
            to = end
            if end - at > SLICE:
                m = _SLICE_END.search(text, at + SLICE, end)
                to = m.start() if m else end
            part = text[at:to]
            yield _PIECES.findall(part) if _NO_SPACE.search(part) else part.split(), to - at
            at = to

    def stream(self, text: str) -> Iterator[array]:
        """The ids of a text, one array per slice."""
        return (ids for _, ids in self.streams([text]))

    def encode(self, text: str | None) -> array:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[array]:
        out = [array("I") for _ in texts]
        for place, ids in self.streams(texts):
            out[place] += ids
        return out


def normalised(text: str) -> str:
    """NFC in lower case, character by character; white space is left to the pattern, which skips it."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Decoder:
    """Ids to text, step by step. ``marked`` text shows tokens as the vocabulary writes them, with spaces between; plain text
    turns byte symbols into bytes, word ends into spaces, and gives characters as soon as their bytes are complete."""

    def __init__(self, vocabulary: Vocabulary, marked: bool):
        self.vocabulary, self.marked, self.started = vocabulary, marked, False
        self.bytes = {s: b for b, s in enumerate(vocabulary.symbols)}
        self.text = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        tokens = list(map(self.vocabulary.tokens.__getitem__, ids))
        if self.marked:
            out = (" " if self.started and tokens else "") + " ".join(tokens)
            self.started |= bool(tokens)
            return out
        return "".join(map(self._plain, tokens))

    def _plain(self, token: str) -> str:
        if token in self.vocabulary.special:
            return self.text.decode(b"", final=True) + token
        end = token.endswith(self.vocabulary.end)
        body = bytes(self.bytes[c] for c in (token[:-len(self.vocabulary.end)] if end else token))
        return self.text.decode(body + b" " if end else body)

    def close(self) -> str:
        return "" if self.marked else self.text.decode(b"", final=True)


@lru_cache(maxsize=2)
def encoder(path: str, streaming: bool = False) -> Encoder:
    """One encoder per worker, file and way, whose remembered words serve all its tasks."""
    return Encoder(path, streaming)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for each row: digests of the ids as little-endian 32-bit numbers and
    of the text they decode to, in the form that shows tokens. All words go through the transducer.

    A null or empty text has no tokens. Every input row gives a row, whatever its id; other columns are ignored. Row-local:
    no shuffle. Beside a batch of texts a task holds the pieces of about ``BLOCK`` characters, or of one slice, and their ids. ``path`` must be readable on every executor.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, streaming=True)
        empty = 0, hashlib.sha256().hexdigest(), hashlib.sha256().hexdigest()
        for batch in batches:
            rows, at = [empty] * len(batch), -1
            for place, part in own.streams(batch.column(1).to_pylist()):
                if place != at:
                    at, n, ids, decoded = place, 0, hashlib.sha256(), hashlib.sha256()
                    decode = Decoder(own.vocabulary, marked=True)
                n += len(part)
                ids.update(part.tobytes())
                decoded.update(decode.push(part).encode())
                rows[at] = n, ids.hexdigest(), decoded.hexdigest()  # tokens leave whole, nothing is held back
            n, ids, decoded = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, id_col, text_col).mapInArrow(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: the ids of each row's text."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids = [i.tolist() for i in own.encode_all(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))],
                                             ["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(encode, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)``: plain text of each row's ids, words set apart by single spaces. Null ids give an empty text."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            out = []
            for ids in batch.column(1).to_pylist():
                machine = Decoder(own.vocabulary, marked=False)
                out.append(machine.push(ids or ()) + machine.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(
        decode, "doc_id long, text string")
