"""Token ids by a public tokenizer's vocabulary, each distinct piece of text encoded once per worker."""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable
from itertools import chain, compress
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

#: White space other than space and newline (with the separators that regex dialects disagree on).
ODD_SPACE = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0                　"
#: Distinct pieces that a worker remembers, and the most bytes of one of them.
REMEMBER, REMEMBERED_BYTES = 400_000, 64
#: One pre-token of byte-level BPE: a line end, or Latin letters, digits or ASCII punctuation, led by a space or not.
PLAIN = re.compile(r"""\n| ?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)""")


#: Found in a text in which a pre-token may not begin at every space, so that it cannot be cut there (RE2).
UNCUT = rf"  |\n \n| \z|[{ODD_SPACE}]"


#: Classes of bytes: all others, letters, digits, punctuation, apostrophes, line ends, spaces, first bytes of À to ɏ.
OTHER, LETTER, DIGIT, MARK, QUOTE, LINE, SPACE, LEAD = range(8)


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    kinds[33:127] = MARK
    for kind, chars in ((DIGIT, "0-9"), (LETTER, "A-Z"), (LETTER, "a-z")):
        kinds[ord(chars[0]) : ord(chars[2]) + 1] = kind
    kinds[ord("'")], kinds[ord("\n")], kinds[ord(" ")], kinds[0xC3:0xCA] = QUOTE, LINE, SPACE, LEAD
    return kinds


def _class_cuts() -> np.ndarray:
    """Whether a pre-token always begins between two bytes of these classes, the first times 8 plus the second."""
    cuts = np.zeros((8, 8), bool)
    cuts[:, SPACE] = True
    cuts[[LETTER, DIGIT, MARK, QUOTE], LINE] = True
    cuts[[LETTER, DIGIT], MARK] = cuts[[LETTER, DIGIT], QUOTE] = True
    cuts[LETTER, DIGIT] = cuts[DIGIT, LETTER] = True
    cuts[MARK, LETTER] = cuts[MARK, DIGIT] = True  # an apostrophe may begin a contraction: no cut after one
    return cuts.ravel()


KINDS, CUTS = _byte_classes().tobytes(), _class_cuts().tobytes().ljust(256, b"\0")


def cut_places(data: np.ndarray) -> np.ndarray:
    """Where a pre-token of byte-level BPE certainly begins in UTF-8 bytes in which one begins at every space."""
    kinds = np.frombuffer(bytearray(data.tobytes().translate(KINDS)), np.uint8)  # bytes.translate is several times as fast as indexing
    lead = np.flatnonzero(kinds == LEAD)
    lead = lead[lead + 1 < len(data)]
    first, second = data[lead], data[lead + 1]
    sign = (first == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (first == 0xC9) & (second > 0x8F)  # × and ÷, and beyond ɏ
    kinds[lead] = kinds[lead + 1] = np.where(sign, OTHER, LETTER)
    cuts = np.zeros(len(data), bool)
    cuts[1:] = np.frombuffer((kinds[:-1] << 3 | kinds[1:]).tobytes().translate(CUTS), bool)
    visible = (kinds >= LETTER) & (kinds <= QUOTE)
    line = np.flatnonzero(kinds[1:-1] == LINE) + 1
    cuts[line[visible[line - 1] & visible[line + 1]] + 1] = True  # after single line ends
    return cuts


class PieceEncoder:
    """Ids of whole texts by an encoder whose results of pieces add up to those of the text.

    encode_pieces gives all ids of a list of strings and the number of each one's. Texts are cut, in NumPy, where a
    pre-token certainly begins (a text in which a space may not begin one stays whole); Arrow finds the distinct pieces of
    a call and looks them up, and only new ones become Python strings. Pieces of at most REMEMBERED_BYTES are encoded once; when more than
    `remember` are known, those of the last call stay.
    """

    def __init__(self, encode_pieces: Callable, remember: int = REMEMBER):
        self.encode_pieces, self.remember = encode_pieces, remember
        self.known = pa.array([], pa.large_string())  # numbered by place
        self.last = np.zeros(0, np.int64)
        self.lens, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def forget(self) -> None:
        """Keep the pieces of the last call only."""
        starts = np.cumsum(self.lens) - self.lens
        self.flat, self.lens = gather(self.flat, starts[self.last], self.lens[self.last]), self.lens[self.last]
        self.known, self.last = self.known.take(pa.array(self.last)), np.arange(len(self.last))

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the number of each text's."""
        if len(self.known) > self.remember:
            self.forget()
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        gc.disable()  # hundreds of thousands of small lists, none in a cycle: looking for cycles took a third of the time
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, places, body = texts.buffers()
        bounds = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        bounds, low = bounds - bounds[0], int(bounds[0])
        if not bounds[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        body = body.slice(low, int(bounds[-1]))
        cuts = cut_places(np.frombuffer(body, np.uint8))
        for i in np.flatnonzero(pc.match_substring_regex(texts, UNCUT).to_numpy(zero_copy_only=False)):
            cuts[bounds[i] : bounds[i + 1]] = False
        cuts[bounds[:-1][bounds[:-1] < len(cuts)]] = True
        firsts = np.flatnonzero(cuts)
        offsets = np.append(firsts, bounds[-1])
        pieces = pa.Array.from_buffers(pa.large_string(), len(firsts), [None, pa.py_buffer(offsets), body]).dictionary_encode()
        flat, lens, code = self._numbered(pieces.dictionary)
        at = code[pieces.indices.to_numpy()]
        own = lens[at]
        ends = np.insert(np.cumsum(own), 0, 0)
        counts = np.diff(ends[np.searchsorted(firsts, bounds)])
        return gather(flat, (np.cumsum(lens) - lens)[at], own), counts

    def _numbered(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids at hand, how many each numbered piece has, and the numbers of these pieces."""
        long = np.diff(np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]) > REMEMBERED_BYTES
        code = pc.index_in(pieces, self.known).fill_null(-1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero((code < 0) & ~long)
        if len(fresh):
            code[fresh] = np.arange(len(self.lens), len(self.lens) + len(fresh))
            own = pieces.take(pa.array(fresh))
            ids, lens = self.encode_pieces(own.to_numpy(zero_copy_only=False).tolist())
            self.known = pa.concat_arrays([self.known, own])
            self.lens, self.flat = np.concatenate([self.lens, lens]), np.concatenate([self.flat, ids])
        self.last = code[~long]
        if not long.any():
            return self.flat, self.lens, code
        ids, lens = self.encode_pieces(pieces.filter(pa.array(long)).to_numpy(zero_copy_only=False).tolist())
        code[long] = len(self.lens) + np.arange(len(lens))
        return np.concatenate([self.flat, ids]), np.concatenate([self.lens, lens]), code


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """flat[starts[0] : starts[0] + lens[0]], then the next, in one array."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((starts - (ends - lens)).astype(kind), lens)
    at += np.arange(total, dtype=kind)
    return flat[at]


class _WholeEncoder:
    def __init__(self, encode_many: Callable):
        self.encode_many = encode_many

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_many(texts.to_pylist() if isinstance(texts, pa.Array) else texts)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the others for letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


def json_encoder(vocabulary: str) -> PieceEncoder | _WholeEncoder:
    """This worker's encoder of a vocabulary in the tokenizers library's JSON (its content, not its path).

    Where the vocabulary is one of byte-level BPE, texts are cut into pieces here, and the library's model is asked for
    each distinct plain one; all else goes through the library's whole chain.
    """

    def make() -> PieceEncoder | _WholeEncoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary)
        tokenizer.encode_special_tokens = True
        rules = json.loads(vocabulary)
        cut = rules.get("pre_tokenizer") or {}
        byte_level = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not rules.get("normalizer") and rules["model"].get("type", "BPE") == "BPE"
        tokenize, letters = tokenizer.model.tokenize, _byte_letters()
        del letters[0]  # parts plain pieces, none of which holds it

        def encode_many(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            out = [np.array(e.ids, np.uint32) for i in range(0, len(texts), 2000) for e in tokenizer.encode_batch_fast(texts[i : i + 2000], add_special_tokens=False)]
            return np.concatenate([*out, np.zeros(0, np.uint32)]), np.fromiter(map(len, out), np.int64, len(out))

        def encode_pieces(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            plain = np.fromiter((len(p) <= REMEMBERED_BYTES and PLAIN.fullmatch(p) is not None for p in pieces), bool, len(pieces))
            joined = "\0".join(compress(pieces, plain)).encode().decode("latin-1").translate(letters)
            counts: list[int] = []

            def found():
                for own in map(tokenize, joined.split("\0") if plain.any() else ()):
                    counts.append(len(own))
                    yield own

            flat = np.fromiter(map(attrgetter("id"), chain.from_iterable(found())), np.uint32)
            if plain.all():
                return flat, np.array(counts, np.int64)
            others, own = encode_many(list(compress(pieces, ~plain)))
            lens, starts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
            lens[plain], lens[~plain] = counts, own
            starts[plain], starts[~plain] = np.cumsum(counts) - counts, len(flat) + np.cumsum(own) - own
            return gather(np.concatenate([flat, others]), starts, lens), lens

        return PieceEncoder(encode_pieces) if byte_level else _WholeEncoder(encode_many)

    return held(("encoder", hash(vocabulary)), make)


def vocabulary(spark, path: str):
    """The vocabulary file's content as a broadcast; its size is that of a public vocabulary, whatever the input."""
    limit = 64 << 20
    if os.path.getsize(path) > limit:
        raise ValueError(f"{path} is larger than {limit} bytes")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())
