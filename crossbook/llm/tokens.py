"""Token ids of whole texts, by a public tokenizer file, inside tasks.

The tokenizer drops white space and never joins characters across it, so a
text's ids are the ids of its white-space separated pieces in order. Each
distinct piece of a slice is encoded once; a bounded memo keeps the ids of
pieces seen before in the same worker.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from crossbook.llm.common import LOWER_TABLE, gather_runs, raw_bytes, split_words, sums_between

MEMO_PIECES = 200_000
_LOADED: dict[str, "PieceEncoder"] = {}


def default_tokenizer() -> str:
    """Path of the public tokenizer used by the queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The character that byte-level BPE writes for each byte: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    letters, spare = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            letters.append(chr(b))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


def _char_classes() -> np.ndarray:
    """1: ASCII letter or digit, 2: printable ASCII mark but the apostrophe."""
    classes = np.zeros(256, np.uint8)
    for b in range(0x21, 0x7F):
        if chr(b).isalnum():
            classes[b] = 1
        elif chr(b) != "'":
            classes[b] = 2
    return classes


_CLASSES = _char_classes()
_LOWER = np.frombuffer(LOWER_TABLE, np.uint8)
_TIMES, _DIVIDE = 0x97, 0xB7  # the two Latin-1 signs among the letters after byte C3


def set_apart(texts: pa.Array) -> pa.Array:
    """Texts of ASCII and Latin-1 characters lower-cased, with a space
    between letters or digits and marks. The tokenizer lower-cases and cuts
    there itself, so ids stay the same while distinct pieces get fewer.
    Texts with other characters or with "<|" (special tokens) stay as they are."""
    offsets, raw = raw_bytes(texts)
    if not len(raw):
        return pc.fill_null(texts.cast(pa.string()), "")
    special = (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
    odd = raw >= 0xC4
    odd[:-1] |= special
    plain = np.repeat(sums_between(odd, offsets) == 0, np.diff(offsets))
    kind = _CLASSES[raw]
    after = np.flatnonzero(raw[:-1] == 0xC3) + 1
    low = raw[after]
    letters = after[(low != _TIMES) & (low != _DIVIDE)]
    kind[letters] = 1
    kind[letters - 1] = 1
    cuts = np.flatnonzero((kind[:-1] * kind[1:] == 2) & plain[1:] & plain[:-1]) + 1
    capitals = letters[(raw[letters] < 0x9F)]
    lowered = np.where(plain, _LOWER[raw], raw)
    capitals = capitals[plain[capitals]]
    lowered[capitals] += 0x20
    out = np.insert(lowered, cuts, 0x20)
    offsets = offsets + np.searchsorted(cuts, offsets, "right")
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32).tobytes()),
                                       pa.py_buffer(out.tobytes()))


class PieceEncoder:
    """Ids of white-space separated pieces, as little-endian 32-bit bytes,
    with a memo of bounded size."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.memo: dict[str, bytes] = {}

    def _encode_piece(self, piece: str) -> bytes:
        """A lower-case word of ASCII or Latin-1 letters goes straight to the
        BPE model (the normalizer leaves it as it is), all else through the
        whole tokenizer."""
        if piece.isalpha() and piece.isascii():
            ids = [t.id for t in self.model.tokenize(piece.lower())]
        elif piece.isalpha() and max(piece) <= "\xff":
            spelled = "".join([self.letters[b] for b in piece.lower().encode("utf-8")])
            ids = [t.id for t in self.model.tokenize(spelled)]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids as uint32) of a whole string array; null: no ids."""
        offsets, codes, pieces = split_words(set_apart(texts))
        if not len(codes):
            return np.zeros(len(offsets), np.int64), np.empty(0, np.uint32)
        memo, encoded = self.memo, []
        for piece in pieces.to_pylist():
            ids = memo.get(piece)
            if ids is None:
                ids = self._encode_piece(piece)
                if len(memo) >= MEMO_PIECES:
                    memo.clear()
                memo[piece] = ids
            encoded.append(ids)
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        flat = np.frombuffer(b"".join(encoded), np.uint32)
        starts = np.cumsum(lengths) - lengths
        per_word = lengths[codes]
        ids = flat[gather_runs(starts[codes], per_word)]
        upto = np.concatenate([[0], np.cumsum(per_word)]).astype(np.int64)
        return upto[offsets], ids


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


def id_dtype(path: str) -> np.dtype:
    """Little-endian unsigned type that holds every id of the vocabulary."""
    from tokenizers import Tokenizer

    return np.dtype("<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4")


def with_end(offsets: np.ndarray, ids: np.ndarray, end_id: int, dtype) -> list[np.ndarray]:
    """Each text's ids followed by the end id."""
    return [np.append(ids[a:b], end_id).astype(dtype) for a, b in zip(offsets[:-1], offsets[1:])]
