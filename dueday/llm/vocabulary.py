"""Pieces of a SentencePiece model file, and recursions over the pieces of many short strings at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textblocks import BYTE_VALUES, U64, mixed, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"  # how model files write a space
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6  # piece types of the model format
CHUNK = 4096
SLOTS = 1 << 20


@dataclass
class Vocabulary:
    """Pieces as bytes, with a space for the model's space mark.

    ``scores`` are the file's. Bytes that no piece covers stand for themselves:
    the byte pieces where the model has them, else the unknown id.
    """

    pieces: list[bytes]  # by id; empty where a piece stands for no text
    scores: np.ndarray
    normal: np.ndarray  # ids that match text
    byte_ids: np.ndarray  # by byte
    dummy_prefix: bool
    ranked: bool  # scores are negated merge ranks, not log probabilities

    def __post_init__(self):
        own = [self.pieces[i] for i in self.normal]
        sizes = np.array([len(p) for p in own], np.int64)
        data, begins = np.frombuffer(b"".join(own), np.uint8), np.cumsum(sizes) - sizes
        place = np.arange(len(data)) - np.repeat(begins, sizes)
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_VALUES[data] * powers(int(sizes.max(initial=0)) + 1)[0][place], out=sums[1:])
        hashes = mixed(sums[begins + sizes] - sums[begins] + sizes.astype(U64))
        self.lengths = sorted({len(self.pieces[i]) for i in self.normal}, reverse=True)
        self.fallback = float(self.scores[self.normal].min(initial=0.0)) - 10.0
        self.levels = []  # one slot a key; those that find theirs taken go to the next level
        rest = np.arange(len(hashes))
        for shift in (44, 24, 4, 34, 14):
            slots = ((hashes[rest] >> U64(shift)) & U64(SLOTS - 1)).astype(np.int64)
            keys, ids = np.zeros(SLOTS, U64), np.full(SLOTS, -1, np.int32)
            _, first = np.unique(slots, return_index=True)
            own = rest[first]
            keys[slots[first]], ids[slots[first]] = hashes[own], self.normal[own]
            self.levels.append((shift, keys, ids))
            rest = np.delete(rest, first)
            if not len(rest):
                break
        assert not len(rest)
        inside = np.zeros(1 << 16, bool)
        within = np.flatnonzero(place[1:] > 0)
        inside[data[within].astype(np.int64) << 8 | data[within + 1]] = True
        self.joins = inside  # byte pairs that some piece holds; every path breaks between others

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of hashed strings, -1 where there is no such piece."""
        out = np.full(hashes.shape, -1, np.int32)
        for shift, keys, ids in self.levels:
            slot = ((hashes >> U64(shift)) & U64(SLOTS - 1)).astype(np.int32)
            np.copyto(out, ids[slot], where=keys[slot] == hashes)
        return out


def model_file(path: str = MODEL) -> dict:
    """A model file, read on the driver, as the arguments of a vocabulary. Its size is that of a vocabulary, whatever the data."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    pieces, normal, unknown = [], [], 0
    byte_ids = np.full(256, -1, np.int32)
    for i, piece in enumerate(model.pieces):
        text = b""
        if piece.type in (NORMAL, USER):
            text = piece.piece.replace(SPACE, " ").encode()
            normal.append(i)
        elif piece.type == BYTE:
            value = int(piece.piece[1:-1], 16)
            text, byte_ids[value] = bytes([value]), i
        elif piece.type == UNKNOWN:
            unknown = i
        pieces.append(text)
    byte_ids[byte_ids < 0] = unknown
    scores = np.array([p.score for p in model.pieces])
    ranked = model.trainer_spec.model_type == model.trainer_spec.BPE
    prefix = model.normalizer_spec.add_dummy_prefix
    return {"pieces": pieces, "scores": scores, "normal": np.array(normal, np.int32), "byte_ids": byte_ids,
            "dummy_prefix": prefix, "ranked": ranked}


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    return Vocabulary(**model_file(path))


def substring_ids(vocabulary: Vocabulary, rows: np.ndarray):
    """For rows (m, L) of bytes: a function of (begin, end) that gives the pieces' ids there."""
    length = rows.shape[1]
    up, down = powers(length + 1)
    sums = np.zeros((length + 1, len(rows)), U64)
    np.cumsum((BYTE_VALUES[rows] * up[:length]).T, axis=0, out=sums[1:])

    def ids(begin: int, end: int) -> np.ndarray:
        return vocabulary.find(mixed((sums[end] - sums[begin]) * down[begin] + U64(end - begin)))

    return ids


def by_length(begin: np.ndarray, end: np.ndarray, most: int):
    """Indices of strings of equal length, in chunks; those longer than ``most`` one by one."""
    sizes = end - begin
    order = np.argsort(sizes, kind="stable")
    cuts = np.searchsorted(sizes[order], np.arange(1, most + 2))
    for length in range(1, most + 1):
        own = order[cuts[length - 1] : cuts[length]]
        for k in range(0, len(own), CHUNK):
            yield length, own[k : k + CHUNK]
    for i in order[cuts[-1] :]:
        yield int(sizes[i]), np.array([i])
