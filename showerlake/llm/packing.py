"""Cost-balanced packing of token ids into sequences.

Each task tokenizes its own texts and packs them group by group; no row is shuffled.
In a group of about `group_tokens` tokens the capacities of its sequences add up to its
tokens exactly: full sequences, and a tail of powers of two, which need no padding. Documents go
from long to short to the sequence of the lowest cost (linear plus quadratic in the
piece's length) that has room for all of it; where none has, the cheapest sequence with room is
filled up with a piece of it. A group is made of neighbouring rows of a task, so its memory is bounded.

A null or empty text is the end id alone. Repeated rows and ids are packed each for
itself. An empty table gives no pieces. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
import threading
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, mapped, text_column

LENGTH = 4096
END_ID = 2
GROUP_TOKENS = 1 << 20
#: Cost of a piece of n tokens: n + n * n / QUADRATIC, where attention and the rest cost the same at QUADRATIC tokens.
QUADRATIC = 6144.0

_KEPT = 400_000
#: A longer part is met once as a rule and isn't kept, so what is kept is bounded in bytes as well.
_LONGEST_KEPT = 64
#: How long a worker without texts keeps what it has learnt.
KEPT_SECONDS = 10.0


# How a tokenizer file must normalise and split for parts between blanks to be encoded apart.
NORMALISES = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
WORD_END = "</w>"


def splits_as_expected(path: str) -> bool:
    """Whether the tokenizer's own settings are the ones that Encoder's short cut rests on; others encode whole texts."""
    with open(path, encoding="utf-8") as f:
        settings = json.load(f)
    normalises, splits = settings.get("normalizer") or {}, settings.get("pre_tokenizer") or {}
    return normalises.get("normalizers") == NORMALISES and splits.get("pretokenizers", [None])[0] == SPLITS and settings["model"].get("end_of_word_suffix") == WORD_END


class Encoder:
    """The token ids of texts, as bytes of little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and joins nothing over it, so blank-separated parts are
    encoded once and looked up afterwards. It also splits letters, single digits and other marks from each other and
    ignores case, so an unseen part is looked up again in those pieces, where that is sure to be the same. A tokenizer with
    other settings encodes each text whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.apart = splits_as_expected(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unsure = re.compile("|".join(map(re.escape, ["'", "\u0130", *special]))).search
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.parts: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def direct(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False) if words else []
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def one_by_one(self, pieces: list[str]) -> list[bytes]:
        """Each piece ends in one token with the word-end mark, so many are encoded as one text and cut apart there."""
        out: list[bytes] = []
        for at in range(0, len(pieces), 1000):
            some = pieces[at : at + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.int64)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(some) and (not len(ids) or cut[-1] == len(ids)):
                raw, cut = ids.astype("<u4").tobytes(), (cut * 4).tolist()
                out += [raw[a:b] for a, b in zip([0, *cut], cut, strict=False)]
            else:
                out += self.direct(some)
        return out

    def split(self, part: str) -> list[str] | None:
        """The pieces that may be encoded apart; None if that is not sure."""
        if self.unsure(part):
            return None
        if part.isascii() or (unicodedata.is_normalized("NFC", part) and max(part) <= "\u017f"):
            return _PIECE.findall(part.lower())
        return None

    def learn(self, parts: list[str]) -> tuple[list[str], list[str]]:
        """Encode unseen parts; returns what was added to `parts` and to `pieces`. Most parts are one piece of plain letters."""
        plain = {p: p.lower() for p in parts if p.isascii() and p.isalpha() and not self.unsure(p)}
        split = {p: self.split(p) for p in parts if p not in plain}
        new = set(plain.values()).union(*[xs for xs in split.values() if xs is not None])
        new = [x for x in new if x not in self.pieces]
        self.pieces.update(zip(new, self.one_by_one(new), strict=True))
        whole = [p for p, xs in split.items() if xs is None]
        self.parts.update(zip(whole, self.direct(whole), strict=True))
        find = self.pieces.__getitem__
        self.parts.update(zip(plain, map(find, plain.values()), strict=True))
        self.parts.update((p, b"".join(map(find, xs))) for p, xs in split.items() if xs is not None)
        return parts, new

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return self.direct(texts)
        split = [t.replace("\n", " ").split(" ") for t in texts]
        added = self.learn([w for w in set().union(*split) if w not in self.parts])
        find = self.parts.__getitem__
        out = [b"".join(map(find, p)) for p in split]
        for known, new in zip((self.parts, self.pieces), added, strict=True):
            for w in [w for w in new if len(w) > _LONGEST_KEPT]:
                del known[w]
            new = [w for w in new if len(w) <= _LONGEST_KEPT]
            for w in new[: max(0, len(known) - _KEPT)]:  # the first that were met stay
                del known[w]
        return out


_PIECE = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_ENCODERS: dict[str, Encoder] = {}
_ENDING: list[threading.Timer] = []


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of each whole text. What was learnt serves the next tasks of this worker, and goes when it has had none for a while:
    the worker may go on to other operators, which need the room."""
    encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
    out = [np.frombuffer(x, "<u4") for x in encoder(texts)]
    while _ENDING:
        _ENDING.pop().cancel()
    _ENDING.append(threading.Timer(KEPT_SECONDS, _ENCODERS.clear))
    _ENDING[0].daemon = True
    _ENDING[0].start()
    return out


def capacities(tokens: int, length: int) -> np.ndarray:
    """Sequence lengths that add up to `tokens`: full ones, then the powers of two of the rest."""
    rest = tokens % length
    return np.array([length] * (tokens // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


def pack(lengths: np.ndarray, length: int = LENGTH, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start in it, length, sequence, offset there) of every piece."""
    room = capacities(int(lengths.sum()), length)
    cost, used = np.zeros(len(room)), np.zeros(len(room), np.int64)
    out = []
    for d in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[d])
        while left:
            fits = np.flatnonzero(room >= min(left, length))
            if not len(fits):
                fits = np.flatnonzero(room)
            s = fits[np.argmin(cost[fits])]
            n = int(min(left, room[s]))
            out.append((int(d), start, n, int(s), int(used[s])))
            room[s] -= n
            used[s] += n
            cost[s] += n + n * n / quadratic
            start, left = start + n, left - n
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, length: int, end_id: int, group_tokens: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    sequence = TaskContext.get().partitionId() << 40
    held_ids: list = []
    held: list[np.ndarray] = []

    def packed() -> pa.RecordBatch:
        nonlocal sequence
        found = pack(np.array([len(x) for x in held]), length)
        cols = np.array(found, np.int64).T
        cut = [held[d][a : a + n] for d, a, n, _, _ in found]
        out = {
            "doc_id": pa.array([held_ids[d] for d in cols[0]], pa.int64()), "start": pa.array(cols[1]), "length": pa.array(cols[2]),
            "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cut], pa.int64()),
            "doc_tokens": pa.array([len(held[d]) for d in cols[0]], pa.int64()), "sequence_id": pa.array(cols[3] + sequence), "offset": pa.array(cols[4]),
        }
        if with_ids:
            out["ids"] = pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32()))
        sequence += int(cols[3].max()) + 1
        held_ids.clear()
        held.clear()
        return pa.RecordBatch.from_pydict(out)

    total = 0
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), filled(batch)
        for at in range(0, len(ids), 512):
            for doc, got in zip(ids[at : at + 512], token_ids(texts.slice(at, 512).to_pylist(), path), strict=True):
                held_ids.append(doc)
                held.append(np.append(got, np.uint32(end_id)))
                total += len(held[-1])
            if total >= group_tokens:
                yield packed()
                total = 0
    if held:
        yield packed()


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents; with_ids adds their token ids. sequence_id is unique over the table."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return mapped(docs.select(F.col("doc_id").cast("long"), text_column().alias("text")), lambda b: _pieces(b, tokenizer_path, length, end_id, group_tokens, with_ids), schema)
