"""Operator 1: encode and decode with a merge-type SentencePiece model by a prefix table.

For every prefix of a text, the last token of that prefix's encoding is unique. The table of these tokens is filled from
left to right: an Aho-Corasick automaton over the pieces lists the pieces that end at a place, and the one is kept whose
left neighbour (the table's entry at its start) is compatible with it, which means that the two pieces' joint string
encodes to just these two. Ids are then read off backwards from the table's end.

No piece of a merge-type vocabulary holds the space mark after another character, so a text falls into independent
segments (space marks, then other characters) and each distinct segment is encoded once per task. The
vocabulary is checked for that; without it, a text is one segment.

Defined cases: a null text counts as empty; an empty text has just the end id and decodes to ''. Repeated rows give
repeated results. Only the id and the text column are read, so other columns' names don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import pieces, texts_of

SPACE_MARK = "▁"
#: Segments remembered by a task before the memory is emptied.
CACHE_SEGMENTS = 500_000


class PieceCodec:
    """Encoder and decoder over a model's pieces: id -> (piece, score), with byte fallback."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], specials: set[int], unk_id: int):
        import ahocorasick

        self.pieces, self.byte_ids, self.specials, self.unk_id = pieces, byte_ids, specials, unk_id
        skipped = specials | set(byte_ids.values()) | {unk_id}
        self.score = {p: scores[i] for i, p in enumerate(pieces) if i not in skipped}
        self.id_of = {p: i for i, p in enumerate(pieces) if i not in skipped}
        # Pieces that don't stand, which their own string doesn't encode to, end no prefix.
        self.standing = {i for p, i in self.id_of.items() if self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if i in self.standing:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.splits = not any(a != SPACE_MARK and b == SPACE_MARK for p in self.id_of for a, b in zip(p, p[1:], strict=False))
        self.pair: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.segment = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")
        byte_of = {i: bytes([b]) for b, i in byte_ids.items()}
        self.raw = [
            b"" if i in specials else byte_of[i] if i in byte_of else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.raw[unk_id] = " ⁇ ".encode()

    @classmethod
    def load(cls, path: str) -> PieceCodec:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(n)]
        byte_ids = {int(names[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        return cls(names, [m.get_score(i) for i in range(n)], byte_ids, {i for i in range(n) if m.is_control(i)}, m.unk_id())

    def merged(self, s: str) -> list[str]:
        """Pieces of a short string by the definition: join the best-scored neighbours, leftmost first, until none is left."""
        parts = list(s)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], float("-inf")), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the joint string of two pieces encodes to just these two."""
        if len(self.pair) > 1_000_000:
            self.pair.clear()
        a, b = self.pieces[left], self.pieces[right]
        ok = self.pair[left * len(self.pieces) + right] = self.merged(a + b) == [a, b]
        return ok

    def _segment_ids(self, s: str) -> list[int]:
        whole = self.id_of.get(s)
        if whole in self.standing:
            return [whole]
        last = [-1] * (len(s) + 1)  # -1: the start, or a character outside the vocabulary, which joins with nothing
        size, known = len(self.pieces), self.pair.get
        for end, (piece, n) in self.automaton.iter(s):
            if last[end + 1] < 0:
                left = last[end + 1 - n]
                if left >= 0:
                    ok = known(left * size + piece)
                    if not (self.fits(left, piece) if ok is None else ok):
                        continue
                last[end + 1] = piece
        out: list[int] = []
        i = len(s)
        while i:
            piece = last[i]
            if piece >= 0:
                out.append(piece)
                i -= len(self.pieces[piece])
            else:
                i -= 1
                if self.byte_ids:
                    out += [self.byte_ids[b] for b in reversed(s[i].encode("utf-8", "surrogatepass"))]
                else:
                    out.append(self.unk_id)
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without an end id."""
        if not text:
            return []
        marked = SPACE_MARK + text.replace(" ", SPACE_MARK)
        cache, out = self.cache, []
        for s in self.segment.findall(marked) if self.splits else [marked]:
            ids = cache.get(s)
            if ids is None:
                ids = tuple(self._segment_ids(s))
                if len(s) <= 64:
                    if len(cache) >= CACHE_SEGMENTS:
                        cache.clear()
                    cache[s] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids vanish, byte ids join to characters, the leading space mark goes."""
        whole = b"".join(map(self.raw.__getitem__, ids))
        first = next((i for i in ids if i not in self.specials), None)
        if first is not None and self.pieces[first].startswith(SPACE_MARK):
            whole = whole[1:]
        return whole.decode("utf-8", "replace")


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec.load(path)
    return _CODECS[path]


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> DataFrame:
    """One row per row of `df`: `id_col`, ids array<int>."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = codec(path)
        for b in pieces(batches):
            ids = [c.encode(t) + ([] if end_id is None else [end_id]) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} long, ids array<int>")


def round_trip_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Encode, then decode each document in one pass: `id_col`, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = codec(path)
        shown = [str(i) for i in range(len(c.pieces))]
        for b in pieces(batches):
            n, a, d = [], [], []
            for t in texts_of(b):
                ids = c.encode(t)
                ids.append(end_id)
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(shown.__getitem__, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
