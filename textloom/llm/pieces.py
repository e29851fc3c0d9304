"""SentencePiece encoding and decoding over an Aho-Corasick automaton."""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import with_fields

SPACE = "▁"
#: What an unknown character costs below the worst piece (a fixed value of the unigram model).
UNKNOWN_PENALTY = 10.0
#: A run of space marks and what follows it up to the next one.
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def vocabulary() -> str:
    """Place of the default piece vocabulary, outside the repository."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encoder and decoder for the pieces and scores of a SentencePiece model file.

    The best segmentation has the largest sum of scores. The automaton reports at
    each position all pieces that end there (the node's own and those along its
    output links), and the best score up to each start is relaxed at once: one
    pass. Characters without a piece become byte pieces, or the unknown id if the
    model has none. Words' results are kept in a bounded table: pieces never run
    on past a space mark that follows other characters, so words are independent.
    """

    most = 400_000

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.unknown = sp.unk_id()
        self.control = {i for i in range(sp.vocab_size()) if sp.is_control(i)}
        bytes_of = {i: int(self.pieces[i][3:5], 16) for i in range(sp.vocab_size()) if sp.is_byte(i)}
        self.byte_of, self.byte_id = bytes_of, {b: i for i, b in bytes_of.items()}
        #: Text of each id by itself; those of ``high`` are parts of a character.
        self.high = {i for i, b in bytes_of.items() if b >= 0x80}
        self.text = [chr(bytes_of[i]) if i in bytes_of else "" if i in self.control else " ⁇ " if i == self.unknown else p for i, p in enumerate(self.pieces)]
        self.score = {}
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.pieces):
            if i == self.unknown or i in self.control or i in bytes_of or not p or sp.is_unused(i):
                continue
            self.score[i] = sp.get_score(i)
            self.automaton.add_word(p, (len(p), i, sp.get_score(i)))
        self.automaton.make_automaton()
        self.floor = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.by_word = all(SPACE not in p.lstrip(SPACE) for p in self.pieces)
        self.known: dict[str, list[int]] = {}
        prefix = sp.encode("a", out_type=str)
        self.prefix = bool(prefix) and prefix[0].startswith(SPACE)

    def viterbi(self, s: str) -> list[int]:
        """Ids of the best segmentation of marked text; of equally good ones, the longer last piece."""
        n, low, floor = len(s), -1e30, self.floor
        best, start_of, id_of = [0.0] + [low] * n, [0] * (n + 1), [-1] * (n + 1)
        single = bytearray(n)  # whether a piece of one character ends there
        at = 0
        for end, (size, i, score) in self.automaton.iter(s):
            while at < end:  # every position before this match's end has its last match behind it
                if not single[at] and best[at] + floor > best[at + 1]:
                    best[at + 1], start_of[at + 1], id_of[at + 1] = best[at] + floor, at, -1
                at += 1
            if size == 1:
                single[end] = 1
            start = end + 1 - size
            x = best[start] + score
            if x > best[end + 1]:
                best[end + 1], start_of[end + 1], id_of[end + 1] = x, start, i
        while at < n:
            if not single[at] and best[at] + floor > best[at + 1]:
                best[at + 1], start_of[at + 1], id_of[at + 1] = best[at] + floor, at, -1
            at += 1
        out = []
        while n:
            start, i = start_of[n], id_of[n]
            if i >= 0:
                out.append(i)
            elif self.byte_id:  # a character without a piece
                out.extend(self.byte_id.get(b, self.unknown) for b in reversed(s[start:n].encode("utf-8", "surrogatepass")))
            else:
                out.append(self.unknown)
            n = start
        return out[::-1]

    def mark(self, text: str) -> str:
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> list[int]:
        s = self.mark(text)
        if not self.by_word:
            return self.viterbi(s)
        out, known = [], self.known
        for word in _SEGMENT.findall(s):
            ids = known.get(word)
            if ids is None:
                ids = self.viterbi(word)
                if len(word) <= 64:
                    if len(known) >= self.most:
                        known.clear()
                    known[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD, control ids nothing."""
        if self.high.isdisjoint(ids):
            s = "".join(map(self.text.__getitem__, ids))
        else:
            parts = (bytes([self.byte_of[i]]) if i in self.byte_of else self.text[i].encode() for i in ids)
            s = b"".join(parts).decode("utf-8", "replace")
        s = s.replace(SPACE, " ")
        return s[1:] if self.prefix and s.startswith(" ") else s


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with pieces (ids of the text's best segmentation).

    A null or empty text has no pieces. Nulls in other columns and repeated rows
    pass; a former column named pieces is replaced; an empty table gives an empty
    result. A text that holds the space mark itself decodes to a space there.
    """
    path = path or vocabulary()

    def run(batches):
        c = codec(path)
        for b in batches:
            ids = [c.encode(t.as_py() or "") for t in b.column(b.schema.get_field_index("text"))]
            yield b.append_column("pieces", pa.array(ids, pa.list_(pa.int32())))

    docs = docs.drop("pieces")
    return docs.mapInArrow(run, with_fields(docs, pieces="array<int>"))


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` with decoded (text of the ids in pieces; null for null)."""
    path = path or vocabulary()

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [None if v is None else c.decode(v) for v in b.column(b.schema.get_field_index("pieces")).to_pylist()]
            yield b.append_column("decoded", pa.array(texts, pa.string()))

    rows = rows.drop("decoded")
    return rows.mapInArrow(run, with_fields(rows, decoded="string"))


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, n_bytes, ids_crc32, round_trip): encoding and decoding in one pass over the texts.

    n_bytes counts byte pieces; ids_crc32 is over little-endian 32-bit ids;
    round_trip says that decoding gives the text back (space marks read as spaces).
    """
    path = path or vocabulary()

    def run(batches):
        c = codec(path)
        is_byte = np.zeros(len(c.pieces), bool)
        is_byte[list(c.byte_of)] = True
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for t in b.column(1):
                text = t.as_py() or ""
                ids = c.encode(text)
                x = np.array(ids, "<u4")
                for col, v in zip(cols, (len(ids), int(is_byte[x].sum()), zlib.crc32(x.tobytes()), c.decode(ids) == text.replace(SPACE, " ")), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(v, pa.int64()) for v in cols[:3]), pa.array(cols[3], pa.bool_())],
                names=["doc_id", "n_pieces", "n_bytes", "ids_crc32", "round_trip"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean")
