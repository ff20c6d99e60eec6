"""SentencePiece encoding and decoding of BPE models with byte fallback.

Encoding finds the result of the merge procedure by backtracking instead of a queue of merges. An Aho-Corasick
automaton over the reversed pieces gives the longest piece at each position; a piece is taken if it is compatible with
the one before it, that is if merging the text of both anew gives just these two, and else its next shorter prefix is
tried. A bitfield holds positions from which the rest could not be reached, so none is tried twice.

Texts fall into words first, at places that no piece spans (checked against the model), and the encoding of a word is
kept in a table of bounded size.

Defined results: a null text encodes as an empty one; a text of any length is encoded whole; signs that the model
lacks become byte pieces; repeated rows repeat; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from chunkloom.llm.common import lean, sliced

SPACE = "▁"
# Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words (in each of two generations) and pairs of pieces whose results are kept in each Python worker.
KEEP_WORDS, KEEP_PAIRS = 150_000, 200_000


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value) of a protocol buffer message."""

    def varint(p: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[p]
            p += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value, p

    p = 0
    while p < len(data):
        key, p = varint(p)
        field, wire = key >> 3, key & 7
        if wire == 0:
            value, p = varint(p)
        elif wire == 2:
            n, p = varint(p)
            value, p = data[p : p + n], p + n
        elif wire == 5:
            value, p = struct.unpack_from("<f", data, p)[0], p + 4
        elif wire == 1:
            value, p = struct.unpack_from("<d", data, p)[0], p + 8
        else:
            raise ValueError("not a model file")
        yield field, wire, value


class PieceBpe:
    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        self.types: list[int] = []
        self.scores: list[float] = []
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        for field, _, value in _fields(model):
            if field == 1:
                parts = {f: v for f, _, v in _fields(value)}
                self.pieces.append(parts[1].decode())
                self.scores.append(parts.get(2, 0.0))
                self.types.append(parts.get(3, NORMAL))
            elif field == 2:
                trainer = {f: v for f, _, v in _fields(value)}
            elif field == 3:
                normalizer = {f: v for f, _, v in _fields(value)}
        if trainer.get(3) != 2 or not trainer.get(35):
            raise ValueError("a BPE model with byte fallback is needed")
        # identity rules, a dummy prefix, white space kept and escaped
        if normalizer.get(2) or normalizer.get(3, 1) != 1 or normalizer.get(4, 1) != 0 or normalizer.get(5, 1) != 1:
            raise ValueError("a model with identity normalization, a dummy prefix and all white space kept is needed")
        if USER_DEFINED in self.types or UNUSED in self.types:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        self.byte_ids = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)]
        self.eos = self.pieces.index("</s>")
        back = ahocorasick.Automaton()
        for p in self.ids:
            back.add_word(p[::-1], len(p))
        back.make_automaton()
        self._back = back
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(x[1] == SPACE != x[0] for x in pairs) or any("\n" in p for p in self.ids):
            self._words = re.compile("(?s:.+)")
        else:
            self._words = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        self._pairs = pairs
        self._kept: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        self._next = {p: self._shorter(p) for p in self.ids}
        self._compatible = lru_cache(KEEP_PAIRS)(self._merges_to_itself)
        self._surface = [self._piece_bytes(i) for i in range(len(self.pieces))]

    # ---- encoding

    def merge(self, text: str) -> list[str]:
        """The merge procedure itself: the best-scored pair first, the leftmost of equals. For short texts."""
        parts = list(text)
        ids, scores = self.ids, self.scores
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, where = scores[k], i
            if best is None:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def _merges_to_itself(self, left: str, right: str) -> bool:
        return self.merge(left + right) == ([left, right] if left else [right])

    def _shorter(self, piece: str) -> str | None:
        """The next shorter piece that the given one starts with; a single sign is always one."""
        for n in range(len(piece) - 1, 1, -1):
            if piece[:n] in self.ids:
                return piece[:n]
        return piece[0] if len(piece) > 1 else None

    def split(self, word: str) -> list[str]:
        """The pieces of a word, by backtracking."""
        n = len(word)
        if n == 1 or word in self.ids and self._compatible("", word):
            return [word]
        back = [1] * n
        for end, size in self._back.iter(word[::-1]):  # all pieces that end here, in the reversed word
            if size > back[end]:
                back[end] = size
        longest = back[::-1]
        failed = bytearray((n >> 3) + 1)
        out: list[str] = []
        pos, piece = 0, word[: longest[0]]
        compatible, following = self._compatible, self._next.get
        while True:
            last = out[-1] if out else ""
            while True:
                end = pos + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and compatible(last, piece):
                    out.append(piece)
                    pos = end
                    if pos == n:
                        return out
                    piece = word[pos : pos + longest[pos]]
                    break
                shorter = following(piece)
                if shorter is not None:
                    piece = shorter
                    continue
                failed[pos >> 3] |= 1 << (pos & 7)
                if not out:
                    raise AssertionError("no encoding")
                out.pop()
                pos -= len(last)
                piece = last
                break

    def _parts(self, word: str) -> Iterator[str]:
        """Runs of a word between places that no piece spans."""
        start = 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self._pairs:
                yield word[start:i]
                start = i
        yield word[start:]

    def _keep(self, word: str, ids: tuple[int, ...]) -> None:
        if len(word) <= 64:
            if len(self._kept) >= KEEP_WORDS:
                self._older, self._kept = self._kept, {}
            self._kept[word] = ids

    def _part_ids(self, part: str) -> tuple[int, ...]:
        out: list[int] = []
        for p in self.split(part):
            k = self.ids.get(p)
            if k is not None:
                out.append(k)
            else:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
        return tuple(out)

    def word_ids(self, word: str) -> tuple[int, ...]:
        found = self._older.get(word)
        if found is None:
            parts = list(self._parts(word))
            if len(parts) == 1:
                found = self._part_ids(word)
            else:
                joined: list[int] = []
                for part in parts:
                    known = self._kept.get(part) or self._older.get(part)
                    if known is None:
                        self._keep(part, known := self._part_ids(part))
                    joined += known
                found = tuple(joined)
        self._keep(word, found)
        return found

    def encode(self, text: str, end: bool = True) -> list[int]:
        out: list[int] = []
        if text:
            get, make = self._kept.get, self.word_ids
            for w in self._words.findall(SPACE + text.replace(" ", SPACE)):
                out += get(w) or make(w)
        if end:
            out.append(self.eos)
        return out

    # ---- decoding

    def _piece_bytes(self, i: int) -> bytes:
        kind, piece = self.types[i], self.pieces[i]
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        if kind == BYTE:
            return bytes((int(piece[3:5], 16),))
        return piece.replace(SPACE, " ").encode()

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: the dummy space goes, byte pieces join to UTF-8, and bad bytes become U+FFFD."""
        raw = b"".join(map(self._surface.__getitem__, ids))
        first = next((i for i in ids if self.types[i] != CONTROL), None)
        if first is not None and self.types[first] == NORMAL and self.pieces[first].startswith(SPACE):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_bad(ids)

    def _decode_bad(self, ids: list[int]) -> str:
        """As decode(), for byte pieces that are no UTF-8: each such byte is one U+FFFD."""
        out, run, begun = [], bytearray(), False

        def flush() -> None:
            i = 0
            while i < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i : i + n]).decode())
                        i += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
            run.clear()

        for k in ids:
            if self.types[k] == BYTE:
                run += self._surface[k]
                begun = True
                continue
            flush()
            piece = self._surface[k].decode()
            if not begun and self.types[k] == NORMAL and piece.startswith(" "):
                piece = piece[1:]
            begun = begun or self.types[k] != CONTROL
            out.append(piece)
        flush()
        return "".join(out)


@lru_cache(2)
def _codec(model: bytes) -> PieceBpe:
    return PieceBpe(model)


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_table(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the piece ids of each text, with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for whole in batches:
            for batch in sliced(whole, "text"):
                ids = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode_table(df: DataFrame, model: bytes) -> DataFrame:
    """doc_id, text of (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def round_trip(df: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, is_lossless: each text encoded and decoded in one pass."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "is_lossless"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        decimal = [str(i) for i in range(len(codec.pieces))]
        sha = hashlib.sha256
        for whole in batches:
            for batch in sliced(whole, "text"):
                n, a, b, same = [], [], [], []
                for text in batch.column("text").to_pylist():
                    ids = codec.encode(text or "")
                    back = codec.decode(ids)
                    n.append(len(ids))
                    a.append(sha(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    b.append(sha(back.encode()).hexdigest())
                    same.append(back == (text or "").replace(SPACE, " "))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(same, pa.bool_())], names)

    return df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, is_lossless boolean")


def encode_corpus(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, is_lossless of every row; is_lossless: the ids decode to the text again (the
    mark that stands for a blank in pieces comes back as a blank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for whole in batches:
            for batch in sliced(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = [codec.encode(t) for t in texts]
                same = [codec.decode(own) == t.replace(SPACE, " ") for own, t in zip(ids, texts, strict=True)]
                columns = [*(batch.column(c) for c in ("doc_id", "lang", "source")), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "source", "n_tokens", "ids", "is_lossless"])

    few = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), docs["text"].cast("string").alias("text"))
    return few.mapInArrow(lean(run), "doc_id long, lang string, source string, n_tokens long, ids array<int>, is_lossless boolean")
