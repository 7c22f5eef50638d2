"""SentencePiece encoding and decoding that keeps byte offsets.

Ids are the library's own. Offsets come from a normaliser of our own that follows the model's rule: the longest prefix
found in the compiled character map is replaced by its entry, anything else stays, white space is handled as the model
says; each byte of the normalised text keeps the source byte it came from. A piece covers a run of normalised bytes,
which project to a span of source bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = "▁".encode()
#: Bytes of text that are encoded at a time; a longer text goes alone.
_PART = 1 << 19

SCHEMAS = {
    "n_tokens": "long",
    "spans_sha256": "string",
    "ids": "array<int>",
    "begins": "array<int>",
    "ends": "array<int>",
    "decoded": "string",
    "ids_sha256": "string",
    "decoded_sha256": "string",
    "n_spanned": "long",
}


class CharsMap:
    """A compiled character map: four bytes with the size of a double-array trie, the trie, then entries that end in 0."""

    def __init__(self, blob: bytes):
        self.trie, self.entries = (), b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.trie = struct.unpack_from(f"<{n // 4}I", blob, 4)
            self.entries = blob[4 + n :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """The length of the longest prefix of text[at:] in the map, and its replacement."""
        trie = self.trie
        if not trie:
            return None
        unit = trie[0]
        node = (unit >> 10) << ((unit & (1 << 9)) >> 6)
        found = None
        for k in range(at, len(text)):
            c = text[k]
            if c == 0:
                break
            node ^= c
            if node >= len(trie):
                break
            unit = trie[node]
            if unit & ((1 << 31) | 0xFF) != c:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                found = (k + 1 - at, trie[node] & 0x7FFFFFFF)
        if found is None:
            return None
        n, start = found
        return n, self.entries[start : self.entries.index(b"\0", start)]


class Normaliser:
    """normalise(text) gives the normalised bytes and, for each and one past the end, the source byte it came from."""

    def __init__(self, charsmap: bytes = b"", add_dummy_prefix: bool = True, remove_extra_whitespaces: bool = True, escape_whitespaces: bool = True, suffix: bool = False):
        self.map = CharsMap(charsmap)
        self.dummy, self.squeeze, self.suffix = add_dummy_prefix, remove_extra_whitespaces, suffix
        self.space = _SPACE if escape_whitespaces else b" "

    def normalise(self, source: bytes) -> tuple[bytes, np.ndarray]:
        if not self.map.trie and not self.squeeze and not self.suffix:
            return self._plain(source)
        return self._mapped(source)

    def _plain(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """Only spaces change."""
        if not source:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(source, np.uint8)
        width = np.where(raw == 32, len(self.space), 1)
        align = np.r_[np.repeat(np.arange(len(raw)), width), len(raw)]
        text = source.replace(b" ", self.space)
        if self.dummy:
            text, align = self.space + text, np.r_[np.zeros(len(self.space), np.int64), align]
        return text, align

    def _prefix(self, source: bytes, at: int) -> tuple[int, bytes]:
        got = self.map.longest(source, at)
        if got is not None:
            return got
        lead = source[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, source[at : at + n]

    def _mapped(self, source: bytes) -> tuple[bytes, np.ndarray]:
        out, align, at, end = bytearray(), [], 0, len(source)
        if self.squeeze:
            while at < end:
                n, piece = self._prefix(source, at)
                if piece != b" ":
                    break
                at += n
        if at >= end:
            return b"", np.zeros(1, np.int64)

        def space() -> None:
            out.extend(self.space)
            align.extend([at] * len(self.space))

        if self.dummy and not self.suffix:
            space()
        after_space = self.squeeze
        while at < end:
            n, piece = self._prefix(source, at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                for c in piece:
                    if c == 32:
                        space()
                    else:
                        out.append(c)
                        align.append(at)
                after_space = piece[-1] == 32
            at += n
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            w = len(self.space)
            while out[-w:] == self.space and len(out) >= w:
                at = align[-w]
                del out[-w:], align[-w:]
        if self.dummy and self.suffix:
            space()
        align.append(at)
        return bytes(out), np.array(align)


class Codec:
    """Encodes with begin and end ids; spans are (begin, end) in bytes of the source, empty for begin and end."""

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        proto = pb.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.normaliser = Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, proto.trainer_spec.treat_whitespace_as_suffix)
        kind = pb.ModelProto.SentencePiece
        self.width = np.array([1 if p.type == kind.BYTE else 0 if p.type == kind.CONTROL else -1 if p.type == kind.UNKNOWN else len(p.piece.encode()) for p in proto.pieces])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.lib.encode(texts, add_bos=True, add_eos=True, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.lib.decode(ids, num_threads=1)

    def spans(self, text: str, ids) -> tuple[np.ndarray, np.ndarray]:
        source = text.encode()
        out, align = self.normaliser.normalise(source)
        width = self.width[np.asarray(ids, np.int64)]
        if (width < 0).any():  # unknown: what lies between its neighbours, known from the pieces of the library
            pieces = self.lib.encode(text, out_type=str, add_bos=True, add_eos=True)
            width = np.array([w if w >= 0 else len(p.encode()) for w, p in zip(width.tolist(), pieces, strict=True)])
        ends = np.cumsum(width)
        if ends.size and ends[-1] != len(out):
            raise ValueError("pieces don't cover the normalised text")
        begin, end = align[ends - width], align[ends]
        return begin, end


_CODECS: dict[str, Codec] = {}


def _codec(model_path: str) -> Codec:
    if model_path not in _CODECS:
        _CODECS[model_path] = Codec(model_path)
    return _CODECS[model_path]


def _parts(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > _PART:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "begins", "ends", "decoded")) -> DataFrame:
    """doc_id and the named ``outputs`` (see SCHEMAS) for every row of ``docs``.

    ``ids`` have begin and end ids; ``begins`` and ``ends`` are the pieces' spans in bytes of the whole text;
    ``decoded`` is what the library makes of the ids; the digests are of the ids as little-endian 32-bit numbers and
    of the decoded text; ``spans_sha256`` is that of begin and end of each piece as such numbers; ``n_spanned`` counts source bytes that lie in a span. A null text counts as empty: begin and
    end ids only. Rows are independent, so that repeated rows and ids get equal results. Other columns are not looked
    at. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, schema = _codec(model_path), pa.schema([("doc_id", pa.int64()), *((o, _ARROW[SCHEMAS[o]]) for o in outputs)])
        for b in batches:
            at = 0
            for part in _parts([t or "" for t in b.column(1).to_pylist()]):
                ids, row = codec.encode(part), {"doc_id": b.column(0).slice(at, len(part)), "n_tokens": None}
                at += len(part)
                row["n_tokens"] = [len(x) for x in ids]
                row["ids"] = ids
                if {"decoded", "decoded_sha256"} & {*outputs}:
                    row["decoded"] = codec.decode(ids)
                    if "decoded_sha256" in outputs:
                        row["decoded_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in row["decoded"]]
                arrays = [np.array(x, "<u4") for x in ids] if {"ids_sha256", "begins", "ends", "n_spanned", "spans_sha256"} & {*outputs} else []
                if "ids_sha256" in outputs:
                    row["ids_sha256"] = [hashlib.sha256(x.tobytes()).hexdigest() for x in arrays]
                if {"begins", "ends", "n_spanned", "spans_sha256"} & {*outputs}:
                    spans = [codec.spans(t, x) for t, x in zip(part, arrays, strict=True)]
                    row["begins"], row["ends"] = [s.tolist() if "begins" in outputs else None for s, _ in spans], [e.tolist() if "ends" in outputs else None for _, e in spans]
                    row["n_spanned"] = [int((e - s).sum()) for s, e in spans]
                    if "spans_sha256" in outputs:
                        row["spans_sha256"] = [hashlib.sha256(np.stack(x, axis=1).astype("<u4").tobytes()).hexdigest() for x in spans]
                yield pa.RecordBatch.from_arrays([row["doc_id"], *(pa.array(row[o], schema.field(o).type) for o in outputs)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ", ".join(["doc_id long", *(f"{o} {SCHEMAS[o]}" for o in outputs)]))


_ARROW = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) for every row with ids. Null or no ids decode to an empty text.

    Rows are independent, so that repeated ones get equal results. An empty table gives no rows. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = codec.decode([x or [] for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded string")
