"""SentencePiece ids with the source bytes of every piece, and texts from ids.

A text is normalised here, not by the library: at each place the longest prefix that the model's compiled
character map knows is replaced, and every byte that comes out remembers at which source byte its prefix began.
Pieces are then found by the library under a copy of the model that normalises nothing, and each piece's
bytes are projected through that alignment to a span of the original UTF-8.

If no piece of the vocabulary has a word mark behind another character, merges never cross the start of a
run of marks. A normalised text is then cut there, and a worker encodes every distinct item once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.tokens import Generations
from siftwork.llm.worker import memo, slices, texts

MARK = "▁"  # stands for a blank inside pieces
# Fixed values of the published model format: fields of the model, of a piece, of the normalizer and the trainer.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_TYPE = 1, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CHARACTER_MAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
MARK_AS_SUFFIX = 24

SPANS = "doc_id long, ids array<int>, starts array<int>, ends array<int>"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialized message: numbers, or bytes for all that has a size."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _field(number: int, value: int | bytes) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def with_normalizer(model: bytes, spec: bytes) -> bytes:
    """The same model with another normalizer."""
    kept = b"".join(_field(n, v) for n, v in message(model) if n in (PIECE, TRAINER))
    return kept + _field(NORMALIZER, spec)


def character_map(data: bytes) -> dict[str, str]:
    """All replacements of a compiled character map: a double array of the sources, then the targets, ended by zeros.

    The double array is walked level by level, all nodes of a level at once.
    """
    if not data:
        return {}
    size = int.from_bytes(data[:4], "little")
    units, targets = np.frombuffer(data[4 : 4 + size], "<u4").astype(np.int64), data[4 + size :]
    labels = np.arange(1, 256)
    offset = (units >> 10) << ((units >> 6) & 8)
    found: dict[str, str] = {}
    places, names = np.array([offset[0]]), [b""]
    while len(places):
        next_places = places[:, None] ^ labels[None, :]
        inside = next_places < len(units)
        unit = units[np.where(inside, next_places, 0)]
        node, label = np.nonzero(inside & ((unit & 0x800000FF) == labels[None, :]))
        at = next_places[node, label]
        names = [names[i] + bytes([c]) for i, c in zip(node.tolist(), labels[label].tolist())]
        places = at ^ offset[at]
        for i in np.flatnonzero(units[at] >> 8 & 1).tolist():
            start = int(units[places[i]] & 0x7FFFFFFF)
            found[names[i].decode()] = targets[start : targets.index(b"\0", start)].decode()
    return found


class Normalizer:
    """Longest-prefix replacement with a source place for every byte that comes out."""

    def __init__(self, model: bytes):
        top = list(message(model))
        spec = dict(message(next((v for n, v in top if n == NORMALIZER), b"")))
        trainer = dict(message(next((v for n, v in top if n == TRAINER), b"")))
        self.prefix, self.remove_extra, self.escape = (bool(spec.get(n, 1)) for n in (DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE))
        self.suffix = bool(trainer.get(MARK_AS_SUFFIX, 0))
        own = (dict(message(v)) for n, v in top if n == PIECE)
        fixed = {p[PIECE_TEXT].decode() for p in own if p.get(PIECE_TYPE, NORMAL) == USER_DEFINED}
        # Symbols the user defined stand for themselves and go before the map.
        self.rules = [{x: x for x in fixed}, character_map(spec.get(CHARACTER_MAP, b""))]
        self.longest: list[dict[str, int]] = []
        for rules in self.rules:
            sizes: dict[str, int] = {}
            for source in rules:
                sizes[source[0]] = max(sizes.get(source[0], 0), len(source))
            self.longest.append(sizes)
        first = sorted({c for sizes in self.longest for c in sizes})
        self.first = re.compile("[" + "".join(map(re.escape, first)) + "]") if first else None

    def _replaced(self, text: str) -> Iterator[tuple[str, str | None]]:
        """Stretches of the text, each with what replaces it as a whole, or None if its characters stay."""
        at = 0
        for start in self.first.finditer(text) if self.first else ():
            i = start.start()
            if i < at:
                continue
            found = next((text[i : i + n] for rules, sizes in zip(self.rules, self.longest) for n in range(sizes.get(text[i], 0), 0, -1) if text[i : i + n] in rules), None)
            if found is not None:
                if at < i:
                    yield text[at:i], None
                yield found, self.rules[0].get(found) or self.rules[1].get(found, "")
                at = i + len(found)
        if at < len(text):
            yield text[at:], None

    def normalized(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text in UTF-8, and the source byte of each of its bytes and of its end."""
        if not text:
            return b"", np.zeros(1, np.int64)
        out, places, at, lead, leading = [], [], 0, 0, self.remove_extra
        for source, target in self._replaced(text):
            raw = source.encode()
            if target is None:
                own = np.frombuffer(raw, np.uint8)
                # All bytes of a character come from its first.
                where = np.maximum.accumulate(np.where(own & 0xC0 != 0x80, np.arange(len(own)), 0))
                out.append(raw)
                places.append(where + at)
                if leading:
                    blanks = len(raw) - len(raw.lstrip(b" "))
                    lead, leading = at + blanks, blanks == len(raw)
            else:
                out.append(target.encode())
                places.append(np.full(len(out[-1]), at, np.int64))
                leading = leading and target == " "
                lead = at + len(raw) if leading else lead
            at += len(raw)
        if leading:  # nothing but blanks
            return b"", np.full(1, at, np.int64)
        data, where, end = b"".join(out), np.concatenate(places), at
        mark = MARK.encode() if self.escape else b" "
        if self.remove_extra:
            blank = np.frombuffer(data, np.uint8) == 0x20
            keep = ~(blank & np.concatenate(([True], blank[:-1])))
            data, where = np.frombuffer(data, np.uint8)[keep].tobytes(), where[keep]
        if self.escape:
            where = np.repeat(where, np.where(np.frombuffer(data, np.uint8) == 0x20, len(mark), 1))
            data = data.replace(b" ", mark)
        if self.prefix and not self.suffix:
            data, where = mark + data, np.concatenate((np.full(len(mark), lead, np.int64), where))
        if self.remove_extra:
            while data.endswith(mark):
                data, end, where = data[: -len(mark)], where[len(data) - len(mark)], where[: -len(mark)]
        if self.prefix and self.suffix:
            data, where = data + mark, np.concatenate((where, np.full(len(mark), end, np.int64)))
        return data, np.append(where, end)


class Pieces:
    """Encoder of one model; ``limit`` bounds the items its cache keeps."""

    LONGEST = 200  # characters of an item that is worth keeping

    def __init__(self, model: bytes, limit: int = 250_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalizer = Normalizer(model)
        plain = b"".join(_field(n, 0) for n in (DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE))
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=with_normalizer(model, _field(1, b"identity") + plain))
        kinds = [(p[PIECE_TEXT].decode(), p.get(PIECE_TYPE, NORMAL)) for p in (dict(message(v)) for n, v in message(model) if n == PIECE)]
        # Bytes that an id covers; 0 for the unknown one, which covers what it stands for.
        self.sizes = np.array([1 if kind == BYTE else 0 if kind == UNKNOWN else len(text.encode()) for text, kind in kinds])
        self.apart = self.normalizer.escape and not self.normalizer.suffix and not any(kind == USER_DEFINED or MARK in text.lstrip(MARK) for text, kind in kinds)
        self.items = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.cache = Generations(limit)

    def _looked_up(self, items: list[str]) -> list[bytes]:
        """Ids of distinct items; those the cache doesn't hold go through the library in one call."""
        recent, older = self.cache.recent, self.cache.older
        values = list(map(recent.get, items))
        new = []
        for i, value in enumerate(values):
            if value is None:
                item = items[i]
                if item in older:
                    values[i] = recent[item] = older[item]
                else:
                    new.append(i)
        found = self.plain.encode([items[i] for i in new], num_threads=1)
        ends = np.cumsum([0, *map(len, found)]) * 4
        ids = np.fromiter(chain.from_iterable(found), "<i4", ends[-1] // 4).tobytes()
        for i, a, b in zip(new, ends[:-1].tolist(), ends[1:].tolist()):
            values[i] = ids[a:b]
            if len(items[i]) <= self.LONGEST:
                recent[items[i]] = ids[a:b]
        self.cache.turn()
        return values

    def _covered(self, data: bytes, ids: np.ndarray) -> np.ndarray:
        """The bytes of a normalised text that each of its ids covers."""
        sizes = self.sizes[ids]
        if not sizes.all():
            items = self.items.findall(data.decode()) if self.apart else [data.decode()]
            names = [x for item in items for x in self.plain.encode(item, out_type=str)]
            sizes = np.where(sizes == 0, [len(x.encode()) for x in names], sizes)
        return sizes

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text its ids, and the first and the last source byte (exclusive) of each piece."""
        normal = [self.normalizer.normalized(x) for x in texts]
        mark = MARK.encode()
        # Texts of items that each have one mark in front are cut all together.
        even = [i for i, (x, _) in enumerate(normal) if self.apart and x.startswith(mark) and mark + mark not in x and not x.endswith(mark)]
        found: list = [None] * len(texts)
        if even:
            lists = pc.split_pattern(pa.array([normal[i][0][len(mark) :] for i in even], pa.large_binary()).cast(pa.large_string()), MARK)
            coded = lists.flatten().dictionary_encode()
            for i, ids in zip(even, self._gathered([MARK + x for x in coded.dictionary.to_pylist()], coded.indices.to_numpy(), lists.offsets.to_numpy())):
                found[i] = ids
        for i, (data, _) in enumerate(normal):
            if found[i] is None:
                items = self.items.findall(data.decode()) if self.apart else [data.decode()] if data else []
                places = {x: n for n, x in enumerate(dict.fromkeys(items))}
                codes = np.array([places[x] for x in items], np.int64)
                found[i] = self._gathered(list(places), codes, np.array([0, len(codes)]))[0]
        out = []
        for (data, source), ids in zip(normal, found):
            sizes = self._covered(data, ids)
            ends = np.cumsum(sizes, dtype=np.int64)
            if len(data) != (ends[-1] if len(ends) else 0):
                raise ValueError("the pieces don't cover the normalised text")
            out.append((ids, source[ends - sizes], source[ends]))
        return out

    def _gathered(self, distinct: list[str], codes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Ids of texts that are given as numbers of distinct items, and as where each text's items start."""
        values = self._looked_up(distinct)
        pool = np.frombuffer(b"".join(values), "<i4")
        counts = np.fromiter(map(len, values), np.int64, len(values)) // 4
        starts, many = np.cumsum(counts) - counts, counts[codes]
        ends = np.concatenate(([0], np.cumsum(many)))
        at = np.repeat(starts[codes] - ends[:-1], many) + np.arange(ends[-1])
        ids, cuts = pool[at], ends[bounds].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def model_pieces(path: str) -> Pieces:
    """The worker's own encoder of a model file, kept between tasks."""

    def make() -> Pieces:
        with open(path, "rb") as f:
            return Pieces(f.read())

    return memo(("pieces", path), make)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    values = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, starts, ends`` for every row of ``docs``: piece i comes from bytes starts[i] to ends[i] of the text.

    A null text counts as empty and has no pieces; a null ``doc_id`` stays null; repeated rows give repeated rows; an
    empty table gives an empty one; other columns are not read. A character that is spelt in bytes belongs to the
    last of its byte pieces, the others have empty spans at its start. ``path`` names the model file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_pieces(path)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                found = own.encode(texts(part))
                columns = [_lists([x[i] for x in found]) for i in range(3)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "ids", "starts", "ends"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SPANS)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id, decoded``: the text that the model's library gives back for ``ids`` (null ids: the empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_pieces(path).library
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [own.decode(x) if x else "" for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "decoded"])

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``encode`` and ``decode`` of every row in the same task: ``doc_id, ids, starts, ends, decoded``, as defined there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_pieces(path)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                found = own.encode(texts(part))
                columns = [_lists([x[i] for x in found]) for i in range(3)]
                back = pa.array([own.library.decode(x[0].tolist()) if len(x[0]) else "" for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, back], names=["doc_id", "ids", "starts", "ends", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"{SPANS}, decoded string")
