"""Token ids of whole texts, exactly as the tokenizer files give them, through worker caches.

A byte-level BPE tokenizer splits a text by a fixed pattern before it merges, and no piece of
that pattern crosses a boundary between a visible character and the blank after it. So a text cut
at its single blanks gives items whose ids do not depend on their neighbours: each distinct item
of a batch is looked up once, unknown items are cut into the pattern's pieces, and unknown pieces
go through the tokenizers library, many at a time with a byte between them that no merge joins. Texts to which the argument does not apply (blank runs,
special strings) and all other tokenizers are encoded whole by their library.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siftwork.llm.worker import memo

# Letters for which the pattern's classes are certain in any Unicode version, and
# the published pre-token pattern of byte-level BPE over ASCII and those letters.
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"
CERTAIN = rf"[\t\n\r\x20-\x7e{LETTERS}]*"
# Items that may be cut many at a time, with a BREAK between them: certain ones that begin and end visibly.
EASY = rf"\ue000?[\x21-\x7e{LETTERS}](?:[\t\n\x20-\x7e{LETTERS}]*[\x21-\x7e{LETTERS}])?"
BREAK = "\r"

FIRST = "\ue000"  # a private-use letter that marks the item which starts a text and so has no blank before it
PIECES_KEPT = 125_000
GATHERED = 1 << 15  # items whose ids are put in place at a time
MADE = 1 << 14  # items that are cut into pieces at a time
MERGED = 128  # pieces that are merged as one word
NEVER = 0xFF  # a byte that UTF-8 doesn't use, so that no piece holds it
MARK = b"\xff" * 4  # stands between the ids of items or pieces; the last byte of an id is 0, so it can't arise from them
WHOLE = None  # cache value of an item whose text has to be encoded whole


def byte_letters() -> dict[int, str]:
    """The published byte-to-letter table of byte-level BPE: visible Latin-1 stays, the rest follows 255."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Generations:
    """A bounded cache: when the recent entries reach ``limit`` they become the older ones, which go."""

    def __init__(self, limit: int):
        self.limit = limit
        self.recent: dict = {}
        self.older: dict = {}

    def turn(self) -> None:
        if len(self.recent) >= self.limit:
            self.recent, self.older = {}, self.recent


class Known:
    """A bounded cache of items and their ids in flat arrays (some 50 bytes an item), looked up by Arrow all at once.

    When it has twice ``limit`` items, those of the last lookup and the latest others stay, ``limit`` in all if the former are fewer.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.keys = pa.array([], pa.large_string())
        self.sizes = np.empty(0, np.int32)  # -1: the text has to be encoded whole
        self.pool = np.empty(0, "<u4")

    def find(self, keys: pa.Array) -> np.ndarray:
        """The place of each key, -1 for unknown ones."""
        return pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int32)

    def add(self, keys: pa.Array, values: list[bytes | None]) -> None:
        self.keys = pa.concat_arrays([self.keys, keys])
        self.sizes = np.concatenate((self.sizes, np.fromiter((-1 if v is WHOLE else len(v) // 4 for v in values), np.int32, len(values))))
        self.pool = np.concatenate((self.pool, np.frombuffer(b"".join([v or b"" for v in values]), "<u4")))

    def trim(self, used: np.ndarray) -> None:
        if len(self.sizes) < 2 * self.limit:
            return
        lately = np.zeros(len(self.sizes), bool)
        lately[used] = True
        others = np.flatnonzero(~lately)
        stay = np.concatenate((others[max(0, len(others) - max(0, self.limit - int(lately.sum()))) :], np.flatnonzero(lately)))
        sizes = np.maximum(self.sizes, 0)
        ends = np.concatenate(([0], np.cumsum(sizes[stay], dtype=np.int64)))
        self.pool = _gathered(self.pool, np.cumsum(sizes, dtype=np.int64) - sizes, sizes, stay, ends)
        self.keys, self.sizes = self.keys.take(pa.array(stay)), self.sizes[stay]


class Encoder:
    """Ids of texts by one tokenizer file; ``limit`` bounds its cache of items, half of it (``PIECES_KEPT`` at most) that of pieces."""

    def __init__(self, path: str, limit: int = 250_000):
        self.path, self.limit = path, limit
        # Only items not seen lately are cut into pieces, and most of those are new as pieces too.
        self.items, self.pieces = Known(limit), Generations(min(max(1, limit // 2), PIECES_KEPT))
        self.common: tuple = (None, None, None)
        self.pattern, self.certain, self.easy = re.compile(PIECES), re.compile(CERTAIN), re.compile(EASY)
        self.letters = byte_letters()
        self.specials: list[str] = []
        self.cached = False
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            said = json.loads(self.library.to_str())
            pre, model = said["pre_tokenizer"] or {}, said["model"]
            self.specials = [x["content"] for x in said["added_tokens"]]
            # Padding and truncation of the file are switched off: counts are of whole texts.
            self.library.no_padding()
            self.library.no_truncation()
            self.cached = (
                said["normalizer"] is None
                and pre.get("type") == "ByteLevel"
                and not pre.get("add_prefix_space")
                and pre.get("use_regex")
                and model["type"] == "BPE"
                and not model.get("dropout")
                and not any(" " in x for x in self.specials)
            )
            self.model = self.library.model
            self.between = self._between(model) if self.cached else None
            if self.between is not None:
                os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
                self.merger = Tokenizer(self.model)
        elif path.endswith(".model"):
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            raise ValueError(f"neither a .json nor a .model file: {path}")

    def _between(self, model: dict) -> int | None:
        """The id of the byte ``NEVER``, if pieces with it between them merge as they do alone."""
        letter = self.letters[NEVER]
        merges = [x if isinstance(x, str) else "".join(x) for x in model["merges"]]
        apart = not any(letter in x for x in merges) and not any(BREAK in x for x in self.specials)
        if not apart or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return None
        # Ids below 2^24 only, so that their last byte is 0; all bytes have ids, so that none is left out.
        small = max(model["vocab"].values()) < 1 << 24 and all(x in model["vocab"] for x in self.letters.values())
        return model["vocab"][letter] if small else None

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text by the library alone."""
        ids = self.library.encode(text, add_special_tokens=False).ids if self.path.endswith(".json") else self.library.encode(text, num_threads=1)
        return np.array(ids, dtype="<u4")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another (unsigned 32 bit), and where each text's ids start, with the end."""
        if not texts:
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        if not self.cached:
            parts = [self.whole(x) for x in texts]
            return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        items, bounds, found, sizes, pool = self._looked_up(texts)
        known, sizes = sizes >= 0, np.maximum(sizes, 0)
        starts = (np.cumsum(sizes, dtype=np.int64) - sizes)[found]
        known, sizes = known[found], sizes[found]
        ends = np.zeros(len(items) + 1, np.int64)
        np.cumsum(sizes[items], out=ends[1:])
        ids = _gathered(pool, starts, sizes, items, ends)
        offsets = ends[bounds]
        odd = self._odd(texts, items, known, bounds)
        if not odd:
            return ids, offsets
        parts = [self.whole(x) if i in odd else ids[offsets[i] : offsets[i + 1]] for i, x in enumerate(texts)]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def lengths(self, texts: list[str], frequent: dict[str, int] | None = None) -> np.ndarray:
        """The number of ids of each text. ``frequent`` holds lengths of items that need no lookup here."""
        if not texts:
            return np.zeros(0, np.int64)
        if not self.cached:
            return np.array([len(self.whole(x)) for x in texts], np.int64)
        items, bounds, found, sizes, _ = self._looked_up(texts, frequent)
        sizes = np.where(found < 0, -2 - found, np.append(sizes, 0)[np.maximum(found, 0)])
        known = sizes >= 0
        sizes = np.maximum(sizes, 0).astype(np.int64)
        total = np.concatenate(([0], np.cumsum(sizes[items])))[bounds]
        out = np.diff(total)
        for i in self._odd(texts, items, known, bounds):
            out[i] = len(self.whole(texts[i]))
        return out

    def _looked_up(self, texts: list[str], frequent: dict[str, int] | None = None):
        """The items of the texts, where each text's begin, the place of each distinct one, and the sizes and ids by place.

        An item that is ``frequent`` has -2 less its number of ids for a place.
        """
        # Marked by Arrow: a marked Python string would take two bytes a letter, and as many again once it is encoded.
        mark, nothing = pa.scalar(FIRST, pa.large_string()), pa.scalar("", pa.large_string())
        lists = pc.split_pattern(pc.binary_join_element_wise(mark, pa.array(texts, pa.large_string()), nothing), " ")
        bounds, coded = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        del lists
        keys, items = coded.dictionary, coded.indices.to_numpy()
        own = self.items
        if frequent:
            if self.common[0] is not frequent:
                self.common = frequent, pa.array(list(frequent), pa.large_string()), np.fromiter(frequent.values(), np.int64, len(frequent))
            at = pc.fill_null(pc.index_in(keys, value_set=self.common[1]), -1).to_numpy(zero_copy_only=False)
            found = np.where(at < 0, -1, -2 - self.common[2][at]).astype(np.int32)
            rest = np.flatnonzero(at < 0)
            found[rest] = own.find(keys.take(pa.array(rest)))
        else:
            found = own.find(keys)
        new = np.flatnonzero(found == -1)
        if len(new):
            unknown = keys.take(pa.array(new))
            found[new] = len(own.sizes) + np.arange(len(new))
            own.add(unknown, self._made(unknown.to_pylist()))
        sizes, pool = own.sizes, own.pool
        own.trim(found[found >= 0])
        return items, bounds, found, sizes, pool

    def _odd(self, texts: list[str], items: np.ndarray, known: np.ndarray, bounds: np.ndarray) -> set[int]:
        """Which texts have to be encoded whole."""
        odd: set[int] = set()
        if not known.all():
            places = np.flatnonzero(~known[items])
            odd = set((np.searchsorted(bounds, places, side="right") - 1).tolist())
        if any(FIRST in x for x in texts):
            odd |= {i for i, x in enumerate(texts) if FIRST in x}
        return odd

    def _made(self, keys: list[str]) -> list[bytes | None]:
        """Ids of new items as bytes, WHOLE for those that may depend on what stands beside them."""
        out: list[bytes | None] = []
        for i in range(0, len(keys), MADE):
            some = keys[i : i + MADE]
            joined = "".join(some)
            plain = not any(x in joined for x in self.specials)
            if self.between is None or not plain:
                out += [self._made_alone(key, plain) for key in some]
                continue
            easy = list(map(self.easy.fullmatch, some))
            if all(easy):
                out += self._made_together(some)
            else:
                found = iter(self._made_together([key for key, x in zip(some, easy) if x]))
                out += [next(found) if x else self._made_alone(key, plain) for key, x in zip(some, easy)]
        self.pieces.turn()
        return out

    def _made_alone(self, key: str, plain: bool) -> bytes | None:
        recent, older = self.pieces.recent, self.pieces.older
        text = key[1:] if key[:1] == FIRST else " " + key
        if not key or text[-1:].isspace() or text[1:2].isspace() or (not plain and any(x in key for x in self.specials)):
            return WHOLE if text else b""
        if not self.certain.fullmatch(text):
            return self.whole(text).tobytes()
        found = self.pattern.findall(text)
        for p in found:
            if p not in recent:
                recent[p] = older.get(p) or self._merged(p)
        return recent[found[0]] if len(found) == 1 else b"".join([recent[p] for p in found])

    def _made_together(self, keys: list[str]) -> list[bytes]:
        """Ids of items that match EASY: no piece of the pattern crosses a BREAK between two of them."""
        if not keys:
            return []
        recent, older = self.pieces.recent, self.pieces.older
        found = self.pattern.findall((" " + f"{BREAK} ".join(keys)).replace(" " + FIRST, ""))
        new = []
        for p in set(found).difference(recent):
            if p in older:
                recent[p] = older[p]
            else:
                new.append(p)
        new = [p for p in new if p != BREAK]
        for p, ids in zip(new, self._merged_together(new)):
            recent[p] = ids
        recent[BREAK] = MARK
        out = b"".join([recent[p] for p in found]).split(MARK)
        del recent[BREAK]
        return out

    def _merged_together(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without a BREAK, ``MERGED`` of them as one word for the library."""
        words = []
        for i in range(0, len(pieces), MERGED):
            raw = BREAK.join(pieces[i : i + MERGED]).encode().replace(BREAK.encode(), bytes([NEVER]))
            words.append(raw.decode("latin-1").translate(self.letters))
        out = []
        for word in self.merger.encode_batch_fast(words, add_special_tokens=False):
            ids = np.array(word.ids, "<u4")
            ids[ids == self.between] = 0xFFFFFFFF
            out += ids.tobytes().split(MARK)
        return out

    def _merged(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, items: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ids of all items one after another; places are made for ``GATHERED`` items at a time, so they stay small."""
    ids = np.empty(ends[-1], pool.dtype)
    for i in range(0, len(items), GATHERED):
        some, low, high = items[i : i + GATHERED], ends[i], ends[min(i + GATHERED, len(items))]
        at = np.repeat(starts[some] - (ends[i : i + len(some)] - low), sizes[some])
        at += np.arange(high - low)
        np.take(pool, at, out=ids[low:high])
    return ids


def encoder(path: str, limit: int = 250_000) -> Encoder:
    """The worker's own encoder of a file, with its caches, kept between tasks."""
    return memo(("encoder", path, limit), lambda: Encoder(path, limit))
