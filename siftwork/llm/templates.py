"""Benchmark passages in documents, found by templates, so that changed numbers or names don't hide them.

Every word becomes a template token: numbers, units and names become typed slots, all other words
their lower-case letters and digits. A capitalised word at the start of a sentence can be a name or
not, so it is read both ways, and either may match. Windows of ``WINDOW`` tokens of the benchmark form a hash
table; windows of the documents probe it. A hit is extended along its diagonal (same distance
between the two texts). Where the slots of the agreeing tokens are not filled one to one (one value of
the item stands for one value of the document, and the other way round), the run is split into its
longest consistent stretches; each counts that has ``LEAST`` tokens in a row, enough of them words
or all of them copied word for word.

Items of fewer than ``WINDOW`` words, and those with letters of scripts without blanks, are looked up
as exact copies of the whole: word by word in a table per number of words, and letter by letter, wherever
it stands in running text, in a table per length of a prefix.

The table is broadcast in blocks of at most ``BLOCK_BYTES`` of benchmark text: one block as a rule, and
a further pass over the documents for each block more.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from siftwork.llm.shared import free_name
from siftwork.llm.worker import memo, mixed, shingle_hashes, slices, texts

WINDOW = 8
LEAST = 13  # agreeing tokens in a row, or a whole item where that is shorter
WORDS = 0.5  # share of them that are words and not slots, at least, where a slot's value differs
BLOCK_BYTES = 32 << 20
TABLE_BITS = 22
TOGETHER = 1 << 14  # words of texts whose windows are made together, some
READINGS = 4096  # windows whose readings are made at once, at most 2^WINDOW each
FACTOR = np.uint64(0x9E3779B97F4A7C15)

# Words that stand for a unit after a number.
UNITS = set(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur percent degree degrees mph kmh hz khz mhz ghz w kw kwh v a j kj cal kcal".split()
)

WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
CORE = r"^[^\w$€£%]+|[^\w%]+$"
NUMERIC = r"[$€£]?[+-]?\d[\d.,:/]*%?"
# Letters of scripts that set no blanks between words: Thai to Myanmar, Khmer, kana, ideographs.
UNSPACED = "\u0e00-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
PREFIXES = (16, 8, 4, 2, 1)


class Tokens:
    """The template tokens of a text: the hash of each lower-case word, the kind of slot it can be, and
    whether it is a slot for sure; a token that only can be a slot is read as a word too."""

    def __init__(self, low: np.ndarray, slot: np.ndarray, sure: np.ndarray):
        self.low, self.slot, self.sure = low, slot, sure

    def __len__(self) -> int:
        return len(self.low)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of each window of ``WINDOW`` tokens in all readings, in the order of their places."""
        count = len(self) - WINDOW + 1
        slot = self.slot.astype(np.uint64)
        base = np.where(self.sure, slot, self.low)
        both = (self.slot != WORD) & ~self.sure
        keys = np.full(count, WINDOW, np.uint64)
        factors = np.full(WINDOW, FACTOR, np.uint64)
        factors[0] = 1
        with np.errstate(over="ignore"):
            factors = np.multiply.accumulate(factors)[::-1]
            for i in range(WINDOW):
                keys *= FACTOR
                keys += base[i : i + count]
            total = np.concatenate(([0], np.cumsum(both)))
            open_ = np.flatnonzero(total[WINDOW:] > total[:-WINDOW])
            if not len(open_):
                return mixed(keys), np.arange(count)
            more, change = [], slot - base
            for k in range(0, len(open_), READINGS):
                at = open_[k : k + READINGS]
                own = keys[at]
                for i in range(WINDOW):
                    two = np.flatnonzero(both[at + i])
                    own = np.concatenate((own, own[two] + change[at[two] + i] * factors[i]))
                    at = np.concatenate((at, at[two]))
                n = min(READINGS, len(open_) - k)
                more.append((own[n:], at[n:]))
            keys = mixed(np.concatenate((keys, *(x for x, _ in more))))
            places = np.concatenate((np.arange(count), *(x for _, x in more)))
        return keys, places


class Places(dict):
    """Where the token of each known word is kept; ``add`` places a new word."""

    def __init__(self, add: Callable[[str], int]):
        super().__init__()
        self.add = add

    def __missing__(self, word: str) -> int:
        return self.add(word)


class Templates:
    """The template token of each word; kept for known words."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self.core, self.numeric = re.compile(CORE), re.compile(NUMERIC)
        self.clear()

    def clear(self) -> None:
        self.place = Places(self.add)
        self.lows, self.slots, self.ends = array("Q"), array("B"), array("B")

    def add(self, word: str) -> int:
        core = self.core.sub("", word)
        low = core.lower()
        if self.numeric.fullmatch(core):
            slot = NUMBER
        elif low in UNITS and len(low) > 1:
            slot = UNIT
        else:
            slot = NAME if len(core) > 1 and core[0].isupper() and core[1:].islower() else WORD
        self.lows.append(xxhash.xxh3_64_intdigest(low.encode()) | 8)
        self.slots.append(slot)
        self.ends.append(word[-1] in ".!?:;")
        at = self.place[word] = len(self.place)
        return at

    def of(self, words: list[str], starts: np.ndarray | None = None) -> Tokens:
        """The tokens of a text, or of several in a row that begin at ``starts``."""
        if len(self.place) > self.limit:
            self.clear()
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        view = lambda x, kind: np.frombuffer(x, kind)[at]
        first = np.concatenate(([True], view(self.ends, np.uint8)[:-1] != 0)) if len(at) else np.empty(0, bool)
        if starts is not None:
            first[starts] = True
        slot = view(self.slots, np.uint8)
        return Tokens(view(self.lows, np.uint64), slot, (slot != WORD) & ~(first & (slot == NAME)))


class Exact:
    """Whole sequences by the hash of their first ``width`` hashes or letters."""

    def __init__(self, width: int, rows: list[tuple[np.ndarray, object]]):
        self.width = width
        keys = np.concatenate([shingle_hashes(start[:width], width) for start, _ in rows])
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], [rows[k][1] for k in order.tolist()]

    def hits(self, own: np.ndarray) -> Iterator[tuple[int, object]]:
        """Places in a text, and what may stand there."""
        if len(own) < self.width:
            return
        windows = shingle_hashes(own, self.width)
        low, high = (np.searchsorted(self.keys, windows, side=x) for x in ("left", "right"))
        for at in np.flatnonzero(high > low).tolist():
            for k in range(int(low[at]), int(high[at])):
                yield at, self.rows[k]


class Benchmark:
    """The tables of one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        own = Templates()
        self.ids, self.words, self.tokens = [], [], []
        self.unspaced, self.dropped = re.compile(f"[{UNSPACED}]"), re.compile(f"[^\\w{UNSPACED}]|_")
        short, letters = {}, {}
        keys, item, start = [], [], []
        for item_id, text in items:
            words = text.split()
            if not words:
                continue
            if self.unspaced.search(text):
                run = self.letters(text)
                width = next(n for n in PREFIXES if n <= len(run))
                letters.setdefault(width, []).append((self.codes(run[:width]), (item_id, run)))
            tokens = own.of(words)
            if len(words) < WINDOW:
                if any(map(self.value, words)):
                    short.setdefault(len(words), []).append((tokens.low, (item_id, tokens.low)))
                continue
            # The first word can stand after any other, so its capital may be read as a name's there.
            first = tokens.slot[0] in (WORD, NAME)
            windows, places = Tokens(tokens.low, np.append(NAME if first else tokens.slot[0], tokens.slot[1:]), np.append(not first, tokens.sure[1:])).windows()
            keys.append(windows)
            item.append(np.full(len(windows), len(self.ids)))
            start.append(places)
            self.ids.append(item_id)
            self.words.append(words)
            self.tokens.append(tokens)
        self.short = [Exact(width, rows) for width, rows in sorted(short.items())]
        self.runs = [Exact(width, rows) for width, rows in sorted(letters.items())]
        keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.item = np.concatenate(item)[order] if item else order
        self.start = np.concatenate(start)[order] if start else order
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def matches(self, text: str, own: Templates) -> list[tuple[int, int, int]]:
        """``item_id, first word, number of words`` of each passage of an item in a text, in order."""
        return self.matches_of([text], own)[0]

    def matches_of(self, texts: list[str], own: Templates) -> list[list[tuple[int, int, int]]]:
        """``matches`` of each text; texts of some ``TOGETHER`` words share their array operations."""
        out, held, count = [], [], 0
        for text in texts:
            words = text.split()
            held.append((text, words))
            count += len(words)
            if count >= TOGETHER:
                out += self._together(held, own)
                held, count = [], 0
        return out + self._together(held, own)

    def _together(self, held: list[tuple[str, list[str]]], own: Templates) -> list[list[tuple[int, int, int]]]:
        found = [self.in_letters(text, words) if words else [] for text, words in held]
        sizes = np.array([len(words) for _, words in held], np.int64)
        ends = np.cumsum(sizes)
        if len(sizes) and (self.short or (len(self.keys) and sizes.max() >= WINDOW)) and ends[-1]:
            starts = ends - sizes
            tokens = own.of([w for _, words in held for w in words], starts[sizes > 0])
            part = lambda i: Tokens(*(x[starts[i] : ends[i]] for x in (tokens.low, tokens.slot, tokens.sure)))
            for exact in self.short:
                for i in np.flatnonzero(sizes).tolist():
                    low = tokens.low[starts[i] : ends[i]]
                    found[i] += [(item, at, exact.width) for at, (item, wanted) in exact.hits(low) if np.array_equal(low[at : at + exact.width], wanted)]
            if len(self.keys) and ends[-1] >= WINDOW:
                windows, places = tokens.windows()
                maybe = np.flatnonzero(self.table[(windows >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
                maybe = maybe[np.argsort(places[maybe], kind="stable")]
                text = np.searchsorted(ends, places[maybe], side="right")
                inside = places[maybe] + WINDOW <= ends[text]
                maybe, text = maybe[inside], text[inside]
                names, first = np.unique(text, return_index=True)
                for i, some in zip(names.tolist(), np.split(maybe, first[1:])):
                    found[i] += self.in_windows(held[i][1], part(i), windows[some], places[some] - starts[i])
        return [sorted(set(x)) for x in found]

    def letters(self, text: str) -> str:
        return self.dropped.sub("", text.lower())

    @staticmethod
    def codes(run: str) -> np.ndarray:
        return np.frombuffer(run.encode("utf-32-le"), "<u4").astype(np.uint64)

    def in_letters(self, text: str, words: list[str]) -> list[tuple[int, int, int]]:
        """The passages of whole items whose script sets no blanks."""
        if not self.runs or not self.unspaced.search(text):
            return []
        own = [self.letters(w) for w in words]
        ends, run = np.cumsum([len(x) for x in own]), "".join(own)
        codes, found = self.codes(run), []
        for exact in self.runs:
            for at, (item_id, wanted) in exact.hits(codes):
                if run.startswith(wanted, at):
                    first, last = np.searchsorted(ends, (at, at + len(wanted) - 1), side="right").tolist()
                    found.append((item_id, first, last - first + 1))
        return found

    def in_windows(self, words: list[str], tokens: Tokens, windows: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int]]:
        """The passages found by windows that may be of an item, in the order of their places."""
        low = np.searchsorted(self.keys, windows, side="left")
        high = np.searchsorted(self.keys, windows, side="right")
        found, seen = [], {}
        for at, a, b in zip(places.tolist(), low.tolist(), high.tolist()):
            for k in range(a, b):
                item, start = int(self.item[k]), int(self.start[k])
                if seen.get((item, at - start), -1) >= at:  # inside a run that has been looked at
                    continue
                first, end = self.run(item, start, tokens, at)
                seen[(item, at - start)] = end - WINDOW
                found += [(self.ids[item], first + i, j - i) for i, j in self.passages(item, start - at + first, words, tokens, first, end - first)]
        return found

    def run(self, item: int, start: int, tokens: Tokens, at: int) -> tuple[int, int]:
        """Begin and end, in the text, of the tokens around there that agree."""
        own = self.tokens[item]
        before, after = min(start, at), min(len(own) - start, len(tokens) - at)
        here, there = slice(start - before, start + after), slice(at - before, at + after)
        apart = np.flatnonzero((own.low[here] != tokens.low[there]) & ((own.slot[here] != tokens.slot[there]) | (own.slot[here] == WORD)))
        k = int(np.searchsorted(apart, before))
        return at - before + (int(apart[k - 1]) + 1 if k else 0), at - before + (int(apart[k]) if k < len(apart) else before + after)

    def passages(self, item: int, start: int, words: list[str], tokens: Tokens, at: int, length: int) -> list[tuple[int, int]]:
        """Begin and end of each passage in a run of agreeing tokens."""
        need = min(LEAST, len(self.words[item]))
        if length < need:
            return []
        own, here, there = self.tokens[item], slice(start, start + length), slice(at, at + length)
        same = own.low[here] == tokens.low[there]
        # Equal words are a slot only if one of the two texts leaves no other reading.
        slot = ~same | ((own.slot[here] == tokens.slot[there]) & (own.sure[here] | tokens.sure[there]))
        word, changed = (np.concatenate(([0], np.cumsum(x))) for x in (same & ~own.sure[here], ~same))
        good = (word[need:] - word[:-need] >= WORDS * need) | (changed[need:] == changed[:-need])
        if not good.any() and word[-1] < WORDS * need:
            return []
        slots = np.flatnonzero(slot).tolist()
        kinds = own.slot[here].tolist()
        pairs = [((kinds[i], self.value(self.words[item][start + i])), (kinds[i], self.value(words[at + i]))) for i in slots]
        found = []
        for i, j in consistent(slots, pairs, length):
            if j - i < need:
                continue
            if word[j] - word[i] >= WORDS * (j - i) or changed[j] == changed[i]:
                found.append((i, j))
            else:
                found += [(i + a, i + b + need - 1) for a, b in stretches(good[i : j + 1 - need])]
        return found

    @staticmethod
    def value(word: str) -> str:
        return re.sub(CORE, "", word).lower()


def consistent(slots: list[int], pairs: list[tuple], length: int) -> list[tuple[int, int]]:
    """Begin and end of each longest stretch of a run whose pairs of values at ``slots`` are one to one."""
    begin, found = 0, []
    there: dict = {}
    back: dict = {}
    for i, (a, b) in zip(slots, pairs):
        clash = max([p for p, x in (there.get(a, (-1, b)),) if x != b] + [p for p, x in (back.get(b, (-1, a)),) if x != a], default=-1)
        if clash >= begin:
            found.append((begin, i))
            begin = clash + 1
        there[a], back[b] = (i, b), (i, a)
    return [*found, (begin, length)]


def stretches(good: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each stretch of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], good.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


MATCHES = ArrayType(StructType([StructField("item_id", LongType()), StructField("start", LongType()), StructField("length", LongType())]))


def with_matches(docs: DataFrame, benchmark: DataFrame, column: str = "matches", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``column``: the benchmark passages of each text (item, first word, words).

    A null text has none; rows, their order in a partition and all other columns stay as they are; a
    column of that name that is there already is replaced. Items with null texts or ids, or
    without any letter or digit, are not searched for; repeated items are searched for once.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropna().distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    out = docs.drop(column).withColumn(column, F.array().cast(MATCHES))
    for k in range(blocks):
        # A block holds about ``block_bytes`` of text, so it may come to the driver.
        rows = sorted(map(tuple, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()))
        out = _probed(out, docs.sparkSession.sparkContext.broadcast(rows), column)
    return out


def _probed(docs: DataFrame, rows, column: str) -> DataFrame:
    place = docs.columns.index(column)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = rows.value
        own, table = memo("templates", Templates), memo(("benchmark", xxhash.xxh3_64_hexdigest(repr(block))), lambda: Benchmark(block))
        for batch in batches:
            for part in slices(batch, "text"):
                found = [before + [{"item_id": i, "start": s, "length": n} for i, s, n in new] for new, before in zip(table.matches_of(texts(part), own), part.column(column).to_pylist())]
                columns = [part.column(i) for i in range(part.num_columns)]
                columns[place] = pa.array(found, kind)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, contaminated, item_ids, matches`` of every row; see ``with_matches``."""
    found = with_matches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), benchmark)
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.array_sort(F.array_distinct("matches.item_id")).alias("item_ids"), "matches")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark passage."""
    mark = free_name(docs, "_matches")
    return with_matches(docs, benchmark, mark).where(F.size(mark) == 0).select(*docs.columns)
