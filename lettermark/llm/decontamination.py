"""Benchmark decontamination: texts that hold a benchmark item up to a few edits."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of all items that one pass over the texts searches; larger benchmarks take several passes.
PASS_CHARS = 4_000_000
_GAP = re.compile(r"[^0-9a-z\x80-\U0010ffff]+")


def normal(text: str | None) -> str:
    """Lower case, with one space for every stretch of ASCII that is no letter or digit, none at the ends."""
    return _GAP.sub(" ", (text or "").lower()).strip(" ")


def cut(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


#: Scripts written without spaces between words: Thai to Tibetan, Burmese, Khmer, kana and Chinese characters.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def bounded(text: str, start: int, end: int) -> bool:
    """Whether no word goes on beyond the part of a text; scripts without spaces and signs have a bound at every character."""

    def apart(a: str, b: str) -> bool:
        return not (_word(a) and _word(b))

    return (start == 0 or apart(text[start - 1], text[start])) and (end == len(text) or apart(text[end - 1], text[end]))


def _word(c: str) -> bool:
    return (c.isalnum() or unicodedata.category(c)[0] == "M") and not _UNSPACED.match(c)


def budget(length: int, percent: int) -> int:
    return length * percent // 100


class Item:
    """A pattern with its Myers bit vectors and error budget."""

    def __init__(self, pattern: str, errors: int):
        self.pattern, self.errors = pattern, errors
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def pieces(self) -> list[tuple[int, str]]:
        """The pattern in errors + 1 pieces of about one length: (offset, piece)."""
        n, parts = len(self.pattern), self.errors + 1
        cuts = [n * k // parts for k in range(parts + 1)]
        return [(a, self.pattern[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def distance(self, text: str) -> int:
        """The least edit distance between the pattern and any part of the text."""
        m = len(self.pattern)
        mask, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score, best = mask, 0, m, m
        for c in text:
            x = self.masks.get(c, 0)
            d = (((x & plus) + plus) ^ plus) | x | minus
            up, down = minus | (mask & ~(d | plus)), plus & d
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = up << 1 & mask, down << 1 & mask
            plus, minus = down | (mask & ~((x | minus) | up)), up & (x | minus)
            best = min(best, score)
        return best


class Matcher:
    """Finds items in normalised texts: exact hits of any piece, then Myers' distance around them.

    Items of fewer than `least` characters are found as they are and on word bounds.
    """

    def __init__(self, items: list[tuple[int, str]], percent: int, least: int = 0):
        import ahocorasick

        self.least = least
        self.items = [(i, Item(t, budget(len(t), percent) if len(t) >= least else 0)) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item) in enumerate(self.items):
            for at, piece in item.pieces():
                where.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def search(self, text: str) -> Iterator[tuple[int, int]]:
        """(item_id, smallest distance) of the items within their budgets."""
        starts: dict[int, list[int]] = {}
        for last, (n, places) in self.automaton.iter(text):
            for k, at in places:
                if len(self.items[k][1].pattern) < self.least and not bounded(text, last - n + 1, last + 1):
                    continue
                starts.setdefault(k, []).append(last - n + 1 - at)
        for k, found in starts.items():
            item_id, item = self.items[k]
            n, e, best = len(item.pattern), item.errors, item.errors + 1
            if n < self.least:
                yield item_id, 0
                continue
            found = sorted(set(found))
            low = high = found[0]
            for s in [*found[1:], None]:
                if s is not None and s <= high + n:  # one stretch of text for hits that lie close together
                    high = s
                    continue
                best = min(best, item.distance(text[max(0, low - e) : high + n + e]))
                low = high = s
            if best <= e:
                yield item_id, best


def _lots(benchmark: DataFrame) -> list[list[tuple]]:
    """(item_id, normal text) of the items with any word, in lots for one pass each."""
    lots: list[list[tuple]] = [[]]
    held = 0
    for row in benchmark.select("item_id", "text").where("text IS NOT NULL").distinct().toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        if held + len(text) > PASS_CHARS and lots[-1]:
            lots.append([])
            held = 0
        lots[-1].append((row["item_id"], text))
        held += len(text)
    return lots


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 5, least: int = 20) -> DataFrame:
    """(doc_id, item_id, distance) for every text and item whose distance is within the item's budget.

    Texts and items are lower-cased and reduced to words. The budget is `percent` of the item's length, the distance
    the fewest edits that turn some part of the text into the item. An item is cut into one piece more than its budget,
    so one of them must stand in the text as it is. Items shorter than `least` characters match
    without edits and on word bounds only: parts of words would be found in any text. NULL texts match nothing, rows that repeat an id give a row each, and empty tables no rows.
    The items are few by nature and are sent to the tasks in lots of at most `PASS_CHARS` characters or one item;
    a larger benchmark takes more passes over the texts. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = benchmark.schema["item_id"].dataType.simpleString()
    lots = _lots(benchmark)

    def search(items):
        def run(batches):
            matcher = None
            for batch in cut(batches):
                matcher = matcher or (Matcher(items, percent, least) if items else None)
                rows = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t and matcher for hit in matcher.search(normal(t))]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.types[0]), pa.array(columns[1]), pa.array(columns[2], pa.int32())], names=["doc_id", "item_id", "distance"])

        return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id {key}, distance int")

    found = search(lots[0])
    for lot in lots[1:]:
        found = found.union(search(lot))
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame, percent: int = 5, least: int = 20) -> DataFrame:
    """The rows of `docs` (text, any others) that hold no item, with all their columns; see `leaks`."""

    def search(items, at):
        def run(batches):
            matcher = None
            for batch in cut(batches):
                matcher = matcher or Matcher(items, percent, least)
                clean = [not t or next(matcher.search(normal(t)), None) is None for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for lot in _lots(benchmark):
        if lot:
            docs = docs.mapInArrow(search(lot, docs.columns.index("text")), docs.schema)
    return docs
