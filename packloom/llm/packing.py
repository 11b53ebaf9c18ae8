"""Mixture-controlled packing of token streams into fixed windows.

Each source is a queue of tokens, served by deficit round-robin: every window
adds a queue's quantum, its share of the window, to the queue's deficit and
serves the whole tokens of it; what is left of the window goes to the greatest
remainders, and deficits, of less than two tokens, carry on to the next window.
Shares are whole numbers of tokens a period of windows, so all deficits are zero
after a period: one period is run through, and any window of any later period is
arithmetic.  A task can so place any document without state from another, which
is how deficits carry across partitions.  In the window in which a queue runs
dry the others take its tokens by their shares; a new period begins after it.

Above ``MAX_QUEUES`` sources the same runs twice: queues of several sources are
served by the sum of their shares, and what a queue is served is dealt to its
sources in small windows of its own.

The only global state is one token count per source and per (partition, source).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .batches import by_parts, parts
from .bpe import byte_symbols
from .staging import stage

#: Windows after which the service repeats; more where there are more queues than QUEUES_PER_WINDOW for each.
PERIOD = 64
QUEUES_PER_WINDOW = 16
#: More sources than this share this many queues, in each of which a second round-robin serves them.
MAX_QUEUES = 256
#: Tokens of a period of a second round-robin at least, so that its shares are fine enough.
INNER_TOKENS = 8_192
#: Tables of a period that a task holds at once.
TABLES = 64
PART_ROWS, PART_BYTES = 500, 4 << 20
#: The split pattern of the byte-level vocabulary (a fixed value of that format).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(2)
def _tokenizer(path: str) -> tiktoken.Encoding:
    """The vocabulary file's ids are its merge ranks."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte = byte_symbols()
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {t: i for t, i in ranks.items() if i not in special.values()}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _token_queues(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, part, before = _tokenizer(path), TaskContext.get().partitionId(), {}
        kind = "<u2" if max(encoding.n_vocab, end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            for rows in parts(batch, 1, PART_ROWS, PART_BYTES):
                sources, ids, starts, sizes = rows.column(2).to_pylist(), [], [], []
                for text, source in zip(rows.column(1), sources, strict=True):
                    tokens = encoding.encode_to_numpy(text.as_py() or "", allowed_special="all")
                    ids.append(np.append(tokens, np.uint32(end_id)).astype(kind).tobytes())
                    starts.append(before.get(source, 0))
                    sizes.append(len(tokens) + 1)
                    before[source] = starts[-1] + sizes[-1]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["id", "queue", "part", "before", "tokens", "ids"])
        pa.default_memory_pool().release_unused()

    return run


def round_robin(shares: np.ndarray, windows: int) -> np.ndarray:
    """Tokens of each queue in each window of a period; ``shares`` are its tokens in the whole period.

    Deficits are held in units of 1 / ``windows`` token; equal remainders go to
    the first queue.
    """
    length = int(shares.sum()) // windows
    deficit, counts = np.zeros(len(shares), np.int64), np.zeros((windows, len(shares)), np.int64)
    for w in range(windows):
        deficit += shares
        served = np.maximum(deficit, 0) // windows
        rest = deficit - served * windows
        left = length - int(served.sum())
        if left > 0:
            served[np.argsort(-rest, kind="stable")[:left]] += 1
        elif left < 0:  # owed to queues that are ahead: these wait
            due = np.flatnonzero(served)
            served[due[np.argsort(rest[due], kind="stable")[:-left]]] -= 1
        deficit -= served * windows
        counts[w] = served
    return counts


def _to_period(weights: np.ndarray, period: int) -> np.ndarray:
    """Whole numbers of a period's tokens, at least one for each queue, by largest remainder."""
    exact = weights / weights.sum() * (period - len(weights))
    shares = np.floor(exact).astype(np.int64)
    short = period - len(weights) - int(shares.sum())
    shares[np.argsort(-(exact - shares), kind="stable")[:short]] += 1
    return shares + 1


def _take_dry(counts: np.ndarray, left: np.ndarray, weights: np.ndarray, length: int) -> np.ndarray:
    """A window in which a queue runs dry: its missing tokens go to the others by their weights."""
    take = np.minimum(counts, left)
    while (short := length - int(take.sum())) > 0 and (more := np.flatnonzero(left > take)).size:
        extra = np.floor(short * weights[more] / weights[more].sum()).astype(np.int64)
        if not extra.any():
            extra[np.argsort(-weights[more], kind="stable")[:short]] = 1
        take[more] += np.minimum(extra, left[more] - take[more])
    return take


class Schedule:
    """Where each token of each queue stands: its window, and its place there.

    Runs of windows with the same queues follow one another; within a run the
    period's table repeats.  A window holds its queues in order.
    """

    def __init__(self, totals: list[int], weights: list[float], length: int = 1024, least: int = 0):
        self.length, total, weight = length, np.array(totals, np.int64), np.array(weights, float)
        self.period = PERIOD
        while self.period * length < max(least, 4 * len(totals)) or self.period * QUEUES_PER_WINDOW < len(totals):
            self.period *= 2
        self.begins, self.tables, before, served, window = [], [], [], np.zeros(len(total), np.int64), 0
        self.table = lru_cache(TABLES)(self._table)
        while (left := total - served).any():
            active = np.flatnonzero(left)
            shares = np.zeros(len(total), np.int64)
            shares[active] = _to_period(weight[active], self.period * length)
            cum = self._periodic(shares)
            rounds = left[active] // shares[active]
            extra = [int(np.searchsorted(cum[1:, q], left[q] - r * shares[q], "right")) for q, r in zip(active, rounds, strict=True)]
            n = int(min(r * self.period + e for r, e in zip(rounds, extra, strict=True)))
            for count, table in ((n, shares), (1, None)):
                if count and (left := total - served).any():
                    if table is None:  # the window in which a queue runs dry, or the last one
                        table = _take_dry(np.diff(cum, axis=0)[n % self.period], left, weight, length)[None]
                        used = table[0]
                    else:
                        used = n // self.period * shares + cum[n % self.period]
                    self.begins.append(window)
                    self.tables.append(table)
                    before.append(served)
                    served, window = served + used, window + count
        self.windows, self.begins, self.served = window, np.array(self.begins, np.int64), np.array(before, np.int64).reshape(-1, len(total))
        del self.table
        self.table = lru_cache(TABLES)(self._table)

    def _periodic(self, shares: np.ndarray) -> np.ndarray:
        active = np.flatnonzero(shares)
        counts = np.zeros((self.period, len(shares)), np.int64)
        counts[:, active] = round_robin(shares[active], self.period)
        return np.concatenate((np.zeros((1, len(shares)), np.int64), counts.cumsum(0)))

    def _table(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of run k: tokens of each queue before each window of the period, and where the queues begin in it."""
        table = self.tables[k]
        cum = self._periodic(table) if table.ndim == 1 else np.concatenate((0 * table, table))
        counts = np.diff(cum, axis=0)
        return cum, counts.cumsum(1) - counts

    def _runs(self, run: np.ndarray):
        for k in np.unique(run):
            yield int(k), np.flatnonzero(run == k)

    def window_of(self, q: int, token: np.ndarray) -> np.ndarray:
        """Windows of some of a queue's tokens."""
        out = np.empty(len(token), np.int64)
        for k, at in self._runs(np.searchsorted(self.served[:, q], token, "right") - 1):
            cum = self.table(k)[0]
            rounds, rest = np.divmod(token[at] - self.served[k, q], cum[-1, q])
            out[at] = self.begins[k] + rounds * (len(cum) - 1) + np.searchsorted(cum[:, q], rest, "right") - 1
        return out

    def served_before(self, q: int, window: np.ndarray) -> np.ndarray:
        """Tokens of a queue in all windows before each of ``window``."""
        out = np.empty(len(window), np.int64)
        for k, at in self._runs(np.searchsorted(self.begins, window, "right") - 1):
            cum = self.table(k)[0]
            rounds, rest = np.divmod(window[at] - self.begins[k], len(cum) - 1)
            out[at] = self.served[k, q] + rounds * cum[-1, q] + cum[rest, q]
        return out

    def offset(self, q: int, window: np.ndarray) -> np.ndarray:
        """Where a queue begins in each of ``window``."""
        out = np.zeros(len(window), np.int64)
        for k, at in self._runs(np.searchsorted(self.begins, window, "right") - 1):
            begin = self.table(k)[1]
            out[at] = begin[(window[at] - self.begins[k]) % len(begin), q]
        return out

    def served_by(self, q: int, place: np.ndarray) -> np.ndarray:
        """Tokens of a queue among the first ``place`` tokens of all windows in a row."""
        window = np.minimum(place // self.length, self.windows - 1)
        before = self.served_before(q, window)
        run = self.served_before(q, window + 1) - before
        return before + np.clip(place - window * self.length - self.offset(q, window), 0, run)

    def place(self, q: int, token: np.ndarray) -> np.ndarray:
        """Places of some of a queue's tokens in all windows in a row."""
        window = self.window_of(q, token)
        return window * self.length + self.offset(q, window) + token - self.served_before(q, window)

    def pieces(self, q: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cuts the queue's tokens begin..end-1 of each document by windows: document, first token, tokens, window, offset."""
        low, high = self.window_of(q, begin), self.window_of(q, end - 1)
        doc, window = _each(low, high)
        starts, offset = self.served_before(q, window), self.offset(q, window)
        return _cut(doc, begin, end, starts, self.served_before(q, window + 1), window, offset)


def _each(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of all of low..high, one after another."""
    sizes = high - low + 1
    index = np.repeat(np.arange(len(low)), sizes)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[index]


def _cut(doc: np.ndarray, begin: np.ndarray, end: np.ndarray, starts: np.ndarray, stops: np.ndarray, window: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, ...]:
    first, last = np.maximum(begin[doc], starts), np.minimum(end[doc], stops)
    some = first < last
    return doc[some], first[some], (last - first)[some], window[some], (offset + first - starts)[some]


class GroupedSchedule:
    """A :class:`Schedule` of queues of several sources; what a queue is served goes to its sources by a schedule of its own.

    Sources are numbered queue by queue; ``first`` has the number of each queue's first one.
    """

    def __init__(self, totals: list[int], weights: list[float], first: list[int], length: int = 1024):
        self.first = np.array(first)
        self.parts = [(totals[a:b], weights[a:b]) for a, b in zip(first, [*first[1:], len(totals)], strict=True)]
        self.outer = Schedule([sum(t) for t, _ in self.parts], [sum(w) for _, w in self.parts], length)
        self.inner = lru_cache(8)(self._inner)

    def _inner(self, g: int) -> Schedule:
        totals, weights = self.parts[g]
        return Schedule(totals, weights, max(2, len(totals)), INNER_TOKENS)

    def pieces(self, q: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """As :meth:`Schedule.pieces`; within a queue's part of a window its sources stand in order."""
        g = int(np.searchsorted(self.first, q, "right")) - 1
        inner, s = self.inner(g), q - int(self.first[g])
        low, high = (self.outer.window_of(g, inner.place(s, t)) for t in (begin, end - 1))
        doc, window = _each(low, high)
        each, back = np.unique(window, return_inverse=True)
        x, y = self.outer.served_before(g, each), self.outer.served_before(g, each + 1)
        ahead = sum((inner.served_by(k, y) - inner.served_by(k, x) for k in range(s)), np.zeros(len(each), np.int64))
        offset = self.outer.offset(g, each) + ahead
        return _cut(doc, begin, end, inner.served_by(s, x)[back], inner.served_by(s, y)[back], window, offset[back])


def _place(totals: list[int], weights: list[float], names: list[str], first_of: list[int] | None, length: int):
    def make():
        plan = GroupedSchedule(totals, weights, first_of, length) if first_of else Schedule(totals, weights, length)
        index = {n: q for q, n in enumerate(names)}

        def one(rows: pa.RecordBatch) -> pa.RecordBatch:
            queues = np.array([index[x] for x in rows.column("queue").to_pylist()])
            first, sizes = (rows.column(c).to_numpy() for c in ("first", "tokens"))
            found = []
            for q in np.unique(queues):
                docs = np.flatnonzero(queues == q)
                doc, *rest = plan.pieces(int(q), first[docs], first[docs] + sizes[docs])
                found.append((docs[doc], *rest))
            doc, token, size, window, offset = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((token, doc))
            doc, token, size, window, offset = (x[order] for x in (doc, token, size, window, offset))
            data = [x.as_buffer() for x in rows.column("ids")]
            flat = np.concatenate([np.frombuffer(x, f"<u{len(x) // n}") for x, n in zip(data, sizes, strict=True)]).astype("<u4")
            cuts = np.append(0, np.cumsum(size)) * 4
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(flat)])
            columns = [rows.column("id").take(pa.array(doc)), pa.array(token - first[doc]), pa.array(size), ids, pa.array(sizes[doc]), pa.array(window), pa.array(offset), rows.column("label").take(pa.array(doc))]
            return pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "queue"])

        return one

    return by_parts(make, "ids", PART_ROWS, PART_BYTES)


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, shares: dict[str, float] | None = None, length: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: id, start, length, ids, doc_tokens, sequence_id, offset, queue.

    A document is its ids and then ``end_id``; it is cut wherever its source's
    part of a window ends, so that every window keeps the mixture.  ``shares``
    gives each source's part of a window (a source not named there weighs as the
    smallest named); by default the sources' parts of the corpus, so that all
    last until the end.  A window holds each source's part within two tokens
    until a source runs dry, whose part then goes to the others.  More than
    ``MAX_QUEUES`` sources are dealt to as many queues, ``queue`` being a queue's
    number: parts then hold within four tokens, and the part of a source that
    runs dry goes to the others of its queue first.  One count a source reaches
    the driver and the tasks.  All sequences are full but the last one; their
    numbers follow the order in which the table's partitions hold the documents.
    Null and empty texts are the end id alone; texts may be of any length; a
    null source is the queue ''.  Ties: equal deficits go to the first source by
    name.  Null and repeated ids are kept as rows of their own.  An empty table
    gives no rows; other columns are ignored.  ``ids`` holds little-endian
    unsigned 32-bit integers.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("queue"))
    kind = docs.schema["id"].dataType.simpleString()
    tokens = stage(docs.mapInArrow(_token_queues(path, end_id), f"id {kind}, queue string, part int, before long, tokens long, ids binary"), "pack-tokens", "zstd")
    cells = stage(tokens.groupBy("part", "queue").agg(F.sum("tokens").alias("tokens")), "pack-cells")
    many = cells.select("queue").distinct().count() > MAX_QUEUES
    label = F.pmod(F.xxhash64("queue"), F.lit(MAX_QUEUES)).cast("string") if many else F.col("queue")
    ahead = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("label", label).withColumn("base", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)))
    sums = cells.groupBy("label", "queue").agg(F.sum("tokens").alias("n")).orderBy("label", "queue").collect()
    names, totals = [r["queue"] for r in sums], [r["n"] for r in sums]
    first_of = [q for q, r in enumerate(sums) if not q or sums[q - 1]["label"] != r["label"]] if many else None
    if shares and names:
        least = min(v for v in shares.values() if v > 0)
        weights = [max(shares.get(n, least), least / 1e6) for n in names]
    else:
        weights = [float(t) for t in totals]
    placed = tokens.join(cells.select("part", "queue", "label", "base"), ["part", "queue"]).select("id", "queue", "label", (F.col("base") + F.col("before")).alias("first"), "tokens", "ids")
    if many:  # a task then makes each second schedule once
        placed = placed.sortWithinPartitions("label")
    out = placed.mapInArrow(_place(totals, weights, names, first_of, length), f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, queue string")
    return out.withColumnRenamed("id", id_col)
