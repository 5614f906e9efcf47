"""Benchmark decontamination with generalised suffix automata over the words of the test items.

Training words are streamed through an automaton, which tracks the longest match that ends at each
word. A match of ``window`` words or more, or a whole shorter item, is a hit. Words and runs of RUN words that
occur in no item reset the automaton, so only stretches whose every run is known to the items are walked; the
test for that is vectorised. Items of fewer than RUN words are looked up as they are.

The benchmark's words are hashed in tasks and dealt into blocks of at most about BLOCK_WORDS (an item beyond an
eighth of that is dealt as pieces that overlap by a window). Each block's automaton is built in one task, as flat
arrays of about 60 bytes a word, and one block at a time is sent to the executors. A benchmark of several blocks
is walked in as many passes, whose hits are written to the scratch folder with the rows; so no size of the
benchmark is held at once by the driver or by a worker.

Defined results: null or wordless texts have no words and no hits; null, empty and repeated items
count for themselves, items of one id once; an empty benchmark hits nothing; an empty table gives an empty table;
texts of any length are read whole; repeated rows get equal results; columns of any name are kept by
``decontaminate`` and ignored by ``contamination``.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, WordHasher, chunks, mix, odd_constants, once, release, text_buffer

#: Words of the items that one automaton holds, and that one broadcast sends.
BLOCK_WORDS = 1_000_000
RUN = 4

REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, longest long, coverage double, spans array<struct<start:int,end:int>>"
CARRY = "hits array<struct<a:int,b:int>>, items array<string>, longest int"


class SuffixAutomaton:
    """States over word codes, shared by all items: a first transition of each state in arrays, further ones in a dictionary."""

    def __init__(self, items: list, window: int) -> None:
        """items: (number of the item's id, list of word codes)."""
        self.word, self.to, self.link, self.length = array("i", [-1]), array("i", [-1]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.window = window
        self.windows: dict[int, set] = {}
        self.short: dict[int, list] = {}
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        for item, words in items:
            state = 0
            for k, w in enumerate(words):
                state = self.follow(state, w)
                if k + 1 >= window:
                    self.windows.setdefault(self.cut(state, window), set()).add(item)
            if 0 < len(words) < window:
                self.short.setdefault(self.cut(state, len(words)), []).append((item, len(words)))

    def follow(self, state: int, w: int) -> int:
        """The state after a word, or -1."""
        if self.word[state] == w:
            return self.to[state]
        more = self.more.get(state)
        return -1 if more is None else more.get(w, -1)

    def _put(self, state: int, w: int, q: int) -> None:
        if self.word[state] in (-1, w):
            self.word[state], self.to[state] = w, q
        else:
            self.more.setdefault(state, {})[w] = q

    def cut(self, state: int, n: int) -> int:
        """The state of the last n words."""
        while state and self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _state(self, word: int, to: int, link: int, length: int) -> int:
        self.word.append(word)
        self.to.append(to)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _extend(self, last: int, w: int) -> int:
        q = self.follow(last, w)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(-1, -1, 0, self.length[last] + 1), last
        while p >= 0 and (q := self.follow(p, w)) < 0:
            self._put(p, w, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.word[q], self.to[q], self.link[q], self.length[p] + 1)
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self.link[q] = copy
        while p >= 0 and self.follow(p, w) == q:
            self._put(p, w, copy)
            p = self.link[p]
        return copy

    def arrays(self) -> dict:
        """What ``Walker`` reads, as flat arrays."""
        import numpy as np

        n, length = len(self.link), np.frombuffer(self.length, np.int32)
        marked, link = np.full(n, -1, np.int32), self.link
        for s in np.argsort(length, kind="stable").tolist():  # itself or its nearest suffix that is a whole shorter item
            marked[s] = s if s in self.short else (marked[link[s]] if s else -1)
        more = [(s, w, q) for s, m in self.more.items() for w, q in m.items()]
        wins = sorted((s, i) for s, held in self.windows.items() for i in held)
        short = [(s, i, k) for s, held in self.short.items() for i, k in held]
        flat = {name: np.array(x, np.int32).reshape(-1, width) for name, x, width in (("more", more, 3), ("wins", wins, 2), ("short", short, 3))}
        return flat | {"word": np.frombuffer(self.word, np.int32), "to": np.frombuffer(self.to, np.int32), "link": np.frombuffer(self.link, np.int32), "length": length, "marked": marked, "window": self.window}


class Walker:
    """Walks words through an automaton's arrays."""

    def __init__(self, a: dict) -> None:
        import numpy as np

        self.word, self.to, self.link, self.length, self.marked = (memoryview(np.ascontiguousarray(a[k])) for k in ("word", "to", "link", "length", "marked"))
        self.window, self.wins, self.more, self.short = a["window"], a["wins"], {}, {}
        for s, w, q in a["more"].tolist():
            self.more.setdefault(s, {})[w] = q
        for s, i, n in a["short"].tolist():
            self.short.setdefault(s, []).append((i, n))
        self.won = np.ascontiguousarray(a["wins"][:, 0])

    def walk(self, words: list[int], base: int, hit, items: set) -> int:
        """Marks the hit words of a stretch that begins at word ``base``; the longest match."""
        word, to, link, length, more, window, won = self.word, self.to, self.link, self.length, self.more, self.window, set()
        state = matched = longest = 0
        for k, w in enumerate(words):
            while True:
                q = to[state] if word[state] == w else more[state].get(w, -1) if state in more else -1
                if q >= 0 or not state:
                    break
                state = link[state]
                matched = length[state]
            if q >= 0:
                state, matched = q, matched + 1
            longest = max(longest, matched)
            at = base + k + 1
            if matched >= window:
                hit[at - matched : at] = True
                s = state
                while s and length[link[s]] >= window:
                    s = link[s]
                won.add(s)
            s = self.marked[state]
            while s > 0:
                for item, n in self.short.get(s, ()):
                    if n <= matched:
                        hit[at - n : at] = True
                        items.add(item)
                s = self.marked[link[s]]
        for s in won:
            a, b = self.won.searchsorted([s, s + 1]).tolist()
            items.update(self.wins[a:b, 1].tolist())
        return longest


def item_words(benchmark: DataFrame, window: int, piece: int) -> DataFrame:
    """(item, words): the word hashes of each item with words, in pieces of at most ``piece`` words that overlap by window - 1."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hasher = WordHasher("alnum")
        for batch in batches:
            ids, raw_ids, rows = [], batch.column(0).to_pylist(), []
            raw, starts, ends = text_buffer(batch.column(1))
            for i, j in chunks(starts, ends):
                h, _, _, count = hasher(raw, starts[i:j], ends[i:j])
                at = np.r_[0, np.cumsum(count)]
                for k in range(j - i):
                    words = h[at[k] : at[k + 1]].view(np.int64)
                    for a in range(0, max(len(words) - window + 1, min(len(words), 1)), piece):
                        ids.append(raw_ids[i + k])
                        rows.append(words[a : a + piece + window - 1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(rows, pa.list_(pa.int64()))], ["item", "words"])

    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item string, words array<long>")


def block_of(items: list, words: list, window: int) -> dict:
    """What one pass needs of (item, word hashes): sorted words, known runs, the automaton, and items of fewer than RUN words."""
    import numpy as np

    names = sorted(set(items))
    number = {item: k for k, item in enumerate(names)}
    long_ = [k for k, w in enumerate(words) if len(w) >= RUN]
    vocabulary = np.unique(np.concatenate([words[k] for k in long_])) if long_ else np.zeros(0, np.uint64)
    coded = [(number[items[k]], np.searchsorted(vocabulary, words[k])) for k in long_]
    runs = np.unique(np.concatenate([rolled(w, RUN) for _, w in coded])) if coded else np.zeros(0, np.uint64)
    short = {}
    for n in range(1, RUN):
        mine = [k for k, w in enumerate(words) if len(w) == n]
        if mine:
            h = np.concatenate([rolled(words[k], n) for k in mine])
            by = np.argsort(h, kind="stable")
            short[n] = (h[by], np.array([number[items[k]] for k in mine], np.int32)[by])
    least = min([len(w) for _, w in coded], default=RUN)
    return {"items": names, "vocabulary": vocabulary, "runs": runs, "short": short, "least": min(least, window), "automaton": SuffixAutomaton([(i, w.tolist()) for i, w in coded], window).arrays()}


def build_blocks(benchmark: DataFrame, window: int, block_words: int) -> list[DataFrame]:
    """For each block of the benchmark, a table of one row (block, payload), or of none if nothing was dealt to it."""
    scratch = Scratch(benchmark.sparkSession)
    words = scratch.write(item_words(benchmark, window, max(1, block_words // 8)), "words")
    total = words.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = 1 if total <= block_words else -(-2 * total // block_words)
    dealt = words.withColumn("block", F.pmod(F.xxhash64("item", F.xxhash64("words")), F.lit(blocks)).cast("int"))

    def build(table):
        import numpy as np
        import pyarrow as pa

        held = [np.asarray(w.values, np.int64).view(np.uint64) for w in table.column("words")]
        payload = pickle.dumps(block_of(table.column("item").to_pylist(), held, window), protocol=5)
        return pa.table({"block": pa.array(table.column("block").to_pylist()[:1], pa.int32()), "payload": pa.array([payload], pa.binary())})

    built = scratch.write(dealt.groupBy("block").applyInArrow(build, "block int, payload binary"), "blocks")
    return [built.where(F.col("block") == b) for b in range(blocks)]


def rolled(codes, n: int):
    """Hashes of all runs of n words."""
    import numpy as np

    keys = odd_constants(n, 21)
    size = max(0, len(codes) - n + 1)
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h += codes[k : k + size].astype(np.uint64) * keys[k]
    return mix(h)


def known(sorted_, x):
    """The place of each x in sorted_, or -1."""
    import numpy as np

    if not len(sorted_):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


class Block:
    """A block as a worker uses it."""

    def __init__(self, payload: bytes) -> None:
        held = pickle.loads(payload)
        self.items, self.vocabulary, self.runs, self.short, self.least = (held[k] for k in ("items", "vocabulary", "runs", "short", "least"))
        self.walker = Walker(held["automaton"])

    def mark(self, h, owner, hit, found: dict, longest: dict) -> None:
        """Marks hit words of texts whose words are h, each of text ``owner``; adds numbers of items and longest matches by text."""
        import numpy as np

        for n, (sorted_, number) in self.short.items():
            keys, size = odd_constants(n, 21), max(0, len(h) - n + 1)
            total = np.zeros(size, np.uint64)
            for k in range(n):
                total += h[k : k + size] * keys[k]
            total = mix(total)
            at = np.flatnonzero((known(sorted_, total) >= 0) & (owner[:size] == owner[n - 1 : n - 1 + size]))
            for k in range(n):
                hit[at + k] = True
            for d, x in np.unique(np.stack([owner[at].astype(np.uint64), total[at]], axis=1), axis=0).tolist():
                a, b = np.searchsorted(sorted_, np.array([x], np.uint64), "left")[0], np.searchsorted(sorted_, np.array([x], np.uint64), "right")[0]
                found.setdefault(int(d), set()).update(number[a:b].tolist())
                longest[int(d)] = max(longest.get(int(d), 0), n)
        codes = known(self.vocabulary, h)
        size = max(0, len(h) - RUN + 1)
        if not size:
            return
        fine = owner[:size] == owner[RUN - 1 : RUN - 1 + size]
        for k in range(RUN):
            fine &= codes[k : k + size] >= 0
        place = np.flatnonzero(fine)
        keys, total = odd_constants(RUN, 21), np.zeros(len(place), np.uint64)
        for k in range(RUN):
            total += codes[place + k].astype(np.uint64) * keys[k]
        place = place[known(self.runs, mix(total)) >= 0]
        if not len(place):
            return
        edge = np.flatnonzero((np.diff(place) != 1) | (owner[place[1:]] != owner[place[:-1]]))
        begin, end = place[np.r_[0, edge + 1]], place[np.r_[edge, len(place) - 1]] + RUN
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            if b - a >= self.least:
                d = int(owner[a])
                longest[d] = max(longest.get(d, 0), self.walker.walk(codes[a:b].tolist(), a, hit, found.setdefault(d, set())))


def scan(docs: DataFrame, benchmark: DataFrame, window: int, report, schema: T.StructType, text_at: int, block_words: int) -> DataFrame:
    """Calls report(batch, row, n_words, hit, items, longest, first bytes, end bytes, bytes, start, end) for each row."""
    spark = docs.sparkSession
    scratch, fields, width = Scratch(spark), docs.schema.fields, len(docs.columns)
    blocks = build_blocks(benchmark, window, block_words)
    for p, block in enumerate(blocks):
        rows = block.collect()  # one row, or none of an empty benchmark
        shared, last, carried = spark.sparkContext.broadcast(rows[0]["payload"] if rows else pickle.dumps(block_of([], [], window))), p == len(blocks) - 1, p > 0
        out = schema if last else T.StructType([*fields, *T.StructType.fromDDL(CARRY).fields])
        docs = docs.mapInArrow(one_pass(shared, uuid.uuid4().hex, text_at, width, carried, report if last else carry, to_arrow(out)), out)
        if not last:
            docs = scratch.write(docs, f"pass-{p}")
            shared.destroy()
            scratch.drop(f"pass-{p - 1}")
    return docs


def carry(batch, row, n_words, hit, items, longest, first, last, raw, low, high):
    import numpy as np

    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return None, [{"a": a, "b": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)], sorted(items), longest


def one_pass(shared, uid: str, text_at: int, width: int, carried: bool, report, schema):
    """Marks what one block's items hit, beside what earlier passes have marked."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = once("suffix-automaton", dict)
        if held.get("uid") != uid:
            held.clear()
            held.update(uid=uid, block=Block(shared.value))
        block, hasher = held["block"], WordHasher("alnum")
        for batch in batches:
            rows = []
            raw, starts, ends = text_buffer(batch.column(text_at))
            for i, j in chunks(starts, ends):
                h, first, last, count = hasher(raw, starts[i:j], ends[i:j])
                at, hit, found, longest = np.r_[0, np.cumsum(count)], np.zeros(len(h), bool), {}, {}
                block.mark(h, np.repeat(np.arange(j - i), count), hit, found, longest)
                for d in range(j - i):
                    a, b = int(at[d]), int(at[d + 1])
                    items, most = {block.items[k] for k in found.get(d, ())}, longest.get(d, 0)
                    if carried:
                        for x in batch.column(width)[i + d].as_py():
                            hit[a + x["a"] : a + x["b"]] = True
                        items |= set(batch.column(width + 1)[i + d].as_py())
                        most = max(most, batch.column(width + 2)[i + d].as_py())
                    rows.append(report(batch, i + d, b - a, hit[a:b], items, most, first[a:b], last[a:b], raw, int(starts[i + d]), int(ends[i + d])))
            if report is carry:
                made = [pa.array([r[k] for r in rows], schema.field(width + k - 1).type) for k in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], schema=schema)
            else:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)
            release()

    return run


def to_arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def hit_spans(hit, first, last, low: int) -> list[tuple[int, int]]:
    """Byte spans of runs of hit words."""
    import numpy as np

    if not hit.any():
        return []
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return [(int(first[a]) - low, int(last[b - 1]) - low) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs(doc_id, text): counts, matched items, longest match, hit spans (code points)."""
    schema = T.StructType.fromDDL("doc_id long, " + REPORT)

    def report(batch, row, n_words, hit, items, longest, first, last, raw, low, high):
        n_hit = int(hit.sum())
        spans, at, point = [], 0, 0
        for a, b in hit_spans(hit, first, last, low):
            start = point + len(raw[low + at : low + a].tobytes().decode("utf-8", "replace"))
            at, point = b, start + len(raw[low + a : low + b].tobytes().decode("utf-8", "replace"))
            spans.append({"start": start, "end": point})
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        return batch.column(0)[row].as_py(), n_words, n_hit, len(items), digest, longest, n_hit / n_words if n_words else 0.0, spans

    return scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, window, report, schema, 1, block_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_coverage: float = 0.05, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the spans that match test items; documents with a coverage of ``max_coverage`` or more go.

    All columns are kept; ``n_chars``, if there is one, is counted anew for changed texts.
    """
    columns, text_at = docs.columns, docs.columns.index("text")
    names = [f"c{k}" for k in range(len(columns))]  # whatever the columns are called
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)]
    schema = T.StructType([*fields, T.StructField("contaminated", T.BooleanType())])

    def report(batch, row, n_words, hit, items, longest, first, last, raw, low, high):
        values = [batch.column(k)[row].as_py() for k in range(len(columns))]
        n_hit = int(hit.sum())
        if n_hit and n_hit < max_coverage * n_words:
            body, parts, at = raw[low:high].tobytes(), [], 0
            for a, b in hit_spans(hit, first, last, low):
                parts.append(body[at:a])
                at = b
            values[text_at] = b"".join([*parts, body[at:]]).decode("utf-8")
            if "n_chars" in columns:
                values[columns.index("n_chars")] = len(values[text_at])
        return (*values, bool(n_hit and n_hit >= max_coverage * n_words))

    out = scan(docs.toDF(*names), benchmark, window, report, schema, text_at, block_words)
    return out.where("not contaminated").drop("contaminated").toDF(*columns)
