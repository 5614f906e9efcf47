"""Sampled segmentations without replacement from the pieces of a public SentencePiece model.

The vocabulary is read, never trained. A piece of rank r has the weight (r + 2)^-alpha, so a text's
segmentations form a lattice with the distribution P(s) = prod(weights) / Z. Gumbel top-k draws k
distinct segmentations: a best-first (A*) search over sets of segmentations that share a prefix and
exclude some next pieces. The perturbed log-probability of a set, the maximum over its members, is
drawn top-down, truncated by its parent's, so the bound is exact and sets leave the heap in order of
their best member. Draws are hashes of (row key, sample, place), so results depend on the row only.

A unit is a word with the space before it; a run of two spaces or more and the word after it are one unit,
as pieces of several spaces exist. No piece crosses from one unit into the next (spaces stand only at the
start of a piece), so the lattice of a text is a chain of unit lattices; units are solved once for each block
of texts. Characters outside the vocabulary are bytes.

Memory is bounded by BLOCK_CHARS of text (or one text) for the lattices, which are solved SOLVE_NODES nodes at
a time, and by SAMPLE_CHARS of text (or one text) for the drawn segmentations. Units of over LONG code points,
as in texts without spaces, are solved and sampled node by node in linear time instead of step by step.

Defined results: null text has no samples; empty text has one sample, the empty segmentation; a text
with fewer than k segmentations gets all of them, each with inclusion score 1; very long texts are read
whole; repeated rows (equal text and key) get equal samples; a null key counts as 0; an empty table gives an
empty table; columns of any name are kept, but ``samples`` and ``roundtrip`` are replaced. Decoding any sample
gives the text back, whatever it holds (a literal U+2581 is written as bytes).
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, odd_constants, once, release, text_buffer

BLOCK_CHARS, SAMPLE_CHARS, SOLVE_NODES, LONG = 3 << 19, 1 << 18, 1 << 18, 4096
MARK = 0x2581
SAMPLES = "array<struct<ids:array<int>,log_prob:double,perturbed:double,inclusion:double>>"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def stir(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The rolling hash of a run of code points, one longer."""
    h = h * np.uint64(0x9E6C63D0876A3F35) + code
    h += np.uint64(1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


class Vocabulary:
    """Pieces by rolling hash of their code points; prefixes for pruning."""

    def __init__(self, model_file: str, alpha: float) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = np.zeros(256, np.int32)
        self.out: list[bytes] = [b""] * n
        keep = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.bytes[int(p[1:-1], 16)] = i
                self.out[i] = bytes([int(p[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.out[i] = p.replace(chr(MARK), " ").encode()
                if chr(MARK) not in p.lstrip(chr(MARK)):
                    keep.append(i)
        self.longest = max(len(pieces[i]) for i in keep)
        codes = [np.array([ord(c) for c in pieces[i]], np.uint64) for i in keep]
        rank = {i: r for r, i in enumerate(sorted(keep, key=lambda i: (-sp.get_score(i), i)))}
        self.byte_weight = -alpha * np.log(len(keep) + 2.0)
        size = np.array([len(c) for c in codes])
        padded = np.zeros((len(codes), self.longest), np.uint64)
        for r, c in enumerate(codes):
            padded[r, : len(c)] = c
        whole, h = {}, np.zeros(len(codes), np.uint64)
        for k in range(self.longest):
            h = stir(h, padded[:, k])
            for x, i in zip(h[size > k].tolist(), np.where(size == k + 1, keep, -1)[size > k].tolist(), strict=True):
                if i >= 0 or x not in whole:
                    whole[x] = i
        # prefixes: hash, whole piece (or -1) and its weight, found through a table of the top bits
        self.hash = np.fromiter(whole, np.uint64, len(whole))
        self.ids = np.fromiter(whole.values(), np.int32, len(whole))
        self.weight = np.array([-alpha * np.log(rank[i] + 2.0) if i >= 0 else 0.0 for i in whole.values()])
        top = (self.hash >> np.uint64(43)).astype(np.int64)
        self.place = np.full(1 << 21, -1, np.int32)
        self.place[top] = np.arange(len(top))
        lost = np.flatnonzero(self.place[top] != np.arange(len(top)))
        self.late = lost[np.argsort(self.hash[lost])]
        self.shared = np.zeros(1 << 21, bool)
        self.shared[top[lost]] = True
        self.single = np.unique(np.array([int(c[0]) for c in codes if len(c) == 1], np.uint64))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the prefixes, or -1."""
        top = (h >> np.uint64(43)).astype(np.int64)
        k = self.place[top].astype(np.int64)
        k[self.hash[k] != h] = -1
        again = np.flatnonzero((k < 0) & self.shared[top])
        if len(again):
            at = member(self.hash[self.late], h[again])
            k[again] = np.where(at >= 0, self.late[at], -1)
        return k


def member(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


def solve(vocabulary: Vocabulary, code: np.ndarray, size: np.ndarray) -> list:
    """Of units of the given sizes (with their first mark): options of each node, and their ends, pieces and log-probabilities."""
    root = np.r_[0, np.cumsum(size + 1)][:-1]
    nodes = int((size + 1).sum())
    end = np.repeat(root + size, size + 1)
    cp = np.zeros(nodes, np.uint64)
    inner = np.ones(nodes, bool)
    inner[root] = inner[root + size] = False
    code = code.astype(np.uint64)
    cp[inner] = np.where(code == MARK, np.uint64(MARK + 0x110000), np.where(code == 0x20, np.uint64(MARK), code))
    cp[root[size > 0]] = MARK
    left = end - np.arange(nodes)
    place, h, found = np.flatnonzero(left > 0), np.zeros(nodes, np.uint64), []
    for length in range(1, vocabulary.longest + 1):
        place = place[left[place] >= length]
        h[place] = stir(h[place], cp[place + length - 1])
        k = vocabulary.find(h[place])
        place, k = place[k >= 0], k[k >= 0]
        if not len(place):
            break
        whole = vocabulary.ids[k] >= 0
        found.append((place[whole], length, k[whole]))
    bare = np.flatnonzero((left > 0) & (member(vocabulary.single, cp) < 0))
    count = np.zeros(nodes, np.int64)
    for at, _, _ in found:
        count[at] += 1
    count[bare] += 1
    first = np.r_[0, np.cumsum(count)]
    total = int(first[-1])
    to, piece, score = np.zeros(total, np.int32), np.zeros(total, np.int32), np.zeros(total)
    fill = first[:-1].copy()
    for at, length, k in reversed(found):  # the longest first: it is the likeliest
        o = fill[at]
        to[o], piece[o], score[o] = at + length, vocabulary.ids[k], vocabulary.weight[k]
        fill[at] += 1
    o = fill[bare]
    point = np.where(cp[bare] >= 0x110000, cp[bare] - np.uint64(0x110000), cp[bare])
    width = 1 + (point >= 0x80) + (point >= 0x800).astype(int) + (point >= 0x10000)
    to[o], score[o] = bare + 1, vocabulary.byte_weight * width
    piece[o] = np.where(width == 1, vocabulary.bytes[np.minimum(point, 255).astype(np.int64)], -1 - point.astype(np.int64))
    # log-sums of completions, from the ends of all units at once; long units on their own
    beta, owner = np.zeros(nodes), np.repeat(size, size + 1)
    short = owner <= LONG
    most = int(left[short].max(initial=0))
    by = np.argsort(np.where(short, left, most + 1).astype(np.uint16), kind="stable")
    cut = np.searchsorted(left[by[: int(short.sum())]], np.arange(1, most + 2))
    for d in range(len(cut) - 1):
        v = by[cut[d] : cut[d + 1]]
        if not len(v):
            continue
        n = count[v]
        heads = np.r_[0, np.cumsum(n)[:-1]]
        o = np.arange(int(n.sum())) + np.repeat(first[v] - heads, n)
        x = score[o] + beta[to[o]]
        top = np.maximum.reduceat(x, heads)
        beta[v] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, n)), heads))
    for k in np.flatnonzero(size > LONG).tolist():
        sums_of_long(int(root[k]), int(root[k] + size[k]), first, to, score, beta)
    score += beta[to]
    score -= np.repeat(beta, count)
    return [count, to, piece, score]


def sums_of_long(begin: int, end: int, first: np.ndarray, to: np.ndarray, score: np.ndarray, beta: np.ndarray, step: int = 1 << 14) -> None:
    """Fills beta of one long unit, from its end, a stretch of nodes at a time."""
    from math import exp, log

    known = {end: 0.0}  # of the nodes that the next ones lead to
    for a in range(begin + (end - 1 - begin) // step * step, begin - 1, -step):
        b = min(a + step, end)
        heads = first[a : b + 1].tolist()
        low = heads[0]
        ends, weights = to[low : heads[-1]].tolist(), score[low : heads[-1]].tolist()
        for v in range(b - 1, a - 1, -1):
            x = [weights[o] + known[ends[o]] for o in range(heads[v - a] - low, heads[v - a + 1] - low)]
            top = max(x)
            known[v] = top + log(sum([exp(y - top) for y in x]))
        beta[a:b] = [known[v] for v in range(a, b)]
        known = {v: known[v] for v in range(a, min(a + 64, end) + (a + 64 >= end))}


class Lattices:
    """Lattices of distinct units: for each place of each unit the possible next pieces.

    Options of node v are option[first[v]:first[v + 1]]: end node, piece (or -1 - code point), probability.
    """

    def __init__(self, vocabulary: Vocabulary, units, size: np.ndarray) -> None:
        """units: an Arrow array of strings (without their first space); size: their code points."""
        raw, starts, ends = text_buffer(units)
        size = size + 1  # with the space mark
        self.root = np.r_[0, np.cumsum(size + 1)]  # each unit has an end node
        parts, i, nodes = [], 0, 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(self.root, self.root[i] + SOLVE_NODES, side="right")) - 1)
            text = raw[starts[i] : ends[j - 1]].tobytes().decode()
            parts.append(solve(vocabulary, np.frombuffer(text.encode("utf-32-le"), np.uint32), size[i:j]))
            parts[-1][1] += np.int32(nodes)
            i, nodes = j, nodes + len(parts[-1][0])
        parts = parts or [solve(vocabulary, np.zeros(0, np.uint32), size)]
        count, self.to, self.piece, self.log = (np.concatenate([p[k] for p in parts]) for k in range(4))
        self.root, self.over = self.root[:-1], count == 0
        self.first = np.r_[0, np.cumsum(count)].astype(np.int32)
        self.prob = np.exp(self.log)
        self.alone = np.repeat(count == 1, count)  # options without another at their node
        self.end = self.root + size

    def span(self, option: int) -> tuple[int, int]:
        """The options of an option's node."""
        v = int(np.searchsorted(self.first, option, side="right")) - 1
        return int(self.first[v]), int(self.first[v + 1])

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An option of each node, by its probability."""
        o, last = self.first[node], self.first[node + 1] - 1
        u = u - self.prob[o]
        go = np.flatnonzero((u >= 0) & (o < last))
        while len(go):
            o[go] += 1
            u[go] -= self.prob[o[go]]
            go = go[(u[go] >= 0) & (o[go] < last[go])]
        return o

    def paths(self, node: np.ndarray, seed: np.ndarray, end: np.ndarray):
        """Samples a completion of each node up to its unit's end; (owner, option) of all steps, in order of owner and step."""
        steps, count = [], np.zeros(len(node), np.int64)
        far = end - node > LONG
        live = np.flatnonzero(~self.over[node] & ~far)
        at, turn = node[live], 0
        while len(live):
            turn += 1
            u = (mix(seed[live] + np.uint64(turn)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            o = self.choose(at, u)
            count[live] += 1
            steps.append((live, o.astype(np.int32)))
            at = self.to[o]
            go = ~self.over[at]
            live, at = live[go], at[go]
        walks = {}
        for k in np.flatnonzero(far).tolist():
            walks[k] = self.walk(int(node[k]), int(end[k]), seed[k])
            count[k] = len(walks[k])
        begin = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        for k, (live, o) in enumerate(steps):
            out[begin[live] + k] = o
        for k, walk in walks.items():
            out[begin[k] : begin[k] + count[k]] = walk
        return np.repeat(np.arange(len(node)), count), out

    def walk(self, node: int, end: int, seed: np.uint64, step: int = 1 << 14) -> np.ndarray:
        """A completion within a long unit: each node has a draw of its own, so what a path does not meet costs no step."""
        met, at = [], node
        for a in range(node, end, step):
            v = np.arange(a, min(a + step, end))
            u = (mix(seed + (v - end).astype(np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            o = self.choose(v, u)
            to, stop, mine = self.to[o].tolist(), int(v[-1]), []
            while at <= stop:
                mine.append(at - a)
                at = to[at - a]
            met.append(o[mine].astype(np.int32))
        return np.concatenate(met)


def uniform(x: np.ndarray) -> np.ndarray:
    """Of (0, 1)."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


#: Race times are above exp(-LOWEST), whatever the draw; places within REACH nats hold the winners but for rare draws.
LOWEST, REACH = 37.5, 44.0


def races(lattice: Lattices, options: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Log race times, -log(u) / mass, of the sets that leave a segmentation at an option, given what precedes it."""
    left = 1.0 - lattice.prob[options]
    left[lattice.alone[options] | (left < 1e-13)] = 0.0
    with np.errstate(divide="ignore"):
        return draws(salt) - np.log(left)


def draws(salt: np.ndarray) -> np.ndarray:
    """Logs of exponential variables."""
    return np.log(np.maximum(-np.log(uniform(salt)), 2.0**-54))


def sample_texts(lattice: Lattices, texts: list, keys: np.ndarray, k: int) -> list:
    """For each text, the k best perturbed segmentations and the next bound.

    texts: the word numbers of each text. A segmentation is (options, log_prob, perturbed, words' places);
    a heap entry is (-perturbed, tie, parent, place of the first new option, options excluded there). Every
    text pops its best set in each round; the new segmentations of all texts are drawn together. A Gumbel
    variable with location phi that is at most g is -log(exp(-g) + E exp(-phi)), E standard exponential.
    """
    salts, step = odd_constants(4, 41), np.uint64(0xD1342543DE82EF95)
    numbers = odd_constants(k, 43)
    base = mix(keys)
    root = -np.log(-np.log(uniform(base ^ salts[0])))
    heaps = [[(-float(g), 0, -1, 0, ())] for g in root]
    out: list[list] = [[] for _ in texts]
    none = np.zeros(0, np.int64)
    for round_ in range(k):
        live = [d for d in range(len(texts)) if heaps[d]]
        if not live:
            break
        salt = mix(base + numbers[round_])
        turn = uniform(salt ^ salts[2])
        begun, nodes, tails = [], [], []
        for d in live:
            g, _, parent, place, excluded = heapq.heappop(heaps[d])
            words = texts[d]
            if parent < 0:
                head, old, at, option = none, none, 0, none
            else:
                options, _, _, slot = out[d][parent]
                head, old, at = options[:place], slot[:place], int(slot[place])
                a, b = lattice.span(options[place])
                p = lattice.prob[a:b].copy()
                p[[e - a for e in excluded]] = 0
                c = np.cumsum(p)
                option = np.array([a + min(int(np.searchsorted(c, turn[d] * c[-1], side="right")), int(np.flatnonzero(p)[-1]))])
            ahead = lattice.root[words[at:]]
            if len(option):
                ahead[0] = lattice.to[option[0]]
            begun.append((d, -g, place, excluded, head, old, at, option, len(ahead)))
            nodes.append(ahead)
            tails.append(lattice.end[words[at:]])
        count = np.array([b[8] for b in begun])
        sizes = np.r_[0, np.cumsum(count)]
        words_at = np.arange(sizes[-1]) + np.repeat(np.array([b[6] for b in begun]) + 1 - sizes[:-1], count)
        who, tail = lattice.paths(np.concatenate(nodes), mix(np.repeat(salt[live], count) + words_at.astype(np.uint64) * step), np.concatenate(tails))
        cut = np.searchsorted(who, sizes)
        made = []
        for (d, g, place, excluded, head, old, at, option, _), base_at, a, b in zip(begun, sizes[:-1], cut[:-1], cut[1:], strict=True):
            made.append((d, g, place, excluded, len(head), np.concatenate([head, option, tail[a:b]]).astype(np.int32), np.concatenate([old, np.full(len(option), at), who[a:b] - base_at + at]).astype(np.int32)))
        logp = lattice.log[np.concatenate([m[5] for m in made])]
        # masses fall along a segmentation, so a place cannot win once -total exceeds the k-th best time by LOWEST
        totals, windows, end = [], [], 0
        for _, _, place, _, _, options, _ in made:
            total = np.zeros(len(options) + 1)
            np.cumsum(logp[end : end + len(options)], out=total[1:])  # of this text alone: results must not depend on its block
            end += len(options)
            totals.append(total)
            windows.append(place + int(np.searchsorted(-total[place:-1], REACH - total[place], side="right")))
        wide = np.array([stop - m[2] for m, stop in zip(made, windows, strict=True)])
        starts = np.cumsum(wide) - wide
        within = np.arange(int(wide.sum())) + np.repeat(np.array([m[2] for m in made]) + 1 - starts, wide)
        first = draws(salt[live] + salts[3] * np.array([m[2] + 1 for m in made], np.uint64)).tolist()
        near = races(lattice, np.concatenate([m[5][m[2] : stop] for m, stop in zip(made, windows, strict=True)]), np.repeat(salt[live], wide) + salts[3] * within.astype(np.uint64))
        for (d, g, place, excluded, _, options, slot), total, stop, start, draw in zip(made, totals, windows, starts.tolist(), first, strict=True):
            number = len(out[d])
            out[d].append((options, float(total[-1]), g, slot))
            # the rest of the popped set, cut by the first place where a member leaves this segmentation
            want = k - number
            race = near[start : start + stop - place]
            for last in (stop, len(options)):
                if last > stop:  # the window does not decide
                    race = races(lattice, options[place:], salt[d : d + 1] + salts[3] * np.arange(place + 1, last + 1, dtype=np.uint64))
                race = race - total[place:last]
                if excluded and len(race):
                    a, b = lattice.span(options[place])
                    held = sum(float(lattice.prob[o]) for o in range(a, b) if o not in excluded and o != options[place])
                    race[0] = draw - np.log(held) - total[place] if held > 1e-13 else np.inf
                if last == len(options) or (len(race) >= want and np.partition(race, want - 1)[want - 1] + LOWEST <= -total[last]):
                    break
            if not len(race):
                continue
            best = np.argpartition(race, want - 1)[:want] if len(race) > want else np.arange(len(race))
            for q in best.tolist():
                if race[q] < np.inf:
                    bound = -float(np.logaddexp(-g, race[q]))
                    heapq.heappush(heaps[d], (-bound, place + q, number, place + q, (*(excluded if q == 0 else ()), int(options[place + q]))))
    return [(found, -heap[0][0] if heap else -np.inf) for found, heap in zip(out, heaps, strict=True)]


def to_ids(vocabulary: Vocabulary, lattice: Lattices, options: np.ndarray) -> np.ndarray:
    pieces = lattice.piece[options]
    wide = np.flatnonzero(pieces < 0)
    if not len(wide):
        return pieces.astype(np.int32)
    parts, at = [], 0
    for k in wide.tolist():
        parts += [pieces[at:k], vocabulary.bytes[list(chr(-1 - int(pieces[k])).encode())]]
        at = k + 1
    return np.concatenate([*parts, pieces[at:]]).astype(np.int32)


def units_of(texts, size: np.ndarray):
    """The units of an Arrow array of texts, without their first space, dictionary-encoded, and their number in each text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.split_pattern(texts, " ")
    counts = np.where(size == 0, 0, np.asarray(pc.fill_null(pc.list_value_length(split), 0), np.int64))
    words = split.filter(pa.array(size > 0)).flatten()
    blank = np.asarray(pc.equal(pc.binary_length(words), 0))
    last = np.zeros(len(words), bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    ends = ~blank | last  # an empty word is a space that joins the next word of its text
    if not ends.all():
        at = np.flatnonzero(ends)
        spaces = np.diff(np.r_[-1, at]) - 1
        words = words.take(pa.array(at))
        wide = spaces > 0
        led = pc.binary_join_element_wise(pc.binary_repeat(pa.array([" "] * int(wide.sum())), pa.array(spaces[wide])), words.filter(pa.array(wide)), "")
        words = pc.replace_with_mask(words, pa.array(wide), led)
        owner = np.repeat(np.arange(len(size)), counts)[at]
        counts = np.bincount(owner, minlength=len(size))
    return words.dictionary_encode(), counts


def encode_batch(vocabulary: Vocabulary, column, keys: np.ndarray, samples: int, verify: bool):
    """(first row, end row, arrays of samples and, with ``verify``, roundtrip) for stretches of an Arrow string column."""
    import pyarrow as pa
    import pyarrow.compute as pc

    long_ = np.where(np.asarray(pc.is_null(column)), 0, np.asarray(pc.fill_null(pc.utf8_length(column), 0)))
    total = np.r_[0, np.cumsum(long_)]

    def stretches(i, n, limit):
        while i < n:
            j = max(i + 1, int(np.searchsorted(total, total[i] + limit, side="right")) - 1)
            yield i, min(j, n)
            i = min(j, n)

    for i, j in stretches(0, len(column), BLOCK_CHARS):
        units, counts = units_of(column.slice(i, j - i), long_[i:j])
        numbers, at = np.asarray(units.indices, np.int32), np.r_[0, np.cumsum(counts)]
        lattice = Lattices(vocabulary, units.dictionary, np.asarray(pc.utf8_length(units.dictionary), np.int64))
        for a, b in stretches(i, j, SAMPLE_CHARS):
            part = column.slice(a, b - a)
            drawn = sample_texts(lattice, [numbers[at[d - i] : at[d - i + 1]] for d in range(a, b)], keys[a:b].view(np.uint64), samples)
            ids, logp, pert, incl, per = [], [], [], [], [0]
            for (found, bound), gone in zip(drawn, pc.is_null(part).to_pylist(), strict=True):
                for options, log_prob, g, _ in [] if gone else found:
                    ids.append(to_ids(vocabulary, lattice, options))
                    logp.append(log_prob)
                    pert.append(g)
                    incl.append(1.0 if bound == -np.inf else float(-np.expm1(-np.exp(min(700.0, log_prob - bound)))))
                per.append(len(ids))
            del drawn
            flat, cut = np.concatenate(ids) if ids else np.zeros(0, np.int32), np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.ListArray.from_arrays(cut, flat), pa.array(logp, pa.float64()), pa.array(pert, pa.float64()), pa.array(incl, pa.float64())], ["ids", "log_prob", "perturbed", "inclusion"])
            arrays = [pa.ListArray.from_arrays(np.array(per, np.int32), structs)]
            if verify:
                arrays.append(pa.array(round_trips(vocabulary, flat, cut, per, part), pa.bool_()))
            yield a, b, arrays
        del lattice
        release()


def encode_samples(docs: DataFrame, key: Column, samples: int = 3, alpha: float = 1.0, model_file: str | None = None, verify: bool = False) -> DataFrame:
    """docs with ``samples``: k distinct sampled segmentations of each text, most perturbed first.

    inclusion is P(the segmentation is among the drawn) given the (k+1)-th perturbed log-probability,
    1 - exp(-exp(log_prob - threshold)); dividing by it gives unbiased sums over segmentations.
    ``key`` (a long) seeds each row. With ``verify``, ``roundtrip`` says whether all samples decode to the text.
    """
    columns = [c for c in docs.columns if c not in ("samples", "roundtrip")]
    text_at, names = columns.index("text"), [f"c{k}" for k in range(len(columns))]
    fields = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, columns, strict=True)]
    extra = T.StructType.fromDDL(f"samples {SAMPLES}" + ", roundtrip boolean" * verify)
    path = model_file or default_model()
    keyed = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, columns, strict=True)], F.coalesce(key.cast("long"), F.lit(0).cast("long")).alias("key"))

    def run(batches):
        import pyarrow as pa

        vocabulary = once((path, alpha), lambda: Vocabulary(path, alpha))
        for batch in batches:
            keys = np.asarray(batch.column(len(names)), np.int64)
            for a, b, arrays in encode_batch(vocabulary, batch.column(text_at), keys, samples, verify):
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[: len(names)]] + arrays, [*names, *extra.names])

    return keyed.mapInArrow(run, T.StructType([*fields, *extra.fields])).toDF(*columns, *extra.names)


def round_trips(vocabulary: Vocabulary, flat: np.ndarray, cut: np.ndarray, per: list[int], texts) -> list[bool]:
    """Whether all samples of each text decode to it, byte for byte."""
    import pyarrow as pa

    raw, starts, ends = text_buffer(texts)
    pieces = pa.array(vocabulary.out, pa.binary()).take(pa.array(flat))
    off = np.frombuffer(pieces.buffers()[1], np.int32)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
    data, out = memoryview(pieces.buffers()[2].to_pybytes() if pieces.buffers()[2] else b""), []
    for d in range(len(texts)):
        text = raw[starts[d] : ends[d]].tobytes()
        out.append(all(bytes(data[off[cut[k]] + 1 : off[cut[k + 1]]]) == text if cut[k + 1] > cut[k] else not text for k in range(per[d], per[d + 1])))
    return out


def decode(out: list[bytes], ids: list[int]) -> str:
    """The text of piece ids; the space mark that encoding adds in front is taken off."""
    return b"".join([out[i] for i in ids])[1:].decode("utf-8", "replace")


def decode_ids(df: DataFrame, ids: str = "ids", into: str = "text", model_file: str | None = None) -> DataFrame:
    """df with the decoded text of an array of piece ids (null ids: null)."""
    path = model_file or default_model()

    @F.pandas_udf("string")
    def run(column):
        table = once((path, 1.0), lambda: Vocabulary(path, 1.0)).out
        return column.map(lambda x: None if x is None else decode(table, list(x)))

    return df.withColumn(into, run(F.col(ids)))
