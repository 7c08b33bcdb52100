"""Subword sampling without replacement: Gumbel top-k over the segmentation lattice of a text.

The lattice has an edge for each vocabulary piece that fits at a place; its weight is the piece's share in the corpus, counted from the
tokenizer's own encoding of all texts. Backward sums over the lattice give each place's edge probabilities. Where no piece of
the vocabulary goes on into a word's leading blanks, past a line end, or from a letter to another character, a text's lattice parts
there into a chain of small ones, one for each unit; each of this is looked up in the vocabulary, and it parts no further. A worker keeps
the lattices of units that it has met, up to `KEPT_PLACES`; they are pure values, so this has no effect on results.

The search is best-first over the tree of segmentation prefixes. The root gets a Gumbel value; a node's value is the greatest of its
children's, so a sample inherits it down its path. All that leaves a sample's path at any step, by edges not taken before, is one opening:
its value is a truncated Gumbel value of its summed mass, and if it is the greatest of all openings, the step at which the next sample
leaves the path is drawn in proportion to the steps' masses, and the edge in proportion to the edges' (the greatest of independent Gumbel
values and its place are independent). The next sample goes on anew from there and is an opening of its own; the opening it came from
goes without it, below its value. So samples come in falling order of perturbed log probability, all distinct, which is sampling without
replacement. The value that would come next is the threshold of the inclusion scores, kept as logarithms.

All draws are hashes of seed, row key, sample and place, so a row's samples depend neither on its partition nor on other rows' keys.
Nothing is cut: backward sums run over whole units, rescaled on the way; masses are sums of the edges not taken, in logarithms, and each
opening is weighed against the heaviest step that is left in it, however unlikely that is.

Defined cases: null and empty texts have one sample, of no pieces; a text with fewer segmentations than k has all of them, and inclusion 1;
characters outside the vocabulary are their UTF-8 byte pieces; a text with the blank mark itself decodes to blanks (round_trip false, as
with the tokenizer); equal rows get equal samples; null ids draw as id 0; no rows give none; other columns are not read. Ids take two
bytes each, four in vocabularies of over 65 536 pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafmill.llm import common
from sheafmill.llm.op4_token_store import pieces
from sheafmill.llm.shingles import BASE, UNBASE, mix

SAMPLES, SEED = 2, 20240101
LONGEST_PIECE = 16
SLICE_BYTES = 1 << 20
#: Places of units (characters) whose edges a worker keeps, about 110 bytes each; of more, those used most often stay.
KEPT_PLACES = 2_400_000
#: Units laid out at once: few, so that what is made on the way stays in the cache.
LAID_AT_ONCE = 512
#: Sums over a slice of texts differ in their last bits with what else is in it.
DIGITS = 9
REMEMBERED = 300_000
#: Brings products of piece shares along a unit into the range of doubles; it cancels out of all probabilities.
SCALE = 30.0

_vocabularies: dict[str, Vocabulary] = {}
_kept: dict[str, tuple[np.ndarray, Net]] = {}

SAMPLED = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, round_trip boolean, ids binary"


class Vocabulary:
    """Pieces by a hash of their characters, and their bytes for decoding."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, n = self.model, self.model.get_piece_size()
        self.size = n
        self.normal = np.array([not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in range(n)])
        self.byte_ids = np.zeros(256, np.int32)
        strings = []
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                strings.append(bytes([int(piece[3:5], 16)]))
            else:
                strings.append(piece.replace("▁", " ").encode() if self.normal[i] else b"")
        self.widths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.widths) - self.widths
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        spoken = [x for x, ok in zip(strings, self.normal, strict=True) if ok]
        #: Whether no piece goes on into another unit: past a blank or a line end, or from a letter to another character.
        self.by_unit = not any(unit_starts(np.frombuffer(x, np.uint8), False).any() for x in spoken)
        self.by_kind = self.by_unit and not any(unit_starts(np.frombuffer(x, np.uint8), True).any() for x in spoken)
        normal = {m.id_to_piece(int(i)): int(i) for i in np.nonzero(self.normal)[0]}
        begun = dict.fromkeys((x[:k] for x in normal for k in range(1, len(x))), -1) | normal  # all openings of pieces; -1 for one that is none itself
        self.lengths = np.array([len(m.id_to_piece(i)) if self.normal[i] else 0 for i in range(n)])
        if self.lengths.max() > LONGEST_PIECE:
            raise ValueError(f"the vocabulary has pieces of over {LONGEST_PIECE} characters")
        self.bits = 18
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        left, ids = string_hashes(list(begun)), np.array(list(begun.values()), np.int32)
        while len(left):  # what finds its slot taken goes to the next layer
            slots = (left >> np.uint64(64 - self.bits)).astype(np.int64)
            _, first = np.unique(slots, return_index=True)
            held, named = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -3, np.int32)
            held[slots[first]], named[slots[first]] = left[first], ids[first]
            self.layers.append((held, named))
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, ids = left[rest], ids[rest]

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """Edge weights by piece from piece counts, scaled by length; then of a character of bytes, and of no piece."""
        share = np.where(self.normal, counts + 0.5, 0.0)
        return np.append(share / share.sum() * SCALE**self.lengths, [1.0, 0.0])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The pieces of these hashes; -1 where longer pieces begin so, and -3 where none does."""
        slots = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        held, named = self.layers[0]
        there = held[slots]
        out = np.where(there == keys, named[slots], np.int32(-3))
        left = np.nonzero((out == -3) & (there != 0))[0]
        for held, named in self.layers[1:]:
            hit = left[held[slots[left]] == keys[left]]
            out[hit] = named[slots[hit]]
        return out

    def letters(self, ids: np.ndarray) -> bytes:
        """The bytes of some ids, by table lookup."""
        widths = self.widths[ids]
        ends = np.cumsum(widths)
        return self.bytes[np.repeat(self.starts[ids] - ends + widths, widths) + np.arange(ends[-1] if len(ids) else 0)].tobytes()


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]))


def string_hashes(strings: list[str]) -> np.ndarray:
    """Polynomial hashes of code points, mixed with the length."""
    lengths = np.array([len(x) for x in strings], np.int64)
    points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(points)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(points * powers(int(lengths.max()))[place], starts) + lengths.astype(np.uint64))


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def piece_counts(docs: DataFrame, path: str) -> np.ndarray:
    """How often each piece occurs in the tokenizer's encoding of all whole texts. No piece goes on past a unit, so a text's encoding is that of its units, runs of blanks
    and line ends among them, one after the other: each different unit is encoded once. A task emits one row a piece."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        total = np.zeros(vocab.size, np.int64)
        known: dict[bytes, int] = {}
        before = len(vocab.model.encode("\n"))  # a line end in front keeps the tokenizer's own blank away from a unit

        def settle() -> None:
            units = list(known)
            for begin in range(0, len(units), 20_000):
                some = units[begin : begin + 20_000]
                for ids, n in zip(vocab.model.encode(["\n" + u.decode() for u in some]), (known[u] for u in some), strict=True):
                    for i in ids[before:]:
                        total[i] += n
            known.clear()

        for batch in batches:
            for part in pieces(batch["text"], SLICE_BYTES):
                places, units, _ = units_of(batch["text"].slice(part.start, part.stop - part.start), vocab)
                for unit, n in zip(units, np.bincount(places, minlength=len(units)).tolist(), strict=True):
                    known[unit] = known.get(unit, 0) + n
                if len(known) > REMEMBERED:
                    settle()
        settle()
        kept = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), pa.array(total[kept])], names=["id", "n"])

    rows = docs.select("text").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(vocabulary(path).size, np.int64)
    for row in rows:
        out[row["id"]] = row["n"]
    return out


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            wider = np.zeros(max(5 * len(self.held) // 4, self.n + len(more)), self.held.dtype)
            wider[: self.n] = self.held[: self.n]
            self.held = wider
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)

    def keep(self, at: np.ndarray) -> None:
        self.held[: len(at)] = self.held[at]
        self.n = len(at)


class Net:
    """Lattices of units. Unit u's places are `starts[u]` to `ends[u]` of the places; a place's edges, the longest first, stand from
    `first` on: piece (-2 is a character of bytes), length (negative for a place's last edge), probability, and that of all other
    edges together."""

    def __init__(self, vocab: Vocabulary, weights: np.ndarray):
        self.vocab, self.weights = vocab, weights
        self.number: dict[bytes, int] = {}
        self.by_unit = self.starts, self.ends, self.used = Grown(np.int64), Grown(np.int64), Grown(np.int64)
        self.by_place = self.points, self.n_edges, self.first = Grown(np.uint32), Grown(np.int8), Grown(np.int64)
        self.by_edge = self.ids, self.sizes, self.shares, self.rest = Grown(np.int32), Grown(np.int8), Grown(np.float64), Grown(np.float64)

    def numbers(self, units: list[bytes]) -> np.ndarray:
        """The numbers of some units, after those that are new have been laid out. Numbers given before may hold no longer."""
        new = [u for u in units if u not in self.number]
        if new and self.points.n + sum(map(len, new)) > KEPT_PLACES:
            self.forget()
            new = [u for u in units if u not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            for begin in range(0, len(new), LAID_AT_ONCE):
                self.lay_out([x.decode().replace(" ", "▁") for x in new[begin : begin + LAID_AT_ONCE]])
        found = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))
        self.used.held[found] += 1
        return found

    def forget(self) -> None:
        """Keeps the units used most often, of half of all places that may be kept."""
        n = len(self.number)
        lengths, used = (self.ends.held - self.starts.held)[:n], self.used.held[:n]
        order = np.argsort(-used, kind="stable")
        kept = np.sort(order[np.cumsum(lengths[order]) <= KEPT_PLACES // 2])
        names = list(self.number)
        self.number = {names[k]: i for i, k in enumerate(kept.tolist())}
        places = stretches(self.starts.held[kept], lengths[kept])
        edges = stretches(self.first.held[places], self.n_edges.held[places].astype(np.int64))
        for held, of in ((self.by_unit, kept), (self.by_place, places), (self.by_edge, edges)):
            for x in held:
                x.keep(of)
        self.ends.held[: len(kept)] = np.cumsum(lengths[kept])
        self.starts.held[: len(kept)] = self.ends.held[: len(kept)] - lengths[kept]
        counts = self.n_edges.held[: len(places)].astype(np.int64)
        self.first.held[: len(places)] = np.cumsum(counts) - counts
        self.used.held[: len(kept)] //= 2

    def lay_out(self, units: list[str]) -> None:
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lengths)
        self.starts.add(self.points.n + ends - lengths)
        self.ends.add(self.points.n + ends)
        self.used.add(np.zeros(len(units), np.int64))
        self.points.add(points)
        ids = fitting(points, lengths, self.vocab)
        self.add_edges(ids, edge_shares(self.weights[ids], lengths))

    def add_edges(self, ids: np.ndarray, shares: np.ndarray) -> None:
        ids, shares = ids[:, ::-1], shares[:, ::-1]
        there = shares > 0
        counts = there.sum(axis=1)
        rest = np.zeros_like(shares)
        rest[:, 1:] = np.cumsum(shares[:, :-1], axis=1)
        rest[:, :-1] += np.cumsum(shares[:, :0:-1], axis=1)[:, ::-1]
        sizes, ends = shares.shape[1] - np.nonzero(there)[1], np.cumsum(counts)
        sizes[ends - 1] *= -1
        self.first.add(self.ids.n + ends - counts)
        self.n_edges.add(counts)
        self.ids.add(ids[there])
        self.sizes.add(sizes)
        self.shares.add(shares[there])
        self.rest.add(rest[there])


def fitting(points: np.ndarray, lengths: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """By place and length the piece that fits there; -1 for none, -2 for a character of bytes."""
    n = len(points)
    place = np.arange(n, dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = np.repeat(lengths, lengths) - place
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(lengths.max()), BASE, np.uint64)]))
    unpower = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(lengths.max()), UNBASE, np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[place])])
    out, back, at = np.full((n, LONGEST_PIECE), -1, np.int32), unpower[place], np.arange(n)
    for k in range(1, LONGEST_PIECE + 1):  # only where what has been read may go on
        at = at[left[at] >= k]
        found = vocab.find(mix((sums[at + k] - sums[at]) * back[at] + np.uint64(k)))
        at, found = at[found != -3], found[found != -3]
        out[at, k - 1] = found
    out[out[:, 0] < 0, 0] = -2
    return out[:, : 1 + int(np.nonzero((out != -1).any(axis=0))[0][-1])]


def edge_shares(weights: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Edge probabilities by place and length, by backward sums over each unit. Units go by falling length, so those that have d
    characters left are the first ones."""
    order = np.argsort(-lengths, kind="stable")
    ends = np.cumsum(lengths)[order]
    ends_after = ends + order + 1  # sums have a slot more a unit, for its end
    after = np.zeros(len(weights) + len(lengths) + LONGEST_PIECE + 1)
    after[ends_after - 1] = 1.0
    out, ahead, near = np.zeros_like(weights), np.arange(1, weights.shape[1] + 1), np.arange(LONGEST_PIECE)
    n_left = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(int(lengths.max()) + 1), "left")
    for d in range(1, int(lengths.max()) + 1):
        n = int(n_left[d])
        row, slot = ends[:n] - d, ends_after[:n] - 1 - d
        here = weights[row] * after[slot[:, None] + ahead]
        total = here.sum(axis=1)
        after[slot] = total
        out[row] = here / total[:, None]
        if d % LONGEST_PIECE == 0:  # sums of a unit have a common scale, a power of two, which cancels out
            held = slot[:, None] + near
            after[held] = np.ldexp(after[held], -np.frexp(total)[1][:, None])
    return out


def net_of(path: str, weights: np.ndarray) -> Net:
    """The worker's lattices for these weights."""
    if path not in _kept or not np.array_equal(_kept[path][0], weights):
        _kept[path] = (weights, Net(vocabulary(path), weights))
    return _kept[path][1]


def uniform_keys(key: np.ndarray, *parts: np.ndarray | int) -> np.ndarray:
    """Keys of draws: a key mixed with ordinals."""
    state = np.asarray(key, np.uint64)
    for p in parts:
        state = mix(state * BASE + np.asarray(p).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return state


def uniform(key: np.ndarray, *parts: np.ndarray | int) -> np.ndarray:
    """Draws in (0, 1) by hash of a key and ordinals."""
    return ((uniform_keys(key, *parts) >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def walked(net: Net, places: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random path through each of some stretches of places: counts of steps, then by stretch and step the places and edges."""
    first, shares, sizes = net.first.held, net.shares.held, net.sizes.held
    taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live, counts, step = np.nonzero(places < ends)[0], np.zeros(len(places), np.int64), 0
    place, end, key = places[live], ends[live], keys[live]
    while len(live):
        edge, drawn = first[place], uniform(key, step)
        on = np.nonzero((drawn >= shares[edge]) & (sizes[edge] > 0))[0]
        while len(on):
            drawn[on] -= shares[edge[on]]
            edge[on] += 1
            on = on[(drawn[on] >= shares[edge[on]]) & (sizes[edge[on]] > 0)]
        taken.append((live, place, edge))
        counts[live] += 1
        place = place + np.abs(sizes[edge])
        on = np.nonzero(place < end)[0]
        live, place, end, key = live[on], place[on], end[on], key[on]
        step += 1
    begin = np.cumsum(counts) - counts
    at_place, at_edge = np.zeros(int(counts.sum()), np.int64), np.zeros(int(counts.sum()), np.int64)
    for k, (who, place, edge) in enumerate(taken):
        at = begin[who] + k
        at_place[at], at_edge[at] = place, edge
    return counts, at_place, at_edge


def truncated(mass: np.ndarray, bound: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Gumbel values of log masses, none above the bound. A mass of nothing has none."""
    with np.errstate(invalid="ignore"):
        return np.where(mass == -np.inf, -np.inf, mass - np.logaddexp(mass - bound, np.log(-np.log(drawn))))


def stretches(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then those from starts[1] on, and so on."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Paths:
    """The paths of the texts' samples of one number, one after the other: by step place, edge and word; and what leaves them."""

    def __init__(self, net: Net, counts: np.ndarray, places: np.ndarray, edges: np.ndarray, words: np.ndarray, since: np.ndarray, values: np.ndarray):
        self.net, self.counts, self.places, self.edges, self.words, self.values = net, counts, places, edges, words, values
        self.ends = np.cumsum(counts)
        self.begins = self.ends - counts
        self.gone: dict[tuple[int, int], set[int]] = {}
        sums = np.concatenate([[0.0], np.cumsum(np.log(net.shares.held[edges]))])
        self.log_probs = sums[self.ends] - sums[self.begins]
        self.prefix = sums[:-1] - np.repeat(sums[self.begins], counts)
        with np.errstate(divide="ignore"):
            self.masses = self.prefix + np.log(net.rest.held[edges])
        self.masses[stretches(self.begins, np.minimum(since, counts))] = -np.inf  # what leaves before is another path's
        self.full = np.nonzero(counts)[0]
        self.weigh()

    def weigh(self) -> None:
        """The log mass of each path's opening, and the running sums of its steps' masses by the heaviest."""
        self.mass = np.full(len(self.counts), -np.inf)
        if len(self.full):
            top = np.maximum.reduceat(self.masses, self.begins[self.full])
            top[top == -np.inf] = 0.0
            self.sums = np.concatenate([[0.0], np.cumsum(np.exp(self.masses - np.repeat(top, self.counts[self.full])))])
            with np.errstate(divide="ignore"):
                self.mass[self.full] = np.log(self.sums[self.ends[self.full]] - self.sums[self.begins[self.full]]) + top

    def leaving(self, of: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        """A step for each of some texts, in proportion to what leaves there."""
        low, high = self.sums[self.begins[of]], self.sums[self.ends[of]]
        steps = np.clip(np.searchsorted(self.sums, low + drawn * (high - low), "right") - 1, self.begins[of], self.ends[of] - 1)
        for i in np.nonzero(self.masses[steps] == -np.inf)[0]:  # by rounding at a stretch's end
            steps[i] = self.begins[of[i]] + int(np.argmax(self.masses[self.begins[of[i]] : self.ends[of[i]]]))
        return steps

    def other_edges(self, of: np.ndarray, steps: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        """Another edge at each of these steps, which then leaves the opening too."""
        net, places = self.net, self.places[steps]
        first, n = net.first.held[places], net.n_edges.held[places].astype(np.int64)
        edges = first[:, None] + np.arange(LONGEST_PIECE)
        with np.errstate(divide="ignore"):
            logs = np.log(np.where(np.arange(LONGEST_PIECE) < n[:, None], net.shares.held[np.minimum(edges, net.shares.n - 1)], 0.0))
        logs[edges == self.edges[steps][:, None]] = -np.inf
        before = [self.gone.setdefault((int(t), int(step)), set()) for t, step in zip(of, steps, strict=True)]
        for i in (i for i, gone in enumerate(before) if gone):
            logs[i, [e - int(first[i]) for e in before[i]]] = -np.inf
        top = logs.max(axis=1, keepdims=True)
        upto = np.cumsum(np.exp(logs - top), axis=1)
        taken = (upto <= (drawn * upto[:, -1])[:, None]).sum(axis=1)
        taken = np.where(logs[np.arange(len(of)), np.minimum(taken, LONGEST_PIECE - 1)] > -np.inf, taken, np.argmax(logs, axis=1))
        logs[np.arange(len(of)), taken] = -np.inf
        top = logs.max(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(top == -np.inf, -np.inf, np.log(np.exp(logs - top[:, None]).sum(axis=1)) + top)
        self.masses[steps] = self.prefix[steps] + left
        for gone, edge in zip(before, (first + taken).tolist(), strict=True):
            gone.add(edge)
        return first + taken


def is_letter(raw: np.ndarray) -> np.ndarray:
    """By byte of UTF-8 text: ASCII letters, and characters beyond ASCII but for those of the blocks that hold most punctuation."""
    low = raw | np.uint8(0x20)
    out = ((low >= ord("a")) & (low <= ord("z"))) | (raw >= 0x80)
    two, three = raw == 0xC2, raw == 0xE2
    out &= ~(two | three)
    out[1:] &= ~(two | three)[:-1]
    out[2:] &= ~three[:-2]
    return out


def unit_starts(raw: np.ndarray, by_kind: bool) -> np.ndarray:
    """Where the units of UTF-8 text begin: at a run of blanks, around a line end, and, if asked, between letters and other characters."""
    blank, line = raw == ord(" "), raw == ord("\n")
    starts = np.zeros(len(raw), bool)
    starts[1:] = (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1]
    if by_kind:
        letter = is_letter(raw)
        starts[1:] |= (letter[1:] != letter[:-1]) & ~blank[1:] & ~blank[:-1]
    return starts


def units_of(texts: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The units of texts one after the other as places in a list of different ones, the list, and each text's number of units. Blanks stand
    for the vocabulary's mark; a text that is not empty has one put in front."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), "▁", " ")
    marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
    if isinstance(marked, pa.ChunkedArray):
        marked = marked.combine_chunks()
    wide = np.concatenate([[0], np.cumsum(pc.binary_length(marked).to_numpy(zero_copy_only=False).astype(np.int64))])
    whole = b"".join(pc.cast(marked, pa.binary()).to_pylist())
    raw = np.frombuffer(whole, np.uint8)
    starts = unit_starts(raw, vocab.by_kind) if vocab.by_unit else np.zeros(len(raw), bool)
    starts[wide[:-1][np.diff(wide) > 0]] = True
    at = np.nonzero(starts)[0]
    units = binaries(raw, np.append(at, len(raw))[1:]) if len(at) else pa.array([], pa.binary())
    units = units.dictionary_encode()
    return units.indices.to_numpy(zero_copy_only=False).astype(np.int64), units.dictionary.to_pylist(), np.diff(np.searchsorted(at, wide))


def searched(texts: pa.Array, keys: np.ndarray, net: Net, k: int) -> tuple[list[Paths], np.ndarray]:
    """The paths of the k best of each text by perturbed log probability, and the value that would come next. New steps of all texts are
    drawn and weighed at once."""
    at_name, names, n_words = units_of(texts, net.vocab)
    unit_of = net.numbers(names)[at_name] if len(names) else at_name
    starts, ends = net.starts.held[unit_of], net.ends.held[unit_of]
    first_word = np.cumsum(n_words) - n_words
    word = np.arange(len(unit_of)) - np.repeat(first_word, n_words)
    texts_of = np.repeat(np.arange(len(keys)), n_words)

    values = -np.log(-np.log(uniform(keys, 0)))
    counts, places, edges = walked(net, starts, ends, uniform_keys(keys[texts_of], 1, word))
    in_text = np.concatenate([[0], np.cumsum(counts)])
    per_text = in_text[first_word + n_words] - in_text[first_word]
    found = [Paths(net, per_text, places, edges, np.repeat(np.arange(len(unit_of)), counts), np.zeros(len(keys), np.int64), values)]
    openings = [truncated(found[0].mass, values, uniform(keys, 2, 1 << 40, 0))]
    for number in range(2, k + 1):
        best = np.argmax(openings, axis=0)
        top = np.max(openings, axis=0)
        at_text, since, lead_place, lead_edge, lead_word, kept_from = (np.zeros(len(keys), np.int64) for _ in range(6))
        for j, path in enumerate(found):
            of = np.nonzero((best == j) & (top > -np.inf))[0]
            if not len(of):
                continue
            steps = path.leaving(of, uniform(keys[of], number, 1 << 41))
            since[of], lead_place[of], lead_word[of], kept_from[of] = steps - path.begins[of] + 1, path.places[steps], path.words[steps], path.begins[of]
            lead_edge[of] = path.other_edges(of, steps, uniform(keys[of], number, 1 << 42))
            path.weigh()
            openings[j][of] = truncated(path.mass[of], top[of], uniform(keys[of], number + 1, 1 << 40, j))
        at_text = np.nonzero(since)[0]
        if not len(at_text):
            break
        # the unit of the leading edge goes on behind it, and all units after it anew
        n_new = (first_word + n_words)[at_text] - lead_word[at_text]
        words = stretches(lead_word[at_text], n_new)
        from_place, first_of = starts[words].copy(), np.cumsum(n_new) - n_new
        from_place[first_of] = lead_place[at_text] + np.abs(net.sizes.held[lead_edge[at_text]])
        counts, places, edges = walked(net, from_place, ends[words], uniform_keys(keys[np.repeat(at_text, n_new)], number, word[words]))
        in_text = np.concatenate([[0], np.cumsum(counts)])
        n_walked = in_text[first_of + n_new] - in_text[first_of]
        n_old = since[at_text] - 1
        per_text = np.zeros(len(keys), np.int64)
        per_text[at_text] = n_old + 1 + n_walked
        begin = (np.cumsum(per_text) - per_text)[at_text]
        merged = []
        for part, lead, new in (("places", lead_place, places), ("edges", lead_edge, edges), ("words", lead_word, np.repeat(words, counts))):
            out = np.zeros(int(per_text.sum()), np.int64)
            for j, path in enumerate(found):
                of = np.nonzero(best[at_text] == j)[0]
                out[stretches(begin[of], n_old[of])] = getattr(path, part)[stretches(kept_from[at_text][of], n_old[of])]
            out[begin + n_old] = lead[at_text]
            out[stretches(begin + n_old + 1, n_walked)] = new
            merged.append(out)
        found.append(Paths(net, per_text, *merged, since, np.where(since > 0, top, -np.inf)))
        openings.append(truncated(found[-1].mass, top, uniform(keys, number + 1, 1 << 40, number - 1)))
    return found, np.max(openings, axis=0)


def spelled(net: Net, places: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The piece ids of some steps, and how many each step has: one, or the bytes of a character outside the vocabulary."""
    ids = net.ids.held[edges]
    counts = np.ones(len(ids), np.int64)
    unknown = np.nonzero(ids == -2)[0]
    if not len(unknown):
        return ids, counts
    points = net.points.held[places[unknown]]
    counts[unknown] = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    starts = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    out[starts] = ids
    for point in np.unique(points):
        at = starts[unknown[points == point]]
        for k, byte in enumerate(chr(point).encode()):
            out[at + k] = net.vocab.byte_ids[byte]
    return out, counts


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that stand one after the other, with their ends in bytes."""
    offsets = np.concatenate([[0], ends])
    if offsets[-1] > np.iinfo(np.int32).max:
        return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values)])
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])


def log_inclusion(log_probs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(log_prob - bound)))."""
    with np.errstate(divide="ignore", over="ignore"):
        apart = log_probs - bounds
        return np.where(apart > 30, 0.0, np.where(apart < -30, apart, np.log(-np.expm1(-np.exp(np.minimum(apart, 30.0))))))


def table(texts: pa.Array, ids: pa.Array, keys: np.ndarray, net: Net, k: int) -> pa.RecordBatch:
    """SAMPLED's rows for some texts."""
    found, bounds = searched(texts, keys, net, k)
    texts = pc.fill_null(pc.cast(texts, pa.binary()), b"")
    marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), b"", pc.binary_join_element_wise(b" ", texts, b""))  # with the tokenizer's own blank in front
    batches = []
    for number, path in enumerate(found, 1):
        of = np.nonzero(path.values > -np.inf)[0]
        pieces, counts = spelled(net, path.places, path.edges)
        upto = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], path.ends])]
        wide = np.concatenate([[0], np.cumsum(net.vocab.widths[pieces])])[upto]
        same = pc.equal(binaries(np.frombuffer(net.vocab.letters(pieces), np.uint8), wide[1:]), marked)
        kind = "<u2" if net.vocab.size <= 1 << 16 else "<u4"
        raw = binaries(pieces.astype(kind), upto[1:] * np.dtype(kind).itemsize)
        at = pa.array(of)
        n = len(of)
        columns = [ids.take(at), pa.array(np.full(n, number, np.int32)), pa.array(np.diff(upto)[of]), *(pa.array(np.round(x[of], DIGITS)) for x in (path.log_probs, path.values, log_inclusion(path.log_probs, bounds))), same.take(at), pc.cast(raw.take(at), pa.binary())]
        batches.append(pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SAMPLED.split(", ")]))
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if len(texts) else batches[0]


def sampled(docs: DataFrame, path: str, k: int = SAMPLES, seed: int = SEED, counts: np.ndarray | None = None) -> DataFrame:
    """A row a document and sample. `counts` are piece counts; without them they are taken from `docs`."""
    counts = piece_counts(docs, path) if counts is None else counts

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = net_of(path, vocabulary(path).weights(counts))
        for batch in batches:
            for part in pieces(batch["text"], SLICE_BYTES):
                rows = batch.slice(part.start, part.stop - part.start)
                keys = pc.fill_null(rows["doc_id"], 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                yield table(rows["text"], rows["doc_id"], mix(keys + np.uint64(seed)), net, k)

    return docs.select("doc_id", "text").mapInArrow(sample, SAMPLED)


def op10_subword_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sampled(common.load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
