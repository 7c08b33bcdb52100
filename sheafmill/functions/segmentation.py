"""Word segmentation of Lao, which is written without blanks: a shortest path over dictionary words, run by run.

A run of Lao characters is cut into clusters, the least units that a word can begin or end at: leading vowels with their consonant and all signs that
follow it, or a run of digits. A word is a stretch of whole clusters that the dictionary has; runs of digits and the two punctuation signs are words by themselves.
The path through a run is the one with the fewest characters outside of words, then the fewest tokens; clusters outside of words side by side are one
token. Of equal paths that with the earlier and longer word is taken, looking from the left.

The dictionary is a table of words; it goes to the executors as a prefix table. Columns are pieced natively, and texts without the script never enter Python.
The different runs of some rows are cut together: a step of arrays for all clusters that are as far from their run's end, so that no cluster is a Python object.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafmill.functions import batches, texts

#: The word list of a language is bounded; a table of more words is not one.
MOST_WORDS = 1_000_000
# The script's clusters, and what is a word without a dictionary.
CLUSTER = "[ເ-ໄ]*[ກ-ຮໜ-ໟ][ະ-ຽ່-໎]*|[ເ-ໄ]+|[ະ-ຽ່-໎]+|[໐-໙]+|[຀-໿]"
BY_ITSELF = "[໐-໙]+|[ຯໆ]"
PIECE = f"[{texts.LAO}]+|[^{texts.LAO}\\s\\p{{Z}}\\x{{85}}]+"

_CLUSTER, _BY_ITSELF = re.compile(CLUSTER), re.compile(BY_ITSELF)

#: Runs of more characters are cut one by one: each step of arrays would have few of them.
LONG_RUN = 256
#: Bytes of different pieces that are cut together: arrays of some ten times as many.
RUN_BYTES = batches.PART_BYTES // 2
#: Where a run ends, among the characters of the script (its block's 128, counted from 0).
_END = 128
#: Kinds of characters: others, leading vowels, consonants, signs, digits; and pairs of kinds of which the second goes on with the first's cluster.
_KIND = np.array([next((k for k, of in enumerate(("[ເ-ໄ]", "[ກ-ຮໜ-ໟ]", "[ະ-ຽ່-໎]", "[໐-໙]"), 1) if re.match(of, chr(0xE80 + c))), 0) for c in range(_END)] + [0], np.int8)
_GOES_ON = np.isin(np.arange(25), [5 * a + b for a, b in ((1, 1), (1, 2), (2, 3), (3, 3), (4, 4))])
_ALONE = np.array([bool(_BY_ITSELF.match(chr(0xE80 + c))) for c in range(_END)] + [False])
#: Costs are characters outside of words, and tokens below: neither are more than LONG_RUN.
_OUTSIDE, _FAR = np.int32(1 << 10), np.int32(1 << 30)
#: A character's bit among its 64, and the bits before it.
_BIT = np.append(np.tile(np.uint64(1) << np.arange(64, dtype=np.uint64), 2), np.uint64(0))
_BEFORE = _BIT - np.minimum(_BIT, np.uint64(1))


class Segmenter:
    """Words, and all their openings: by clusters, and by characters as a trie. A node's steps are bits of two numbers, and nodes are numbered in the order of the steps to them."""

    def __init__(self, words: list[str]):
        self.words: dict[str, bool] = {}
        for word in sorted(set(words) - {"", None}):
            clusters = _CLUSTER.findall(word)
            for k in range(1, len(clusters)):
                self.words.setdefault("".join(clusters[:k]), False)
            self.words[word] = True
        said = sorted(w for w, whole in self.words.items() if whole and all("຀" <= c <= "໿" for c in w))
        codes = np.frombuffer("".join(said).encode("utf-16-le"), np.uint16).astype(np.int64) - 0xE80
        sizes = np.array([len(w) for w in said], np.int64)
        begin, node, steps, ends = np.cumsum(sizes) - sizes, np.zeros(len(said), np.int64), [], []
        left, n, k = np.arange(len(said)), 0, 0
        while len(left):
            level, at = np.unique(node[left] * _END + codes[begin[left] + k], return_inverse=True)
            node[left], k = n + at + 1, k + 1
            ends.append(np.zeros(len(level), bool))
            ends[-1][at[sizes[left] == k]] = True
            steps.append(level)
            left, n = left[sizes[left] > k], n + len(level)
        steps = np.concatenate([np.zeros(0, np.int64), *steps])
        self.whole = np.concatenate([np.zeros(1, bool), *ends])
        self.bits, half = np.zeros(2 * len(self.whole) + 1, np.uint64), steps // 64  # the last one is of no node
        np.bitwise_or.at(self.bits, half, _BIT[steps % _END])
        self.first = np.searchsorted(half, np.arange(2 * len(self.whole))).astype(np.int32)  # how many steps there are before those of a number

    def tokens(self, run: str) -> list[str]:
        """The tokens of a run of Lao characters, from the costs of its tails."""
        clusters = _CLUSTER.findall(run)
        n, far = len(clusters), (1 << 60, 0)
        known, other = [far] * n + [(0, 0)], [far] * (n + 1)  # least (characters outside, tokens) of a tail that begins with a word, or doesn't
        ends = [0] * n
        for i in range(n - 1, -1, -1):
            word, j = "", i
            while j < n:
                word += clusters[j]
                found = self.words.get(word)
                j += 1
                if found or j == i + 1 and _BY_ITSELF.fullmatch(word):
                    outside, after = min(known[j], other[j])
                    if (outside, after + 1) <= known[i]:
                        known[i], ends[i] = (outside, after + 1), j
                if found is None:
                    break
            next_known, next_other = (known[i + 1][0], known[i + 1][1] + 1), other[i + 1]
            outside, after = min(next_known, next_other)
            other[i] = (outside + len(clusters[i]), after)
        out, i = [], 0
        while i < n:
            if known[i] <= other[i]:
                out.append("".join(clusters[i : ends[i]]))
                i = ends[i]
                continue
            begin = i
            while True:
                i += 1
                if i == n or (known[i][0], known[i][1] + 1) <= other[i]:
                    break
            out.append("".join(clusters[begin:i]))
        return out

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Which of some runs' characters (from 0 on, _END behind each run) begin a token, as `tokens` has it."""
        kind = _KIND[codes]
        begin = np.ones(len(codes), bool)  # a cluster, or a run's end
        begin[1:] = ~_GOES_ON[kind[:-1] * 5 + kind[1:]]
        at, place = np.flatnonzero(begin).astype(np.int32), np.cumsum(begin, dtype=np.int32) - np.int32(1)
        end = codes[at] == _END
        last, here = np.flatnonzero(end).astype(np.int32), np.arange(len(at), dtype=np.int32)
        # clusters by how far from their run's end they are
        level = np.repeat(last, np.diff(last, prepend=-1)) - here
        order, bounds = np.argsort(level.astype(np.int16), kind="stable").astype(np.int32), np.cumsum(np.bincount(level))
        # the words that begin at each, in that order, the shorter ones first
        found = self.held(codes, begin, place, at)
        n = np.zeros(len(at), np.int32)
        for head, _ in found:
            n[head] += 1
        upto = np.cumsum(n[order], dtype=np.int32)
        free = np.empty(len(at), np.int32)
        free[order] = upto - n[order]
        froms, tos = np.empty((2, upto[-1]), np.int32)
        for head, behind in found:
            froms[free[head]], tos[free[head]] = head, behind
            free[head] += 1
        width = np.diff(at, append=np.int32(len(codes))) * _OUTSIDE
        known, other, best, ends = np.full(len(at), _FAR), np.full(len(at), _FAR), np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        known[last] = 0
        for k in range(1, len(bounds)):
            now = order[bounds[k - 1] : bounds[k]]
            lo, hi = upto[bounds[k - 1] - 1], upto[bounds[k] - 1]
            if lo < hi:
                cost, count = best[tos[lo:hi]] + 1, n[now]
                count = count[count > 0]
                first = np.cumsum(count) - count
                least, head = np.minimum.reduceat(cost, first), froms[lo + first]
                longest = np.maximum.reduceat(np.where(cost == np.repeat(least, count), tos[lo:hi], 0), first)
                known[head], ends[head] = least, longest
            other[now] = np.minimum(known[now + 1] + 1, other[now + 1]) + width[now]
            best[now] = np.minimum(known[now], other[now])
        stop = np.where(known + 1 <= other, here, np.int32(len(at)))  # a stretch outside of words ends here
        stop = np.minimum.accumulate(stop[::-1])[::-1]
        after = np.where(known <= other, ends, np.append(stop[1:], np.int32(len(at))))
        out = np.zeros(len(codes), bool)
        now = np.concatenate([np.zeros(1, np.int32), last[:-1] + 1])
        while len(now):
            out[at[now]] = True
            now = after[now]
            now = now[~end[now]]
        return out

    def held(self, codes: np.ndarray, begin: np.ndarray, place: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(from, to) of all words in some runs, as places of the cluster that begins one and of that behind it: of each cluster one at most in a pair of arrays, its shorter ones before. `at` are
        where clusters begin."""
        alone = np.flatnonzero(_ALONE[codes[at]]).astype(np.int32)
        found = [(alone, alone + 1)]
        node, char, head = np.zeros(len(at), np.int32), at, np.arange(len(at), dtype=np.int32)
        while len(char):
            code = codes[char]
            half = 2 * node + (code >> 6)
            bits = self.bits[half]
            on = np.flatnonzero(bits & _BIT[code])
            node = self.first[half[on]] + np.bitwise_count(bits[on] & _BEFORE[code[on]]).astype(np.int32) + 1
            char, head = char[on] + 1, head[on]
            word = np.flatnonzero(self.whole[node] & begin[char])
            found.append((head[word], place[char[word]]))
        return found


def word_list(dictionary: DataFrame) -> list[str]:
    """The different words (word) of the script in a table."""
    rows = dictionary.where(F.col("word").rlike(f"^[{texts.LAO}]+$")).select("word").distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a dictionary has at most {MOST_WORDS} words")
    return [r["word"] for r in rows]


def segmenter(dictionary: DataFrame) -> Segmenter:
    """From a table of words (word) of the script."""
    return Segmenter(word_list(dictionary))


def pieces(text: Column) -> Column:
    """Runs of the script, and what else stands between these and blanks."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def distinct_pieces(found: pa.Array) -> pa.DictionaryArray:
    """The pieces of lists, end to end, each different one once."""
    flat = found.flatten().dictionary_encode()
    return flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat


class Memory:
    """A segmenter, and its results for pieces that are cut one by one, a bounded number of them."""

    def __init__(self, by: Segmenter, most: int = 100_000):
        self.by, self.most, self.met = by, most, {}

    def of(self, piece: str) -> list[str]:
        found = self.met.get(piece)
        if found is None:
            if len(self.met) >= self.most:
                self.met.clear()
            found = self.met[piece] = self.by.tokens(piece) if "຀" <= piece[0] <= "໿" else [piece]
        return found


def cut(pieces: pa.Array, memory: Memory) -> pa.ListArray:
    """The tokens of each piece, as many pieces together as are `RUN_BYTES`."""
    return batches.by_parts(pieces, lambda part: cut_together(part, memory), RUN_BYTES)


def cut_together(pieces: pa.Array, memory: Memory) -> pa.ListArray:
    """The tokens of each piece (runs of the script, and others, which are a token each); no piece is null or empty. A token is a stretch of its piece's bytes."""
    if not len(pieces):
        return pa.array([], pa.list_(pa.string()))
    offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
    data, sizes = np.frombuffer(pieces.buffers()[2], np.uint8), np.diff(offsets)
    script = (sizes > 2) & (data[offsets[:-1]] == 0xE0)  # three bytes a character of the script: E0, then BA or BB, then its place
    script[script] = data[offsets[:-1][script] + 1] & 0xFE == 0xBA
    short = script & (sizes <= 3 * LONG_RUN)
    begins = [offsets[:-1]]
    if short.any():
        n = sizes[short] // 3
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        char = np.arange(len(row), dtype=np.int32)
        byte = np.repeat(offsets[:-1][short] - 3 * (np.cumsum(n, dtype=np.int32) - n), n) + 3 * char
        codes = np.full(len(row) + len(n), _END, np.uint8)
        codes[char + row] = (data[byte + 1] & 1) << 6 | data[byte + 2] & 0x3F
        begins.append(byte[memory.by.starts(codes)[char + row]])
    for i in np.flatnonzero(script & ~short):
        found = memory.of(pieces[int(i)].as_py())
        begins.append(offsets[i] + 3 * np.cumsum([0, *(len(t) for t in found[:-1])], dtype=np.int32))
    marked = np.zeros(offsets[-1] - offsets[0], bool)
    for at in begins:
        marked[at - offsets[0]] = True
    begins = np.flatnonzero(marked).astype(np.int32) + offsets[0]
    values = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, offsets[-1:])), pieces.buffers()[2])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, offsets), pa.int32()), values)


def begins(found: pa.Array) -> np.ndarray:
    """Where each list begins among the lists' elements, end to end, and where the last one ends; a null one is empty."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def parted_lists(found: pa.Array, memory: Memory) -> pa.Array:
    """Lists of pieces as lists of tokens: each different piece is cut once, and taken as often as it stands."""
    pieces = distinct_pieces(found)
    each = cut(pieces.dictionary, memory).take(pieces.indices)
    ends = begins(each)[begins(found)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each.flatten(), mask=found.is_null())


def counted_lists(found: pa.Array, memory: Memory) -> pa.Array:
    """Lists of lists of pieces as lists of numbers of tokens."""
    inner = found.flatten()
    pieces = distinct_pieces(inner)
    sizes = np.diff(begins(cut(pieces.dictionary, memory)))
    sums = np.concatenate([[0], np.cumsum(sizes[pieces.indices.to_numpy(zero_copy_only=False)])]) if len(sizes) else np.zeros(1, np.int64)
    return pa.ListArray.from_arrays(pa.array(begins(found), pa.int32()), pa.array(np.diff(sums[begins(inner)]), pa.int32()), mask=found.is_null())


def runs_in(found: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts (none is null) as pieces, end to end: runs of the script and what stands between them, and where each text's begin, and the last one's end. Pieces are stretches of the texts' bytes."""
    offsets = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1]
    data = np.frombuffer(found.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    script = np.zeros(len(data) + 7, bool)  # where a character of the script (three bytes) begins, after three bytes
    script[3 : len(data) + 2] = (data[:-1] == 0xE0) & (data[1:] & 0xFE == 0xBA)
    bounds = script[3 : len(data) + 4] ^ script[: len(data) + 1]
    bounds[offsets - offsets[0]] = True
    bounds = np.flatnonzero(bounds).astype(np.int32) + offsets[0]
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), found.buffers()[2]), np.searchsorted(bounds, offsets)


def checked_strings(found: pa.Array, memory: Memory, known: pa.Array) -> pa.Array:
    """Texts as how many different tokens of the script (words) they have, and how many of these aren't known."""
    flat, upto = runs_in(found.fill_null(""))
    flat = flat.dictionary_encode()
    each = cut(flat.dictionary, memory)
    tokens, ends = each.flatten().dictionary_encode(), begins(each)
    words = pc.match_substring_regex(tokens.dictionary, f"[{texts.LAO}]").to_numpy(zero_copy_only=False)
    missing = ~pc.is_in(tokens.dictionary, value_set=known).to_numpy(zero_copy_only=False)
    row, piece, token = np.repeat(np.arange(len(found)), np.diff(upto)), flat.indices.to_numpy(), tokens.indices.to_numpy()
    if len(piece):
        script = words[token[ends[:-1]]][piece]
        row, piece = np.divmod(np.unique(row[script] * len(each) + piece[script]), len(each))  # each run once a text
        n = np.diff(ends)[piece]
        row, token = np.divmod(np.unique(np.repeat(row * len(words), n) + token[np.repeat(ends[piece] - (np.cumsum(n) - n), n) + np.arange(n.sum())]), len(words))
    counts = [np.bincount(row, minlength=len(found)), np.bincount(row[missing[token]], minlength=len(found))]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in counts], ["words", "unknown"])


def tokens(text: Column, by: Segmenter) -> Column:
    """The tokens of a text in order: words of its Lao runs, and what stands between these and blanks. Null text has none."""
    text, memory = F.coalesce(text, F.lit("")), Memory(by)

    @F.arrow_udf("array<string>")
    def parted(found: pa.Array) -> pa.Array:
        return batches.by_parts(found, lambda part: parted_lists(part, memory))

    return F.coalesce(parted(F.when(text.rlike(f"[{texts.LAO}]"), pieces(text))), pieces(text))


def checked(text: Column, by: Segmenter, known: list[str]) -> Column:
    """How many different words of the script (words) a text has by a segmenter, and how many of them aren't known (unknown). Null text has none. Its tokens never leave the task's arrays."""
    memory, listed = Memory(by), pa.array(known, pa.string())

    @F.arrow_udf("struct<words: bigint, unknown: bigint>")
    def counted(found: pa.Array) -> pa.Array:
        return batches.by_parts(found, lambda part: checked_strings(part, memory, listed))

    found = counted(F.when(text.rlike(f"[{texts.LAO}]"), text))
    return F.struct(*[F.coalesce(found[k], F.lit(0).cast("long")).alias(k) for k in ("words", "unknown")])


def counts(found: Column, by: Segmenter) -> Column:
    """How many tokens each text of an array has."""
    memory = Memory(by)

    @F.arrow_udf("array<int>")
    def counted(rows: pa.Array) -> pa.Array:
        return batches.by_parts(rows, lambda part: counted_lists(part, memory))

    in_script = F.exists(found, lambda t: t.rlike(f"[{texts.LAO}]"))
    return F.coalesce(counted(F.when(in_script, F.transform(found, pieces))), F.transform(found, lambda t: F.size(pieces(t))))


def segmented(text: Column, by: Segmenter) -> Column:
    """tokens, joined (by blanks), count and lang of a text."""
    found = tokens(text, by)
    return F.struct(found.alias("tokens"), F.array_join(found, " ").alias("joined"), F.size(found).cast("long").alias("count"), texts.language(F.coalesce(text, F.lit(""))).alias("lang"))
