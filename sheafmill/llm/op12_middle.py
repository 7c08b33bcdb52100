"""Fill-in-middle transformation over an indexable skip list of units.

A text's units are runs of ASCII letters and single other code points. They form a skip list: its express lanes hold every unit whose rank's hash
ends in so many zero bits, about a sixteenth of the lane below, and a lane's node carries how many units, code points and bytes lie before the lane's
next node. A cut behind the k-th unit is found by descending: on each lane, nodes are passed as long as their accumulated unit widths stay within k, and
the widths of code points and bytes are summed on the way; below the lowest lane, the few units that are left are cut from the text itself. So a cut
costs some sixteen steps a lane, and falls exactly on a code point and a unit. Lanes are built from slices of bytes, so that what a text needs
beside itself is a fraction of it.

Both cuts, whether the text is transformed at all and in which form are drawn from SHA-256 of a seed and doc_id: rows draw alike in any order and on any
executor. A text that contains a marker is left plain, so that the markers found in an output are its own and the text can be rebuilt.

Defined cases: null text is an empty one; empty texts are plain with no unit; a null doc_id draws as an empty one; repeated rows and rows of one doc_id draw alike;
texts of one unit have empty parts; no rows give none; columns whose names begin with _sm_ are reserved, and no others but doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafmill.llm import common
from sheafmill.llm.shingles import mix

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = "1"
#: Percent of texts that are transformed, and of those, that have the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: A lane's node stands for about 2 ** LANE_BITS nodes of the lane below.
LANE_BITS = 4
SLICE = 1 << 20
UNIT = re.compile(rb"[A-Za-z]+|[\x00-\x40\x5b-\x60\x7b-\x7f]|[\xc0-\xff][\x80-\xbf]*")
MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


class Lane(NamedTuple):
    """A node's widths reach to the lane's next node, or to the end; `down` is its place in the lane below."""

    units: np.ndarray
    points: np.ndarray
    octets: np.ndarray
    down: np.ndarray


class UnitList:
    """The units of a UTF-8 text as an indexable skip list."""

    def __init__(self, raw: bytes, lane_bits: int = LANE_BITS, slice_bytes: int = SLICE):
        self.raw, self.n_units, self.n_points = raw, 0, 0
        places, kept, letter_before = np.frombuffer(raw, np.uint8), [], False
        for low in range(0, len(raw), slice_bytes):
            part = places[low : low + slice_bytes]
            letter = ((part | 32) - 97) < 26
            point = (part & 0xC0) != 0x80
            inner = letter.copy()
            inner[1:] &= letter[:-1]
            inner[0] &= letter_before
            starts = np.nonzero(point & ~inner)[0]
            ranks = np.arange(self.n_units, self.n_units + len(starts), dtype=np.uint64)
            zeros = mix(ranks)
            chosen = ((zeros & np.uint64((1 << lane_bits) - 1)) == 0) | (ranks == 0)
            before = np.cumsum(point) - point
            kept.append((ranks[chosen].astype(np.int64), self.n_points + before[starts[chosen]], low + starts[chosen], zeros[chosen]))
            self.n_units, self.n_points, letter_before = self.n_units + len(starts), self.n_points + int(point.sum()), bool(letter[-1])
        self.lanes: list[Lane] = []
        if not raw:
            return
        ranks, points, octets, zeros = (np.concatenate(x) for x in zip(*kept, strict=True))
        down = np.zeros(len(ranks), np.int64)
        while True:
            self.lanes.append(Lane(np.diff(ranks, append=self.n_units), np.diff(points, append=self.n_points), np.diff(octets, append=len(raw)), down))
            zeros = zeros >> np.uint64(lane_bits)
            down = np.nonzero(((zeros & np.uint64((1 << lane_bits) - 1)) == 0) | (ranks == 0))[0]
            if len(down) == len(ranks) or len(ranks) == 1:
                return
            ranks, points, octets, zeros = ranks[down], points[down], octets[down], zeros[down]

    def after(self, rank: int) -> tuple[int, int]:
        """Code points and bytes of the first `rank` units."""
        units = points = octets = node = 0
        for lane in reversed(self.lanes):
            while node < len(lane.units) and units + lane.units[node] <= rank:
                units, points, octets = units + int(lane.units[node]), points + int(lane.points[node]), octets + int(lane.octets[node])
                node += 1
            if node == len(lane.units):
                return points, octets
            node = int(lane.down[node])
        for unit in islice(UNIT.finditer(self.raw, octets), rank - units):
            points, octets = points + (unit.end() - unit.start() if unit.group()[0] < 128 else 1), unit.end()
        return points, octets


def draws(doc_id: int | None, seed: str = SEED) -> list[int]:
    """Four numbers of 32 bits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4]) for k in (0, 4, 8, 12)]


def made(doc_id: int | None, text: bytes | None, seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle, and the output."""
    raw = text or b""
    units, (cut, other, taken, order) = UnitList(raw), draws(doc_id, seed)
    n = units.n_units
    if not raw or any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE)) or taken % 100 >= rate:
        return n, "plain", None, None, raw
    low, high = sorted((cut % (n + 1), other % (n + 1)))
    (points, a), (up_to, b) = units.after(low), units.after(high)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if order % 100 < suffix_first:
        return n, "spm", points, up_to - points, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", points, up_to - points, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def transformed(docs: DataFrame, seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """`docs` with _sm_fim: n units, form (plain, psm or spm), code points of prefix and middle, and the output text."""
    def make(ids: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [made(i.as_py(), t.as_py(), seed, rate, suffix_first) for i, t in zip(ids, texts, strict=True)]
        n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())],
            ["n", "form", "prefix_chars", "middle_chars", "output"],
        )

    return docs.withColumn("_sm_fim", F.arrow_udf(make, MADE)(docs["doc_id"], docs["text"].cast("binary")))


def restored(output: Column, form: Column) -> Column:
    """The text of an output, by its form."""
    def joined(marks: bytes, order: tuple[int, int, int]) -> Column:
        parts = F.split(F.substr(output, F.lit(len(PREFIX) + 1)), f"<[{marks.decode()}]>")
        return common.let(parts, lambda p: F.concat(*[p[k] for k in order]))

    return F.when(form == "psm", joined(b"SM", (0, 2, 1))).when(form == "spm", joined(b"PM", (1, 2, 0))).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fim = transformed(common.load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_sm_fim.*")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return fim.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS us, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, len(us)::BIGINT AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(us[1:a], '') AS prefix, array_to_string(us[a + 1:b], '') AS middle, array_to_string(us[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
