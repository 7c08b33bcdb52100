"""Media chunks against plain versions that share no function with the operator but its gear table and sizes."""

import collections
import hashlib
import io
import wave
import zlib

from sheafmill.llm import common, op6_media

SF = "/root/testdata/sf0.001"


def wav_of(text):
    """The payload, and the file that a WAV library reads it from."""
    raw = (text or "").encode()
    payload = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
    held = io.BytesIO()
    with wave.open(held, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(op6_media.RATE)
        f.writeframes(payload)
    return payload, held.getvalue()


def cut_plainly(media):
    """A byte at a time: the hash is doubled and a byte's gear added, so a byte leaves it after 32 steps."""
    chunks, begin, h = [], 0, 0
    for i, byte in enumerate(media):
        h = (2 * h + int(op6_media.GEAR[byte])) % 2**32
        size = i + 1 - begin
        if size >= op6_media.LEAST and h >> (32 - op6_media.CUT_BITS) == 0 or size == op6_media.MOST:
            chunks.append(media[begin : i + 1])
            begin = i + 1
    return chunks + [media[begin:]] * (begin < len(media))


def test_media_by_plain_versions(spark):
    """Every file, chunk list, shared place and value of the table, and of copies, near copies and texts without any."""
    docs = common.load(spark, SF, "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    body = " ".join(f"word{i * i % 997}" for i in range(4000))
    rows += [(1001, body), (1002, body), (1003, "put in front " + body), (1004, None), (1005, ""), (1006, "x" * 30_000), (1007, "é" * 95), (1008, "a" * 192)]
    files, chunks = op6_media.store(spark.createDataFrame(rows, "doc_id long, text string"))
    made = {i: wav_of(text) for i, text in rows}
    cuts = {i: [hashlib.sha256(c).digest() for c in cut_plainly(media)] for i, (_, media) in made.items()}
    times = collections.Counter(d for ds in cuts.values() for d in ds)
    bodies = {hashlib.sha256(c).digest(): c for _, media in made.values() for c in cut_plainly(media)}
    stored = chunks.collect()
    assert sorted(bytes(r.digest) for r in stored) == sorted(d for d, n in times.items() if n > 1) and all(bytes(r.chunk) == bodies[bytes(r.digest)] for r in stored)
    held = files.collect()
    assert sorted(r.doc_id for r in held) == sorted(i for i, _ in rows)
    for r in held:
        names = cuts[r.doc_id]
        assert [bytes(d) for d in r.digests] == names and r.sizes == [len(bodies[d]) for d in names]
        assert r.shared == [times[d] > 1 for d in names] and bytes(r.own) == b"".join(bodies[d] for d in names if times[d] == 1)
    assert any(times[d] > 1 for d in cuts[1003]) and any(times[d] == 1 for d in cuts[1003])  # chunks of a near copy are shared, but for its opening
    for r in op6_media.read_back(files, chunks).collect():
        payload, media = made[r.doc_id]
        heard = list(payload)
        crossings = sum((a >= 96) != (b >= 96) for a, b in zip(heard, heard[1:], strict=False))
        feature = f"mean={sum(heard) * 100 // len(heard)};peak={max(heard)};low={min(heard)};crossings={crossings}"
        want = (len(media), hashlib.sha256(media).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), feature)
        assert (r.media_bytes, r.media_sha256, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == want


def test_large_ids_beside_nulls(spark):
    """Ids keep all their bits, whatever stands in their batch."""
    rows = [(None, "a"), (2**62 + 1, "b" * 9000), (2**62 + 3, "b" * 9000), (-(2**60) - 1, None)]
    files, chunks = op6_media.store(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert sorted(map(str, (r.doc_id for r in op6_media.read_back(files, chunks).collect()))) == sorted(str(i) for i, _ in rows)
