"""Quality rules by cross-document line frequency, in built-in column functions only.

Lines are normalised (lower case, digit runs to 0, white space squeezed) and hashed together with their host. A line of a
host is boilerplate if it stands in at least `min_docs` of the host's documents, told apart by doc_id, and in more than `max_share` of
them. Such lines are removed; a document is depleted, and rejected, if under `min_left` of its words remain. Base rules fail a document
of under 50 words, or in which words of repeated three-word windows are over half of all; they read the whole text.

Defined cases: null or blank text has no words and fails the base rules; a null source is a host of its own; null doc_ids are one
document of a host; repeated rows are judged alike, each on its own; a table without rows gives none; columns whose names begin with _sm_
are reserved in `filtered`, and no other column of the input is read or changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafmill.llm import common

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_DOCS, MAX_SHARE, MIN_LEFT = 20, 0.05, 0.3
SYMBOLS = "#*$%&|<>"
#: Frequent lines, and documents that lose some (8 bytes, and 16 with 4 a line), are broadcast up to so many rows, and shuffled beyond.
BROADCAST_ROWS = 100_000


def windows_of(words: Column, n: int = 3) -> Column:
    """Hashes of all windows of n words, in order."""
    def of(hashes: Column) -> Column:
        return F.when(F.size(hashes) < n, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.slice(hashes, F.lit(1), F.size(hashes) - (n - 1)), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, n)]))
        )

    return common.let(F.transform(words, lambda w: F.xxhash64(w)), of)


def repeated_words(words: Column, n: int = 3) -> Column:
    """Words that lie in an n-word window found twice or more, the first included."""
    def covered(ordered: Column) -> Column:
        again = F.transform(ordered, lambda x, k: F.when(
            (x["h"] == F.coalesce(F.get(ordered, k - 1)["h"], x["h"] + 1)) | (x["h"] == F.coalesce(F.get(ordered, k + 1)["h"], x["h"] + 1)), x["i"]))
        places = F.filter(again, lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(*[i + k for k in range(n)])))))

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            common.let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)).alias("h"), i.alias("i")))), covered)
        )

    return common.let(windows_of(words, n), count).cast("long")


def with_words(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.coalesce(F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(common.BLANKS))) > 0), F.array().cast("array<string>"))


def base_stats(docs: DataFrame, text: str = "text") -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = common.let(with_words(t), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counts = common.let(common.words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    return [
        counts.alias("_sm_counts"),
        F.length(F.translate(t, common.BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
    ]


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def normalised(line: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(F.regexp_replace(line, "[0-9]+", "0"), common.BLANK_RUN, " "), F.lit(common.BLANKS)))


def lines_of(docs: DataFrame) -> Column:
    """place, key (a hash of host and normalised line) and words of each line that has a word."""
    def line(x: Column, i: Column) -> Column:
        return F.struct(i.alias("place"), F.xxhash64(F.xxhash64(docs["source"]), normalised(x)).alias("key"), common.n_words(x).alias("n"))

    return F.filter(F.transform(F.split(F.coalesce(docs["text"], F.lit("")), "\n"), line), lambda x: x["n"] > 0)


def frequent_lines(parsed: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """The written table of keys of the lines that too many documents of their host have."""
    once = parsed.select("host", "doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key")).groupBy("host", "key", "doc_id").agg(F.lit(1).alias("one"))
    in_docs = once.groupBy("host", "key").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    hosts = parsed.where(F.size("lines") > 0).groupBy("host", "doc_id").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_docs"))
    return common.written(in_docs.join(hosts, "host").where(F.col("docs") > max_share * F.col("host_docs")).select("key").distinct(), "op7-frequent")


def removals(parsed: DataFrame, **limits: float) -> DataFrame:
    """The written table of (doc_id, text_hash, places, gone): the lines that documents lose, and how many words go with them."""
    frequent = common.small_or_shuffled(frequent_lines(parsed, **limits), BROADCAST_ROWS)
    lost = parsed.select("doc_id", "text_hash", F.explode("lines").alias("line")).select("doc_id", "text_hash", "line.*").join(frequent, "key", "left_semi")
    per = lost.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("place", "n")).alias("of"))
    return common.written(per.select("doc_id", "text_hash", F.transform("of", lambda x: x["place"]).alias("places"), F.aggregate("of", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("gone")), "op7-removed")


def host_and_hash(docs: DataFrame) -> list[Column]:
    return [F.xxhash64("source").alias("host"), F.xxhash64("text").alias("text_hash")]


def is_depleted(n_words: Column, gone: Column, min_left: float) -> Column:
    return F.coalesce(n_words - gone < min_left * n_words, F.lit(False))


def judged(docs: DataFrame, min_left: float = MIN_LEFT, **limits: float) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and lines removed and words left, for each row. Texts are read once."""
    parsed = docs.select("doc_id", *host_and_hash(docs), *base_stats(docs), lines_of(docs).alias("lines"))
    parsed = parsed.select("doc_id", "host", "text_hash", F.col("_sm_counts.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_sm_counts.r").alias("n_repeat_words"), "lines")
    parsed = common.written(parsed, "op7-parsed")
    gone = common.small_or_shuffled(removals(parsed, **limits), BROADCAST_ROWS, 32 + 4 * F.size("places")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), F.size("places").cast("long").alias("places"), "gone")
    rows = parsed.drop("lines", "host").withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    out = rows.join(gone, rows["doc_id"].eqNullSafe(gone["gone_id"]) & (rows["text_hash"] == gone["gone_hash"]), "left")
    kept = ~F.col("base_failed") & ~is_depleted(F.col("n_words"), F.col("gone"), min_left)
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    return out.select(*[c for c in rows.columns if c != "text_hash"], kept.alias("kept"), F.coalesce("places", F.lit(0).cast("long")).alias("n_lines_removed"), left.alias("words_left"))


def filtered(docs: DataFrame, min_left: float = MIN_LEFT, **limits: float) -> DataFrame:
    """The rows of `docs`, all columns, that the rules keep, their texts without the lines above the limits, and `n_chars`, where there is one,
    counted anew in the texts changed."""
    parsed = common.written(docs.select("doc_id", *host_and_hash(docs), lines_of(docs).alias("lines")), "op7-parsed")
    gone = common.small_or_shuffled(removals(parsed, **limits), BROADCAST_ROWS, 32 + 4 * F.size("places")).select(F.col("doc_id").alias("_sm_id"), F.col("text_hash").alias("_sm_hash"), F.col("places").alias("_sm_places"), F.col("gone").alias("_sm_gone"))
    counts = common.let(common.words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    sound = docs.withColumn("_sm_counts", counts).where(~F.coalesce(base_failed(F.col("_sm_counts.n"), F.col("_sm_counts.r")), F.lit(True)))
    rows = sound.join(gone, sound["doc_id"].eqNullSafe(gone["_sm_id"]) & (F.xxhash64(sound["text"]) == gone["_sm_hash"]), "left").where(~is_depleted(F.col("_sm_counts.n"), F.col("_sm_gone"), min_left))
    places, changed = F.col("_sm_places"), F.col("_sm_places").isNotNull()
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(places, i)), "\n")
    rows = rows.withColumn("text", F.when(changed, left).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.load(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (SELECT doc_id, source, text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
ix AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i+1], ws[i+2]) AS c FROM ix),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM tri, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
lines AS (SELECT doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  lower(trim(regexp_replace(regexp_replace(line, '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm
  FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS d FROM lines GROUP BY doc_id),
freq AS (SELECT source, norm, count(DISTINCT doc_id) AS docs FROM lines GROUP BY source, norm),
hosts AS (SELECT source, count(DISTINCT doc_id) AS host_docs FROM lines GROUP BY source),
common_lines AS (SELECT f.source, f.norm FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
  WHERE f.docs >= 20 AND f.docs > 0.05::DOUBLE * h.host_docs),
gone AS (SELECT l.doc_id, count(*) AS n_lines, sum(l.n) AS n_gone FROM lines l JOIN common_lines c ON l.source IS NOT DISTINCT FROM c.source AND l.norm = c.norm GROUP BY l.doc_id),
s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')), 0)::BIGINT AS word_chars,
  coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0)::BIGINT AS n_symbols,
  coalesce(d, 0)::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id))
SELECT s.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(n_words - n_gone < 0.3::DOUBLE * n_words, false) AS kept,
  coalesce(n_lines, 0)::BIGINT AS n_lines_removed, (n_words - coalesce(n_gone, 0))::BIGINT AS words_left FROM s LEFT JOIN gone USING (doc_id)
"""
