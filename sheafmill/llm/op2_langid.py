"""Language identification by error-correcting output codes.

Each language gets a codeword of bits; for each bit a binary n-gram classifier (naive Bayes log odds of hashed byte trigrams,
averaged over the trigrams of a text's letters) says whether the text's language is one of those with the bit set.
Loss-weighted decoding sums exp(-code * margin) over the bits, each weighed by how well its classifier did in training, and takes
the codeword of the least loss; where the runner-up is close, the document is flagged as ambiguous.

Only text and non-null lang of labelled rows are learned from, on a hash sample of about `TRAIN_DOCS` documents at most
(all, if there are fewer). Counts are summed in Spark; what comes to the driver is one row a language, of 2^13 counts.

Defined cases: null text, and text without a letter (of category L: not digits, fractions, Roman numerals or circled numbers), is `und` with score 0 (so is every text if no row is labelled); one
language alone is always predicted; repeated rows get equal predictions; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafmill.llm import common

TRAIN_DOCS = 20_000
SLOTS = 1 << 13
EXTRA_BITS = 12
#: Margins are averages of log odds; this brings them to a usual range of a logistic loss.
SHARPNESS = 6.0
AMBIGUOUS_UNDER = 0.6
#: Of Unicode's categories of letters; numbers written with letters are none.
LETTER = regex.compile(r"\p{L}")
#: The hash sample is cut so finely that it keeps its size in tables of any number of rows.
SAMPLE_PARTS = 1 << 48
#: ASCII bytes that aren't letters all count as a blank.
TO_BLANK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def slot_counts(text: str) -> np.ndarray:
    """How often each hashed trigram of the lower-cased letters occurs; runs of non-letters count as one blank."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(TO_BLANK) + b" ", np.uint8)
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    raw = raw[keep].astype(np.uint32)
    grams = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    return np.bincount((grams * np.uint32(2654435761)) >> np.uint32(32 - 13), minlength=SLOTS)


def has_letter(text: str | None) -> bool:
    return bool(text and LETTER.search(text))


def codewords(n: int, extra: int = EXTRA_BITS) -> np.ndarray:
    """A row of -1 and 1 for each of n languages, no column or its opposite twice. If there are few ways to split them, all; else one bit
    a language, and further bits that split them evenly and differ most."""
    own = 2 * np.eye(n, dtype=int) - 1
    if n < 3:
        return own[:, :1]
    if 2 ** (n - 1) - 1 <= n + extra:
        return np.array([[1 if not k else 2 * (bits >> (k - 1) & 1) - 1 for bits in range(2 ** (n - 1) - 1)] for k in range(n)])
    random = np.random.default_rng(n)
    tried = [np.where(np.argsort(random.random(n)) < n // 2, 1, -1) for _ in range(40 * extra)]
    more: list[np.ndarray] = []
    for _ in range(extra):
        agree = [max((abs(int(t @ m)) for m in more), default=0) for t in tried]
        more.append(tried[int(np.argmin(agree))])
    return np.column_stack([own, *more])


class Decoder:
    """Bit classifiers of all codeword bits and their loss-weighted decoding."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.codes = langs, codewords(len(langs))
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        self.odds = np.zeros((SLOTS, self.codes.shape[1]))
        for b, code in enumerate(self.codes.T):
            if (code == 1).any() and (code == -1).any():
                self.odds[:, b] = np.log(share[code == 1].mean(axis=0)) - np.log(share[code == -1].mean(axis=0))
        margins = share @ self.odds * self.codes  # of each language's own trigrams, by bit
        self.weights = np.clip(margins.min(axis=0), 0.05, None) if langs else np.zeros(0)
        self.weights /= self.weights.sum() or 1

    def decode(self, counts: np.ndarray) -> tuple[str, float, bool]:
        margins = SHARPNESS * (counts @ self.odds) / max(1, counts.sum())
        loss = np.exp(np.clip(-self.codes * margins, -30, 30)) @ self.weights
        likely = 1 / loss
        likely /= likely.sum()
        best = int(np.argmin(loss))
        return self.langs[best], float(likely[best]), bool(len(likely) > 1 and likely[best] < AMBIGUOUS_UNDER)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Decoder:
    """From rows of (doc_id, text, lang); doc_id only picks the sample."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    share = min(1.0, train_docs / max(1, labelled.count()))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_PARTS)) < int(share * SAMPLE_PARTS)).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if has_letter(text):
                    sums[lang] = sums.get(lang, 0) + slot_counts(text)
        for lang, total in sums.items():
            yield pd.DataFrame({"lang": lang, "slot": np.nonzero(total)[0], "n": total[total > 0]})

    sums = sample.mapInPandas(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    rows = sums.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("counts")).orderBy("lang").collect()
    table = np.zeros((len(rows), SLOTS))
    for at, row in enumerate(rows):
        for slot, n in row["counts"]:
            table[at, slot] = n
    return Decoder([r["lang"] for r in rows], table)


def predicted(docs: DataFrame, decoder: Decoder, keep: list[Column]) -> DataFrame:
    """The columns `keep` with lang_pred, score and ambiguous. Predictions read the text alone."""
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = [decoder.decode(slot_counts(t)) if decoder.langs and has_letter(t) else ("und", 0.0, False) for t in texts]
        return pd.DataFrame(found, columns=["lang_pred", "score", "ambiguous"])

    said = F.pandas_udf(predict, "lang_pred string, score double, ambiguous boolean")
    return docs.select(*keep, said(F.col("text")).alias("_sm_said")).select("*", "_sm_said.*").drop("_sm_said")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", is_held_out(F.col("doc_id")))
    return predicted(docs, trained(docs.where("NOT held_out")), [F.col("doc_id"), F.col("held_out")])
