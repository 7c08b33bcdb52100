"""Secret scans with a random forest against false positives, in DataFrame functions only.

Candidates are values, of any length, of assignments to telling names, strings of known key formats, whole blocks of private keys, and
long runs of key characters with a digit. A text parts at its candidates into gaps; neighbouring words are those in the last
`NEAR_BEFORE` characters of the gap before a candidate and the first `NEAR_AFTER` of the gap behind it. Features are length, changes
between character kinds, shares of kinds, common letter pairs, coverage by a dictionary, path, and neighbouring words. The
dictionary has the words of the list below and the `CORPUS_WORDS` that stand in most documents, counted over all of them.

The forest (Spark ML) is trained from labelled findings, rows of (text, path, is_secret): `seed_findings` makes `SEED_FINDINGS` of them
from digests and word lists in Spark, and a caller can add its own.

Defined cases: null and blank texts have no candidates; repeated rows are one document; a document may have any number of
candidates; null sources are an empty path; rows of equal doc_id and text but different sources are judged each by its own path; a private key
without its end reaches as far as its lines do, however many they are; no rows give none.
Redaction keeps all other columns and every other character; columns whose names begin with _sm_ are reserved in it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafmill.llm import common

SEED_FINDINGS = 6000
TREES, DEPTH, SEED = 30, 7, 11
THRESHOLD = 0.5
NEAR_BEFORE, NEAR_AFTER = 48, 24
CORPUS_WORDS = 400
REDACTED = "[REDACTED]"
#: Documents with secrets: a key and some ordinals each; broadcast up to so many rows, shuffled beyond.
BROADCAST_ROWS = 50_000

# Names that secrets are assigned to, key formats, dictionary, letter pairs and neighbouring words.
NAMES = "password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|client[_-]?secret|auth[_-]?token|credential"
FORMATS = {
    "aws": "AKIA[0-9A-Z]{16}",
    "github": "gh[pousr]_[A-Za-z0-9]{36}",
    "slack": "xox[abprs]-[A-Za-z0-9-]{10,}",
    "google": "AIza[0-9A-Za-z_-]{35}",
    "stripe": "[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "jwt": "eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]*",
    "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\\s\\S]*?-----END [A-Z ]*PRIVATE KEY-----|(?:\\s+[A-Za-z0-9+/=]{16,})*+)",
}
DICTIONARY = (
    "access account action admin application archive backup branch build bundle change chapter check chunk class client cluster code commit "
    "common config console content count create data database date debug default delete demo design device directory docs document domain "
    "download driver email enable engine entry error event export file filter folder form format function github global group handler header help "
    "image import index info input item java json library license line link list local login machine manager media menu message method model "
    "module node note output parent password process profile project public python query queue read record release remote request resource "
    "response result schema script search section secret select server service session setting start state static status store switch system "
    "table target task template test text theme time title token update upload user util version"
).split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
HASH_WORDS = "commit|sha|md5|checksum|digest|uuid|guid|etag|revision|integrity|hash|build|version|card|invoice|order|phone|serial|isbn"
PLACEHOLDERS = "example|sample|dummy|placeholder|changeme|your|xxxx|1234|abcd|todo|fake|redacted|environ|getenv|config\\."
TEST_PATHS = "test|spec|fixture|example|sample|mock|docs?/"

ASSIGNED = f"(?i:\\b(?:[a-z]+[_-])?(?:{NAMES})(?:[_-][a-z]+)?)[\"']?\\s{{0,4}}(?::=|=>|[:=])\\s{{0,4}}[\"']?"
KEY_RUN = "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"
CANDIDATE = f"{ASSIGNED}[^\\s\"',;<>#&]+|{'|'.join(FORMATS.values())}|{KEY_RUN}"

FEATURES = ["length", "changes", "digits", "uppers", "lowers", "others", "hex", "kinds", "doubled", "pairs", "covered", "varied", "test_path", "near_name", "near_hash", "placeholder", "assigned", "known"]


class Scanner(NamedTuple):
    """A forest, and the words that its coverage feature counts by."""

    model: RandomForestClassificationModel
    words: tuple[str, ...]


def dictionary(docs: DataFrame, most: int = CORPUS_WORDS) -> tuple[str, ...]:
    """DICTIONARY and the `most` words of 4 to 12 letters that stand in most documents. `most` rows come to the driver."""
    found = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("\\b[a-z]{4,12}\\b"), F.lit(0)))).alias("word"))
    common_words = found.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return tuple(sorted({*DICTIONARY, *(r["word"] for r in common_words.collect())}))


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """A row a candidate: the columns `keep`, no, value, before, after, path, start (in code points) and length."""
    def found(parts: Column) -> Column:
        return F.transform(parts["values"], lambda c, i: F.struct(
            i.alias("no"), c.alias("match"), F.length(F.get(parts["gaps"], i)).alias("gap"),
            F.right(F.get(parts["gaps"], i), F.lit(NEAR_BEFORE)).alias("before"), F.left(F.get(parts["gaps"], i + 1), F.lit(NEAR_AFTER)).alias("after")))

    t = F.col("text")
    matches = common.let(F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)), lambda m: F.when(F.size(m) > 0, common.let(F.struct(m.alias("values"), F.split(t, CANDIDATE, -1).alias("gaps")), found)))
    rows = docs.select(*keep, F.coalesce(F.col("source"), F.lit("")).alias("path"), F.explode(matches).alias("of")).select(*keep, "path", "of.*")
    prefix = F.regexp_extract("match", f"^{ASSIGNED}", 0)
    rows = rows.withColumn("prefix", prefix).withColumn("value", F.expr("substr(match, length(prefix) + 1)")).withColumn("before", F.concat("before", "prefix"))
    return rows


def features(rows: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """`rows` of candidates with their FEATURES as columns of doubles."""
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    share = lambda chars: F.regexp_count(v, F.lit(chars)) / n
    low, near = F.lower(v), F.lower(F.concat_ws(" ", "before", "after"))
    change = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    kinds = sum((F.regexp_like(v, F.lit(k)).cast("int") for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0))
    made = {
        "length": F.length(v), "changes": F.regexp_count(v, F.lit(change)) / n, "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "others": share("[^A-Za-z0-9]"),
        "hex": F.regexp_like(v, F.lit("^[0-9a-fA-F]+$")), "kinds": kinds, "doubled": F.regexp_count(v, F.lit("(.)\\1")) / n, "pairs": F.regexp_count(low, F.lit(f"(?={'|'.join(PAIRS)})")) / n,
        "covered": 1 - F.length(F.regexp_replace(low, "|".join(sorted(words, key=lambda w: (-len(w), w))), "")) / n, "varied": F.size(F.array_distinct(F.split(v, ""))) / n,
        "test_path": F.regexp_like(F.lower("path"), F.lit(TEST_PATHS)), "near_name": F.regexp_like(near, F.lit(NAMES)), "near_hash": F.regexp_like(near, F.lit(HASH_WORDS)),
        "placeholder": F.regexp_like(F.concat_ws(" ", low, near), F.lit(PLACEHOLDERS)), "assigned": F.regexp_like("before", F.lit("[:=]\\s*[\"']?$")), "known": F.regexp_like(v, F.lit(f"^(?:{'|'.join(FORMATS.values())})")),
    }
    return rows.select("*", *[made[k].cast("double").alias(k) for k in FEATURES])


def seed_findings(spark: SparkSession, n: int = SEED_FINDINGS, seed: str = "seed") -> DataFrame:
    """Labelled findings: keys of random digests in contexts of secrets, and things that only look like keys."""
    digest = lambda k: F.sha2(F.concat_ws("/", F.lit(seed), F.lit(k), F.col("id").cast("string")), 256)
    pick = lambda k, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.conv(F.substring(digest(k), 1, 6), 16, 10).cast("long") % len(xs) + 1).cast("int"))
    mixed = lambda k: F.translate(F.base64(F.unhex(digest(k))), "=", "")
    digits = lambda k, size: F.substring(F.translate(digest(k), "abcdef", "503917"), 1, size)
    word = lambda k: pick(k, DICTIONARY)
    plain = lambda k: F.concat_ws(" ", word(f"{k}1"), F.lit("the"), word(f"{k}2"), F.lit("of"), word(f"{k}3"))
    name = pick("name", ["token", "secret", "api_key", "password", "access_key", "client_secret", "AUTH_TOKEN", "db_password"])
    to, quote = pick("to", [" = ", "=", ": ", " := "]), pick("quote", ['"', "'", ""])
    given = lambda value: F.concat(name, to, quote, value, quote)
    usual = pick("path", ["src/main.py", "config/settings.py", "app.env", "src3", "notes.md", "deploy/run.sh"])
    tested = pick("path", ["tests/fixtures/keys.py", "spec/example_spec.rb", "docs/example.md", "test/mock_config.json"])
    kinds = [
        (1, given(F.substring(digest("a"), 1, 40)), usual), (1, given(F.substring(digest("b"), 1, 32)), usual), (1, given(F.substring(mixed("c"), 1, 40)), usual), (1, given(digest("d")), usual),
        (1, F.concat(F.lit("ghp_"), F.substring(F.translate(mixed("e"), "+/", "ab"), 1, 36)), usual), (1, F.concat(F.lit("AKIA"), F.upper(F.substring(digest("f"), 1, 16))), usual),
        (1, given(F.concat(F.substring(mixed("g"), 1, 12), pick("sign", ["!", "$", "?", "-", "_"]))), usual), (1, F.concat(F.lit("sk_live_"), F.substring(F.translate(mixed("h"), "+/", "xy"), 1, 24)), usual),
        (1, F.concat(F.lit("Authorization: Bearer eyJ"), F.substring(mixed("i"), 1, 20), F.lit(".eyJ"), F.substring(mixed("j"), 1, 24), F.lit("."), F.substring(mixed("k"), 1, 30)), usual),
        (1, given(F.substring(digest("l"), 1, 40)), usual), (1, given(F.concat(word("s1"), digits("s2", 1), pick("s3", ["", "!", "7", "x", "$9"]))), usual), (1, given(F.substring(mixed("s4"), 1, 7)), usual),
        (1, F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), mixed("s5"), mixed("s6"), F.lit("\n"), mixed("s7"), F.lit("\n-----END RSA PRIVATE KEY-----")), usual),
        (0, digits("m", 16), usual), (0, F.concat(pick("hash", ["commit ", "sha256: ", "md5 checksum ", "revision ", "digest sha1:"]), F.substring(digest("n"), 1, 40)), usual),
        (0, given(pick("blank", ["xxxxxxxxxxxxxxxxxxxx", "changeme123456", "your-api-key-here-1234", "example_token_000000", "<your-token>12345678", "os.environ['SECRET_1']", "config.get('token_1')"])), usual),
        (0, F.concat(word("o"), F.lit("_"), word("p"), F.lit("_"), word("q"), F.lit("_"), digits("r", 4)), usual), (0, F.concat(F.lit("uuid "), F.regexp_replace(F.substring(digest("s"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")), usual),
        (0, F.concat(F.lit("/"), word("t"), F.lit("/"), word("u"), F.lit("/"), word("v"), F.lit("-"), digits("w", 3)), usual), (0, given(F.substring(digest("x"), 1, 40)), tested),
        (0, F.concat(*[pick(f"y{i}", PAIRS) for i in range(9)], digits("y", 2)), usual), (0, given(F.concat(word("z"), F.lit("-"), word("z1"), F.lit("-"), word("z2"))), usual),
        (0, F.concat(name, to, word("t1")), usual), (0, given(pick("t2", ["None", "null", "true", "false", "str", "required", "optional", "the", "a", "string", "0", "-1", "...", "***", "self", "value"])), usual),
        (0, F.concat(F.lit("serial "), F.upper(F.substring(digest("z3"), 1, 4)), F.lit("-"), digits("z4", 6), F.lit("-"), digits("z5", 6)), usual),
    ]
    of = F.col("id") % len(kinds)
    at = lambda k: F.element_at(F.array(*[F.lit(x[k]) if k == 0 else x[k] for x in kinds]), (of + 1).cast("int"))
    return spark.range(n).select(F.concat_ws(" ", plain("before"), at(1), plain("after")).alias("text"), at(2).alias("path"), (at(0) == 1).alias("is_secret"))


def vectors(rows: DataFrame, words: tuple[str, ...]) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(rows, words))


def trained(labelled: DataFrame, words: tuple[str, ...] = tuple(DICTIONARY), trees: int = TREES, depth: int = DEPTH) -> Scanner:
    """A scanner, from rows of (text, path, is_secret); every candidate of a text has the text's label."""
    rows = candidates(labelled.select("text", F.col("path").alias("source"), F.col("is_secret").cast("double").alias("label")), "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featuresCol="features", labelCol="label")
    return Scanner(forest.fit(vectors(rows, words).select("features", "label")), words)


def judged(rows: DataFrame, scanner: Scanner, threshold: float = THRESHOLD) -> DataFrame:
    """Candidates with score and is_secret."""
    said = scanner.model.transform(vectors(rows, scanner.words)).withColumn("score", F.round(F.element_at(vector_to_array("probability"), 2), 6))
    return said.withColumn("is_secret", F.col("score") >= threshold).drop("features", "rawPrediction", "probability", "prediction", *FEATURES)


def findings(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """A row a candidate of a document: doc_id, no, start, length, sha256, score, is_secret."""
    keyed = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_hash"))
    rows = judged(candidates(keyed, "doc_id", "text_hash"), scanner).dropDuplicates(["doc_id", "text_hash", "path", "no"])
    upto = Window.partitionBy("doc_id", "text_hash", "path").orderBy("no")
    start = F.sum(F.col("gap") + F.length("match")).over(upto) - F.length("value")
    return rows.select("doc_id", "text_hash", F.col("no").cast("long").alias("no"), start.cast("long").alias("start"), F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("sha256"), "score", "is_secret")


def redacted(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """`docs` with each secret replaced in `text`, and `n_chars`, where there is one, counted anew in the texts changed."""
    keyed = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_hash"))
    secrets = judged(candidates(keyed, "doc_id", "text_hash"), scanner).where("is_secret").groupBy("doc_id", "text_hash", "path").agg(F.collect_set("no").alias("_sm_nos"))
    secrets = common.written(secrets.select(F.col("doc_id").alias("_sm_id"), F.col("text_hash").alias("_sm_hash"), F.col("path").alias("_sm_path"), "_sm_nos"), "op3-secrets")
    secrets = common.small_or_shuffled(secrets, BROADCAST_ROWS, 40 + F.length("_sm_path") + 4 * F.size("_sm_nos"))
    same = docs["doc_id"].eqNullSafe(secrets["_sm_id"]) & (F.xxhash64(docs["text"]) == secrets["_sm_hash"]) & (F.coalesce(docs["source"], F.lit("")) == secrets["_sm_path"])
    out = docs.join(secrets, same, "left")
    t, nos = F.col("text"), F.col("_sm_nos")

    def rebuilt(parts: Column) -> Column:
        kept = F.transform(parts["values"], lambda c, i: F.concat(F.get(parts["gaps"], i), F.when(F.array_contains(nos, i), F.concat(F.regexp_extract(c, f"^{ASSIGNED}", 0), F.lit(REDACTED))).otherwise(c)))
        return F.concat(F.array_join(kept, ""), F.element_at(parts["gaps"], -1))

    clean = F.when(nos.isNotNull(), common.let(F.struct(F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)).alias("values"), F.split(t, CANDIDATE, -1).alias("gaps")), rebuilt)).otherwise(t)
    out = out.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(nos.isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    return findings(docs, trained(seed_findings(spark), dictionary(docs))).drop("text_hash")
