"""Secret scans: patterns find candidates, a random forest removes false positives.

Candidates are the matches of well-known key formats, of values assigned to names such as password or token, and
of long mixed strings; a candidate is the whole value, whatever its length. Each gets its length, the rate at which
the class of its characters changes, the share of its letter pairs that words have too, distinct characters, shares of
digits, vowels and capitals, the share of its characters that dictionary words cover, its longest such word, its longest
run, what its path speaks of, and which words and characters stand before and after it. A random forest, trained from
labelled findings, gives the probability of a real secret; findings below ``threshold`` are false positives.

DataFrame, SQL and Spark ML functions only. Texts are searched whole; a text without any match is left at once. The
place of a match is the running sum of what lies before it, and a text is put together again from its parts, so a text
with very many matches costs in proportion to its length; one task holds one text and its matches.
The forest is fitted on a bounded table of labelled findings (``labelled``; by default ``synthetic_findings``,
``LABELLED_ROWS`` rows, made from hashes alone).

Null, empty and match-free texts have no findings. A null path counts as empty. Repeated rows repeat their
findings; an empty table gives none. Only ``doc_id``, ``text`` and ``source`` (the path) are read; ``redact``
keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABELLED_ROWS = 6_000
TREES, DEPTH, SEED = 30, 8, 19
THRESHOLD = 0.5
CONTEXT = 60

# Starts and ends of words in ASCII: what \b means outside ASCII differs between versions of Java.
_START, _END = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Key formats, and names whose assigned value may be secret. One alternative for each kind; all but the
# first start with a word. A candidate is the whole value whatever its length: quantifiers are open and possessive, so a
# long one is read once, without recursion. A mixed string is a whole run of its characters that has a digit.
KINDS = {
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+-----END [A-Z ]{0,20}PRIVATE KEY-----",
    "aws_key_id": rf"(?:AKIA|ASIA)[0-9A-Z]{{16}}{_END}",
    "github_token": rf"gh[pousr]_[A-Za-z0-9]{{36,}}+{_END}",
    "google_key": r"AIza[0-9A-Za-z_\-]{35,}+",
    "slack_token": r"xox[abprs]-[0-9A-Za-z\-]{10,}+",
    "json_web_token": r"eyJ[A-Za-z0-9_\-]{10,}+\.[A-Za-z0-9_\-]{10,}+\.[A-Za-z0-9_\-]{10,}+",
    "assigned": r"(?i:(?:password|passwd|pwd|passphrase|secret|token|api[_\-]?key|access[_\-]?key|auth[_\-]?key|credential)s?)[\"']?\s{0,3}(?::=|=>|=|:)\s{0,3}[\"']?[^\s\"'<>,;]{6,}+",
    "mixed_string": r"(?=[A-Za-z0-9_+/\-]{24})(?<=(?:^|[^A-Za-z0-9_+/\-])[+/\-]{0,8})(?=[A-Za-z_+/\-]*+[0-9])[A-Za-z0-9_+/\-]{24,}+={0,2}",
}
ANY = f"{KINDS['private_key']}|{_START}(?:{'|'.join(p for k, p in KINDS.items() if k != 'private_key')})"
ASSIGNED_NAME = r"^(?i:[a-z_\-]{3,12})[\"']?\s{0,3}(?::=|=>|=|:)\s{0,3}[\"']?"

# Words for dictionary coverage.
WORDS = (
    "password passwd pass word secret token admin user username login root test testing demo example sample dummy fake mock default "
    "change changeme here your yours mine insert enter replace value string key keys api access account service client server "
    "host local localhost prod production stage staging dev develop development database data base table index file path name "
    "config configuration setting settings env environment variable public private internal external letmein welcome hello world "
    "qwerty master monkey dragon abc xyz foo bar baz lorem ipsum none null true false undefined todo fixme redacted removed hidden "
    "the and for with this that from version build release branch commit revision hash digest checksum sha md5 uuid guid "
    "please contact support team email phone number code line page site link home image list item order price total date time day "
    "month year first last next back open close start stop read write load save send get set put add new old one two three"
).split()
SAFE = rf"(?i){_START}(?:example|sample|dummy|placeholder|commit|revision|sha1|sha256|md5|checksum|digest|etag|uuid|guid|hash|integrity|build){_END}"
NAMED = r"(?i)(?:pass|pwd|secret|token|key|auth|credential|bearer)"
TEST_PATH = r"(?i)(?:test|spec|example|sample|fixture|mock|demo|doc)"
CONFIG_PATH = r"(?i)(?:config|deploy|secret|credential|\.env|\.pem|\.ya?ml|\.ini)"


def common_pairs(words: Sequence[str] = WORDS, least: int = 2) -> list[str]:
    """Pairs of neighbouring letters that at least so many of the words hold."""
    held = Counter(p for w in set(words) for p in {w[i : i + 2] for i in range(len(w) - 1)} if p.isalpha())
    return sorted(p for p, n in held.items() if n >= least)


FEATURES = [
    "n_chars", "transitions", "pair_share", "n_distinct", "digit_share", "vowel_share", "upper_share", "covered", "longest_word", "longest_run",
    "test_path", "config_path", "safe_before", "safe_after", "named_near", "prose_near", "is_format",
]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, source, i, start, kind, found, candidate, before, after) of all matches; i numbers a text's matches, start counts characters, both from 0."""
    hits = docs.where(F.rlike("text", F.lit(ANY))).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.monotonically_increasing_id().alias("rid"),
        F.split("text", ANY, -1).alias("gap"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("found"),
    )
    parts = hits.select("doc_id", "source", "rid", F.posexplode(F.arrays_zip("gap", "found", F.expr("slice(gap, 2, size(found))"))).alias("i", "m"))
    rows = parts.where("m.found is not null").select("doc_id", "source", "rid", "i", "m.found", F.length("m.gap").alias("skipped"), F.expr(f"right(m.gap, {CONTEXT})").alias("before"), F.expr(f"left(m.`2`, {CONTEXT})").alias("after"))
    upto = Window.partitionBy("rid").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("start", F.sum(F.col("skipped") + F.length("found")).over(upto) - F.length("found"))
    kind = F.coalesce(*(F.when(F.rlike("found", F.lit(f"^(?:{p})$")), F.lit(k)) for k, p in KINDS.items()), F.lit("mixed_string"))
    named = placed.withColumn("kind", kind).withColumn("candidate", F.when(F.col("kind") == "assigned", F.regexp_replace("found", ASSIGNED_NAME, "")).otherwise(F.col("found")))
    return named.select("doc_id", "source", "i", "start", "kind", "found", "candidate", "before", "after")


def features(found: DataFrame) -> DataFrame:
    """found with the columns FEATURES."""
    c, n = F.col("candidate"), F.greatest(F.length("candidate"), F.lit(1)).cast("double")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]", "_"), "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0")
    share = lambda p: F.regexp_count(c, F.lit(p)) / n
    words = "|".join(sorted(set(WORDS), key=lambda w: (-len(w), w)))
    near = F.concat_ws(" ", "before", F.when(F.col("kind") == "assigned", F.col("found")), "after")
    around = F.concat("before", "after")
    flag = lambda x: x.cast("double")
    same = F.length(F.regexp_replace(c, r"(.)\1{2,}", ""))
    hits = F.regexp_extract_all(F.lower(c), F.lit(f"(?:{words})"), F.lit(0))
    return found.withColumns({
        "n_chars": F.least(n, F.lit(200.0)),
        "transitions": (F.length(F.regexp_replace(classes, r"(.)\1*", "x")) - 1) / n,
        "pair_share": F.regexp_count(F.lower(c), F.lit(f"(?=(?:{'|'.join(common_pairs())}))")) / n,
        "n_distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(32.0)),
        "digit_share": share("[0-9]"), "vowel_share": share("[AEIOUaeiou]"), "upper_share": share("[A-Z]"),
        "covered": 1 - F.length(F.regexp_replace(F.lower(c), f"(?:{words})", "")) / n,
        "longest_word": F.coalesce(F.array_max(F.transform(hits, F.length)), F.lit(0)).cast("double"),
        "longest_run": 1 - same / n,
        "test_path": flag(F.rlike("source", F.lit(TEST_PATH))), "config_path": flag(F.rlike("source", F.lit(CONFIG_PATH))),
        "safe_before": flag(F.rlike(F.concat_ws(" ", "before", "candidate"), F.lit(SAFE))), "safe_after": flag(F.rlike("after", F.lit(SAFE))),
        "named_near": flag(F.rlike(near, F.lit(NAMED))),
        "prose_near": F.regexp_count(around, F.lit("[A-Za-z ]")) / F.greatest(F.length(around), F.lit(1)),
        "is_format": flag(~F.col("kind").isin("assigned", "mixed_string")),
    })


def synthetic_findings(spark: SparkSession, rows: int = LABELLED_ROWS, seed: int = SEED) -> DataFrame:
    """Labelled findings made from hashes: real keys in several formats against placeholders, digests, names and runs.

    Paths and the words after a finding are drawn alike for both labels, but for the weights of test and configuration
    paths, so neither tells the label by itself.
    """
    h = lambda salt: F.sha2(F.concat_ws(":", F.lit(str(seed)), "id", F.lit(salt)), 512)
    pick = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    b64 = lambda salt: F.regexp_replace(F.base64(F.unhex(h(salt))), r"[=\r\n]", "")
    upper = F.upper(F.regexp_replace(b64("u"), "[^A-Za-z0-9]", "Q"))
    length = (F.pmod(F.xxhash64("id", F.lit("n")), F.lit(24)) + 16).cast("int")
    two = F.concat(pick(WORDS, "w1"), pick(["_", "-", "", "."], "sep"), pick(WORDS, "w2"), pick(["", "1", "123", "2024", "!"], "tail"))
    named, safe = ["password=", "token = ", "api_key: ", "secret = ", "access_key=", "pwd: "], ["commit ", "sha256 ", "md5 ", "checksum: ", "revision ", "uuid ", "digest ", "example "]
    plain = ["", "see ", "and then ", "value of ", "with the ", "found in "]
    kinds = [  # (label, kind, candidate, words before)
        (1.0, "assigned", F.substr(h("a"), F.lit(1), length), named), (1.0, "assigned", F.substr(b64("b"), F.lit(1), length), named),
        (1.0, "assigned", F.substr(h("g"), F.lit(1), F.lit(40)), named),
        (1.0, "aws_key_id", F.concat(F.lit("AKIA"), F.substr(upper, F.lit(1), F.lit(16))), plain + named),
        (1.0, "github_token", F.concat(F.lit("ghp_"), F.substr(F.regexp_replace(b64("c"), "[^A-Za-z0-9]", "x"), F.lit(1), F.lit(36))), plain + named),
        (1.0, "mixed_string", F.substr(b64("d"), F.lit(1), F.lit(40)), named + ["key ", "bearer ", "secret "]),
        (0.0, "assigned", two, named), (0.0, "assigned", F.concat(F.lit("your_"), two), named),
        (0.0, "assigned", F.repeat(pick(["x", "*", "0", "1", "a", "X"], "r"), length), named),
        (0.0, "mixed_string", F.substr(h("e"), F.lit(1), pick([32, 40, 64], "l")), safe), (0.0, "mixed_string", F.concat_ws("-", two, pick(WORDS, "w3"), pick(WORDS, "w4"), F.lit("2024")), plain),
        (0.0, "aws_key_id", F.concat(F.lit("AKIA"), F.substr(upper, F.lit(1), F.lit(9)), F.lit("EXAMPLE")), plain + named),
    ]
    base = spark.range(rows).withColumn("k", F.pmod(F.xxhash64("id", F.lit("kind")), F.lit(len(kinds))).cast("int"))
    each = lambda f: F.coalesce(*(F.when(F.col("k") == i, f(x)) for i, x in enumerate(kinds)))
    return base.select(
        each(lambda x: F.lit(x[0])).alias("label"), each(lambda x: F.lit(x[1])).alias("kind"), each(lambda x: x[2]).alias("candidate"),
        pick(["", "text ", "line 7: ", "run() "], "lead").alias("lead"), each(lambda x: pick(x[3], "ctx")).alias("ctx"), pick(["", "\n", " and more", "\" ,", " # example", " see docs"], "aft").alias("after"),
        F.when(F.pmod(F.xxhash64("id", F.lit("p0")), F.lit(10)) < F.when(each(lambda x: F.lit(x[0])) == 1.0, F.lit(7)).otherwise(F.lit(4)), pick(["src0", "app/main", "config/prod.yml", "lib/db", "deploy"], "p1")).otherwise(pick(["src0", "src3", "tests/unit", "docs/example", "app/main"], "p2")).alias("source"),
    ).withColumn("found", F.when(F.col("kind") == "assigned", F.concat("ctx", "candidate")).otherwise(F.col("candidate"))).withColumn("before", F.when(F.col("kind") == "assigned", F.col("lead")).otherwise(F.concat("lead", "ctx"))).drop("lead", "ctx")


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> PipelineModel:
    """A random forest over FEATURES for the column label (1: secret, 0: false positive)."""
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="v")
    forest = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=False)
    table = assembler.transform(features(labelled).select("label", *FEATURES)).select("label", "v").coalesce(2)
    return PipelineModel([assembler, forest.fit(table)])


def judged(found: DataFrame, model: PipelineModel, threshold: float = THRESHOLD) -> DataFrame:
    """found with score (probability of a secret) and is_secret."""
    out = model.transform(features(found)).withColumn("score", vector_to_array("probability")[1])
    return out.withColumn("is_secret", F.col("score") >= threshold).drop("v", "rawPrediction", "probability", "prediction", *FEATURES)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each candidate: doc_id, start, length, kind, candidate_sha256, score, is_secret. No secret is returned."""
    model = fit(labelled if labelled is not None else synthetic_findings(docs.sparkSession))
    out = judged(candidates(docs), model, threshold)
    shift = F.length("found") - F.length("candidate")
    return out.select("doc_id", (F.col("start") + shift).cast("bigint").alias("start"), F.length("candidate").cast("bigint").alias("length"), "kind", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


MARK = "[REDACTED]"


def redact(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every secret in its text replaced by MARK; other columns and texts without one stay as they are."""
    model = fit(labelled if labelled is not None else synthetic_findings(docs.sparkSession))
    # the input's columns travel in one struct, so no name of theirs can clash with those of the join
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    path = F.coalesce(F.col("row.source").cast("string"), F.lit(""))
    found = judged(candidates(rows.select(F.xxhash64("row.text").alias("doc_id"), path.alias("source"), F.col("row.text").alias("text"))), model, threshold)
    spots = found.groupBy("doc_id", "source", "i").agg(F.first(F.struct("is_secret", (F.length("found") - F.length("candidate")).alias("shift"))).alias("v"))
    marks = spots.groupBy("doc_id", "source").agg(F.expr("transform(array_sort(collect_list(struct(i, v))), x -> x.v)").alias("mark"), F.max("v.is_secret").alias("any_secret")).where("any_secret")
    marks = marks.selectExpr("doc_id as th", "source as path", "mark")
    joined = rows.join(marks, (F.xxhash64("row.text") == F.col("th")) & (path == F.col("path")), "left")
    there = F.col("mark").isNotNull()
    cut = joined.select("row", "mark", F.when(there, F.split("row.text", ANY, -1)).alias("gap"), F.when(there, F.regexp_extract_all("row.text", F.lit(ANY), F.lit(0))).alias("hit"))
    part = lambda z: F.concat(z["gap"], F.coalesce(F.when(z["mark"]["is_secret"], F.concat(F.left(z["hit"], z["mark"]["shift"]), F.lit(MARK))).otherwise(z["hit"]), F.lit("")))
    text = F.when(F.col("mark").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(F.arrays_zip("gap", "hit", "mark"), part), ""))
    return cut.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
