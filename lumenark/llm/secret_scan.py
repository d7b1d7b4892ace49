"""Secret scans in DataFrame functions, with a random forest against false positives.

Candidates are all matches of one alternation of key shapes. Their features
(length, character transitions, dictionary coverage, path, neighbouring words) are
SQL expressions. The forest is trained by Spark's own learner on labelled findings
(by default a generated table) and turned into one SQL expression of nested CASEs, so
scoring is a projection over the candidates: no Python, no vectors.

Defined results: a null text has no findings; repeated rows give repeated findings; an
empty table gives none; matches do not overlap, leftmost first; a null path is an empty
path; extra columns are ignored unless named in `keep`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Shapes of credentials, in order of preference. Values of any length; possessive, so long runs are read once.
SHAPES = {
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    "aws_access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA|akia)[A-Za-z0-9]{16}(?![A-Za-z0-9])",
    "github_token": r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "slack_token": r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+",
    "google_key": r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+",
    "assignment": r"""(?i:(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)["']?[ \t]{0,4}(?::=|=>|[=:])[ \t]{0,4}["']?[A-Za-z0-9_/+.$!@%^&*~-]{8,}+)""",
    "high_entropy": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}+={0,2}+(?![A-Za-z0-9+/_=-])",
}
PATTERN = "|".join(SHAPES.values())
# Words of the dictionary, of secrets' neighbours, of harmless strings' neighbours, of test paths.
DICTIONARY = "example sample test dummy changeme placeholder your insert secret password token value string name user admin default none null true false there this that with from have will what when where which their about would other after first never these think could order because people water little right between under last never start might story while found thought together house world still should public number again great where small every large often important children river carry state without second later idea enough almost above girl sometimes mountain young talk soon list song being leave family color function class return import module version package readme document background international understanding".split()
NEAR_SECRET = "token secret password passwd pwd key apikey auth credential login bearer private".split()
NEAR_HARMLESS = "commit sha sha1 sha256 md5 hash checksum digest uuid guid etag fingerprint revision blob tree integrity".split()
TEST_PATH = "test tests example examples sample fixture fixtures mock docs doc demo spec".split()
FEATURES = ("length", "transitions", "digit_share", "upper_share", "lower_share", "distinct_share", "vowel_turns", "dictionary", "repeats", "test_path", "near_secret", "near_harmless", "shaped", "assigned")
CONTEXT = 48


def _share(value: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{keep}]", "")) / F.greatest(F.length(value), F.lit(1))


def _words(words: list[str]) -> str:
    return "(?<![a-z])(?:" + "|".join(words) + ")(?![a-z])"


def with_features(candidates: DataFrame) -> DataFrame:
    """Adds the features to columns kind, match, before, after, path."""
    value = F.when(F.col("kind") == "assignment", F.regexp_extract("match", r"[=:>][ \t]*[\"']?([^ \t\"']*)$", 1)).otherwise(F.col("match"))
    df = candidates.withColumn("value", value)
    v = F.col("value")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"), "[^0aA]", "-")
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    low = F.lower(v)
    turns = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "[^a-z]", ""), "[aeiouy]", "#"), "[a-z]", "-"), r"(.)\1+", "$1"))
    uncovered = F.length(F.regexp_replace(low, "|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=len, reverse=True)), ""))
    n = F.greatest(F.length(v), F.lit(1))
    near = F.lower(F.concat_ws(" ", "before", F.when(F.col("kind") == "assignment", F.substring("match", 1, 24)), F.substring("after", 1, 16)))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    made = {
        "length": F.least(n, F.lit(200)).cast("double"),
        "transitions": runs / n,
        "digit_share": _share(v, "0-9"),
        "upper_share": _share(v, "A-Z"),
        "lower_share": _share(v, "a-z"),
        "distinct_share": F.size(F.array_distinct(F.split(v, ""))) / n,
        "vowel_turns": turns / n,
        "dictionary": 1 - uncovered / n,
        "repeats": 1 - F.length(F.regexp_replace(v, r"(.)\1{2,}", "$1")) / n,
        "test_path": flag(F.coalesce(F.lower("path"), F.lit("")).rlike(_words(TEST_PATH))),
        "near_secret": flag(near.rlike(_words(NEAR_SECRET))),
        "near_harmless": flag(near.rlike(_words(NEAR_HARMLESS))),
        "shaped": flag(~F.col("kind").isin("assignment", "high_entropy")),
        "assigned": flag(F.col("kind") == "assignment"),
    }
    return df.select("*", *[e.cast("double").alias(k) for k, e in made.items()])


def _kind() -> Column:
    out = F.lit("high_entropy")
    for name, shape in list(SHAPES.items())[-2::-1]:
        bare = re.sub(r"\(\?<![^)]*\)|\(\?![^)]*\)", "", shape)
        out = F.when(F.col("match").rlike(f"^(?:{bare})$"), name).otherwise(out)
    return out


def candidates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", path: str | None = "source") -> DataFrame:
    """Every match with its place (code points, end exclusive) and neighbouring text."""
    src = docs.select(
        *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)],
        (F.col(f"`{path}`").cast("string") if path else F.lit("")).alias("path"),
        F.col(f"`{text}`").cast("string").alias("__text"),
    ).where(F.col("__text").rlike(PATTERN))
    # The row's number depends on the scan alone, so a task that runs again gives the same one.
    src = src.withColumn("__row", F.monotonically_increasing_id())
    cut = src.select("*", F.regexp_extract_all("__text", F.lit(PATTERN), F.lit(0)).alias("__m"), F.split("__text", PATTERN, -1).alias("__p")).drop("__text")
    each = F.transform("__m", lambda m, i: F.struct(m.alias("match"), F.element_at("__p", i + 1).alias("__gap"), F.when(i > 0, F.element_at("__m", F.greatest(i, F.lit(1)))).otherwise("").alias("__last"), F.substring(F.element_at("__p", i + 2), 1, CONTEXT).alias("after")))
    flat = cut.select(*[c for c in src.columns if c != "__text"], F.posexplode(each).alias("__i", "__x")).select("*", "__x.*").drop("__x")
    order = Window.partitionBy("__row").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("__gap") + F.length("match")).over(order)
    placed = flat.withColumn("end", end.cast("bigint")).withColumn("start", F.col("end") - F.length("match")).withColumn("before", F.expr(f"right(concat(__last, __gap), {CONTEXT})"))
    return placed.withColumn("kind", _kind()).select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "path", "kind", "match", "start", "end", "before", "after")


def labelled_findings(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Generated findings with known truth: n rows of kind, match, before, after, path, label. The same on every run."""
    r = lambda k: F.abs(F.xxhash64("id", F.lit(k)))
    pick = lambda options, k: F.element_at(F.array(*map(F.lit, options)), (F.pmod(r(k), F.lit(len(options))) + 1).cast("int"))
    hexes = lambda size, k: F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{k}")), 256), 1, size)
    base = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.col("id").cast("string"), F.lit("/b")), 256))), "[+/=]", "x")
    alnum = lambda size: F.substring(base, 1, size)
    word = pick(["the", "in", "to", "sets", "uses", "with", "our", "from", "value", "line", "here", "note"], 31)
    secret_word, hash_word = pick(NEAR_SECRET, 1), pick(NEAR_HARMLESS, 2)
    plain = F.concat_ws("_", pick(DICTIONARY, 3), pick(DICTIONARY, 4), pick(DICTIONARY, 5), pick(DICTIONARY, 6))
    row = lambda label, kind, match, before, path: F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"), match.alias("match"), before.alias("before"), path.alias("path"))
    src_path, test_path = pick(["app/config.py", "deploy/prod.env", "web/settings.js", "src/main.go", "notes.txt"], 7), pick(["tests/test_auth.py", "docs/example.md", "fixtures/keys.txt"], 8)
    assigned = lambda v: F.concat(secret_word, pick([" = \"", "=", ": '", "=\""], 9), v)
    upper = lambda c: F.when(F.pmod(r(10), F.lit(6)) == 0, F.upper(c)).otherwise(c)
    cases = [
        row(1, "assignment", upper(assigned(hexes(40, "a"))), word, src_path),
        row(1, "assignment", upper(assigned(hexes(18, "c"))), word, src_path),
        row(1, "assignment", upper(assigned(alnum(24))), word, src_path),
        row(1, "aws_access_key", F.concat(F.lit("AKIA"), F.upper(alnum(16))), word, src_path),
        row(1, "github_token", F.concat(F.lit("ghp_"), alnum(36)), word, src_path),
        row(1, "high_entropy", hexes(40, "d"), F.concat(word, F.lit(" "), secret_word, F.lit(" ")), src_path),
        row(1, "aws_access_key", F.concat(F.lit("AKIA"), F.upper(alnum(16))), F.concat(hash_word, F.lit(" ")), src_path),
        row(1, "assignment", upper(assigned(hexes(40, "h"))), F.concat(hash_word, F.lit(" ")), src_path),
        row(0, "high_entropy", hexes(40, "e"), F.concat(word, F.lit(" "), hash_word, F.lit(" ")), src_path),
        row(0, "high_entropy", hexes(64, "f"), F.concat(hash_word, F.lit(": ")), src_path),
        row(0, "high_entropy", F.concat(plain, F.lit("_"), pick(DICTIONARY, 11)), word, src_path),
        row(0, "assignment", assigned(plain), word, src_path),
        row(0, "assignment", assigned(F.concat(F.lit("your-"), pick(DICTIONARY, 12), F.lit("-here"))), word, test_path),
        row(0, "assignment", assigned(F.rpad(pick(["x", "*", "0", "."], 13), 16, "x")), word, src_path),
        row(0, "assignment", assigned(hexes(16, "g")), F.concat(word, F.lit(" example")), test_path),
        row(0, "high_entropy", F.rpad(F.lit("-"), 40, "-_"), word, src_path),
        row(0, "aws_access_key", F.concat(F.lit("AKIA"), F.rpad(F.lit("EXAMPLE"), 16, "X")), word, test_path),
    ]
    each = F.element_at(F.array(*cases), (F.pmod(F.col("id"), F.lit(len(cases))) + 1).cast("int"))
    return spark.range(0, n, 1, 2).select("id", each.alias("c")).select("id", "c.*", F.lit(" ").alias("after"))


def _tree(node, features: tuple[str, ...]) -> str:
    """SQL for the share of secrets at the leaf that a row reaches."""
    if node.subtreeDepth() == 0:
        stats = list(node.impurityStats().stats())
        return repr(stats[1] / max(sum(stats), 1e-9))
    split = node.split()
    return f"CASE WHEN {features[split.featureIndex()]} <= {split.threshold()!r}D THEN {_tree(node.leftChild(), features)} ELSE {_tree(node.rightChild(), features)} END"


def train(findings: DataFrame, trees: int = 12, depth: int = 5, seed: int = 17) -> str:
    """A random forest over labelled findings, as SQL for the chance that a candidate is a secret."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="v").transform(with_features(findings)).select("v", F.col("label").cast("double").alias("label"))
    model = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)
    parts = [_tree(t._call_java("rootNode"), FEATURES) for t in model.trees]
    return "(" + " + ".join(f"({p})" for p in parts) + f") / {len(parts)}"


def scan(docs: DataFrame, forest: str | None = None, findings: DataFrame | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text", path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """Every candidate: the kept columns, kind, match, start, end, score and is_secret."""
    forest = forest or train(findings if findings is not None else labelled_findings(docs.sparkSession))
    scored = with_features(candidates(docs, keep, text, path)).withColumn("score", F.round(F.expr(forest), 6))
    return scored.select(*[F.col(f"`{c}`") for c in keep], "kind", "match", "start", "end", "score", (F.col("score") >= threshold).alias("is_secret"))
