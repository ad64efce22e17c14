"""Secret scan with a random forest that tells secrets from look-alikes.

Candidates are long runs of key characters with a digit. Labelled findings train
a forest on their length, character transitions, dictionary coverage, path and
neighbouring words; it then scores every candidate, which removes the false
positives that a pattern alone lets through.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravalor.llm.common import text_of, words_of
from terravalor.session import materialize

#: A candidate: at least twelve key characters, one a digit, with no key character before.
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{12,}"
#: Characters of context kept on each side for the neighbouring words.
CONTEXT = 48
#: Words of the dictionary, the most documents first, and labelled findings that train the forest.
DICTIONARY = 4096
LABELLED = 20_000
TREES, DEPTH = 40, 8
THRESHOLD = 0.5

#: Words beside a secret, and parts of paths that hold examples.
SECRET_WORDS = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api|key|auth|credential|bearer|private)"
SAMPLE_PATHS = r"(?i)(test|example|sample|fixture|mock|doc)"

FEATURES = (
    "n", "digits", "uppers", "lowers", "others", "distinct", "turns", "alternations", "coverage", "path_depth", "path_sample",
    "word_before", "word_close", "assigned", "quoted", "plain_before", "plain_after", "word_after",
)


def dictionary(docs: DataFrame, text: str = "text", words: int = DICTIONARY) -> list[str]:
    """The words that stand in the most documents: a bounded list, ties in alphabetical order."""
    found = docs.select(F.explode(F.array_distinct(words_of(F.lower(text_of(text))))).alias("word")).where(F.col("word").rlike(r"^\p{L}{3,}$"))
    often = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(words)
    return [r.word for r in materialize(often).orderBy(F.desc("n"), "word").collect()]  # written first: the driver gets the list alone


def candidates(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """A row a candidate: ``row`` (the document but its text), start (in characters), finding, before, after, path."""
    mark = "\x01"
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(None).cast("string").alias("none")])
    marked = F.regexp_replace(F.replace(text_of(text), F.lit(mark), F.lit("\x02")), CANDIDATE, mark + "$0")
    rows = docs.select(kept.alias("row"), (F.col(path).cast("string") if path else F.lit(None).cast("string")).alias("path"), F.split(marked, mark).alias("parts"))
    rows = rows.where(F.size("parts") > 1)
    starts = F.aggregate("parts", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))))
    rows = rows.withColumn("starts", starts)
    each = F.transform(
        F.sequence(F.lit(1), F.size("parts") - 1),
        lambda i: F.struct(F.get("starts", i).cast("long").alias("start"), F.get("parts", i).alias("part"), F.right(F.get("parts", i - 1), F.lit(CONTEXT)).alias("before")),
    )
    out = rows.select("row", "path", F.explode(each).alias("e")).select("row", "path", "e.start", "e.before", "e.part", F.regexp_extract("e.part", r"^[A-Za-z0-9+/_\-]+", 0).alias("finding"))
    return out.select("row", "path", "start", "finding", "before", F.substring(F.col("part"), F.length("finding") + 1, F.lit(CONTEXT)).alias("after"))


def features(found: DataFrame, known: list[str]) -> DataFrame:
    """The findings with the columns of FEATURES."""
    c, n = F.col("finding"), F.length("finding").cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    in_dictionary = lambda x: x.isin(known) if known else F.lit(False)
    runs = F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}{3,}"), F.lit(0)), in_dictionary)
    before = F.lower("before")
    last, next_ = F.regexp_extract(before, r"(\p{L}+)\P{L}*$", 1), F.regexp_extract(F.lower("after"), r"^\P{L}*(\p{L}+)", 1)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return found.withColumns({
        "n": n,
        "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "others": share(r"[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "turns": share(r"(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Z])|(?<=[0-9])(?![0-9])"),
        "alternations": share(r"(?i)[aeiou](?=[bcdfghj-np-tv-z])|[bcdfghj-np-tv-z](?=[aeiou])"),
        "coverage": F.coalesce(F.aggregate(runs, F.lit(0), lambda a, x: a + F.length(x)), F.lit(0)) / n,
        "path_depth": F.coalesce(F.regexp_count(F.col("path"), F.lit("/")), F.lit(0)).cast("double"),
        "path_sample": flag(F.col("path").rlike(SAMPLE_PATHS)),
        "word_before": flag(before.rlike(SECRET_WORDS)),
        "word_close": flag(before.rlike(SECRET_WORDS + r"\P{L}{0,6}$")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(before.rlike(r"[\"'`]$")),
        "plain_before": flag(in_dictionary(last)),
        "plain_after": flag(in_dictionary(next_)),
        "word_after": flag(F.col("after").rlike(SECRET_WORDS)),
    })


class Constant:
    """What a single class, or no labelled finding, teaches."""

    def __init__(self, score: float | None) -> None:
        self.score = score

    def scored(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("score", F.lit(self.score).cast("double"))


class Forest:
    def __init__(self, model: RandomForestClassificationModel, assembler: VectorAssembler) -> None:
        self.model, self.assembler = model, assembler

    def scored(self, rows: DataFrame) -> DataFrame:
        out = self.model.transform(self.assembler.transform(rows))
        return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def train(labelled: DataFrame, bound: int = LABELLED, seed: int = 7) -> Forest | Constant:
    """A forest from findings with features and ``label`` (true, false; null is left out).

    At most ``bound`` findings train it, those of the smallest hashes.
    """
    rows = labelled.where(F.col("label").isNotNull()).orderBy(F.xxhash64("finding", "before", "after"), "finding", "before", "after").limit(bound)
    rows = materialize(rows.select(*FEATURES, F.col("label").cast("double").alias("label")))
    seen = [r.label for r in rows.select("label").distinct().collect()]
    if len(seen) < 2:
        return Constant(seen[0] if seen else None)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=seed)
    return Forest(forest.fit(assembler.transform(rows)), assembler)


def weak_label() -> Column:
    """Labels by format, for tables without labelled findings: provider keys and assigned hex values are
    secrets, plain numbers and dashed words are not, all else is left open."""
    provider = F.col("finding").rlike("^AKIA[0-9A-Z]{16}$")
    assigned = F.col("before").rlike(r"(?i)(password|passwd|pwd|secret|token|api_?key)\s*[=:]\s*[\"']?$") & F.col("finding").rlike("^[0-9a-f]{16,64}$")
    plain = F.col("finding").rlike(r"^[0-9+/_\-]+$|^[A-Za-z]+(-[A-Za-z0-9]+)+$")
    return F.when(provider | assigned, F.lit(True)).when(plain, F.lit(False))


def scan(docs: DataFrame, text: str = "text", path: str | None = None, label: Column | None = None) -> DataFrame:
    """Every candidate of every whole text with ``start``, ``length``, ``finding``, ``score``, ``is_secret`` and its document's columns.

    ``label`` says, over finding, before, after and path, which findings are labelled and how; by
    default ``weak_label``. Null and empty texts have no candidates; neither has an empty table.
    Repeated rows are scanned each; a very long text is scanned as a row; an input column named like
    an output gives way. Without two classes of labelled findings the score is the one label, or
    null with none, and nothing is a secret then.
    """
    found = materialize(features(candidates(docs, text, path), dictionary(docs, text)))
    model = train(found.withColumn("label", weak_label() if label is None else label))
    scored = model.scored(found)
    outputs = {"start": F.col("start"), "length": F.length("finding").cast("long"), "finding": F.col("finding"), "score": F.col("score"), "is_secret": F.coalesce(F.col("score") >= THRESHOLD, F.lit(False))}
    names = [c for c in docs.columns if c != text and c not in outputs]
    return scored.select(*[F.col("row").getField(c).alias(c) for c in names], *[v.alias(k) for k, v in outputs.items()])
