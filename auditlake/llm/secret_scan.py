"""Secret scans: candidate strings, native features and a random forest that removes false positives.

A candidate is a run of 16 or more key characters with a digit.  Features: length, character classes and the transitions
between them, coverage by the corpus's own dictionary, the path around it, and the neighbouring words.  The forest is
trained from labelled findings; without labels of both kinds every candidate keeps the share of positives as its score.
Only DataFrame functions and Spark's own forest run; the spans are code point offsets into the text.

A null or empty text has no candidates.  Repeated rows give repeated findings; a null doc_id stays null.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from auditlake.llm.names import free
from auditlake.operators.shuffle import stage

#: A run of key characters holding a digit, not part of a longer run.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_-])"
KEY_WORD = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
TRAINED_ON = 20_000  # labelled findings that the forest is fitted on, at most about
DICTIONARY = 3_000  # most frequent words of four letters or more
THRESHOLD = 0.5
BEFORE, AFTER = 48, 24  # characters beside a candidate in which neighbouring words are sought
FEATURES = (
    "length", "digits", "uppers", "lowers", "others", "transitions", "covered", "in_path", "dots_near", "assigned", "quoted", "key_word", "words_before", "words_after",
)
REPLACEMENT = "[SECRET]"


def dictionary(docs: DataFrame, text: str = "text") -> list[str]:
    """The most frequent lower-case words of the corpus: a list of fixed length, so it may sit in the plan."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("word")).where(F.length("word").between(4, 24))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(DICTIONARY)
    return sorted(r["word"] for r in top.collect())


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per candidate: the row's other columns, ``start``, ``length``, ``value``, ``before`` and ``after``."""
    step = docs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_found", F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    step = step.where(F.size("_found") > 0).withColumn("_parts", F.split(text, CANDIDATE, -1))
    near = F.transform(
        "_found",
        lambda v, i: F.struct(
            v.alias("value"), F.char_length(F.get("_parts", i)).alias("gap"),
            F.right(F.get("_parts", i), F.lit(BEFORE)).alias("before"), F.left(F.get("_parts", i + 1), F.lit(AFTER)).alias("after"),
        ),
    )
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "start", "length", "value", "before", "after", "pos", "near")]
    rows = step.select("_row", *others, F.posexplode(near).alias("pos", "near"))
    rows = rows.withColumn("length", F.char_length("near.value").cast("long"))
    along = W.partitionBy("_row").orderBy("pos")
    end = F.sum(F.col("near.gap") + F.col("length")).over(along)
    return rows.withColumn("start", (end - F.col("length")).cast("long")).select(*others, "start", "length", "near.value", "near.before", "near.after")


def featured(found: DataFrame, words: list[str]) -> DataFrame:
    """Adds ``FEATURES`` as doubles (the length as ``f_length``)."""
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    size = F.col("length").cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    classes = value
    for pattern, sign in ((r"[a-z]+", "a"), (r"[A-Z]+", "A"), (r"[0-9]+", "0"), (r"[^aA0]+", "-")):
        classes = F.regexp_replace(classes, pattern, sign)
    runs = F.split(F.lower(value), r"[^a-z]+")
    known = F.array_intersect(runs, F.lit(words)) if words else F.array().cast("array<string>")
    flag = lambda c: c.cast("double")
    features: dict[str, Column] = {
        "length": size, "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "others": share("[^A-Za-z0-9]"),
        "transitions": (F.char_length(classes) - 1) / size,
        "covered": F.char_length(F.array_join(known, "")) / size,
        "in_path": flag(value.contains("/") | before.rlike(r"[/\\.]$") | before.rlike(r"://\S*$") | after.rlike(r"^[/\\]")),
        "dots_near": flag(before.rlike(r"[.@]$") | after.rlike(r"^[.@][A-Za-z0-9]")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")), "quoted": flag(before.rlike(r"[\"']$")),
        "key_word": flag(before.rlike(KEY_WORD + r"\W{0,5}$")),
        "words_before": F.regexp_count(before, F.lit(r"\p{L}{2,}")).cast("double"), "words_after": F.regexp_count(after, F.lit(r"\p{L}{2,}")).cast("double"),
    }
    return found.withColumns({f"f_{k}": F.coalesce(c, F.lit(0.0)) for k, c in features.items()})


def weak_label() -> Column:
    """1 for a published key format or an assignment to a key word, 0 for card numbers, addresses and paths, else null."""
    value, before = F.col("value"), F.col("before")
    positive = value.rlike(r"^(AKIA|ASIA)[A-Z0-9]{16}$") | value.rlike(r"^gh[pousr]_[A-Za-z0-9]{36}$") | (before.rlike(KEY_WORD + r"\s*[=:]\s*[\"']?$") & ~value.rlike(r"^[0-9/_-]+$"))
    negative = value.rlike(r"^[0-9/_-]+$") | value.rlike(r"^//") | before.rlike(r"://\S*$") | F.col("after").rlike(r"^@[a-z0-9]")
    return F.when(negative, 0.0).when(positive, 1.0)


def findings(docs: DataFrame, labelled: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Candidates of ``docs`` with ``score`` and ``is_secret``.

    ``labelled``: findings (value, length, before, after, label); by default those of ``docs`` that ``weak_label`` decides.
    At most about ``TRAINED_ON`` of them, chosen by a hash, are used.
    """
    words = dictionary(docs, text)
    found = stage(featured(candidates(docs, text), words), "candidates")
    known = (found.withColumn("label", weak_label()) if labelled is None else featured(labelled, words)).where("label is not null")
    n, positive = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < positive < n:
        scored = found.withColumn("score", F.lit(positive / n if n else 1.0))
    else:
        chosen = known.where(F.pmod(F.xxhash64("value", "before"), F.lit(1_000_000)) < F.lit(min(1_000_000, TRAINED_ON * 1_000_000 // n)))
        columns = [f"f_{c}" for c in FEATURES]
        assembler = VectorAssembler(inputCols=columns, outputCol="_features")
        chosen = assembler.transform(stage(chosen.select(*columns, "label"), "labelled"))
        if chosen.select("label").distinct().count() < 2:
            scored = found.withColumn("score", F.lit(positive / n))
        else:
            forest = RandomForestClassifier(labelCol="label", featuresCol="_features", numTrees=24, maxDepth=6, seed=7, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y")
            scored = forest.fit(chosen).transform(assembler.transform(found)).withColumn("score", vector_to_array("_p")[1])
    scored = scored.withColumn("is_secret", F.col("score") >= THRESHOLD)
    return scored.drop("_features", "_p", "_r", "_y")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; the other columns as they are.

    A row is named by a hash of its text, so repeated texts share one list of secrets, at most those of one text.
    """
    name, spans_, pieces_, end_ = (free(docs, n) for n in ("_text", "_spans", "_pieces", "_end"))
    key = F.md5(text)
    secrets = findings(docs.select(F.col(text).alias("text"), key.alias("_text")).where("text is not null")).where("is_secret")
    spans = secrets.groupBy(F.col("_text").alias(name)).agg(F.array_distinct(F.array_sort(F.collect_set(F.struct("start", "length")))).alias(spans_))
    joined = docs.withColumn(name, key).join(spans, name, "left")
    before = lambda i: F.get(spans_, F.greatest(i - 1, F.lit(0)))
    done = lambda i: F.when(i == 0, 0).otherwise(before(i)["start"] + before(i)["length"])
    pieces = F.transform(spans_, lambda s, i: F.concat(F.substring(F.col(text), (done(i) + 1).cast("int"), (s["start"] - done(i)).cast("int")), F.lit(REPLACEMENT)))
    last = F.get(spans_, F.size(spans_) - 1)
    tail = F.expr(f"substring(`{text}`, cast(`{end_}` + 1 as int))")
    joined = joined.withColumn(pieces_, pieces).withColumn(end_, last["start"] + last["length"])
    cleaned = F.when(F.col(spans_).isNull(), F.col(text)).otherwise(F.concat(F.array_join(pieces_, ""), tail))
    return joined.withColumn(text, cleaned).select(*[F.col(f"`{c}`") for c in docs.columns])
