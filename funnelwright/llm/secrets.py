"""Secrets in documents: candidates by shape, false positives removed by a random forest.

All of it in DataFrame expressions and Spark ML. Candidates are runs of 16 or more key characters
with a digit, and values of any shape (SHORT_VALUE characters or more) that are assigned to a
credential's name, follow one, or stand as the password in an address. Their features: length and character mix, transitions between kinds of characters,
coverage by the words that most documents use (counted over all documents), the path of the
document, and the neighbouring words. The forest is trained from labelled findings, a bounded sample
of them chosen by hash; where a corpus has none, ``reviewed`` labels its own findings by what is
beyond doubt on either side, and leaves the rest to the forest.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelwright.llm.common import cut_lineage, fresh, least_count, row_hash

VALUE = r"[A-Za-z0-9+/=_\-]{16,}"
#: Words next to a value that name credentials, and paths whose findings are samples more often.
NAMED = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|credential|bearer)"
#: A value in quotes, without what stands behind them; a value without quotes and closing marks; a name and its value in one word; the password of an address.
SHORT_VALUE = 4
QUOTED = r"""^[(\[{<]*(["'`])([^"'`]+)\1.*$"""
CLOSED = r"""^["'`(\[{<]+|["'`)\]}>,;.]+$"""
INSIDE = NAMED + r"""[A-Za-z0-9_.\-]*["'`]?\s*(?:=>|:=|[=:])["'`]?([^\s"'`,;]{4,})"""
ADDRESS = r"""://[^\s/:@]*:([^\s@/]{4,})@"""
SAMPLE_PATH = r"(?i)(test|example|sample|fixture|mock|demo|doc)"
DICTIONARY, SHORTEST, LONGEST_WORD = 5000, 3, 8
LABELLED, TREES, DEPTH, SEED = 20_000, 20, 6, 17
FEATURES = (
    "length digits upper lower symbols hexadecimal kinds distinct digit_to_letter letter_to_digit case_changes to_vowel "
    "repeats covered path_depth path_sample path_bucket named_before named_two_before assigned quoted before_bucket "
    "after_bucket digits_before"
).split()


def candidates(docs: DataFrame, key: str = "doc_id", path: str = "source") -> DataFrame:
    """(row, key, path, place, value, before, two_before, after): every candidate with its neighbours.

    ``place`` counts the document's words from 0. A word may hold several candidates. ``row`` is a
    hash of id and text: equal rows share it.
    """
    tokens = docs.select(
        row_hash(key).alias("row"),
        F.col(key),
        F.coalesce(F.col(path), F.lit("")).alias("path"),
        "text",
        F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+").alias("tokens"),
    )

    def at(i: Column) -> Column:
        return F.coalesce(F.get("tokens", i), F.lit(""))

    def stripped(token: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(token, QUOTED, "$2"), CLOSED, "")

    def follows(token: Column, before: Column, two_before: Column) -> Column:
        """Is the word assigned to the name before it, or does it follow the name and have a digit?"""
        value = stripped(token)
        assigned = before.rlike("[=:]['\"`]?$") & (before.rlike(NAMED) | (before.rlike("^[=:>]+$") & two_before.rlike(NAMED)))
        return (F.length(value) >= SHORT_VALUE) & (assigned | (before.rlike(NAMED) & (F.length(value) >= 6) & value.rlike("[0-9]")))

    named = F.coalesce(F.col("text").rlike(NAMED) | F.col("text").contains("://"), F.lit(False))
    places = F.filter(
        F.sequence(F.lit(0), F.size("tokens") - 1),
        lambda i: ((F.length(at(i)) >= 16) & at(i).rlike("[0-9]") & at(i).rlike(VALUE))
        | (F.col("named") & (follows(at(i), at(i - 1), at(i - 2)) | at(i).rlike(INSIDE) | at(i).rlike(ADDRESS))),
    )
    tokens = tokens.withColumn("named", named)
    found = tokens.select("row", key, "path", F.explode(F.transform(places, lambda i: F.struct(
        i.alias("place"), at(i).alias("token"), at(i - 1).alias("before"), at(i - 2).alias("two_before"), at(i + 1).alias("after"),
    ))).alias("at")).select("row", key, "path", "at.*")
    runs = F.filter(F.regexp_extract_all("token", F.lit(VALUE), F.lit(0)), lambda v: v.rlike("[0-9]"))
    inside = F.concat(F.regexp_extract_all("token", F.lit(INSIDE), F.lit(2)), F.regexp_extract_all("token", F.lit(ADDRESS), F.lit(1)))
    inside = F.filter(F.transform(inside, stripped), lambda v: F.length(v) >= SHORT_VALUE)
    whole = F.col("token")
    alone = F.when(
        follows(whole, F.col("before"), F.col("two_before")) & (F.size(inside) == 0), F.array(stripped(whole))
    ).otherwise(F.array().cast("array<string>"))
    # Of a value and a run inside it only the value counts.
    near = F.array_distinct(F.concat(inside, alone))
    runs = F.filter(runs, lambda v: ~F.exists(near, lambda w: w.contains(v)))
    return found.withColumn("value", F.explode(F.array_distinct(F.concat(runs, near))))


def dictionary(docs: DataFrame) -> DataFrame:
    """(word): the plain words that most documents use, over all documents: as many as DICTIONARY without a tie."""
    plain = F.filter(
        F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z]+"),
        lambda w: F.length(w).between(SHORTEST, LONGEST_WORD),
    )
    used = cut_lineage(docs.select(F.explode(F.array_distinct(plain)).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    return used.where(F.col("n") >= least_count(used, DICTIONARY)).select("word")


def _coverage(values: DataFrame, known: DataFrame) -> DataFrame:
    """(value, covered): share of a value's characters in dictionary words."""
    spans = F.flatten(F.transform(
        F.sequence(F.lit(1), F.length("value") - SHORTEST + 1),
        lambda i: F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST_WORD)), lambda n: F.struct(i.alias("i"), n.alias("n"))),
    ))
    parts = values.select("value", F.explode(spans).alias("at")).where(F.col("at.i") + F.col("at.n") - 1 <= F.length("value"))
    parts = parts.select("value", "at.*", F.lower(F.substring("value", F.col("at.i"), F.col("at.n"))).alias("word"))
    hit = parts.where(F.col("word").rlike("^[a-z]+$")).join(known, "word")
    places = hit.select("value", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("n") - 1)).alias("place")).distinct()
    return places.groupBy("value").agg((F.count("*") / F.length("value")).alias("covered"))


def _share(pattern: str) -> Column:
    return (F.length("value") - F.length(F.regexp_replace("value", pattern, ""))) / F.length("value")


def _in_address() -> Column:
    return F.col("token").contains("://") & F.col("token").contains(F.concat(F.lit(":"), "value", F.lit("@")))


def _bucket(text: str) -> Column:
    return (F.crc32(F.lower(text).cast("binary")) % 32).cast("double")


def features(found: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates with the columns of FEATURES, all double."""
    covered = _coverage(found.select("value").distinct(), known)
    value, before = F.col("value"), F.col("before")
    characters = F.split("value", "")
    address = _in_address()
    made = {
        "length": F.length("value"),
        "digits": _share("[0-9]"),
        "upper": _share("[A-Z]"),
        "lower": _share("[a-z]"),
        "symbols": _share("[^A-Za-z0-9]"),
        "hexadecimal": _share("[0-9a-fA-F]"),
        "kinds": sum(value.rlike(x).cast("int") for x in ("[0-9]", "[A-Z]", "[a-z]", "[^A-Za-z0-9]")),
        "distinct": F.size(F.array_distinct(characters)) / F.length("value"),
        "digit_to_letter": F.regexp_count("value", F.lit("[0-9](?=[A-Za-z])")) / F.length("value"),
        "letter_to_digit": F.regexp_count("value", F.lit("[A-Za-z](?=[0-9])")) / F.length("value"),
        "case_changes": F.regexp_count("value", F.lit("[a-z](?=[A-Z])|[A-Z](?=[a-z])")) / F.length("value"),
        "to_vowel": F.regexp_count("value", F.lit("(?i)[b-df-hj-np-tv-z](?=[aeiou])")) / F.length("value"),
        "repeats": F.regexp_count("value", F.lit(r"(.)(?=\1)")) / F.length("value"),
        "covered": F.coalesce("covered", F.lit(0.0)),
        "path_depth": F.regexp_count("path", F.lit("/")),
        "path_sample": F.col("path").rlike(SAMPLE_PATH),
        "path_bucket": _bucket("path"),
        "named_before": before.rlike(NAMED) | F.col("token").rlike(NAMED) | address,
        "named_two_before": F.col("two_before").rlike(NAMED),
        "assigned": before.rlike("[=:]$")
        | F.col("token").rlike(r"[=:]['\"]?" + VALUE)
        | F.col("token").rlike(INSIDE)
        | address,
        "quoted": F.col("token").rlike("['\"`]"),
        "before_bucket": _bucket("before"),
        "after_bucket": _bucket("after"),
        "digits_before": before.rlike("[0-9]"),
    }
    return found.join(covered, "value", "left").withColumns({k: v.cast("double") for k, v in made.items()})


def _plain() -> Column:
    """Beyond doubt no secret: digits alone, dictionary words, a link (not the password in one)."""
    link = F.col("token").rlike("(?i)https?:|@") & ~F.col("token").rlike(INSIDE) & ~_in_address()
    return (F.col("digits") == 1) | (F.col("covered") >= 0.8) | link


def _named_mixed() -> Column:
    """Beyond doubt a secret: a mixed value that is assigned to a credential's name."""
    named = (F.col("named_before") + F.col("named_two_before") > 0) & (F.col("assigned") > 0)
    return named & (F.col("kinds") >= 2) & (F.col("distinct") * F.col("length") >= 8) & (F.col("covered") < 0.5)


def reviewed(measured: DataFrame) -> DataFrame:
    """Labels of findings beyond doubt: 1 a mixed value that is assigned to a credential's name, 0 a
    value of digits alone, one of dictionary words, or a link. Others have none."""
    label = F.when(_plain(), 0.0).when(_named_mixed(), 1.0)
    return measured.withColumn("label", label).where("label is not null")


def by_rule() -> Column:
    """Score where no forest can be trained: 0 for what is beyond doubt no secret, and for digests and
    slugs of words and numbers without a credential's name; else 1."""
    value, named = F.col("value"), F.col("named_before") + F.col("named_two_before") > 0
    digest = value.rlike("^([0-9a-f]+|[0-9A-F]+)$") & F.length("value").isin(32, 40, 56, 64, 96, 128)
    slug = value.rlike("^[a-z]+([-_/][a-z]+|[-_/][0-9]+)+$|^[0-9]+([-_/]([a-z]+|[0-9]+))+$")
    return F.when(_plain() | (~named & (digest | slug)), 0.0).otherwise(1.0)


def train(labelled: DataFrame) -> RandomForestClassificationModel | None:
    """Forest of labelled findings (FEATURES and label); None unless both labels occur.

    At most about LABELLED findings, chosen by a hash of row and value, are used.
    """
    sizes = dict(labelled.groupBy("label").count().collect())
    if len(sizes) < 2:
        return None
    scale = 1 << 30
    # Each label has its share, so that neither is lost where the other is common.
    rare = min(1.0, LABELLED / 2 / sizes[1.0]), min(1.0, LABELLED / 2 / sizes[0.0])
    draw = F.pmod(F.xxhash64(F.lit(SEED), "row", "value"), F.lit(scale))
    chosen = labelled.where(draw < F.when(F.col("label") == 1, int(rare[0] * scale)).otherwise(int(rare[1] * scale)))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(chosen)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=2)
    return forest.fit(vectors.select("features", "label").orderBy("label", F.hash("features")).coalesce(1))


def scan(docs: DataFrame, labelled: DataFrame | None = None, key: str = "doc_id", path: str = "source") -> DataFrame:
    """(row, key, place, value, score, is_secret) for every candidate of ``docs``.

    ``labelled``: findings with FEATURES and label; without it the corpus's own reviewed findings.
    ``score`` is the forest's probability; without a forest (no findings of one label) that of
    ``by_rule``. Null and empty texts have no candidates, null paths count as empty.
    """
    found = cut_lineage(features(cut_lineage(candidates(docs, key, path)), dictionary(docs)))
    forest = train(reviewed(found) if labelled is None else labelled)
    if forest is None:
        scored = found.withColumn("score", by_rule())
    else:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
        scored = forest.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return scored.select("row", key, "place", "value", "score", (F.col("score") >= 0.5).alias("is_secret"))


def redacted(docs: DataFrame, found: DataFrame, mark: str = "[secret]", key: str = "doc_id") -> DataFrame:
    """``docs`` with each confirmed value of ``found`` replaced by ``mark``; columns as they were."""
    row, listed = fresh(docs, "row"), fresh(docs, "secret_values")
    values = found.where("is_secret").groupBy(F.col("row").alias(row)).agg(F.collect_set("value").alias(listed))
    # The longest first: one value may be part of another. Short values only as whole words.
    ordered = F.array_sort(listed, lambda a, b: F.length(b) - F.length(a))
    marked = docs.withColumn(row, row_hash(key)).join(values, row, "left")

    def without(text: Column, value: Column) -> Column:
        quoted = F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), value, F.lit(r"\E(?![A-Za-z0-9])"))
        short = (F.length(value) < 16) & ~value.contains("\\")
        return F.when(short, F.regexp_replace(text, quoted, F.lit(mark))).otherwise(F.replace(text, value, F.lit(mark)))

    text = F.when(F.col(listed).isNull(), F.col("text")).otherwise(F.aggregate(ordered, F.col("text"), without))
    return marked.withColumn("text", text).select(docs.columns)
