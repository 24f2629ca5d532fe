"""Secret scans: a random forest removes false positives among secret-like strings.

Candidates are values that stand after a telling name, and long runs of key characters anywhere. The forest sees their
length, the transitions between kinds of characters, how much of them the dictionary of the corpus covers, the path that
they come from and the words beside them. It is trained on labelled findings: secrets of many formats and harmless strings made of
the corpus's own words and numbers, each planted in several dresses. A finding's label is how it was made; no feature holds it.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonority.llm.common import few, met, table, text_or_empty, written
from sonority.llm.spans import matches

# Names that tell of a secret, others that don't, and what stands between a name and its value.
TELLING = ("token", "secret", "passwd", "password", "pwd", "api_key", "apikey", "access_key", "private_key", "auth", "credential")
NEUTRAL = ("id", "name", "file", "version", "title", "path", "number", "label", "key", "hash", "commit", "page")
NAME = "(?i:" + "|".join(TELLING) + ")s?"
LINK = r"""["']?\s{0,3}[:=]\s{0,3}["']?"""
#: A value of six or more characters after a telling name; or a run of sixteen or more key characters with a digit, or in
#: quotes; or a run of thirty-two or more letters.
CANDIDATE = (
    r"(?<![A-Za-z0-9])" + NAME + LINK + r"""[^\s"',;<>]{6,}+"""
    r"""|(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+|(?<=["'])[A-Za-z+/_-]{16,}+|[A-Za-z+/_-]{32,}+)={0,2}"""
)
PREFIX = "^" + NAME + LINK
#: Code points on each side in which the words beside a candidate are looked for, and how many of them count.
REACH, BESIDE = 80, 3
#: A run of four letters is in the dictionary with this share of all such runs, so the dictionary has at most the inverse.
LEAST_SHARE = 4e-6
#: Words and paths that planted findings are made of, planted findings of each format; the forest's size; the threshold.
POOL, PLANTED, TREES, DEPTH, THRESHOLD = 2_000, 300, 40, 8, 0.5
#: Bins of the hashed path and of the hashed words on each side.
PATHS, WORDS = 8, 16


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, path, start, end, value, left, right`` of every candidate in every whole text.

    A value's telling name belongs to ``left``.
    """
    text = text_or_empty()
    found = F.when(text.rlike(CANDIDATE), matches(text, CANDIDATE, context=True))
    held = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"), F.explode(found).alias("m")).select("doc_id", "path", "m.*")
    name = F.regexp_extract("value", PREFIX, 0)
    return held.select(
        "doc_id", "path", (F.col("start") + F.length(name)).alias("start"), "end", F.substring("value", F.length(name) + 1, F.length("value")).alias("value"),
        F.right(F.concat("left", name), F.lit(REACH)).alias("left"), F.left("right", F.lit(REACH)).alias("right"),
    )


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def _turns(value: Column) -> Column:
    """Share of neighbouring characters that are of different kinds: lower case, upper case, digits, others."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "9"), "[^aB9]", "_")
    once = F.regexp_replace(kinds, r"(.)\1+", "$1")
    return (F.length(once) - 1) / F.length(value)


def _grams(letters: Column) -> Column:
    """Runs of four letters, overlapping; found by a look-ahead, which is linear in the word."""
    return F.regexp_extract_all(letters, F.lit("(?=(.{4}))"), F.lit(1))


def words_of(docs: DataFrame) -> DataFrame:
    """``w, n``: words of four to thirty letters in all documents, in lower case, with their number.

    Longer runs of letters are candidates themselves.
    """
    split = docs.select(F.explode(F.split(F.lower(text_or_empty()), r"[^\p{L}]+")).alias("w"))
    return split.where(F.length("w").between(4, 30)).groupBy("w").agg(F.count("*").alias("n"))


def dictionary(words: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """``part``: runs of four letters anywhere in words, those with at least ``least`` of all runs."""
    counts = words.select("n", F.explode(_grams(F.col("w"))).alias("part")).groupBy("part").agg(F.sum("n").alias("n"))
    counts = written(counts, "secret-parts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= F.lit(least * total)).select("part")


def with_features(found: DataFrame, parts: DataFrame) -> DataFrame:
    """Add ``features`` to candidates.

    Coverage is the share of a candidate's runs of four letters that are in the dictionary.
    """
    values = found.groupBy("value").agg(F.count("*").alias("_of"))
    grams = values.select("value", "_of", F.explode_outer(_grams(F.lower(F.regexp_replace("value", "[^A-Za-z]+", "")))).alias("part"))
    covered = grams.join(few(parts.withColumn("known", F.lit(1.0))), "part", "left").groupBy("value").agg(F.max("_of").alias("_of"), F.avg(F.when(F.col("part").isNotNull(), F.coalesce("known", F.lit(0.0)))).alias("_covered"))
    covered = written(covered, "secret-values")
    total = covered.agg(F.sum("_of")).first()[0] or 0
    rows = met(found, covered, "value", "_of", total)
    value, left, right = F.col("value"), F.col("left"), F.col("right")
    before = F.regexp_replace(left, r"""[\s"'=:]+$""", "")
    around = r"(?U)[^\w]+"

    def bins(words: Column) -> Column:
        """Which bins the words fall into."""
        at = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(WORDS)).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.array_contains(at, i).cast("double"))

    said = F.split(F.trim(F.regexp_replace(before, around, " ")), " ")
    told = F.split(F.trim(F.regexp_replace(right, around, " ")), " ")
    single = [
        F.length(value), _share(value, "[^0-9]"), _share(value, "[^A-Z]"), _share(value, "[^a-z]"), _turns(value),
        value.rlike("[0-9]").cast("int") + value.rlike("[a-z]").cast("int") + value.rlike("[A-Z]").cast("int") + value.rlike("[^A-Za-z0-9]").cast("int"),
        value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.coalesce("_covered", F.lit(0.0)), F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        before.rlike(NAME + "$"), left.rlike(r"""[=:]\s*["']?$"""), left.rlike("""["']$""") & right.rlike("""^["']"""),
        left.rlike(r"[@./\\]$") | right.rlike(r"^[@./\\][A-Za-z0-9]"),
    ]
    path = F.transform(F.sequence(F.lit(0), F.lit(PATHS - 1)), lambda i: (F.pmod(F.xxhash64("path"), F.lit(PATHS)) == i).cast("double"))
    array = F.concat(F.array(*[x.cast("double") for x in single]), path, bins(F.slice(F.reverse(said), 1, BESIDE)), bins(F.slice(told, 1, BESIDE)))
    return rows.select(found["*"], array.alias("features"))


def findings(spark: SparkSession, words: DataFrame, paths: DataFrame, each: int = PLANTED, pool: int = POOL, without: tuple[str, ...] = ()) -> DataFrame:
    """Labelled findings ``format, path, value, left, right, label``: ``each`` of every format, the same for the same corpus.

    Label 1: keys, tokens and passwords of several formats; label 0: numbers, dates, versions, compounds and paths of words,
    placeholders and repeated signs. Secrets mostly stand after a telling name and harmless strings mostly don't, but
    either may; what stands beside them are words of the corpus.

    :param words: ``w``; ``paths``: ``path``; of each, ``pool`` at most are taken, by their hash; ``without``: formats to leave out.
    """
    word_list = words.orderBy(F.xxhash64("w"), "w").limit(pool).agg(F.sort_array(F.collect_list("w")).alias("_words"))
    path_list = paths.distinct().orderBy(F.xxhash64("path"), "path").limit(pool).agg(F.sort_array(F.collect_list("path")).alias("_paths"))
    # one row with both lists
    base = spark.range(each).crossJoin(F.broadcast(word_list)).crossJoin(F.broadcast(path_list))

    def draw(salt: str, n) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n) if isinstance(n, int) else n).cast("int")

    def one(column: str, salt: str) -> Column:
        return F.coalesce(F.get(column, draw(salt, F.greatest(F.size(column), F.lit(1)))), F.lit("word"))

    def pick(options: tuple, salt: str) -> Column:
        return F.get(F.array(*map(F.lit, options)), draw(salt, len(options)))

    def hexadecimal(salt: str) -> Column:
        return F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(salt)), 256)

    def mixed(salt: str) -> Column:
        return F.regexp_replace(F.base64(F.unhex(F.concat(hexadecimal(salt), hexadecimal(salt + "+")))), "[+/=\\s]", "")

    def word(salt: str) -> Column:
        return one("_words", salt)

    digits = F.translate(F.concat(hexadecimal("d"), hexadecimal("e")), "abcdef", "012345")
    cut = F.substring
    secret = {
        "hex": cut(hexadecimal("a"), F.lit(1), pick((20, 32, 40, 40, 64), "l")), "upper": F.upper(cut(hexadecimal("b"), F.lit(1), pick((32, 40, 64), "l"))),
        "base64": cut(F.base64(F.unhex(F.concat(hexadecimal("c"), hexadecimal("c2")))), F.lit(1), 20 + draw("l", 24)), "mixed": cut(mixed("m"), F.lit(1), 16 + draw("l", 25)),
        "password": F.concat(cut(mixed("p"), F.lit(1), 4 + draw("l", 5)), pick(("!", "#", "_", "-", "%", "$"), "s"), cut(mixed("q"), F.lit(1), 3 + draw("k", 6))),
        "prefixed": F.concat(pick(("AKIA", "ghp_", "sk_live_", "xoxb-", "glpat-"), "f"), cut(mixed("r"), F.lit(1), 16 + draw("l", 20))),
        "uuid": F.regexp_replace(cut(hexadecimal("u"), F.lit(1), F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
    }
    harmless = {
        "digits": cut(digits, F.lit(1), 12 + draw("l", 12)), "dates": F.regexp_replace(cut(digits, F.lit(1), F.lit(14)), "^(..)(..)(..)(..)(..)(..)..$", "20$1-$2-$3T$4-$5-$6"),
        "version": F.concat(word("v"), F.lit("-"), draw("x", 20), F.lit("-"), draw("y", 30), F.lit("-"), draw("z", 90)), "snake": F.concat_ws("_", word("1"), word("2"), word("3")),
        "slashes": F.concat_ws("/", word("1"), word("2"), word("3"), draw("n", 2030)), "camel": F.concat(word("1"), F.initcap(word("2")), F.initcap(word("3")), draw("n", 99)),
        "compound": F.concat(word("1"), word("2"), word("3"), word("4")), "placeholder": F.concat(pick(("your_", "my-", "example_", "<", "test-", ""), "p"), word("1"), pick(("_here", "_token", "-123456", ">", "_2024", "_goes_here"), "q")),
        "repeated": F.repeat(pick(("x", "0", "-", "_", "ab", "*", "1234"), "r"), 8 + draw("l", 24)), "word": F.concat(word("1"), word("2")),
    }
    # how a name and its value are linked; or no name at all
    link = pick(('="', ' = "', ": ", "=", ' = "', "='"), "link")
    quote = F.regexp_extract(link, "[\"']$", 0)

    def dressed(kinds: dict, label: int, telling: int, neutral: int) -> DataFrame:
        rows = base.withColumn("f", F.explode(F.array(*[F.struct(F.lit(k).alias("format"), v.alias("value")) for k, v in kinds.items() if k not in without])))
        # each format stands in dresses of its own
        chance = F.pmod(F.xxhash64("id", "f.format", F.lit("dress")), F.lit(100))
        name = F.when(chance < telling, pick(TELLING, "name")).otherwise(pick(NEUTRAL, "name"))
        name = F.when(draw("case", 4) == 0, F.upper(name)).otherwise(name)
        bare = chance >= telling + neutral
        return rows.select(
            "f.format", one("_paths", "path").alias("path"), "f.value", F.concat_ws(" ", word("la"), word("lb"), F.when(bare, F.lit("")).otherwise(F.concat(name, link))).alias("left"),
            F.concat(F.when(bare, F.lit("")).otherwise(quote), F.lit(" "), word("ra"), F.lit(" "), word("rb")).alias("right"), F.lit(float(label)).alias("label"),
        )

    return dressed(secret, 1, 75, 10).union(dressed(harmless, 0, 25, 25))


def fit(planted: DataFrame, parts: DataFrame):
    """The forest, trained on labelled findings, whose number is bounded by how many are planted."""
    train = with_features(planted, parts).select(array_to_vector("features").alias("features"), "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, labelCol="label", featuresCol="features", featureSubsetStrategy="0.4").fit(train)


def judged(found: DataFrame, parts: DataFrame, forest, threshold: float = THRESHOLD) -> DataFrame:
    """``found`` with ``score`` and ``secret``."""
    rows = with_features(found, parts).withColumn("features", array_to_vector("features"))
    scored = forest.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select(found["*"], "score", (F.col("score") >= threshold).alias("secret"))


def scan(docs: DataFrame, planted: int = PLANTED, threshold: float = THRESHOLD) -> DataFrame:
    """Score every candidate of every whole text.

    :param docs: ``doc_id, text, source`` and any other columns, which are ignored. Null and empty texts have no
        candidates; a null source is an empty path; repeated rows are all scanned, and get the same scores. An empty table gives
        no rows. The dictionary is counted over all documents.
    :return: ``doc_id, start, end, value_sha256, score, secret``, a row for each candidate; values stay in the documents.
    """
    spark = docs.sparkSession
    found = written(candidates(docs), "secret-candidates")
    words = written(words_of(docs), "secret-words")
    parts = written(dictionary(words), "secret-dictionary")
    paths = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"))
    forest = fit(written(findings(spark, words, paths, planted), "secret-findings"), parts)
    return judged(found, parts, forest, threshold).select("doc_id", "start", "end", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", "secret")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
