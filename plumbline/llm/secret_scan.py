"""Secret scanning with a random forest that removes false positives, in DataFrame functions and Spark ML only.

Candidates are tokens of 12 characters or more with a digit, and any value assigned to a name such as password. Each is described by its length,
kinds and transitions of characters, the share that dictionary words cover, the path it stands in and its neighbouring
words; a forest trained on labelled findings decides whether it is a secret.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that make a token look like text, and neighbours that speak for or against a secret.
DICTIONARY = ("access", "account", "admin", "and", "app", "auth", "build", "change", "client", "code", "config", "data", "default", "dev", "document", "dummy", "email", "example", "fake", "file", "for", "from", "function", "here", "home", "http", "image", "index", "insert", "item", "key", "label", "last", "line", "list", "local", "mail", "main", "message", "name", "none", "null", "number", "object", "order", "page", "pass", "password", "path", "place", "public", "release", "sample", "secret", "section", "server", "service", "setting", "some", "string", "table", "test", "that", "the", "this", "time", "title", "token", "type", "update", "user", "value", "version", "with", "word", "your")
SPEAKS_FOR = ("password", "passwd", "pwd", "secret", "token", "api[_-]?key", "apikey", "access[_-]?key", "auth", "bearer", "credential", "private")
SPEAKS_AGAINST = ("example", "sample", "dummy", "placeholder", "commit", "revision", "checksum", "digest", "md5", "sha1", "sha256", "uuid", "guid", "isbn", "version", "build", "id")
TEST_PATH = "test|example|sample|fixture|mock|demo|doc"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+={0,2}(?![A-Za-z0-9+/_-])"
#: A name that speaks for a secret, a sign or word of assignment, and the value: quoted, or up to white space without closing punctuation.
ASSIGNED = r"(?i)(?:(?:" + "|".join(SPEAKS_FOR) + r""")(?:s|[_.-]?key|[_-][a-z0-9_-]*+)?["'\]]*\s*(?:=>|:=|==?|:|\sis\s)|bearer\s)\s*["']?((?<=")[^"\r\n]+(?=")|(?<=')[^'\r\n]+(?=')|[^\s"']*[^\s"',;.)\]}])"""
NEAR = 40
FEATURES = ("length", "digits", "uppers", "lowers", "symbols", "kinds", "transitions", "distinct", "vowels", "hex", "runs", "words", "test_path", "speaks_for", "speaks_against", "assigned", "quoted")


def matches(pattern: str, group: int) -> Column:
    """finding, at (characters before it and 1), byte (bytes before it) of each match in text; the group ends where the match does."""
    whole, value = (F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in (0, group))
    between = F.slice(F.split("text", pattern, -1), F.lit(1), F.size(whole))
    sizes = F.zip_with(between, whole, lambda a, b: F.struct((F.length(a) + F.length(b)).alias("chars"), (F.octet_length(a) + F.octet_length(b)).alias("bytes")))
    start = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("bytes"), F.array().cast("array<struct<chars:int,bytes:int>>").alias("all"))

    def step(s: Column, x: Column) -> Column:
        chars, octets = s["chars"] + x["chars"], s["bytes"] + x["bytes"]
        return F.struct(chars.alias("chars"), octets.alias("bytes"), F.concat(s["all"], F.array(F.struct(chars.alias("chars"), octets.alias("bytes")))).alias("all"))

    ends = F.aggregate(sizes, start, step)["all"]
    return F.zip_with(value, ends, lambda v, end: F.struct(v.alias("finding"), (end["chars"] - F.length(v) + 1).alias("at"), (end["bytes"] - F.octet_length(v)).alias("byte")))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, path, finding, at, before, after for every place of a candidate; a place that both patterns find comes once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("text").rlike(CANDIDATE) | F.col("text").rlike(ASSIGNED))
    rows = rows.withColumn("m", F.explode(F.array_distinct(F.concat(matches(CANDIDATE, 0), matches(ASSIGNED, 1)))))
    # places in bytes, so that a neighbour is found without counting characters from the start of a long text; a character
    # has four bytes at most
    data, at, finding = F.col("text").cast("binary"), F.col("m.byte"), F.col("m.finding")
    wide = 4 * NEAR
    before = F.substring(data, F.greatest(at - wide, F.lit(0)) + 1, F.least(at, F.lit(wide))).cast("string")
    before = F.substring(before, F.greatest(F.length(before) - NEAR, F.lit(0)) + 1, F.lit(NEAR))
    after = F.substring(F.substring(data, at + F.octet_length(finding) + 1, F.lit(wide)).cast("string"), 1, NEAR)
    return rows.select("doc_id", "path", finding.alias("finding"), F.col("m.at").alias("at"), before.alias("before"), after.alias("after"))


def share(pattern: str, text: Column) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def features(found: DataFrame) -> DataFrame:
    """found (finding, path, before, after) with FEATURES; nulls count as empty texts."""
    text, path, before, after = (F.coalesce(F.col(c), F.lit("")) for c in ("finding", "path", "before", "after"))
    lower = F.lower(text)
    near = F.lower(F.concat_ws(" ", before, after))
    cover = F.lit(1.0) - F.length(F.regexp_replace(lower, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / F.greatest(F.length(lower), F.lit(1))
    word = lambda terms: F.regexp_count(near, F.lit(r"(?<![a-z0-9])(?:" + "|".join(terms) + r")(?![a-z0-9])"))
    made = {
        "length": F.length(text),
        "digits": share("[0-9]", text),
        "uppers": share("[A-Z]", text),
        "lowers": share("[a-z]", text),
        "symbols": share("[^A-Za-z0-9]", text),
        "kinds": sum((text.rlike(p).cast("int") for p in ("[0-9]", "[A-Z]", "[a-z]", "[^A-Za-z0-9]")), F.lit(0)),
        "transitions": share("(?<=[a-z])(?=[0-9A-Z])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[0-9a-z])", text),
        "distinct": F.size(F.array_distinct(F.split(text, ""))) / F.greatest(F.length(text), F.lit(1)),
        "vowels": share("[aeiou]", lower),
        "hex": text.rlike("^[0-9a-fA-F-]+$").cast("int"),
        "runs": share(r"(.)\1", text),
        "words": cover,
        "test_path": F.lower(path).rlike(TEST_PATH).cast("int"),
        "speaks_for": word(SPEAKS_FOR),
        "speaks_against": word(SPEAKS_AGAINST),
        "assigned": before.rlike(r"[:=]\s*[\"']?$").cast("int"),
        "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("int"),
    }
    return found.select("*", *(F.coalesce(made[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES))


def labelled_findings(spark: SparkSession, n: int = 4000, seed: int = 11) -> DataFrame:
    """n labelled findings (finding, path, before, after, label) drawn from the formats of secrets and of what is mistaken for them."""
    draw = lambda k, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(m)).cast("int")
    pick = lambda k, items: F.element_at(F.array(*map(F.lit, items)), draw(k, len(items)) + 1)
    hexes = F.concat(*(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"{seed}/{k}")), 256) for k in range(2)))
    base64 = F.regexp_replace(F.base64(F.unhex(hexes)), "[\\r\\n=]", "")
    upper = F.translate(F.upper(F.regexp_replace(base64, "[^A-Za-z0-9]", "")), "0189", "7654")
    words = F.concat_ws("-", *(pick(20 + k, DICTIONARY) for k in range(3)))
    hex_at = lambda k: F.substring(hexes, 1, k)
    name = pick(1, ("password", "token", "secret", "api_key", "auth", "access_key", "passwd"))
    filler = F.concat_ws(" ", pick(2, DICTIONARY), pick(3, DICTIONARY), pick(4, DICTIONARY))
    after = F.concat(F.lit(" "), pick(5, DICTIONARY), F.lit(" "), pick(6, DICTIONARY))
    f = lambda finding, before, after, label: F.struct(finding.alias("finding"), before.alias("before"), after.alias("after"), F.lit(float(label)).alias("label"))
    plain = F.concat(filler, F.lit(" "))
    assigned = F.concat(filler, F.lit(" "), name, pick(24, ("=", ": ")))
    letters = F.regexp_replace(base64, "[^A-Za-z]", "")
    kinds = [
        f(F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), plain, after, 1),
        f(F.concat(F.lit("AKIA"), F.substring(upper, 5, 16)), F.concat(filler, F.lit(" "), name, F.lit("=")), after, 1),
        f(hex_at(40), F.concat(filler, F.lit(" "), name, F.lit(' = "')), F.concat(F.lit('"'), after), 1),
        f(hex_at(18), F.concat(filler, F.lit(" "), name, F.lit("=")), after, 1),
        f(F.substring(base64, 1, 32), F.concat(filler, F.lit(" "), name, F.lit(": ")), after, 1),
        f(F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(base64, "[^A-Za-z0-9]", "x"), 1, 36)), plain, after, 1),
        f(F.substring(base64, 1, 40), F.concat(filler, F.lit(" bearer ")), after, 1),
        f(F.regexp_replace(F.initcap(F.regexp_replace(words, "-", " ")), " ", ""), assigned, after, 1),
        f(F.concat(F.substring(letters, 1, 5), F.lit("!"), F.substring(hexes, 1, 2), F.lit("$"), F.substring(letters, 6, 4), F.lit("@"), draw(17, 99).cast("string")), assigned, after, 1),
        f(F.substring(base64, 1, 8), assigned, after, 1),
        f(F.substring(letters, 1, 20), assigned, after, 1),
        f(F.repeat(base64, 12), F.concat(filler, F.lit(" private_key=")), after, 1),
        f(F.concat(F.substring(F.repeat(letters, 2), 1, 48), draw(18, 99999).cast("string")), assigned, after, 1),
        f(pick(19, DICTIONARY), assigned, after, 0),
        f(F.concat(F.lit("<"), words, F.lit(">")), assigned, after, 0),
        f(hex_at(40), F.concat(filler, F.lit(" commit ")), after, 0),
        f(hex_at(32), F.concat(filler, F.lit(" md5 checksum: ")), after, 0),
        f(hex_at(64), F.concat(filler, F.lit(" sha256 digest ")), after, 0),
        f(F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), F.concat(filler, F.lit(" uuid ")), after, 0),
        f(F.concat(words, F.lit("-"), draw(7, 99).cast("string")), plain, after, 0),
        f(F.concat(F.lit("/"), F.regexp_replace(words, "-", "/"), F.lit("/"), draw(8, 999).cast("string")), plain, after, 0),
        f(F.concat(F.lit("your_"), F.regexp_replace(words, "-", "_"), F.lit("_"), draw(9, 9).cast("string")), F.concat(filler, F.lit(" "), name, F.lit("=")), after, 0),
        f(F.concat(pick(10, ("xxxxxxxxxxxx", "000000000000", "123456789012", "changeme1234")), F.substring(F.lit("000000"), 1, draw(11, 6))), F.concat(filler, F.lit(" "), name, F.lit("=")), after, 0),
        f(F.concat_ws("-", (draw(12, 30) + 1990).cast("string"), F.lpad((draw(13, 12) + 1).cast("string"), 2, "0"), F.lpad((draw(14, 28) + 1).cast("string"), 2, "0"), F.lpad(draw(15, 9999).cast("string"), 4, "0")), plain, after, 0),
        f(F.lpad(F.abs(F.xxhash64("id")).cast("string"), 16, "7"), F.concat(filler, F.lit(" id ")), after, 0),
    ]
    path = pick(16, ("src", "src3", "src12", "web/app", "conf/prod", "tests/unit", "docs/example"))
    rows = spark.range(n).withColumn("k", draw(0, len(kinds))).withColumn("f", F.element_at(F.array(*kinds), F.col("k") + 1))
    return rows.select("f.finding", path.alias("path"), "f.before", "f.after", "f.label")


def train(labelled: DataFrame, trees: int = 20, depth: int = 7, seed: int = 5) -> RandomForestClassificationModel:
    """labelled: finding, path, before, after, label (1.0 a secret, 0.0 not), a bounded sample; rows without a label are left out."""
    rows = features(labelled.filter("label is not null").coalesce(1))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows).select("x", F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8).fit(rows)


def score(found: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(features(found))
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction", *FEATURES)


def scan(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, at, n_chars, shown, sha256, score, is_secret for each place of a candidate in docs (doc_id, source, text).

    at is the place (from 1) in the text; each place is judged by its own neighbours. shown hides all but its first four characters. A null or
    empty text has none; rows that repeat a document repeat its findings; other columns are ignored; an empty table gives
    no rows.
    """
    out = score(candidates(docs), model)
    shown = F.concat(F.substring("finding", 1, 4), F.lit("..."))
    return out.select("doc_id", F.col("at").cast("long").alias("at"), F.length("finding").cast("long").alias("n_chars"), shown.alias("shown"), F.sha2("finding", 256).alias("sha256"), F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("is_secret"))
