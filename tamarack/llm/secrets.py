"""Secret scan: candidates by pattern, false positives removed by a random forest, in DataFrame operations only.

A candidate is a value assigned to a name such as password or access_key_id, or a run of 16 or more
characters of keys and digests that has a digit, begins with the prefix of a key format, changes between
capitals and small letters three times or more, or begins with 16 capitals. The forest sees its length, its character transitions, how much of it
a dictionary covers, the path it lies under and the words beside it, and is trained on labelled findings.
The dictionary holds the words that several different texts of the corpus share, counted over all of it.
Texts are cut at candidates, so each has its neighbours and its place without a second search.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.llm import common
from tamarack.scratch import Scratch

TREES, DEPTH, LEAST, SEED = 30, 8, 0.5, 5
BESIDE = 48
#: Partitions that labelled findings are dealt to.
TRAINING_PARTS = 4
#: Texts that must share a word for it to be in the dictionary.
SHARED = 3

_NAMES = r"passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential"
_ENDED = r"(?:[_-][A-Za-z0-9]{1,16}){0,2}"
_ASSIGNED = rf"(?i:(?:{_NAMES}){_ENDED}[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?[^\s\"']{{8,}})"
_PARTS = rf"^((?i:(?:{_NAMES}){_ENDED}[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?))([^\s\"']{{8,}})$"
# Prefixes of public key formats, common words in code and prose, frequent English letter pairs.
_PREFIXES = "AKIA|ASIA|gh[pousr]_|github_pat_|sk-|sk_live_|xox[abp]-|eyJ|glpat-|AIza|npm_"
_RUN = rf"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9]|{_PREFIXES}|[a-z_+/=-]*+(?:[A-Z]++[a-z_+/=-]++){{3}}|[A-Z]{{16}})[A-Za-z0-9_+/=-]{{16,}}"
CANDIDATE = f"{_ASSIGNED}|{_RUN}"
_WORDS = (
    "test|example|sample|dummy|placeholder|your|here|change|replace|insert|key|token|secret|password|user|name|data|file|path|version|release|build|image|config|value|null|none|true|false|default|admin|root|local|host|server|client|https|http|www|com|org|index|page|item|list|string|number|object|class|function|return|import|public|private|static|module|package|service|report|section|table|figure|chapter|model|layer|block|the|and|for|with"
)
_PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce"

FEATURES = (
    "length", "digits", "upper", "lower", "symbols", "hex", "only_digits", "uuid", "transitions", "distinct", "run", "pairs", "vowels", "code_words", "dictionary",
    "slashes", "test_path", "in_url", "named", "assigned", "quoted", "digest_word", "number_word", "prefix",
)


def features(value: Column, left: Column, right: Column, path: Column, covered: Column) -> list[Column]:
    """The forest's inputs, in the order of ``FEATURES``; ``covered``: letters of the value in words of the dictionary."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    low, beside, near = F.lower(value), F.lower(left), F.lower(F.coalesce(path, F.lit("")))
    share = lambda text, pattern: F.regexp_count(text, F.lit(pattern)) / n
    has = lambda text, pattern: text.rlike(pattern).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"), "[^0aA]", "-")
    columns = [
        F.log2(n), share(value, "[0-9]"), share(value, "[A-Z]"), share(value, "[a-z]"), share(value, "[^A-Za-z0-9]"), has(value, "^[0-9a-fA-F]+$"), has(value, "^[0-9]+$"),
        has(value, "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"), (F.length(F.regexp_replace(kinds, r"(.)\1*", "x")) - 1) / n,
        F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64.0)), has(value, r"(.)\1{3,}"), share(low, _PAIRS), share(low, "[aeiou]"), 1 - F.length(F.regexp_replace(low, _WORDS, "")) / n,
        F.coalesce(covered, F.lit(0)) / n,
        share(value, "/"), has(near, "test|spec|fixture|example|sample|mock|doc"), has(beside, r"(?:://|www\.)\S*$"), has(beside, rf"(?:{_NAMES}|bearer){_ENDED}[^a-z]{{0,8}}$"), has(beside, r"[:=]\s*[\"']?$"),
        (has(beside, r"[\"']$") * has(right, r"^[\"']")), has(beside, r"(?:commit|sha-?\d*|md5|checksum|digest|hash|etag|rev|revision|uuid|guid|blob|tree)[^a-z]{0,8}$"), has(beside, r"(?:card|phone|tel|no|number|isbn|order|invoice|id|version)[^a-z]{0,4}$"), has(value, f"^(?:{_PREFIXES})"),
    ]
    return [c.cast("double").alias(name) for c, name in zip(columns, FEATURES, strict=True)]


def words_of(text: Column) -> Column:
    """Words of four letters or more, lower case, parted where capitals begin."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), F.lit("[a-z]{4,20}"), F.lit(0))


def dictionary(docs: DataFrame, shared: int = SHARED) -> DataFrame:
    """(word): runs of 4 to 20 letters that ``shared`` documents have, not all of them of one text, so that copies of a key add nothing."""
    each = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("of"), F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word"))
    counted = each.where(F.length("word").between(4, 20)).groupBy("word").agg(F.count("*").alias("n"), F.min("of").alias("low"), F.max("of").alias("high"))
    return counted.where((F.col("n") >= shared) & (F.col("low") < F.col("high"))).select("word")


def covered(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``covered`` to rows with an ``id`` and a ``value``: letters of the value in words of the dictionary."""
    tokens = rows.select("id", F.explode(words_of(F.col("value"))).alias("word"))
    letters = tokens.join(words, "word").groupBy("id").agg(F.sum(F.length("word")).alias("covered"))
    return rows.join(letters, "id", "left")


def labelled_findings(spark: SparkSession, words: DataFrame | None = None, each: int = 60, seed: int = SEED) -> DataFrame:
    """Findings with labels made by rule: (value, left, right, path, label), ``each`` of every kind below.

    True ones are random keys in the places where keys stand. False ones are what scanners mistake for keys:
    digests, identifiers, card and phone numbers, slugs, version strings, placeholders, counters, and, with a
    dictionary, names and slugs made of ``3 * each`` of its words.
    """
    some = [r.word for r in words.orderBy(F.xxhash64(F.lit(seed), "word"), "word").limit(3 * each).collect()] if words is not None else []
    word = lambda k: F.get(F.col("own"), F.pmod(3 * F.col("i") + k, F.lit(max(1, len(some)))).cast("int"))
    hexed = lambda salt: F.sha2(F.concat_ws("|", F.lit(f"{seed}{salt}"), F.col("i").cast("string")), 256)
    based = lambda salt: F.regexp_replace(F.base64(F.unhex(F.concat(hexed(salt), hexed(salt + "+")))), "[+/=\n]", "")
    letters = lambda salt: F.translate(based(salt), "0123456789", "gHjKmPqRsT")
    digits = lambda salt, n: F.substring(F.regexp_replace(F.concat(hexed(salt), hexed(salt + "+")), "[a-f]", ""), 1, n)
    pick = lambda *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), (F.pmod(F.xxhash64(F.lit(len(xs)), "i"), F.lit(len(xs))) + 1).cast("int"))
    said = lambda: pick("the of and ", "in this we find ", "der die das und ", "le la les de ", "el la de que ", "see ")
    name = lambda: pick("token = \"", "api_key: \"", "secret='", "PASSWORD = \"", "access_key=\"", "auth_token: '", "TOKEN = \"")
    kinds = [
        (F.substring(hexed("a"), 1, 40), F.concat(said(), name()), F.lit("\" x"), 1), (F.upper(F.substring(hexed("b"), 1, 40)), F.concat(said(), name()), F.lit("\"!! X"), 1), (F.substring(based("c"), 1, 32), F.concat(said(), name()), F.lit("'"), 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(based("d"), 1, 16))), said(), F.lit(" "), 1), (F.concat(F.lit("ghp_"), F.substring(based("e"), 1, 36)), pick("Bearer ", "url ", "token "), F.lit("\n"), 1), (F.concat(F.lit("sk-"), F.substring(based("f"), 1, 44)), F.concat(said(), name()), F.lit("\""), 1),
        (F.concat(F.lit("eyJ"), F.substring(based("g"), 1, 60)), pick("Authorization: Bearer ", "auth="), F.lit(" "), 1), (F.concat(F.substring(based("h"), 1, 12), F.lit("!"), F.substring(based("h2"), 1, 6)), F.concat(said(), pick("password: ", "pwd=", "passwd = '")), F.lit(" "), 1),
        (F.substring(hexed("i"), 1, 64), F.concat(said(), name()), F.lit("\"###"), 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(letters("aa"), 1, 16))), pick(said(), "aws_access_key_id = ", "access_key_id: \"", "AWS_ACCESS_KEY_ID="), F.lit(" "), 1), (F.concat(pick("ghp_", "sk-", "npm_"), F.substring(letters("ab"), 1, 36)), pick("Bearer ", "url ", "see ", "the "), F.lit("\n"), 1), (F.substring(letters("ac"), 1, 40), pick(name(), said()), F.lit("\""), 1),
        (F.substring(hexed("k"), 1, 40), F.concat(said(), pick("commit ", "revision ", "tree ", "blob ", "sha1: ")), F.lit(" by"), 0), (F.substring(hexed("l"), 1, 32), F.concat(said(), pick("md5 ", "checksum: ", "etag \"", "hash=")), F.lit("\""), 0), (hexed("m"), pick("sha256:", "digest ", "sha-256 = "), F.lit(" "), 0),
        (F.regexp_replace(F.substring(hexed("n"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), pick("uuid ", "id: ", "guid=", "request "), F.lit(" "), 0), (digits("o", 16), pick("card ", "no. ", "in ", "de ", "the ", "der "), F.lit(" "), 0), (digits("p", 18), said(), F.lit("."), 0), (digits("q", 24), pick("order ", "invoice number ", "isbn "), F.lit(" "), 0),
        (F.concat(F.lit("articles/page-"), digits("r", 3), F.lit("/the-and-for-section")), pick("https://www.example.com/", "http://host/"), F.lit(" "), 0), (F.concat(F.lit("release_version_"), digits("s", 2), F.lit("_build_"), digits("s2", 4)), pick("see ", "= \"", "version "), F.lit(" "), 0),
        (F.concat(pick("your_token_here_", "example-api-key-", "change_this_password", "xxxxxxxxxxxxxxxx", "placeholder-secret-"), digits("t", 2)), name(), F.lit("\""), 0), (F.concat(F.lit("test_user_password_"), digits("u", 2)), name(), F.lit("\""), 0), (F.concat(F.lit("function_return_value"), digits("v", 1), F.lit("_string")), said(), F.lit("("), 0), (F.concat(F.lit("2024-0"), digits("w", 1), F.lit("-1"), digits("w2", 1), F.lit("-100000-report")), said(), F.lit(" "), 0),
        (F.concat(pick("get", "load", "parse", "Abstract", "read"), pick("User", "Table", "Model", "Client", "Config", "Report", "Page"), pick("Name", "Index", "List", "Value"), pick("FromService", "Builder", "ForEachItem")), pick(said(), "new ", "import "), F.lit("("), 0), (F.concat(pick("State-Of-The-", "New-York-", "Out-Of-"), pick("Art-Report", "City-Council-Page", "Town-Service-List", "Date-Module-Index"), F.lit("-Section")), said(), F.lit(" "), 0), (pick("INTERNATIONALIZATION", "RESPONSIBILITIES", "ACKNOWLEDGEMENTS", "CHARACTERIZATION", "INCOMPREHENSIBLE"), said(), F.lit(" "), 0),
        *([
            (F.concat_ws("-", word(0), word(1), word(2), digits("y", 2)), F.concat(said(), pick("https://www.example.com/", "see ", "/")), F.lit(" "), 0), (F.concat(word(0), F.initcap(word(1)), F.initcap(word(2)), F.lit("Id")), F.concat(said(), pick("call ", "new ", "import ")), F.lit("("), 0),
            (F.concat_ws("_", word(2), word(1), word(0), digits("z", 3)), F.concat(word(1), F.lit(" "), pick("= \"", "in ", "version ")), F.lit(" "), 0), (F.substring(hexed("ad"), 1, 40), F.concat(word(0), F.lit(" "), word(1), F.lit(" "), name()), F.concat(F.lit("\" "), word(2)), 1),
        ] if some else []),
        (F.lit("1234567890123456"), name(), F.lit("\""), 0), (F.concat(F.lit("====================="), digits("x", 1)), F.lit("\n"), F.lit("\n"), 0),
    ]
    cases = F.array(*[F.struct(v.alias("value"), a.alias("left"), b.alias("right"), F.lit(float(y)).alias("label")) for v, a, b, y in kinds])
    rows = spark.createDataFrame([(i, some) for i in range(each)], "i long, own array<string>")
    return rows.select(F.explode(cases).alias("f"), pick("src/main", "src0", "docs/guide", "tests/fixtures", "web").alias("path")).select("f.value", "f.left", "f.right", "path", "f.label")


def train(findings: DataFrame, words: DataFrame | None = None, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassificationModel:
    """A forest from labelled findings (value, left, right, path, label 0 or 1); rows without value or label are left out."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = findings.where("value is not null and label is not null")
    if words is None:
        rows = rows.withColumn("covered", F.lit(0))
    else:
        # the id is made of the row itself, so that a task that runs again gives the same
        rows = covered(rows.withColumn("id", F.xxhash64("value", "left", "right", "path", "label")).dropDuplicates(["id"]), words)
    rows = rows.select(F.col("label").cast("double").alias("label"), *features(F.col("value"), empty("left"), empty("right"), empty("path"), F.col("covered")))
    # the forest goes over its rows once a level; they are dealt by their values, so that reruns agree
    rows = Scratch(findings.sparkSession, "secrets-training").keep(rows, "rows")
    rows = rows.repartition(TRAINING_PARTS, F.xxhash64("label", *FEATURES)).sortWithinPartitions("label", *FEATURES)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(vectors)


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate: doc_id, place (0, 1, ... in its text), start (code points), value, left, right, path."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("path"), "text")
    # texts are searched once; those with candidates are cut at them once more
    found = rows.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    cut = found.select("row", "doc_id", "path", "found", F.when(F.size("found") > 0, F.split("text", CANDIDATE, -1)).alias("between"))
    pair = F.transform("found", lambda f, i: F.struct(f.alias("match"), F.length(F.get("between", i)).alias("gap"), F.right(F.get("between", i), F.lit(BESIDE)).alias("left"), F.left(F.get("between", i + 1), F.lit(BESIDE)).alias("right")))
    each = cut.select("row", "doc_id", "path", F.posexplode(pair).alias("place", "c")).select("row", "doc_id", "path", "place", "c.*")
    # a window holds the candidates of one text
    upto = Window.partitionBy("row").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("at", F.sum(F.col("gap") + F.length("match")).over(upto) - F.length("match"))
    name = F.regexp_extract("match", _PARTS, 1)
    value = F.when(F.length(name) > 0, F.regexp_extract("match", _PARTS, 2)).otherwise(F.col("match"))
    return each.select("doc_id", "place", (F.col("at") + F.length(name)).cast("long").alias("start"), value.alias("value"), F.concat("left", name).alias("left"), "right", "path")


def scan(spark: SparkSession, docs: DataFrame, findings: DataFrame | None = None, least: float = LEAST, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """One row per candidate: doc_id, place, start, value, score (share of the forest for a secret), is_secret.

    ``start`` counts code points of the whole text from 0. Without findings or a model, the forest is trained
    on ``labelled_findings``. Null and empty texts have no candidates; repeated rows are scanned each; a null
    source is an empty path. Of other columns none is read. An empty table gives an empty result.
    """
    tables = Scratch(spark, "secrets")
    words = tables.keep(dictionary(docs), "words")
    model = model or train(findings if findings is not None else labelled_findings(spark, words), words)
    rows = tables.keep(candidates(docs).withColumn("id", F.monotonically_increasing_id()), "candidates")
    rows = covered(rows, words)
    rows = rows.select("doc_id", "place", "start", "value", *features(F.col("value"), F.col("left"), F.col("right"), F.col("path"), F.col("covered")))
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
    score = F.element_at(vector_to_array("probability"), 2)
    return scored.select("doc_id", "place", "start", "value", score.alias("score"), (score >= least).alias("is_secret"))


def redact(docs: DataFrame, found: DataFrame, mask: str = "[secret]") -> DataFrame:
    """doc_id and text with each secret of ``found`` (rows of ``scan``) masked; for tables whose doc_ids are unique."""
    own = found.where("is_secret").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", F.length("value").alias("size")))).alias("spans"))
    joined = docs.select("doc_id", "text").join(own, "doc_id", "left")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["start"] + s["size"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length("text").cast("long")))
    kept = F.zip_with(ends, starts, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    return joined.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(kept, mask)).alias("text"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every whole text of ``documents`` with the forest's verdict, values as hashes; see ``scan``."""
    found = scan(spark, common.load(spark, sf_dir, "documents"))
    return found.select("doc_id", "place", "start", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")
