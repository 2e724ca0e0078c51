"""Secrets in text: candidates by shape, false positives removed by a random forest.

A candidate is the value assigned to a name such as ``password``, the password of
a URL's login, what follows the prefix of a known kind of key (these of any length
and characters), or a run of 16 or more key characters.  Features are its length, how often its kind of character changes, its make-up, how much of
its letters dictionary words cover (words that the corpus has often), its path,
and the words beside it.

The forest is fitted on labelled findings: at most SAMPLE candidates of the
corpus, drawn by hash, labelled by rules that use sure signs only (unsure ones are
left out), and for each of them known variants: keys in other alphabets and
assignments, and digests, identifiers, placeholders and version strings that
are no secrets.

Defined results: no text has no candidates; rows that share an id and a text give
their findings once each; a null path is an empty one; if a sample has only one
class its variants still give both; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drawn as drawn_part
from .common import written
from .spans import starts, stretches

KEY = "A-Za-z0-9+/_-"
#: Characters of context on each side; candidates labelled at most; a dictionary word's least count; trees and their depth.
CONTEXT, SAMPLE, DICTIONARY, TREES, DEPTH = 40, 2000, 20, 24, 6
#: A finding is a secret from this score on.
SCORE = 0.5

NAME = r"token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential"
NAMES = rf"(?i)({NAME})"
#: A value follows = or : at once or after an opening quote; that is looked for first, as it is rare.
VALUE = (rf"(?<=[=:]>?\s{{0,3}}[\"']?)(?<=(?i:{NAME})(?i:s|[_-]?(?:key|value|token))?[\"']?\s{{0,3}}(?:=>|=|:)\s{{0,3}}[\"']?)"
         r"(?:(?<=\")(?:[^\"\\\n]++|\\.)++(?=\")|(?<=')(?:[^'\\\n]++|\\.)++(?=')|[^\s\"'=:>](?:\S*[^\s\"',;.)\]}>])?)")
LOGIN = r"(?<=:)(?<=://[^\s/:@]{0,256}:)[^\s/]+(?=@)"
PREFIXED = rf"(?<![{KEY}])(?:AKIA|ASIA|AIza|gh[opsur]_|github_pat_|glpat-|sk[_-]|pk_live_|xox[abeprs]-|hf_|npm_|eyJ)[.{KEY}]*[{KEY}]=*"
CANDIDATE = rf"{VALUE}|{LOGIN}|{PREFIXED}|(?<![{KEY}])[{KEY}]{{16,}}+=*"
ASSIGNED = NAMES + r"[\"']?\s{0,3}(?:=|:|=>)?\s{0,3}[\"']?$"
FEATURES = ["length", "changes", "digits", "uppers", "hexes", "distinct", "coverage", "test_path", "named", "assigned", "quoted", "mail", "web", "digest_word", "dashes", "others", "login", "stand_in"]
#: What stands where a secret would: names of types and states, calls, variables and gaps to fill in.
STAND_IN = r"(?i)^(?:none|null|nil|true|false|yes|no|str(?:ing)?|int|bool(?:ean)?|text|required|optional|bearer|basic|undefined|empty|n/a|\*+|x+|\.+)$|^[\[<{$%]|[(\[]|^(?:os|env|process|self|config|settings|this)\.|your|example|changeme|placeholder|redacted"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Rows ``doc_id, mark, path, start, found, before, after``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"))
    rows = rows.withColumn("m", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where("size(m) > 0")
    rows = rows.withColumn("b", stretches(F.col("text"), CANDIDATE, F.col("m"))).withColumn("s", starts(F.col("m"), F.col("b")))
    each = F.transform("m", lambda m, i: F.struct(F.get("s", i).alias("start"), m.alias("found"), F.substring(F.get("b", i), -CONTEXT, CONTEXT).alias("before"),
                                                  F.substring(F.get("b", i + 1), 1, CONTEXT).alias("after")))
    return rows.select("doc_id", F.xxhash64("text").alias("mark"), "path", F.explode(each).alias("c")).select("doc_id", "mark", "path", "c.*")


def part(found: Column, kinds: str) -> Column:
    return F.length(F.regexp_replace(found, f"[^{kinds}]", "")) / F.length(found)


def login(before: Column, after: Column) -> Column:
    """Whether what stands between is the password of a URL's login."""
    return before.rlike(r"(?:://|^)[^\s/:@]*:$") & after.rlike("^@")


def runs(found: Column) -> Column:
    """Its runs of three letters or more, lower-cased."""
    return F.regexp_extract_all(F.lower(found), F.lit("[a-z]{3,}"), F.lit(0))


def shaped(rows: DataFrame) -> DataFrame:
    """All features but the dictionary's."""
    f, before, after = F.col("found"), F.col("before"), F.col("after")
    flag = lambda c: c.cast("double")
    return rows.withColumns({
        "length": F.length(f).cast("double"), "changes": F.size(F.regexp_extract_all(f, F.lit("[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0))) / F.length(f),
        "digits": part(f, "0-9"), "uppers": part(f, "A-Z"), "hexes": part(f, "0-9a-fA-F"), "dashes": part(f, "_/+-"),
        "others": F.length(F.regexp_replace(f, "[A-Za-z0-9_/+-]", "")) / F.length(f), "login": flag(login(before, after)), "stand_in": flag(f.rlike(STAND_IN)),
        "distinct": F.size(F.array_distinct(F.split(F.lower(f), ""))) / F.length(f), "test_path": flag(F.col("path").rlike("(?i)test|example|sample|fixture")),
        "named": flag(before.rlike(NAMES)), "assigned": flag(before.rlike(ASSIGNED)), "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "mail": flag(before.rlike("@[A-Za-z0-9.]*$") | after.rlike("^[.A-Za-z0-9]*@")), "web": flag(before.rlike(r"(?i)https?://\S*$")),
        "digest_word": flag(before.rlike(r"(?i)(sha\d*|md5|commit|checksum|digest|integrity|uuid|etag|version|build)\W*$"))})


def covered(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """With ``coverage``: the part of a candidate's letters that lie in dictionary words."""
    keyed = rows.withColumn("runs", runs(F.col("found")))
    known = keyed.select("found", F.explode(F.array_distinct("runs")).alias("word")).distinct().join(dictionary.select("word"), "word").groupBy("found").agg(F.collect_set("word").alias("words"))
    both = keyed.join(known, "found", "left")
    inside = F.aggregate(F.filter("runs", lambda r: F.array_contains("words", r)), F.lit(0), lambda s, r: s + F.length(r))
    letters = F.length(F.regexp_replace("found", "[^A-Za-z]", ""))
    return both.withColumn("coverage", F.coalesce(F.when(letters > 0, inside / letters), F.lit(0.0))).drop("runs", "words")


def dictionary(docs: DataFrame, found: DataFrame, text_col: str = "text", least: int = DICTIONARY) -> DataFrame:
    """Those letter runs of candidates that are words of the corpus, counted over all of it."""
    asked = found.select(F.explode(runs(F.col("found"))).alias("word")).distinct()
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"(?<![a-z0-9])[a-z]{3,}(?![a-z0-9])"), F.lit(0))).alias("word"))
    # Counted before the join, so what is exchanged are counts of a task's different words, however many are asked for.
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).join(asked, "word", "left_semi")


def labelled(found: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` candidates of the corpus with sure labels, and their variants."""
    f = F.col("found")
    h = F.xxhash64("found", "before", "after")
    some = drawn_part(found.select("path", "found", "before", "after"), h, 16 * sample, found.count())
    drawn = some.distinct().orderBy(h, "found", "before", "after", "path").limit(sample)
    strong = f.rlike("^[0-9a-fA-F]{32,}$") | (F.length(f) >= 20) & f.rlike("[A-Z]") & f.rlike("[a-z]") & f.rlike("[0-9]")
    plain = f.rlike("^[0-9]+$") | f.rlike("^(?:[A-Za-z]{3,}+[0-9]{0,4}+[_/-]?+)++$") | F.col("before").rlike("@[A-Za-z0-9.]*$") | F.col("after").rlike("^[.A-Za-z0-9]*@")
    sure = drawn.withColumn("label", F.when(strong & F.col("before").rlike(ASSIGNED), 1.0).when(plain & ~F.col("before").rlike(ASSIGNED) & ~login(F.col("before"), F.col("after")), 0.0)).where("label is not null")
    # Variants are made from hashes of the drawn rows; one row stands in for an empty sample.
    seeds = drawn.select(F.sha2(F.concat_ws("|", "found", "before"), 256).alias("h")).union(found.sparkSession.range(64).select(F.sha2(F.col("id").cast("string"), 256).alias("h")))
    h = F.col("h")
    key = F.regexp_replace(F.base64(F.unhex(h)), "=", "")
    lead = F.substring(F.translate(h, "0123456789", "ghijklmnop"), 1, 12)
    made = [("api_key = \"", key, "\"", 1), ("secret: ", F.substring(key, 1, 24), "\n", 1), ("password='", F.substring(key, 3, 20), "'", 1), ("Authorization: Bearer ", key, " ", 1),
            ("token = \"", F.substring(h, 1, 40), "\"", 1), ("aws_access_key_id ", F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16))), "\n", 1),
            ("commit ", F.substring(h, 1, 40), "\n", 0), ("sha256:", h, " ", 0), ("md5 ", F.substring(h, 1, 32), " ", 0),
            ("uuid ", F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), " ", 0),
            ("version ", F.concat(F.lit("release-2024-"), F.substring(h, 1, 6)), " ", 0), ("token = \"", F.concat(F.lit("example-token-"), F.substring(F.conv(F.substring(h, 1, 4), 16, 10), 1, 3)), "\"", 0),
            ("api_key = \"", F.lit("xxxxxxxxxxxxxxxx1234"), "\"", 0), ("card ", F.substring(F.translate(h, "abcdef", "123456"), 1, 16), " ", 0), (" ", F.concat(lead, F.lit("-2024-item1")), " ", 0)]
    # Short ones, with other characters, letters alone, logins; and what else is assigned to such names.
    letters, word = F.translate(h, "0123456789", "ghijklmnop"), F.element_at(F.array(*[F.lit(w) for w in ("required", "string", "None", "true", "null", "os.environ", "your_password", "<password>", "${TOKEN}", "get_secret()")]),
                                                                                     F.pmod(F.xxhash64("h"), F.lit(10)).cast("int") + 1)
    short = F.concat(F.substring(letters, 1, 6), F.substring(F.conv(F.substring(h, 1, 4), 16, 10), 1, 2), F.substring(letters, 9, 4))
    mixed = F.concat(F.upper(F.substring(letters, 1, 1)), F.lit("@"), F.substring(letters, 2, 3), F.substring(h, 3, 3), F.lit("!"), F.substring(h, 9, 4), F.lit("#"), F.substring(letters, 20, 3))
    made += [("password = \"", short, "\"", 1), ("password: ", short, "\n", 1), ("password: \"", mixed, "\"", 1), ("pwd=", mixed, " ", 1), ("api_key=\"", F.concat(F.lit("AKIA"), F.upper(F.substring(letters, 1, 16))), "\"", 1),
             ("secret = \"", F.substring(letters, 1, 30), "\"", 1), ("token: ", F.substring(letters, 1, 30), "\n", 1), ("postgres://u:", F.substring(key, 1, 10), "@db/x", 1), ("https://me:", short, "@host/", 1), ("amqp://app:", mixed, "@q", 1),
             ("password: ", word, "\n", 0), ("token = ", word, "\n", 0), ("api_key=\"", word, "\"", 0), (" ", F.substring(letters, 1, 18), " ", 0), (" ", F.concat_ws("/", F.substring(letters, 1, 6), F.substring(letters, 7, 8), F.substring(letters, 15, 5)), " ", 0)]
    variants = seeds.select(F.explode(F.array(*[F.struct(F.lit("").alias("path"), c.alias("found"), F.lit(b).alias("before"), F.lit(a).alias("after"), F.lit(float(y)).alias("label")) for b, c, a, y in made])).alias("v")).select("v.*")
    return sure.union(variants.select(*sure.columns))


def fit(found: DataFrame, words: DataFrame, sample: int = SAMPLE, seed: int = 7) -> PipelineModel:
    rows = covered(shaped(labelled(found, sample)), words)
    rows = written(rows.coalesce(1).sortWithinPartitions("found", "before", "after"), "labelled")  # a bounded sample; one order gives one forest
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows.coalesce(1))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", sample: int = SAMPLE) -> DataFrame:
    """Every candidate: ``doc_id, mark, start, end, found, score, is_secret``."""
    found = written(candidates(docs, id_col, text_col, path_col), "candidates")
    words = written(dictionary(docs, found, text_col), "dictionary")
    model = fit(found, words, sample)
    scored = model.transform(covered(shaped(found), words))
    return scored.withColumn("score", F.round(vector_to_array("probability")[1], 6)).select(
        "doc_id", "mark", "start", (F.col("start") + F.length("found")).alias("end"), "found", "score", (F.col("score") >= SCORE).alias("is_secret"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``docs`` with each secret's characters replaced by ``[SECRET]``; other columns stay."""
    own = scan(docs, id_col, text_col, path_col).where("is_secret").groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_secrets"))
    own = own.select(F.col("doc_id").alias("_secret_id"), F.col("mark").alias("_secret_mark"), "_secrets")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_secret_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_secret_mark"))
    text = F.col(text_col)
    put = F.aggregate("_secrets", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda s, x: F.struct(
        x["end"].alias("at"), F.concat(s["out"], text.substr(s["at"] + 1, x["start"] - s["at"]), F.lit("[SECRET]")).alias("out")), lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))))
    return docs.join(own, same, "left").withColumn(text_col, F.coalesce(put, text)).select(*docs.columns)
