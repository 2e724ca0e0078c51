"""Personal data by patterns, and terms that would reveal it by co-occurrence.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers.
What they find are the protected entities.  A term tells about an entity as much
as their pointwise mutual information over the corpus: from rows with the
entity, the term, and both, out of all rows.  An entity's own information is
that of its rarity.  How often the entity is there when the term is, is an estimate, so
the lower end of its Wilson interval counts: what is seen in few rows has to be told apart from chance by
the size of the corpus.  A term that reveals at least DISCLOSED percent of the entity's information is generalised with
it: each of its occurrences in a document that holds the entity is a span, unless it overlaps
what a pattern found.  Entities of one document have such terms too.

Counts are of rows and cover the whole corpus.  A term in more than
``n_e * (n / n_e) ** (1 - DISCLOSED / 100)`` of ``n`` rows can't reveal an entity of ``n_e`` rows, so frequent terms leave
before terms meet entities.  Terms of the same rows, and entities of the same rows, are counted as one set of
rows: a page of many addresses and rare words is one pair.

Defined results: no text counts as empty; rows that repeat count alike on all
sides; a null id is judged like others; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .spans import matches, starts, stretches

#: A match begins where a run of its first characters does, or where the last match ended: so no run is tried from each of its characters.
RUN = r"(?:\G|(?<![%s]))[%s]"
LOCAL = "A-Za-z0-9._%+-"
#: Kind, pattern, and a character without which a text isn't searched.
KINDS = [
    ("email", RUN % (LOCAL, LOCAL) + r"++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "@"),
    ("ip", RUN % ("0-9", "0-9") + r"++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "."),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
]
TERM = r"\p{L}[\p{L}\p{N}]{2,}"
#: Percentage of the entity's information; half width of the interval in standard errors.
DISCLOSED, ERRORS = 90, 1.0
#: A term of more than one row in so many is joined apart from the others.
FREQUENT = 1000


def holds(kind: str, match: Column) -> Column:
    """Whether a match is of its kind."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("decimal(38,0)"), F.when(p.rlike("^0+$"), F.lit(0)).otherwise(F.lit(256))) <= 255)
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ``doc_id, text, mark`` (of the text) and ``base``: spans in order of start, then kind."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({f"m_{k}": matches(F.col("text"), p, hint) for k, p, hint in KINDS})
    rows = rows.withColumns({f"b_{k}": stretches(F.col("text"), p, F.col(f"m_{k}")) for k, p, _ in KINDS})
    rows = rows.withColumns({f"s_{k}": starts(F.col(f"m_{k}"), F.col(f"b_{k}")) for k, _, _ in KINDS})

    def spans(rank: int, kind: str) -> Column:
        both = F.arrays_zip(F.col(f"s_{kind}").alias("at"), F.col(f"m_{kind}").alias("m"))
        return F.transform(F.filter(both, lambda z: holds(kind, z["m"])), lambda z: F.struct(
            z["at"].alias("start"), F.lit(rank).alias("rank"), (z["at"] + F.length(z["m"])).alias("end"), F.lit(kind).alias("kind"), z["m"].alias("found")))

    each = [spans(rank, kind) for rank, (kind, _, _) in enumerate(KINDS)]
    return rows.select("doc_id", "text", F.xxhash64("text").alias("mark"), F.array_sort(F.concat(*each)).alias("base"))


def entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], F.lower(span["found"]))


def with_entities(found: DataFrame) -> DataFrame:
    """``row`` (a number)``, doc_id, mark, base, entities`` (each once) and ``text``, null without an entity: so that the others aren't kept."""
    return found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "mark", "base", F.array_distinct(F.transform("base", entity)).alias("entities"),
                        F.when(F.size("base") > 0, F.col("text")).alias("text"))


def terms_of(text: Column) -> Column:
    """The different terms of a text, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])


def rows_of(rows: DataFrame, key: str, count: str) -> DataFrame:
    """Each key's number of rows, and ``{key}_set``, a name for the set of texts it stands in (by their ``mark``)."""
    part = lambda shift: F.sum(F.shiftrightunsigned("mark", shift).bitwiseAND(F.lit((1 << 28) - 1)))
    sums = rows.groupBy(key).agg(F.count("*").alias(count), part(0).alias("low"), part(32).alias("high"))
    return sums.select(key, count, F.xxhash64(count, "low", "high").alias(f"{key}_set"))


def most_rows(n: Column, total: int, disclosed: int = DISCLOSED) -> Column:
    """The rows that a term may have and yet reveal an entity of ``n`` rows."""
    return n * F.pow(F.lit(float(total)) / n, F.lit(1 - disclosed / 100)) * (1 + 1e-9)


def disclosure(both: Column, term: Column, ent: Column, total: int, errors: float = ERRORS) -> Column:
    """Part of an entity's information that a term gives, by the lower end of the share of the term's rows that hold it."""
    z2, share = errors * errors, both / term
    low = (share + z2 / (2 * term) - errors * F.sqrt(share * (1 - share) / term + z2 / (4 * term * term))) / (1 + z2 / term)
    return F.ln(low * total / ent) / F.ln(F.lit(float(total)) / ent)


def revealing(texts: DataFrame, wide: DataFrame, disclosed: int = DISCLOSED) -> DataFrame:
    """Rows ``row, told``: the terms of a row that reveal one of its entities."""
    total = wide.count()
    each = wide.select("row", "mark", F.explode("entities").alias("entity"))
    entities = written(rows_of(each, "entity", "n_e").where(F.col("n_e") < total), "entities")
    most = entities.agg(F.max(most_rows(F.col("n_e"), total, disclosed))).first()[0]
    none = "row long, told array<string>"
    if most is None:
        return wide.sparkSession.createDataFrame([], none)
    held = written(each.select("row", "entity").join(entities, "entity").groupBy("row", "entity_set").agg(F.max("n_e").alias("n_e")), "held")
    words = texts.select("mark", F.explode(terms_of(F.col("text"))).alias("term"))
    counts = rows_of(words, "term", "n_t")
    # Counted first, whatever the joins below ask for: written, so no join is pushed ahead of the counts.
    counts = written(counts.where((F.col("n_t") <= most) | (F.col("n_t") * FREQUENT > total)), "counts")
    often = written(counts.where(F.col("n_t") * FREQUENT > total).withColumnsRenamed({"n_t": "often", "term_set": "often_set"}), "often")
    own = wide.where(F.size("entities") > 0).select("row", F.explode(terms_of(F.col("text"))).alias("term")).join(often, "term", "left")
    rare = own.where("often is null").select("row", "term").join(counts.where((F.col("n_t") <= most) & (F.col("n_t") * FREQUENT <= total)), "term").select("row", "term", "n_t", "term_set")
    terms = written(rare.union(own.where(F.col("often") <= most).select("row", "term", "often", "often_set")), "terms")
    sets = terms.groupBy("row", "term_set").agg(F.max("n_t").alias("n_t"))
    pairs = written(sets.join(held, "row").where(F.col("n_t") <= most_rows(F.col("n_e"), total, disclosed)), "pairs")
    told = pairs.groupBy("entity_set", "term_set").agg(F.count("*").alias("both"), F.max("n_e").alias("n_e"), F.max("n_t").alias("n_t")).where(
        disclosure(F.col("both"), F.col("n_t"), F.col("n_e"), total) * 100 >= disclosed - 1e-9).select("entity_set", "term_set")
    hits = pairs.join(told, ["entity_set", "term_set"]).select("row", "term_set").distinct()
    return terms.join(hits, ["row", "term_set"]).groupBy("row").agg(F.collect_list("term").alias("told"))


def occurrences(text: Column, told: Column, base: Column) -> Column:
    """Spans of all places of the ``told`` terms in a text that don't overlap a base span, in order; ``told`` and ``base`` must be stored columns."""
    found = matches(text, TERM)
    span = lambda s, z: F.struct((s["at"] + F.length(z["b"])).alias("start"), F.lit(len(KINDS)).alias("rank"), (s["at"] + F.length(z["b"]) + F.length(z["m"])).alias("end"),
                                 F.lit("term").alias("kind"), F.lit(None).cast("string").alias("found"))
    none = F.filter(base, lambda b: F.lit(False))
    # There is a stretch more than there are matches.
    each = F.filter(F.arrays_zip(stretches(text, TERM, found).alias("b"), found.alias("m")), lambda z: z["m"].isNotNull())
    all_spans = F.aggregate(each, F.struct(F.lit(0).alias("at"), none.alias("all")), lambda s, z: F.struct(
        (s["at"] + F.length(z["b"]) + F.length(z["m"])).alias("at"),
        F.when(F.array_contains(told, F.lower(z["m"])), F.array_append(s["all"], span(s, z))).otherwise(s["all"]).alias("all")), lambda s: s["all"])
    return F.filter(all_spans, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, mark, base, terms`` (spans of revealing terms)."""
    found = detect(docs, id_col, text_col)
    wide = written(with_entities(found), "base")
    told = written(revealing(found.select("mark", "text"), wide), "revealing")
    places = written(wide.join(told, "row").select("row", occurrences(F.col("text"), F.col("told"), F.col("base")).alias("terms")), "places")
    joined = wide.select("row", "doc_id", "mark", "base").join(places, "row", "left")
    return joined.select("doc_id", "mark", "base", F.coalesce("terms", F.filter("base", lambda b: F.lit(False))).alias("terms"))


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def generalised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first in order stands for all."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    put = F.aggregate(spans, first, lambda s, x: F.struct(
        F.greatest(s["at"], x["end"]).alias("at"),
        F.when(x["start"] >= s["at"], F.concat(s["out"], text.substr(s["at"] + 1, x["start"] - s["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(s["out"]).alias("out")),
        lambda s: s)
    return F.concat(put["out"], text.substr(put["at"] + 1, F.length(text)))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with personal data and revealing terms generalised."""
    spans = personal_data(docs, id_col, text_col).select(F.col("doc_id").alias("span_id"), "mark", F.array_sort(F.concat("base", "terms")).alias("spans")).distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(spans, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.xxhash64("text") == F.col("mark"))).select("doc_id", generalised(F.col("text"), F.col("spans")).alias("text"))
