"""Personal data: patterns, and terms that give away what the patterns protect.

Base spans are emails, IP addresses, card and phone numbers.  Beyond them, what surrounds a
protected entity may reveal it.  For each term t in a document with an entity e, the corpus tells
how far t narrows e down: the pointwise mutual information log(P(e|t) / P(e)) as a part of
e's information content log(1 / P(e)); both probabilities are shares of documents, over all
of them.  A term of which that part is at least `GENERALISE` is generalised, and of which it is
at least `REMOVE` is removed, wherever it stands.  Copies prove nothing: to be a term it has to be with the
entity in documents that add up to `LEAST_DOCUMENTS` different ones.  A document counts as the inverse of how many of the
entity's documents are like it, itself included: each as the share of `BANDS` bands of minwise tokens of their words that
are the same, which is about the third power of the similarity.  So near copies, however many, add up to two at most, and
documents with no more than a passage in common to many.

Defined results: a null or empty text has no spans; rows equal in doc_id and text count as one
document, and each has its spans; spans of different kinds may overlap and all stay; columns other than doc_id
and text are ignored by `find_personal_data` and kept by `sanitised`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import MARK, SPAN, Kind, clean, digest, running_sums, together, with_spans, written
from .stages import staged

_LOCAL = "A-Za-z0-9._%+-"
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|)"


def _luhn(number: Column) -> Column:
    digits = F.reverse(F.translate(number, " -", ""))
    doubled = F.translate(digits, "0123456789", "0246813579")  # twice the digit, its digits summed
    at = lambda s, i: F.substring(s, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, at(doubled, i)).otherwise(at(digits, i)))
    return F.when(F.char_length(digits).between(12, 19), total % 10 == 0).otherwise(F.lit(False))


#: A match begins where its run does, or where the match before it ended.
KINDS = [
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
    Kind("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,}+", _luhn),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: F.char_length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)),
]
NAMES = [k.name for k in KINDS]
TERM = "term"

GENERALISE = 0.75
REMOVE = 0.9
LEAST_DOCUMENTS = 3
#: Smallest word hashes of a document that its tokens are taken from, bands, and tokens of a band.
LOWEST, BANDS, IN_BAND = 64, 8, 3
#: What a document unlike all others counts.
UNIT = 1_000_000
#: Tables up to this size are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
_WORD = r"[\p{L}\p{N}]++"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _cleaned(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), clean(F.col("text")).alias("text"))


def _lowest(words: Column) -> Column:
    """The smallest hashes of an array of distinct words; no words are one."""
    hashes = F.transform(F.when(F.size(words) > 0, words).otherwise(F.array(F.lit(""))), lambda w: F.xxhash64(w))
    return F.slice(F.sort_array(hashes), 1, LOWEST)


def _bands(lowest: Column) -> Column:
    """A hash of the minwise tokens of each band."""
    token = lambda j: F.array_min(F.transform(lowest, lambda h: F.xxhash64(h, j)))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(BANDS - 1).cast("bigint")), lambda b: F.xxhash64(b, *(token(b * IN_BAND + j) for j in range(IN_BAND))))


_KEY = ["row_key", "row_doc"]


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds a key of the row's doc_id and text; equal rows have equal keys."""
    return rows.withColumns({"row_key": F.xxhash64("doc_id", "text"), "row_doc": F.coalesce("doc_id", F.lit(-(2**63)).cast("bigint"))})


def _mentions(scanned: DataFrame) -> DataFrame:
    """doc, sketch, entity: the distinct protected entities of each row."""
    bare = lambda x: F.when(x["rank"] >= 2, F.regexp_replace(x["value"], "[^0-9]", "")).otherwise(F.lower(x["value"]))
    entities = F.transform(together([f"of_{n}" for n in NAMES]), lambda x: F.concat_ws(":", x["kind"], bare(x)))
    return scanned.where("words is not null").select("doc", "sketch", F.explode(F.array_distinct(entities)).alias("entity"))


def _outside(text: Column) -> Column:
    """A clean text with a line break for each base span."""

    def bare(kind: Kind) -> Callable[[Column, Column], Column]:
        return lambda x, i: F.when((i % 2 == 1) & (kind.holds(x) if kind.holds else F.lit(True)), F.lit("\n")).otherwise(x)

    for kind in KINDS:
        marked = F.regexp_replace(text, F.lit(kind.pattern), F.lit(f"{MARK}$0{MARK}"))
        text = F.array_join(F.transform(F.split(marked, MARK, -1), bare(kind)), "")
    return text


def _share(together: Column, holding: Column, of_entity: Column, total: int) -> Column:
    """log(P(e|t) / P(e)) as a part of log(1 / P(e)); null for an entity that every document has."""
    content = F.log(F.lit(float(total)) / of_entity)
    return F.when(content > 0, F.log(together / holding * F.lit(float(total)) / of_entity) / content)


def _base_spans(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, clean text and any others) with their key and span arrays, and the distinct words and sketch of those that have any; without the text.

    Written once, read by each use.
    """
    rows = with_spans(_keyed(rows), "text", KINDS, "of_")
    some = F.greatest(*(F.size(f"of_{n}") for n in NAMES)) > 0
    rows = rows.withColumn("words", F.when(some, F.array_distinct(_words(F.col("text")))))
    rows = rows.withColumn("lowest", F.when(F.col("words").isNotNull(), _lowest(F.col("words"))))
    rows = rows.withColumn("sketch", F.when(F.col("lowest").isNotNull(), _bands(F.col("lowest")))).drop("lowest")
    rows = rows.withColumn("covered", F.when(some, F.array_except("words", _words(_outside(F.col("text"))))))
    return staged(rows.drop("text"), "spans")


def _small(rows: DataFrame, weight: Column | int = 64) -> DataFrame:
    """Marked to be broadcast if the rows, of about `weight` bytes each, are few enough."""
    size = rows.agg(F.sum(weight if isinstance(weight, Column) else F.lit(weight))).first()[0] or 0
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def _counting_copies(known: DataFrame) -> DataFrame:
    """Adds weight to rows (entity, doc, sketch), each document once an entity: UNIT over the number of the entity's documents like it."""
    equal = known.groupBy("entity", "sketch").agg(F.count("*").alias("n"))
    values = equal.select("entity", "sketch", "n", F.explode("sketch").alias("value"))
    shared = values.groupBy("entity", "value").agg((F.sum("n") - 1).alias("others")).where("others > 0")
    met = values.join(_small(shared), ["entity", "value"]).groupBy("entity", "sketch").agg(F.sum("others").alias("others"))
    met = met.select("entity", "sketch", F.floor(F.lit(UNIT * BANDS) / (F.lit(BANDS) + F.col("others"))).alias("weight"))
    met = staged(met, "alike")
    return known.join(_small(met, 64 + 8 * BANDS), ["entity", "sketch"], "left").withColumn("weight", F.coalesce("weight", F.lit(UNIT).cast("bigint")))


def disclosing_terms(docs: DataFrame, found: DataFrame | None = None) -> DataFrame | None:
    """term and disclosure of every term that reaches GENERALISE; None if there is none to look at.

    A term is held by at least those documents with a protected entity that have it, so what these leave
    no chance to is put aside first; the others are counted with each entity of their documents, and those
    still left over the whole corpus.
    """
    found = (_base_spans(_cleaned(docs)) if found is None else found).withColumn("doc", F.col("row_key"))
    rows, total = found.agg(F.count("*"), F.count_distinct("doc")).first()
    mentions = _mentions(found)
    if rows > total:
        mentions = mentions.dropDuplicates(["doc", "entity"])  # equal rows
    mentions = staged(mentions, "mentions")
    entities = mentions.groupBy("entity").agg(F.count("*").alias("of_entity"))
    entities = staged(entities.where((F.col("of_entity") >= LEAST_DOCUMENTS) & (F.col("of_entity") < total)), "entities")
    members = _counting_copies(mentions.join(_small(entities), "entity"))
    members = staged(members.select("doc", "entity", "of_entity", "weight"), "members")
    enough = members.groupBy("entity", "of_entity").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= LEAST_DOCUMENTS * UNIT)
    enough = staged(enough.select("entity", "of_entity"), "enough")
    most = enough.agg(F.max("of_entity")).first()[0]
    if most is None:
        return None
    members = members.join(_small(enough.select("entity")), "entity", "left_semi")

    covered = F.transform("covered", lambda w: F.struct(w.alias("term"), F.lit(True).alias("covered")))
    bare = F.transform(F.array_except("words", "covered"), lambda w: F.struct(w.alias("term"), F.lit(False).alias("covered")))
    spanned = found.where("words is not null").select("doc", F.explode(F.concat(bare, covered)).alias("x")).select("doc", "x.*")
    if rows > total:
        spanned = spanned.distinct()  # equal rows
    least = spanned.groupBy("term").agg(F.count("*").alias("least"))
    least = least.where((F.col("least") >= LEAST_DOCUMENTS) & (_share(F.least(F.lit(most), F.col("least")), F.col("least"), F.lit(most), total) >= GENERALISE - 1e-9))
    least = staged(least, "least")
    held = spanned.join(_small(least), "term").join(members, "doc")
    held = held.where(_share(F.least("of_entity", "least"), F.col("least"), F.col("of_entity"), total) >= GENERALISE - 1e-9)
    key = ["entity", "term", "of_entity", "least"]
    pairs = held.groupBy(*key).agg(F.count("*").alias("together"), F.sum("weight").alias("weight"), F.min("covered").alias("covered"))
    bound = _share(F.col("together"), F.col("least"), F.col("of_entity"), total)
    # What stands in the spans alone is protected by them.
    pairs = staged(pairs.where((bound >= GENERALISE - 1e-9) & (F.col("weight") >= LEAST_DOCUMENTS * UNIT) & ~F.col("covered")), "revealing")
    if pairs.isEmpty():
        return None
    words = _keyed(_cleaned(docs)).select(F.col("row_key").alias("doc"), F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    holding = words.join(_small(pairs.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count_distinct("doc").alias("holding"))
    share = _share(F.col("together"), F.col("holding"), F.col("of_entity"), total)
    terms = pairs.join(holding, "term").groupBy("term").agg(F.max(share).alias("disclosure")).where(F.col("disclosure") >= GENERALISE - 1e-9)
    terms = staged(terms, "terms")
    return None if terms.isEmpty() else terms


def _term_spans(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """row_key, row_doc, of_term for the rows (doc_id, clean text) that have a disclosing term."""
    known = _small(terms)
    keyed = _keyed(rows)
    held = keyed.select(*_KEY, F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).join(known, "term")
    held = staged(held.distinct().groupBy(*_KEY).agg(F.collect_list(F.struct("term", "disclosure")).alias("held")), "held")
    found = keyed.join(_small(held, 64 + 48 * F.size("held")), _KEY)
    # A text's own terms become one pattern; terms are letters and digits only.
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform("held", lambda x: x["term"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    found = found.withColumn("tp", F.split(F.regexp_replace("text", pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1))
    found = found.withColumn("tn", F.transform("tp", lambda x: F.char_length(x).cast("bigint"))).withColumn("ts", running_sums(F.col("tn")))

    def span(i: Column) -> Column:
        removed = F.exists("held", lambda h: (h["term"] == F.lower(F.element_at("tp", i))) & (h["disclosure"] >= REMOVE))
        return F.struct(
            F.element_at("ts", i).alias("start"), F.lit(len(KINDS)).alias("rank"), (F.element_at("ts", i) + F.element_at("tn", i)).alias("end"), F.lit(TERM).alias("kind"),
            F.when(removed, F.lit("remove")).otherwise(F.lit("generalise")).alias("value"), F.lit("").alias("before"), F.lit("").alias("after"),
        )

    spans = F.transform(F.sequence(F.lit(2), F.size("tp") - 1, F.lit(2)), span)
    return found.where(F.size("tp") > 1).select(*_KEY, spans.alias("of_term")).dropDuplicates(_KEY)


def _with_terms(rows: DataFrame, spans_of: DataFrame, terms: DataFrame | None) -> DataFrame:
    """Adds of_term to rows with a row key; spans_of has doc_id and the clean text of all rows."""
    if terms is None:
        return rows.withColumn("of_term", F.array().cast(f"array<{SPAN}>"))
    spans = staged(_term_spans(spans_of, terms), "term-spans")
    spans = _small(spans, 64 + 120 * F.size("of_term"))
    return rows.join(spans, _KEY, "left").withColumn("of_term", F.coalesce("of_term", F.array().cast(f"array<{SPAN}>")))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; one row per document."""
    found = _base_spans(_cleaned(docs))
    rows = _with_terms(found, _cleaned(docs), disclosing_terms(docs, found))
    rows = rows.withColumn("base", together([f"of_{n}" for n in NAMES]))
    rows = rows.withColumn("all_spans", together(["base", "of_term"]))
    return rows.select(
        "doc_id",
        *(F.size(f"of_{n}").cast("bigint").alias(f"n_{n}") for n in NAMES),
        digest(written(F.col("base"))).alias("base_sha256"),
        written(F.col("all_spans")).alias("spans"),
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced: [EMAIL] and so on, [TERM], or nothing for removed terms.

    Overlapping spans are replaced as one, by the first one's kind; n_chars follows the text.
    """
    names = docs.columns
    given = F.struct(*[F.col(n) for n in names]).alias("given")
    found = _base_spans(docs.select(given, F.col("doc_id").cast("bigint").alias("doc_id"), clean(F.col("text")).alias("text")))
    texts = found.select("doc_id", clean(F.col("given.text")).alias("text"))
    rows = _with_terms(found, texts, disclosing_terms(texts, found.drop("given")))
    rows = rows.withColumn("all_spans", together([*(f"of_{n}" for n in NAMES), "of_term"])).drop(*(f"of_{n}" for n in NAMES), "of_term")
    label = lambda x: F.when(x["value"] == "remove", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
    begin = F.array().cast("array<struct<start:bigint,end:bigint,label:string>>")

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.struct(x["start"].alias("start"), x["end"].alias("end"), label(x).alias("label"))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["label"].alias("label"))
        overlaps = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > x["start"])
        return F.when(overlaps, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(one)))

    rows = rows.withColumn("cuts", F.when(F.size("all_spans") > 0, F.aggregate("all_spans", begin, merge)))
    given = F.col("given.text")
    kept = F.transform("cuts", lambda x, i: F.concat(F.substring(given, F.when(i == 0, F.lit(0)).otherwise(F.element_at("cuts", i)["end"]).cast("int") + 1, (x["start"] - F.when(i == 0, F.lit(0)).otherwise(F.element_at("cuts", i)["end"])).cast("int")), x["label"]))
    rest = F.substring(given, F.element_at("cuts", -1)["end"].cast("int") + 1, F.char_length(given))
    text = F.when(F.col("cuts").isNotNull(), F.concat(F.array_join(kept, ""), rest)).otherwise(given)
    rows = rows.withColumn("new_text", text)
    out = [F.col("new_text").alias("text") if n == "text" else F.when(F.col("cuts").isNotNull(), F.char_length("new_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("given.n_chars")).alias("n_chars") if n == "n_chars" else F.col("given").getField(n).alias(n) for n in names]
    return rows.select(*out)
