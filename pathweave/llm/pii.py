"""Personal data: base patterns, and information-theoretic sanitisation of what reveals them.

Base spans are e-mail addresses, IP addresses, payment cards and telephone numbers. Each
distinct value is a protected entity. A word near an entity may reveal it even where the
entity itself is gone, if it hardly occurs elsewhere. How strongly is estimated from the
corpus: over all distinct texts, ``PMI(c;t) = log(n_ct * N / (n_c * n_t))`` of entity ``c``
and term ``t`` against the entity's information ``IC(c) = log(N / n_c)``. A term whose share
``PMI / IC`` reaches ``disclosure`` in at least ``min_support`` texts tells more than is
allowed; it is a span of kind ``term`` wherever it occurs, generalised to ``[name]`` when it
is capitalised and removed as ``[term]`` otherwise.

Counts go by distinct text, so that copies prove nothing. Contexts are ``window`` words to
either side of an entity; ``n_t`` counts the whole corpus. Word counts are taken only for
terms that some entity with enough support has near it, and the words of a text meet those
terms before they are shuffled, by broadcast if their checked number allows it.

Main path: DataFrame functions only.

Cases: null text is empty; null ids are carried; equal rows each get the same spans; an empty
table gives an empty result; texts are searched whole; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.spans import SPAN, cut_out, digits, find, luhn, merged
from pathweave.llm.tables import counted_side
from pathweave.session import cut_lineage

# ``\G`` lets a match begin where the last one ended; the look-behind keeps the search for
# the start of a run from trying each of its characters, which takes quadratic time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: A counted table of up to this many short rows is sent to all tasks; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
TERM = r"[\p{L}\p{N}]{2,}"


def valid_ip(m: Column) -> Column:
    part = lambda p: F.length(F.regexp_replace(p, "^0+", ""))
    return F.forall(F.split(m, r"\."), lambda p: (part(p) < 3) | ((part(p) == 3) & (F.regexp_replace(p, "^0+", "") <= "255")))


def valid_card(m: Column) -> Column:
    d = digits(m)
    return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)


def base_spans(text: Column) -> Column:
    return merged(
        [
            find(text, EMAIL, "email", 0),
            find(text, IP, "ip", 1, valid_ip),
            find(text, CARD, "card", 2, valid_card),
            find(text, PHONE, "phone", 3, lambda m: F.length(digits(m)).between(9, 15)),
        ]
    )


def entity(span: Column) -> Column:
    """The value that a span protects: lower-case address, or the digits alone."""
    return F.when(span["kind"].isin("email", "ip"), F.lower(span["text"])).otherwise(F.concat(span["kind"], F.lit(":"), digits(span["text"])))


def words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def text_digest(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def near(text: Column, span: Column, window: int) -> Column:
    """The distinct terms among the ``window`` words of what stands before a span, and of what stands after it.

    A few characters hold them nearly always; where these don't hold more words than wanted, so
    that the outermost may be cut, the whole text is searched.
    """
    reach = window * 40
    last = lambda part: F.slice(F.reverse(part), 1, window)
    first = lambda part: F.slice(part, 1, window)
    before = words(F.substring(text, F.greatest(span["start"] - reach, F.lit(0)) + 1, F.least(span["start"], F.lit(reach))))
    after = words(F.substring(text, span["end"] + 1, F.lit(reach)))
    left = F.when(F.size(before) > window, last(before)).otherwise(last(words(F.substring(text, F.lit(1), span["start"]))))
    right = F.when(F.size(after) > window, first(after)).otherwise(first(words(F.substring(text, span["end"] + 1, F.length(text)))))
    return F.array_distinct(F.concat(left, right))


def disclosing_terms(found: DataFrame, *, window: int = 5, min_support: int = 3, disclosure: float = 0.8) -> DataFrame:
    """``found(content, blob, spans)`` of all rows -> ``term, share``: the terms over the threshold.

    ``spans`` are the base spans and ``blob`` is the digest of the content.
    """
    at = F.explode(F.transform("spans", lambda s: F.struct(entity(s).alias("entity"), near(F.col("content"), s, window).alias("terms"))))
    holding = cut_lineage(found.filter(F.size("spans") > 0).select("blob", at.alias("at")).select("blob", "at.entity", "at.terms"))
    entities, _ = counted_side(holding.groupBy("entity").agg(F.count_distinct("blob").alias("n_c")).filter(F.col("n_c") >= min_support), BROADCAST_ROWS)
    pairs = (
        holding.join(entities, "entity")
        .select("blob", "entity", "n_c", F.explode("terms").alias("term"))
        .groupBy("entity", "n_c", "term")
        .agg(F.count_distinct("blob").alias("n_ct"))
        .filter(F.col("n_ct") >= min_support)
    )
    pairs = cut_lineage(pairs)
    if pairs.isEmpty():
        return pairs.select("term", F.lit(0.0).alias("share"))
    texts = float(found.agg(F.count_distinct("blob").alias("n")).first()["n"])
    # The threshold bounds n_t from above, and the texts that have the term near any entity bound
    # it from below: common words are out without a count over the corpus.
    at_most = F.col("n_ct") * F.lit(texts) / F.col("n_c") / F.pow(F.lit(texts) / F.col("n_c"), F.lit(disclosure))
    at_least = holding.select("blob", F.explode("terms").alias("term")).groupBy("term").agg(F.count_distinct("blob").alias("n_near"))
    pairs = cut_lineage(pairs.join(at_least, "term").filter(F.col("n_near") <= at_most * 1.000001).drop("n_near"))
    terms, n_terms = counted_side(pairs.select("term").distinct(), BROADCAST_ROWS)
    if n_terms == 0:
        return pairs.select("term", F.lit(0.0).alias("share"))
    tokens = found.select("blob", F.explode(F.array_distinct(words(F.col("content")))).alias("term"))
    freq = tokens.join(terms, "term").groupBy("term").agg(F.count_distinct("blob").alias("n_t"))
    pmi = F.log(F.col("n_ct") * F.lit(texts) / (F.col("n_c") * F.col("n_t")))
    ic = F.log(F.lit(texts) / F.col("n_c"))
    shared = pairs.join(freq, "term").withColumn("share", F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0)))
    return shared.filter(F.col("share") >= disclosure).groupBy("term").agg(F.max("share").alias("share"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id, content, base, spans`` of every row: its base spans, and these with its term spans.

    ``options`` are those of ``disclosing_terms``.
    """
    content = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), content.alias("content"), text_digest(content).alias("blob"))
    found = d.withColumn("spans", base_spans(F.col("content")))
    terms, n_terms = counted_side(disclosing_terms(found, **options).select("term"), BROADCAST_ROWS)
    if n_terms == 0:
        return found.select("id", "content", F.col("spans").alias("base"), "spans")
    tokens = d.select("blob", F.explode(F.array_distinct(words(F.col("content")))).alias("term"))
    hits, _ = counted_side(tokens.join(terms, "term").groupBy("blob").agg(F.collect_set("term").alias("hits")), BROADCAST_ROWS)
    added = F.when(F.col("hits").isNull(), F.array().cast(f"array<{SPAN}>")).otherwise(
        find(F.col("content"), TERM, "term", len(KINDS), lambda m: F.array_contains("hits", F.lower(m)))
    )
    return found.join(hits, "blob", "left").select("id", "content", F.col("spans").alias("base"), merged([F.col("spans"), added]).alias("spans"))


def sanitized(content: Column, spans: Column) -> Column:
    """A text with its entities named by kind, and its terms generalised or removed; of spans that overlap the first holds."""

    def put(s: Column) -> Column:
        named = F.when(s["text"].rlike(r"^\p{Lu}"), F.lit("[name]")).otherwise(F.lit("[term]"))
        return F.when(s["kind"] == "term", named).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))

    return cut_out(content, spans, put)


def sanitize(scanned: DataFrame) -> DataFrame:
    """The result of ``scan`` -> ``id, sanitized``."""
    return scanned.select("id", sanitized(F.col("content"), F.col("spans")).alias("sanitized"))
