"""Personal data, and the terms that give it away.

Base spans are e-mail addresses, IP addresses, card and phone numbers, found by patterns and checked (parts, digits, Luhn). Each value so
found is a protected entity. The corpus tells how strongly a term reveals one: with documents as events, a term that stands in n_et of
the n_e documents of an entity, anywhere in their texts, carries PMI = log2(N n_et / (n_e n_t)) bits about it, of the
IC = log2(N / n_e) bits that name it. A term discloses an entity if it leaves less than SLACK bits open (PMI >= IC - SLACK: of the
documents with the term, a fixed share hold the entity), unless that can be chance: it must be seen with the entity in SUPPORT different
contexts (CONTEXT characters to either side of the value; copies of a passage are one), since any word of a single text has PMI = IC, and
the chance that so many of n_t random documents hold the entity (Chernoff's bound), times the number of pairs of entity and term that
were looked at, must be CHANCE at most. Such terms are generalised
wherever they occur, like the entities themselves.

PMI >= IC - SLACK says n_et >= n_t / 2^SLACK, and n_et is n_e at most. So only pairs with SUPPORT <= n_t <= 2^SLACK n_e can pass, and no other is
looked at. Terms are counted first; a bitmap of fixed size (BITS) of those within the range drops nearly all others where a text is read, and the exact
counts drop the rest before a term meets its text's entities.

All of it is DataFrame operations. Texts are scanned: once for matches, once for the terms' document counts (summed in every task before they
move), once for the words of the documents with an entity of several contexts, once for the documents that hold a disclosing term, once for the places of
those terms. Matches and positions are small rows. A text moves to its entities or terms only if a bitmap of the keys of such texts has its bit.
Patterns are possessive or begin where a run of their characters does, so they are linear and need no stack on long runs.

Defined results: a null text is empty. Positions are code points, ends exclusive. Text inside a base span is no term. Rows of equal
text get equal spans; repeated rows and null ids keep their own rows. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.tables import ADDED, stored

#: The patterns' kinds, in their order.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
CONTEXT = 80
SUPPORT = 2
CHANCE = 0.05
SLACK = 1.0
#: Bits of a map of terms or keys: 2^18 rows of 64, 4 MB at any size of the corpus. A full map lets more rows through to the exact join.
BITS = 1 << 24
WORD = r"\p{L}{3,}"

_LOCAL = r"[A-Za-z0-9._%+-]"
_PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G)({_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)",
    "ip": r"(?:(?<![0-9])|\G)([0-9]++\.[0-9]++\.[0-9]++\.[0-9]++)",
    "card": r"([0-9](?:[\x20-]?[0-9])++)",
    "phone": r"(\+[0-9][\x20().0-9-]+[0-9])",
}


def _may_hold(text: Column, kind: str) -> Column:
    """What any checked match of the kind has; most texts end here."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    return text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]" if kind == "ip" else r"[0-9](?:[\x20-]?[0-9]){15}")


def _matches(text: Column, kind: str) -> Column:
    """Every match in order: characters since the one before, the value, and what stands to either side.

    What follows the last match is taken as one with an empty value. Without that, the search would begin anew at each of its
    characters, and its cost would be the square of their number.
    """
    pattern = F.lit(rf"(?s)(.*?)(?:{_PATTERNS[kind]}(?=(.{{0,{CONTEXT}}}))|\z)")
    gaps = F.transform(
        F.regexp_extract_all(text, pattern, F.lit(1)),
        lambda g: F.struct(F.length(g).alias("size"), F.right(g, F.lit(CONTEXT)).alias("before")),
    )
    values, after = F.regexp_extract_all(text, pattern, F.lit(2)), F.regexp_extract_all(text, pattern, F.lit(3))
    zipped = F.arrays_zip(gaps.alias("gap"), values.alias("value"), after.alias("after"))
    return F.when(_may_hold(text, kind), zipped)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small_part(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) <= 3) & (F.concat(F.lit("0"), F.substring(bare, 1, 3)).cast("int") <= 255)


def _luhn(digits: Column) -> Column:
    """Whether the weighted sum of 16 to 19 digits ends in 0."""

    def weighted(place: Column) -> Column:
        digit = F.substring(F.reverse(digits), place, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return F.when(place % 2 == 0, twice).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, place: total + weighted(place))
    return F.when(F.length(digits).between(16, 19), total % 10 == 0).otherwise(False)


def _valid(kind: Column, value: Column) -> Column:
    return (
        F.when(kind == 0, True)
        .when(kind == 1, F.forall(F.split(value, r"\."), _small_part))
        .when(kind == 2, _luhn(_digits(value)))
        .otherwise(F.length(_digits(value)).between(8, 15))
    )


def _with_key(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): rows of equal text have one key."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("key", F.md5("text"))


def find_matches(docs: DataFrame) -> DataFrame:
    """One row for each document: row, doc_id, key and an array of matches for each kind."""
    found = _with_key(docs).select("doc_id", "key", *(_matches(F.col("text"), k).alias(k) for k in KINDS))
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "disclosure")


def base_spans(matches: DataFrame) -> DataFrame:
    """row, key, kind, start, end, value, before, after of every checked match."""

    def numbered(kind: int) -> Column:
        own = F.transform(
            F.col(KINDS[kind]),
            lambda m, i: F.struct(
                F.lit(kind).alias("kind"), i.alias("place"), m.gap.size.alias("gap"), m.gap.before.alias("before"),
                m.value.alias("value"), m.after.alias("after"),
            ),
        )
        return F.coalesce(own, F.array().cast(_MATCH))

    every = F.concat(*map(numbered, range(len(KINDS))))
    rows = matches.select("row", "key", F.explode(every).alias("m")).select("row", "key", "m.*").where(F.col("value") != "")
    upto = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("value")
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(upto))
    rows = rows.withColumn("start", F.col("end") - size)
    return rows.where(_valid(F.col("kind"), F.col("value"))).drop("gap", "place")


_SPANS = "array<struct<kind:int,start:bigint,end:bigint>>"
_MATCH = "array<struct<kind:int,place:int,gap:int,before:string,value:string,after:string>>"


def disclosing_terms(
    docs: DataFrame, spans: DataFrame, n_docs: Column, support: int = SUPPORT, slack: float = SLACK
) -> DataFrame:
    """entity, term, pmi, ic of the terms that disclose an entity."""
    entity = F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1), "value")
    context = F.xxhash64(F.lower(F.concat("before", F.lit(" "), "after")))
    # Rows of equal text have one key: copies are counted, but their words are taken once.
    held = spans.select("key", "row", entity.alias("entity"), context.alias("context")).groupBy("entity", "key")
    held = held.agg(F.count_distinct("row").alias("rows"), F.min("context").alias("context"))
    rows_of = held.groupBy("entity").agg(F.sum("rows").alias("n_e"), F.count_distinct("context").alias("contexts"))
    held = stored(held.join(rows_of.where(F.col("contexts") >= support).select("entity", "n_e"), "entity"), "disclosure-held")
    texts = held.groupBy("key").agg(F.max("n_e").alias("most")).withColumn("id", F.monotonically_increasing_id())
    texts = stored(texts, "disclosure-texts")
    most = held.agg(F.max("n_e")).first()[0] or 0
    n_t = words_of(docs).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    rare = stored(n_t.where(F.col("n_t").between(support, most * 2**slack)), "disclosure-rare")
    plain = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.md5("text"))
    words = _perhaps_in(plain, texts, "key").join(texts, "key").select("id", "most", F.explode(_terms("text")).alias("term"))
    words = _perhaps_in(words, rare, "term").join(rare, "term").where(F.col("n_t") <= F.col("most") * 2**slack)
    words = words.select("id", "term", "n_t").distinct()
    pairs = words.join(held.join(texts.select("key", "id"), "key"), "id").where(F.col("n_t") <= F.col("n_e") * 2**slack)
    counts = [F.max(c).alias(c) for c in ("n_t", "n_e")]
    pairs = pairs.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.sum("rows").alias("n_et"), *counts)
    likely = stored(pairs.where(F.col("contexts") >= support), "disclosure-pairs")
    counted = likely.withColumn("n", n_docs)
    pmi = F.log2(F.col("n") * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    # Chernoff: n_t times the divergence of the share seen, n_et / n_t, from the share expected, n_e / n.
    rest, other = F.col("n_t") - F.col("n_et"), F.col("n") - F.col("n_e")
    absent = F.when((rest > 0) & (other > 0), rest * F.log(rest * F.col("n") / (F.col("n_t") * other))).otherwise(0.0)
    evidence = F.col("n_et") * pmi * math.log(2) + absent
    found = counted.where(evidence >= math.log(max(1, likely.count()) / CHANCE))
    # PMI >= IC - SLACK, without the rounding of logarithms.
    found = found.where(F.col("n_et") * 2**slack >= F.col("n_t"))
    return found.select("entity", "term", pmi.alias("pmi"), F.log2(F.col("n") / F.col("n_e")).alias("ic"))


def _perhaps_in(rows: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """The rows whose value has its bit in the map of the known values; the map's size is fixed, so it is broadcast."""
    place = F.pmod(F.xxhash64(column), F.lit(BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    map_rows = known.groupBy(F.floor(place / 64).alias("place")).agg(F.bit_or(bit).alias("bits"))
    found = rows.withColumn("place", F.floor(place / 64)).join(F.broadcast(map_rows), "place")
    return found.where(F.getbit("bits", (place % 64).cast("int")) == 1).select(*rows.columns)


def _terms(text: str) -> Column:
    """The distinct terms of a text; only e-mail addresses have letters that are none."""
    # With what hangs on an address by a further @, such as the end of a@b.c@d.
    plain = F.regexp_replace(text, _PATTERNS["email"] + r"(?:@\S*+)?", " ")
    bare = F.when(_may_hold(F.col(text), "email"), plain).otherwise(F.col(text))
    return F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(WORD), F.lit(0)))


def words_of(docs: DataFrame) -> DataFrame:
    """key, term: every document's distinct terms."""
    return _with_key(docs).select("key", F.explode(_terms("text")).alias("term"))


def term_spans(docs: DataFrame, terms: DataFrame, spans: DataFrame) -> DataFrame:
    """key, start, end of every occurrence of the terms, outside base spans."""
    holders = _perhaps_in(words_of(docs), terms, "term").join(terms, "term", "left_semi")
    holders = stored(holders.groupBy("key").agg(F.collect_set("term").alias("terms")), "disclosure-holders")
    texts = _perhaps_in(_with_key(docs), holders, "key").groupBy("key").agg(F.min("text").alias("text")).join(holders, "key")
    pattern = F.lit(rf"(?s)(.*?)(?:({WORD})|\z)")
    gaps = F.transform(F.regexp_extract_all("text", pattern, F.lit(1)), F.length)
    words = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("word"))
    # What follows the last word has an empty one, which is no term.
    places = F.transform(
        words, lambda m: F.struct(m.gap.alias("gap"), F.length(m.word).alias("size"), F.array_contains("terms", F.lower(m.word)).alias("held"))
    )
    # A word stays beside its text's others: the places are summed and tested without moving again.
    rows = texts.select("key", F.posexplode(places).alias("place", "m")).select("key", "place", "m.*")
    upto = Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).where("held")
    found = rows.select("key", (F.col("end") - F.col("size")).alias("start"), "end")
    base = spans.select(F.col("key").alias("k"), F.col("start").alias("s"), F.col("end").alias("e")).distinct()
    inside = (F.col("key") == F.col("k")) & (F.col("start") < F.col("e")) & (F.col("end") > F.col("s"))
    return found.join(base, inside, "left_anti")


def all_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matches (a row for each document), and key, kind, start, end of every span; kind 4 is a disclosing term."""
    matches = find_matches(docs)
    spans = stored(base_spans(matches), "disclosure-spans")
    terms = disclosing_terms(docs, spans, F.lit(matches.count()))
    terms = stored(terms.select("term").distinct(), "disclosure-terms")
    added = term_spans(docs, terms, spans).select("key", F.lit(len(KINDS)).alias("kind"), "start", "end")
    base = spans.select("key", "kind", "start", "end").distinct()
    return matches, base.unionByName(added)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, n_spans, has_personal_data of every document."""
    matches, spans = all_spans(docs)
    each = F.array_sort(F.collect_list(F.struct("kind", "start", "end")))
    by_key = spans.groupBy("key").agg(each.alias("found"))
    names = F.array(*map(F.lit, (*KINDS, TERM)))

    def spelled(found: Column) -> Column:
        return F.array_join(
            F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
        )

    rows = matches.select("doc_id", "key").join(by_key, "key", "left")
    rows = rows.select("doc_id", F.coalesce("found", F.array().cast(_SPANS)).alias("found"))

    def count(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("found", lambda s: s["kind"] < len(KINDS))
    return rows.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(spelled(base), 256).alias("base_sha256"),
        spelled(F.col("found")).alias("spans"),
        count(len(KINDS)).alias("n_term"),
        F.size("found").cast("long").alias("n_spans"),
        (F.size("found") > 0).alias("has_personal_data"),
    )


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span generalised to its kind, such as `<EMAIL>`; other columns as they are.

    Of spans that overlap, the later one is cut to what the earlier leaves. A null text stays null.
    """
    plain = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text"))
    _, spans = all_spans(plain)
    before = Window.partitionBy("key").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    cut = spans.withColumn("start", F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    cut = cut.where(F.col("start") < F.col("end"))
    by_key = cut.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias(ADDED + "_spans"))
    by_key = by_key.withColumnRenamed("key", ADDED)
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in (*KINDS, TERM)))
    held, own = F.col(ADDED + "_spans"), F.col(text)

    def piece(span: Column, i: Column) -> Column:
        """The text since the span before, and the kind in the span's place."""
        since = F.coalesce(F.get(held, i - 1)["end"], F.lit(0))
        return F.concat(F.substring(own, since + 1, span["start"] - since), F.element_at(names, span["kind"] + 1))

    rest = F.substring(own, F.element_at(held, -1)["end"] + 1, F.length(own))
    clean = F.when(held.isNull(), own).otherwise(F.concat(F.array_join(F.transform(held, piece), ""), rest))
    joined = docs.withColumn(ADDED, F.md5(F.coalesce(text, F.lit("")))).join(by_key, ADDED, "left")
    return joined.withColumn(text, clean).select(*docs.columns)
