"""Personal data: patterns for protected entities, and terms whose co-occurrence reveals them, on built-in functions only.

Base entities are e-mail addresses, IP addresses, card numbers and phone numbers, leftmost matches per kind that don't overlap; matches that fail
a kind's test are dropped. Terms (words of four letters or more) anywhere in a text with an entity may disclose it: over all rows,
PMI(term; entity) = log2(n(term, entity) * N / (n(term) * n(entity))) is held against the entity's own information log2(N / n(entity)). A term whose
share of it reaches the threshold is telling. It must stand with the entity in at least `support` different texts, two unless asked otherwise:
one text alone has every pair of its rare words in common, and copies count as one. A telling term is a span wherever it stands, in texts without
the entity too, since it reveals it there; it is generalised to its kind of word, or removed if it gives the entity away altogether.

Defined results: null and empty texts have no spans. Rows keep their number; ids may be null or repeated. Offsets count code points.
Words longer than MAX_TERM letters are no terms.
Patterns are written so that Java matches them without recursion and without trying a long run again from each of its characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut
from .secret_scan import matches

KINDS = ["email", "ip", "card", "phone"]

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must have before its kind's pattern is tried.
MAY_HAVE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}

_PART = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
TERM = r"\p{L}{4,}"
#: Letters of a term at most.
MAX_TERM = 64
#: Parts into which the rows of one text are dealt.
SALTS = 16


@dataclass(frozen=True)
class PiiConfig:
    """threshold: share of the entity's information from which a term discloses it. removed: the share from which the term goes instead of being generalised.

    support: different texts that have both.
    """

    threshold: float = 0.75
    removed: float = 0.999
    support: int = 2


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit holds."""
    last_first = F.split(F.reverse(digits), "")
    doubled = F.transform(last_first, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _test(kind: str):
    return lambda m: _passes(kind, m["value"])


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(13, 19), luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _span(kind: int):
    """Makes the span of a match of the kind with this number."""
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value"))


_SPANS = "array<struct<kind:int,start:int,end:int,value:string>>"


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value) by kind and start."""
    parts = []
    for i, kind in enumerate(KINDS):
        may = F.instr(text, MAY_HAVE[kind]) > 0 if kind == "email" else text.rlike(MAY_HAVE[kind])
        found = F.filter(matches(text, PATTERNS[kind]), _test(kind))
        parts.append(F.when(may, F.transform(found, _span(i))).otherwise(F.array().cast(_SPANS)))
    return F.coalesce(F.concat(*parts), F.array().cast(_SPANS))


def _words(text: Column) -> Column:
    """The different terms of a text, lower-cased."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))), lambda w: F.length(w) <= MAX_TERM)


def telling_terms(base: DataFrame, docs: DataFrame, value: Column, n_rows: int, config: PiiConfig) -> DataFrame:
    """(term, removed) of the terms that disclose an entity, from rows (key, spans, txt) with spans and all rows of `docs`, whose text is `value`.

    With N rows a term of n(term) rows can only reach the threshold h for an entity if n(term) <= N ** (1 - h) * n(entity) ** h, since both have
    n(entity) rows at most. So words are counted over all rows first, and only rare ones meet the entities of their texts.
    """
    entity = lambda s: F.concat_ws(":", s["kind"].cast("string"), F.lower(s["value"]))
    per_text = base.select("key", F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity")).groupBy("entity", "key").agg(F.count(F.lit(1)).alias("n"))
    entities = per_text.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= config.support).drop("texts")
    # texts once with the number of their rows; only those with an entity that several texts have go on
    total = float(max(n_rows, 1))
    held = cut(per_text.join(entities, "entity").withColumn("most", F.pow(F.lit(total), F.lit(1 - config.threshold)) * F.pow("n_entity", F.lit(config.threshold)) * F.lit(1 + 1e-9)))
    keys = held.groupBy("key").agg(F.max("most").alias("most"))
    texts = base.select("key", "txt").join(keys.select("key"), "key", "left_semi").groupBy("key").agg(F.first("txt").alias("txt"))
    words = cut(texts.select("key", F.explode(_words(F.col("txt"))).alias("term")))
    terms = cut(words.select("term").distinct())
    n_terms = terms.count()
    if not n_terms:
        return terms.withColumn("removed", F.lit(False))
    known = broadcast_if_small(terms, n_terms * (MAX_TERM + 64))
    # words are counted before they meet the terms, so no step makes a row for each place where a frequent term stands
    counted = docs.select(F.explode(_words(value)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).join(known, "term", "left_semi")
    counted = counted.where(F.col("n_term") <= keys.agg(F.coalesce(F.max("most"), F.lit(0.0))).first()[0])
    rare = words.join(counted, "term").join(held, "key").where(F.col("n_term") <= F.col("most"))
    both = rare.groupBy("entity", "term").agg(F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"), F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= config.support)
    information = F.greatest(F.log2(F.lit(total) / F.col("n_entity")), F.lit(1e-9))
    share = F.log2(F.col("n_both") * F.lit(total) / (F.greatest("n_term", "n_both") * F.col("n_entity"))) / information
    return both.withColumn("share", share).where(F.col("share") >= config.threshold).groupBy("term").agg(F.max(F.col("share") >= config.removed).alias("removed"))


_PLACES = "array<struct<start:int,end:int,removed:boolean>>"


def _places(text: Column, telling: Column) -> Column:
    """Where the telling terms (array of term, removed) of a text stand; the fold grows by those places only, however many words there are."""
    values = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    gaps = F.transform(F.split(text, TERM, -1), lambda x: F.length(x))
    removed = F.map_from_entries(telling)

    def step(a: Column, x: Column) -> Column:
        start, term = a["at"] + x["g"], F.lower(x["v"])
        end = start + F.length(x["v"])
        more = F.array(F.struct(start.alias("start"), end.alias("end"), F.try_element_at(removed, term).alias("removed")))
        return F.struct(end.alias("at"), F.when(F.map_contains_key(removed, term), F.concat(a["out"], more)).otherwise(a["out"]).alias("out"))

    return F.aggregate(F.arrays_zip(values.alias("v"), F.slice(gaps, 1, F.size(values)).alias("g")), F.struct(F.lit(0).alias("at"), F.array().cast(_PLACES).alias("out")), step)["out"]


def detect(docs: DataFrame, config: PiiConfig = PiiConfig(), keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep` of every row with base (array of kind, start, end, value) and terms (array of start, end, removed)."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kept = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], F.md5(value).alias("key"), value.alias("txt"))
    # texts with an entity stay in the table beside their spans, so that they needn't be found again
    base = cut(rows.withColumn("spans", base_spans(F.col("txt"))).withColumn("txt", F.when(F.size("spans") > 0, F.col("txt"))))
    telling = cut(telling_terms(base.where(F.size("spans") > 0).select("key", "spans", "txt"), docs, value, base.count(), config))
    n_telling = telling.count()
    short = F.col("spans").alias("base")
    none = F.array().cast(_PLACES)
    if not n_telling:
        return base.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], short, none.alias("terms"))
    known = broadcast_if_small(telling, n_telling * (MAX_TERM + 64))
    # which terms a text has; telling terms stand in few texts, since they say much about one entity
    mine = rows.select("key", F.explode(_words(F.col("txt"))).alias("term")).join(known, "term").groupBy("key").agg(F.collect_set(F.struct("term", "removed")).alias("mine"))
    mine = cut(mine)
    keys = mine.select("key")
    different = rows.select("key", "txt").join(broadcast_if_small(keys, keys.count() * 64), "key", "left_semi").groupBy("key").agg(F.first("txt").alias("txt"))
    added = different.join(mine, "key").select("key", _places(F.col("txt"), F.col("mine")).alias("terms"))
    # rows meet their text's terms by salted keys, since one text may be a third of all rows
    salted = base.withColumn("salt", F.pmod(F.xxhash64(*kept), F.lit(SALTS)))
    added = added.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    out = salted.join(added, ["key", "salt"], "left")
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], short, F.coalesce("terms", none).alias("terms"))


def listed(base: Column) -> Column:
    """Base spans as kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(base, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, base: Column, terms: Column) -> Column:
    """The text with entities as [KIND], disclosing terms as [NAME] or [WORD], by their first letter, or, if they give an entity away, without them."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    all_spans = F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(marks, s["kind"]).alias("mark"))),
        F.transform(terms, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["removed"], F.lit("")).when(F.substring(text, s["start"] + 1, F.lit(1)).rlike(r"\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[WORD]")).alias("mark"))),
    )
    # of spans that overlap the first stands for all
    folded = F.aggregate(
        F.array_sort(all_spans),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["mark"])).otherwise(a["out"]).alias("out")),
    )
    return F.concat(folded["out"], F.substring(text, folded["at"] + 1, F.length(text)))
