"""Fielded BM25 ranking of files for a question, with reasons, a selection rule and explicit misses.

Lengths are sizes of term arrays in each row; only terms that can match the question are exploded, so one small shuffle counts them. Corpus
statistics are one row, broadcast. Sums over (stem, field) are folded in that order, so a score doesn't depend on the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M
from ..functions import text as tx
from ..functions.stem import agent_verb, stem, vocabulary_stems
from ..session import cut
from ..sources import corpus


@dataclass(frozen=True)
class Question:
    """A question's stems in order, surface tokens, and what it asks for."""

    text: str
    stems: tuple[str, ...]
    surface: tuple[str, ...]
    stemmed: bool
    asks_test: bool
    asks_value: bool
    asks_frequency: bool


_AUXILIARIES = {"are", "were", "do", "does", "did", "may", "can", "could", "must", "should", "will", "would", "have"}


def analyze(question: str, stemmed: bool = True) -> Question:
    """Stems and intent of a question; `stemmed` False takes tokens as they are."""
    import re

    tokens = [t.lower() for t in re.findall(tx.TOKEN, question)]
    kept = [t for t in tokens if len(t) > 1 and t not in tx.STOP_WORDS]
    stems = sorted({stem(t) if stemmed and not t[0].isdigit() else t for t in kept})
    words = [w.lower() for w in re.findall("[A-Za-z0-9]+", question)]
    pairs = set(zip(words, words[1:], strict=False))
    often = any(("how", w) in pairs for w in ("often", "frequently")) or "frequency" in words
    many = any(("how", w) in pairs for w in ("long", "many", "much"))
    plural = lambda w: len(w) > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is"))
    at = lambda i: words[i] if i < len(words) else ""
    sets = any(w == "which" and any(plural(at(i + k)) and at(i + k + 1) in _AUXILIARIES for k in (1, 2)) for i, w in enumerate(words))
    test = any(w in ("test", "tests", "testing") for w in words)
    request = any((a, b) in pairs for a in ("function", "command", "hook", "script", "manual", "guide") for b in ("is", "does", "implements"))
    return Question(question, tuple(stems), tuple(sorted(set(tokens))), stemmed, test, (often or many or sets) and not test and not request, often)


def fields_of(files: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """Adds the term arrays t0..t3 of filename, path, body and description, and role."""
    if descriptions is not None:
        files = files.join(descriptions.withColumnRenamed("description", "__extra"), "path", "left")
    role = corpus.path_role(F.col("path"))
    lead = F.when(role == "doc", tx.lead_of_document(F.col("text"))).otherwise(tx.lead_of_code(F.col("text")))
    described = F.concat_ws(" ", lead, F.col("__extra")) if descriptions is not None else lead
    columns = {
        "t0": tx.terms(corpus.filename_words(F.col("path"))), "t1": tx.terms(tx.directory(F.col("path"))), "t2": tx.terms(F.coalesce("text", F.lit(""))), "t3": tx.terms(F.coalesce(described, F.lit(""))),
        "role": corpus.content_role(F.col("path"), F.coalesce("text", F.lit(""))),
    }
    return files.withColumns(columns).drop("__extra")


def matching_tokens(fielded: DataFrame, q: Question) -> tuple[dict[str, str], dict[str, str]]:
    """(token to stem, token to stem by verb form): the words of the corpus that match the question. Verb forms count in filenames only.

    A stem keeps its word's first letter but for a few words, so few words reach the stemmer, each once; what comes back are only matches.
    """
    if not q.stemmed:
        return {s: s for s in q.stems}, {}
    starts = sorted({s[:1] for s in q.stems} | {"s", "d", "l", "t"})
    verbs: dict[str, str] = {}
    for s in q.stems:
        verbs.setdefault(agent_verb(s), s)
    tokens = fielded.select(F.explode(F.concat("t0", "t1", "t2", "t3")).alias("token")).where(F.substring("token", 1, 1).isin(starts))
    found = vocabulary_stems(tokens).where(F.col("stem").isin(list(q.stems)) | F.col("verb").isin(list(verbs))).collect()
    direct = {r["token"]: r["stem"] for r in found if r["stem"] in q.stems}
    return direct, {r["token"]: verbs[r["verb"]] for r in found if r["token"] not in direct and r["verb"] in verbs}


def _with_hits(ready: DataFrame, q: Question, direct: dict[str, str], by_verb: dict[str, str]) -> DataFrame:
    """Adds hits (array of (stem, field, tf) by stem and field) and literal (number of literal filename words) to rows with term arrays.

    The few matching tokens of each array become a column of their own first, so that counting them doesn't walk the whole text again for each stem.
    """

    def kept(column: str, table: dict[str, str]) -> Column:
        return F.filter(column, lambda t: t.isin(sorted(table))) if table else F.array().cast("array<string>")

    def stems_in(column: str, table: dict[str, str]) -> Column:
        if all(k == v for k, v in table.items()):
            return F.col(column)
        lookup = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
        return F.transform(column, lambda t: F.try_element_at(lookup, t))

    tables = [{**direct, **by_verb} if not k else direct for k in range(4)]
    small = ready.withColumns({f"__m{k}": kept(f"t{k}", tables[k]) for k in range(4)}).withColumns({f"__s{k}": stems_in(f"__m{k}", tables[k]) for k in range(4)})
    counted = [F.transform(F.array_distinct(f"__s{k}"), _counter(F.col(f"__s{k}"), k)) for k in range(4)]
    literal = sorted(t for t in {**direct, **by_verb} if t in q.surface)
    n_literal = F.size(F.filter("t0", lambda t: t.isin(literal))) if literal else F.lit(0)
    return small.withColumns({"hits": F.array_sort(F.concat(*counted)), "literal": n_literal.cast("long")})


def _counter(stems: Column, k: int):
    return lambda s: F.struct(s.alias("stem"), F.lit(k).alias("field"), F.size(F.filter(stems, lambda x: x == s)).alias("tf"))


def score(files: DataFrame, q: Question, classes: list | None = None, descriptions: DataFrame | None = None, shortlist: int = M.SHORTLIST) -> DataFrame:
    """One row for each file with evidence: tier, class, role, score, literal, tie, fields and partial (matched stems). `files` has unique paths.

    Texts are read once: what is left of each is a row of lengths and hits, which is cut off; all else works on those rows.
    """
    tier, name = corpus.classify(F.col("path"), classes or [])
    ready = fields_of(files.where(~corpus.excluded_from_brief(F.col("path"))), descriptions).withColumns({"tier": tier, "class": name})
    traits = ["path", "tier", "class", "role", "active", "canonical", "public_safe", "confidence", "freshness"]
    small = cut(_with_hits(ready, q, *matching_tokens(ready, q)).select(*traits, *[F.size(f"t{k}").alias(f"len{k}") for k in range(4)], "hits", "literal"))
    return score_rows(small, q, shortlist)


def score_rows(small: DataFrame, q: Question, shortlist: int = M.SHORTLIST) -> DataFrame:
    """Scores rows of traits, role, tier, class, lengths (len0..len3), literal and hits (array of stem, field, tf in that order), one for each file."""
    traits = ["path", "tier", "class", "role", "active", "canonical", "public_safe", "confidence", "freshness"]
    # the corpus is the least tier: one row of lengths and document frequencies
    lead = small.agg(F.min("tier").alias("lead"))
    leading = small.join(F.broadcast(lead), F.col("tier") == F.col("lead"))
    stems = [F.count_if(F.exists("hits", _body_hit(s))).alias(f"df{i}") for i, s in enumerate(q.stems)]
    any_of = [F.count_if(F.exists("hits", _any_hit(s))).alias(f"any{i}") for i, s in enumerate(q.stems)]
    stats = leading.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"len{k}").alias(f"avg{k}") for k in range(4)], F.count_if(F.size("hits") > 0).alias("admitted"), *stems, *any_of)
    rows = small.where(F.size("hits") > 0).crossJoin(F.broadcast(stats))
    count = len(q.stems)
    idf_of = F.create_map(*[x for i, s in enumerate(q.stems) for x in (F.lit(s), F.log1p((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)))])
    pick = lambda values, k: F.element_at(F.array(*values), k + 1)
    mean = [F.when(F.col(f"avg{k}") == 0, 1.0).otherwise(F.col(f"avg{k}")) for k in range(4)]
    weight, b = [F.lit(x) for x in M.FIELD_WEIGHTS], [F.lit(x) for x in M.LENGTH_NORMALIZATION]
    size = [F.col(f"len{k}") for k in range(4)]

    def part(h: Column) -> Column:
        k = h["field"]
        norm = F.lit(M.K1) * (F.lit(1.0) - pick(b, k) + pick(b, k) * pick(size, k) / pick(mean, k))
        return F.element_at(idf_of, h["stem"]) * pick(weight, k) * F.lit(M.K1 + 1) * h["tf"] / (h["tf"] + norm)

    lexical = F.aggregate("hits", F.lit(0.0), lambda a, h: a + part(h))
    tie = F.col("active") * 100 + F.col("canonical") * 50 + F.col("public_safe") * 20 + F.col("confidence")
    test = F.when(F.col("role") == "test", M.TEST_ROLE_WEIGHT if q.asks_test else -M.TEST_ROLE_WEIGHT).otherwise(0.0)
    # lower tiers count only if the least one has too few files or lacks a stem
    seen = sum(((F.col(f"any{i}") > 0).cast("int") for i in range(count)), F.lit(0))
    rows = rows.where((F.col("tier") == F.col("lead")) | (F.col("admitted") < shortlist) | (seen < count))
    rows = rows.withColumn("tie", tie.cast("long")).withColumn("score", lexical + F.lit(M.TRAIT_WEIGHT) * F.least("tie", F.lit(1023)) + test)
    fields = F.array_compact(F.array(*[F.when(F.array_contains(F.transform("hits", lambda h: h["field"]), k), F.lit(f)) for k, f in enumerate(M.FIELDS)]))
    return rows.select(*traits, "score", "literal", "tie", fields.alias("fields"), F.size(F.array_distinct(F.transform("hits", lambda h: h["stem"]))).alias("partial"))


# --- an index, so that texts are read once for many questions ------------------------------------------------------------

TRAITS = ["path", "role", "active", "canonical", "public_safe", "confidence", "freshness"]


@dataclass(frozen=True)
class TokenIndex:
    """files: TRAITS and len0..len3. postings: token, path, field, tf, sorted by token. vocabulary: token, stem, verb. All are tables of the shared folder."""

    files: DataFrame
    postings: DataFrame
    vocabulary: DataFrame


def build_index(files: DataFrame, descriptions: DataFrame | None = None) -> TokenIndex:
    """One pass over the texts; a question then reads the postings of its own tokens, which stand together."""
    ready = fields_of(files.where(~corpus.excluded_from_brief(F.col("path"))), descriptions)
    own = cut(ready.select(*TRAITS, *[F.size(f"t{k}").alias(f"len{k}") for k in range(4)]))
    fields = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"t{k}").alias("tokens")) for k in range(4)])
    tokens = ready.select("path", F.explode(fields).alias("f")).select("path", "f.field", F.explode("f.tokens").alias("token"))
    counted = tokens.groupBy("token", "path", "field").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    # a token's postings may be many, so the order goes on with the path
    postings = cut(counted.repartitionByRange(F.col("token"), F.col("path")).sortWithinPartitions("token", "path"))
    return TokenIndex(own, postings, cut(vocabulary_stems(postings.select("token"))))


def score_indexed(index: TokenIndex, q: Question, classes: list | None = None, shortlist: int = M.SHORTLIST) -> DataFrame:
    """What `score` gives, from an index."""
    tier, name = corpus.classify(F.col("path"), classes or [])
    if q.stemmed:
        verbs: dict[str, str] = {}
        for s in q.stems:
            verbs.setdefault(agent_verb(s), s)
        found = index.vocabulary.where(F.col("stem").isin(list(q.stems)) | F.col("verb").isin(list(verbs))).collect()
        direct = {r["token"]: r["stem"] for r in found if r["stem"] in q.stems}
        by_verb = {r["token"]: verbs[r["verb"]] for r in found if r["token"] not in direct and r["verb"] in verbs}
    else:
        direct, by_verb = {s: s for s in q.stems}, {}
    table_ = {**direct, **by_verb}
    lookup = F.create_map(*[F.lit(x) for pair in sorted(table_.items()) for x in pair]) if table_ else F.lit(None).cast("map<string,string>")
    asked = index.postings.where(F.col("token").isin(sorted(table_))) if table_ else index.postings.where("false")
    if by_verb:  # verb forms count in filenames only
        asked = asked.where(~F.col("token").isin(sorted(by_verb)) | (F.col("field") == 0))
    literal = sorted(t for t in table_ if t in q.surface)
    is_literal = (F.col("field") == 0) & F.col("token").isin(literal) if literal else F.lit(False)
    per_stem = asked.groupBy("path", "field", F.try_element_at(lookup, F.col("token")).alias("stem")).agg(F.sum("tf").cast("int").alias("tf"), F.sum(F.when(is_literal, F.col("tf")).otherwise(0)).alias("literal"))
    hits = per_stem.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("stem", "field", "tf"))).alias("hits"), F.sum("literal").cast("long").alias("literal"))
    none = F.array().cast("array<struct<stem:string,field:int,tf:int>>")
    rows = index.files.withColumns({"tier": tier, "class": name}).join(hits, "path", "left").withColumns({"hits": F.coalesce("hits", none), "literal": F.coalesce("literal", F.lit(0).cast("long"))})
    return score_rows(rows, q, shortlist)


def _body_hit(s: str):
    return lambda h: (h["field"] == 2) & (h["stem"] == s)


def _any_hit(s: str):
    return lambda h: h["stem"] == s


def fixed_point(value: Column, offset: int = 0) -> Column:
    """A score as a whole number of millionths, not below 0."""
    return F.floor(F.greatest(value + offset, F.lit(0.0)) * M.SCORE_SCALE).cast("long")


def brief_order() -> list[Column]:
    """Tier, then score, literal hits, tie and freshness falling, then path."""
    return [F.asc("tier"), F.desc("points"), F.desc("offset_points"), F.desc("literal"), F.desc("tie"), F.desc("freshness"), F.asc("path")]


def with_exact_units(scored: DataFrame, files: DataFrame, question: str) -> DataFrame:
    """Adds exact: entities of the question in path or text, and terms that are the whole path."""
    spark = scored.sparkSession
    row = spark.range(1).select(tx.query_entities(F.lit(question)).alias("e"), tx.query_terms(F.lit(question)).alias("t")).first()
    low_path, low_text = tx.lower_ascii(F.col("path")), tx.lower_ascii(F.coalesce("text", F.lit("")))
    hits = [F.when(F.contains(low_path, F.lit(e)) | F.contains(low_text, F.lit(e)), 1).otherwise(0) for e in row["e"]] + [F.when(low_path == t, 1).otherwise(0) for t in row["t"]]
    if not hits:
        return scored.withColumn("exact", F.lit(0))
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return scored.join(files.select("path", total.alias("exact")), "path")


def shortlisted(scored: DataFrame, shortlist: int = M.SHORTLIST) -> DataFrame:
    """The best rows by brief order alone; reasons don't change the order, so what they need is looked up for these."""
    ready = scored.withColumns({"points": fixed_point(F.col("score")), "offset_points": fixed_point(F.col("score"), M.SCORE_OFFSET)})
    return F.broadcast(cut(ready.orderBy(*brief_order()).limit(shortlist).drop("points", "offset_points")))


def rank(scored: DataFrame, top: int = M.BRIEF_TOP, shortlist: int = M.SHORTLIST) -> DataFrame:
    """The shortlist by brief order, cut by the selection rule, ranked densely, `top` rows at most."""
    exact = F.col("exact") if "exact" in scored.columns else F.lit(0)
    kind = F.when(exact > 0, F.lit("exact")).otherwise(F.lit("partial"))
    label = F.when(F.col("class").isNotNull(), F.concat(F.lit(" ["), F.col("class"), F.lit("]"))).otherwise("")
    ready = scored.withColumns({"points": fixed_point(F.col("score")), "offset_points": fixed_point(F.col("score"), M.SCORE_OFFSET), "reason": F.concat(kind, F.lit(":"), F.array_join("fields", "+"), label)})
    best = ready.orderBy(*brief_order()).limit(shortlist)
    # at most `shortlist` rows from here on
    order = Window.orderBy(*brief_order())
    numerator, denominator = M.RULE_SHARE
    first = F.first("points").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept = best.withColumn("top_points", first).where((F.col("points") * denominator >= F.col("top_points") * numerator) | (F.col("top_points") == 0))
    ranked = kept.withColumn("rank", F.row_number().over(Window.orderBy(*brief_order()))).where(F.col("rank") <= top)
    return ranked.select("rank", "path", "tier", "points", "literal", "tie", "partial", "reason")


def value_sources(scored: DataFrame, files: DataFrame, q: Question) -> DataFrame:
    """Raises config files that eligible documents or code name, that have a schedule, or whose keys share a stem with the question."""
    peak = scored.agg(F.max("score").alias("peak"))
    refs = resolve_references(files.join(scored.where(F.col("role").isin("doc", "code")).select("path", "score"), "path"), files)
    refer = refs.join(scored.select(F.col("path").alias("from"), F.col("score").alias("own")), "from").groupBy(F.col("to").alias("path")).agg(F.greatest(F.max("own"), F.lit(0.0)).alias("refer"))
    role = corpus.content_role(F.col("path"), F.coalesce("text", F.lit("")))
    config = files.withColumn("role", role).where("role = 'config'").select("path", "text").join(refer, "path", "left").join(scored.select("path", "score"), "path", "left").crossJoin(F.broadcast(peak))
    stems = F.array(*map(F.lit, q.stems)) if q.stems else F.array().cast("array<string>")
    keys = tx.terms(F.array_join(F.regexp_extract_all("text", F.lit(r"(?m)(?:^|[,{])\s*[\"']?([A-Za-z_][A-Za-z0-9_.-]*)[\"']?\s*[:=]"), F.lit(1)), " "))
    head = F.lower(F.substring("text", 1, 2000))
    timer = F.lit(q.asks_frequency) & head.rlike(r"(?m)^\[timer\]|^\s*(?:schedule|cron):|(?<![A-Za-z0-9_])oncalendar=")
    refer_of, own = F.coalesce("refer", F.lit(0.0)), F.coalesce("score", F.lit(0.0))
    strong = refer_of > F.lit(M.REFERENCE_SUPPORT) * F.col("peak")
    raised = own + F.greatest(F.lit(M.REFERENCE_TRANSFER) * (refer_of - own), F.lit(0.0)) + F.lit(M.VALUE_PEAK_SHARE) * F.col("peak") + F.when(timer, F.lit(M.SCHEDULE_PEAK_SHARE) * F.col("peak")).otherwise(0.0)
    config = config.withColumns({"strong": strong, "timer": timer, "keyed": F.arrays_overlap(keys, stems)})
    return config.where((F.col("score").isNotNull() | F.col("strong")) & (F.col("strong") | F.col("timer") | F.col("keyed"))).select("path", raised.alias("score"), F.col("strong").alias("referenced"))


def resolve_references(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(from, to) of path-like words in texts: relative to the file, then to the root, then the only path that ends so."""
    runs = sources.select(F.col("path").alias("from"), F.explode(F.split("text", "\n")).alias("line")).where(F.octet_length("line") <= 3000)
    raw = runs.select("from", F.explode(F.regexp_extract_all("line", F.lit(r"[A-Za-z0-9_.+@/-]*[/.][A-Za-z0-9_.+@/-]*"), F.lit(0))).alias("raw"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", r"\.+$", ""), "^/+|/+$", ""), r"^\./", "")
    wanted = raw.select("from", clean.alias("raw")).where(F.length("raw") >= 4).distinct()
    wanted = wanted.withColumn("local", tx.normalize_path(F.concat_ws("/", tx.directory(F.col("from")), F.col("raw"))))
    known = files.select(F.col("path").alias("hit"))
    found = wanted.join(known.withColumnRenamed("hit", "a"), F.col("local") == F.col("a"), "left").join(known.withColumnRenamed("hit", "b"), F.col("raw") == F.col("b"), "left")
    exact = found.where("a is not null or b is not null").select("from", F.coalesce("a", "b").alias("to"))
    loose = found.where("a is null and b is null").withColumn("name", F.lower(tx.file_name(F.col("raw"))))
    named = files.select(F.col("path").alias("to"), F.lower(tx.file_name(F.col("path"))).alias("name"), F.lower("path").alias("low"))
    suffix = loose.join(named, "name").where((F.col("low") == F.lower("raw")) | F.endswith(F.col("low"), F.concat(F.lit("/"), F.lower("raw"))))
    single = suffix.groupBy("from", "raw").agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("to")).where("n = 1").select("from", "to")
    return exact.unionByName(single).where(F.col("from") != F.col("to")).distinct()


def outcome(matched: Column, unmatched: Column, ranked: Column) -> Column:
    """miss without a ranked file, partial_unanchored with an unmatched entity, else grounded."""
    return F.when(~ranked | (F.size(matched) == 0), "miss").when(F.exists(unmatched, lambda u: u.rlike("[-_.]") & (F.length(u) >= 6)), "partial_unanchored").otherwise("grounded")


#: Different words of all questions up to which they are looked up in each text; more meet the texts' words by a join.
MANY_WORDS = 1 << 16


def _counted(terms: Column) -> Column:
    """Array of (term, tf) of a sorted array of terms: a term goes from its first place to that of the next."""
    begins = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    pairs = lambda s, b: F.transform(b, lambda x, k: F.struct(F.get(s, x).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - x).alias("tf")))
    # lambdas over arrays of one bind the parts, which would else be made again for each place
    bound = F.flatten(F.flatten(F.transform(F.array(terms), lambda s: F.transform(F.array(begins(s)), lambda b: pairs(s, b)))))
    return F.when(F.size(terms) > 0, bound).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


def rank_many(files: DataFrame, questions: DataFrame, top: int = 8) -> DataFrame:
    """(question_id, rank, path, points): BM25 over bodies for many questions at once; `questions` has question_id and terms.

    Texts are read once: what is left of each are its length and the counts of the questions' words, cut off. Rows of a file stand in one task, so its sums
    need no shuffle, and each task sends on its best rows of a question only.
    """
    body = files.select("path", tx.terms(F.coalesce("text", F.lit(""))).alias("t2")).withColumn("len", F.size("t2"))
    wanted = cut(questions.select("question_id", F.explode(F.array_distinct("terms")).alias("term")))
    vocabulary = wanted.select("term").distinct()
    words = [r["term"] for r in vocabulary.limit(MANY_WORDS + 1).collect()]
    few = len(words) <= MANY_WORDS
    if few:
        asked = body.select("path", "len", F.sort_array(F.filter("t2", lambda t: t.isin(words))).alias("kept"))
        small = cut(asked.select("path", "len", _counted(F.col("kept")).alias("hits")))
        tf = small.repartition("path").select("path", "len", F.explode_outer("hits").alias("h")).select("path", "len", "h.term", F.col("h.tf").cast("long").alias("tf")).where("term is not null")
        if not small.groupBy("path", "len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():  # files of one path and length count as one
            tf = tf.groupBy("path", "len", "term").agg(F.sum("tf").alias("tf"))
    else:
        small = cut(body.select("path", "len"))
        tf = body.select("path", "len", F.explode("t2").alias("term")).join(vocabulary, "term", "left_semi").groupBy("path", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = small.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats))
    weights = df.select("term", "avg", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * (M.K1 + 1) * F.col("tf") / (F.col("tf") + M.K1 * (1 - M.LENGTH_NORMALIZATION[2] + M.LENGTH_NORMALIZATION[2] * F.col("len") / F.col("avg")))
    # at most as many rows as words
    weights = F.broadcast(cut(weights)) if few else weights
    # whole numbers: sums are the same in every order
    points = tf.join(weights, "term").select("path", "term", F.floor(part * M.SCORE_SCALE).cast("long").alias("p"))
    summed = points.join(wanted, "term").groupBy("question_id", "path").agg(F.sum("p").alias("points"))
    order = Window.partitionBy("question_id").orderBy(F.desc("points"), F.asc("path"))
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("question_id", "rank", "path", "points")
