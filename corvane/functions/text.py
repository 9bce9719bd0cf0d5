"""Scalar text functions as Column expressions: tokens, names, paths, lines, dates, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English function words that are no terms.
STOP_WORDS = (
    "a about across after all also an and any are as at be because been before being both by can could did do does each every for from had has have here how if in "
    "into is it its many may more most must not of often on only onto or other per should some such than that the their them then there these they this those to too unless "
    "until upon use using very via was were what when where which who whom whose will with would"
).split()

# Words that are no terms of a default query.
QUERY_STOP_WORDS = ["about", "and", "for", "from", "not", "the", "this", "with"]

# Languages by extension.
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp",
    "rb": "ruby", "sh": "shell", "bash": "shell", "sql": "sql", "md": "markdown", "markdown": "markdown", "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json", "html": "html", "css": "css",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[0-9]+|[A-Z]*[a-z]+|[A-Z]+"


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z and nothing else."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def identifier_tokens(text: Column) -> Column:
    """Lower-case runs of letters, cut where lower case meets upper case, and runs of digits."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def is_term(token: Column) -> Column:
    """Longer than one character and no stop word."""
    return (F.length(token) > 1) & ~F.coalesce(F.array_contains(F.array(*map(F.lit, STOP_WORDS)), token), F.lit(False))


def terms(text: Column) -> Column:
    """Tokens that count as terms."""
    # the stop list in the pattern costs less than a search in an array for each token
    kept = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.transform(F.filter(kept, lambda t: (F.length(t) > 1) & ~F.lower(t).isin(STOP_WORDS)), F.lower)


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def file_name(path: Column) -> Column:
    """The last component of a path."""
    return F.element_at(F.split(path, "/"), -1)


def base_name(path: Column) -> Column:
    """The last component without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """The last extension without its dot, '' without one."""
    return F.regexp_extract(file_name(path), r"(?<=.)\.([^.]*)$", 1)


def directory(path: Column) -> Column:
    """All but the last component, '' at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def language(path: Column) -> Column:
    """The language of a file by its extension, null for others."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(extension(path)))


def normalize_path(path: Column) -> Column:
    """Without '.' and with '..' resolved; null if it leaves the top."""
    folded = F.aggregate(
        F.split(path, "/"),
        F.struct(F.array().cast("array<string>").alias("parts"), F.lit(True).alias("ok")),
        lambda a, p: F.when((p == "") | (p == "."), a)
        .when(p == "..", F.struct(F.slice(a["parts"], 1, F.greatest(F.size(a["parts"]) - 1, F.lit(0))).alias("parts"), (a["ok"] & (F.size(a["parts"]) > 0)).alias("ok")))
        .otherwise(F.struct(F.concat(a["parts"], F.array(p)).alias("parts"), a["ok"].alias("ok"))),
    )
    return F.when(folded["ok"], F.array_join(folded["parts"], "/"))


def truncate_utf8(text: Column, max_bytes: int) -> Column:
    """The longest head of at most so many bytes that ends between characters."""
    head = F.substring(F.encode(text, "UTF-8"), 1, max_bytes)
    # a cut character leaves one to three replacement marks at the end of the decoded head
    cut = F.regexp_replace(F.hex(head), "(?:F[0-7](?:[89AB][0-9A-F]){0,2}|E[0-9A-F](?:[89AB][0-9A-F]){0,1}|[CD][0-9A-F])$", "")
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(F.decode(F.unhex(cut), "UTF-8"))


def estimate_tokens(n_bytes: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(n_bytes / 4).cast("long")


def identifier_runs(text: Column) -> Column:
    """Runs of letters, digits and -_. without those signs at their ends."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}._-]+"), F.lit(0))
    return F.filter(F.transform(runs, lambda r: F.regexp_replace(r, "^[-_.]+|[-_.]+$", "")), lambda r: r != "")


def query_entities(text: Column) -> Column:
    """Distinct lower-case runs of six bytes or more that hold one of -_. , sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(identifier_runs(text), lambda r: (F.octet_length(r) >= 6) & r.rlike("[-_.]")), lower_ascii)))


def query_terms(text: Column) -> Column:
    """Distinct lower-case runs of three bytes or more without one of -_. that are no stop words, sorted."""
    plain = F.filter(identifier_runs(text), lambda r: ~r.rlike("[-_.]") & (F.octet_length(r) >= 3))
    return F.array_sort(F.array_distinct(F.filter(F.transform(plain, lower_ascii), lambda r: ~r.isin(QUERY_STOP_WORDS))))


def match_positions(text: Column, pattern: str) -> Column:
    """Array of (start, value) of the pattern's leftmost matches; start counts code points from 0."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    folded = F.aggregate(
        F.arrays_zip(values.alias("v"), F.slice(gaps, 1, F.size(values)).alias("g")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out")),
        lambda a, x: F.struct((a["at"] + x["g"] + F.length(x["v"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("start"), x["v"].alias("value")))).alias("out")),
    )
    return folded["out"]


def front_matter(text: Column) -> Column:
    """struct(opened, header, body): whether the first row is a fence of three dashes, the rows up to the next fence (null without one), and the rest.

    The text is cut once, at the first closing fence; Java's patterns recurse for each row of a group, so none spans rows. The parts are bound to a
    name by a lambda, which keeps the planner from cutting again for each field.
    """
    opened = F.substring_index(text, "\n", 1).rlike(r"\A\x{FEFF}?[ \t]*---[ \t]*\r?\z")
    # a fence is a whole row; what may follow its dashes is what `$` takes for a row's end
    parts = F.when(opened, F.split(text, r"\n[ \t]*---[ \t]*\r?[\r\x{85}\x{2028}\x{2029}]?(?=\n|\z)", 2)).otherwise(F.array(text))

    def fields(p: Column) -> Column:
        before, after = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        header = F.when(after.isNotNull(), F.when(F.contains(before, F.lit("\n")), F.concat(F.regexp_replace(before, r"\A[^\n]*\n", ""), F.lit("\n"))).otherwise(""))
        body = F.when(after.isNotNull(), F.when(F.startswith(after, F.lit("\n")), F.substring(after, F.lit(2), F.length(after))).otherwise("")).when(opened, "").otherwise(text)
        return F.struct(opened.alias("opened"), header.alias("header"), body.alias("body"))

    return F.get(F.transform(F.array(parts), fields), F.lit(0))


def is_iso_date(text: Column) -> Column:
    """YYYY-MM-DD that the calendar has."""
    return F.coalesce(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def light_stem(word: Column) -> Column:
    """A plain stem of a lower-case word of five letters or more, null where none is safe: plural, -ed and -ing endings off, a doubled last consonant single."""
    single = lambda w: F.regexp_replace(w, r"^(.{2,})([bcdfghjkmnpqrtvwxyz])\2$", "$1$2")
    made = (
        F.when(F.endswith(word, F.lit("ies")), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(?:sh|ch|ss|x|z)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("(?<![sui])s$"), F.regexp_replace(word, "s$", ""))
        .when(F.endswith(word, F.lit("ed")), single(F.regexp_replace(word, "ed$", "")))
        .when(word.rlike("....ing$"), single(F.regexp_replace(word, "ing$", "")))
    )
    return F.when(word.rlike("^[a-z]{5,}$") & (F.length(made) >= 3), made)


def morph_norm(word: Column) -> Column:
    """The form by which a question's word meets tokens: its stem, or itself if it ends in y; null for words without either."""
    stem = light_stem(word)
    return F.when(word.rlike("^[a-z]{3,}$"), F.coalesce(stem, F.when(F.endswith(word, F.lit("y")), word)))


def has_morph_token(text: Column, norm: str) -> Column:
    """Whether a whole token of the text, or its stem, is the form; only tokens that begin with the form's root are stemmed."""
    root = norm.removesuffix("y")
    tokens = F.regexp_extract_all(text, F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}])\Q{root}\E[A-Za-z0-9]*+(?![\p{{L}}\p{{N}}])"), F.lit(0))
    return F.exists(F.transform(tokens, lower_ascii), lambda t: (t == norm) | F.coalesce(light_stem(t) == norm, F.lit(False)))


def has_morph_subword(text: Column, root: str, least: int) -> Column:
    """Whether the root, a word of `least` letters or more, begins at a token's start, at a hump of camel case or after a digit; case of A-Z aside."""
    if len(root) < least or not root.isascii():
        return F.lit(False)
    begin = r"(?:\A|(?<=[\x00-\x7F&&[^A-Za-z0-9]])|(?<=[a-z0-9])(?=[A-Z])|(?<=[0-9])(?=[^0-9]))"
    return text.rlike(rf"{begin}(?i:\Q{root}\E)")


def has_alnum_token(text: Column, token: str) -> Column:
    """Whether the token stands in the text, case of A-Z aside, with no letter or digit beside it."""
    return F.coalesce(text.rlike(rf"(?iU)(?<![\p{{L}}\p{{N}}])\Q{token}\E(?![\p{{L}}\p{{N}}])"), F.lit(False))


def occurrences_capped(text: Column, term: str, cap: int = 3) -> Column:
    """How often the term stands in the text, case aside, without overlap, at most `cap`."""
    return F.least(F.regexp_count(F.lower(text), F.lit(rf"\Q{term}\E")), F.lit(cap))


def first_field_reason(reason: Column) -> Column:
    """A match reason with its first field only."""
    return F.regexp_replace(reason, r"\+[^ ]*", "")


def match_kind(reason: Column) -> Column:
    """The kind of a match reason: what stands before the colon."""
    return F.split_part(reason, F.lit(":"), F.lit(1))


def lead_of_document(text: Column) -> Column:
    """Title-like lines among the first fifty, four at most, 230 characters each, joined by spaces."""
    lines = F.filter(F.slice(F.split(text, "\n"), 1, 50), lambda s: s.rlike("^(?:# |title:|purpose:|description:|aliases:|tags:)"))
    return F.array_join(F.transform(F.slice(lines, 1, 4), lambda s: F.substring(s, 1, 230)), " ")


def lead_of_code(text: Column) -> Column:
    """Comment lines among the first thirty, twelve at most, joined by spaces."""
    lines = F.filter(F.slice(F.split(text, "\n"), 1, 30), lambda s: s.rlike("^(?:#|//|\"\"\"|'''|;)"))
    return F.array_join(F.slice(lines, 1, 12), " ")


def markdown_links(text: Column) -> Column:
    """Targets of inline links that aren't anchors, addresses of the web or of mail."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"\]\(([^)]*)\)"), F.lit(1)), lambda t: ~t.rlike(r"^(?:#|[a-z][a-z0-9+.-]*://|mailto:)") & (t != ""))


def citations(text: Column) -> Column:
    """path.ext:line references."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_./-]+\.(?:rs|py|js|ts|go|java|md|toml|ya?ml|json|sh|sql):[0-9]+"), F.lit(0))


def column_letters(number: Column) -> Column:
    """A for 1, Z for 26, AA for 27, up to three letters."""
    char = lambda n: F.char((n + 65).cast("bigint"))
    one, two = number - 1, F.floor((number - 27) / 26)
    three = F.floor((number - 703) / 676)
    return F.concat(F.when(number > 702, char(three % 26)).otherwise(""), F.when(number > 26, char(two % 26)).otherwise(""), char(one % 26))
