"""Secret scans: candidates by pattern, false positives removed by a random forest, on built-in functions only.

Candidates are runs of key-like characters: known key formats, values that are assigned to a name, and long runs of mixed characters. Each has
features: its length, kinds of characters and transitions between them, distinct characters, repeated and rising neighbours, frequent letter pairs, coverage by
a dictionary, words of its path and of the text around it. The dictionary is the most frequent words of all texts (`dictionary`). A forest of decision trees is trained from labelled findings on the driver, over a
bounded number of rows, and is evaluated by walking arrays of nodes. Scores are whole hundredths of votes.

Where no labelled findings are given, `generated_findings` makes them from rules: keys of known formats and random values next to
assignments are true; words, numbers, dates, paths, placeholders, repeated and counted-up characters, unassigned digests are false.

Defined results: null and empty texts have no findings; equal candidates at other places are findings of their own; offsets count code points.
Ties of votes count as true; of equally frequent words the dictionary takes the first in their order. Rows are kept one for one.
"""

from __future__ import annotations

import random
import string
from dataclasses import dataclass
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import free_name

#: Beginnings of public key formats.
FORMATS = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|AIza|SG\.|npm_|eyJ|-----BEGIN)"

#: Names that secrets are assigned to, and words of examples.
NAMES = ["token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "authorization", "bearer", "credential", "private_key", "client_secret"]
HARMLESS = ["example", "sample", "dummy", "placeholder", "changeme", "redacted", "xxxx", "your", "test", "sha256", "sha1", "md5", "commit", "checksum", "digest", "hash", "uuid", "integrity"]

_NAMED = "|".join(NAMES).replace("-", r"\-")
_KEY = "[A-Za-z0-9+/_=.-]"
#: The place after a credential's name and an assignment sign; the short look-behinds come first, since they fail at nearly every place.
_ASSIGNED = rf"(?<=[:=> \"'])(?<=[:=>][ \"']{{0,3}})(?<=(?i:{_NAMED})[\"' ]{{0,2}}(?::=|=>|[:=])[\"' ]{{0,3}})"
#: Private keys, whole blocks where they end; values assigned to a credential's name, of any length and signs, up to their quote or space; runs of key-like characters that don't have such a name assigned in them.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[^-]*+-----END [A-Z ]{0,30}PRIVATE KEY-----)?+"
    rf"|{_ASSIGNED}(?:(?<=\")[^\"\r\n]++(?=\")|(?<=')[^'\r\n]++(?=')|[^\s\"']\S*(?<![\"',;)\]}}>.]))"
    rf"|(?<!{_KEY})(?!(?i:[A-Za-z0-9_.-]*+=(?<=(?:{_NAMED})=))){_KEY}{{16,}}+"
)

#: Frequent letter pairs of words.
PAIRS = ["th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ea", "ra", "ce", "li", "ch", "ll", "be", "ma", "si", "om", "ur", "un", "ge", "ei", "ie", "sc", "qu", "ue", "au", "ai", "os", "ci", "la"]

FEATURES = ["length", "lower", "upper", "digit", "sign", "hexlike", "changes", "distinct", "repeats", "rising", "pairs", "coverage", "format", "named", "assigned", "quoted", "harmless", "path_code", "path_test"]

_WINDOW = 40
#: Parts into which the rows of one text are dealt.
SALTS = 16


#: Words of the dictionary.
DICTIONARY = 2000
_DICTIONARY_WORD = r"\p{L}{3,}"


@dataclass(frozen=True)
class ForestConfig:
    """trees, depth, least rows of a leaf, features tried at a split, rows of training at most, seed, and votes (hundredths) from which a finding stays."""

    trees: int = 15
    depth: int = 6
    leaf: int = 4
    tried: int = 6
    max_rows: int = 20_000
    seed: int = 11
    threshold: int = 50


@dataclass
class Forest:
    """Trees with the dictionary that their features look words up in."""

    trees: list
    words: list[str]


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> list[str]:
    """The most frequent words of three letters or more, lower-cased, counted over all texts; at most `size` come to the driver."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text).cast("string")), F.lit(_DICTIONARY_WORD), F.lit(0))).alias("word"))
    top = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return sorted(r["word"] for r in top.collect())


def coverage(value: Column, words: list[str]) -> Column:
    """How many characters of a value stand in words of the dictionary; words end where letters do, or where a capital follows a small letter."""
    if not words:
        return F.lit(0)
    known = F.split(F.lit(" ".join(words)), " ")
    parts = F.regexp_extract_all(F.lower(F.regexp_replace(value, r"(?<=\p{Ll})(?=\p{Lu})", " ")), F.lit(_DICTIONARY_WORD), F.lit(0))
    return F.aggregate(parts, F.lit(0), lambda n, part: n + F.when(F.array_contains(known, part), F.length(part)).otherwise(0))


# --- features, the same for training rows and findings -------------------------------------------------------------


def with_features(rows: DataFrame, words: list[str]) -> DataFrame:
    """Adds FEATURES to rows of (value, before, after, path); whole numbers, shares in thousandths. words: the dictionary."""
    value, before, after, path = (F.coalesce(F.col(c), F.lit("")) for c in ("value", "before", "after", "path"))
    size = F.greatest(F.length(value), F.lit(1))
    part = lambda pattern: (F.regexp_count(value, F.lit(pattern)) * 1000 / size).cast("int")
    low_before, low_path = F.lower(before), F.lower(path)
    named = "|".join(NAMES).replace("-", r"\-")
    harmless = "|".join(HARMLESS)
    columns = {
        "length": size.cast("int"), "lower": part("[a-z]"), "upper": part("[A-Z]"), "digit": part("[0-9]"), "sign": part("[^A-Za-z0-9]"), "hexlike": part("[0-9a-fA-F]"),
        "changes": part("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"), "distinct": (F.size(F.array_distinct(F.split(value, ""))) * 1000 / size).cast("int"),
        "repeats": part(r"(.)(?=\1)"), "rising": part("(?i)0(?=1)|1(?=2)|2(?=3)|3(?=4)|4(?=5)|5(?=6)|6(?=7)|7(?=8)|8(?=9)|a(?=b)|b(?=c)|c(?=d)|d(?=e)|e(?=f)|f(?=g)"),
        "pairs": part("(?i)" + "|".join(f"{p[0]}(?={p[1]})" for p in PAIRS)), "coverage": (coverage(value, words) * 1000 / size).cast("int"), "format": F.when(value.rlike(FORMATS), 1).otherwise(0),
        "named": F.when(low_before.rlike(rf"(?:{named})[\"' ]{{0,2}}[:=]?[\"' ]{{0,3}}$"), 1).otherwise(0), "assigned": F.when(before.rlike("[:=][\"' ]{0,3}$") | value.rlike("^[A-Za-z_]{2,}="), 1).otherwise(0),
        "quoted": F.when(before.rlike("[\"'`]$") & after.rlike("^[\"'`]"), 1).otherwise(0), "harmless": F.when(low_before.rlike(harmless) | F.lower(value).rlike(harmless), 1).otherwise(0),
        "path_code": F.when(low_path.rlike(r"\.(py|js|ts|go|rs|java|env|ya?ml|json|toml|ini|conf|sh)$"), 1).otherwise(0), "path_test": F.when(low_path.rlike("(^|[/_.-])(tests?|spec|fixtures?|examples?|docs?)([/_.-]|$)"), 1).otherwise(0),
    }
    return rows.withColumns(columns)


# --- the forest ------------------------------------------------------------------------------------------------------


def _grow(x: np.ndarray, y: np.ndarray, depth: int, config: ForestConfig, rng: np.random.Generator):
    """A leaf (votes in hundredths) or (feature, bound, low, high): rows with feature <= bound go low; splits have the least Gini impurity."""
    n, true = len(y), int(y.sum())
    leaf = round(100 * true / n) if n else 0
    if not depth or n < 2 * config.leaf or true in (0, n):
        return leaf
    best = None
    for k in sorted(rng.choice(len(FEATURES), min(config.tried, len(FEATURES)), replace=False).tolist()):
        order = np.argsort(x[:, k], kind="stable")
        values, low = x[order, k], np.cumsum(y[order])[:-1]
        size = np.arange(1, n)
        cost = low * (size - low) / size + (true - low) * (n - size - true + low) / (n - size)
        ok = (values[1:] != values[:-1]) & (size >= config.leaf) & (n - size >= config.leaf)
        if ok.any():
            at = int(np.where(ok, cost, np.inf).argmin())
            if best is None or cost[at] < best[0]:
                best = (cost[at], k, int(values[at]))
    if best is None:
        return leaf
    _, k, bound = best
    low = x[:, k] <= bound
    return k, bound, _grow(x[low], y[low], depth - 1, config, rng), _grow(x[~low], y[~low], depth - 1, config, rng)


def train_forest(findings: DataFrame, words: list[str], config: ForestConfig = ForestConfig()) -> Forest:
    """Trees from labelled findings (value, before, after, path, label). At most about max_rows rows, picked by a hash, come to the driver."""
    labelled = findings.where("label is not null and value is not null")
    total = labelled.count()
    share = min(1.0, config.max_rows / total) if total else 1.0
    picked = labelled.where(F.pmod(F.xxhash64("value", "before"), F.lit(1_000_003)) / F.lit(1_000_003.0) < share)
    rows = sorted(tuple(r) for r in with_features(picked, words).select(*FEATURES, F.col("label").cast("int")).collect())
    if not rows:
        return Forest([], words)
    rng = np.random.default_rng(config.seed)
    table = np.array(rows, np.int64)
    picks = [rng.integers(0, len(rows), len(rows)) for _ in range(config.trees)]
    return Forest([_grow(table[p, :-1], table[p, -1], config.depth, config, rng) for p in picks], words)


def _flat(forest: list) -> tuple[list[int], list[list[int]]]:
    """The roots' places and the nodes of all trees as (feature, bound, low, high); a leaf points at itself and holds its votes as bound."""
    nodes: list[list[int]] = []

    def put(tree) -> int:
        at = len(nodes)
        nodes.append([0, tree, at, at] if isinstance(tree, int) else [tree[0], tree[1], 0, 0])
        if not isinstance(tree, int):
            nodes[at][2], nodes[at][3] = put(tree[2]), put(tree[3])
        return at

    return [put(t) for t in forest], nodes


def with_votes(rows: DataFrame, forest: Forest, depth: int = ForestConfig.depth) -> DataFrame:
    """Adds votes, the mean of the trees' votes in whole hundredths, to rows with FEATURES; without a tree every candidate stays.

    The features pass through a generator, so that they are computed once and not at each node of a walk.
    """
    if not forest.trees:
        return rows.withColumn("votes", F.lit(100))
    roots, nodes = _flat(forest.trees)
    feature, bound, low, high = (F.array(*map(F.lit, x)) for x in zip(*nodes, strict=True))
    values = F.col("__x")
    walk = lambda root: F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, lambda at, _: F.when(F.get(values, F.get(feature, at)) <= F.get(bound, at), F.get(low, at)).otherwise(F.get(high, at)))
    total = F.aggregate(F.array(*map(F.lit, roots)), F.lit(0), lambda sum_, root: sum_ + F.get(bound, walk(root)))
    rows = rows.select("*", F.explode(F.array(F.array(*FEATURES))).alias("__x"))
    return rows.withColumn("votes", F.floor(total / len(roots)).cast("int")).drop("__x")


def generated_findings(spark: SparkSession, words: list[str] = (), rows: int = 6000, seed: int = 5) -> DataFrame:
    """Labelled findings made from rules, half of them true; their words are from the dictionary in part."""
    rng = random.Random(seed)
    take = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    syllables, signs = PAIRS, "!@#$%&*^?"
    word = lambda n: rng.choice(words) if words and rng.random() < 0.4 else "".join(rng.choice(syllables) for _ in range(n))
    leet = lambda: "".join(dict(a="@", o="0", e="3", i="1", s="5").get(c, c) if rng.random() < 0.7 else c for c in word(rng.randint(1, 3)))
    prose = lambda: " ".join(word(rng.randint(1, 3)) for _ in range(6))[-_WINDOW:]
    out = []
    for i in range(rows // 2):
        keys = [take(hexes, rng.choice([32, 40, 64])), take(alnum, rng.randint(24, 48)), "AKIA" + take(string.ascii_uppercase + string.digits, 16), "ghp_" + take(alnum, 36), "sk_live_" + take(alnum, 24), "eyJ" + take(alnum, 20) + "." + take(alnum, 40), take(alnum + "+/", 40), take(hexes.upper(), 40)]
        # passwords, and tokens of any length
        keys += [take(alnum + signs, rng.randint(8, 20)), f"{word(rng.randint(1, 3)).capitalize()}{take(signs, rng.randint(1, 2))}{take(string.digits, rng.randint(1, 4))}{take(alnum, rng.randint(0, 4))}", f"{word(2)}{take(string.digits, rng.randint(1, 2))}{take(signs, 1)}{take(alnum, rng.randint(1, 5))}", "".join(rng.choice([leet(), word(rng.randint(1, 2)), take(string.digits, rng.randint(1, 4))]) + take(signs, 1) for _ in range(rng.randint(2, 3))) + leet(), "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(take(alnum + "+/", 64) for _ in range(rng.randint(1, 12))) + "\n-----END RSA PRIVATE KEY-----", "eyJ" + ".".join(take(alnum + "-_", rng.randint(40, 600)) for _ in range(3))]
        kind = i % len(keys)
        name, quote = rng.choice(NAMES), rng.choice(['"', "'", '"', ""])
        bare = keys[kind] if kind in (2, 3, 4, 5, 12) and rng.random() < 0.5 else None
        before = prose() if bare else f"{prose()} {name}{rng.choice([' = ', '=', ': ', ' := '])}{quote}"
        out.append((keys[kind], before[-_WINDOW:], ("" if bare else quote) + " " + prose(), rng.choice(["src/app.py", "config/prod.yaml", "notes.md", "web"]), 1))
        fakes = [
            word(rng.randint(8, 20)), word(rng.randint(4, 10)).capitalize(), take("0123456789", rng.randint(16, 24)), "/".join(word(2) for _ in range(5)), "-".join(word(2) for _ in range(5)), "_".join(word(2) for _ in range(4)),
            "x" * rng.randint(16, 40), "0123456789abcdef0123456789abcdef"[: rng.randint(16, 32)], f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T10:00:00".replace(":", "."), take(hexes, 40), "=" * rng.randint(16, 60), "-" * rng.randint(16, 60),
            f"your_{rng.choice(NAMES)}_here_{word(2)}", f"example{word(4)}{rng.randint(10, 99)}", f"{word(3)}.{word(3)}.example.com", f"{rng.randint(10, 255)}.{rng.randint(10, 255)}.{rng.randint(100, 255)}.{rng.randint(100, 255)}.", word(rng.randint(7, 12)).upper() + rng.choice([".", "", "..", "-"]), take("ab", rng.randint(16, 30)),
            word(rng.randint(6, 12)).capitalize() + rng.choice([".", "..."]) + word(rng.randint(0, 4)), word(rng.randint(8, 14)) + ".", f"{word(4)}.{rng.randint(10, 99)}", f"{word(5).upper()}-{word(5).upper()}", f"{word(3).upper()}_{word(3).upper()}_{word(3).upper()}", take("0123456789", 4) + "-" + take("0123456789", 4) + "-" + take("0123456789", 8),
            word(rng.randint(1, 4)), word(rng.randint(1, 3)).capitalize() + rng.choice(["", ",", ":", "?", "!"]), rng.choice(["true", "false", "null", "None", "nil", "required", "string", "str", "%s", "***", "...", "|", "{", "[]", "()"]), rng.choice(["${%s}", "$%s", "{{ %s }}", "<%s>", "%%(%s)s", "process.env.%s", "os.environ[%s]", "get_%s()"]) % rng.choice([word(2), word(3).upper(), rng.choice(NAMES)]), " ".join(word(rng.randint(1, 3)) for _ in range(rng.randint(2, 9))), take(alnum + "+/", rng.randint(300, 2000)),
        ]
        kind = i % len(fakes)
        lead = f"{prose()} {rng.choice(['commit', 'sha1', 'checksum', 'digest'])} " if kind == 9 else f"{prose()} {rng.choice(['', '', 'see ', 'title: ', 'url = '])}"
        if kind in (12, 13, 6, 7) and rng.random() < 0.7:
            lead = f"{prose()} {rng.choice(NAMES)} = \""
        if 24 <= kind < 29:
            lead = f"{prose()} {rng.choice(NAMES)}{rng.choice([' = ', '=', ': ', ': '])}{rng.choice(['\"', chr(39), '', ''])}"
        if kind == 29:
            lead = f"{prose()} data:image/png;base64,"
        out.append((fakes[kind], lead[-_WINDOW:], " " + prose(), rng.choice(["src/app.py", "tests/test_app.py", "docs/guide.md", "web"]), 0))
    return spark.createDataFrame(out, "value string, before string, after string, path string, label int")


# --- scanning --------------------------------------------------------------------------------------------------------


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, value) of the pattern's leftmost matches; start counts code points from 0."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    folded = F.aggregate(
        F.arrays_zip(values.alias("v"), F.slice(gaps, 1, F.size(values)).alias("g")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out")),
        lambda a, x: F.struct((a["at"] + x["g"] + F.length(x["v"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("start"), x["v"].alias("value")))).alias("out")),
    )
    return folded["out"]


def candidates(docs: DataFrame, keep: tuple[str, ...], text: str, path: str | None) -> DataFrame:
    """One row for each candidate: k0.., start, value, before, after, path."""
    value = F.col(text).cast("string")
    rows = docs.where(value.rlike(CANDIDATE)).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], value.alias("txt"), (F.col(path).cast("string") if path else F.lit("")).alias("path"))
    found = rows.select("*", F.explode(matches(F.col("txt"), CANDIDATE)).alias("m"))
    start, size = F.col("m.start"), F.length("m.value")
    return found.select(
        *[f"k{i}" for i in range(len(keep))], start.alias("start"), F.col("m.value").alias("value"), F.expr(f"substring(txt, greatest(m.start - {_WINDOW}, 0) + 1, least(m.start, {_WINDOW}))").alias("before"),
        F.substring("txt", start + size + 1, F.lit(_WINDOW)).alias("after"), "path",
    )


def findings(docs: DataFrame, forest: Forest, config: ForestConfig = ForestConfig(), keep: tuple[str, ...] = ("doc_id",), text: str = "text", path: str | None = "source") -> DataFrame:
    """The columns `keep`, start, end, value, votes of each candidate that the forest keeps."""
    scored = with_votes(with_features(candidates(docs, keep, text, path), forest.words), forest, config.depth).where(F.col("votes") >= config.threshold)
    return scored.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "start", (F.col("start") + F.length("value")).alias("end"), "value", "votes")


def _with_spans(docs: DataFrame, forest: Forest, config: ForestConfig, text: str, path: str | None) -> tuple[DataFrame, DataFrame, str]:
    """(rows that have a candidate, with the found spans or null in one more column; all other rows; that column's name).

    Texts meet their findings by a digest, so repeated and null ids are no matter; a text without a candidate doesn't move.
    """
    value = F.col(text).cast("string")
    suspect = F.coalesce(value.rlike(CANDIDATE), F.lit(False))
    place = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    key, salt, spans = (free_name(docs.columns, name) for name in ("__key", "__salt", "__spans"))
    marked = docs.where(suspect).withColumn(key, F.md5(F.concat_ws("\u0000", place, value)))
    # one text may be a third of all rows: rows meet their text's findings by salted keys
    plain = [f.name for f in docs.schema.fields if f.name != text and f.dataType.typeName() not in ("map", "array", "struct", "variant")]
    marked = marked.withColumn(salt, F.pmod(F.xxhash64(*plain), F.lit(SALTS)) if plain else F.lit(0).cast("long"))
    found = findings(marked, forest, config, (key,), text, path).groupBy(key).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(spans))
    found = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return marked.join(found, [key, salt], "left"), docs.where(~suspect), spans


def report(docs: DataFrame, forest: Forest, config: ForestConfig = ForestConfig(), keep: tuple[str, ...] = ("doc_id",), text: str = "text", path: str | None = "source") -> DataFrame:
    """The columns `keep` of every row with n_secrets and spans (start:end in code points, comma-joined)."""
    rows, clean, spans = _with_spans(docs, forest, config, text, path)
    listed = F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    rows = rows.select(*keep, F.coalesce(F.size(spans), F.lit(0)).cast("long").alias("n_secrets"), F.coalesce(listed, F.lit("")).alias("spans"))
    return rows.unionByName(clean.select(*keep, F.lit(0).cast("long").alias("n_secrets"), F.lit("").alias("spans")))


def redact(docs: DataFrame, forest: Forest, config: ForestConfig = ForestConfig(), text: str = "text", path: str | None = "source", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every found secret in `text` replaced by the mark, and `n_chars`, if there, counted anew."""
    rows, clean, spans = _with_spans(docs, forest, config, text, path)
    value = F.col(text).cast("string")
    pieces = F.aggregate(
        F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>")),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(value, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out")),
    )
    whole = F.concat(pieces["out"], F.substring(value, pieces["at"] + 1, F.length(value)))
    changed = rows.withColumn(text, F.when(F.col(spans).isNotNull(), whole).otherwise(value))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns).unionByName(clean)
