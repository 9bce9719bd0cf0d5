"""Excerpts, weak identities and symbol indexes against brute force."""

from pyspark.sql import functions as F

from corvane.operators import selection, symbols
from corvane.sources import identity, symbol_index
from corvane.plans.registry import QUERIES
from corvane.session import table

MASK = (1 << 64) - 1


def brute_identity(data):
    a, b, c = identity.STARTS
    turn = lambda x, n: (x << n | x >> (64 - n)) & MASK
    for i, byte in enumerate(data):
        a = (a * identity.FACTORS[0] + (byte ^ turn(i, 17))) & MASK
        b = turn(b ^ (byte + i), 13) * identity.FACTORS[1] & MASK
        c = turn((c + byte * identity.FACTORS[2]) & MASK, 29) ^ (i * identity.FACTORS[3] & MASK)
    return f"{len(data):x}:{a:016x}:{b:016x}:{c:016x}"


def test_weak_identities_match_brute_force(spark, sf):
    data = [b"", b"a", bytes(range(256)) * 40, b"x" * 5000, b"ab"]
    assert identity.weak_identities(data) == [brute_identity(x) for x in data]
    text = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, sf, "documents").collect()}
    got = {r["doc_id"]: r["identity"] for r in QUERIES["weak_identities"](spark, sf).collect()}
    assert all(got[d] == brute_identity(text[d]) for d in sorted(text)[:40])


def test_fingerprints_of_inputs_differ_by_each():
    base = dict(schema="s", parser="p", profile="f", config={"max": 1, "all": True}, defaults={"a": {"k": "v"}}, ignore="x")
    first = identity.input_fingerprint(**base)
    for key, value in (("schema", "z"), ("parser", "z"), ("profile", "z"), ("config", {"max": 2, "all": True}), ("defaults", {}), ("ignore", "y")):
        other = identity.input_fingerprint(**{**base, key: value})
        assert [k for k in first if first[k] != other[k]] == [{"defaults": "package_defaults"}.get(key, key)]


def test_scans_read_everything_if_an_input_differs(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "9"), ("b", "8"), ("d", "4")], "path string, sha256 string")
    states = lambda same: {r["path"]: r["state"] for r in identity.scan_changed(old, new, ["a"], same).collect()}
    assert states(True) == {"a": "changed", "b": "reused", "c": "reused"}
    assert states(False) == {"a": "changed", "b": "changed", "c": "removed", "d": "added"}


def message(*parts):
    """A message of (number, whole number or bytes)."""
    number = lambda n: bytes([n & 127 | 128]) + number(n >> 7) if n > 127 else bytes([n])
    out = b""
    for key, value in parts:
        out += number(key << 3) + number(value) if isinstance(value, int) else number(key << 3 | 2) + number(len(value)) + value
    return out


def test_symbol_indexes(spark):
    relation = message((1, b"s p m 1 Base#"), (3, 1))
    document = message((1, b"a.py"), (5, b"text"), (2, message((1, bytes([3, 1, 9])), (2, b"s p m 1 f()."), (3, 1))), (2, message((1, 4), (1, 0), (1, 6), (1, 2), (2, b"s p m 1 g()."))), (2, message((2, b"s p m 1 h()."), (9, message((1, 7), (3, 9))))), (3, message((1, b"s p m 1 C#"), (5, 7), (4, relation))))
    index = message((1, message((1, 1))), (2, document), (3, message((1, b"local 1"))))
    files = spark.createDataFrame([("one", index), ("two", b"\xff"), ("three", message((2, message((2, message((1, bytes([3, 1]))))))))], "index string, content binary")
    rows = symbol_index.read_indexes(files).collect()
    found = {(r["record"], r["symbol"], r["definition"], r["start_line"], r["end_line"], r["target"]) for r in rows if r["index"] == "one"}
    assert found == {("document", None, None, None, None, None), ("occurrence", "s p m 1 f().", True, 4, 4, None), ("occurrence", "s p m 1 g().", False, 5, 7, None), ("occurrence", "s p m 1 h().", False, 8, 10, None), ("symbol", "s p m 1 C#", None, None, None, None), ("implements", "s p m 1 C#", None, None, None, "s p m 1 Base#"), ("symbol", "local 1", None, None, None, None)}
    assert {r["index"] for r in rows if r["record"] == "fault"} == {"two", "three"}


def test_symbol_names():
    names = {
        "s p m 1 a/B#c().": ("c", "a::B::c", True), "s p m 1 `x``y`#": ("x`y", "x`y", True), "s  x p m 1 A#": ("A", "A", True), "s p m 1 A#[T]": ("A", "A", False), "s p m 1 f().(x)": ("f", "f", False), "s p m 1 m!": ("m", "m", True), "s p m 1 A#meta:": ("A", "A", False),
        "local 3": None, "s p m": None, "s p m 1 ": None, "s p m 1 A": None, "s p m 1 A?": None, "s p m 1 `a#": None, "s p m 1 f(.": None, "s p m 1 [T": None,
    }
    assert {s: symbol_index.symbol_name(s) for s in names} == names


def test_excerpts_match_brute_force(spark, sf):
    def brute(text, terms):
        out = ""
        for line in filter(None, map(str.strip, text.split("\n"))):
            if len(out.encode()) >= 900:
                break
            if len(out.encode()) < 300 or any(t in line.lower() for t in terms):
                out += ("\n" if out else "") + line
        return out.encode()[:900].decode(errors="ignore")

    rows = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(", "), F.lit("\n")).alias("t")).select("t", selection.excerpt(F.col("t"), ["tion", "qu"]).alias("e")).collect()
    assert all(r["e"] == brute(r["t"], ["tion", "qu"]) for r in rows)


def many_symbols(spark):
    """1,300 named symbols, each implemented by another; the last of them stand in the first document."""
    rows = spark.range(1_300).selectExpr("format_string('s%04d', id) symbol", "format_string('t%04d', id) other", "1300 - id rank")
    named = rows.selectExpr("symbol", "'Run' name", "true navigable")
    occurrences = rows.selectExpr("'d' || rank path", "symbol", "false definition", "1L start_line", "2L end_line").unionByName(rows.selectExpr("'d' || rank path", "other symbol", "true definition", "3L start_line", "4L end_line"))
    return named, occurrences, rows.selectExpr("other symbol", "symbol target"), rows.selectExpr("'d' || rank path", "rank")


def test_symbol_evidence_looks_at_all_symbols_and_pairs(spark):
    found = symbols.evidence(*many_symbols(spark), ["run"], 6).orderBy("position").collect()
    assert [(r["path"], r["role"], r["symbol"], r["implements"]) for r in found] == [x for k in (1, 2, 3) for x in ((f"d{k}", "reference", f"s{1300 - k}", None), (f"d{k}", "implementation", f"t{1300 - k}", f"s{1300 - k}"))]
    assert all(r["truncated"] for r in found)
    whole = symbols.evidence(*many_symbols(spark), ["run"], 5_000).collect()
    assert len(whole) == 2_600 and not any(r["truncated"] for r in whole)


def test_symbol_lines_hold_symbols_beyond_a_thousand(spark):
    named, *others = many_symbols(spark)
    found = symbols.payload_lines(symbols.evidence(named, *others, ["run"], 2), named.selectExpr("symbol", "'q' || symbol qualified")).collect()
    assert [tuple(r) for r in found] == [("d1", "scip_symbols: reference qs1299 1-2; implementation t1299 3-4 implements qs1299\n")]
