"""Operators on small hand-made inputs."""

import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.functions import stem, text as tx
from corvane.operators import brief_units, default_ranking, facts, fielded, graph, incremental, packets, rules, structural, views
from corvane.operators.evidence_log import StoreFull, append
from corvane.sources import corpus, documents, sql_gate, stores


def values(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_split_at_case_and_digits(spark):
    assert values(spark, tx.identifier_tokens(F.lit("parseHTTPServer2x don't"))) == ["parse", "httpserver", "2", "x", "don", "t"]
    assert values(spark, tx.terms(F.lit("The a x parseIt 10 7"))) == ["parse", "10"]


def test_paths(spark):
    assert values(spark, tx.normalize_path(F.lit("a/./b/../c"))) == "a/c"
    assert values(spark, tx.normalize_path(F.lit("../c"))) is None
    assert values(spark, tx.base_name(F.lit("d/.hidden"))) == ".hidden"
    assert values(spark, tx.extension(F.lit("d/x.tar.gz"))) == "gz"
    assert values(spark, tx.directory(F.lit("a/b/c"))) == "a/b"


@pytest.mark.parametrize(("text", "n", "out"), [("aé", 2, "a"), ("aé", 3, "aé"), ("漢字", 4, "漢"), ("😀x", 3, ""), ("abc", 9, "abc")])
def test_truncation_keeps_characters_whole(spark, text, n, out):
    assert values(spark, tx.truncate_utf8(F.lit(text), n)) == out


@pytest.mark.parametrize(("n", "letters"), [(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (702, "ZZ"), (703, "AAA"), (16384, "XFD")])
def test_column_letters(spark, n, letters):
    assert values(spark, tx.column_letters(F.lit(n))) == letters


@pytest.mark.parametrize(("word", "out"), [("running", "run"), ("ponies", "poni"), ("generously", "generous"), ("skies", "sky"), ("hoping", "hope"), ("falling", "fall"), ("national", "nation"), ("conflated", "conflat"), ("sensational", "sensat"), ("cried", "cri"), ("ties", "tie"), ("proceed", "proceed"), ("knack", "knack")])
def test_stems(word, out):
    assert stem.stem(word) == out


def test_classes_and_globs(spark):
    classes = corpus.parse_classes("classes:\n  - name: docs\n    tier: 1\n    globs: [docs/**, '*.md']\n  - name: rest\n    tier: 2\n    globs: ['**']\n")
    tier, name = corpus.classify(F.col("p"), classes)
    rows = spark.createDataFrame([("docs/a/b.txt",), ("x.md",), ("a/x.md",)], "p string").select("p", tier.alias("t"), name.alias("n")).collect()
    assert [(r["t"], r["n"]) for r in rows] == [(1, "docs"), (1, "docs"), (2, "rest")]
    for bad in ("classes:\n\t- name: x", "classes:\n  - name: x\n    tier: 10\n    globs: [a]", "classes:\n  - name: x\n    tier: 1\n    globs: []", "classes:\n  - nom: x"):
        with pytest.raises(ValueError):
            corpus.parse_classes(bad)


def test_roles(spark):
    rows = spark.createDataFrame([("a/test_x.py", ""), ("tests/x.py", ""), ("a.md", ""), ("a.txt", "/etc/x\nkey: v"), ("a.txt", "plain words here\nmore"), ("a.rs", "")], "p string, t string")
    assert [r[0] for r in rows.select(corpus.content_role(F.col("p"), F.col("t"))).collect()] == ["test", "test", "doc", "config", "doc", "code"]


def test_intent():
    assert fielded.analyze("how often does the backup run").asks_frequency
    assert fielded.analyze("which ports are open").asks_value
    assert not fielded.analyze("which tests are slow").asks_value


def files(spark, rows):
    frame = spark.createDataFrame(rows, "path string, text string")
    return frame.withColumns({"active": F.lit(0), "canonical": F.lit(0), "public_safe": F.lit(0), "confidence": F.lit(0), "freshness": F.lit("")})


def test_fielded_prefers_the_filename(spark):
    frame = files(spark, [("docs/valve-wiring.md", "# Notes\nabout pumps"), ("docs/pumps.md", "valve valve wiring"), ("docs/else.md", "nothing")])
    ranked = fielded.rank(fielded.score(frame, fielded.analyze("valve wiring"))).collect()
    assert [r["path"] for r in ranked] == ["docs/valve-wiring.md", "docs/pumps.md"]
    assert ranked[0]["reason"] == "partial:filename"


def test_agent_nouns_match_in_filenames_only(spark):
    frame = files(spark, [("src/parse.py", "x"), ("src/other.py", "parse")])
    assert [r["path"] for r in fielded.score(frame, fielded.analyze("parser")).collect()] == ["src/parse.py"]


def test_value_sources_raise_named_settings(spark):
    frame = files(spark, [("docs/backup.md", "the backup runs, see conf/backup.yaml"), ("conf/backup.yaml", "schedule: daily"), ("docs/x.md", "other")])
    q = fielded.analyze("how often does the backup run")
    raised = fielded.value_sources(fielded.score(frame, q), frame, q).collect()
    assert [r["path"] for r in raised] == ["conf/backup.yaml"]
    assert raised[0]["referenced"]


def test_unanchored_entities_silence_generic_matches(spark):
    frame = files(spark, [("a.md", "valve text"), ("b.md", "other")])
    assert default_ranking.suppress_unanchored(default_ranking.matches(frame, "valve missing-thing.cfg"), "valve missing-thing.cfg").count() == 0
    assert default_ranking.suppress_unanchored(default_ranking.matches(frame, "valve"), "valve").count() == 1


def test_view_bounds():
    deep = ("all",)
    for _ in range(17):
        deep = ("not", deep)
    for spec in (views.ViewSpec(filter=deep), views.ViewSpec(filter=("any_of", [("all",)] * 129)), views.ViewSpec(max_items=0), views.ViewSpec(source=("ids", []))):
        with pytest.raises(views.ViewError):
            spec.validate()


def nodes_edges(spark):
    n = spark.createDataFrame([(x, "entrypoint" if x == "a" else "document", "s", x, 50, None) for x in "abcdefg"], "id string, role string, prov_source string, prov_locator string, confidence int, facts map<string,array<string>>")
    e = spark.createDataFrame([("1", "a", "b", "known"), ("2", "a", "c", "known"), ("3", "b", "d", "known"), ("4", "c", "d", "known"), ("5", "d", "e", "dynamic"), ("6", "e", "f", "known")], "id string, src string, dst string, certainty string").withColumn("relationship", F.lit("dependency"))
    return n, e


def test_trail_takes_the_least_of_equal_paths(spark):
    n, e = nodes_edges(spark)
    assert [(r["id"], r["edge_id"]) for r in graph.trail(n, e, "a", "d", 5).orderBy("position").collect()] == [("a", None), ("b", "1"), ("d", "3")]
    assert graph.trail(n, e, "a", "f", 5).count() == 0


def test_reachability_outcomes(spark):
    n, e = nodes_edges(spark)
    found = {r["id"]: (r["outcome"], r["reason"]) for r in graph.reachability(n, e, 5).collect()}
    assert found == {"a": ("active", "entrypoint"), "b": ("supporting", "known-path"), "c": ("supporting", "known-path"), "d": ("supporting", "known-path"), "e": ("unknown", "uncertain"), "f": ("unknown", "uncertain"), "g": ("unreachable", "no-known-path")}


def test_impact_stops_at_the_bound(spark):
    n, e = nodes_edges(spark)
    rows = graph.impact(n, e, "d", 3, 2).orderBy("position").collect()
    assert [(r["id"], r["depth"], r["truncated"]) for r in rows] == [("b", 1, True), ("c", 1, True)]


def test_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a")], "src string, dst string")
    assert sorted(r["id"] for r in graph.strongly_cyclic(e).collect()) == ["a", "b", "c"]


def test_packet_skips_what_does_not_fit(spark):
    rows = [("a", "related", 9, "x" * 200), ("b", "related", 8, "y" * 900), ("c", "related", 7, "z")]
    frame = spark.createDataFrame(rows, "id string, priority string, authority int, content string").withColumns({"prov_source": F.lit("s"), "prov_locator": F.lit("l"), "freshness": F.lit(0)})
    row = packets.assemble(frame, packets.PacketLimits(max_bytes=400)).first()
    assert (row["selected"], row["omitted"], row["failed"]) == (["a", "c"], ["b"], None)
    assert packets.assemble(frame.withColumn("priority", F.lit("required")), packets.PacketLimits(max_bytes=400)).first()["failed"] == "b"


def test_renames_and_ambiguity(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "3"), ("e", "5")], "path string, sha256 string")
    new = spark.createDataFrame([("a2", "1"), ("b", "9"), ("x", "3"), ("n", "7"), ("e", "5")], "path string, sha256 string")
    kinds = sorted((r["kind"], r["old_path"], r["path"]) for r in incremental.classify_deltas(incremental.scan_diff(old, new)).collect() if r["kind"] != "ambiguous")
    assert kinds == [("change", "b", "b"), ("create", None, "n"), ("rename", "a", "a2")]


def test_log_refuses_when_full(spark):
    log = spark.createDataFrame([(f"q{i}", ["r"]) for i in range(32)], "request string, roots array<string>")
    assert append(log, spark.createDataFrame([("q1", ["r"])], log.schema)).count() == 32
    with pytest.raises(StoreFull):
        append(log, spark.createDataFrame([("new", ["r"])], log.schema))


def test_declared_and_inferred_facts(spark):
    docs = spark.createDataFrame([("src/a.py", "def f(x):\n    pass\nimport os\n"), ("b.md", "---\ntags: [x, y]\nstatus: active\n---\n# Head\n")], "path string, text string")
    found = {(r["path"], r["key"], r["value"]) for r in facts.declared(docs).unionByName(facts.inferred(docs)).collect()}
    assert {("src/a.py", "symbol", "f"), ("src/a.py", "import", "os"), ("src/a.py", "language", "python"), ("b.md", "tags", "y"), ("b.md", "heading", "Head")} <= found


def test_numbering_is_total(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"))
    assert [r["n"] for r in structural.number(rows, [F.asc("v")], "n").orderBy("v").collect()] == list(range(1, 501))


def test_gate_normalises_and_projects():
    gated = sql_gate.gate("SELECT  Name FROM main.t ORDER BY 1", ["main.t"])
    assert gated.sql == "select name from main . t order by 1" and gated.relations == ("main.t",)
    assert sql_gate.project("main.t", ["a", "b"], ["main.t"]).sql == 'select "a" , "b" from "main" . "t" order by 1 , 2'
    with pytest.raises(sql_gate.Rejected, match="invalid-projection"):
        sql_gate.project("main.t", ["a", "a"], ["main.t"])


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_document_readers(spark):
    w, s = documents._W, documents._S
    docx = package(**{"word/document.xml": f'<d xmlns="{w}"><body><p><pPr><pStyle val="Heading1"/></pPr><r><t>Head</t></r></p><p><r><t>one </t><t>two</t></r></p><tbl><tr><tc><p><r><t>c</t></r></p></tc></tr></tbl></body></d>'})
    assert [(r[2], r[4]) for r in documents.read_document("a.docx", docx)] == [("heading", "Head"), ("paragraph", "one two"), ("cell", "c")]
    xlsx = package(**{
        "xl/workbook.xml": f'<w xmlns="{s}" xmlns:r="urn:r"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></w>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>', "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>hello</t></si></sst>',
        "xl/worksheets/s.xml": f'<w xmlns="{s}"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c><v>1.50</v></c><c><f>A1+1</f><v>3</v></c></row></sheetData></w>',
    })
    assert [(r[3], r[4]) for r in documents.read_document("a.xlsx", xlsx)] == [("S!R2C2", "hello"), ("S!R2C3", "1.50"), ("S!R2C4", "=A1+1 [cached: 3]")]
    pdf = b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R]>> endobj\n3 0 obj <</Type /Page /Contents 4 0 R>> endobj\n4 0 obj <</Length 40>>stream\nBT (Hel) Tj (lo) Tj 0 -10 Td (World) Tj ET\nendstream endobj\n"
    assert [r[4] for r in documents.read_document("a.pdf", pdf)] == ["Hello World"] or [r[4] for r in documents.read_document("a.pdf", pdf)] == ["Hel lo World"]
    assert documents.read_document("a.pdf", pdf.replace(b"/Catalog", b"/Catalog /JavaScript"))[0][5] == "active-content"
    assert documents.read_document("a.docx", b"nothing")[0][5] == "zip-malformed"
    assert documents.read_document("a.docx", package(**{"word/document.xml": "<!DOCTYPE x><d/>"}))[0][5] == "xml-doctype"
    frame = spark.createDataFrame([("a.docx", docx), ("b.docx", b"bad")], "path string, content binary")
    assert documents.anchors(frame).count() == 4


def test_stores(tmp_path, spark):
    store = stores.FileStore(str(tmp_path), 10)
    key = store.put(b"12345")
    assert store.get(key) == b"12345" and store.put(b"12345") == key
    with pytest.raises(stores.StoreError):
        store.put(b"1234567")
    (tmp_path / key).write_bytes(b"x")
    with pytest.raises(stores.StoreError):
        store.get(key)
    with pytest.raises(ValueError):
        stores.parse_canonical('{"a":1,"a":2}')
    n, e = nodes_edges(spark)
    back_nodes, back_edges = stores.read_vault(stores.vault_pages(n, e))
    assert back_nodes.count() == 7 and back_edges.count() == 6


def test_advice_keeps_the_order_on_faults(spark):
    ranked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, rank int")
    order = lambda frame: [r["path"] for r in frame.orderBy("rank").collect()]
    assert order(stores.apply_advice(ranked, '{"paths":["c","a"]}')) == ["c", "a"]
    assert order(stores.apply_advice(ranked, '{"scores":{"b":0.9}}')) == ["b", "a", "c"]
    for fault in ("x", '{"paths":["z"]}', '{"scores":{"a":2}}', '{"paths":["a"],"scores":{}}'):
        assert order(stores.apply_advice(ranked, fault)) == ["a", "b", "c"]


def test_brief_budget():
    rows = [{"path": f"p{i}" * 30, "reason": "partial:filename+body+description"} for i in range(40)]
    out = stores.within_budget(rows, ["m"], [f"term{i}" for i in range(50)], 8)
    import json

    assert len(json.dumps(out, ensure_ascii=False, separators=(",", ":"))) <= 2000 and out["results"]


def test_streamed_snapshots_and_windows(spark, sf, tmp_path):
    from corvane.session import table
    from corvane.streaming.events import SnapshotPublisher, stream_of, windowed

    source = tmp_path / "changes"
    frame = spark.createDataFrame([("a", "1", "x", False), ("b", "2", "y", False)], "path string, sha256 string, text string, removed boolean")
    frame.coalesce(1).write.parquet(str(source / "one"))
    publisher = SnapshotPublisher(str(tmp_path / "snap"))
    publisher.start(stream_of(spark, str(source / "*"), frame.schema), str(tmp_path / "cp")).awaitTermination()
    frame.sparkSession.createDataFrame([("a", "1", "x", True), ("c", "3", "z", False)], frame.schema).coalesce(1).write.parquet(str(source / "two"))
    publisher.start(stream_of(spark, str(source / "*"), frame.schema), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["path"] for r in publisher.current(spark).collect()) == ["b", "c"]
    events = table(spark, sf, "events")
    stream = stream_of(spark, sf, events.schema, "events.parquet")
    query = windowed(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(str, spark.table("w").collect())) == sorted(map(str, windowed(events).collect()))


def test_units_weigh_places(spark):
    frame = files(spark, [("docs/valve.md", "x"), ("valve/x.md", "x"), ("docs/a.md", "the valve, the valve"), ("docs/b.md", "many valves"), ("docs/c.md", "none")])
    ranked = brief_units.rank(brief_units.score(frame, "valve")).collect()
    assert [r["path"] for r in ranked] == ["docs/valve.md", "valve/x.md", "docs/a.md", "docs/b.md"]
    assert [r["structural"] for r in ranked] == [2500, 2350, 2000, 2000]


def test_scan_of_a_tree(tmp_path, spark):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("hello")
    (tmp_path / "node_modules" / "b.md").write_text("no")
    (tmp_path / "c.bin").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "big.md").write_text("x" * 3000)
    found, diagnostics = corpus.scan_tree(spark, str(tmp_path), max_file_bytes=2000)
    assert [(r["path"], r["text"]) for r in found.collect()] == [("d/a.md", "hello")]
    assert sorted((r["path"], r["kind"]) for r in diagnostics.collect()) == [("big.md", "oversized-input"), ("c.bin", "unsupported-input")]


def test_descriptions_must_be_fresh_and_first(spark):
    import hashlib
    import json

    sha = hashlib.sha256(b"body").hexdigest()
    rows = [(1, json.dumps({"path": "a", "sha256": sha, "description": "first"})), (2, json.dumps({"path": "a", "sha256": sha, "description": "second"})), (3, json.dumps({"path": "b", "sha256": "0" * 64, "description": "stale"})), (4, "broken")]
    found = corpus.valid_descriptions(spark, spark.createDataFrame(rows, "ord int, line string"), spark.createDataFrame([("a", "body"), ("b", "other")], "path string, text string"))
    assert [(r["path"], r["description"]) for r in found.collect()] == [("a", "first")]


def test_tiers_in_a_packet(spark):
    rows = [("a", "follow-up", 1, "x" * 20), ("b", "primary-canonical", 1, "y"), ("c", "required-dependency", 1, "z"), ("b", "follow-up", 2, "y"), ("d", "conflict-or-superseded", 1, "w" * 500)]
    frame = spark.createDataFrame(rows, "id string, tier string, position int, content string").withColumns({"prov_source": F.lit("s"), "prov_locator": F.lit("l")})
    row = packets.assemble_tiers(frame, packets.PacketLimits(max_bytes=250)).first()
    assert (row["selected"], row["omitted"], row["failed"]) == (["b", "c", "a"], ["d"], None)


@pytest.mark.parametrize(("compressed", "codes", "out"), [(None, [], "unavailable"), ("keep k1", ["private_key"], "refused-data-loss"), ("lost", [], "refused-anchor"), ("k1 " + "x" * 60, [], "refused-size"), ("k1", [], "admitted"), ("k1 a longer one", [], "not-smaller")])
def test_compression_fails_closed(spark, compressed, codes, out):
    cell = F.lit(compressed).cast("string")
    listed = F.array(*map(F.lit, codes)) if codes else F.array().cast("array<string>")
    assert values(spark, packets.compression_outcome(F.lit("k1 payload xy"), cell, F.array(F.lit("k1")), 40, listed)) == out


def test_an_index_scores_as_texts_do(spark, sf):
    from corvane.plans import queries_rank

    rows = queries_rank.files(spark, sf)
    index = fielded.build_index(rows)
    for text, stemmed in (("how often do hend parsers run the src tests", True), (queries_rank.QUESTION, True), (queries_rank.QUESTION, False), ("the of", True)):
        q = fielded.analyze(text, stemmed)
        plain, by_index = fielded.score(rows, q, queries_rank.CLASSES), fielded.score_indexed(index, q, queries_rank.CLASSES)
        assert sorted(plain.columns) == sorted(by_index.columns)
        names = sorted(plain.columns)
        key = lambda r: [round(r[c], 9) if isinstance(r[c], float) else r[c] for c in names]
        assert sorted(map(str, map(key, plain.collect()))) == sorted(map(str, map(key, by_index.collect())))
    q = fielded.analyze(queries_rank.QUESTION)
    whole = fielded.rank(fielded.with_exact_units(fielded.score(rows, q, queries_rank.CLASSES), rows, queries_rank.QUESTION))
    short = fielded.rank(fielded.with_exact_units(fielded.shortlisted(fielded.score_indexed(index, q, queries_rank.CLASSES)), rows, queries_rank.QUESTION))
    assert sorted(map(str, whole.collect())) == sorted(map(str, short.collect()))


@pytest.mark.parametrize("name", ["fielded_rank_plain", "fielded_rank"])
def test_a_single_question_builds_no_index(name, spark, sf, monkeypatch):
    from corvane import session
    from corvane.plans.registry import QUERIES

    def refused(*_):
        raise AssertionError("a question alone needs its own tokens only")

    monkeypatch.setattr(session, "_REMEMBERED", {})
    monkeypatch.setattr(fielded, "build_index", refused)
    assert QUERIES[name](spark, sf).count() > 0


def only_ids_are_kept(monkeypatch):
    """From now on a search that writes more than ids fails."""
    kept = graph.cut_counted

    def checked(df):
        assert df.columns == ["id"]
        return kept(df)

    monkeypatch.setattr(graph, "cut_counted", checked)


def a_graph(spark):
    nodes = spark.createDataFrame([(x, "entrypoint" if x == "a" else "document", None) for x in "abcdefg"], "id string, role string, facts map<string,array<string>>")
    rows = [("1", "a", "b", "known"), ("2", "a", "c", "known"), ("3", "b", "d", "known"), ("4", "c", "d", "known"), ("5", "b", "d", "known"), ("6", "d", "e", "known"), ("7", "e", "a", "known"), ("8", "f", "g", "dynamic"), ("9", "d", "x", "known"), ("0", "x", "f", "known")]
    return nodes, spark.createDataFrame([(*r, "dependency") for r in rows], "id string, src string, dst string, certainty string, relationship string")


def test_reachability_keeps_ids_only(spark, monkeypatch):
    only_ids_are_kept(monkeypatch)
    found = {r["id"]: (r["reason"], r["depth"]) for r in graph.reachability(*a_graph(spark), 6).collect()}
    assert found == {"a": ("entrypoint", None), "b": ("known-path", 1), "c": ("known-path", 1), "d": ("known-path", 2), "e": ("known-path", 3), "f": ("known-path", 4), "g": ("uncertain", None)}
    assert {r["id"] for r in graph.reachability(*a_graph(spark), 1).where("truncated").collect()} == {"d", "e", "f", "g"}


def test_a_closure_without_bound_keeps_ids_only(spark, monkeypatch):
    nodes, edges = a_graph(spark)
    bounded = graph.dependency_closure(nodes, edges, nodes.where("id = 'a'"), 6, 100)
    only_ids_are_kept(monkeypatch)
    whole = graph.dependency_closure(nodes, edges, nodes.where("id = 'a'"), 6, None)
    # x is no node, so nothing is met through it
    assert sorted(map(tuple, whole[0].collect())) == sorted(map(tuple, bounded[0].collect())) == [("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert graph.dependency_closure(nodes, edges, nodes.where("id = 'a'"), 2, None)[1] and not whole[1]


def test_trail_keeps_ids_only_and_is_least(spark, monkeypatch):
    only_ids_are_kept(monkeypatch)
    nodes, edges = a_graph(spark)
    path = lambda *x: [tuple(r)[1:] for r in graph.trail(nodes, edges, *x).orderBy("position").collect()]
    assert path("a", "e", 5) == [("a", None), ("b", "1"), ("d", "3"), ("e", "6")]
    assert path("a", "a", 5) == [("a", None)] and path("a", "e", 2) == path("x", "f", 5) == path("f", "g", 5) == []


def test_distances_by_shuffle_are_those_by_broadcast(spark, monkeypatch):
    nodes, edges = a_graph(spark)
    few = sorted(map(tuple, graph.distances(nodes, edges, nodes.where("id = 'a'"), 6).collect()))
    monkeypatch.setattr(graph, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, graph.distances(nodes, edges, nodes.where("id = 'a'"), 6).collect())) == few
    assert sorted(map(tuple, graph.dependency_closure(nodes, edges, nodes.where("id = 'a'"), 6, None)[0].collect())) == [("b", 1), ("c", 1), ("d", 2), ("e", 3)]


def plan_of(spark, name, sf):
    from corvane.plans.registry import QUERIES

    return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_degrees_are_counted_without_doubled_rows(spark, sf):
    assert "Expand" not in plan_of(spark, "graph_degrees", sf)


def test_integrity_deals_edges_by_one_column(spark, sf):
    import re

    assert not re.search(r"hashpartitioning\(id#\d+, \w+#", plan_of(spark, "graph_integrity", sf))


def test_edges_are_dealt_by_source(spark, sf):
    from corvane.plans import star_graph

    grouped = star_graph.edges(spark, sf).groupBy("src").count()
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()


def test_front_matter_is_cut_at_the_first_whole_fence(spark):
    cases = {"---\na: 1\n---\nb\n---\n": ("a: 1\n", "b\n---\n"), "---\n---\n": ("", ""), "---\n---": ("", ""), "\ufeff --- \r\n----\n ---\t\r\nx": ("----\n", "x"), "---\na": (None, ""), "---": (None, ""), "a\n---\n": (None, "a\n---\n"), "": (None, "")}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", tx.front_matter(F.col("t")).alias("f")).collect()
    assert {r["t"]: (r["f"]["header"], r["f"]["body"]) for r in rows} == cases


def test_declared_facts_cut_each_text_once(spark, sf):
    # the filter that the planner infers for explode would cut it again
    assert plan_of(spark, "facts_declared", sf).count("map_from_entries") == 1


@pytest.mark.parametrize("name,scans", [("facts_maps", 1), ("facts_conflicts", 2)])
def test_facts_are_resolved_in_one_reading(name, scans, spark, sf):
    assert plan_of(spark, name, sf).count("FileScan") == scans


def test_resolved_facts_of_odd_keys(spark):
    rows = [("a", "title", "x", "declared"), ("a", "title", "y", "inferred"), ("a", "tags", "x", "declared"), ("a", "tags", "y", "declared"), ("b", "title", "x", "inferred"), ("b", "title", "y", "inferred"), ("c", "title", "x", "declared"), ("c", "title", "x", "inferred")]
    found = facts.resolve(spark.createDataFrame(rows, "path string, key string, value string, confidence string")).where("state = 'ambiguous'").collect()
    assert sorted((r["path"], r["key"], r["value"]) for r in found) == [("a", "title", "x"), ("a", "title", "y")]


def test_many_questions_read_texts_once_with_the_same_points(spark, monkeypatch, sf):
    assert "documents.parquet" not in plan_of(spark, "fielded_rank_many", sf)
    texts = [("a", "red fox red den"), ("b", "fox"), ("b", "red"), ("c", ""), ("d", None), ("e", "den den den fox 12")]
    files = spark.createDataFrame(texts, "path string, text string")
    asked = spark.createDataFrame([(1, ["red", "red", "den"]), (2, ["fox", "owl"]), (3, ["12"]), (4, [])], "question_id int, terms array<string>")
    found = sorted(map(tuple, fielded.rank_many(files, asked).collect()))
    # by hand: the two files b have one path and length, so they count as one with both words
    counts = {("a", 4): {"red": 2, "fox": 1, "den": 1}, ("b", 1): {"fox": 1, "red": 1}, ("e", 5): {"den": 3, "fox": 1, "12": 1}}
    df = {w: sum(w in c for c in counts.values()) for w in ("red", "fox", "den", "12")}
    share = lambda c, size, w: int(math.log1p((6 - df[w] + 0.5) / (df[w] + 0.5)) * 2.2 * c[w] / (c[w] + 1.2 * (0.25 + 0.75 * size / (11 / 6))) * 1_000_000)
    points = {(q, p): sum(share(c, size, w) for w in words if w in c) for q, words in ((1, ("red", "den")), (2, ("fox", "owl")), (3, ("12",))) for (p, size), c in counts.items() if any(w in c for w in words)}
    assert {(q, p): n for q, _, p, n in found} == points
    assert [p for q, _, p, _ in found if q == 1] == sorted((p for q, p in points if q == 1), key=lambda p: -points[1, p])
    monkeypatch.setattr(fielded, "MANY_WORDS", 0)
    assert sorted(map(tuple, fielded.rank_many(files, asked).collect())) == found


def test_reachability_by_shuffle_is_that_by_broadcast(spark, sf, monkeypatch):
    from corvane.plans.registry import QUERIES

    few = sorted(map(str, QUERIES["graph_reachability"](spark, sf).collect()))
    only_ids_are_kept(monkeypatch)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", -1)
    assert sorted(map(str, QUERIES["graph_reachability"](spark, sf).collect())) == few
