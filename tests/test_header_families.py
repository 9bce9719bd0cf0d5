"""Headers as JSON, and the rules on their optional families."""

import pytest

from corvane.operators.header_families import family_diagnostics
from corvane.sources.header_yaml import HeaderError, parse_header


def test_nested_headers():
    text = "type: x\nsources:\n  - resource: a\n    n: 1\n  - b\ngenerated:\n  by: me\nlist: [a, 'b, c', 2]\nempty:\nflat:\n- x\n- y: z"
    assert parse_header(text) == {"type": "x", "sources": [{"resource": "a", "n": 1}, "b"], "generated": {"by": "me"}, "list": ["a", "b, c", 2], "empty": None, "flat": ["x", {"y": "z"}]}
    for bad in ("a: 1\na: 2", "a:\n\t- b", "- a", "a: [1", "a: |\n  x", "a: 1\n   b: 2"):
        with pytest.raises(HeaderError):
            parse_header(bad)


CASES = [
    ("sources: x", {"sources-not-sequence"}), ("sources:\n  - a\n  - n: 1\n  - resource: ok", {"source-entry-not-mapping", "source-entry-resource"}), ("usage_window: 5", {"usage-window-not-mapping"}), ("usage_window:\n  from: a\n  to: ''", {"usage-window-to"}),
    ("generated:\n  by: 3\n  at: 4", {"generated-by", "generated-at"}), ("generated: y", {"generated-not-mapping"}), ("verified: x", {"verified-shape"}), ("verified:\n  by: a\n  at: b", set()), ("verified:\n  - x\n  - by: a", {"verified-event-not-mapping", "verified-at"}),
    ("status: gone", {"status-value"}), ("status: stable", set()), ("stale_after: 2024-02-30", {"stale-after-shape"}), ("stale_after: 2024-02-29", set()), ("type: Attested Computation", {"ac-runtime"}),
    ("type: Attested Computation\nruntime: r\nparameters:\n  - name: a\ncomputation: 1\nexecutor:\n  resource: x\n  receipt: no\nattester: z", {"ac-parameters", "ac-computation", "ac-executor", "ac-attester"}),
    ("type: Attested Computation\nruntime: r\nparameters:\n  - name: a\n    type: b\nexecutor:\n  resource: x\n  receipt: [a]\nattester:\n  resource: y", set()), ("type: other\nparameters: 1", set()),
]


def test_families(spark):
    docs = spark.createDataFrame([(f"{i}.md", f"---\n{h}\n---\nbody") for i, (h, _) in enumerate(CASES)], "path string, text string")
    found = {}
    for r in family_diagnostics(docs).collect():
        found.setdefault(r["path"], set()).add(r["code"])
    assert found == {f"{i}.md": codes for i, (_, codes) in enumerate(CASES) if codes}
