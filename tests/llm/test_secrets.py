"""Spans of texts with very many matches, against regular expressions."""

import re

from sparksift.llm import secrets


def test_many_matches(spark):
    one = "é token = abcdef" + "0123456789abcdef" * 2 + " x AKIA" + "A1" * 9 + " password:short "
    texts = [one * n for n in (0, 1, 63, 64, 65, 129, 2500)]
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    kinds = {"assign": (secrets.ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", "(?i:password|passwd|secret|token|api_?key)"), 2, 6), "access": (secrets.ACCESS, 0, 20), "hex": (secrets.HEX, 0, 24)}
    for r, t in zip(rows, texts, strict=True):
        for kind, (pattern, group, least) in kinds.items():
            want = [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t) if len(m[group]) >= least]
            assert [(s.start, s["end"], s.value) for s in r.secrets if s.kind == kind] == want
