"""The keywords that gate license rules never hide what a rule's expression finds."""

import re
from dataclasses import replace
from itertools import product

import duckdb
import pytest
from tables import documents, rows_of

from quillmap.llm import licenses
from quillmap.llm.licenses import NAMES, NOTICES, scan_licenses, signature_rules


def expanded(tokens) -> list[str]:
    """Texts that an expression matches: every alternative, every optional part with and without."""
    parts = []
    for op, arg in tokens:
        match str(op):
            case "LITERAL":
                parts.append([chr(arg)])
            case "NOT_LITERAL":
                parts.append(["x"])
            case "IN":
                parts.append([chr(a) for _, a in arg])
            case "BRANCH":
                parts.append([x for own in arg[1] for x in expanded(own)])
            case "SUBPATTERN":
                parts.append(expanded(arg[-1]))
            case "MAX_REPEAT":
                parts.append(["", *expanded(arg[2])] if arg[0] == 0 else expanded(arg[2]))
            case _:
                raise ValueError(op)
    return ["".join(p) for p in product(*parts)]


def test_every_alternative_holds_a_keyword_of_its_rule():
    bodies = {label: body for label, _, body in NAMES}
    for rule in signature_rules():
        body = bodies.get(rule.label, rule.body) if rule.label in bodies and bodies[rule.label] in rule.body else rule.body
        for text in expanded(re._parser.parse(body)):
            assert rule.keyword in text or (rule.also and rule.also in text), (rule, text)


@pytest.fixture(scope="module")
def notices():
    names = [x for _, _, body in NAMES for x in expanded(re._parser.parse(body))]
    texts = [f"licensed under the {x} license" for x in names] + [x for *_, body in NOTICES for x in expanded(re._parser.parse(body))]
    return list(enumerate(texts))


def test_the_sql_finds_what_the_scan_finds(spark, notices):
    """The check's gate hides nothing either: names spelled out and in short, and sentences of license texts."""
    names = ["doc_id", "n_words", "n_base", "base_labels", "labels", "score"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", notices)
    found = con.execute(licenses.scan_sql()).fetch_df()[names].itertuples(index=False, name=None)
    assert sorted(found) == sorted(rows_of(scan_licenses(documents(spark, notices, extra=False)), *names))


def test_few_rules_are_tried():
    """Of the texts that reach the rules, each opens fourteen of them or fewer; ten, the aim, is not reached."""
    rules, opened = signature_rules(), []
    for (text,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall():
        line = " " + re.sub(licenses.SEPARATORS, " ", text).strip().lower() + " "
        if any(phrase in line for phrase in licenses.GATE):
            opened.append(sum(" " + r.keyword in line or bool(r.also and " " + r.also in line) for r in rules))
    assert opened and sum(opened) <= 14 * len(opened), sum(opened) / len(opened)


def test_gated_result_equals_the_ungated(spark, notices, monkeypatch):
    names = ["doc_id", "labels", "score"]
    gated = rows_of(scan_licenses(documents(spark, notices, extra=False)), *names)
    monkeypatch.setattr(licenses, "signature_rules", lambda: [replace(r, keyword="") for r in signature_rules()])
    monkeypatch.setattr(licenses, "GATE", ("",))
    assert gated == rows_of(scan_licenses(documents(spark, notices, extra=False)), *names)


@pytest.mark.parametrize(
    "text, label",
    [
        ("under the Expat license", "mit"),
        ("under the Creative Commons Attribution license", "cc-by"),
        ("Licensed under the Creative Commons Attribution ShareAlike license", "cc-by-sa"),
        ("under the Creative Commons Attribution NoDerivatives license", "cc-by-nd"),
        ("under the Creative Commons Attribution NonCommercial ShareAlike license", "cc-by-nc-sa"),
        ("covered under the Open Database License", "odbl-1"),
    ],
)
def test_spelled_out_names_are_found(spark, text, label):
    """Words beside the notice do not decide."""
    found = rows_of(scan_licenses(documents(spark, [(1, text), (2, text + ". The summit hobby saga was windy and odd")], extra=False)), "labels")
    assert found[0] == found[1] and label in found[0][0].split(",")
