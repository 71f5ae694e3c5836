"""Document audit, claims, splicing, harvest and composition on small fixtures."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from conftest import rows
from corpuslens.operators import audit, claims, documents, harvest, stack
from corpuslens.operators import manifests as man
from corpuslens.sources.transcripts import read_transcripts, transcript_items

PYPROJECT = '[project]\nname = "x"\nversion = "1.2.3"\ndependencies = [\n  "typer>=0.9",\n  "rich",\n]\n'


def _doc(spark, text, project="p"):
    return spark.createDataFrame([(project, "CLAUDE.md", text)], "project string, path string, text string")


def _messages(df):
    return [m for (m,) in rows(df, "message")]


def test_section_and_wording_checks(spark):
    heads = "\n".join(f"## {n}" for n, _ in audit.fixed.REQUIRED_SECTIONS)
    assert not rows(audit.text_check_findings(_doc(spark, heads), audit.coverage_checks()))
    prose = heads.replace("## Architecture", "the architecture is plain")
    assert not rows(audit.text_check_findings(_doc(spark, prose), audit.coverage_checks()))
    gone = heads.replace("## Architecture", "")
    assert rows(audit.text_check_findings(_doc(spark, gone), audit.coverage_checks()), "severity") == [("error",)]
    checks = audit.anti_pattern_checks()
    assert len(rows(audit.text_check_findings(_doc(spark, "x\n" * 501), checks))) == 1
    assert len(rows(audit.text_check_findings(_doc(spark, "x\n" * 19), checks))) == 1
    assert not rows(audit.text_check_findings(_doc(spark, "x\n" * 20), checks))
    noisy = "x\n" * 30 + "TODO a\nTODO b\nplease help\nWe use it\n```\n"
    assert len(rows(audit.text_check_findings(_doc(spark, noisy), checks))) == 4
    vague = "Be consistent.\n## Common Commands\nrun it\n## Anti-Patterns\nnone\n"
    assert len(rows(audit.text_check_findings(_doc(spark, vague), audit.specificity_checks()))) == 3


def test_references_and_accuracy(spark, files):
    tree = files({"p": {"src/app/main.py": "", "package.json": "{}"}})
    text = "see `src/app/main.py` `src/app/` `src/` `docs/gone.md` `docs/gone.md` `/etc/x.d` `make/x.y` `plain.md` greenfield React"
    stale = audit.stale_reference_findings(_doc(spark, text), tree)
    assert _messages(stale) == ["References path `docs/gone.md` which doesn't exist in the project"] * 2
    got = _messages(audit.accuracy_findings(_doc(spark, text), tree, stack.detected_tools(tree)))
    assert got == ['Lists "react" but it was not detected in dependencies']


def test_claims(spark, files):
    tree = files({"p": {"src/app.py": "", "pyproject.toml": PYPROJECT}})
    manifests = man.manifest_rows(tree)
    names = man.all_dependency_names(manifests)

    def report(text):
        doc = _doc(spark, text)
        checks = claims.claim_checks(doc, tree, manifests, names)
        return claims.reality_report(doc, checks).first(), sorted(r["category"] for r in claims.claim_findings(checks).collect())

    good = "- **Version**: 1.2.3\n- src/app.py\n\n## Dependencies\n\n- typer\n- **Rich**: x\n- core\n"
    assert report(good)[0]["reality_score"] == 100
    bad = "- **Version**: v9.9\n- src/nope.py\n\n## Dependencies\n- lodash[x]\n- a.b\n## Next\n- other\n"
    row, found = report(bad)
    assert (row["checks_run"], row["reality_score"], found) == (3, 0, ["missing_file", "unknown_dep", "version_mismatch"])
    row, found = report("nothing claimed")
    assert (row["checks_run"], row["reality_score"], found) == (0, 0, [])


def test_claimed_path_extension_order(spark):
    doc = _doc(spark, "at src/App.tsx and src/b.json")
    assert rows(claims.claimed_files(doc), "claim") == [("src/App.ts",), ("src/b.js",)]
    assert rows(claims.claimed_files(doc, bounded=True), "claim") == [("src/App.tsx",), ("src/b.json",)]


def test_splicing(spark):
    bullet = "- **Read first** — body"

    def splice(text, *bullets):
        doc = _doc(spark, text).withColumn("bullets", F.array(*[F.lit(b) for b in bullets]))
        r = harvest.spliced_documents(doc).first()
        return r["patched"], r["added"], r["skipped"]

    text = "# T\n\n## Anti-Patterns\n\n- **Old** — x\n\n## Dependencies\n\n- a\n"
    assert splice(text, bullet, "- **OLD** — again") == (
        "# T\n\n## Anti-Patterns\n\n- **Old** — x\n" + bullet + "\n\n## Dependencies\n\n- a\n", 1, 1)
    assert splice("# T\n\n## Dependencies\n- a\n", bullet) == (
        "# T\n\n## Anti-Patterns\n\n" + bullet + "\n\n## Dependencies\n- a\n", 1, 0)
    assert splice("# T\ntext", bullet) == ("# T\ntext\n\n## Anti-Patterns\n\n" + bullet + "\n\n", 1, 0)
    same = "## anti-patterns (local)\n- **read FIRST** — y\n"
    assert splice(same, bullet) == (same, 0, 1)


def test_harvest_from_files(spark, tmp_path):
    error = "File has not been read yet: /a/b.py line 12"
    for s in range(3):
        lines = [
            "not json", json.dumps({"cwd": "/w/p", "message": {"content": [{"type": "tool_use", "id": "1", "name": "Edit"}]}}),
            json.dumps({"message": {"content": "plain"}}),
            json.dumps({"message": {"content": [{"type": "tool_result", "tool_use_id": "1", "is_error": True,
                                                 "content": [{"type": "text", "text": error}, {"text": "x  y"}]}]}}),
            json.dumps({"message": {"content": [{"type": "tool_result", "tool_use_id": "9", "is_error": True, "content": f"odd {s}a"}]}}),
        ]
        (tmp_path / f"s{s}.jsonl").write_text("\n".join(lines) + "\n")
    items = transcript_items(read_transcripts(spark, str(tmp_path)))
    errors = harvest.paired_errors(items)
    found = harvest.with_advice(harvest.gotchas(errors)).collect()
    assert [(r["tool"], r["signature"], r["count"], r["sessions"], r["title"], len(r["examples"])) for r in found] == [
        ("Edit", "File has not been read yet: <PATH> line <N> x y", 3, 3, "Always Read before Edit/Write", 3)]
    assert sorted(r["tool"] for r in errors.collect()) == ["?", "?", "?", "Edit", "Edit", "Edit"]
    assert harvest.paired_errors(items, "/w/p").count() == 3
    assert harvest.gotchas(errors, min_count=4).count() == 0


def test_repeated_tool_id_takes_last_call_before(spark):
    data = [("s", 1, "use", "a", "Read", None, False, None), ("s", 2, "result", "a", None, None, True, "boom"),
            ("s", 3, "use", "a", "Bash", None, False, None), ("s", 4, "result", "a", None, None, True, "bang")]
    items = spark.createDataFrame(data, "session string, pos bigint, kind string, tool_id string, tool string, cwd string, is_error boolean, text string")
    assert rows(harvest.paired_errors(items), "pos", "tool") == [(2, "Read"), (4, "Bash")]


def test_composed_document(files):
    tree = {
        "pyproject.toml": PYPROJECT, "README.md": "# T\n\nThe SDK of Big Blue.\n", "src/main.py": "class Engine:\n    pass\n" * 3,
        "tests/test_a.py": "def test_a():\n    pass\n", "Makefile": "build:\n\tmake it\n", "Dockerfile": "CMD run\n",
    }
    text = documents.composed(documents.document_sections(files({"proj": tree}))).first()["text"]
    assert text.startswith("# CLAUDE.md — proj\n\n## Project Overview\n\nThe SDK of Big Blue.\n")
    for part in ("- **Version**: 1.2.3", "- **Language**: Python", "├── src/", "# build\nmake build", "- `Engine`", "### Core\n- typer\n- rich", "## Git Conventions"):
        assert part in text, part
    assert "\n\n\n" not in text and text.endswith("\n") and not text.endswith("\n\n")


def test_empty_corpus_gives_no_documents(files, spark):
    empty = spark.createDataFrame([], "project string, path string, text string")
    assert documents.composed(documents.document_sections(empty)).count() == 0
