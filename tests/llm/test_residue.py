import json

import numpy as np
import pytest

from loomline.llm.residue import COVERAGE, coverage, find_residue, fit, units

DIFF = "diff --git a/x.html b/x.html\nindex 1..2 100644\n--- a/x.html\n+++ b/x.html\n@@ -1,3 +1,3 @@ body\n <p>{{ name }}</p>\n-<noscript>Please enable JavaScript to use this form.</noscript>\n+  <h1>404 - page not found</h1>\n"


def commit(message, author="Tallin Garpu <tallin.garpu@dev.example>", diff=DIFF):
    body = "\n".join("    " + x if x else "" for x in message.split("\n"))
    return f"commit {'0a' * 20}\nAuthor: {author}\nDate:   2024-01-01 10:00:00 +0000\n\n{body}\n\n{diff}"


BAD = [
    commit("Fix the parser\n\nReviewed-by: {reviewer}"), commit("<type>(<scope>): <subject>"), commit("Add tests", author="${author_name} <${author_email}>"), commit("Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor"),
    commit("asdf asdf asdf asdf asdf asdf"), commit("Please enable JavaScript and reload this page."), commit("Fix it", diff="<html>\n<head><title>502 Bad Gateway</title></head>\n<body>\n<h1>502 Bad Gateway</h1>\n</body>\n</html>\n"),
    "Your session has expired. Please log in.", commit("## What does this change?\n<!-- describe the change -->\n\n## How was it tested?\n<!-- list the steps -->"), commit("Veuillez activer JavaScript pour afficher ce commit."), commit("Zugriff verweigert. Bitte melden Sie sich neu an."),
    json.dumps({"sha": "0a" * 20, "author": {"name": "A B", "email": "a.b@x.example"}, "message": "Too many requests. Try again in 30 seconds.", "patch": DIFF}), '{"message": "Not Found", "status": "404"}', commit("Fix x", diff=DIFF).replace("\n", "\r\n") + "\r\nThe requested object could not be found on this server.",
]
GOOD = [
    None, "", "  \n ", commit("Fix the garpu cache\n\nCloses #12. No change for users of talnu."), commit("Replace placeholder text on the sign-up page"), commit('Test that "Too many requests" is retried'), commit("Escape `{{ title }}` in the welcome mail"), commit("Merge branch 'talnu' into main"),
    commit("Bump garpu from 1.2 to 1.2.3", author="Garpu-bot <bot@ci.example>"), commit("Behebe Fehlerpfad in talnu\n\nErledigt #3."), commit("修正: talnu キャッシュ"), commit("## What does this change?\nCloses #2.\n\n## How was it tested?\nNo change for users of garpu.\n\n- [ ] docs"),
    json.dumps({"sha": "0a" * 20, "author": {"name": "A B", "email": "a.b@x.example"}, "message": "Rework the talnu cache", "patch": DIFF}), commit("Run the formatter", diff="diff --git a/x.png b/x.png\nGIT binary patch\nliteral 12\nzasdfasdfasdfasdfasdfasdfasdfasdfasdfasdfasdf\n\n"),
]


@pytest.fixture(scope="module")
def models():
    return fit()


def test_units():
    got = [(u.part, u.text) for u in units(commit("Add x\n\nMore."))]
    assert got == [("author", "Tallin Garpu <tallin.garpu@dev.example>"), ("text", "Add x"), ("text", "More.")]
    assert [u.text for u in units("r12 | a.b | 2024-01-01 10:00:00 +0000 | 1 lines\n\nAdd x\n\nIndex: a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1 +1 @@\n-x\n+y\n")] == ["a.b", "Add x"]
    assert units(None) == [] and units(" \n") == []


def test_held_out_phrases(models):
    """Wording that no seed has."""
    bad = ["We could not find the page you were looking for. Try again later.", "Please turn on JavaScript to view the repository.", "{{ commit_message }}", "lorem ipsum lorem ipsum dolor", "jkl asdf jklf sdfjk lkjas", "Seite nicht verfügbar. Bitte melden Sie sich neu an.", "[insert your summary here]", "xxx xxx xxx xxx"]
    good = ["Use a smaller batch when the queue of mokavi is long", "Let vanoru retry once", "Document how sefimi orders its rows", "Entferne alte Spalten aus lomiva", "Corrige le calcul de varimo", "Move the check of tasive into rimoka"]
    share = coverage(models, bad + good).max(axis=1)
    assert (share[: len(bad)] >= COVERAGE).mean() >= 0.85 and (share[len(bad) :] < COVERAGE).all()


def test_fit_is_deterministic(models):
    again = fit()
    assert np.array_equal(models.mark, again.mark) and np.array_equal(models.ratio, again.ratio)


def test_find(spark):
    rows = [(i, t, "x") for i, t in enumerate(BAD + GOOD)] + [(99, "x" + "Fix the garpu cache\n" * 50_000 + "\nPlease enable JavaScript and reload this page.", "x"), (0, BAD[0], "x")]
    got = find_residue(spark.createDataFrame(rows, "doc_id int, text string, part string"), "doc_id", "text").collect()
    assert sorted(r.doc_id for r in got) == sorted([*range(len(BAD)), 99, 0])
    assert {r.part for r in got} == {"author", "text"} and {r.kind for r in got} == {"stand-in", "notice"} and all(r.coverage >= COVERAGE for r in got)
    assert find_residue(spark.createDataFrame([], "doc_id int, text string"), "doc_id", "text").count() == 0
