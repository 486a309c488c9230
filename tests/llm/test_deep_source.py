import ast

import pytest

from loomline.llm.source_check import faults_of


def test_truncated_deep_json_is_faulty():
    for text in ("[" * 20_000, '{"a":' * 20_000, "[" * 20_000 + "]" * 19_999):
        assert faults_of("json", text), text[:10]
    assert faults_of("json", "[" * 20_000 + "]" * 20_000) == []


def test_python_whose_tree_is_too_deep():
    """RecursionError comes after the grammar has accepted the text; a broken one gives SyntaxError however long."""
    long = "x = " + "1 + " * 60_000
    with pytest.raises(RecursionError):
        ast.parse(long + "1")
    with pytest.raises(SyntaxError):
        ast.parse(long)
    assert faults_of("py", long + "1") == [] and faults_of("py", long) and faults_of("py", long + "1\ny = = 1\n")
