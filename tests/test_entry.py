import ast
import os

import __spark_entry__ as e

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"p1_found", "p2_found", "p3_found", "p5_found", "p6_found"} <= set(e.queries())


def test_nothing_else_imports_the_llm_package():
    for folder, _, files in os.walk(os.path.join(ROOT, "millrace")):
        if "llm" in os.path.relpath(folder, ROOT).split(os.sep):
            continue
        for f in (x for x in files if x.endswith(".py")):
            for node in ast.walk(ast.parse(open(os.path.join(folder, f), encoding="utf-8").read())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") for n in names), f
