"""What holds for all modules, whatever they do."""

import ast
import pathlib

import pytest

ROOT = pathlib.Path(__file__).parents[1]
MODULES = [*ROOT.glob("*.py"), *ROOT.glob("seismolake/**/*.py")]


def bound(node: ast.stmt) -> list[str]:
    if isinstance(node, ast.FunctionDef | ast.ClassDef):
        return [node.name]
    if isinstance(node, ast.Import | ast.ImportFrom):
        return [(a.asname or a.name).split(".")[0] for a in node.names]
    return [t.id for t in node.targets if isinstance(t, ast.Name)] if isinstance(node, ast.Assign) else []


@pytest.mark.parametrize("path", MODULES, ids=lambda p: str(p.relative_to(ROOT)))
def test_no_name_is_bound_twice(path):
    """F3, F4 of the fourth review: a helper took the name of an imported one, which two queries above it call."""
    names = [n for node in ast.parse(path.read_text()).body for n in bound(node)]
    assert sorted(names) == sorted(set(names))
