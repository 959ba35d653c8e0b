import ast
import importlib
import pathlib
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


def test_library_imports_nothing_of_the_pipeline_subpackage():
    for path in (ROOT / "timeloom").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or "", *(a.name for a in node.names)] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_entry_works_without_the_pipeline_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("timeloom.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith(("timeloom.llm", "corpus_pipeline")):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    import timeloom

    monkeypatch.delattr(timeloom, "llm", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries() and all(n.startswith("q_") for n in entry.queries()) and entry.oracle_sql().keys() <= entry.queries().keys()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_flagship(spark):
    from timeloom import queries

    out = queries.flagship(spark, "/root/testdata/sf0.001")
    assert out.columns == ["episode", "idx", "start", "end", "n", "cast", "lines"] and out.count() > 0
