import importlib
import sys


def test_entry_and_keys(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_corpus_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m in ("__spark_entry__", "corpus_pipeline") or m.startswith("vecsift.llm")]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "vecsift.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
            return None

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    e = importlib.import_module("__spark_entry__")
    assert "v4_topk_exact" in e.queries() and "pipeline" not in e.queries()
    monkeypatch.undo()
    sys.modules.pop("__spark_entry__", None)
